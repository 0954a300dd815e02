"""Benchmark items in documents, also re-parameterised ones, by template windows (operator 8).

Both sides are cut into tokens and made canonical: numbers, names (capitalised words inside a sentence) and
units after a number become typed placeholders, other words lower case. Every run of five canonical tokens is
a template window; an item of fewer than nine tokens is one window of its own length. The word that opens a
sentence may be a name or not, so a window that begins with it has both readings. Documents and items meet by
a hash join on the window. Windows of a document belong together if their places follow the item's with a drift of no
more than the item's own length (words put in or left out); windows scattered over a document don't add up. For each
(document, item, stretch of shifts) the operator counts the item's windows found and collects what the placeholders
stand for on both sides: a re-parameterised copy replaces a value by the same value everywhere (two values may become
one), so windows with another value than most of them hold are dropped. An item is found in a document if enough of its
windows agree in one stretch.

Scale: windows of documents are first looked up in a Bloom filter of the item windows, whose size is fixed;
what passes is joined exactly, by a shuffle if the items are many. Documents themselves aren't shuffled; they
only learn their verdict by a join on a 16-byte text digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import text_arrays as T
from panelwright.session import durable

WIDTH = 5
COVERAGE = 0.8
BLOOM_BITS = 23
# Unit words that follow a number.
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "years", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "degrees", "meters", "metres", "litres", "liters", "grams")
# Words that open a sentence and are no names.
OPENERS = ("a", "an", "all", "and", "are", "as", "at", "but", "by", "can", "compute", "could", "describe", "did", "do", "does", "each", "every", "explain", "find", "for", "from", "given", "has", "have", "he", "how", "if", "in", "is", "it", "let", "my", "name", "no", "of", "on", "or", "our", "she", "should", "some", "that", "the", "their", "there", "these", "they", "this", "those", "to", "was", "we", "were", "what", "when", "where", "which", "who", "whom", "whose", "why", "will", "with", "would", "write", "you", "your", "der", "die", "das", "ein", "eine", "wer", "wie", "was", "wo", "le", "la", "les", "un", "une", "que", "qui", "quel", "quelle", "el", "los", "las", "una", "quien", "cual")
NUMBER, NAME, UNIT = (np.uint64(x) for x in (11, 12, 13))

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the accented capitals of the two-byte Latin range."""
    out = T.FOLD[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(T.span_hashes(np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([0, *map(len, words[:-1])]), np.cumsum([*map(len, words)])))


_UNIT_HASHES, _OPENER_HASHES = _hashes(UNITS), _hashes(OPENERS)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, canonical hash, slot value (0: not a slot) and, for a capitalised word that opens a sentence, its value as a name of every token."""
    low, digit = _folded(data), _DIGIT[data]
    inside = _WORD[data].copy()
    if len(data) > 2:  # 3.5 and 1,000 are one number; the neighbours may not belong to other texts
        inner = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
        inner &= ~np.isin(np.arange(1, len(data) - 1), offsets) & ~np.isin(np.arange(2, len(data)), offsets)
        inside[1:-1] |= inner
    starts, ends, rows = T.words(inside, offsets)
    if not len(starts):
        return rows, *[np.zeros(0, np.uint64)] * 3
    raw = T.span_hashes(low, starts, ends)
    number = digit[starts] & ~_has_letter(data, starts, ends)
    # A name begins with a capital and goes on in lower case, so texts written all in capitals have none.
    upper = _upper(data, low)
    second = starts + 1 + (data[starts] >= 0xC0)
    capital = upper[starts] & (second < ends)
    capital[capital] &= ~upper[second[capital]] & ~digit[second[capital]]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    previous = np.concatenate([[0], ends[:-1]])
    opening = np.concatenate([[True], rows[1:] != rows[:-1]]) | (stops[starts] > stops[previous])
    after_number = np.concatenate([[False], number[:-1] & (rows[1:] == rows[:-1])])
    unit = np.isin(raw, _UNIT_HASHES) & after_number & ~number
    name = capital & ~opening & ~number & ~unit
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, np.uint64(0))))
    value, none = np.maximum(raw, np.uint64(1)), np.uint64(0)
    return rows, np.where(kind > 0, T.mix(kind), raw), np.where(kind > 0, value, none), np.where(capital & opening & (kind == 0), value, none)


def _upper(data: np.ndarray, low: np.ndarray) -> np.ndarray:
    """At the first byte of every capital."""
    upper = (data >= 65) & (data <= 90)
    if len(data) > 1:
        upper[:-1] |= (data[:-1] == 0xC3) & (low[1:] != data[1:])
    return upper


def _has_letter(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    letters = np.concatenate([[0], np.cumsum(_WORD[data] & ~_DIGIT[data])])
    return letters[ends] > letters[starts]


WINDOWS = "digest binary, place int, window long, slots array<long>, whole boolean, fixed boolean"
_NAME_HASH = T.mix(np.array([NAME], np.uint64))[0]


def _window_batch(digests: list[bytes], rows: np.ndarray, hashes: np.ndarray, slots: np.ndarray, names: np.ndarray, width: int, bloom: np.ndarray | None, second: bool) -> pa.RecordBatch:
    """Windows of ``width``; ``second``: in the other reading of their first word, a name."""
    first, found = T.windows(hashes, rows, width, np.where(names > 0, _NAME_HASH, hashes) if second else None)
    if bloom is not None and len(found):
        passed = _bits(bloom, found)
        first, found = first[passed], found[passed]
    starts = np.searchsorted(rows, rows[first]) if len(first) else first
    ends = np.searchsorted(rows, rows[first], "right") if len(first) else first
    grid = np.minimum(first[:, None] + np.arange(width), max(len(rows) - 1, 0))
    within = first[:, None] + np.arange(width) < ends[:, None]
    values = np.where(within, slots[grid], np.uint64(0)) if len(first) else np.zeros((0, width), np.uint64)
    if second and len(first):
        values[:, 0] = names[first]
    # A word that is no name stands for itself in either reading.
    fixed = np.isin(names[first], _OPENER_HASHES) & second if len(first) else np.zeros(0, bool)
    flat = pa.array(values.astype(np.uint64).view(np.int64).ravel(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([digests[r] for r in rows[first]], pa.binary()), pa.array((first - starts).astype(np.int32)), pa.array(found.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * width), flat), pa.array(ends - starts <= width), pa.array(fixed),
        ],
        ["digest", "place", "window", "slots", "whole", "fixed"],
    )


def _bits(bloom: np.ndarray, found: np.ndarray) -> np.ndarray:
    low, mask = np.uint64(24), np.uint64((1 << BLOOM_BITS) - 1)
    return bloom[(found & mask).astype(np.int64)] & bloom[((found >> low) & mask).astype(np.int64)]


def _own_windows(digests: list[bytes], rows: np.ndarray, hashes: np.ndarray, slots: np.ndarray, names: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Windows of items: those of fewer than ``2 * width - 1`` tokens are one window. Only an item's first word has two readings."""
    size = np.bincount(rows, minlength=len(digests))[rows]
    names = np.where(np.concatenate([[True], rows[1:] != rows[:-1]])[: len(rows)], names, np.uint64(0))
    for w in range(1, 2 * width):
        held = size == w if w < 2 * width - 1 else size >= w
        for second in (False, True) if held.any() else ():
            yield _window_batch(digests, rows[held], hashes[held], slots[held], names[held], w if w < 2 * width - 1 else width, None, second)


def template_windows(texts: DataFrame, text_col: str, width: int = WIDTH, bloom: np.ndarray | None = None, lengths: tuple[int, ...] = ()) -> DataFrame:
    """Template windows of documents, of ``width`` and all ``lengths``, that may be in ``bloom``; without one, those of items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column(0).to_pylist()
            for first, end, data, offsets in T.runs(batch.column(1)):
                rows, hashes, slots, names = canonical(data, offsets)
                if bloom is None:
                    yield from _own_windows(digests[first:end], rows, hashes, slots, names, width)
                    continue
                names[np.isin(names, _OPENER_HASHES)] = 0
                for w in sorted({width, *lengths}):
                    for second in (False, True):
                        yield _window_batch(digests[first:end], rows, hashes, slots, names, w, bloom, second)

    source = texts.where(F.col(f"`{text_col}`").isNotNull()).select(F.unhex(F.md5(F.col(f"`{text_col}`"))).alias("digest"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(cut, WINDOWS)


def _bloom(windows: DataFrame) -> np.ndarray:
    """Bits of the item windows, or-ed together: the same size however many items there are."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            bits[((found >> np.uint64(24)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], ["at", "bits"])

    words = np.zeros((1 << BLOOM_BITS) // 64, np.int64)
    merged = windows.select("window").distinct().mapInArrow(own, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    for r in merged.toLocalIterator():
        words[r["at"]] = r["bits"]
    return np.unpackbits(words.view(np.uint8)).astype(bool)


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """``digest, item, share``: items found in texts, by the md5 digest of the text."""
    sized = items.where(F.col(f"`{item_text_col}`").isNotNull()).select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    own = template_windows(sized, "text", width).distinct()
    named = sized.select("item", F.unhex(F.md5("text")).alias("digest")).distinct()
    own = durable(own.select("digest", F.col("place").alias("item_place"), "window", F.col("slots").alias("item_slots"), F.col("fixed").alias("item_fixed")))
    sizes = own.groupBy("digest").agg(F.countDistinct("item_place").alias("n"))
    lengths = tuple(r["size"] for r in own.select(F.size("item_slots").alias("size")).distinct().collect())  # below 2 * width - 1
    met = template_windows(docs, text_col, width, _bloom(own), lengths).join(own.withColumnRenamed("digest", "item_digest"), "window")
    # Fewer than width words are no template: inside a longer text they must be the item's own.
    same = (F.col("slots") == F.col("item_slots")) | (F.size("item_slots") >= width) | F.col("whole")
    met = met.where(same & (~F.col("item_fixed") | (F.get("slots", F.lit(0)) == F.get("item_slots", F.lit(0)))))
    met = met.select("digest", "item_digest", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda s: (s["a"] != 0) | (s["b"] != 0)).alias("pairs"))
    # Two overlapping rows of stretches: shifts that lie within the drift share at least one of them.
    met = met.join(sizes.withColumnRenamed("digest", "item_digest"), "item_digest").withColumn("drift", F.greatest(F.col("n"), F.lit(2 * width)))
    stretches = F.array(2 * F.floor(F.col("shift") / (2 * F.col("drift"))), 2 * F.floor((F.col("shift") + F.col("drift")) / (2 * F.col("drift"))) + 1)
    met = durable(met.select("digest", "item_digest", "item_place", "pairs", "n", F.explode(stretches).alias("stretch")))
    # A slot value of the item stands for one value in the document: the one that most windows of a stretch hold. Others
    # take only their own windows along. Two item values may become the same one.
    at = ["digest", "item_digest", "stretch"]
    counts = met.select(*at, "item_place", F.explode(F.array_distinct("pairs")).alias("p")).groupBy(*at, "p").agg(F.countDistinct("item_place").alias("k"))
    chosen = counts.groupBy(*at, F.col("p.a").alias("a")).agg(F.max(F.struct("k", (F.col("p.a") == F.col("p.b")).alias("same"), F.col("p.b").alias("b"))).alias("best"), F.collect_list("p").alias("all"))
    minor = chosen.select(*at, F.explode(F.filter("all", lambda p: p["b"] != F.col("best.b"))).alias("p")).groupBy(*at).agg(F.collect_list("p").alias("minor"))
    agreed = met.join(minor, at, "left").where(F.col("minor").isNull() | ~F.arrays_overlap("pairs", "minor"))
    found = agreed.groupBy(*at, "n").agg(F.countDistinct("item_place").alias("hits"))
    found = found.groupBy("digest", "item_digest").agg(F.max(F.col("hits") / F.col("n")).alias("share")).where(F.col("share") >= coverage)
    return found.join(named.withColumnRenamed("digest", "item_digest"), "item_digest").select("digest", "item", "share")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """All columns of ``docs`` plus ``contaminated``, ``items`` (sorted ids) and ``share`` (best share of an item's windows).

    Existing columns of these names are replaced. Every row comes back once and equal texts get equal verdicts.
    Null and empty texts, and texts without words, are clean, as is everything if there are no items; items with null or wordless text match
    nothing. An item of fewer than ``2 * width - 1`` words is found as a whole; one of fewer than ``width`` words
    with other values only in a text of nothing else. Items with the same text are all named.
    """
    found = find_items(docs, items, text_col, item_col, item_text_col, width, coverage)
    verdict = found.groupBy("digest").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("share").alias("share"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("contaminated", "items", "share")])
    rows = docs.select(row.alias("row"), F.unhex(F.md5(F.col(f"`{text_col}`"))).alias("digest")).join(verdict, "digest", "left")
    empty = F.array().cast(dict(verdict.dtypes)["items"])
    return rows.select("row.*", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", empty).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share"))
