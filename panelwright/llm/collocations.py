"""Phrases whose words occur together more often than apart (operator 12).

Every word opens a suffix: its language and up to four words of its piece, the longest phrase that begins there.
Suffixes are routed by their leading words: ranges of routing codes, cut at sampled splitters, so that a frequent
first word, or a frequent pair, is spread over several ranges by the words that follow. Each range is one task,
which orders pointers to its suffixes by multikey three-way quicksort: a pivot word splits them into smaller, equal
and larger ones; the size of an equal part is the count of the phrase so far, and the part goes on with the next
word. Parts below the least count are abandoned at once. Only phrases that a splitter cuts in two leave a range
as partial counts, whatever their size, and are added up afterwards.

Before the exchange each run of texts collapses its equal suffixes, so a passage that a third of all documents
holds travels once per run. Words travel as text in small dictionaries: codes route, they never decide equality.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm import text_arrays as T
from panelwright.session import durable

WORDS = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
COVERED = (80, 100)
NO_LANG = "und"
RANGE_BYTES = 16_000_000  # text per range
RUN_BYTES = 4_000_000
KEYS_PER_RANGE, MOST_KEYS = 100, 1_000_000  # splitter samples, as Spark's own range partitioner bounds them
SMALL = 4096
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?\n\x0b\x0c\r"]] = True
BLANKS = np.zeros(256, bool)
BLANKS[[9, 32]] = True
KEY = f"S{4 * (WORDS + 1)}"
GROUPS = "lang string, words int, phrase string, n long"


class Suffixes:
    """Distinct suffixes of one run in routing order: columns of word numbers (0: the piece has ended), their counts
    and the texts and routing codes behind the numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array) -> None:
        data = T.FOLD[data]
        breaks = BREAKS[data]
        inside = ~(breaks | BLANKS[data])
        starts, ends, row = T.words(inside, offsets)
        kinds, words = T.coded(data, inside, ends - starts)
        tongues = langs.cast(pa.large_binary()).dictionary_encode()
        self.texts = pa.concat_arrays([words, tongues.dictionary])
        codes = np.concatenate([route_codes(words), route_codes(tongues.dictionary)])
        self.codes = np.zeros(len(codes) + 1, np.uint32)
        # Numbers follow the codes, words before languages, so the order of numbers is the routing order.
        order = np.concatenate([np.argsort(codes[: len(words)], kind="stable"), len(words) + np.argsort(codes[len(words) :], kind="stable")])
        self.texts, self.codes[1:] = self.texts.take(pa.array(order)), codes[order]
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(1, len(order) + 1)
        crossed = np.cumsum(breaks, dtype=np.int32)[starts]
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (row[1:] == row[:-1]) & (crossed[1:] == crossed[:-1])
        columns = [number[len(words) + tongues.indices.to_numpy()[row]], number[kinds]]
        for _ in range(WORDS - 1):
            later = np.zeros(len(starts), np.int32)
            later[:-1] = columns[-1][1:]
            columns.append(np.where(follows, later, 0).astype(np.int32))
        radix = np.int64(len(order) + 1)
        high = (columns[0] * radix + columns[1]) * radix + columns[2]
        low = columns[3] * radix + columns[4]
        at = np.lexsort((low, high))
        new = np.ones(len(at), bool)
        new[1:] = (high[at][1:] != high[at][:-1]) | (low[at][1:] != low[at][:-1])
        first = np.flatnonzero(new)
        self.counts = np.diff(np.append(first, len(at)))
        self.columns = [c[at[first]] for c in columns]

    def __len__(self) -> int:
        return len(self.counts)

    def keys(self) -> np.ndarray:
        table = np.empty((len(self), WORDS + 1), ">u4")
        for k, c in enumerate(self.columns):
            table[:, k] = self.codes[c]
        return table.reshape(-1).view(KEY)

    def packed(self, begin: int, end: int) -> bytes:
        """Suffixes ``begin`` to ``end`` with the words they use, compressed."""
        columns = [c[begin:end] for c in self.columns]
        used = np.unique(np.concatenate(columns))
        used = used[used > 0]
        number = np.zeros(len(self.codes), np.int32)
        number[used] = np.arange(1, len(used) + 1)
        own = self.texts.take(pa.array(used - 1))
        ends = np.frombuffer(own.buffers()[1], np.int64)[: len(used) + 1]
        kind = "<u2" if len(used) < 65536 else "<u4"
        body = [np.diff(ends).astype("<u4").tobytes(), own.buffers()[2].to_pybytes()[: ends[-1]]]
        body += [number[c].astype(kind).tobytes() for c in columns]
        body.append(self.counts[begin:end].astype("<u4").tobytes())
        raw = b"".join(body)
        head = struct.pack("<4q", len(raw), len(used), int(ends[-1]), end - begin)
        return head + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(blob: bytes) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """Words, columns and counts of ``Suffixes.packed``."""
    size, used, text, n = struct.unpack_from("<4q", blob)
    raw = pa.Codec("zstd").decompress(memoryview(blob)[32:], size, asbytes=True)
    sizes = np.frombuffer(raw, "<u4", used).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    place = 4 * used
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), used, [None, pa.py_buffer(ends), pa.py_buffer(raw[place : place + text])])
    place += text
    kind = np.dtype("<u2" if used < 65536 else "<u4")
    columns = []
    for _ in range(WORDS + 1):
        columns.append(np.frombuffer(raw, kind, n, place))
        place += n * kind.itemsize
    return words, columns, np.frombuffer(raw, "<u4", n, place).astype(np.int64)


def route_codes(texts: pa.Array) -> np.ndarray:
    """32-bit code of each word, never 0, which is the code of a piece's end."""
    codes = np.ones(len(texts), np.uint32)
    filled = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    if len(filled):
        codes[filled] = np.maximum(T.binary_hashes(texts.take(pa.array(filled))) >> np.uint64(32), 1)
    return codes


def three_way(columns: list[np.ndarray], counts: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(words, suffix, count)`` of every language (0 words) and phrase that occurs ``least`` times or more; the
    suffix is one that begins with it. Pointers are ordered by multikey three-way quicksort."""
    found: list[tuple[int, int, int]] = []
    pointers = np.arange(len(counts))
    waiting = [(0, len(counts), 0)] if counts.sum() >= least else []
    while waiting:
        low, high, depth = waiting.pop()
        part = pointers[low:high]
        key = columns[depth][part]
        if high - low <= SMALL:  # a small part is ordered at once
            order = np.argsort(key, kind="stable")
            part[:] = part[order]
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.add.reduceat(counts[part], first)
            wanted = np.flatnonzero((sizes >= least) & (key[first] > 0))
            ends = np.append(first, len(key))
            equals = zip((low + first[wanted]).tolist(), (low + ends[wanted + 1]).tolist(), sizes[wanted].tolist(), strict=True)
        else:
            pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
            below, above = key < pivot, key > pivot
            parts = part[below], part[~(below | above)], part[above]
            part[:] = np.concatenate(parts)
            cuts = low, low + len(parts[0]), high - len(parts[2]), high
            sizes = [int(counts[p].sum()) for p in parts]
            for k in (0, 2):
                if sizes[k] >= least:
                    waiting.append((cuts[k], cuts[k + 1], depth))
            equals = [(cuts[1], cuts[2], sizes[1])] if pivot and sizes[1] >= least else []
        for begin, end, size in equals:
            found.append((depth, int(pointers[begin]), size))
            if depth < WORDS:
                waiting.append((begin, end, depth + 1))
    return found


def range_counts(blobs: Iterator[bytes], borders: list[bytes], least: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``GROUPS`` of one range: whole counts from ``least`` on, partial ones of what ``borders`` cut."""
    texts, columns, counts, shift = [], [], [], 0
    for blob in blobs:
        words, found, n = unpacked(blob)
        texts.append(words)
        columns.append([np.where(c > 0, c.astype(np.int32) + shift, 0) for c in found])
        counts.append(n)
        shift += len(words)
    if not counts:
        return
    kinds = pa.concat_arrays(texts).dictionary_encode()
    number = np.concatenate([[0], kinds.indices.to_numpy() + 1]).astype(np.int32)
    columns = [number[np.concatenate(c)] for c in zip(*columns, strict=True)]
    counts = np.concatenate(counts)
    words = kinds.dictionary
    codes = np.concatenate([np.zeros(1, np.uint32), route_codes(words)])
    partial: list[tuple[int, int, int]] = []
    cut: set[tuple[int, ...]] = set()
    for border in dict.fromkeys(borders):
        wanted = np.frombuffer(border.ljust(4 * (WORDS + 1), b"\0"), ">u4")
        waiting = [((), np.arange(len(counts)))]
        while waiting:
            path, rows = waiting.pop()
            depth = len(path)
            if not wanted[depth]:
                continue
            rows = rows[codes[columns[depth][rows]] == wanted[depth]]
            ids = columns[depth][rows]
            for own in ids[:1] if (ids == ids[:1]).all() else np.unique(ids):  # words of one code are told apart
                at = rows[ids == own]
                if (longer := (*path, int(own))) not in cut:
                    cut.add(longer)
                    partial.append((depth, int(at[0]), int(counts[at].sum())))
                if depth < WORDS:
                    waiting.append((longer, at))
    found = [x for x in three_way(columns, counts, least) if not cut or tuple([int(columns[k][x[1]]) for k in range(x[0] + 1)]) not in cut]
    found += partial
    # Languages are always passed on, for their totals.
    known = {int(columns[0][x[1]]) for x in found if x[0] == 0}
    for lang in set(np.flatnonzero(np.bincount(columns[0])).tolist()) - known:
        rows = np.flatnonzero(columns[0] == lang)
        found.append((0, int(rows[0]), int(counts[rows].sum())))
    text = words.to_pylist()
    for k in range(0, len(found), 50_000):
        part = found[k : k + 50_000]
        paths = [[text[columns[d][row] - 1] for d in range(depth + 1)] for depth, row, _ in part]
        made = [pa.array([p[0] for p in paths], pa.binary()).cast(pa.string()), pa.array([x[0] for x in part], pa.int32())]
        made += [pa.array([b" ".join(p[1:]) for p in paths], pa.binary()).cast(pa.string()), pa.array([x[2] for x in part], pa.int64())]
        yield pa.RecordBatch.from_arrays(made, ["lang", "words", "phrase", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    for batch in batches:
        for first, end, data, offsets in T.runs(batch.column(0), RUN_BYTES):
            run = Suffixes(data, offsets, batch.column(1).slice(first, end - first).fill_null(NO_LANG))
            if len(run):
                yield run


def splitters(texts: DataFrame, ranges: int, size: int) -> list[bytes]:
    """Routing keys that cut the suffixes into about equal ranges, from a sample; they decide balance only."""
    if ranges < 2:
        return []
    share = min(1.0, max(0.01, 4 * RUN_BYTES / size))
    wanted = min(KEYS_PER_RANGE * ranges, MOST_KEYS)
    every = max(1, int(size * share / 8 / wanted))  # a word and its blank take about six bytes; some suffixes collapse

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            keys = run.keys()[every // 2 :: every]
            yield pa.RecordBatch.from_arrays([pa.array([k.ljust(4 * (WORDS + 1), b"\0") for k in keys.tolist()], pa.binary())], ["key"])

    keys = sorted(r["key"] for r in texts.sample(share, 7).mapInArrow(drawn, "key binary").collect())
    return sorted({bytes(keys[len(keys) * k // ranges]) for k in range(1, ranges)}) if keys else []


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``lang, words, phrase, n`` of every phrase of 1 to 4 words that occurs ``least`` times or more within pieces of
    its language, overlaps included; rows with 0 words hold a language's word total. Null languages are ``und``."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cuts = splitters(texts, math.ceil(size / range_bytes), size)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = np.array(cuts, KEY)
        for run in _runs(batches):
            bounds = np.concatenate([[0], np.searchsorted(run.keys(), borders, "left"), [len(run)]]) if cuts else np.array([0, len(run)])
            held = np.flatnonzero(np.diff(bounds))
            for k in range(0, len(held), 64):
                part = held[k : k + 64]
                blobs = [run.packed(int(bounds[r]), int(bounds[r + 1])) for r in part]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], ["range", "suffixes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        of = None
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if of is not None and r != of:
                    yield from range_counts(held, cuts[max(of - 1, 0) : of + 1], least)
                    held = []
                of = r
                held.append(blob)
        if of is not None:
            yield from range_counts(held, cuts[max(of - 1, 0) : of + 1], least)

    routed = texts.mapInArrow(route, "range int, suffixes binary").repartitionById(len(cuts) + 1, F.col("range"))
    groups = routed.mapInArrow(count, GROUPS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return groups.where((F.col("n") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int | None = TOP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ``top`` phrases of each language (all, if None): ``lang, rank, phrase, a, l, r, n, score``.

    Texts lose A-Z to a-z, are cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at blanks and
    tabs. ``a`` counts the phrase of 2 to 4 words, ``n`` all words of the language. Of the cuts of a phrase into two
    parts (counts ``l`` and ``r``) the one with the least ``floor(2000000 a / (l + r))`` gives the score, the earliest
    of equal ones. A phrase within a longer one that has 80 % of its count is dropped. Ranks follow score, count, then
    the phrase's bytes. Null texts are empty; null languages are ``und``; repeated rows count each time; other
    columns are not read. An empty table gives no rows. A word of any length is a word.
    """
    counts = durable(phrase_counts(docs, text_col, lang_col, least, range_bytes))
    phrases = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words", F.split("phrase", " ").alias("w"))
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = phrases.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    firsts = counts.where("words BETWEEN 1 AND 3").select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rests = firsts.select("lang", F.col("first").alias("rest"), F.col("l").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).withColumn("product", wide("a") * F.lit(SCALE).cast("decimal(10,0)")).withColumn("parts", wide("l") + wide("r"))
    scored = scored.withColumn("score", F.expr("product div parts"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.score", "b.l", "b.r")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: joined(start, size))))
    inner = phrases.where("words > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(COVERED[1]) * wide("longer") < F.lit(COVERED[0]) * wide("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
