"""Documents as token pieces, packed into as few sequences as possible (operator 11).

``cut`` encodes documents and cuts those above the capacity; ``place`` deals pieces to sequences by large-item
matching. Pieces above a third of the capacity can share a sequence with at most one more of their kind: from the
longest down, each takes the longest free partner that still fits (greedy matching, which opens no more sequences
than needed for them). The others then go, longest first, where the gap left is least (best fit).

How many pieces of each length there are decides everything, so the plan is made on the histogram of lengths: at
most ``capacity`` numbers, whatever the corpus. It names runs of equal steps ("pieces 0 to 999,999 of length 700
with pieces 0 to 999,999 of length 324"), and each piece finds its own run by its number among the pieces of its
length. Those numbers come from counts per writing task and running sums of them, so no length is numbered in one
task, however frequent it is.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import text_arrays as T
from panelwright.session import durable

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 1024
END = 2
KNOWN = 400_000  # encoded pre-tokens a worker remembers
LONGEST_KNOWN = 64  # bytes; longer ones are encoded each time
RUN_BYTES = 4_000_000
SPACE, LETTER, NUMBER, OTHER = range(4)
ADDED = ("piece", "start", "length", "ids")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point as the split pattern tells them apart: white space, letter, number, other."""
    import regex

    points = np.setdiff1d(np.arange(0x110000, dtype=np.uint32), np.arange(0xD800, 0xE000, dtype=np.uint32))
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, text):
            table[points[found.start() : found.end()]] = kind
    return table


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of every pre-token of UTF-8 texts laid end to end: runs of one class, a blank before one belongs to
    it, the last white space before other characters stands alone, and English contractions are cut off."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    at = np.zeros(n + 1, np.int64)
    np.cumsum((points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF) + 1, out=at[1:])
    opens = np.zeros(n + 1, bool)  # first character of a text
    opens[np.searchsorted(at, offsets)] = True
    opens[n] = True
    kind = classes()[points]
    space = kind == SPACE
    after_space, after_blank, changed = np.zeros(n, bool), np.zeros(n, bool), np.ones(n, bool)
    after_space[1:], after_blank[1:], changed[1:] = space[:-1], points[:-1] == 32, kind[1:] != kind[:-1]
    last_space = space.copy()
    last_space[:-1] &= ~space[1:] & ~opens[1:-1]
    last_space[-1] = False
    starts = opens[:-1] | np.where(space, ~after_space | last_space, np.where(after_space, ~after_blank, changed))
    quotes = np.flatnonzero((points == 39) & starts)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[~opens[quotes + 1]]
    one = points[quotes + 1]
    two = np.where(quotes + 2 < n, points[np.minimum(quotes + 2, n - 1)], 0)
    two[opens[np.minimum(quotes + 2, n)]] = 0
    letter, pair = lambda c: one == ord(c), lambda c: (one == ord(c[0])) & (two == ord(c[1]))
    size = np.where(letter("s") | letter("t") | letter("m") | letter("d"), 1, np.where(pair("re") | pair("ve") | pair("ll"), 2, 0))
    quotes, size = quotes[size > 0], size[size > 0]
    starts[quotes + 1] = False
    ends = quotes + 1 + size
    starts[ends[ends < n]] = True
    return at[:-1][starts]


class Encoder:
    """Ids of pre-tokens by the tokenizer's own merges, with a bounded memory of those already met."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.merge = Tokenizer.from_file(path).model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        # A byte-level vocabulary writes printable bytes as themselves and the others as characters from 256 on.
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.known: dict[bytes, bytes] = {}

    def one(self, part: bytes) -> bytes:
        ids = [t.id for t in self.merge(part.decode("latin-1").translate(self.letters))]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= LONGEST_KNOWN:
            self.known[part] = found
        return found

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in order and how many each has."""
        if len(self.known) > KNOWN:
            self.known.clear()
        ends = np.append(starts, len(data)).astype(np.int64)
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        parts = spans.dictionary_encode()
        text, ends = parts.dictionary.buffers()[2].to_pybytes(), np.frombuffer(parts.dictionary.buffers()[1], np.int64)[: len(parts.dictionary) + 1].tolist()
        get, one = self.known.get, self.one
        found = [get(p) or one(p) for p in map(text.__getitem__, map(slice, ends, ends[1:]))]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(sizes) - sizes
        kinds = parts.indices.to_numpy()
        counts = sizes[kinds]
        shift = np.repeat(first[kinds] - (np.cumsum(counts) - counts), counts)
        return flat[shift + np.arange(len(shift))], counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(data: np.ndarray, offsets: np.ndarray, codes: Encoder, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by ``end``, and the place where each text's ids begin (and the last end)."""
    starts = pre_tokens(data, offsets)
    found, counts = codes.ids(data, starts) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    rows = np.searchsorted(offsets, starts, "right") - 1
    per_row = np.bincount(rows, counts, len(offsets) - 1).astype(np.int64) + 1
    begins = np.concatenate([[0], np.cumsum(per_row)])
    ids = np.full(begins[-1], end, "<u4")
    ids[np.arange(len(found)) + np.repeat(rows, counts)] = found
    return ids, begins


def cut(docs: DataFrame, text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END) -> DataFrame:
    """One row per piece: the columns of ``docs`` without the text, ``piece int`` (from 0), ``start long`` (the
    document's ids before it), ``length long`` and ``ids binary`` (unsigned 32-bit, little-endian).

    A document is the ids of its whole text and ``end_id``; special tokens' names in a text are ordinary text. Only
    longer documents than ``capacity`` are cut: every piece but the first is full. Null and empty texts give one
    piece with ``end_id`` alone. Repeated rows are documents of their own. Columns of ``docs`` named like the added
    ones are replaced. Memory follows a run of texts of 4 MB, or one text if that is longer.
    """
    kept = [c for c in docs.columns if c not in (*ADDED, text_col)]
    rows = docs.select(F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in kept])
    nulls = {"piece": "int", "start": "long", "length": "long", "ids": "binary"}
    schema = rows.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast(nulls[c]).alias(c) for c in ADDED]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        for batch in batches:
            for first, end, data, offsets in T.runs(batch.column(0), RUN_BYTES):
                ids, begins = _encoded(data, offsets, codes, end_id)
                total = np.diff(begins)
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = (total - (pieces - 1) * capacity)[row]
                start = np.where(number == 0, 0, short + (number - 1) * capacity)
                length = np.where(number == 0, short, capacity)
                bounds = pa.py_buffer(4 * np.append(begins[row] + start, begins[-1]))
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, bounds, pa.py_buffer(ids)])
                others = [c.take(pa.array(row)) for c in batch.slice(first, end - first).columns[1:]]
                yield pa.RecordBatch.from_arrays([*others, pa.array(number, pa.int32()), pa.array(start), pa.array(length), whole.cast(pa.binary())], [*kept, *ADDED])

    return rows.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs of equal steps, sorted: columns length, number of the first piece, pieces per sequence, first sequence,
    place in it. ``counts``: pieces of each length from 1 to ``capacity``."""
    left = [counts.get(k, 0) for k in range(capacity + 1)]
    used = [0] * (capacity + 1)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)
    steps: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(length: int, n: int, each: int, first: int, place: int) -> None:
        steps.append((length, used[length], each, first, place))
        used[length] += n
        left[length] -= n

    def opens(n: int, room: int) -> None:
        nonlocal opened
        if room:
            gaps[room].append((opened, n))
        opened += n

    small = capacity // 3
    for length in range(capacity, small, -1):
        partner = min(capacity - length, length)
        while left[length] and partner > small:
            if partner == length:
                pairs = left[length] // 2
                if pairs:
                    put(length, 2 * pairs, 2, opened, 0)
                    opens(pairs, capacity - 2 * length)
            elif pairs := min(left[length], left[partner]):
                put(length, pairs, 1, opened, 0)
                put(partner, pairs, 1, opened, length)
                opens(pairs, capacity - length - partner)
            partner -= 1
        if alone := left[length]:
            put(length, alone, 1, opened, 0)
            opens(alone, capacity - length)

    for length in range(small, 0, -1):
        room = length
        while left[length]:
            while room < capacity and not gaps.get(room):
                room += 1
            if not gaps.get(room):
                opens(-(-left[length] // (capacity // length)), capacity)
            first, n = gaps[room].pop()
            each = room // length
            full = min(n, left[length] // each)
            rest = left[length] - full * each if full < n else 0
            if full:
                put(length, full * each, each, first, capacity - room)
                if room - each * length:
                    gaps[room - each * length].append((first, full))
            if rest:
                put(length, rest, rest, first + full, capacity - room)
                gaps[room - rest * length].append((first + full, 1))
            if n > full + bool(rest):
                gaps[room].append((first + full + bool(rest), n - full - bool(rest)))
    return np.array(sorted(steps), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All rows and columns of ``pieces`` plus ``sequence_id long`` (from 0) and ``offset long``: pieces of one
    sequence stand gapless from 0 and together hold at most ``capacity``.

    Lengths run from 1 to ``capacity``; others, nulls too, stop the job. Existing columns of the added names are
    replaced. Ties are dealt in the order in which rows are met.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_part", "_seat")]
    at = kept.index(length_col)
    rows = pieces.select(*[F.col(f"`{c}`") for c in kept])
    numbered = rows.select("*", F.lit(0).cast("int").alias("_part"), F.lit(0).cast("long").alias("_seat"))

    def seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
                raise ValueError(f"a piece must have 1 to {capacity} tokens")
            order = np.argsort(lengths, kind="stable")
            counts = np.bincount(lengths, minlength=capacity + 1)
            seat = np.empty(len(lengths), np.int64)
            seat[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(met, counts)
            met += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(seat)], [*kept, "_part", "_seat"])

    # Stored, because numbers must be the same for the counts and for the rows.
    stored = durable(rows.mapInArrow(seats, numbered.schema))
    length = F.col(f"`{length_col}`").cast("long")
    counts = stored.groupBy(F.col("_part").alias("_of"), length.alias("_length")).agg(F.count(F.lit(1)).alias("_n"))
    steps = plan({r["_length"]: r["n"] for r in counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    earlier = Window.partitionBy("_length").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_of", "_length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = stored.join(before, (F.col("_part") == F.col("_of")) & (length == F.col("_length")))
    ordinals = joined.select(*[F.col(f"`{c}`") for c in kept], (F.col("_before") + F.col("_seat")).alias("_seat"))
    schema = ordinals.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    keys = (steps[:, 0] << 44) + steps[:, 1]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(at).cast(pa.int64()).to_numpy()
            seat = batch.column(len(kept)).to_numpy()
            step = steps[np.searchsorted(keys, (lengths << 44) + seat, "right") - 1]
            turn = seat - step[:, 1]
            made = [pa.array(step[:, 3] + turn // step[:, 2]), pa.array(step[:, 4] + turn % step[:, 2] * lengths)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*kept, "sequence_id", "offset"])

    return ordinals.mapInArrow(dealt, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``length long``, ``ids binary`` and ``starts array<long>`` of the pieces in it."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside.alias("inside"))
    joined = F.aggregate("inside", F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    return rows.select("sequence_id", "length", joined.alias("ids"), F.col("inside.offset").alias("starts"))
