"""Removal of long byte strings that occur more than once, by prefix doubling over sampled positions (operator 9).

A byte goes if it is covered by a ``length``-byte string that also starts somewhere else. Doubling ranks
positions by strings of growing length and drops a position as soon as its rank is unique. Ranking every byte
of a corpus would shuffle it dozens of times over, so the first round ranks sampled positions only, in a way
that loses nothing: every start s is represented by m(s), the position of the least hash among the short
strings (about a quarter of ``length``) beginning in s's window. m depends on the window's bytes alone, so equal windows have equal
representatives at equal distance, and neighbouring starts share one. Then

1. representatives are ranked by their short string; unique ones are dropped with all their starts;
2. the rest are ranked at the full offset, by the whole stretch that their starts' windows cover: a stretch
   that occurs again makes all its starts repeated; a short string with one stretch only is settled;
3. where one short string stands in different stretches (the borders of repeated passages), each different
   stretch ranks its starts, first 16 at a time, then 4, then one: if what the windows of such a block have in
   common is unique, none of its starts is repeated; if what they cover together occurs again, all are; only
   blocks in between go on to the next round.

Ranks are fingerprints (64 bits for the short string, and 64 more for what is compared within its group) instead of sort positions: equal strings get equal ranks, which is all that reranking needs.

Scale: rounds shuffle fixed-size rows, about one per hundred bytes in the first; counts are combined before the
shuffle, so a passage in a third of all documents is no hot task. Texts travel compressed and once per
distinct text. Memory follows one text or one run of texts; long texts are scanned in overlapping segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import text_arrays as T
from panelwright.session import durable

LENGTH = 400
SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, short-string hash, representative, first start and last start (places in ``data``), by segments.

    ``data`` are bytes, or 64-bit hashes of larger units such as words."""
    span = 3 * length // 4
    short = length - span + 1
    for base in range(0, max(len(data), 1), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        if len(part) < length:
            return
        power, inverse = T.powers(SEGMENT + 65536)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((T.BYTE_KEYS[part] if part.dtype == np.uint8 else part) * power[: len(part)], dtype=np.uint64)])
        raw = T.mix((sums[short:] - sums[:-short]) * inverse[: len(part) - short + 1])
        keys = (raw & ~_PLACE) | np.arange(len(raw), dtype=np.uint64)  # ties: the first place
        blocks = -(-len(keys) // span)
        square = np.full(blocks * span, np.iinfo(np.uint64).max)
        square[: len(keys)] = keys
        square = square.reshape(blocks, span)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        n = min(len(keys) - span + 1, SEGMENT)
        chosen = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & _PLACE).astype(np.int64)
        starts = np.arange(base, base + n)
        rows = np.searchsorted(offsets, starts, "right") - 1
        inside = starts + length <= offsets[rows + 1]
        chosen, starts, rows = chosen[inside], starts[inside], rows[inside]
        if not len(starts):
            continue
        new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(starts)]]) - 1
        yield rows[first], raw[chosen[first]], chosen[first] + base, starts[first], starts[last]


def digest(text: bytes | memoryview) -> bytes:
    return xxhash.xxh3_128_digest(text)


def text_rows(texts: DataFrame, text_col: str) -> DataFrame:
    return texts.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def sampled(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """``h, c, t, low, more, at``: short-string rank, stretch rank, text digest, first start of each stretch, number of
    further starts, and the representative's distance from the first start."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in T.runs(batch.column(0), SEGMENT):
                view = memoryview(data)
                digests = [digest(view[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]
                for rows, h, at, low, high in stretches(data, offsets, length):
                    c = np.array([xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array([digests[r] for r in rows.tolist()], pa.binary()), pa.array(low - offsets[rows]), pa.array((high - low).astype(np.int32)), pa.array((at - low).astype(np.int32))], ["h", "c", "t", "low", "more", "at"]
                    )

    return text_rows(docs, text_col).mapInArrow(sample, "h long, c long, t binary, low long, more int, at int")


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``t, z``: digest and compressed bytes, once per distinct text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for _, _, data, offsets in T.runs(batch.column(0), SEGMENT):
                parts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(offsets) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in parts], pa.binary()), pa.array([press.compress(x) for x in parts], pa.binary())], ["t", "z"])

    return text_rows(docs, text_col).mapInArrow(pack, "t binary, z binary").groupBy("t").agg(F.first("z").alias("z"))


def border_bytes(texts: DataFrame, borders: DataFrame, length: int) -> DataFrame:
    """``h, c, t, low, more, at, body``: the border stretches with their bytes."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for t, z, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = press.decompress(z)
                columns = [pa.array([x[n] for x in spans], k) for n, k in (("h", pa.int64()), ("c", pa.int64()), ("low", pa.int64()), ("more", pa.int32()), ("at", pa.int32()))]
                bodies = pa.array([text[x["low"] : x["low"] + x["more"] + length] for x in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns[:2], pa.array([t] * len(spans), pa.binary()), *columns[2:], bodies], ["h", "c", "t", "low", "more", "at", "body"])

    wanted = borders.groupBy("t").agg(F.collect_list(F.struct("h", "c", "low", "more", "at")).alias("spans"))
    return texts.join(wanted, "t").mapInArrow(fetch, "h long, c long, t binary, low long, more int, at int, body binary")


def _block_ranks(stretches: DataFrame, width: int, length: int) -> DataFrame:
    """Blocks of ``width`` starts inside the asked spans of distances: ``common`` ranks what all windows of the whole
    block share, ``covered`` what the windows of the block's starts in this stretch cover together."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, c, at, body, spans in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                view = memoryview(body)
                for span in spans:
                    for block in range(span["near"] // width, span["far"] // width + 1):
                        near, far = max(span["near"], block * width), min(span["far"], (block + 1) * width - 1)
                        first = at - block * width
                        common = xxhash.xxh3_64_intdigest(view[first : first + length - width + 1])
                        covered = xxhash.xxh3_64_intdigest(view[at - far : at - near + length])
                        out.append((h, c, block, near, far, common, covered))
            columns = list(zip(*out, strict=True)) or [()] * 7
            arrays = [pa.array(np.array(x, np.uint64 if i > 4 else np.int64).view(np.int64), pa.int64()) for i, x in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "c", "block", "near", "far", "common", "covered"])

    return stretches.select("h", "c", "at", "body", "spans").mapInArrow(rank, "h long, c long, block long, near long, far long, common long, covered long")


def border_starts(stretches: DataFrame, length: int) -> DataFrame:
    """``t, low, more``: the repeated starts of border stretches, by narrowing blocks."""
    asked = stretches.select("h", "c", F.array(F.struct((F.col("at") - F.col("more")).cast("long").alias("near"), F.col("at").cast("long").alias("far"))).alias("spans"))
    found, place = None, stretches.select("h", "c", "t", (F.col("low") + F.col("at")).alias("m"))
    for width in [w for w in (16, 4, 1) if w == 1 or 2 * w <= length]:
        ranks = durable(_block_ranks(stretches.join(asked, ["h", "c"]), width, length))
        again = ranks.groupBy("h", "block", "common").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        open_blocks = durable(ranks.join(again, ["h", "block", "common"]))
        whole = open_blocks.groupBy("h", "near", "far", "covered").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        marked = open_blocks.join(whole.withColumn("all", F.lit(True)), ["h", "near", "far", "covered"], "left")
        marked = durable(marked.withColumn("all", F.col("all").isNotNull()))
        settled, between = marked.where("all"), marked.where("NOT all")
        found = settled.select("h", "c", "near", "far") if found is None else found.unionByName(settled.select("h", "c", "near", "far"))
        # One of each kind of settled blocks goes on as a witness for those in between.
        witness = settled.groupBy("h", "block", "common", "near", "far", "covered").agg(F.min("c").alias("c")).join(between.select("h", "block", "common").distinct(), ["h", "block", "common"], "left_semi")
        asked = between.select("h", "c", "near", "far").unionByName(witness.select("h", "c", "near", "far")).groupBy("h", "c").agg(F.collect_list(F.struct("near", "far")).alias("spans"))
    return found.join(place, ["h", "c"]).select("t", (F.col("m") - F.col("far")).alias("low"), (F.col("far") - F.col("near")).cast("int").alias("more"))


def repeated_starts(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """``t, low, more``: all starts low .. low + more of text t begin a string that occurs elsewhere too."""
    rows = durable(sampled(docs, text_col, length))  # read for the ranks and for the rows that share one
    # Stored, so that the join has a plain exchange on both sides: only then adaptive execution splits the short string of periodic texts.
    twice = durable(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("mixed")).where("n > 1").select("h", "mixed"))
    rows = durable(rows.join(twice, "h"))
    again = durable(rows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.any_value("mixed").alias("mixed"), F.min(F.struct("t", "low", "more", "at")).alias("one")))
    whole = rows.join(again.where("n > 1").select("h", "c"), ["h", "c"]).select("t", "low", "more").distinct()
    # Each different stretch of a mixed short string is ranked, also those known to be repeated: they bear witness.
    borders = durable(border_bytes(distinct_texts(docs, text_col), again.where("mixed").select("h", "c", "one.*"), length))
    return whole.unionByName(border_starts(borders, length))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, beside: DataFrame | None = None) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept, kept_sha256`` for every row of ``docs``, then the columns of ``beside``.

    ``kept`` is the rest as bytes (a cut may fall inside a character), ``n_spans`` the number of maximal
    removed runs. Strings are judged on the input. Null texts are empty: 0 bytes. Texts shorter than
    ``length`` stay. Repeated rows and equal texts are occurrences of each other, so texts of at least ``length`` bytes
    that occur twice are removed whole, in every copy. Other columns are ignored; an empty table gives no rows.
    ``beside``: columns by text digest ``t``, null where it has none.
    """
    if length < 4 or length > 65536:
        raise ValueError("length must be 4 to 65536 bytes")
    kind = docs.schema[id_col].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer() for x in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x) for x in texts], pa.binary()), pa.array([len(memoryview(x)) for x in texts], pa.int64())], ["id", "t", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for t, z, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, kept, at, removed, runs = press.decompress(z), [], 0, 0, 0
                for a, b in merged(spans or [], length):
                    kept.append(text[at:a])
                    at, removed, runs = b, removed + b - a, runs + 1
                rest = b"".join([*kept, text[at:]])
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.binary()), pa.array([removed]), pa.array([runs]), pa.array([rest], pa.binary()), pa.array([hashlib.sha256(rest).hexdigest()])], ["t", "n_removed", "n_spans", "kept", "kept_sha256"])

    found = repeated_starts(docs, text_col, length).groupBy("t").agg(F.collect_list(F.struct("low", "more")).alias("spans"))
    cuts = distinct_texts(docs, text_col).join(found, "t", "left").mapInArrow(cut, "t binary, n_removed long, n_spans long, kept binary, kept_sha256 string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(name, f"id {kind}, t binary, n long")
    more = [] if beside is None else [x for x in beside.columns if x != "t"]
    rows = rows if beside is None else rows.join(beside, "t", "left")
    return rows.join(cuts, "t").select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept", "kept_sha256", *more)


def merged(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Covered byte ranges, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["low"], s["low"] + s["more"] + length) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
