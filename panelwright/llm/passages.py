"""Runs of words that occur more than once, beside the byte rule of operator 9.

A passage of over 50 words can be shorter than 400 bytes, so the byte rule leaves it. Here a window is ``words`` words
(`[^\\x20\\x09-\\x0D]+`, compared as they are; blanks between them don't count) and a word is repeated if it lies in a window
that also starts anywhere else, same document included. Windows are represented and grouped as in ``repeats``, with
64-bit hashes of words in place of bytes:

1. representatives whose short run occurs once are dropped; a filter of fixed size holds the others, which a second scan
   picks out (where the filter fills up, more rows go on, none is lost);
2. equal stretches make all their starts repeated;
3. where one short run stands in different stretches, one of each is split into its windows, and those found in two
   different stretches are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import repeats
from panelwright.llm import text_arrays as T
from panelwright.session import durable, release, stored_folder, stored_mark

WORDS = 51
SLABS, SLAB_BITS = 256, 18


def _word_runs(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Text digests, word hashes and the first word of each text, by runs of texts."""
    for _, _, data, offsets in T.runs(texts, repeats.SEGMENT):
        view = memoryview(data)
        digests = [repeats.digest(view[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]
        starts, ends, _ = T.words(~T.BLANK[data], offsets)
        yield digests, T.span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def _place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slab of the filter and the two bits in it."""
    mask = np.uint64((1 << SLAB_BITS) - 1)
    return (keys & np.uint64(SLABS - 1)).astype(np.int64), ((keys >> np.uint64(8)) & mask).astype(np.int64), ((keys >> np.uint64(34)) & mask).astype(np.int64)


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the longs in the only column, which are taken as hashes; 8 MB however many there are."""
    name = keys.columns[0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slabs: dict[int, np.ndarray] = {}
        for batch in batches:
            slab, one, two = _place(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for k in np.unique(slab).tolist():
                bits, held = slabs.setdefault(k, np.zeros(1 << SLAB_BITS, bool)), slab == k
                bits[one[held]] = bits[two[held]] = True
        for k, bits in slabs.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slab", "bits"])

    out = np.zeros((SLABS, (1 << SLAB_BITS) // 8), np.uint8)
    for r in keys.select(name).repartition(F.pmod(name, F.lit(SLABS))).mapInArrow(fill, "slab int, bits binary").toLocalIterator():
        out[r["slab"]] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slab, one, two = _place(keys)
    return ((bits[slab, one >> 3] >> (one & 7)) & (bits[slab, two >> 3] >> (two & 7)) & 1).astype(bool)


def _text_keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in digests), ">u8").astype(np.uint64)


def _short_runs(texts: DataFrame, words: int) -> DataFrame:
    """``h``: hash of the short run of every representative."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, firsts in _word_runs(batch.column(0)):
                for _, h, *_ in repeats.stretches(values, firsts, words):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return texts.mapInArrow(sample, "h long")


def _met(digests: list[bytes], values: np.ndarray, firsts: np.ndarray, words: int, met: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, short run, whole stretch, first and last start of the stretches whose short run may be in ``met``, and their own keys."""
    view, texts = memoryview(values).cast("B"), _text_keys(digests)
    for rows, h, _, low, high in repeats.stretches(values, firsts, words):
        held = _may_hold(met, h)
        rows, h, low, high = rows[held], h[held], low[held], high[held]
        c = np.array([xxhash.xxh3_64_intdigest(view[8 * a : 8 * (b + words)]) for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.uint64)
        yield rows, h, c, low, high, T.mix(c ^ T.mix(texts[rows] + (low - firsts[rows]).astype(np.uint64)))


def _met_stretches(texts: DataFrame, words: int, met: np.ndarray) -> DataFrame:
    """``h, c, t, low, more, key``: short run, whole stretch, text digest, first start, number of further starts, hash of c, t and low."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digests, values, firsts in _word_runs(batch.column(0)):
                for rows, h, c, low, high, key in _met(digests, values, firsts, words, met):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array([digests[r] for r in rows.tolist()], pa.binary()), pa.array(low - firsts[rows]), pa.array((high - low).astype(np.int32)), pa.array(key.view(np.int64))], ["h", "c", "t", "low", "more", "key"]
                    )

    return texts.mapInArrow(sample, "h long, c long, t binary, low long, more int, key long")


def _border_windows(texts: DataFrame, words: int, met: np.ndarray, borders: np.ndarray) -> DataFrame:
    """``w, c, off``: hash of each window of the stretches that may be in ``borders``, stretch and distance from its first start.

    ``borders`` holds their keys and those of their texts, so that other texts are not split into words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [_may_hold(borders, _text_keys([repeats.digest(x.as_buffer()) for x in batch.column(0).cast(pa.large_binary())]))] if len(batch) else []
            for digests, values, firsts in _word_runs(batch.column(0).filter(pa.array(chosen[0]))) if chosen else ():
                power, inverse = T.powers(len(values) + 1)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(values)], dtype=np.uint64)])
                for _, _, c, low, high, key in _met(digests, values, firsts, words, met):
                    held = _may_hold(borders, key)
                    size = (high - low + 1)[held]
                    off = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    at = np.repeat(low[held], size) + off
                    w = T.mix((sums[at + words] - sums[at]) * inverse[at])
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.repeat(c[held], size).view(np.int64)), pa.array(off.astype(np.int32))], ["w", "c", "off"])

    return texts.mapInArrow(cut, "w long, c long, off int")


def repeated_words(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``t, n_repeated_words``: digest of every text with repeated words (once per distinct text) and their number."""
    if words < 4 or words > 65536:
        raise ValueError("words must be 4 to 65536")
    spark, texts = docs.sparkSession, repeats.text_rows(docs, text_col)
    path, mark = stored_folder(spark), stored_mark()
    met = key_filter(_short_runs(texts, words).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    # Copies of a text fall together before they are grouped by what they hold.
    rows = durable(_met_stretches(texts, words, met).groupBy("h", "c", "t", "low", "more", "key").agg(F.count(F.lit(1)).alias("n")))
    again = durable(rows.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("t", "low", "more", "key")).alias("one")))
    whole = rows.join(again.where("n > 1").select("h", "c"), ["h", "c"]).select("t", "low", "more")
    # Each different stretch of such a short run is split, also those known to be repeated: they bear witness.
    mixed = durable(again.join(again.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h"), "h").select("c", "n", "one.*"))
    text_key = F.conv(F.hex(F.substring("t", 1, 8)), 16, -10).cast("long")
    borders = key_filter(mixed.select(F.explode(F.array("key", text_key)).alias("key")))
    windows = durable(_border_windows(texts, words, met, borders))
    twice = windows.groupBy("w").agg((F.min("c") != F.max("c")).alias("twice")).where("twice").select("w")
    found = windows.join(twice, "w").select("c", "off").distinct().join(mixed.where("n = 1").select("c", "t", "low"), "c")
    starts = whole.unionByName(found.select("t", (F.col("low") + F.col("off")).alias("low"), F.lit(0).alias("more")))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [sum(b - a for a, b in repeats.merged(x, words)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], ["t", "n_repeated_words"])

    counts = starts.groupBy("t").agg(F.collect_list(F.struct("low", "more")).alias("spans")).mapInArrow(total, "t binary, n_repeated_words long")
    counts.write.parquet(path)
    release(spark, mark)  # what is stored on the way is not read again
    return spark.read.schema(counts.schema).parquet(path)
