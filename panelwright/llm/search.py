"""Ranked lexical search over an inverted index of document shards (operator 13).

``build_index`` turns every run of texts into one shard, a row: its documents with their lengths, its terms, and
their postings in blocks of 128, packed in one to four bytes a number. A block states its first and last document,
its highest term frequency and its shortest document, from which the highest score within it follows for any corpus
statistics, so an index doesn't age when documents are added.

``search`` runs Block-Max MaxScore in each shard. Lists are ordered by the highest score they can give. From the
top, whole lists are read until what all the others can add together falls below the least score of the best ``k``
so far: these lists are the essential ones, and no document outside them can enter. Candidates from them are then
held against the block maxima of the other lists; those that can't reach that score are rejected before any of
these blocks is unpacked. Each task merges the heaps of its shards, Spark those of the tasks.

Scale: one pass over the texts, shards of bounded size, no exchange of postings. Queries are dealt into blocks of
bounded size, and each block goes to all shards; only ``k`` rows per query and task come back.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import text_arrays as T
from panelwright.session import durable, unite

K = 20
BLOCK = 128
SHARD_BYTES = 8_000_000
SHARDS_PER_FILE = 4  # what a task holds of the index at once when it writes or reads one, about 30 MB
QUERY_TERMS = 200_000  # terms of one block of queries, about
KEPT_POSTINGS = 2_000_000  # unpacked postings a task remembers within one shard
BITS = 1_000_000_000
# Fixed value: everything but these ASCII characters belongs to a term.
APART = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
BLOCKS = ("first", "last", "most", "shortest", "place", "wide", "high")


def _widths(most: np.ndarray) -> np.ndarray:
    return np.select([most < 1 << 8, most < 1 << 16], [1, 2], 4)


def _write(out: np.ndarray, at: np.ndarray, width: np.ndarray, values: np.ndarray) -> None:
    for k in range(4):
        used = np.flatnonzero(width > k)
        out[at[used] + k] = (values[used] >> (8 * k)) & 255


def shard(data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
    """Index of one run of texts; documents are numbered by row."""
    data = T.FOLD[data]
    inside = INSIDE[data]
    starts, ends, row = T.words(inside, offsets)
    kinds, terms = T.coded(data, inside, ends - starts)
    docs = len(offsets) - 1
    lengths = np.bincount(row, minlength=docs)
    pairs, often = np.unique(kinds.astype(np.int64) * docs + row, return_counts=True)
    term, doc = np.divmod(pairs, docs)
    df = np.bincount(term, minlength=len(terms))
    seat = np.arange(len(pairs)) - np.repeat(np.cumsum(df) - df, df)
    begin = np.flatnonzero(seat % BLOCK == 0)
    sizes = np.diff(np.append(begin, len(pairs)))
    block = np.repeat(np.arange(len(begin)), sizes)
    first, last = doc[begin], doc[begin + sizes - 1]
    most = np.maximum.reduceat(often, begin) if len(begin) else begin
    shortest = np.minimum.reduceat(lengths[doc], begin) if len(begin) else begin
    wide, high = _widths(last - first), _widths(most)
    place = np.cumsum(sizes * (wide + high)) - sizes * (wide + high)
    packed = np.zeros(int((sizes * (wide + high)).sum()), np.uint8)
    inner = seat % BLOCK
    _write(packed, place[block] + inner * wide[block], wide[block], doc - first[block])
    _write(packed, (place + sizes * wide)[block] + inner * high[block], high[block], often)
    blocks = np.stack([first, last, most, shortest, place, wide, high]).astype("<i8") if len(begin) else np.zeros((7, 0), "<i8")
    return {"lengths": lengths, "terms": terms, "df": df, "blocks": blocks.astype("<u4").tobytes(), "postings": packed.tobytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: ``ids``, ``lengths`` (terms per document), ``terms``, ``df``, ``blocks``, ``postings``.

    Terms are the longest runs of characters other than ASCII ones that are neither letter nor digit, A-Z lower-cased, over whole texts. Null
    texts have none. Repeated rows are documents of their own. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"ids array<{id_type}>, lengths array<bigint>, terms array<string>, df array<bigint>, blocks binary, postings binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(values: pa.Array | np.ndarray) -> pa.Array:
            values = values if isinstance(values, pa.Array) else pa.array(values, pa.int64())
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        for batch in batches:
            for first, end, data, offsets in T.runs(batch.column(0), shard_bytes):
                made = shard(data, offsets)
                lists = [one(batch.column(1).slice(first, end - first)), one(made["lengths"]), one(made["terms"].cast(pa.string())), one(made["df"])]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([made["blocks"]], pa.binary()), pa.array([made["postings"]], pa.binary())], ["ids", "lengths", "terms", "df", "blocks", "postings"])

    return rows.mapInArrow(run, schema)


def store_index(index: DataFrame) -> DataFrame:
    """The index as a stored frame in small files, so that memory follows a few shards, not a task's share of the input."""
    return durable(index, SHARDS_PER_FILE)


class Shard:
    """One shard, ready to be searched under the statistics of the whole corpus: N documents, L terms."""

    def __init__(self, lengths: np.ndarray, df: np.ndarray, blocks: bytes, postings: bytes, n_docs: int, n_terms: int) -> None:
        self.norm = 12 * (75 + 25 * lengths.astype(np.int64) * n_docs // n_terms)
        table = np.frombuffer(blocks, "<u4").reshape(len(BLOCKS), -1).astype(np.int64)
        self.first, self.last, most, shortest, self.place, self.wide, self.high = table
        self.most = BITS * most // (1000 * most + 12 * (75 + 25 * shortest * n_docs // n_terms))
        per_term = -(-df // BLOCK)
        self.end = np.cumsum(per_term)
        self.begin = self.end - per_term
        self.sizes = np.full(len(self.first), BLOCK, np.int64)
        self.sizes[self.end[df > 0] - 1] = (df - BLOCK * (per_term - 1))[df > 0]
        self.raw = np.frombuffer(postings, np.uint8)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.kept = 0

    def unpack(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what one occurrence-weighted term gives each (its weight aside)."""
        n, wide, high, at = (int(x[block]) for x in (self.sizes, self.wide, self.high, self.place))
        docs = self.raw[at : at + n * wide].view(f"<u{wide}") + self.first[block]
        tf = self.raw[at + n * wide : at + n * (wide + high)].view(f"<u{high}").astype(np.int64)
        return docs, BITS * tf // (1000 * tf + self.norm[docs])

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.known:
            parts = [self.unpack(b) for b in range(self.begin[term], self.end[term])]
            found = parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))
            if self.kept + len(found[0]) > KEPT_POSTINGS:
                return found
            self.kept += len(found[0])
            self.known[term] = found
        return self.known[term]

    def best(self, query: list[tuple[int, int]], k: int, least: int, order: np.ndarray) -> list[tuple[int, int]]:
        """``(score, document)`` of the ``k`` highest scores from ``least`` (1 or more) on; ties go by ``order``.

        ``query``: (term, weight times repeats).
        """
        lists = sorted(((int(self.most[self.begin[t] : self.end[t]].max()) * w, t, w) for t, w in query if w), reverse=True)
        rest = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0).astype(np.int64)
        scores = np.zeros(len(self.norm), np.int64)
        essential = 0
        while essential < len(lists) and rest[essential] >= least:
            _, term, weight = lists[essential]
            docs, gives = self.whole(term)
            scores[docs] += weight * gives
            essential += 1
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[-k]))
        found = np.flatnonzero(scores)
        found = found[scores[found] + rest[essential] >= least]
        if essential < len(lists) and len(found):
            found = self._others(lists[essential:], found, scores, k, least)
        found = found[scores[found] >= least]
        top = found[np.lexsort((order[found], -scores[found]))[:k]]
        return [(int(scores[d]), int(d)) for d in top]

    def _others(self, lists: list[tuple[int, int, int]], found: np.ndarray, scores: np.ndarray, k: int, least: int) -> np.ndarray:
        """Candidates that stay after the non-essential lists; their scores are complete then."""
        blocks, tops = [], []
        for _, term, weight in lists:
            begin, end = self.begin[term], self.end[term]
            at = begin + np.searchsorted(self.last[begin:end], found)
            inside = at < end
            at = np.where(inside, at, begin)
            inside &= self.first[at] <= found
            blocks.append(at)
            tops.append(np.where(inside, self.most[at] * weight, 0))
        blocks, tops = np.stack(blocks), np.stack(tops)
        left = np.cumsum(tops[::-1], 0)[::-1]  # what a list and those after it can still give
        for j, (_, _, weight) in enumerate(lists):
            stay = scores[found] + left[j] >= least
            if not stay.all():
                found, blocks, tops, left = found[stay], blocks[:, stay], tops[:, stay], left[:, stay]
            if not len(found):
                break
            may = np.flatnonzero(tops[j])
            for block in np.unique(blocks[j][may]):
                docs, gives = self.unpack(block)
                mine = found[may[blocks[j][may] == block]]
                at = np.minimum(np.searchsorted(docs, mine), len(docs) - 1)
                hit = docs[at] == mine
                scores[mine[hit]] += weight * gives[at[hit]]
            if len(found) >= k:
                least = max(least, int(np.partition(scores[found], len(found) - k)[-k]))
        return found


def _search(index: DataFrame, queries: list[tuple[int, list[tuple[str, int]]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``q, doc_id, score``: the merged heaps of each task's shards."""
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    words = pa.array(sorted({t for _, terms in queries for t, _ in terms}), pa.string())
    number = {t: i for i, t in enumerate(words.to_pylist())}
    coded = [(q, [(number[t], w) for t, w in terms]) for q, terms in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths, terms, df = (batch.column(c)[i].values for c in range(4))
                part = Shard(lengths.to_numpy(), df.to_numpy(), batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), n_docs, n_terms)
                place = pc.index_in(words, value_set=terms).fill_null(-1).to_numpy().tolist()
                order = np.empty(len(ids), np.int64)
                order[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
                for q, query in coded:
                    here = [(place[t], w) for t, w in query if place[t] >= 0]
                    heap = heaps[q]
                    found = part.best(here, k, max(heap[-1][0] if len(heap) == k else 1, 1), order) if here else []
                    if found:
                        new = [(score, ids[d].as_py()) for score, d in found]
                        heaps[q] = heapq.nsmallest(k, heap + new, key=lambda x: (-x[0], x[1] is None, x[1]))
        rows = [(q, d, s) for q, heap in heaps.items() for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], batch_type), pa.array([r[2] for r in rows], pa.int64())], ["q", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(index.schema["ids"].dataType.elementType)
    return index.mapInArrow(run, f"q bigint, doc_id {id_type}, score bigint")


def search(index: DataFrame, items: DataFrame, k: int = K, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0 (all, if fewer).

    ``index`` should be stored (``store_index``): it is read for the statistics and for each block of queries. Equal rows of ``items``
    are one query; rows that share an id but not a text are ranked apart. Items without terms, null texts too, find
    nothing; neither does an empty index. Equal scores go by ascending document id, nulls last. A term's weight is
    ``floor(1000 ln((2 N + 2) / (2 df + 1)))``, a score the sum of ``weight * (1e9 tf div (1000 tf + 12 m))`` with
    ``m = 75 + 25 n N div L``. Other columns are not read.
    """
    size = index.agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0))), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    n_docs, n_terms = size[0] or 0, size[1] or 0
    item = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).distinct()
    item = durable(item.withColumn("q", F.monotonically_increasing_id()))
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = durable(item.select("q", F.explode(F.regexp_extract_all(folded, F.lit(APART), 0)).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("repeats")))
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), "x.df")
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    weighed = durable(asked.join(df, "term").select("q", "term", (weight * F.col("repeats")).alias("weight")))
    blocks = max(1, math.ceil(weighed.count() / QUERY_TERMS))
    found = []
    for b in range(blocks):
        rows = weighed.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).groupBy("q").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).collect()
        found.append(_search(index, [(r["q"], [(t["term"], t["weight"]) for t in r["terms"]]) for r in rows], n_docs, max(n_terms, 1), k))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = unite(*found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(item.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
