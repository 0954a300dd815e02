"""Groups of near-duplicate documents by SuperMinHash, banding, verification and union-find (operator 2).

A document is its set of distinct word shingles. Each shingle visits the signature's slots in an order of its
own and offers rank + fraction to every slot it visits; a slot keeps the least offer. As the ranks of one
shingle are a permutation, slots are less alike by chance than with independent hashes, and a document stops
once no later rank can lower any slot, which for most documents is after a few ranks. Equal bands of slots
make candidates; links are confirmed on the full sets; groups are connected components.

No bucket is compared in all pairs. Equal sets are one node from the start. Each bucket first compares its
members with a single hub, the member that sits in the most crowded buckets (in a group of edited copies
that is the text they were made from). What is then left are buckets whose members lie in different
components. Those members meet by prefix filtering: with shingles ordered from rare to frequent, two sets that
reach the threshold share one of the first few (|x| - shared + 1) shingles of both, so copies that went too far
apart, whose first shingles are all their own, meet nobody. A shingle's bucket is again compared with 32, 64,
128, ... hubs until all its pairs are compared or connected, so no link is lost and crowded buckets cost
rows x hubs.

Scale: signatures, nodes and links are narrow tables; texts are shuffled once, to bring candidates' sets
together. With 25 bands of 5 slots a pair at the threshold 0.85 is missed with a chance of 4e-7, one at 0.8
with 5e-5. Every round is stored in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm import text_arrays as T
from panelwright.session import durable

SHINGLE = 5
SLOTS, BANDS, ROWS = 128, 25, 5
THRESHOLD = (80, 100)  # shared * 100 >= union * 80
HUBS = 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles (A-Z lower-cased, words end at ASCII blanks)."""
    starts, ends, rows = T.words(~T.BLANK[data], offsets)
    first, found = T.windows(T.span_hashes(T.FOLD[data], starts, ends), rows, width)
    edges = np.searchsorted(rows[first], np.arange(len(offsets))) if len(first) else np.zeros(len(offsets), np.int64)
    return [np.unique(found[edges[i] : edges[i + 1]]) for i in range(len(offsets) - 1)]


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures as (rank << 32 | fraction); ``slots`` must be a power of two. An empty set keeps the largest value."""
    sizes = np.array([len(s) for s in sets])
    shingles = np.concatenate(sets) if sizes.sum() else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    low = np.uint64(slots - 1)
    step, at = T.mix(shingles ^ np.uint64(0xA5A5A5A5)) | np.uint64(1), T.mix(shingles ^ np.uint64(0x5A5A5A5A))
    least = np.full(len(sets) * slots, np.iinfo(np.uint64).max)
    for rank in range(slots):
        if not len(shingles):
            break
        offer = T.mix(shingles + np.uint64(rank * 2654435761)) >> np.uint64(32) | np.uint64(rank << 32)
        slot = ((step * np.uint64(rank) + at) & low).astype(np.int64)
        np.minimum.at(least, rows * slots + slot, offer)
        going = (least.reshape(-1, slots).max(1) >> np.uint64(32)) > rank
        stay = going[rows]
        shingles, rows, step, at = shingles[stay], rows[stay], step[stay], at[stay]
    return least.reshape(-1, slots)


def _bands(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures[:, : bands * rows].reshape(-1, bands, rows)
    total = np.zeros(parts.shape[:2], np.uint64)
    for j in range(rows):
        total += T.mix(parts[:, :, j]) * T._LOW[2 * j + 1]
    return T.mix(total + np.arange(1, bands + 1, dtype=np.uint64) * T._LOW[99])


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE, slots: int = SLOTS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, n, k, d, bands``: shingles, digest of the set (null without words), of the text, and band keys of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in T.runs(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                keys = _bands(superminhash(sets, slots), bands, rows)
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), batch.column(2).slice(first, end - first), lists], ["id", "n", "k", "d", "bands"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), _text_digest(F.col(f"`{text_col}`")).alias("d"))
    return texts.mapInArrow(sign, f"id {kind}, n long, k binary, d binary, bands array<long>")


def _text_digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _fetched(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``k, text``: the document that stands for each wanted set, found by id and text. Rows that share an id, or have
    none, don't meet each other's sets."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), _text_digest(F.col(f"`{text_col}`")).alias("d"))
    own = wanted.select("k", F.col("one.id").alias("wanted_id"), F.col("one.d").alias("wanted_d"))
    return texts.join(own, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("d") == F.col("wanted_d"))).select("k", "text")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``k, shingles`` of the wanted sets, from one document each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, end, data, offsets in T.runs(batch.column(1)):
                sets = [(k, s) for k, s in zip(keys[first:end], shingle_sets(data, offsets, width), strict=True) if len(s) and _digest(s) == k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.binary()), pa.array([s.tobytes() for _, s in sets], pa.binary())], ["k", "shingles"])

    joined = _fetched(docs, wanted, id_col, text_col)
    return joined.mapInArrow(cut, "k binary, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the threshold."""
    share, whole = threshold

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if len(small) * whole < share * len(large):
                    near.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                near.append(whole * both >= share * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("k").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("k").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(confirm, "a binary, b binary")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one partition: each node points to the least of its tree."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            a, b = root(bytes(a)), root(bytes(b))
            if a != b:
                up[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in list(up)]
    yield pd.DataFrame([(x, r) for x, r in pairs if x != r], columns=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``k, root``: the least node of its component for every linked node but the roots themselves.

    Union-find inside partitions, then large-star and small-star steps between them until every node has one
    root that is no other node's child; a step only shuffles (node, node) pairs.
    """
    edges = durable(links.mapInPandas(_forest, "a binary, b binary"))
    while True:
        roles = edges.unionByName(edges.select(F.col("b").alias("a"), "b"))
        if roles.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high").isEmpty():
            return edges.distinct().select(F.col("a").alias("k"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        moved = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = durable(moved)


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` after more links: only the roots that these connect are worked on again."""
    if roots is None:
        return durable(components(links))
    named = lambda c: roots.select(F.col("k").alias(c), F.col("root").alias(f"{c}_root"))
    lifted = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    above = durable(components(lifted.where("a <> b").distinct()))
    moved = roots.join(above.select(F.col("k").alias("root"), F.col("root").alias("upper")), "root", "left").select("k", F.coalesce("upper", "root").alias("root"))
    return durable(moved.unionByName(above))


def _prefixes(keys: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``band, k, n, place``: the shingles among which each set must share one with any set it is linked to.

    Shingles are ordered by the number of these sets that hold them, rarest first; ``place`` counts from 1.
    """
    share, whole = threshold

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, shingles in zip(batch.column(0), batch.column(1), strict=True):
                values = np.frombuffer(shingles.as_buffer(), np.int64)
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, pa.binary()), pa.array(np.full(n, n)), pa.array(values)], ["k", "n", "band"])

    rows = durable(sets.join(keys, "k").select("k", "shingles").mapInArrow(spread, "k binary, n long, band long"))
    held = rows.groupBy("band").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("k").orderBy("held", "band")
    placed = rows.join(held, "band").withColumn("place", F.row_number().over(order))
    return placed.where(f"place <= n - (n * {share} + {whole - 1}) div {whole} + 1 AND held > 1").select("band", "k", "n", "place")


def _candidates(members: DataFrame, hubs: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs between the first ``hubs`` members of each bucket and its members in other components.

    Where sizes are known, only pairs whose prefixes for these two sizes both contain the bucket's shingle.
    """
    share, whole = threshold
    order = Window.partitionBy("band").orderBy(F.desc("score"), "k")
    top = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= hubs)
    top = top.select("band", F.col("k").alias("hub"), F.col("root").alias("hub_root"), F.col("n").alias("hub_n"), F.col("place").alias("hub_place"))
    shared = f"(({share} * (n + hub_n) + {whole + share - 1}) div {whole + share})"
    reach = F.expr(f"place <= n - {shared} + 1 AND hub_place <= hub_n - {shared} + 1")
    met = members.join(top, "band").where(F.col("k") != F.col("hub")).where("root <> hub_root").where(F.coalesce(reach, F.lit(True)))
    return met.select(F.least("k", "hub").alias("a"), F.greatest("k", "hub").alias("b")).distinct()


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links. Null, empty and blank texts have no shingles, link
    with nothing and stay. A text of fewer than ``width`` words is one shingle. Repeated rows are linked as equal texts. A null id takes its component's
    smallest id (null if there is none, then it stays). Other columns are ignored. An empty table gives no rows.
    """
    rows = durable(signatures(docs, id_col, text_col, width))
    nodes = durable(rows.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("id"), F.min(F.struct("id", "d")).alias("one"), F.any_value("bands").alias("bands")))
    keys = nodes.select("k", F.explode("bands").alias("band"))
    crowd = keys.groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    members = keys.join(crowd, "band")
    members = durable(members.join(members.groupBy("k").agg(F.sum("crowd").alias("score")), "k").select("band", "k", "score"))
    sets = durable(_sets(docs, nodes.join(members.select("k").distinct(), "k").select("k", "one"), id_col, text_col, width))
    open_members = members.select("*", F.col("k").alias("root"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("place"))
    scores = members.select("k", "score").distinct()
    roots, tested, hubs = None, None, 1
    while True:
        pairs = _candidates(open_members, hubs, threshold)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = durable(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if roots is None or not pairs.isEmpty():
            roots = _joined(roots, durable(verified(pairs, sets, threshold)))
        # A hub has met its whole bucket and leaves it; a bucket whose rest is one component is done.
        order = Window.partitionBy("band").orderBy(F.desc("score"), "k")
        met = open_members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= hubs).select("band", "k")
        left = _rooted(open_members.drop("root").join(met, ["band", "k"], "left_anti"), roots)
        mixed = left.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
        open_members = durable(left.join(mixed, "band"))
        if hubs == 1:
            prefixes = _prefixes(open_members.select("k").distinct(), sets, threshold)
            open_members = durable(_rooted(prefixes.join(scores, "k"), roots))
        if open_members.isEmpty():
            break
        hubs = max(HUBS, 2 * hubs)
    named = nodes.join(roots, "k", "left").select("k", "id", F.coalesce("root", "k").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").select("k", "component_id")
    out = rows.join(named, "k", "left").withColumn("component_id", F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
