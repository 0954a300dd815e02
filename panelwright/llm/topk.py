"""Exact top-k inner products over norm-sorted vectors (operator 6).

Vectors are rounded to integers, so scores are exact. Equal vectors form a class and are scored once; of a
class only its k + 1 smallest ids can be among anyone's k best (ties go to the smaller id, and a query is
left out of its own list), so classes lose nothing. Classes are cut into blocks by descending length. Vectors
are rotated by the eigenvectors of their second-moment matrix, which packs most of a product into the first
coordinates: partial sum + (length of the query's rest) * (length of the vector's rest) is an upper bound by
Cauchy-Schwarz. A pair is scored in full only if its bound reaches the query's k-th best lower bound, which
is known from the longest vectors; a block of vectors too short for any query of a query block is never
shipped to it.

Scale: work is a grid of (query block, vector block) groups, each a matrix product in one task; blocks have a
fixed number of rows and travel as packed binary. Each grid group returns at most k + 1 rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.session import durable

BLOCK = 8192
HEAD = 0.25
SAFE = 2.0**53


def quantized(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component as long; null if the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _rotation(classes: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal axes by falling energy: eigenvectors of the sum of x x' (one dims x dims matrix per task)."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = np.array(batch["v"].tolist(), dtype=float).reshape(-1, dims)
            total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(dims), dims), "j": np.tile(np.arange(dims), dims), "s": total.ravel()})

    sums = np.zeros((dims, dims))
    for r in classes.select("v").mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        sums[r["i"], r["j"]] = r["s"]
    return np.linalg.eigh(sums)[1][:, ::-1]


def _packer(keys: list[str], floors: bool):
    """A function that packs the rows of a block into one row: class keys, vectors and lower bounds as binary."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = {x: [group[x].iloc[0]] for x in keys}
        out |= {"keys": [group["c"].to_numpy("<i8").tobytes()], "vectors": [np.array(group["v"].tolist(), dtype="<i8").tobytes()]}
        if floors:
            out = {"q": out["q"], "q_keys": out["keys"], "q_vectors": out["vectors"], "q_floor": [group["floor"].to_numpy("<f8").tobytes()]}
        return pd.DataFrame(out)

    return pack


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "v", block: int = BLOCK, head: float = HEAD) -> DataFrame:
    """``query_id, rank, id_col, score``: the k highest integer inner products of every query.

    ``vectors`` holds candidates (id, array<long>), ``queries`` the ids of the candidates that ask; a query is
    never its own candidate. Ties go to the smaller id; fewer than k candidates give fewer rows. Null vectors
    and null ids take no part, nor do queries without a vector. Vectors of different length don't meet. A
    repeated id with the same vector counts once; with different vectors, its smallest vector counts. Scores beyond 64 bits are
    refused. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    asks = queries.select(F.col(f"`{queries.columns[0]}`").cast("long").alias("id")).where("id IS NOT NULL").distinct().withColumn("asks", F.lit(True))
    rows = durable(rows.join(asks, "id", "left"))
    # The k + 1 smallest ids of a class: a limit per class that Spark also applies before the shuffle.
    first = Window.partitionBy("v").orderBy("id")
    members = rows.select("id", "v").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    keys = members.groupBy("v").agg(F.min("id").alias("c"), F.collect_list("id").alias("ids"))
    classes = rows.groupBy("v").agg(F.max("asks").alias("asks"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    classes = durable(classes.join(keys, "v").select("c", "v", "asks", F.size("ids").alias("n"), "ids", length.alias("length"), F.size("v").alias("dims")))
    parts = []
    for (dims,) in classes.select("dims").distinct().collect():  # one entry per vector length in the table
        parts.append(_same_length(classes.where(F.col("dims") == dims), dims, k, block, head))
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    best = parts[0]
    for other in parts[1:]:
        best = best.unionByName(other)
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "v").join(classes.select("v", "c"), "v").select("query_id", "c")
    lists = best.join(asking, "c").where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), F.col("score").cast("long").alias("score"))


def _same_length(classes: DataFrame, dims: int, k: int, block: int, head: float) -> DataFrame:
    """``c, id, score``: per asking class the k + 1 best members of all classes."""
    n, longest = classes.agg(F.count(F.lit(1)), F.max("length")).first()
    if (longest or 0.0) ** 2 >= 2.0**63:
        raise ValueError("an inner product could exceed 64 bits")
    axes, cut = _rotation(classes, dims), max(1, int(dims * head))
    # Bands of lengths within 2 %, longest first: at most some thousands, as lengths are below 2 ** 32. A band
    # larger than a block is dealt over several blocks by key.
    banded = classes.withColumn("band", F.floor(-50 * F.log(F.greatest("length", F.lit(1.0)))).cast("long"))
    bands = banded.groupBy("band").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("rows")).orderBy("band").collect()
    shares = {r["band"]: -(-r["rows"] // block) for r in bands}
    share_of = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    blocked = durable(banded.withColumn("share", F.pmod(F.xxhash64("c"), share_of[F.col("band")])))

    def floors(query: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        if not len(query) or not len(pool):
            return pd.DataFrame({"c": pd.Series(dtype="int64"), "floor": pd.Series(dtype="float64")})
        x, times = np.array(pool["v"].tolist(), dtype=float), pool["n"].to_numpy()
        found = []
        for at in range(0, len(query), 1024):
            scores = np.array(query["v"].iloc[at : at + 1024].tolist(), dtype=float) @ x.T
            order = np.argsort(-scores, axis=1, kind="stable")[:, : 4 * (k + 1)]
            seen = np.cumsum(times[order], axis=1)
            enough = seen[:, -1] >= k + 1
            place = (seen >= k + 1).argmax(axis=1)
            found.append(np.where(enough, np.take_along_axis(scores, np.take_along_axis(order, place[:, None], 1), 1)[:, 0], -np.inf))
        return pd.DataFrame({"c": query["c"], "floor": np.concatenate(found)})

    n_asking = blocked.where("asks").count()
    if not n_asking:
        return blocked.where(F.lit(False)).select("c", F.col("c").alias("id"), F.col("c").alias("score"))
    q_count = -(-n_asking // (block // 2))
    asking = blocked.where("asks").select("c", "v", "length", F.pmod(F.xxhash64("c"), F.lit(q_count)).alias("q"))
    # Lower bounds for the (k + 1)-th best scores come from the longest vectors, some hundred to two blocks of them.
    reach, last = 0, None
    for r in bands:
        reach, last = reach + r["rows"], r["band"]
        if reach >= block // 4:
            break
    pool = blocked.where((F.col("band") < last) | ((F.col("band") == last) & (F.col("share") == 0))).select("c", "v", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_count - 1).cast("long"))).alias("q"))
    bounds = asking.groupBy("q").cogroup(pool.groupBy("q")).applyInPandas(floors, "c long, floor double")
    asking = durable(asking.join(bounds, "c"))
    reach_of = asking.groupBy("q").agg(F.max("length").alias("q_length"), F.min("floor").alias("least"))
    all_bands = F.array(*[F.struct(F.lit(r["band"]).alias("band"), F.lit(float(r["longest"])).alias("longest"), F.lit(shares[r["band"]]).alias("shares")) for r in bands])
    grid = reach_of.select("q", "q_length", "least", F.explode(all_bands).alias("b")).where(F.col("q_length") * F.col("b.longest") * (1 + 1e-9) >= F.col("least"))
    grid = grid.select("q", "b.band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.shares").cast("long") - 1)).alias("share"))
    q_blocks = asking.groupBy("q").applyInPandas(_packer(["q"], True), "q long, q_keys binary, q_vectors binary, q_floor binary")
    v_blocks = blocked.select("band", "share", "c", "v").groupBy("band", "share").applyInPandas(_packer(["band", "share"], False), "band long, share long, keys binary, vectors binary")
    grid = grid.join(q_blocks, "q").join(v_blocks, ["band", "share"])

    def score(pair: pd.DataFrame) -> pd.DataFrame:
        r = pair.iloc[0]
        ints = lambda x: np.frombuffer(x, "<i8")
        return _best(ints(r["q_keys"]), ints(r["q_vectors"]).reshape(-1, dims), np.frombuffer(r["q_floor"], "<f8"), ints(r["keys"]), ints(r["vectors"]).reshape(-1, dims), axes, cut, k)

    pairs = grid.groupBy("q", "band", "share").applyInPandas(score, "c long, other long, score long")
    # k + 1 classes per query arrive from each block; each of the best k + 1 then stands for its smallest ids.
    nearest = Window.partitionBy("c").orderBy(F.desc("score"), "other")
    kept = pairs.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n")
    listed = kept.join(classes.select(F.col("c").alias("other"), F.explode("ids").alias("id")), "other").select("c", "id", "score")
    best = Window.partitionBy("c").orderBy(F.desc("score"), "id")
    return listed.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")


def _best(qk: np.ndarray, qv: np.ndarray, floor: np.ndarray, ck: np.ndarray, cv: np.ndarray, axes: np.ndarray, cut: int, k: int) -> pd.DataFrame:
    """Per query the k + 1 best classes of one block, as far as they reach its lower bound (ties: smaller key)."""
    qr, cr = qv @ axes, cv @ axes
    rest_q, rest_c = np.sqrt((qr[:, cut:] ** 2).sum(1)), np.sqrt((cr[:, cut:] ** 2).sum(1))
    slack = 1e-9 * (1 + np.sqrt((qr**2).sum(1)).max(initial=0) * np.sqrt((cr**2).sum(1)).max(initial=0))
    out = []
    for at in range(0, len(qk), 512):
        part = slice(at, at + 512)
        bound = qr[part, :cut] @ cr[:, :cut].T + np.outer(rest_q[part], rest_c) + slack
        rows, cols = np.nonzero(bound >= floor[part][:, None])
        if not len(rows):
            continue
        if len(rows) * 4 > bound.size and (np.abs(qv).max() * np.abs(cv).max() * qv.shape[1]) < SAFE:
            values = np.rint(qv[part].astype(float) @ cv.T.astype(float)).astype("int64")[rows, cols]
        else:
            values = np.concatenate([(qv[part][rows[i : i + 65536]] * cv[cols[i : i + 65536]]).sum(1) for i in range(0, len(rows), 65536)])
        keep = values >= floor[part][rows]
        rows, cols, values = rows[keep], cols[keep], values[keep]
        order = np.lexsort((ck[cols], -values, rows))
        rows, cols, values = rows[order], cols[order], values[order]
        starts = np.searchsorted(rows, np.arange(bound.shape[0]))
        place = np.arange(len(rows)) - starts[rows]
        keep = place <= k
        out.append(pd.DataFrame({"c": qk[part][rows[keep]], "other": ck[cols[keep]], "score": values[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"c": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
