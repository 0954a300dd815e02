"""Purged expanding walk-forward folds, as arithmetic on bar positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import HORIZON_BARS


def _check(n_splits: int, horizon: int, embargo: int) -> None:
    if n_splits < 1 or horizon < 0 or embargo < 0:
        raise ValueError(f"need n_splits >= 1, horizon >= 0, embargo >= 0; got {n_splits}, {horizon}, {embargo}")


def fold_struct(n: Column, fold: Column, n_splits: int, horizon: int, embargo: int) -> Column:
    """Half-open train and test ranges of one fold on a panel of ``n`` bars."""
    size = F.floor(n / (n_splits + 1)).cast("long")
    first = n - size * n_splits
    start = first + fold * size
    end = F.when(fold == n_splits - 1, n).otherwise(start + size)
    impossible = (size < 1) | (first - horizon - embargo < 1)
    train_end = F.when(
        impossible,
        contracts.fail(f"{n_splits} folds with horizon {horizon} and embargo {embargo} do not fit ", n, " bars", type_="long"),
    ).otherwise(start - horizon - embargo)
    return F.struct(
        fold.cast("long").alias("fold"),
        F.lit(0).cast("long").alias("train_start"),
        train_end.cast("long").alias("train_end"),
        start.cast("long").alias("test_start"),
        end.cast("long").alias("test_end"),
    )


def walk_forward_folds(n_bars: DataFrame, n_splits: int, horizon: int = HORIZON_BARS, embargo: int = 0) -> DataFrame:
    """Fold ranges for every panel in ``n_bars`` (rows with a column ``n_panel``)."""
    _check(n_splits, horizon, embargo)
    n = F.col("n_panel").cast("long")
    ids = F.sequence(F.lit(0), F.lit(n_splits - 1))
    others = [c for c in n_bars.columns if c != "n_panel"]
    return n_bars.select(
        *others, F.explode(F.transform(ids, lambda i: fold_struct(n, i, n_splits, horizon, embargo))).alias("_f")
    ).select(*others, "_f.*")


def folds_from_ranges(spark: SparkSession, ranges: list[tuple[int, int, int, int]]) -> DataFrame:
    """A hand-written fold table, for auditing splits made elsewhere."""
    rows = [(i, *r) for i, r in enumerate(ranges)]
    return spark.createDataFrame(rows, "fold long, train_start long, train_end long, test_start long, test_end long")


def fold_roles(positions: DataFrame, n_splits: int, horizon: int = HORIZON_BARS, embargo: int = 0) -> DataFrame:
    """Each bar's role (train or test) in each fold it belongs to. Needs ``pos`` and ``n_panel``.

    Ranges are computed from the row's own panel length, so this is a projection, not a range join.
    """
    _check(n_splits, horizon, embargo)
    n, pos = F.col("n_panel").cast("long"), F.col("pos")

    def role(i: Column) -> Column:
        f = fold_struct(n, i, n_splits, horizon, embargo)
        label = F.when((pos >= f["train_start"]) & (pos < f["train_end"]), "train").when(
            (pos >= f["test_start"]) & (pos < f["test_end"]), "test"
        )
        return F.struct(f["fold"].alias("fold"), f["test_start"].alias("test_start"), label.alias("role"))

    roles = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), role), lambda r: r["role"].isNotNull())
    return positions.withColumn("_role", F.explode(roles)).select(*positions.columns, "_role.*")


def eval_points(
    positions: DataFrame, n_splits: int, horizon: int = HORIZON_BARS, stride: int = HORIZON_BARS, embargo: int = 0
) -> DataFrame:
    """Strided test bars whose whole horizon still lies inside the panel."""
    if stride < 1:
        raise ValueError(f"stride must be >= 1, got {stride}")
    tests = fold_roles(positions, n_splits, horizon, embargo).filter("role = 'test'")
    inside = (F.col("pos") + horizon <= F.col("n_panel") - 1) & ((F.col("pos") - F.col("test_start")) % stride == 0)
    return tests.filter(inside).drop("role", "test_start")


def leakage_audit(folds: DataFrame, horizon: int = HORIZON_BARS, by: list[str] | None = None) -> DataFrame:
    """``(by, fold, reason)`` for every fold that is empty, leaks, or is out of order. Empty means clean.

    Folds are numbered in steps of one; each is held against the one before it in its own panel (``by``), which a join
    finds, so the folds of many panels are not ordered in one task.
    """
    by = by or []
    before = folds.select(*by, (F.col("fold") + 1).alias("fold"), (F.col("test_end") - 1).alias("_previous"))
    checked = folds.join(before, [*by, "fold"], "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("train_end") <= F.col("train_start"), F.lit("train is empty")),
            F.when(F.col("test_end") <= F.col("test_start"), F.lit("test is empty")),
            F.when(F.col("train_end") - 1 + horizon >= F.col("test_start"), F.lit("train horizon reaches test")),
            F.when(F.col("test_start") <= F.col("_previous"), F.lit("test windows overlap or run backwards")),
        )
    )
    return checked.select(*by, "fold", F.explode(reasons).alias("reason"))


def fold_report(roles: DataFrame, points: DataFrame, order: str = "date") -> DataFrame:
    """Train and test bars, evaluation points and their date range, per fold."""
    sizes = roles.groupBy("fold").agg(
        F.count(F.when(F.col("role") == "train", 1)).alias("train_bars"),
        F.count(F.when(F.col("role") == "test", 1)).alias("test_bars"),
    )
    scored = points.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_eval_points"), F.min(order).alias("first_eval_date"), F.max(order).alias("last_eval_date")
    )
    return sizes.join(scored, "fold", "left").withColumn("n_eval_points", F.coalesce("n_eval_points", F.lit(0)))
