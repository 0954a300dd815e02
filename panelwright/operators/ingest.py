"""Contracts, cleaning, upserts and revision-aware incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.defaults import ADJ_REL_TOL, OVERLAP_DAYS
from panelwright.operators.asof import available_date
from panelwright.session import unite

_NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"
_DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"


def check_panel(panel: DataFrame, required: list[str], key: str = "asset", order: str = "date") -> DataFrame:
    """``(asset, date_key, reason, n_rows)`` for malformed date keys and repeated (key, date) pairs."""
    missing = [c for c in required if c not in panel.columns]
    if missing:
        raise ValueError(f"panel is missing column(s) {missing}")
    text = F.col(order).cast("string")
    counts = panel.groupBy(key, text.alias("date_key")).agg(F.count(F.lit(1)).alias("n_rows"))
    malformed = ~F.coalesce(F.col("date_key").rlike(_DATE_SHAPE), F.lit(False)) | F.try_to_date("date_key").isNull()
    reason = F.when(malformed, "date key is not YYYY-MM-DD").when(F.col("n_rows") > 1, "duplicate key")
    return counts.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(key, "date_key", "reason", "n_rows")


def clean_numeric(df: DataFrame, column: str) -> DataFrame:
    """Missing markers to NULL, numeric text to double; ``violation`` marks any other text.

    Infinities are numbers here (``finite_audit`` finds them); suffixed literals such as ``5d`` are not.
    """
    text = F.trim(F.col(column).cast("string"))
    missing = text.isNull() | text.isin("", ".")
    number = F.when(~missing & text.rlike(_NUMBER_SHAPE), text.try_cast("double"))
    number = F.when(F.isnan(number), F.lit(None).cast("double")).otherwise(number)
    is_nan = F.coalesce(F.lower(text) == "nan", F.lit(False))
    return df.withColumn("violation", ~missing & number.isNull() & ~is_nan).withColumn(column, number)


def finite_audit(df: DataFrame, column: str, key: str = "asset", order: str = "date") -> DataFrame:
    """Per key: how many values are missing or not finite, and the first five of their dates."""
    return contracts.violation_report(df.filter(contracts.not_finite(F.col(column))), key, order, f"{column} missing or non-finite")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` with the supplied non-key columns replaced by ``updates``, plus new keys.

    Columns absent from ``updates`` keep their stored value (NULL on new rows). ``updates`` holds a
    key at most once; a repeat stops the job.
    """
    absent = [k for k in keys if k not in updates.columns]
    if absent:
        raise ValueError(f"upsert is missing key column(s) {absent}")
    unknown = [c for c in updates.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"unknown column(s) {unknown}")
    given = [c for c in updates.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_times"), F.first(F.struct(F.lit(1).alias("_one"), *given)).alias("_u")
    )
    hit = F.when(
        F.col("_times") > 1, contracts.fail("key occurs twice in updates: ", F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]), type_="boolean")
    ).otherwise(F.col("_times").isNotNull())
    joined = target.join(newest, keys, "full").withColumn("_hit", hit)
    columns = [
        F.col(c) if c in keys else (F.when(F.col("_hit"), F.col(f"_u.{c}")).otherwise(F.col(c)) if c in given else F.col(c)).alias(c)
        for c in target.columns
    ]
    return joined.filter(F.col("_hit") | F.col("_hit").isNotNull()).select(*columns)


def append(
    target: DataFrame, rows: DataFrame, universe: DataFrame | None = None, key: str = "asset", unique: list[str] | None = None
) -> DataFrame:
    """Append rows whose columns the target knows, whose keys are in the universe and whose ``unique`` columns
    (``[key, "date"]`` where both are there) are not in the target or twice among the rows."""
    unknown = [c for c in rows.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"unknown column(s) {unknown}")
    for f in rows.schema.fields:
        if f.dataType.typeName() == "double":
            rows = rows.withColumn(
                f.name, F.when(F.isnan(f.name), contracts.fail(f"NaN in column {f.name}: pass NULL for missing values")).otherwise(F.col(f.name))
            )
    if universe is not None and key in rows.columns:
        known = universe.select(key, F.lit(True).alias("_known")).distinct()
        checked = rows.join(known, key, "left")
        rows = checked.withColumn(
            key, F.when(F.col("_known").isNull(), contracts.fail(F.col(key), " is not in the universe", type_="string")).otherwise(F.col(key))
        ).drop("_known")
    unique = [c for c in (key, "date") if c in rows.columns] if unique is None else unique
    if len(unique) > 1:
        repeated = duplicate_keys(target, rows, unique).select(*unique, F.lit(True).alias("_repeated"))
        checked = rows.join(repeated, unique, "left")
        shown = F.concat_ws(", ", *[F.col(c).cast("string") for c in unique])
        first = unique[0]
        stop = contracts.fail("key is already stored or occurs twice: ", shown, type_=rows.schema[first].dataType.simpleString())
        rows = checked.withColumn(first, F.when(F.col("_repeated"), stop).otherwise(F.col(first))).select(*rows.columns)
    return unite(target, rows, fill=True)


def duplicate_keys(target: DataFrame, rows: DataFrame, unique: list[str]) -> DataFrame:
    """``(unique columns, n_stored, n_new)`` of the keys that appending ``rows`` would repeat."""
    both = unite(target.select(*unique, F.lit(0).alias("_new")), rows.select(*unique, F.lit(1).alias("_new")))
    counts = both.groupBy(*unique).agg((F.count(F.lit(1)) - F.sum("_new")).alias("n_stored"), F.sum("_new").alias("n_new"))
    return counts.filter((F.col("n_new") > 0) & (F.col("n_stored") + F.col("n_new") > 1))


def high_watermark(df: DataFrame, universe: DataFrame, key: str = "asset", order: str = "date") -> DataFrame:
    """Newest stored date per universe key, NULL where nothing is stored."""
    newest = df.groupBy(key).agg(F.max(order).alias("max_date"))
    return universe.select(key).distinct().join(newest, key, "left")


def incremental(df: DataFrame, watermark: DataFrame, overlap_days: int | None, key: str = "asset", order: str = "date") -> DataFrame:
    """Rows to load: from ``max - overlap`` on (inclusive), or strictly after ``max`` when overlap is None.

    A key without a watermark loads its whole history.
    """
    joined = df.join(watermark.select(key, "max_date"), key, "left")
    top = F.col("max_date")
    fresh = F.col(order) > top if overlap_days is None else F.col(order) >= F.date_sub(top, overlap_days)
    return joined.filter(top.isNull() | fresh).drop("max_date")


def overlap_mismatches(
    stored: DataFrame, fetched: DataFrame, overlap_days: int = OVERLAP_DAYS, tolerance: float = ADJ_REL_TOL, key: str = "asset", order: str = "date", value: str = "adj_close"
) -> DataFrame:
    """Dates in ``[max - overlap, max)`` whose stored and fetched values disagree.

    Exactly one NULL is a disagreement, two are not; the newest stored bar never votes because an
    intraday fetch may have changed it.
    """
    top = stored.groupBy(key).agg(F.max(order).alias("_max"))
    old = stored.select(key, order, F.col(value).alias("stored")).join(top, key)
    old = old.filter((F.col(order) >= F.date_sub("_max", overlap_days)) & (F.col(order) < F.col("_max"))).drop("_max")
    both = old.join(fetched.select(key, order, F.col(value).alias("fetched")), [key, order])
    a, b = F.col("stored"), F.col("fetched")
    apart = F.abs(a - b) > F.greatest(F.abs(a), F.abs(b)) * tolerance
    return both.filter((a.isNull() != b.isNull()) | F.coalesce(apart, F.lit(False)))


def merge_prices(
    stored: DataFrame, fetched: DataFrame, full: DataFrame, universe: DataFrame | None = None, overlap_days: int = OVERLAP_DAYS, key: str = "asset", order: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """Revision-aware merge: ``(merged panel, new-row count per key)``.

    A key with any overlap disagreement, or nothing stored, takes its full refreshed history; other
    keys take the overlap and newer rows only.
    """
    unknown = [c for c in full.columns if c not in stored.columns]
    if unknown:
        raise ValueError(f"unknown column(s) {unknown}")
    rows = _aligned(stored, fetched, full, key, order)
    whole, whole_times = ("_f", "_f_times") if full is fetched else ("_u", "_u_times")
    # A key's rows are together already, so what the whole key decides is a window and no further exchange.
    per_key = Window.partitionBy(key)
    a, b = F.col("_s.adj_close"), F.col("_f.adj_close")
    apart = (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > F.greatest(F.abs(a), F.abs(b)) * ADJ_REL_TOL, F.lit(False))
    rows = rows.withColumn("_max", F.max(F.when(F.col("_s").isNotNull(), F.col(order))).over(per_key))
    since = F.col(order) >= F.date_sub("_max", overlap_days)
    votes = F.col("_s").isNotNull() & F.col("_f").isNotNull() & since & (F.col(order) < F.col("_max")) & apart
    rows = rows.withColumn("_full", F.col("_max").isNull() | F.max(F.coalesce(votes, F.lit(False))).over(per_key))
    chosen = F.when(F.col("_full"), F.col(whole)).when(since, F.col("_f"))
    times = F.when(F.col("_full"), F.col(whole_times)).when(since, F.col("_f_times"))
    repeated = contracts.fail("key occurs twice in updates: ", F.col(key), ", ", F.col(order), type_="boolean")
    rows = rows.withColumn("_new", chosen).withColumn("_hit", F.when(F.coalesce(times, F.lit(0)) > 1, repeated).otherwise(F.col("_new").isNotNull()))
    counts = rows.filter("_hit").groupBy(key).agg(
        F.count(F.when(F.col("_full") | (F.col(order) > F.col("_max")), 1)).alias("new_rows"), F.max("_full").alias("full_refresh")
    )
    if universe is not None:
        counts = universe.select(key).join(counts, key, "left").select(
            key, F.coalesce("new_rows", F.lit(0)).alias("new_rows"), F.coalesce("full_refresh", F.lit(False)).alias("full_refresh")
        )
    given = [c for c in full.columns if c not in (key, order)]
    columns = [
        F.col(c) if c in (key, order) else (F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(f"_s.{c}")) if c in given else F.col(f"_s.{c}")).alias(c)
        for c in stored.columns
    ]
    return rows.filter(F.col("_hit") | F.col("_s").isNotNull()).select(*columns), counts


def _aligned(stored: DataFrame, fetched: DataFrame, full: DataFrame, key: str, order: str) -> DataFrame:
    """One row per (key, date) with the stored, fetched and fully refreshed values side by side.

    Each frame is read once; one that serves as both fetched and full is not read again.
    """
    sources = {"_s": stored, "_f": fetched} | ({} if full is fetched else {"_u": full})
    parts = [df.select(key, order, F.lit(name).alias("_src"), F.struct(*[c for c in df.columns if c not in (key, order)]).alias(name)) for name, df in sources.items()]
    together = unite(*parts, fill=True).repartition(key)
    values = [F.max(name).alias(name) for name in sources]
    times = [F.count(F.when(F.col("_src") == name, 1)).alias(f"{name}_times") for name in sources]
    twice = contracts.fail("key is stored twice: ", F.col(key), ", ", F.col(order), type_="boolean")
    return together.groupBy(key, order).agg(*values, *times).filter(F.when(F.col("_s_times") > 1, twice).otherwise(F.lit(True)))


def append_macro(stored: DataFrame, incoming: DataFrame, lags: dict[str, int], ingested_at: Column | None = None) -> DataFrame:
    """First print wins: only observations after each series' newest stored one are added.

    ``incoming`` is ``(series_id, obs_date, value)`` with the value as raw text or number.
    """
    series = incoming.select("series_id").distinct()
    top = high_watermark(stored, series, "series_id", "obs_date")
    fresh = clean_numeric(incremental(incoming, top, None, "series_id", "obs_date"), "value")
    value = F.when(
        F.col("violation"), contracts.fail("unparseable value of ", F.col("series_id"), " at ", F.col("obs_date"))
    ).otherwise(F.col("value"))
    fresh = available_date(fresh.withColumn("value", value).drop("violation"), lags)
    if ingested_at is not None:
        fresh = fresh.withColumn("ingested_at", ingested_at)
    return unite(stored, fresh, fill=True)


def coverage(df: DataFrame, universe: DataFrame, key: str = "asset", order: str = "date") -> DataFrame:
    """Rows, first and last date per universe key; ``empty`` marks keys without rows."""
    seen = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("first_date"), F.max(order).alias("last_date"))
    joined = universe.select(key).distinct().join(seen, key, "left")
    return joined.withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).withColumn("empty", F.col("n_rows") == 0)


def audit_tables(tables: dict[str, DataFrame], rules: list[dict]) -> DataFrame:
    """Count violations of declarative rules: ``(table, rule, target, n_violations)``.

    Rules: ``{"table", "rule": "not_null", "column"}``, ``{"rule": "domain", "column", "values"}``,
    ``{"rule": "unique", "columns"}``, ``{"rule": "reference", "column", "to", "to_column"}``,
    ``{"rule": "at_most_one", "column"}``. Not-null, domain and at-most-one rules of a table share one scan.
    """
    scans: dict[str, list[tuple[str, str, Column]]] = {}
    parts: list[DataFrame] = []

    def row(counted: DataFrame, table: str, rule: str, target: str) -> DataFrame:
        return counted.select(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(target).alias("target"), F.col("n").cast("long").alias("n_violations")
        )

    for r in rules:
        table, rule = r["table"], r["rule"]
        df = tables[table]
        if rule == "not_null":
            scans.setdefault(table, []).append((rule, r["column"], F.count(F.when(F.col(r["column"]).isNull(), 1))))
        elif rule == "domain":
            outside = F.col(r["column"]).isNotNull() & ~F.col(r["column"]).isin(r["values"])
            scans.setdefault(table, []).append((rule, r["column"], F.count(F.when(outside, 1))))
        elif rule == "at_most_one":
            extra = F.greatest(F.count(F.when(F.col(r["column"]), 1)) - 1, F.lit(0))
            scans.setdefault(table, []).append((rule, r["column"], extra))
        elif rule == "unique":
            repeats = df.groupBy(*r["columns"]).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").agg(F.count(F.lit(1)).alias("n"))
            parts.append(row(repeats, table, rule, ",".join(r["columns"])))
        elif rule == "reference":
            known = tables[r["to"]].select(F.col(r["to_column"]).alias(r["column"])).distinct()
            orphans = df.filter(F.col(r["column"]).isNotNull()).join(known, r["column"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
            parts.append(row(orphans, table, rule, r["column"]))
        else:
            raise ValueError(f"unknown rule {rule!r}")
    for table, checks in scans.items():
        counted = tables[table].agg(*[c.alias(f"_{i}") for i, (_, _, c) in enumerate(checks)])
        cells = F.array(
            *[F.struct(F.lit(rule).alias("rule"), F.lit(target).alias("target"), F.col(f"_{i}").cast("long").alias("n")) for i, (rule, target, _) in enumerate(checks)]
        )
        parts.append(
            counted.select(F.explode(cells).alias("_c")).select(
                F.lit(table).alias("table_name"), "_c.rule", "_c.target", F.col("_c.n").alias("n_violations")
            )
        )
    return unite(*parts)


def set_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of ``left`` absent from ``right``: unknown assets, unknown columns, missing keys."""
    return left.select(*columns).distinct().join(right.select(*columns).distinct(), columns, "left_anti")
