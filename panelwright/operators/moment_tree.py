"""Moments of many date windows over a panel, two partial results per window and key.

The windows' bounds cut the calendar into intervals; a row counts once, for its interval. Over the intervals lies a
tree of power-of-two ranges. Every interval has, per level, the moments from it to the middle of its range, so any window
is one such part left of a middle and one right of it, found by equality joins. Equal windows are put together once,
however many scenarios have them. Moments are centred on a value of their own part and merged around means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import durable, unite

LEVELS = 21  # 2^20 days are over 2,800 years
_ORIGIN = 1 << 20  # moves day numbers above zero, so that nodes stay aligned whatever a panel's first day is
_OPEN_LOW, _OPEN_HIGH = -1, 1 << 40  # bounds of windows that are open on that side
KEYS_PER_ROW = 32


def _day(column: Column) -> Column:
    return F.unix_date(column).cast("long") + _ORIGIN


def window_nodes(windows: DataFrame, first: Column, last: Column, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """``windows`` with one row per tree node of its closed interval: ``_level, _node``. Open bounds, and those beyond
    the panel's ``first`` and ``last`` day, are the panel's. An empty interval has no rows."""
    low = F.greatest(F.coalesce(_day(F.col(start)), first), first)
    high = F.least(F.coalesce(_day(F.col(end)), last), last) + 1
    bounded = windows.withColumn("_low", low).withColumn("_high", high).filter(F.col("_low") < F.col("_high"))

    def nodes(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        a, b = F.call_function("div", F.col("_low") + width - 1, width), F.call_function("div", F.col("_high"), width)
        # What lies between the aligned bounds of this level and those of the next one up, on either side.
        left = F.when((a < b) & (a % 2 == 1), F.struct(level.alias("_level"), a.alias("_node")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(level.alias("_level"), (b - 1).alias("_node")))
        return F.array(left, right)

    cover = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), nodes)))
    return bounded.withColumn("_n", F.explode(cover)).select(*windows.columns, "_n._level", "_n._node")


def _cuts(bounds: DataFrame) -> DataFrame:
    """``_day, _pos``: the days at which a window begins or has just ended, numbered from 1. At most one row a day."""
    days = bounds.select(F.explode(F.array("_low", "_high")).alias("_day")).filter(F.col("_day").between(_OPEN_LOW + 1, _OPEN_HIGH - 1))
    return days.distinct().withColumn("_pos", F.row_number().over(Window.orderBy("_day")).cast("long"))


def _cells(rows: DataFrame, cuts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, _pos, _k, _m, _v``: count, mean and squared deviations per key and interval between cuts; 0 is before the first."""
    until = F.lead("_day").over(Window.orderBy("_day")) - 1
    calendar = cuts.select("_pos", "_day", until.alias("_last")).filter("_last IS NOT NULL")
    calendar = calendar.select("_pos", F.explode(F.sequence("_day", "_last")).alias("_day"))
    edge = cuts.agg(F.struct(F.min("_day").alias("first"), F.max("_pos").alias("n")).alias("e")).select("e").scalar()
    found = rows.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("_x"), _day(F.col(order)).alias("_day")).join(calendar, "_day", "left").withColumn("_e", edge)
    outside = F.when(F.col("_day") >= F.col("_e.first"), F.col("_e.n")).otherwise(F.lit(0).cast("long"))
    placed = found.select(key, F.coalesce("_pos", outside).alias("_pos"), "_x")
    moments = [F.count("_x").cast("double").alias("_k"), F.avg("_x").alias("_m"), (F.var_pop("_x") * F.count("_x")).alias("_v")]
    return placed.groupBy(key, "_pos").agg(*moments)


def _placed(bounds: DataFrame, cuts: DataFrame) -> DataFrame:
    """Bounds with the first and last interval of each window, and the level whose middle lies between these."""
    first, after = cuts.select(F.col("_day").alias("_low"), F.col("_pos").alias("_a")), cuts.select(F.col("_day").alias("_high"), (F.col("_pos") - 1).alias("_b"))
    last = cuts.agg(F.coalesce(F.max("_pos"), F.lit(0).cast("long"))).scalar()
    found = bounds.join(first, "_low", "left").join(after, "_high", "left").withColumn("_end", last)
    found = found.select("_low", "_high", F.coalesce("_a", F.lit(0).cast("long")).alias("_a"), F.coalesce("_b", "_end").alias("_b")).filter("_a <= _b")
    level = F.when(F.col("_a") == F.col("_b"), 0).otherwise(F.length(F.bin(F.col("_a").bitwiseXOR(F.col("_b")))) - 1)
    return found.withColumn("_level", level.cast("int"))


def _parts(cells: DataFrame, placed: DataFrame, key: str, chunks: int) -> DataFrame:
    """``_level, _pos, _chunk, _keys``: for each place a window asks for, the moments from there to the middle of its
    range, of all keys of a chunk in the order of the keys."""
    asked = placed.select("_level", F.explode(F.array("_a", "_b")).alias("_pos")).distinct()
    levels = asked.select(F.collect_set("_level")).scalar()  # at most LEVELS numbers
    none = F.lit(None).cast("double")
    marks = cells.select(key).distinct().crossJoin(asked).select(key, "_level", "_pos", F.lit(0.0).alias("_k"), none.alias("_m"), none.alias("_v"), F.lit(True).alias("_mark"))
    spread = cells.withColumn("_levels", levels).select(key, F.explode("_levels").alias("_level"), "_pos", "_k", "_m", "_v", F.lit(False).alias("_mark"))
    both = unite(marks, spread)
    half = F.call_function("shiftright", F.col("_pos"), F.col("_level"))
    begin = F.call_function("shiftleft", F.col("_half"), F.col("_level"))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))
    # Of two halves the left one runs towards the middle's left side, the right one away from it.
    far = F.when(F.col("_half") % 2 == 0, begin + size - 1 - F.col("_pos")).otherwise(F.col("_pos") - begin)
    both = both.withColumn("_half", half).withColumn("_far", far)
    run = Window.partitionBy(key, "_level", "_half").orderBy("_far").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # The centre is the first value of the part itself, so its spread bounds what the squares can lose.
    both = both.withColumn("_c", F.first("_m", ignorenulls=True).over(run)).withColumn("_g", F.col("_m") - F.col("_c"))
    sums = {"_n": F.col("_k"), "_s": F.col("_k") * F.col("_g"), "_q": F.col("_v") + F.col("_k") * F.col("_g") * F.col("_g")}
    both = both.select("*", *[F.sum(c).over(run).alias(n) for n, c in sums.items()]).filter("_mark")
    shift = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    part = F.struct(
        F.col(key).alias("key"), F.col("_n").alias("k"), F.coalesce(F.col("_c") + shift, F.lit(0.0)).alias("m"),
        F.coalesce(F.greatest(F.col("_q") - F.col("_s") * shift, F.lit(0.0)), F.lit(0.0)).alias("v"),
    )
    chunk = F.pmod(F.xxhash64(key), F.lit(chunks))
    return both.select("_level", "_pos", chunk.alias("_chunk"), part.alias("_p")).groupBy("_level", "_pos", "_chunk").agg(F.array_sort(F.collect_list("_p")).alias("_keys"))


def _merged(a: Column, b: Column) -> Column:
    """Moments of two parts together; a part without values changes nothing."""
    k, gap = a["k"] + b["k"], b["m"] - a["m"]
    mean = F.when(a["k"] == 0, b["m"]).when(b["k"] == 0, a["m"]).otherwise(a["m"] + gap * b["k"] / k)
    square = a["v"] + b["v"] + F.when((a["k"] > 0) & (b["k"] > 0), gap * gap * a["k"] * b["k"] / k).otherwise(0.0)
    return F.struct(a["key"].alias("key"), k.cast("long").alias("n"), mean.alias("mean"), square.alias("square"))


def window_moments(
    rows: DataFrame, windows: DataFrame, scenario: str = "scenario_id", key: str = "asset", order: str = "date", value: str = "log_return"
) -> DataFrame:
    """``scenario, key, n, mean, square``: count, mean and squared deviations of the values in each closed window.

    Windows without values of a key have no row for it. NULL values don't count.
    """
    low = F.coalesce(_day(F.col("window_start")), F.lit(_OPEN_LOW).cast("long")).alias("_low")
    high = F.coalesce(_day(F.col("window_end")) + 1, F.lit(_OPEN_HIGH).cast("long")).alias("_high")
    bounded = windows.select(scenario, low, high).filter("_low < _high")
    bounds = durable(bounded.select("_low", "_high").distinct())
    cuts = durable(_cuts(bounds))
    cells = durable(_cells(rows, cuts, key, order, value))  # a row per key and interval, read for the keys and the sums
    chunks = max(1, cells.select(key).distinct().count() // KEYS_PER_ROW)
    placed = _placed(bounds, cuts)
    parts = durable(_parts(cells, placed, key, chunks))
    wide = placed.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    left, right = parts.withColumnsRenamed({"_pos": "_a", "_keys": "_left"}), parts.withColumnsRenamed({"_pos": "_b", "_keys": "_right"})
    met = wide.join(left, ["_level", "_chunk", "_a"]).join(right, ["_level", "_chunk", "_b"])
    none = F.struct(F.col("_r.key").alias("key"), F.lit(0.0).alias("k"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    # A window within one interval is that interval's part alone.
    found = bounded.join(met.select("_low", "_high", (F.col("_a") == F.col("_b")).alias("_one"), F.arrays_zip("_left", "_right").alias("_both")), ["_low", "_high"])
    pairs = found.select(scenario, "_one", F.explode("_both").alias("_p")).select(scenario, "_one", F.col("_p._left").alias("_l"), F.col("_p._right").alias("_r"))
    merged = pairs.select(scenario, _merged(F.col("_l"), F.when(F.col("_one"), none).otherwise(F.col("_r"))).alias("_w")).filter("_w.n > 0")
    return merged.select(scenario, F.col("_w.key").alias(key), F.col("_w.n").alias("n"), F.col("_w.mean").alias("mean"), F.col("_w.square").alias("square"))
