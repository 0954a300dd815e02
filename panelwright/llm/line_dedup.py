"""Boilerplate lines by their share of a host's pages (operator 7, native).

For every host the operator counts how many of its different pages hold a line and drops the line, wherever
it stands on that host, if that is more than ``ratio`` of the host's different pages. Fewer than ``min_pages``
pages need a higher share, ``ratio * (min_pages / pages) ** 2``, and a single page is never enough; so a small host
loses its boilerplate too, and two near copies lose their lines only on a host of two or three pages. Pages with
the same text count once: a page stored again says nothing about templates.

Scale: lines travel as 16-byte digests, combined before each shuffle, so a host or a line holding a third of
all rows is spread over many tasks. A host can have at most (lines per page / ratio) boilerplate lines,
whatever its size, so the list joined to the pages is small. Pages of a host with more than 1/4096 of all rows
are dealt over parts that each get a copy of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.skew import hot_parts

RATIO = 0.08
MIN_PAGES = 5


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, line, pages, share``: digests of the lines over the ratio. Blank lines and null hosts never are."""
    pages = docs.where(F.col(f"`{host_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{host_col}`").alias("host"), _digest(F.col(f"`{text_col}`")).alias("page"), _lines(F.col(f"`{text_col}`")).alias("lines")
    )
    totals = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("one").alias("total"))
    trimmed = F.filter(F.transform("lines", F.trim), lambda x: x != "")
    held = pages.select("host", "page", F.explode(F.array_distinct(trimmed)).alias("line")).select("host", "page", _digest(F.col("line")).alias("line"))
    counts = held.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min(2, min_pages))
    needed = F.when(F.col("pages") < min_pages, ratio * F.pow(min_pages / F.col("pages"), F.lit(2.0))).otherwise(F.lit(ratio))
    return counts.join(totals, "host").select("host", "line", "pages", (F.col("pages") / F.col("total")).alias("share")).where(F.col("share") > needed)


def dedup_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``docs`` with the text cut, plus ``n_lines`` and ``n_removed``.

    Lines are compared without surrounding blanks; blank lines stay. A null host or text passes unchanged
    (null text: 0 lines); an empty text is one blank line. A text of boilerplate only becomes empty. Repeated
    rows are treated alike and all come back. Existing columns called ``n_lines`` or ``n_removed`` are replaced.
    """
    found = boilerplate_lines(docs, host_col, text_col, ratio, min_pages).groupBy("host").agg(F.collect_set("line").alias("drop"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")])
    hosts = docs.select(F.col(f"`{host_col}`").alias("host")).where("host IS NOT NULL")
    hot = F.broadcast(hot_parts(hosts, "host"))
    # Drawn on the scan, before any shuffle: equal for a row however often a lost task runs again.
    rows = docs.select(row.alias("row"), F.col(f"`{host_col}`").alias("host"), _lines(F.col(f"`{text_col}`")).alias("lines"), F.rand(7).alias("draw"))
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(hot, "host", "left").select("row", "host", "lines", F.floor(F.col("draw") * parts).cast("int").alias("part"))
    found = found.join(hot, "host", "left").select("host", "drop", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = rows.join(found, ["host", "part"], "left")
    keep = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), _digest(F.trim(x)))))
    rows = rows.select("row", "lines", keep.alias("kept"))
    n = F.coalesce(F.size("lines"), F.lit(0))
    out = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*out, F.when(F.col("lines").isNull(), 0).otherwise(n).alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).alias("n_removed"))
