"""Allow/block rules for urls as a sorted sweep over reversed hosts (operator 4, native).

A rule ``(host, path)`` fits a host and all its subdomains when the url's path starts with the rule's path.
Hosts are written as reversed labels with a closing dot (``www.example.com`` -> ``com.example.www.``), so a
rule host covers an interval of the sorted keys, and intervals are nested or apart. The sweep walks the keys
in order; the rules of all open intervals form the stack. Because intervals nest, the stack after an opening
is the rule host's own rules plus those of the hosts around it, and after a closing it is the stack of the
next host outside. Both are worked out once per rule host, so the sweep itself is one running ``last``.

Scale: the sweep runs per slice. Rows of one domain (last two labels) share a bucket, rule hosts go only to
the buckets that can need them, and a domain with more rows than a slice holds (and over 1/4096 of all) is
dealt over several slices, with its few rule events copied to each. No slice depends on one host, url or domain being small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.llm.skew import hot_parts

ROWS_PER_SLICE = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _slice(buckets: Column, parts: Column, part: Column) -> Column:
    """A bucket shared by many domains, or one part of a domain that is too large for a bucket."""
    shared = F.concat_ws("/", F.lit(""), F.pmod(F.xxhash64("domain"), buckets))
    return F.when(parts.isNull(), shared).otherwise(F.concat_ws("/", F.col("domain"), part)).alias("slice")


def rule_frame(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(host, path, verdict)`` tuples as a rule table."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.explode(rows).alias("rule")).select("rule.*")


def _events(rules: DataFrame) -> DataFrame:
    """Opening and closing events of every rule host with the stack that holds from there on.

    The stack is an array, longest rule first. Enclosing hosts are found by an equality join on the
    suffixes of each rule host, of which there are as many as it has labels.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict"
    )
    # The same host and path given twice: block wins over allow, so the result doesn't depend on order.
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = rules.groupBy("host").agg(
        F.collect_list(
            F.struct(
                F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), "path",
                F.concat("host", "path").alias("rule"), "verdict",
            )
        ).alias("own")
    )
    labels = F.split(F.col("host"), r"\.", -1)
    suffixes = own.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("skipped", "around"))
    stacks = (
        suffixes.join(own.select(F.col("host").alias("around"), "own"), "around")
        .groupBy("host")
        .agg(
            F.reverse(F.array_sort(F.flatten(F.collect_list("own")))).alias("inside"),
            F.reverse(F.array_sort(F.flatten(F.collect_list(F.when(F.col("skipped") > 0, F.col("own")))))).alias("outside"),
        )
    )
    start, broad = _key(F.col("host")), F.size(labels) < 2
    return stacks.select(
        F.when(~broad, _domain(F.col("host"))).alias("domain"),
        F.explode(F.array(F.struct(start.alias("key"), F.lit(0).alias("kind"), F.col("inside").alias("stack")), F.struct(F.concat(start, F.lit("\U0010ffff")).alias("key"), F.lit(2).alias("kind"), F.col("outside").alias("stack")))).alias("e"),
    ).select("domain", "e.*")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """All columns of ``pages`` plus ``host``, ``path``, ``rule`` and ``verdict`` (existing ones of these names are replaced).

    Every row comes back once, repeated rows and rows with nulls included. A null url or one without ``://``
    has an empty host, which no rule fits: null rule, default verdict. Of several fitting rules the longest
    (host and path together, then host) wins. An empty page table gives no rows; an empty rule table leaves
    every row at the default.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")])
    urls = pages.select(row.alias("row"), url_host(F.col(f"`{url_col}`")).alias("host"), url_path(F.col(f"`{url_col}`")).alias("path"))
    urls = urls.withColumn("domain", _domain(F.col("host")))
    events = _events(rules)

    # Equal for a row however often a lost task runs again: drawn on the scan, before any shuffle.
    urls = urls.withColumn("draw", F.rand(20))
    hot = F.broadcast(hot_parts(urls.select("domain"), "domain", rows_per_slice))
    buckets = F.lit(max(1, -(-pages.count() // rows_per_slice)))
    part = F.floor(F.col("draw") * F.coalesce("parts", F.lit(1)))
    urls = urls.join(hot, "domain", "left").select("row", "host", "path", _key(F.col("host")).alias("key"), F.lit(1).alias("kind"), _slice(buckets, F.col("parts"), part))
    every_part = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    narrow = events.where(F.col("domain").isNotNull()).join(hot, "domain", "left").select("key", "kind", "stack", "domain", "parts", every_part)
    narrow = narrow.select("key", "kind", "stack", _slice(buckets, F.col("parts"), F.col("part")))
    # One-label hosts (com) can lie around any domain. There are as many as top-level domains; every slice gets them.
    broad = events.where(F.col("domain").isNull())
    to_buckets = broad.select("key", "kind", "stack", F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket")).select("key", "kind", "stack", F.concat_ws("/", F.lit(""), F.col("bucket")).alias("slice"))
    to_parts = broad.select("key", "kind", "stack", F.substring_index("key", ".", 1).alias("top")).join(
        hot.select("domain", "parts", F.substring_index("domain", ".", -1).alias("top"), every_part), "top"
    ).select("key", "kind", "stack", _slice(buckets, F.col("parts"), F.col("part")))
    narrow = narrow.unionByName(to_buckets).unionByName(to_parts)

    swept = urls.unionByName(narrow, allowMissingColumns=True)
    order = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where(F.col("kind") == 1)
    top = F.element_at(F.filter("stack", lambda r: F.col("path").startswith(r["path"])), 1)
    best = F.when(F.size(F.filter("stack", lambda r: F.col("path").startswith(r["path"]))) > 0, top)
    return swept.select("row.*", "host", "path", best.alias("best")).select("*", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")).drop("best")
