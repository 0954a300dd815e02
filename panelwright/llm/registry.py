"""Queries of the operators with production parameters over whole tables, and the SQL giving their expected rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import collocations, decontaminate, license_scan, line_dedup, near_dup, packing, passages, pieces, quality, repeats, search, token_counts, topk, url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), threshold=(85, 100))


def derived_edits(doc_id: Column, text: Column, n: int = 3) -> Column:
    """Edits that depend on the row alone: cuts of up to 23 characters, insertions of up to 39 from the text itself."""
    draw = lambda k, below: F.pmod(F.xxhash64(doc_id, F.lit(k)), below).cast("int")
    size = F.coalesce(F.length(text), F.lit(0))
    return F.array(
        *[F.struct(draw(4 * k, size + 1).alias("at"), draw(4 * k + 1, F.lit(24)).alias("removed"), F.substring(text, draw(4 * k + 2, size + 1), draw(4 * k + 3, F.lit(40))).alias("inserted")) for k in range(n)]
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", derived_edits(F.col("doc_id"), F.col("text")).alias("edits"))
    return token_counts.apply_edits(docs).select("doc_id", "n_before", "n_tokens", "encoded_chars")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rule_frame(spark, RULES)).drop("url")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return coded.select("doc_id", "pieces", F.coalesce(F.size("pieces"), F.lit(0)).alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0).select("vec_id"), 20)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", "n_lines", "n_removed", "text")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.drop("text")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = repeats.remove_repeats(docs, beside=passages.repeated_words(docs))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.coalesce("n_repeated_words", F.lit(0)).cast("long").alias("n_repeated_words"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.select("doc_id", "held_out", "score", "predicted")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_ = packing.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = pieces_.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(digests)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.store_index(search.build_index(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_topk": op6_topk,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_repeats": op9_repeats,
    "op10_quality": op10_quality,
    "op11_packing": op11_packing,
    "op12_collocations": op12_collocations,
    "op13_search": op13_search,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(license_scan.TEMPLATES.items()))
    words = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    grams = "list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)"
    # Sentence ends are marked first: that engine's patterns have no look-behind.
    sentences = "string_split_regex(regexp_replace(text, '([.!?])[ \\t\\n\\v\\f\\r]+', '\\1' || chr(10), 'g'), '\\n+')"
    return f"""
WITH t AS (SELECT license, {grams} AS b FROM (SELECT license, {words.format("wording")} AS w FROM (VALUES {rows}) v(license, wording))),
u AS (SELECT DISTINCT doc_id, unit FROM (SELECT doc_id, unnest(list_distinct(list_concat({sentences}, list_concat(string_split(text, chr(10)), [text])))) AS unit FROM documents)),
g AS (SELECT DISTINCT doc_id, w, {grams} AS b FROM (SELECT doc_id, {words.format("unit")} AS w FROM u)),
s AS (SELECT doc_id, license, 2 * CAST(len(list_intersect(g.b, t.b)) AS DOUBLE) / (len(g.b) + len(t.b)) AS dice FROM g JOIN t
      ON len(g.b) * {2 - license_scan.THRESHOLD} >= len(t.b) * {license_scan.THRESHOLD} - 1e-6 AND len(g.b) * {license_scan.THRESHOLD} <= len(t.b) * {2 - license_scan.THRESHOLD} + 1e-6)
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units FROM s WHERE dice >= {license_scan.THRESHOLD} GROUP BY doc_id, license"""


def _url_sql() -> str:
    rules = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in RULES)
    return f"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
       coalesce(arg_max(rule_verdict, length(rule_host || rule_path)), 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path"""


TOPK_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

LINE_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT DISTINCT source, text, lines FROM d WHERE source IS NOT NULL AND text IS NOT NULL),
t AS (SELECT source, count(*) AS total FROM p GROUP BY source),
l AS (SELECT source, line, count(*) AS pages FROM (SELECT source, text, unnest(list_distinct(list_transform(lines, lambda x: trim(x)))) AS line FROM p) GROUP BY source, line),
b AS (SELECT source, list(line) AS cut FROM l JOIN t USING (source) WHERE line <> '' AND pages >= 2
      AND CAST(pages AS DOUBLE) / total > CASE WHEN pages < {line_dedup.MIN_PAGES} THEN {line_dedup.RATIO} * pow({line_dedup.MIN_PAGES}.0 / pages, 2) ELSE {line_dedup.RATIO} END GROUP BY source),
k AS (SELECT doc_id, source, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(cut, []), trim(x))) AS kept FROM d LEFT JOIN b USING (source))
SELECT doc_id, source, CAST(len(lines) AS INTEGER) AS n_lines, CAST(len(lines) - len(kept) AS INTEGER) AS n_removed, array_to_string(kept, chr(10)) AS text FROM k"""

NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT reach.d, l.y FROM reach JOIN l ON l.x = reach.c)
SELECT d AS doc_id, any_value(n) AS n_shingles, min(c) AS component_id, d = min(c) AS kept FROM reach JOIN n ON n.doc_id = d GROUP BY d"""

PHRASE_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) s(size)),
c AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY lang, size, phrase HAVING count(*) >= 30),
x AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM c WHERE size > 1),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM x)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, h.a AS l, t.a AS r, CAST((CAST(2000000 AS HUGEINT) * k.a) // (h.a + t.a) AS BIGINT) AS score
      FROM k JOIN c h ON h.lang = k.lang AND h.phrase = k.head JOIN c t ON t.lang = k.lang AND t.phrase = k.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (
      SELECT lang, a, unnest(list_transform(range(1, size - part + 2), lambda j: array_to_string(w[j:j + part - 1], ' '))) AS phrase FROM x, (VALUES (2), (3)) q(part) WHERE part < size) GROUP BY lang, phrase),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i USING (lang, phrase)
      WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000"""

SEARCH_SQL = """
WITH d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT d, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
z AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM t),
p AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(w) AS term FROM t) GROUP BY d, doc_id, n, term),
v AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, z GROUP BY term, big_n),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
s AS (SELECT item_id, d, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
      FROM q JOIN v USING (term) JOIN p USING (term), z GROUP BY item_id, d, doc_id),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""

SQL: dict[str, str] = {"op12_collocations": PHRASE_SQL, "op13_search": SEARCH_SQL, "op1_license_scan": _license_sql(), "op2_near_duplicates": NEAR_SQL, "op4_url_filter": _url_sql(), "op6_topk": TOPK_SQL, "op7_line_dedup": LINE_SQL}
