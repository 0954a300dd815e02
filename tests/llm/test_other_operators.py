"""Url rules, top-k search, token counts, pieces, the quality rules and the pipeline against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import pieces, quality, registry, token_counts, topk, url_filter
from panelwright.llm.skew import hot_parts

RULES = [*registry.RULES, ("example.com", "/", "allow"), ("a.example.com", "/x", "block"), ("net", "/", "allow"), ("EXAMPLE.com", "/", "block"), (None, "/", "block")]


def judged(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), p, h.lower() + p, v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, 0, "", None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("rows_per_slice", [7, 10**6])
def test_url_rules_equal_a_scan_of_all_rules(spark, rows_per_slice):
    rnd = random.Random(5)
    hosts = ["example.com", "www.Example.com", "a.example.com", "b.a.example.com", "notexample.com", "x.net", "net", "com", "example.com.", "com.example", "localhost", "ex\u00c4mple.com"]
    urls = [f"{rnd.choice(['http', 'HTTPS', ''])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en/a?b#c', '/es/1', '/x', '?q=/en/', '#f', '/fr/x://y', chr(10) + '/en/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://", *["https://www.example.com/en/same"] * 40]
    pages = spark.createDataFrame([(i, u, "k", "r") for i, u in enumerate(urls)], "page_id long, url string, key string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.rule_frame(spark, RULES), rows_per_slice=rows_per_slice).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == judged(u), u
        assert got[i].key == "k"


def test_url_rules_without_rows_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://example.com/en/")], "page_id long, url string")
    rules = url_filter.rule_frame(spark, RULES)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()] == ["allow"]


def test_hot_parts_are_few_and_follow_the_share(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("key"))
    assert [(r.key, r.parts) for r in hot_parts(rows, "key").collect()] == [(-1, 2048)]
    assert [r.parts for r in hot_parts(rows, "key", 10_000).collect()] == [3]


def best_by_brute_force(vectors, k):
    out = []
    for q, v in vectors.items():
        if q % 20 == 0 and v is not None:
            scores = sorted((-int(np.dot(v, x)), i) for i, x in vectors.items() if i != q and x is not None and len(x) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k_equals_brute_force(spark, block):
    rnd = np.random.default_rng(4)
    vectors = {i: rnd.integers(-9, 10, 6).tolist() for i in range(260)}
    vectors |= {i: [3, 1, 0, -2, 5, 5] for i in range(300, 400)}  # more equal vectors than any list holds
    vectors |= {i: [x * 40 for x in vectors[i - 400]] for i in range(400, 420)} | {420: [0] * 6, 440: None, 460: [1, 2], 480: [2, 1], 461: [0, 0]}
    rows = spark.createDataFrame([(i, v, "c") for i, v in vectors.items()] + [(0, vectors[0], "c"), (None, [1] * 6, "c")], "vec_id long, v array<long>, score string")
    got = topk.top_k(rows, rows.where("vec_id % 20 = 0").select("vec_id"), 5, block=block)
    assert sorted(tuple(r) for r in got.collect()) == best_by_brute_force(vectors, 5)
    assert topk.top_k(rows.limit(0), rows.select("vec_id"), 5).count() == 0
    assert topk.top_k(rows, rows.limit(0).select("vec_id"), 5).count() == 0


def test_quantized_vectors(spark):
    rows = spark.createDataFrame([([0.5, -0.01],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)], "e array<float>")
    assert [r.v for r in rows.select(topk.quantized(F.col("e")).alias("v")).collect()] == [[32, -1], None, None, None, None, []]


def test_token_counts_follow_edits(spark):
    rnd = random.Random(2)
    bits = ["", " ", "  ", "x", "'re", "e", " the end", "\n", "  \n ", "é!", "1", "ll d'", None]
    texts = ["", "a", "   x   y  ", "I'll we're 'r e", "\n\n  \n a1b2!!  ?", " ".join(rnd.choice("one two3 four'll  é!".split(" ")) for _ in range(900)), None]
    rows = [(i, t, [(rnd.randint(-1, len(t or "") + 2), rnd.choice([0, 1, 2, 7, 60]), rnd.choice(bits)) for _ in range(8)], "c") for i, t in enumerate(texts * 12)]
    rows += [(900, "same", None, "c"), (900, "same", None, "c"), (901, "same", [None], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at: int, removed: int, inserted: string>>, tree string")
    encode = token_counts.counter(token_counts.TOKENIZER).encode
    got = token_counts.apply_edits(token_counts.count_tokens(docs)).collect()
    assert len(got) == len(rows)
    once = token_counts.apply_edits(docs.drop("tree")).collect()
    assert sorted(str((r.doc_id, r.text, r.n_tokens, r.encoded_chars)) for r in once) == sorted(str((r.doc_id, r.text, r.n_tokens, r.encoded_chars)) for r in got)
    assert all(r.n_before == len(encode(next(t for i, t, _, _ in rows if i == r.doc_id))) for r in once if r.text is not None)
    for r in got:
        want = next(t for i, t, _, _ in rows if i == r.doc_id)
        if want is None:
            assert r.text is None and r.n_tokens is None
            continue
        for e in r.edits or []:
            if e is not None:
                at = min(max(e.at, 0), len(want))
                want = want[:at] + (e.inserted or "") + want[at + e.removed :]
        assert (r.text, r.n_tokens) == (want, len(encode(want)))
        assert sum(r.tree.chars) == len(want) and r.tree.sums[1] == r.n_tokens
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_an_edit_encodes_its_surroundings_only():
    c = token_counts.counter(token_counts.TOKENIZER)
    text = "word and more of it " * 5000
    tree = token_counts.grown(text, c)
    new, again = token_counts.edited(text, tree, 50_000, 3, "new", c)
    assert tree.total == len(c.encode(new)) and again < 300


def test_pieces_are_lossless_and_seeded(spark):
    texts = ["", " ", "  a  b ", "x\u2581y", "é\n\nz", "漢字🙂 ok\x00\t", "Hello world, hello world " * 400, None, "Hello", "Hello"]
    docs = spark.createDataFrame([(i if i < 8 else 8, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, decoded int")
    once = pieces.encode(docs)
    got = [tuple(r) for r in pieces.decode(once).select("doc_id", "text", "pieces", "decoded").collect()]
    assert all(t == d for _, t, _, d in got)
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in pieces.encode(docs, decoded="decoded").select("doc_id", "text", "pieces", "decoded").collect())
    again = [tuple(r) for r in pieces.encode(docs.repartition(5)).select("doc_id", "text", "pieces").collect()]
    key = lambda r: (r[0], str(r[1]))
    assert sorted((r[:3] for r in got), key=key) == sorted(again, key=key)
    other = pieces.encode(docs, seed=1).where("doc_id = 6").first().pieces
    assert other != next(r[2] for r in got if r[0] == 6)
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0


def test_segmentations_are_drawn_with_their_probability():
    v = pieces.vocabulary(pieces.MODEL, 1.0)
    of = {v.bytes[i]: w for i, w in zip(v.ids.tolist(), v.weights.tolist(), strict=True)}
    word, paths = b" theres", {}

    def walk(at, path, weight):
        if at == len(word):
            paths[path] = np.exp(weight)
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in of:
                walk(end, (*path, word[at:end]), weight + of[word[at:end]])

    walk(0, (), 0.0)
    n, total = 20_000, sum(paths.values())
    drawn = [tuple(v.bytes[i] for i in x) for x in pieces.segment(["theres"] * n, list(range(n)), pieces.Words(v), 0)]
    for path, weight in paths.items():
        p = weight / total
        assert abs(drawn.count(path) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_rules_separate_and_compile_to_the_same_score(spark):
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5)).astype(float)
    model = quality.fit(x[:3000], ["a", "b", "c"], y[:3000])
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[3000:])], "i int, a double, b double, c double")
    got = {r.i: r.s for r in frame.select("i", model.score({n: F.col(n) for n in "abc"}).alias("s")).collect()}
    margin = model.bias + sum(w * np.all([(x[3000:, "abc".index(n)] > e) == above for n, above, e in rule], axis=0) for rule, w in model.rules)
    assert np.allclose([got[i] for i in range(1000)], 1 / (1 + np.exp(-margin)))
    assert ((np.array([got[i] for i in range(1000)]) > 0.5) == y[3000:]).mean() > 0.97
    assert 0 < len(model.rules) < 60


def test_quality_on_held_out_labels(spark):
    scored = registry.op10_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((scored["predicted"] == scored["quality"]).mean() > 0.98) and scored["score"].between(0, 1).all()


def test_quality_without_labels_texts_or_ids(spark):
    docs = spark.createDataFrame([(1, "a b", 1.0), (None, None, 1.0), (1, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(docs, labels).collect()] == [0.5] * 3
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 3 and quality.classify(docs.limit(0), labels).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.01"
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{source}/documents.parquet")
    item = spark.read.parquet(f"{source}/benchmark.parquet").first().text
    extra = [(10**6, docs.where("doc_id = 1").first().text, "en", "src1", 5), (10**6 + 1, "Plain start. " + item, "en", "src1", 5), (10**6 + 2, "", "en", "src1", 0), (10**6 + 3, None, None, None, None), (1, docs.where("doc_id = 1").first().text, "en", "src1", 416)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1 in got and 10**6 not in got and 10**6 + 1 not in got
    assert all(r.lossless for r in got.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{source}/labels.parquet").collect()}
    assert sum(labels.get(d) == 0 for d in got) <= 3
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicates", "benchmark decontamination", "sentencepiece"]
