"""Packing, phrases and ranked search against plain versions of their rules."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import collocations, packing, registry, search
from panelwright.llm import text_arrays as T

ODD = ["'", "s", "ll", "re", " ", "  ", "\n", "\t", "a", "B", "12", "²", "é", "ß", "日本", "!?", " ", "　", "\x1c", "\x85", "\U0001f600", "'ve", "<|endoftext|>", "́"]


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(packing.TOKENIZER)
    made.encode_special_tokens = True
    return made


def test_pre_tokens_and_ids_equal_the_tokenizers(tokenizer):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(ODD, k=rnd.randint(0, 15))) for _ in range(4000)] + ["x" * 70_000, "'" * 50 + "s", "word " * 9000]
    codes, got = packing.encoder(packing.TOKENIZER), []
    for _, _, data, offsets in T.runs(pa.array(texts), 50_000):
        ids, begins = packing._encoded(data, offsets, codes, 2)
        got += [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)]
    assert got == [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_equals_its_contract(spark, tokenizer):
    rnd = random.Random(4)
    texts = [None, "", "", *["a b c"] * 40, *[" ".join(rnd.choices(["stone", "river", "of", "XY", "été"], k=rnd.choice([1, 3, 9, 20, 45, 80, 200]))) for _ in range(150)]]
    docs = spark.createDataFrame([(i if i != 5 else None, t, 7, "k") for i, t in enumerate(texts)], "doc_id long, text string, start int, offset string").repartition(5)
    got = packing.place(packing.cut(docs, capacity=64), capacity=64).collect()
    want = {}
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        want[i if i != 5 else None] = [(k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    found = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(v) for d, v in found.items()} == want
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / 64) + 1
    whole = {r.sequence_id: (r.length, bytes(r["ids"]), r.starts) for r in packing.sequences(packing.place(packing.cut(docs, capacity=64), capacity=64)).collect()}
    assert sum(n for n, _, _ in whole.values()) == total and all(len(ids) == 4 * n and starts[0] == 0 for n, ids, starts in whole.values())


def test_packing_without_rows_and_with_wrong_lengths(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.place(packing.cut(empty)).count() == 0
    for wrong in (0, 1025, None):
        with pytest.raises(Exception, match="1 to 1024"):
            packing.place(spark.createDataFrame([(1, wrong)], "doc_id long, length long")).count()


def least_bins(lengths, capacity):
    """Fewest bins, by trying every way."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(k, gaps):
        if len(gaps) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(gaps)
            return
        for g in {g for g in gaps if g >= lengths[k]}:
            at = gaps.index(g)
            go(k + 1, [*gaps[:at], g - lengths[k], *gaps[at + 1 :]])
        go(k + 1, [*gaps, capacity - lengths[k]])

    go(0, [])
    return best[0]


def unrolled(counts, capacity):
    """Sequences of a plan, each a list of (place, length)."""
    steps, bins = packing.plan(counts, capacity).tolist(), defaultdict(list)
    for length, n in counts.items():
        mine = [s for s in steps if s[0] == length]
        for seat in range(n):
            _, first, each, sequence, place = next(s for s in reversed(mine) if s[1] <= seat)
            turn = seat - first
            bins[sequence + turn // each].append((place + turn % each * length, length))
    return bins


def test_plans_fill_gaplessly_and_match_large_items_best():
    rnd = random.Random(9)
    for _ in range(200):
        large = rnd.random() < 0.5
        lengths = [rnd.randint(7 if large else 1, 20) for _ in range(rnd.randint(1, 8))]
        bins = unrolled(Counter(lengths), 20)
        assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)
        for held in bins.values():
            held.sort()
            assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 20
        best = least_bins(lengths, 20)
        assert len(bins) == best if large else len(bins) <= best + 1
    assert max(r[3] for r in packing.plan({700: 10**12, 324: 10**12}).tolist()) == 0


def plain_phrases(rows, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", fold(text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for size in range(1, 5):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    kept = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, w), a in kept.items():
        if any(x[0] == lang and len(x[1]) > len(w) and 100 * b >= 80 * a and any(x[1][i : i + len(w)] == w for i in range(len(x[1]))) for x, b in kept.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def phrase_rows():
    rnd = random.Random(6)
    words = ["of", "the", "River", "stoneÉ", "日本", "x\x00y", "a b", "tall", "Low"]
    rows = [("".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rnd.randint(0, 120))), rnd.choice(["en", "de", None, "und"])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), (" ... ", "fr"), *[("the hot pair meets the " + rnd.choice(words), "en") for _ in range(120)]]


@pytest.mark.parametrize("range_bytes", [10**9, 700])
def test_phrases_equal_brute_force(spark, range_bytes):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, phrase string").repartition(4)
    got = sorted(map(tuple, collocations.collocations(docs, least=5, top=200, range_bytes=range_bytes).collect()))
    assert got == plain_phrases(rows, 5, 200) and len(got) > 250


def test_phrases_of_few_and_no_rows_and_one_long_text(spark):
    docs = spark.createDataFrame([("a b c d e " * 20_000, None)], "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == plain_phrases([("a b c d e " * 20_000, None)], 30, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0


def test_quicksort_counts_every_prefix():
    rng = np.random.default_rng(2)
    n = 30_000
    columns = [rng.integers(1, 3, n), rng.zipf(1.5, n) % 40, rng.integers(0, 6, n), rng.integers(0, 4, n), rng.integers(0, 3, n)]
    columns[1][columns[1] == 0] = 40
    counts = rng.integers(1, 4, n)
    want = Counter()
    for row in range(n):
        path = ()
        for c in columns:
            if c[row] == 0:
                break
            path += (int(c[row]),)
            want[path] += int(counts[row])
    got = {tuple(int(columns[k][at]) for k in range(depth + 1)): size for depth, at, size in collocations.three_way(columns, counts, 30)}
    assert got == {p: c for p, c in want.items() if c >= 30}


def plain_search(rows, items, k):
    words = lambda t: re.findall(search.APART, fold(t or ""))
    docs = [(d, Counter(w), len(w)) for d, w in ((d, words(t)) for d, t in rows) if w]
    big_n, big_l = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, tf, n in docs:
            m = 75 + (25 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in words(text) if t in tf)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [10**8, 3000])
def test_search_equals_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(search, "QUERY_TERMS", 60)
    rnd = random.Random(8)
    vocabulary = [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(400)] + ["Été", "日本", "A", "a"]
    rows = [(i, rnd.choice([" ", "-", "\n"]).join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 5, 30, 120])))) for i in range(700)]
    rows += [(9000 + i, rows[3][1] + " copy") for i in range(60)] + [(None, "w1 w2"), (9999, None), (9998, "... !"), (3, rows[3][1]), (8000, "w7 " * 5000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 25)))) for i in range(12)] + [(90, rows[3][1]), (91, None), (92, ""), (93, "nowhere else"), (94, "w1 w1 w1 Été")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    index = search.build_index(docs, shard_bytes=shard_bytes).cache()
    got = [tuple(r) for r in search.search(index, asked).collect()]
    assert sorted(got, key=str) == plain_search(rows, items, 20)


def test_stored_index_is_in_files_of_a_few_shards(spark, monkeypatch, tmp_path):
    """A task's whole share of the index in one file is one Parquet page and row group: 10 GB of an executor at splits of 128 MB."""
    rows = [(i, f"w{i} w{i % 7} common " * 20) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w5 w8 common"), (2, "w399")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole, seen = search.build_index, []
    monkeypatch.setattr(search, "build_index", lambda docs: whole(docs, shard_bytes=2000))
    within = search.search
    monkeypatch.setattr(search, "search", lambda index, items: seen.append(index) or within(index, items))
    got = sorted((tuple(r) for r in registry.op13_search(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_search(rows, [(1, "w5 w8 common"), (2, "w399")], 20)
    files = seen[0].groupBy(F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("docs")).collect()
    assert sum(r["docs"] for r in files) == 400 and sum(r["n"] for r in files) > 50
    assert max(r["n"] for r in files) <= 4


def test_search_without_documents_or_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(search.build_index(docs.limit(0)), items).count() == 0
    assert search.search(search.build_index(docs), items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(search.build_index(docs), items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 1200)))]


def test_candidates_are_rejected_before_their_blocks_are_unpacked():
    rare = 5000
    texts = [f"common filler{i} " + ("rare" if i % 250 == 0 else "x") for i in range(rare)] + ["rare rare common"]
    _, _, data, offsets = next(T.runs(pa.array(texts), 10**9))
    made = search.shard(data, offsets)
    part = search.Shard(made["lengths"], made["df"], made["blocks"], made["postings"], len(texts), int(made["lengths"].sum()))
    place = {t: i for i, t in enumerate(made["terms"].cast(pa.string()).to_pylist())}
    seen = []
    part.unpack, plain = (lambda b: (seen.append(int(b)), plain(b))[1]), part.unpack
    best = part.best([(place["rare"], 5000), (place["common"], 3)], 1, 1, np.arange(len(texts)))
    assert best[0][1] == rare
    common = range(part.begin[place["common"]], part.end[place["common"]])
    assert len([b for b in seen if b in common]) <= 1 < len(common)


def test_registered_queries_return_the_stated_columns(spark):
    from panelwright.llm import registry

    kinds = {
        "op11_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
        "op13_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    }
    for name, columns in kinds.items():
        assert ", ".join(f"{c} {t}" for c, t in registry.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes) == columns
    pieces = registry.QUERIES["op11_packing"](spark, "/root/testdata/sf0.001").withColumn("many", F.count("*").over(__import__("pyspark").sql.Window.partitionBy("doc_id")))
    assert pieces.where("piece >= many OR ids_crc32 < 0").count() == 0
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == spark.range(1).select(F.crc32(F.unhex(F.lit("02000000")))).first()[0]
