"""Text operators against brute force on small frames with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, license_scan, line_dedup, near_dup, repeats

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, row string, id long, k string, lines int"


def frame(spark, texts):
    """Texts with ids from 0, beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "r", 7, "k", 3) for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(rnd, n):
    return [rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi rho".split()) + str(rnd.randrange(40)) for _ in range(n)]


def groups_by_brute_force(texts, share=85):
    sets = []
    for t in texts:
        w = re.findall("[^ \t-\r]+", (t or "").translate(UPPER))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", " \t ", "one two", "One  TWO", "one two three four five", "one"]
    for size in (12, 60, 60, 150, 400):
        base = prose(rnd, size)
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(size)] = "x" + str(rnd.randrange(10**6))
            texts.append(" ".join(copy))
    # A crowd of copies of one text, each with edits of its own: linked only through that text.
    base = prose(rnd, 200)
    texts.append(" ".join(base))
    for _ in range(70):
        copy = list(base)
        for _ in range(3):
            copy[rnd.randrange(200)] = "y" + str(rnd.randrange(10**6))
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, texts), threshold=(85, 100)).collect()}
    assert got == groups_by_brute_force(texts)


def test_near_duplicates_of_repeated_rows_null_ids_and_no_rows(spark):
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, ""), (9, "")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(rows).collect())
    assert got == {(5, 5, True): 2, (None, 5, False): 1, (None, None, True): 1, (9, 9, True): 1}
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_many_rows_without_an_id_or_with_one(spark):
    base = [f"t{i} " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(150)]
    rows = spark.createDataFrame([(i if i is None else 7, t) for i in (None, 7) for t in [*base, *[b + " end" for b in base]]], "doc_id long, text string")
    signed = near_dup.signatures(rows, "doc_id", "text", 5)
    nodes = signed.groupBy("k").agg(F.min(F.struct("id", "d")).alias("one"))
    assert near_dup._fetched(rows, nodes, "doc_id", "text").count() == nodes.count() == 300
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(rows).collect())
    assert got == {(None, 7, False): 300, (7, 7, True): 300}


def repeats_by_brute_force(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = {}
    for i, d in enumerate(data):
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out[i] = (len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [20, 400])
def test_repeats_equal_brute_force(spark, length):
    rnd = random.Random(length)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(n)) for n in (length - 1, length, length + 1, 2 * length + 7)]
    texts = [None, "", "x" * (length - 1), "y" * length, "z" * (3 * length), "ab" * (2 * length), passages[1], passages[1]]
    for _ in range(40):
        parts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(2 * length))) for _ in range(3)]
        cut = rnd.choice(passages)
        texts.append(parts[0] + rnd.choice(passages) + parts[1] + cut[rnd.randrange(5) :] + parts[2])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, texts), length=length).collect()}
    assert got == repeats_by_brute_force(texts, length)


def test_repeats_of_a_given_table_equal_brute_force(spark):
    from panelwright.llm import registry

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = repeats_by_brute_force([r.text for r in docs], 400)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.QUERIES["op9_repeats"](spark, "/root/testdata/sf0.001").drop("text").collect()}
    assert got == {r.doc_id: want[i] for i, r in enumerate(docs)}
    assert 0 < sum(x[1] > 0 for x in got.values()) < len(got)


def test_repeats_across_segments_and_no_rows(spark, monkeypatch):
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdef") for _ in range(90))
    texts = ["".join(rnd.choice("abcdef") for _ in range(300)) + passage + "".join(rnd.choice("abcdef") for _ in range(211)) for _ in range(6)]
    import numpy as np

    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = [tuple(map(tuple, x)) for x in repeats.stretches(data, offsets, 40)]
    monkeypatch.setattr(repeats, "SEGMENT", 128)
    cut = list(repeats.stretches(data, offsets, 40))
    starts = lambda parts: {(r, h, s) for rows, hs, _, low, high in parts for r, h, a, b in zip(rows, hs, low, high) for s in range(a, b + 1)}
    assert starts(cut) == starts(whole)
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_line_dedup_drops_a_hosts_frequent_lines_only(spark):
    rows = [(f"a{i}", "menu\nown %d\n\nmenu " % i) for i in range(20)] + [("a0", "menu\nown 0\n\nmenu ")] * 3
    rows = [("a", t) for _, t in rows] + [("b", "menu\nlone")] + [("b", f"text {i}") for i in range(30)] + [(None, "menu"), ("a", None), ("a", "")]
    docs = spark.createDataFrame([(i, h, t, 1) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string, drop int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == len(rows)
    for i, (host, text) in enumerate(rows):
        r = got[i]
        if host == "a" and text:
            assert r.text == text.replace("menu\n", "", 1).replace("\nmenu ", "") and (r.n_lines, r.n_removed) == (4, 2)
        else:
            assert r.text == text and r.n_removed == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("total, least", [(2, 2), (4, 3), (10, 3), (50, 5)])
def test_line_dedup_on_small_hosts(spark, total, least):
    """``least`` pages with the line are enough for it to go, one less isn't."""
    rows = [(held, i, ("menu\n" if i < held else "") + f"own {i}") for held in (least - 1, least) for i in range(total)]
    docs = spark.createDataFrame([(f"h{h}", i, t) for h, i, t in rows], "source string, doc_id long, text string")
    got = {(r.source, r.doc_id): r.n_removed for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {(f"h{h}", i): int(h == least and i < least) for h, i, _ in rows}


def test_license_scan_scores_and_bounds(spark):
    notice = license_scan.TEMPLATES["mpl-2.0 header"]
    texts = ["Some prose. Released under the MIT license! More.", notice.upper(), "x\n" + notice.replace("the terms", "the same terms"), "licensed", None, "", "Released under the MIT License.\nReleased under the MIT License."]
    got = {(r.doc_id, r.license): (round(r.dice, 6), r.n_units) for r in license_scan.scan_licenses(frame(spark, texts).unionByName(frame(spark, texts))).collect()}
    n = len(set(zip((w := re.findall(r"\w+", notice.lower())), w[1:])))
    assert got[(0, "mit notice")] == (1.0, 1) and got[(6, "mit notice")] == (1.0, 2)
    assert got[(1, "mpl-2.0 header")][0] == 1.0
    assert got[(2, "mpl-2.0 header")][0] == round(2 * (n - 1) / (2 * n + 1), 6)
    assert {d for d, _ in got} == {0, 1, 2, 6}
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_license_scan_finds_wrapped_notices_in_long_texts(spark):
    rnd = random.Random(4)
    names = ["apache-2.0 header", "bsd clause", "cc0-1.0 notice", "gpl-3.0 header", "isc grant", "mit grant"]
    wrapped = lambda n, width=79: textwrap.fill(license_scan.TEMPLATES[n], width)
    around = lambda x: "A title\n\n" + x + "\n\n" + " ".join(prose(rnd, 300))
    texts = [around(wrapped(n)) for n in names]
    half = " ".join(license_scan.TEMPLATES["mit grant"].split()[:30])
    texts += [around(textwrap.fill(half, 79)), around(license_scan.TEMPLATES["apache-2.0 header"].replace(". You", ".  You")), around(wrapped("mit grant") + "\n\nand\n\n" + wrapped("mit grant", 50).replace("sublicense", "lend"))]
    got = {(r.doc_id, r.license): (r.dice, r.n_units) for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    # The first sentence of the Apache header holds the short notice in one line or over two.
    assert {k: v for k, v in got.items() if k[1] != "apache-2.0 notice"} == {(i, n): (1.0, 1) for i, n in enumerate(names)} | {(7, names[0]): (1.0, 1), (8, "mit grant"): (1.0, 2)}


def test_decontamination_follows_slots(spark):
    item = "The price of 3 apples for Anna is 12 dollars and Anna pays 12 now."
    items = spark.createDataFrame([(10, item), (11, item), (12, None), (13, "!?")], "item_id long, text string")
    texts = [
        "Before. " + item + " After.", "the PRICE of 7 apples for Bob is 15 dollars and Bob pays 15 now", "The price of 7 apples for Bob is 15 dollars and Carl pays 16 now",
        item.upper() + "!!", "The price of 3 apples", None, "", "Was it the price?", "x " * 300 + item,
    ]
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, texts), items).collect()}
    assert [i for i in range(len(texts)) if got[i].contaminated] == [0, 1, 8]
    assert got[0]["items"] == [10, 11] and got[0].share == 1.0 and got[0].row == "r"
    assert decontaminate.decontaminate(frame(spark, texts), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty(spark), items).count() == 0


def test_decontamination_finds_short_items(spark):
    short = ["What is the capital of France?", "Who wrote Hamlet?", "Tom has 3 apples and Ann has 5", "Photosynthesis"]
    items = spark.createDataFrame(list(enumerate(short)), "item_id long, text string")
    texts = [
        "Q: What is the capital of France? A: a city", "then (" + short[0] + ")", "He asked: Who wrote Hamlet? Nobody knew", "Well, Who wrote Faust? Nobody knew", "who wrote Hamlet",
        "So Tom has 3 apples and Ann has 5 of them", "Bob has 4 apples and Sue has 9 today", "So: Bob has 4 apples and Sue has 9 today", "Paris is the capital of France", "all about photosynthesis here", "What is the capital of", "Who wrote Faust?",
    ]
    got = {r.doc_id: (r["items"], r.share) for r in decontaminate.decontaminate(frame(spark, texts), items).where("contaminated").collect()}
    assert got == {0: ([0], 1.0), 1: ([0], 1.0), 2: ([1], 1.0), 4: ([1], 1.0), 5: ([2], 1.0), 6: ([2], 1.0), 7: ([2], 1.0), 9: ([3], 1.0), 11: ([1], 1.0)}


def test_decontamination_drops_only_windows_of_a_minority_value(spark):
    long = "The shop of Anna sells 30 red chairs each day and a chair costs 12 dollars so that after one week of 7 days with no rest for the staff the owner has sold all of the 210 chairs that were made by Paul in the old town and by Anna herself"
    items = spark.createDataFrame([(0, "Tom has 3 apples and Ann has 5"), (1, long), (2, "If 3 boys and 5 girls share 40 sweets and 8 more come, how many does each get?")], "item_id long, text string")
    texts = [
        "Bob has 4 apples and Sue has 4", "x. " + long.replace("by Anna", "by Hanna"), "x. " + long.replace("30", "5").replace("7", "5"), "If 6 boys and 6 girls share 60 sweets and 6 more come, how many does each get?",
        "Tom has 3 apples", long.replace("Anna", "Carl", 1).replace("Paul", "Carl").replace("by Anna", "by Carl"),
    ]
    got = {r.doc_id: r["items"] for r in decontaminate.decontaminate(frame(spark, texts), items).where("contaminated").collect()}
    assert got == {0: [0], 1: [1], 2: [1], 3: [2], 5: [1]}


def test_decontamination_finds_verbatim_items(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    wanted = {r.doc_id for r in docs.crossJoin(F.broadcast(items.select(F.lower("text").alias("item")))).where(F.contains(F.lower("text"), F.col("item"))).collect()}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).where("contaminated").collect()} == wanted


def test_decontamination_counts_windows_of_one_stretch_only(spark):
    item = "the quick runner met seven tired walkers near an old stone bridge before the market opened its wooden doors at noon"
    words = item.split()
    windows = [" ".join(words[i : i + 5]) for i in range(0, len(words) - 4)]
    filler = lambda k, n: " ".join(f"filler{k}x{j}" for j in range(n))
    scattered = " ".join(f"{w} {filler(k, 200)}" for k, w in enumerate(reversed(windows)))
    drifting = " ".join([*words[:7], "really", "very", *words[7:15], "indeed", *words[15:]])
    texts = [scattered, f"{filler(0, 300)} {item} {filler(1, 300)}", f"{filler(2, 50)} {item} {filler(3, 5000)} {item}", f"{filler(4, 9)} {drifting}", " ".join(reversed(windows))]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    judged = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, texts), items, coverage=0.3).collect()}
    share = [judged[i].share for i in range(len(texts))]
    assert share[0] <= 0.2 and share[1] == share[2] == 1.0 and share[3] >= 0.4 and share[4] < 0.8
    assert [i for i, r in judged.items() if r.contaminated and r.share >= 0.8] == [1, 2]
    clash = frame(spark, texts).withColumn("share", F.lit("own")).withColumn("contaminated", F.lit(3)).withColumn("items", F.lit(0))
    assert {r.doc_id for r in decontaminate.decontaminate(clash, items).where("contaminated").collect()} == {1, 2}
    numbers = spark.createDataFrame([(1, "1 2 3 5 8 13 21 34 55 89")], "item_id long, text string")
    table = frame(spark, [" ".join(str(3 * k + 1) for k in range(400)), "1 2 3 5 8 13 21 34 55 89"])
    assert 1 in {r.doc_id for r in decontaminate.decontaminate(table, numbers).where("contaminated").collect()}


def test_license_scan_of_many_copies_and_texts_without_key_words(spark):
    notice = license_scan.TEMPLATES["mpl-2.0 header"]
    texts = ["plain words only " * 5000, (notice + "\n") * 40, "This Source Code is form subject", None, ""]
    got = {(r.doc_id, r.license): (r.dice, r.n_units) for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert got[1, "mpl-2.0 header"][0] == 1.0 and {d for d, _ in got} == {1}


def test_repeats_show_what_is_left(spark):
    from panelwright.llm import registry

    got = registry.QUERIES["op9_repeats"](spark, "/root/testdata/sf0.001").select("doc_id", "n_kept", "kept_sha256")
    whole = repeats.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    want = {r.doc_id: (len(r.kept), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in whole.collect()}
    assert {r.doc_id: (r.n_kept, r.kept_sha256) for r in got.collect()} == want
