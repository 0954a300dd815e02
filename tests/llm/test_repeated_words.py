"""Passages of over 50 words are found also where they are shorter than 400 bytes, and none is lost."""

import collections
import random
import re

import pytest

from panelwright.llm import passages, registry

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def by_brute_force(texts, words):
    split = [BLANK.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[s : s + words]) for w in split for s in range(len(w) - words + 1))
    out = []
    for w in split:
        held = [False] * len(w)
        for s in range(len(w) - words + 1):
            if seen[tuple(w[s : s + words])] > 1:
                held[s : s + words] = [True] * words
        out.append(sum(held))
    return out


def of_texts(spark, texts, words):
    from panelwright.llm.repeats import digest

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {bytes(r.t): r.n_repeated_words for r in passages.repeated_words(frame, words=words).collect()}
    return [got.get(digest((t or "").encode()), 0) for t in texts]


@pytest.mark.parametrize("words", [4, 9, 51])
def test_repeated_words_equal_brute_force(spark, words):
    rnd = random.Random(words)
    some = lambda n: " ".join(rnd.choice(["a", "bé", "cc", "ddd"]) + rnd.choice(["", "x", "yz", "w"]) for _ in range(n))
    planted = [some(n) for n in (words - 1, words, words + 1, 2 * words + 7)]
    texts = [None, "", "a", some(words - 1), some(words), "z " * (3 * words), "p q " * (2 * words), planted[1], planted[1]]
    for _ in range(40):
        cut = rnd.choice(planted).split()
        texts.append(f"{some(rnd.randrange(2 * words))} {rnd.choice(planted)}\n\n{some(rnd.randrange(2 * words))}\t {' '.join(cut[rnd.randrange(4) :])} {some(rnd.randrange(9))}")
    assert of_texts(spark, texts, words) == by_brute_force(texts, words)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    want = by_brute_force(docs, 51)
    assert 0 < sum(n > 0 for n in want) < len(want)
    assert of_texts(spark, docs, 51) == want
    monkeypatch.setattr(passages, "_may_hold", lambda bits, keys: keys == keys)
    assert of_texts(spark, docs, 51) == want


def test_query_shows_passages_below_400_bytes(spark, tmp_path):
    rnd = random.Random(5)
    some = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, less = some(55), some(50)
    texts = [f"{some(40)}\n{passage}\n{some(70)}", f"{some(90)} {passage} {some(9)}", f"{some(30)} {less} {some(30)}", f"{less}\n{some(80)}", some(200), None]
    assert len(passage) < 400
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op9_repeats"](spark, str(tmp_path)).collect()}
    assert [got[i].n_repeated_words for i in range(6)] == [55, 55, 0, 0, 0, 0]
    assert all(got[i].n_removed == 0 and got[i].text == (texts[i] or "") for i in range(6))
