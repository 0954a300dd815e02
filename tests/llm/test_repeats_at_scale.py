"""Periodic texts are no hot task, and the kept text shows what was cut."""

import numpy as np

from panelwright.llm import registry, repeats

SPLIT = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.files.maxPartitionBytes": "16k",
    "spark.sql.files.openCostInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


def _words(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(n))


def test_rows_of_one_short_string_are_split_over_tasks(spark, monkeypatch):
    plans, store = [], repeats.durable

    def watched(df):
        if "mixed" in df.columns and "t" in df.columns:
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(repeats, "durable", watched)
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    texts = ["ab" * 3000 + chr(65 + i) for i in range(12)] + [_words(i, 200) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    try:
        for k, v in SPLIT.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plans and "skew=true" in plans[0]
    assert got == {i: 6000 if i < 12 else 0 for i in range(24)}


def test_kept_text_lacks_planted_passages_and_clean_texts_stay(spark, tmp_path):
    passage = _words(99, 60)
    texts = [f"{_words(1, 80)} {passage}1{_words(2, 80)}", f"{passage}2{_words(3, 80)}", _words(4, 200), "kurz und schön", "", None, passage[:390]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op9_repeats"](spark, str(tmp_path)).collect()}
    assert passage not in got[0].text and passage not in got[1].text
    assert got[0].text.startswith(_words(1, 80)) and got[1].text.endswith(_words(3, 80))
    assert [got[i].text for i in range(2, 7)] == [t or "" for t in texts[2:]]
    assert all(got[i].n_removed == 0 for i in range(2, 7))


def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path):
    long, short = (" ".join(w[:6] for w in _words(k, 60).split())[:n] for k, n in ((7, 400), (8, 399)))
    assert len(long.split()) > 50 and len(short.split()) > 50
    texts = [f"{_words(i, 60)}{i}{passage}{9 - i}{_words(10 + i, 60)}" for i, passage in enumerate([long, long, short, short])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op9_repeats"](spark, str(tmp_path)).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(4)] == [(400, 1), (400, 1), (0, 0), (0, 0)]
    assert [got[i].text for i in range(4)] == [texts[0].replace(long, ""), texts[1].replace(long, ""), *texts[2:]]
