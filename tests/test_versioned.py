"""Snapshots, commits, crashes and file pruning of the versioned store."""

import datetime as dt
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from panelwright.operators.ingest import overlap_mismatches
from panelwright.session import shared_folder
from panelwright.sources.versioned import Conflict, Store

COLUMNS = "asset string, date date, adj_close double, volume long, fetched_at timestamp"


def bars(spark, rows):
    stamp = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(a, dt.date.fromisoformat(d), p, v, stamp) for a, d, p, v in rows], COLUMNS)


@pytest.fixture
def store(spark):
    made = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    made.declare("prices", bars(spark, []), ["asset", "date"], "date", buckets=4)
    return made


def held(snapshot, *columns):
    return sorted(map(tuple, snapshot.read().select(*(columns or ("asset", "date", "adj_close"))).collect()), key=str)


def day(text):
    return dt.date.fromisoformat(text)


def test_a_reader_keeps_its_version_while_a_writer_commits(spark, store):
    store.commit({"prices": bars(spark, [("A", "2020-01-02", 1.0, 5), ("B", "2020-01-02", 2.0, 6)])})
    old = store.snapshot("prices")
    rows = old.read()
    store.commit({"prices": bars(spark, [("A", "2020-01-02", 9.0, 5), ("C", "2021-01-04", 3.0, 7)])})
    assert {r.asset: r.adj_close for r in rows.collect()} == {"A": 1.0, "B": 2.0}
    assert held(old) == [("A", day("2020-01-02"), 1.0), ("B", day("2020-01-02"), 2.0)]
    assert held(store.snapshot("prices")) == [("A", day("2020-01-02"), 9.0), ("B", day("2020-01-02"), 2.0), ("C", day("2021-01-04"), 3.0)]
    assert held(store.snapshot("prices", old.version)) == held(old)


def test_a_batch_writes_its_own_keys_only(spark, store):
    many = [(f"A{k}", f"20{y}-03-0{d}", float(k + d), k) for k in range(30) for y in (18, 19, 20) for d in range(1, 6)]
    store.commit({"prices": bars(spark, many)})
    store.compact("prices")
    before = set(store._names("segments"))
    store.commit({"prices": bars(spark, [("A3", "2020-03-02", 0.5, 1)])})
    (new,) = set(store._names("segments")) - before
    assert sum(r.rows for r in spark.read.parquet(f"{store.segment(new)}/files").collect()) == 1
    assert len(held(store.snapshot("prices"))) == len(many)
    # Only the cell of the changed row is written again by a compaction.
    base = store.snapshot("prices").table["base"]
    store.compact("prices")
    changed = {c for c, s in store.snapshot("prices").table["base"].items() if base.get(c) != s}
    assert len(changed) == 1 and store.snapshot("prices").table["deltas"] == []
    assert ("A3", day("2020-03-02"), 0.5) in held(store.snapshot("prices"))


def test_columns_left_out_keep_their_stored_values(spark, store):
    store.commit({"prices": bars(spark, [("A", "2020-01-02", 1.0, 5)])})
    store.commit({"prices": spark.createDataFrame([("A", day("2020-01-02"), 4.0), ("B", day("2020-01-03"), 2.0)], "asset string, date date, adj_close double")})
    assert held(store.snapshot("prices"), "asset", "adj_close", "volume") == [("A", 4.0, 5), ("B", 2.0, None)]


def test_a_crash_between_files_and_manifest_changes_nothing(spark, store, monkeypatch):
    store.commit({"prices": bars(spark, [("A", "2020-01-02", 1.0, 5)])})
    version, known = store.manifest()["version"], held(store.snapshot("prices"))
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.commit({"prices": bars(spark, [("A", "2020-01-02", 8.0, 5)])})
        with pytest.raises(OSError, match="lost"):
            store.compact("prices")
    assert store.manifest()["version"] == version and held(store.snapshot("prices")) == known
    with pytest.raises(Exception, match="twice in updates"):
        store.commit({"prices": bars(spark, [("A", "2020-01-02", 8.0, 5), ("A", "2020-01-02", 9.0, 5)])})
    assert held(store.snapshot("prices")) == known
    assert store.vacuum(keep=1) >= 2
    assert held(store.snapshot("prices")) == known


def test_tables_change_together_and_writers_do_not_lose_rows(spark, store):
    store.declare("weights", spark.createDataFrame([], "run_id long, weight double"), ["run_id"])
    version = store.commit({"prices": bars(spark, [("A", "2020-01-02", 1.0, 5)]), "weights": spark.createDataFrame([(1, 0.5)], "run_id long, weight double")})
    assert {store.snapshot(t).version for t in ("prices", "weights")} == {version}
    errors = []

    def write(k):
        try:
            store.commit({"weights": spark.createDataFrame([(k, float(k))], "run_id long, weight double")})
        except Exception as problem:  # the assertion below shows it
            errors.append(problem)

    threads = [threading.Thread(target=write, args=(k,)) for k in (7, 8, 9)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and held(store.snapshot("weights"), "run_id") == [(1,), (7,), (8,), (9,)]
    with pytest.raises(Conflict):
        store._publish(store.manifest())


def test_a_replayed_batch_is_in_once(spark, store):
    rows = bars(spark, [("A", "2020-01-02", 1.0, 5)])
    first = store.commit({"prices": rows}, batch=("feed", 0))
    assert store.commit({"prices": rows}, batch=("feed", 0)) == first == store.manifest()["version"]
    assert store.batch("feed", 0) == {"id": 0, "version": first, "parent": first - 1} and store.batch("feed", 1) is None


def test_overlap_checks_open_the_newest_files_only(spark, store):
    many = [(f"A{k}", f"{y}-06-{d:02d}", float(y + d), k) for k in range(6) for y in range(2010, 2021) for d in range(1, 21)]
    store.commit({"prices": bars(spark, many)})
    store.compact("prices")
    now = store.snapshot("prices")
    marks = {r.asset: r.max_date for r in now.marks().collect()}
    assert marks == {f"A{k}": day("2020-06-20") for k in range(6)}
    since = min(marks.values()) - dt.timedelta(days=10)
    slice_ = now.read(low=since)
    assert slice_.inputFiles() and all("_period=2020" in f for f in slice_.inputFiles())
    assert 0 < len(slice_.inputFiles()) < len(now.read().inputFiles())
    fetched = bars(spark, [("A1", "2020-06-15", 1.0, 0), ("A1", "2020-06-20", 1.0, 0), ("A2", "2020-06-15", 2035.0, 0)])
    assert [(r.asset, r.date) for r in overlap_mismatches(slice_, fetched).collect()] == [("A1", day("2020-06-15"))]
    assert sorted(map(tuple, overlap_mismatches(now.read(), fetched).collect())) == sorted(map(tuple, overlap_mismatches(slice_, fetched).collect()))


def test_empty_tables_unknown_versions_and_columns(spark, store):
    assert held(store.snapshot("prices")) == [] and store.snapshot("prices").marks().count() == 0
    assert store.snapshot("prices").read(low=day("2020-01-01")).count() == 0
    assert store.compact("prices") is None
    store.commit({"prices": bars(spark, [])})
    assert held(store.snapshot("prices")) == []
    for bad in (lambda: store.snapshot("prices", 99), lambda: store.snapshot("other"), lambda: store.commit({"prices": bars(spark, []).withColumn("x", F.lit(1))}), lambda: store.commit({"prices": bars(spark, []).drop("date")})):
        with pytest.raises(ValueError):
            bad()
