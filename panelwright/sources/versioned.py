"""Panels and result tables whose every version is a snapshot.

A store is a folder of immutable segments and of manifests. A commit writes its rows as new segments, one per table,
and then a manifest that names all segments of the next version; renaming that manifest into place is the one step
that makes the commit visible, for all its tables together. A reader keeps the version it opened. A job that dies
earlier leaves segments that nothing names; ``vacuum`` deletes them. Two writers of one version can't both succeed.

A table is cut into cells, by a hash of its key and by year. An upsert writes the rows it got and nothing else (a
delta); reading puts the newest delta row of a key before the base row, and ``compact`` folds deltas into the cells
they touch. Each segment lists its files with their key and date ranges and each key's newest date, so watermarks and
overlap checks open the files they need instead of the history.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright import contracts
from panelwright.operators.layout import by_key
from panelwright.session import unite

CELL = ["_bucket", "_period"]
BUCKETS = 8
TRIES = 5


class Conflict(RuntimeError):
    """Another writer committed the version this one was made for."""


@dataclass(frozen=True)
class Prepared:
    """Segments by table that were written for a version but not published."""

    version: int
    segments: dict[str, str]
    whole: bool


@dataclass(frozen=True)
class Snapshot:
    """One table at one version."""

    store: Store
    version: int
    table: dict

    @property
    def columns(self) -> list[str]:
        return [f.split(" ", 1)[0].strip("`") for f in self.table["fields"]]

    @property
    def segments(self) -> list[str]:
        return [*dict.fromkeys(self.table["base"].values()), *self.table["deltas"]]

    def _listing(self, kind: str, segments: list[str]) -> DataFrame | None:
        spark = self.store.spark
        parts = [spark.read.parquet(f"{self.store.segment(s)}/{kind}").withColumn("segment", F.lit(s)) for s in segments]
        return unite(*parts) if parts else None

    def files(self, low=None, high=None) -> DataFrame | None:
        """Files of this version that may hold rows with ``low <= order <= high``; None for an empty table."""
        listed = self._listing("files", self.segments)
        if listed is None:
            return None
        owner = {f"{b}": s for b, s in self.table["base"].items()}
        cell = F.concat_ws("/", "_bucket", "_period")
        stale = F.lit(False)
        for s in dict.fromkeys(owner.values()):
            mine = [c for c, o in owner.items() if o == s]
            stale = stale | ((F.col("segment") == s) & ~cell.isin(mine))
        listed = listed.filter(~stale)
        if low is not None:
            listed = listed.filter(F.col("high").isNull() | (F.col("high") >= F.lit(low)))
        if high is not None:
            listed = listed.filter(F.col("low").isNull() | (F.col("low") <= F.lit(high)))
        return listed

    def marks(self) -> DataFrame:
        """``(key, max_date, max_fetched)`` from the segments' own listings; no row of the table is read."""
        key = self.table["keys"][0]
        listed = self._listing("marks", self.segments)
        if listed is None:
            return self.empty().select(key, F.lit(None).cast("date").alias("max_date"), F.lit(None).cast("timestamp").alias("max_fetched"))
        return listed.groupBy(key).agg(F.max("max_date").alias("max_date"), F.max("max_fetched").alias("max_fetched"))

    def empty(self) -> DataFrame:
        return self.store.spark.createDataFrame([], ", ".join(self.table["fields"]))

    def _part(self, segment: str, paths: list[str] | None, cells: list[str] | None) -> DataFrame:
        folder = f"{self.store.segment(segment)}/data"
        reader = self.store.spark.read.schema(", ".join([*self.table["fields"], "_bucket int", "_period int"]))
        rows = reader.option("basePath", folder).parquet(*(paths if paths is not None else [folder]))
        if cells is not None:
            rows = rows.filter(F.concat_ws("/", "_bucket", "_period").isin(cells))
        return rows.select(*self.columns)

    def read(self, low=None, high=None) -> DataFrame:
        """All rows, or those with ``low <= order <= high`` from the files that can hold them."""
        keys, order = self.table["keys"], self.table["order"]
        chosen: dict[str, list[str]] | None = None
        if low is not None or high is not None:
            listed, chosen = self.files(low, high), defaultdict(list)
            for r in listed.select("segment", "path").collect() if listed is not None else []:
                chosen[r["segment"]].append(r["path"])

        def rows(segment: str, cells: list[str] | None) -> DataFrame | None:
            if chosen is None:
                return self._part(segment, None, cells)
            return self._part(segment, chosen[segment], None) if segment in chosen else None

        owned = defaultdict(list)
        for cell, segment in self.table["base"].items():
            owned[segment].append(cell)
        base = [r for s, cells in owned.items() if (r := rows(s, cells)) is not None]
        deltas = [r.withColumn("_seq", F.lit(i)) for i, s in enumerate(self.table["deltas"]) if (r := rows(s, None)) is not None]
        out = unite(*base) if base else self.empty()
        if deltas:
            others = [c for c in self.columns if c not in keys]
            newest = by_key(unite(*deltas), *keys).groupBy(*keys).agg(F.max_by(F.struct(F.lit(1).alias("_one"), *others), "_seq").alias("_r"))
            newest = newest.select(*keys, *[F.col(f"_r.{c}") for c in others]).select(*self.columns)
            # Both sides are cut to the same files' range, and a key's order value is part of it: nothing newer is missed.
            out = unite(by_key(out, *keys).join(newest.select(*keys), keys, "left_anti").select(*self.columns), newest) if base else newest
        if low is not None:
            out = out.filter(F.col(order) >= F.lit(low))
        if high is not None:
            out = out.filter(F.col(order) <= F.lit(high))
        return out


class Store:
    """Tables under one folder that all executors share; every commit is one new version of all of them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    # --- files ----------------------------------------------------------------------------------

    def _path(self, path: str):
        return self._fs.Path(path)

    def _system(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def segment(self, name: str) -> str:
        return f"{self.root}/segments/{name}"

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def _names(self, folder: str) -> list[str]:
        system, path = self._system(), self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:12]) for n in self._names("manifests") if n.endswith(".json") and n[:12].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (the newest, if not given); an empty one before the first commit."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}, "batches": {}}
        wanted = known[-1] if version is None else version
        if wanted not in known:
            raise ValueError(f"version {wanted} is not stored; there are {known[:1]} to {known[-1:]}")
        stream = self._system().open(self._path(self._manifest_path(wanted)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        """Rename the manifest into place; exactly one writer of a version succeeds."""
        system, final = self._system(), self._path(self._manifest_path(manifest["version"]))
        staged = self._path(f"{self.root}/staged/{uuid.uuid4().hex}.json")
        out = system.create(staged, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        system.mkdirs(final.getParent())
        none = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        context = self._fs.FileContext.getFileContext(system.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(staged, final, none)
        except Py4JJavaError as problem:
            if "FileAlreadyExists" in str(problem.java_exception):
                raise Conflict(f"version {manifest['version']} was committed by another writer") from problem
            raise

    # --- commits ---------------------------------------------------------------------------------

    def declare(self, name: str, like: DataFrame, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> int:
        """Add an empty table with the columns of ``like``; ``order`` (a date) cuts it by year as well."""
        now = self.manifest()
        if name in now["tables"]:
            raise ValueError(f"table {name!r} exists")
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields]
        table = {"keys": keys, "order": order, "buckets": buckets, "fields": fields, "base": {}, "deltas": []}
        self._publish({**now, "version": now["version"] + 1, "tables": {**now["tables"], name: table}})
        return now["version"] + 1

    def snapshot(self, name: str, version: int | None = None) -> Snapshot:
        found = self.manifest(version)
        if name not in found["tables"]:
            raise ValueError(f"no table {name!r}; there are {sorted(found['tables'])}")
        return Snapshot(self, found["version"], found["tables"][name])

    def _write(self, rows: DataFrame, table: dict, unique: bool) -> str:
        """Store rows as one segment with its listings; returns its name."""
        keys, order, name = table["keys"], table["order"], uuid.uuid4().hex
        columns = [f.split(" ", 1)[0].strip("`") for f in table["fields"]]
        if not unique:
            others = [c for c in columns if c not in keys]
            once = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"), F.first(F.struct(F.lit(1).alias("_one"), *others)).alias("_r"))
            shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
            kind = rows.schema[keys[0]].dataType.simpleString()
            first = F.when(F.col("_times") > 1, contracts.fail("key occurs twice in updates: ", shown, type_=kind)).otherwise(F.col(keys[0]))
            rows = once.withColumn(keys[0], first).select(*keys, *[F.col(f"_r.{c}") for c in others]).select(*columns)
        period = F.year(order) if order else F.lit(0)
        placed = rows.select(*columns).withColumn("_bucket", F.pmod(F.xxhash64(keys[0]), F.lit(table["buckets"])).cast("int")).withColumn("_period", F.coalesce(period, F.lit(0)))
        # Rebalanced, not repartitioned: a cell of any size is split or joined to files of the size Spark aims at.
        laid = placed.hint("rebalance", *CELL).sortWithinPartitions(*CELL, *keys)
        folder = self.segment(name)
        laid.write.partitionBy(*CELL).parquet(f"{folder}/data")
        if not self._system().exists(self._path(f"{folder}/data/_SUCCESS")):
            raise RuntimeError(f"segment {name} was not committed")
        schema = ", ".join([*table["fields"], "_bucket int", "_period int"])
        data = self.spark.read.schema(schema).parquet(f"{folder}/data")
        span = order or keys[0]
        listed = data.groupBy(*CELL, F.col("_metadata.file_path").alias("path")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(keys[0]).alias("first_key"), F.max(keys[0]).alias("last_key"), F.min(span).alias("low"), F.max(span).alias("high")
        )
        listed.coalesce(1).write.parquet(f"{folder}/files")
        fetched = F.max("fetched_at") if "fetched_at" in columns else F.lit(None).cast("timestamp")
        dates = F.max(order) if order else F.lit(None).cast("date")
        data.groupBy(keys[0]).agg(dates.alias("max_date"), fetched.alias("max_fetched"), F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/marks")
        return name

    def _filled(self, rows: DataFrame, snapshot: Snapshot) -> DataFrame:
        """Columns that ``rows`` lacks, from the stored rows of the same keys."""
        keys, absent = snapshot.table["keys"], [c for c in snapshot.columns if c not in rows.columns]
        return by_key(rows, *keys).join(by_key(snapshot.read().select(*keys, *absent), *keys), keys, "left").select(*snapshot.columns)

    def prepare(self, changes: dict[str, DataFrame], unique: bool = False) -> Prepared:
        """Write rows as segments that no version names yet, to be published later, alone or with others."""
        now, written, whole = self.manifest(), {}, True
        for name, rows in changes.items():
            snapshot = self.snapshot(name, now["version"])
            if strange := [c for c in rows.columns if c not in snapshot.columns]:
                raise ValueError(f"unknown column(s) {strange} of {name!r}")
            if absent := [k for k in snapshot.table["keys"] if k not in rows.columns]:
                raise ValueError(f"{name!r} needs key column(s) {absent}")
            if len(rows.columns) < len(snapshot.columns):
                rows, whole = self._filled(rows, snapshot), False
            written[name] = self._write(rows, snapshot.table, unique)
        return Prepared(now["version"], written, whole)

    def publish(self, parts: list[Prepared], batch: tuple[str, int] | None = None) -> int:
        """Make prepared segments visible in one new version, later parts over earlier ones; returns the version."""
        for left in range(TRIES, 0, -1):
            now = self.manifest()
            if batch and (done := self.batch(*batch, manifest=now)):
                return done["version"]
            if any(not p.whole and p.version != now["version"] for p in parts):
                raise Conflict("rows filled up from an older version can't follow a newer one")
            tables = {n: {**t, "deltas": [*t["deltas"], *[p.segments[n] for p in parts if n in p.segments]]} for n, t in now["tables"].items()}
            entry = {batch[0]: {"id": batch[1], "version": now["version"] + 1, "parent": now["version"]}} if batch else {}
            try:
                self._publish({"version": now["version"] + 1, "tables": tables, "batches": {**now["batches"], **entry}})
                return now["version"] + 1
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError("unreachable")

    def commit(self, changes: dict[str, DataFrame], batch: tuple[str, int] | None = None, unique: bool = False) -> int:
        """Upsert rows into tables, all in one version; returns it.

        Rows replace stored ones of the same key; columns they lack keep the stored value. A key that occurs twice
        stops the job (``unique=True`` skips that check), unknown columns are refused. ``batch`` names a stream and
        its batch: a batch that is already in changes nothing and gives the version that has it.
        """
        if batch and (done := self.batch(*batch)):
            return done["version"]
        return self.publish([self.prepare(changes, unique)], batch)

    def batch(self, stream: str, batch_id: int, manifest: dict | None = None) -> dict | None:
        """Version and parent version of a stream's batch, if it is in."""
        found = (manifest or self.manifest())["batches"].get(stream)
        if found is None or found["id"] < batch_id:
            return None
        return found

    def compact(self, name: str, deltas: int = 1) -> int | None:
        """Fold the deltas into the cells they touch once there are so many; returns the new version, if any.

        Cells without a delta keep their segment. Readers of older versions are not disturbed.
        """
        snapshot = self.snapshot(name)
        if len(snapshot.table["deltas"]) < max(1, deltas):
            return None
        listed = snapshot._listing("files", snapshot.table["deltas"])
        cells = {f"{r[0]}/{r[1]}" for r in listed.select(*CELL).distinct().collect()}
        kept = {c: s for c, s in snapshot.table["base"].items() if c not in cells}
        touched = Snapshot(self, snapshot.version, {**snapshot.table, "base": {c: s for c, s in snapshot.table["base"].items() if c in cells}})
        segment = self._write(touched.read(), snapshot.table, unique=True)
        now = self.manifest()
        table = now["tables"][name]
        if table["base"] != snapshot.table["base"] or table["deltas"][: len(snapshot.table["deltas"])] != snapshot.table["deltas"]:
            raise Conflict(f"{name!r} was compacted by another writer")
        later = table["deltas"][len(snapshot.table["deltas"]) :]
        made = {**table, "base": {**kept, **dict.fromkeys(sorted(cells), segment)}, "deltas": later}
        self._publish({**now, "version": now["version"] + 1, "tables": {**now["tables"], name: made}})
        return now["version"] + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` versions and the segments that none of these names; returns how many.

        Run it when no commit is under way: segments not yet named look like those of a job that died.
        """
        known = self.versions()
        kept = known[-max(1, keep) :]
        named = {s for v in kept for t in self.manifest(v)["tables"].values() for s in [*t["base"].values(), *t["deltas"]]}
        system, gone = self._system(), [s for s in self._names("segments") if s not in named]
        for v in known:
            if v not in kept:
                system.delete(self._path(self._manifest_path(v)), False)
        for s in gone:
            system.delete(self._path(self.segment(s)), True)
        return len(gone)
