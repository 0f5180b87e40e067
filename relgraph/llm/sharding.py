"""Sharded tables with size-tiered compaction and versioned manifests.

Arrivals become small immutable Parquet shards. A manifest, one JSON file a
version, lists the shards of a table; committing renames a finished file to the
next version's name, which fails if that version exists, so readers see whole
versions and one of two writers tries again. Compaction takes tiers of similarly
sized shards (a tier spans a factor of ``fanin``), and merges runs of at least
``fanin`` of them into files of about ``target`` bytes. Merged files replace
their sources in a new version; ``expire`` deletes what no kept version lists,
``sweep`` what a writer left that died before its commit.

Rows never change and never meet: merging reads and writes files, without a
shuffle. Files go through Hadoop's file systems, in the shared folder.

Defined cases: an empty arrival commits a version without new shards; nulls,
repeated rows and any columns pass through; an arrival with other columns adds them
to the table's, and rows without a column have null there; a column that comes with
another type is refused; a shard of target size or more is never merged again;
reading a table without versions is an error.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET, FANIN = 128 << 20, 4


class Conflict(Exception):
    """Another writer committed the version first."""


class Lost(Exception):
    """Another compaction merged some of the same shards."""


class ShardedTable:
    def __init__(self, spark: SparkSession, path: str, *, target: int = TARGET, fanin: int = FANIN):
        self.spark, self.path, self.target, self.fanin = spark, path.rstrip("/"), target, fanin
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # manifests

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "schema": None, "shards": []}
            version = known[-1]
        stream = self._fs.open(self._path(f"manifest/v{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], schema: str, what: str) -> dict:
        new = {"version": base["version"] + 1, "what": what, "schema": schema, "shards": shards}
        draft, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{new['version']:010d}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(new).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)  # without OVERWRITE it fails if the version exists
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(final.toString()) from e
            raise
        return new

    def _update(self, change, schema: str | None, what: str, tries: int = 20) -> dict:
        for _ in range(tries):
            base = self.manifest()
            try:
                return self._commit(base, change(base["shards"]), self._widened(base["schema"], schema), what)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries")

    def _widened(self, old: str | None, new: str | None) -> str:
        """The columns of both schemas, in the order in which they came."""
        if not (old and new) or old == new:
            return new or old
        exact = self.spark.conf.get("spark.sql.caseSensitive") == "true"
        fields = {f.name if exact else f.name.lower(): f for f in T.StructType.fromJson(json.loads(old))}
        for f in T.StructType.fromJson(json.loads(new)):
            own = fields.setdefault(f.name if exact else f.name.lower(), T.StructField(f.name, f.dataType))
            if own.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {own.dataType.simpleString()}, not {f.dataType.simpleString()}")
        return T.StructType(list(fields.values())).json()

    # shards

    def _written(self, folder: str) -> list[dict]:
        """The data files of a folder, with bytes and rows. Row counts come from footers."""
        files = [(f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(self._path(folder)) if f.getPath().getName().endswith(".parquet")]
        if not files:
            return []
        counts = {r.name: r.n for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).agg(F.count("*").alias("n")).collect()}
        shards = [{"file": f"{folder}/{name}", "bytes": size, "rows": counts.get(name, 0)} for name, size in sorted(files)]
        return [s for s in shards if s["rows"]]

    def stage(self, df: DataFrame, by: str) -> list[list[dict]]:
        """Write df in one pass as one arrival for each value of column by; nothing is committed."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(by).parquet(f"{self.path}/{folder}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(folder)) if f.isDirectory()]
        return [self._written(f"{folder}/{name}") for name in sorted(found)]

    def append(self, df: DataFrame) -> dict:
        """Add df as new shards, one for each of its partitions."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self.commit_arrival(self._written(folder), df.schema)

    def commit_arrival(self, shards: list[dict], schema: T.StructType) -> dict:
        return self._update(lambda old: [*old, *shards], schema.json(), "append")

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: tiers with at least fanin shards under the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target:
                tiers.setdefault(int(math.log(max(s["bytes"], 1), self.fanin)), []).append(s)
        return [sorted(t, key=lambda s: (s["bytes"], s["file"])) for _, t in sorted(tiers.items()) if len(t) >= self.fanin]

    def compact(self) -> dict:
        """Merge until no tier is full. Every merge is one version."""
        while True:
            now = self.manifest()
            runs = self.plan(now["shards"])
            if not runs:
                return now
            schema = T.StructType.fromJson(json.loads(now["schema"]))
            merged, gone, folders = [], set(), []
            for run in runs:
                folder = f"data/{uuid.uuid4().hex}"
                files = max(1, round(sum(s["bytes"] for s in run) / self.target))
                df = self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['file']}" for s in run])
                folders.append(folder)
                df.coalesce(files).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
                got = self._written(folder)
                if sum(s["rows"] for s in got) != sum(s["rows"] for s in run):
                    raise RuntimeError(f"rows were lost in merging {folder}")
                merged += got
                gone |= {s["file"] for s in run}

            def change(old, merged=merged, gone=gone):
                if not gone <= {s["file"] for s in old}:
                    raise Lost("another compaction took these shards")
                return [*(s for s in old if s["file"] not in gone), *merged]

            try:
                self._update(change, None, "compact")
            except Lost:  # no version lists what was merged; what is left is planned anew
                for folder in folders:
                    self._fs.delete(self._path(folder), True)
                continue
            if len(merged) >= len(gone):
                return self.manifest()

    def expire(self, keep: int = 1, age: float = 0.0) -> int:
        """Drop all but the last versions, and shards that none of those lists. Files deleted.

        A version whose successor is younger than ``age`` seconds stays too: a reader may have opened it just before.
        """
        known = self.versions()
        if age > 0:
            when = {v: self._fs.getFileStatus(self._path(f"manifest/v{v:010d}.json")).getModificationTime() / 1000 for v in known}
            keep = max(keep, sum(time.time() - when[v] < age for v in known) + 1)
        kept = known[-keep:]
        live = {s["file"] for v in kept for s in self.manifest(v)["shards"]}
        gone = [v for v in known if v not in kept]
        dead = {s["file"] for v in gone for s in self.manifest(v)["shards"]} - live
        for f in dead:
            self._fs.delete(self._path(f), False)
        for v in gone:
            self._fs.delete(self._path(f"manifest/v{v:010d}.json"), False)
        return len(dead)

    def sweep(self, age: float = 86_400.0) -> int:
        """Delete data files and drafts that no version lists and that are older than ``age`` seconds. Files deleted.

        ``age`` has to exceed the time from a writer's first file to its commit.
        """
        now, found, drafts = time.time(), [], []
        if self._fs.exists(self._path("data")):
            files = self._fs.listFiles(self._path("data"), True)
            while files.hasNext():
                f = files.next()
                if now - f.getModificationTime() / 1000 > age:
                    found.append(f.getPath())
        if self._fs.exists(self._path("manifest")):
            for f in self._fs.listStatus(self._path("manifest")):
                if f.getPath().getName().startswith(".") and now - f.getModificationTime() / 1000 > age:
                    drafts.append(f.getPath())
        # versions are read after the files: what was committed in between is alive
        live = {self._fs.makeQualified(self._path(s["file"])).toString() for v in self.versions() for s in self.manifest(v)["shards"]}
        dead = [f for f in found if f.toString() not in live] + drafts
        for f in dead:
            self._fs.delete(f, False)
        return len(dead)

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        if not now["version"]:
            raise ValueError(f"{self.path} has no versions")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        if not now["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['file']}" for s in now["shards"]])


def ingest(df: DataFrame, path: str, arrivals, *, target: int = TARGET, fanin: int = FANIN) -> ShardedTable:
    """A table of df that came in several arrivals: arrivals is a column with their numbers.

    df is read once; every arrival is a version; the table is compacted after
    each fanin arrivals and at the end, and versions before the last are expired:
    nobody reads the table before it is returned.
    """
    table = ShardedTable(df.sparkSession, path, target=target, fanin=fanin)
    name = f"arrival_{uuid.uuid4().hex}"
    staged = table.stage(df.withColumn(name, arrivals), name)
    table._update(lambda old: old, df.schema.json(), "create")
    for k, shards in enumerate(staged, 1):
        table.commit_arrival(shards, df.schema)
        if k % fanin == 0 or k == len(staged):
            table.compact()
            table.expire()
    return table
