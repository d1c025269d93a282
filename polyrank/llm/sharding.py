"""Sharding by size-tiered compaction, with DataFrame reads and writes only.

A store is a folder with immutable Parquet shards and a list of manifests, one for each version. Every arrival is
appended as a run of small shards, in a folder that has the run's number in its name, so that a row's run and shard
can be read off its file's path. Once FANOUT runs are of similar size (the same power of FANOUT), they are merged
into one run of target-sized files: shards are read and written in larger groups, without a shuffle. A version
comes to be by renaming a finished manifest to its number, which fails if another writer has taken that number;
readers see whole versions only, and a job that fails leaves no trace but files that no manifest names.

A column that an arrival adds is part of the manifest's schema from then on and null in earlier rows; one that it lacks
is null in its rows. A column whose type differs from the manifest's is refused.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, documents, remember, shared_dir

TARGET_BYTES = 128 << 20
FANOUT = 4
#: The query deals a table of b bytes into sqrt(b / UNIT) arrivals, FANOUT at least, so that merges grow with the table.
UNIT = 1 << 20
#: Versions that the query keeps readable while it compacts.
KEEP = 2
#: The folder and the file that a row lies in, as (run, shard).
_PLACE = r"/run-(\d+)-[0-9a-f]+/part-(\d+)-[^/]*$"


@dataclass
class Run:
    number: int
    shards: list[tuple[str, int]]  # path below the store, bytes

    @property
    def size(self) -> int:
        return sum(b for _, b in self.shards)


@dataclass
class Manifest:
    version: int = 0
    schema: str | None = None
    next_run: int = 0
    runs: list[Run] = field(default_factory=list)


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, below: str):
        return self.hadoop.Path(f"{self.path}/{below}" if below else self.path)

    # manifests

    def versions(self) -> list[int]:
        place = self._path("manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, the last by default; an empty one before the first commit."""
        known = self.versions()
        if version is None and not known:
            return Manifest()
        version = known[-1] if version is None else version
        stream = self.fs.open(self._path(f"manifests/v{version:010d}.json"))
        try:
            got = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(got["version"], got["schema"], got["next_run"], [Run(r["number"], [tuple(s) for s in r["shards"]]) for r in got["runs"]])

    def commit(self, m: Manifest) -> Manifest:
        """Make m the version after its own; raises if that version exists."""
        m = Manifest(m.version + 1, m.schema, m.next_run, m.runs)
        draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        qualified = lambda p: self.fs.makeQualified(p)
        context.rename(qualified(draft), qualified(self._path(f"manifests/v{m.version:010d}.json")), none)
        return m

    # shards

    def _write(self, df: DataFrame, run: int) -> list[tuple[str, int]]:
        folder = f"data/run-{run:010d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        found = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]
        return [(f"{folder}/{n}", b) for n, b in sorted(found)]

    def read(self, version: int | None = None, m: Manifest | None = None) -> DataFrame:
        """The rows of a version. A store without any has no schema to read by."""
        m = m or self.manifest(version)
        if m.schema is None:
            raise ValueError("nothing has been appended yet")
        return self._frame(m, m.runs)

    def _frame(self, m: Manifest, runs: list[Run]) -> DataFrame:
        schema, paths = _schema(m.schema), [p for r in runs for p, _ in r.shards]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def append(self, df: DataFrame) -> Manifest:
        """One arrival: a run with a small shard for each of its tasks."""
        m = self.manifest()
        schema = evolved(_schema(m.schema), df.schema).json() if m.schema else df.schema.json()
        return self.commit(Manifest(m.version, schema, m.next_run + 1, [*m.runs, Run(m.next_run, self._write(df, m.next_run))]))

    def tier(self, size: int) -> int:
        return int(math.log(max(1, size), self.fanout))

    def compact(self) -> Manifest:
        """Merge runs of one tier, as long as some tier has ``fanout`` of them; a commit for each merge."""
        while True:
            m = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in m.runs:
                tiers.setdefault(self.tier(r.size), []).append(r)
            full = [runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fanout]
            if not full:
                return m
            merged = full[0]
            shards = self._write(self._frame(m, merged).coalesce(max(1, round(sum(r.size for r in merged) / self.target))), m.next_run)
            gone = {r.number for r in merged}
            self.commit(Manifest(m.version, m.schema, m.next_run + 1, [*(r for r in m.runs if r.number not in gone), Run(m.next_run, shards)]))

    def vacuum(self, keep: int = 1) -> None:
        """Delete shards and manifests that the last ``keep`` versions don't need. Readers of older ones, and writers, must be done."""
        known = self.versions()
        kept = known[-keep:]
        needed = {p.rsplit("/", 1)[0] for v in kept for r in self.manifest(v).runs for p, _ in r.shards}
        data = self._path("data")
        for s in self.fs.listStatus(data) if self.fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in needed:
                self.fs.delete(s.getPath(), True)
        for v in known[:-keep]:
            self.fs.delete(self._path(f"manifests/v{v:010d}.json"), False)

    def placed(self, version: int | None = None) -> DataFrame:
        """The rows of a version with _run and _shard (its number within the run), read off each row's file: nothing is joined."""
        df = self.read(version)
        if not any(r.shards for r in self.manifest(version).runs):
            return df.withColumns({"_run": F.lit(None).cast("int"), "_shard": F.lit(None).cast("int")})
        part = lambda i: F.regexp_extract(F.col("_metadata.file_path"), _PLACE, i).cast("int")
        return df.withColumns({"_run": part(1), "_shard": part(2)})


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def evolved(old, new):
    """old with the columns that only new has at its end, all of them nullable; raises if a type differs."""
    from pyspark.sql.types import StructField, StructType

    known = {f.name: f.dataType.simpleString() for f in old}
    changed = [f.name for f in new if known.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString()]
    if changed:
        raise ValueError("types differ from the store's: " + ", ".join(changed))
    return StructType([StructField(f.name, f.dataType) for f in [*old, *(f for f in new if f.name not in known)]])


def arrivals(docs: DataFrame, landing: str) -> Iterator[DataFrame]:
    """docs in sqrt(bytes / UNIT) arrivals, FANOUT at least: its files in order of name, or if they are fewer its rows, dealt in turn into folders below ``landing``."""
    spark, files = docs.sparkSession, sorted(docs.inputFiles())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    size = sum((p := path(f)).getFileSystem(conf).getFileStatus(p).getLen() for f in files)
    n = max(FANOUT, round(math.sqrt(size / UNIT)))
    if len(files) >= n:
        groups = [files[i * len(files) // n : (i + 1) * len(files) // n] for i in range(n)]
    else:
        name = "_arrival_" + uuid.uuid4().hex
        docs.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(n))).write.partitionBy(name).parquet(landing)
        groups = [[f"{landing}/{name}={i}"] for i in range(n)]
        fs = path(landing).getFileSystem(conf)
        groups = [g for g in groups if fs.exists(path(g[0]))] or [[]]
    for g in groups:
        yield spark.read.schema(docs.schema).parquet(*g) if g else spark.createDataFrame([], docs.schema)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the documents as arrivals, compact after each, and return every row with the run and shard it has come to lie in.

    Rows are stored as they are, nulls and repeats too; an empty table makes one run without rows.
    """
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    store = ShardStore(spark, folder)
    for arrival in arrivals(documents(spark, sf_dir), f"{folder}-landing"):
        store.append(arrival)
        store.compact()
        store.vacuum(KEEP)
    delete(spark, f"{folder}-landing")
    remember(spark, folder)
    return store.placed().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("text_sha256"), F.col("_run").alias("run"), F.col("_shard").alias("shard"))
