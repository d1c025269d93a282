"""What the training-data operators share: reading tables, written tables, Arrow batches cut by bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what no ASCII white space interrupts.
WORD = r"[^\x20\x09-\x0D]+"
#: Folders with written tables by session, for ``drop_written``.
_WRITTEN: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where the setting is unset, the context's, or in local mode one of our own.

    Raises on a cluster without a shared folder.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="polyrank-"))
    return sc.getCheckpointDir().rstrip("/")


#: Deletes the shuffle files of an execution once it has ended, so that they don't add up over an operator's steps.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For rows of megabytes that are compressed already: a writer that looks at its pages' and row groups' size after every row.
_PACKED = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def written(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """df as a table written once in the shared folder: cuts lineage, survives lost executors, computed once however often it is read.

    packed: its rows are large and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**(_PACKED if packed else {})).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    remember(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def written_apart(df: DataFrame, name: str, condition: str, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """As written, in one pass, but the rows that meet the condition and the others as two tables, each of which can be dropped."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.withColumn("_apart", F.expr(f"if({condition}, 1, 0)")).write.options(**(_PACKED if packed else {})).partitionBy("_apart").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = []
    for i in (1, 0):
        own = f"{path}/_apart={i}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)  # a side without rows is an empty table
        remember(spark, own)
        out.append(spark.read.schema(df.schema).parquet(own))
        out[-1].written_to = own
    return out[0], out[1]


def remember(spark: SparkSession, path: str) -> None:
    """List a folder of the session's results for ``drop_written``."""
    _WRITTEN.append((spark, path))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(spark: SparkSession) -> None:
    """Delete the tables written for this session's results; call it once the results have been stored."""
    for s, path in [x for x in _WRITTEN if x[0] is spark]:
        delete(spark, path)
        _WRITTEN.remove((s, path))


#: Most keys that ``hot_keys`` gives: a key is hot if it has more than this part of all rows.
HOT_KEYS = 10_000


def hot_keys(counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The keys that hold more than 1 / HOT_KEYS of all that is counted; counts has a row for each key. There are fewer than HOT_KEYS, so they may be broadcast."""
    total = counts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    return counts.where(F.col(count) * HOT_KEYS > F.lit(total)).select(*keys)


def join_apart(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key, by ``how`` (inner or left): rows of hot keys stay where they are and meet right's few rows by broadcast, the others are shuffled by key."""
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))  # fewer than HOT_KEYS rows
    own = left.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how)
    return own.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """On leaving, the tables written inside are deleted, but for those handed to the function that this gives: what stays lazy must not need the others."""
    before, kept = {path for _, path in _WRITTEN}, set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.written_to)
        return table

    try:
        yield keep
    finally:
        for spark, path in [x for x in _WRITTEN if x[1] not in before | kept]:
            delete(spark, path)
            _WRITTEN.remove((spark, path))


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.written_to)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != df.written_to]


def pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def unpack(b: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype) if n else np.empty(0, dtype)


_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full((1 << bits) - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse, modulo 2**64: hashes of slices are differences of prefix sums."""
    return _powers(max(10, (n - 1).bit_length()))


#: Bytes of text that a task of a grouped step takes, if the session's number of partitions would give it more.
PART_BYTES = 256 << 20


def dealt_by(df: DataFrame, key: str, text_bytes: int) -> DataFrame:
    """df shuffled by key into as many partitions as its texts need, where the session's own number is smaller; grouping by key shuffles nothing further."""
    n = -(-text_bytes // PART_BYTES)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def n_rows_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, from one pass over that column."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(r["n"]), int(r["b"])


def byte_chunks(batches: Iterable[pa.RecordBatch], text: int, limit: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces of at most ``rows`` rows and about ``limit`` bytes in the column number ``text`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, b in enumerate(sizes.tolist()):
            if i > start and (total + b > limit or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += b
        yield batch.slice(start)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
