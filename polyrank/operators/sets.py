"""Set operations over keys, and overlap audits between two cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import place


def union_tagged(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows with their source's name; columns that a source lacks are null."""
    out = None
    for name, df in frames.items():
        d = df.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one table only, with the side they are on."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("side", F.lit("missing_right")).unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("missing_left")))


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_no", place(keys, *order)).where("_no = 1").drop("_no")


def levels_long(df: DataFrame, key: str, levels: dict) -> DataFrame:
    """(level, value, key): each row's identity at each level; missing identities never match. Long identities are best given as digests."""
    rows = F.array(*[F.struct(F.lit(n).alias("level"), c.cast("string").alias("value")) for n, c in levels.items()])
    return df.select(F.col(key).cast("string").alias("key"), F.explode(rows).alias("x")).select("key", "x.level", "x.value").where("value is not null")


def overlap_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, value, side, id, n_a, n_b): a row for each id, on side a or b, of an identity that occurs on both sides of two ``levels_long`` tables.

    Every id is listed, and no row grows with its identity's group; n_a and n_b are the group's ids on each side.
    """
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))).distinct()
    n = both.groupBy("level", "value").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b")).where("n_a > 0 and n_b > 0")
    return both.join(n, ["level", "value"]).select("level", "value", "side", F.col("key").alias("id"), "n_a", "n_b")


def overlap_counts(a: DataFrame, b: DataFrame, levels: list[str]) -> DataFrame:
    """(level, overlaps): how many identities both sides share at each level, 0 too."""
    names = a.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    n = a.select("level", "value").distinct().join(b.select("level", "value").distinct(), ["level", "value"]).groupBy("level").agg(F.count(F.lit(1)).alias("overlaps"))
    return names.join(n, "level", "left").select("level", F.coalesce("overlaps", F.lit(0).cast("long")).alias("overlaps"))


def overlap_gate(counts: DataFrame, strict: list[str]) -> DataFrame:
    """One row: overlaps at the strict levels, and whether there are none."""
    n = F.coalesce(F.sum(F.when(F.col("level").isin(*strict), F.col("overlaps"))), F.lit(0))
    return counts.agg(n.alias("strict_overlaps"), (n == 0).alias("passed"))


def without_overlaps(df: DataFrame, key: str, audit_side: DataFrame) -> DataFrame:
    """df without the rows whose identity at any level stands on the other side: audit_side has their keys."""
    return df.join(audit_side.select(F.col("key").alias("_k")).distinct(), F.col(key).cast("string") == F.col("_k"), "left_anti")
