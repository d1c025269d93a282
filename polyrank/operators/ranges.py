"""Running sums over an order that no task holds as a whole.

Values are dealt into ranges by approximate quantiles. A running sum is the sum of the ranges before (a table of one row
for each range) and a running sum inside the range, so that a sort never has more than a range's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which values are dealt.
RANGES = 256


def bounds(df: DataFrame, x: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges - 1`` approximate quantiles, ascending and distinct: the only numbers that the driver sees."""
    got = df.select(F.col(x).cast("double").alias("x")).where("x is not null").approxQuantile("x", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    return sorted(set(got))


def range_of(x: str, edges: list[float]) -> Column:
    """How many of the edges are at most x: a tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(x).cast("double") < F.lit(edges[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(edges))


def running(blocks: DataFrame, x: str, columns: list[str], keys: list[str] | None = None, edges: list[float] | None = None) -> DataFrame:
    """blocks with ``before_`` + c for each of the columns: its sum over the rows of the same keys whose x is smaller.

    x is not missing; rows of equal keys and x are one (aggregate first).
    """
    keys = keys or []
    edges = bounds(blocks, x) if edges is None else edges
    dealt = blocks.withColumn("_range", range_of(x, edges))
    sums = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_in_{c}") for c in columns])
    # the ranges of a key: at most RANGES rows
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_in_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumns({f"_run_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    return run.join(offsets, [*keys, "_range"]).select(*blocks.columns, *[(F.col(f"_run_{c}") + F.col(f"_off_{c}")).alias(f"before_{c}") for c in columns])


def numbered(df: DataFrame, x: str) -> DataFrame:
    """The distinct values of x that are not missing, numbered from 0 in ascending order: (x, i). x is a number."""
    d = df.select(x).where(F.col(x).isNotNull()).distinct().withColumn("one", F.lit(1).cast("long"))
    return running(d, x, ["one"]).select(x, F.col("before_one").alias("i"))
