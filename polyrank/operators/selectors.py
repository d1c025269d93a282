"""Selectors: one candidate for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import best_first, place, z_within
from ..roles import ACCEPTABLE


def top1(df: DataFrame, score: str, group: str, ties: list[str], descending: bool = True) -> DataFrame:
    """The best row of each group; missing scores come last, ties go to the smallest tie columns."""
    return df.withColumn("_no", place(group, *best_first(score, ties, descending))).where("_no = 1").drop("_no")


def top1_or_rank1(df: DataFrame, score: str, group: str, rank: str, ties: list[str], descending: bool = True) -> DataFrame:
    """As top1; a group without any score gets its rank-1 row."""
    order = best_first(score, [], descending)
    return df.withColumn("_no", place(group, *order, F.when(F.col(score).isNull(), F.col(rank)).asc_nulls_last(), *[F.col(t) for t in ties])).where("_no = 1").drop("_no")


def rank1(df: DataFrame, rank: str = "rank") -> DataFrame:
    return df.where(F.col(rank) == 1)


def oracle(df: DataFrame, truth: str, group: str, rank: str, ties: list[str], threshold: float | None = ACCEPTABLE) -> DataFrame:
    """The best row by truth; with a threshold, groups where nothing reaches it get their rank-1 row."""
    order = [F.col(truth).desc_nulls_last(), *[F.col(t) for t in ties]]
    if threshold is not None:
        hopeless = F.coalesce(F.col("_best"), F.lit(-1.0)) < threshold
        order = [F.when(hopeless, F.col(rank)).asc_nulls_last(), *order]
    d = df.withColumn("_best", F.max(truth).over(_w(group)))
    return d.withColumn("_no", place(group, *order)).where("_no = 1").drop("_no", "_best")


def _w(group: str):
    from pyspark.sql import Window

    return Window.partitionBy(group)


def gated(df: DataFrame, gate: str, below: float, feature: str, group: str, rank: str, ties: list[str]) -> DataFrame:
    """rank-1, but the best by the feature in groups whose (constant) gate attribute is below the limit."""
    use = F.col(gate) < below
    score = F.when(use, F.col(feature)).otherwise(-F.col(rank).cast("double"))
    return top1(df.withColumn("_score", score), "_score", group, ties).drop("_score")


def battery(df: DataFrame, scores: dict[str, str], truth: str, group: str, rank: str, ties: list[str]) -> DataFrame:
    """The picks of many selectors, one under another, with the selector's name: each score, rank-1 and the oracle.

    All come from one aggregate by group: the greatest of a score and the smallest ties is a minimum over structs.
    """
    row = F.struct(*df.columns).alias("row")
    orders = {n: F.struct(F.col(s).isNull(), -F.col(s), *ties) for n, s in {**scores, "oracle": truth}.items()}
    first = {n: F.min_by(row, o) for n, o in orders.items()} | {"rank1": F.min_by(row, F.when(F.col(rank) == 1, F.struct(F.lit(0), *ties)))}
    picks = df.groupBy(F.col(group).alias("_g")).agg(*[c.alias(n) for n, c in first.items()])
    long = picks.select(F.explode(F.array(*[F.struct(F.lit(n).alias("selector"), F.col(n).alias("row")) for n in first])).alias("x"))
    return long.where("x.row is not null").select("x.row.*", "x.selector")


def combo(df: DataFrame, columns: list[str], group: str, ties: list[str]) -> DataFrame:
    """The best by the sum of z-scores within the group."""
    d = df.withColumns({f"_z{i}": z_within(c, group) for i, c in enumerate(columns)})
    names = [f"_z{i}" for i in range(len(columns))]
    # rounded, so that sums that differ in the last bit tie
    total = F.round(sum((F.col(n) for n in names[1:]), F.col(names[0])), 9)
    return top1(d.withColumn("combo", total), "combo", group, ties).drop(*names)


def from_cluster(df: DataFrame, cluster: str, mode: str, attribute: str, score: str, group: str, rank: str, ties: list[str]) -> DataFrame:
    """The best by score inside one cluster of each group; rank-1 where there is no such cluster. Cluster -1 is noise.

    mode: 'second' (second most members), 'minority' (highest mean attribute among clusters of under half of the
    members), 'best' (highest mean attribute).
    """
    w = _w(group)
    c = df.where(F.col(cluster) != -1).groupBy(group, cluster).agg(F.count(F.lit(1)).alias("_size"), F.round(F.avg(attribute), 9).alias("_mean"))
    c = c.join(df.groupBy(group).agg(F.count(F.lit(1)).alias("_all")), group)
    if mode == "second":
        c = c.withColumn("_no", place(group, F.col("_size").desc(), F.col(cluster))).where("_no = 2")
    elif mode == "minority":
        c = c.where("_size * 2 < _all").withColumn("_no", place(group, F.col("_mean").desc_nulls_last(), F.col(cluster))).where("_no = 1")
    elif mode == "best":
        c = c.withColumn("_no", place(group, F.col("_mean").desc_nulls_last(), F.col(cluster))).where("_no = 1")
    else:
        raise ValueError(f"unknown mode {mode}")
    d = df.join(c.select(group, F.col(cluster).alias("_want")), group, "left")
    has = F.max(F.col("_want").isNotNull()).over(w)
    use = F.when(has, F.when(F.col(cluster) == F.col("_want"), F.col(score))).otherwise(-F.col(rank).cast("double"))
    inside = F.when(has, (F.col(cluster) == F.col("_want")).cast("int")).otherwise(1)
    order = [inside.desc(), use.desc_nulls_last(), *[F.col(t) for t in ties]]
    return d.withColumn("_no", place(group, *order)).where("_no = 1").drop("_no", "_want")


def flags(df: DataFrame, score: str, group: str, rank: str, ties: list[str]) -> DataFrame:
    """selected_by_model and selected_by_reference: one true each for each group, from a window and no join."""
    m = place(group, *best_first(score, ties))
    r = place(group, F.col(rank).asc_nulls_last(), *[F.col(t) for t in ties])
    return df.withColumns({"selected_by_model": m == 1, "selected_by_reference": r == 1})


def paired(a: DataFrame, b: DataFrame, truth: str, group: str) -> DataFrame:
    """Both selectors' truth for each group, with presence flags; full outer, so that a missing group shows."""
    x, y = a.select(group, F.col(truth).alias("a_truth"), F.lit(True).alias("in_a")), b.select(group, F.col(truth).alias("b_truth"), F.lit(True).alias("in_b"))
    return x.join(y, group, "full").select(group, "a_truth", "b_truth", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
