"""Pairs of candidates of a group, set similarity, and what is derived from them.

A candidate's set is an array column (bounded by the candidate itself), so that pairs need one shuffle by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import place


def within_groups(df: DataFrame, group: str, key: str, carry: list[str]) -> DataFrame:
    """Unordered pairs a < b of each group's members, with a_ and b_ of the carried columns."""
    left = df.select(group, *[F.col(c).alias(f"a_{c}") for c in [key, *carry]])
    right = df.select(group, *[F.col(c).alias(f"b_{c}") for c in [key, *carry]])
    return left.join(right, group).where(F.col(f"a_{key}") < F.col(f"b_{key}"))


def jaccard(a: Column, b: Column) -> Column:
    """Null if either is empty: nothing can be said of it."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both))


def empty_reason(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), "both_empty").when(F.size(a) == 0, "first_empty").when(F.size(b) == 0, "second_empty").otherwise("")


def pair_similarity(df: DataFrame, group: str, key: str, sets: str, carry: list[str]) -> DataFrame:
    """Pairs with the Jaccard index of their sets of (ra, rb), of each side's projection, and the mean of the two."""
    side = lambda f: F.array_distinct(F.transform(F.col(sets), lambda c: c[f]))
    p = within_groups(df.withColumns({"_ra": side("ra"), "_rb": side("rb")}), group, key, [*carry, sets, "_ra", "_rb"])
    a, b = F.col(f"a_{sets}"), F.col(f"b_{sets}")
    ja, jb = jaccard(F.col("a__ra"), F.col("b__ra")), jaccard(F.col("a__rb"), F.col("b__rb"))
    p = p.withColumns({"n_a": F.size(a).cast("long"), "n_b": F.size(b).cast("long"), "n_both": F.size(F.array_intersect(a, b)).cast("long"), "jaccard": jaccard(a, b), "jaccard_side_a": ja, "jaccard_side_b": jb, "jaccard_sides": (ja + jb) / 2, "reason": empty_reason(a, b)})
    return p.withColumn("valid", F.col("jaccard").isNotNull()).drop(f"a_{sets}", f"b_{sets}", "a__ra", "b__ra", "a__rb", "b__rb")


def directed(pairs: DataFrame, group: str, key: str, carry: list[str], symmetric: list[str]) -> DataFrame:
    """Each pair from both ends: self_* and other_*."""
    one = pairs.select(group, *[F.col(f"a_{c}").alias(f"self_{c}") for c in [key, *carry]], *[F.col(f"b_{c}").alias(f"other_{c}") for c in [key, *carry]], *symmetric)
    two = pairs.select(group, *[F.col(f"b_{c}").alias(f"self_{c}") for c in [key, *carry]], *[F.col(f"a_{c}").alias(f"other_{c}") for c in [key, *carry]], *symmetric)
    return one.unionByName(two)


def pair_features(pairs: DataFrame, group: str, key: str, score: str, seed: str, weight: str, means: dict[str, str] | None = None, second: str | None = None) -> DataFrame:
    """Features of each candidate from its pairs, in one aggregate.

    Similarity to all (mean, median, highest, mean of the three highest), to the same weight across seeds, to the same
    seed across weights, to other weights; valid pairs and their share; the similarity-weighted mean of the others'
    score (and of a second one); and the mean of further symmetric columns, null where a pair has none: means maps a
    feature's name to a column.
    """
    means = means or {}
    scores = [score, *([second] if second else [])]
    d = directed(pairs, group, key, [*scores, seed, weight], ["jaccard", *[c for c in dict.fromkeys(means.values()) if c != "jaccard"]])
    j = F.col("jaccard")
    same_w, same_s = F.col(f"self_{weight}") == F.col(f"other_{weight}"), F.col(f"self_{seed}") == F.col(f"other_{seed}")
    top = F.slice(F.sort_array(F.collect_list(j), asc=False), 1, 3)
    weighted = lambda s: F.try_divide(F.sum(j * F.col(f"other_{s}")), F.sum(j))
    return d.groupBy(group, F.col(f"self_{key}").alias(key)).agg(
        F.avg("jaccard").alias("mean_j"),
        F.median("jaccard").alias("median_j"),
        F.try_divide(F.aggregate(top, F.lit(0.0), lambda a, x: a + x), F.nullif(F.size(top), F.lit(0))).alias("top3_j"),
        F.avg(F.when(same_w & ~same_s, j)).alias("mean_j_across_seeds"),
        F.avg(F.when(same_s & ~same_w, j)).alias("mean_j_across_weights"),
        F.avg(F.when(~same_w, j)).alias("mean_j_other_weights"),
        F.max("jaccard").alias("max_j"),
        F.avg(j.isNotNull().cast("double")).alias("valid_share"),
        F.count("jaccard").alias("valid_pairs"),
        weighted(score).alias("weighted_score"),
        *([weighted(second).alias("weighted_second")] if second else []),
        *[F.avg(c).alias(n) for n, c in means.items()],
        F.count(F.lit(1)).alias("pairs"),
    )


def decomposition(pairs: DataFrame, group: str, seed: str, weight: str) -> DataFrame:
    """Per group: mean similarity over valid pairs, of one weight across seeds, of one seed across weights, with their numbers."""
    j = F.col("jaccard")
    seeds = (F.col(f"a_{weight}") == F.col(f"b_{weight}")) & (F.col(f"a_{seed}") != F.col(f"b_{seed}"))
    weights = (F.col(f"a_{seed}") == F.col(f"b_{seed}")) & (F.col(f"a_{weight}") != F.col(f"b_{weight}"))
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.count(j).alias("valid_pairs"), F.avg(j).alias("mean_j"), F.avg(F.when(seeds, j)).alias("across_seeds"), F.count(F.when(seeds, j)).alias("n_across_seeds"), F.avg(F.when(weights, j)).alias("across_weights"), F.count(F.when(weights, j)).alias("n_across_weights"))


def ensemble_summary(df: DataFrame, pairs: DataFrame, group: str, sets: str, score: str) -> DataFrame:
    """Per group: members, those with a set, similarity over valid pairs, population deviation of the score, and a status."""
    m = df.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.size(sets) > 0).alias("non_empty"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("pop_std_score"))
    p = pairs.groupBy(group).agg(F.count("jaccard").alias("valid_pairs"), F.avg("jaccard").alias("mean_j"), F.min("jaccard").alias("min_j"), F.median("jaccard").alias("median_j"))
    status = F.when(F.col("non_empty") < 2, "insufficient_nonempty_members").otherwise("ok")
    return m.join(p, group, "left").withColumn("status", status).withColumn("valid_pairs", F.coalesce("valid_pairs", F.lit(0).cast("long")))


def similarity_matrix(df: DataFrame, pairs: DataFrame, group: str, key: str, order: list[str], impute: str = "mean") -> DataFrame:
    """The symmetric matrix of each group in long form (i, j, value, imputed): slots ascend by ``order``, the diagonal is 1.

    A cell without a valid pair gets the group's mean over valid cells off the diagonal (0 without any), or 0.
    """
    slots = df.select(group, key, place(group, *[F.col(c) for c in order]).alias("slot"))
    both = directed(pairs, group, key, [], ["jaccard"])
    cells = slots.withColumnsRenamed({key: f"self_{key}", "slot": "i"}).join(slots.withColumnsRenamed({key: f"other_{key}", "slot": "j"}), group)
    m = cells.join(both, [group, f"self_{key}", f"other_{key}"], "left")
    off = F.when(F.col("i") != F.col("j"), F.col("jaccard"))
    fill = F.coalesce(F.avg(off).over(Window.partitionBy(group)), F.lit(0.0)) if impute == "mean" else F.lit(0.0)
    value = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.coalesce("jaccard", fill))
    return m.select(group, "i", "j", F.col(f"self_{key}").alias(key), value.alias("value"), ((F.col("i") != F.col("j")) & F.col("jaccard").isNull()).alias("imputed"))


def row_vectors(matrix: DataFrame, group: str, key: str, with_self: bool = False) -> DataFrame:
    """Each candidate's row of the matrix as an array in slot order, without its own cell by default."""
    m = matrix if with_self else matrix.where("i <> j")
    rows = m.groupBy(group, key, F.col("i").alias("slot")).agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("_r"))
    return rows.select(group, key, "slot", F.transform("_r", lambda x: x["value"]).alias("vector"))


def label_groups(pairs: DataFrame, labels: DataFrame, group: str, key: str, label: str, cluster: str) -> DataFrame:
    """Pair statistics by the labels at both ends: both acceptable, mixed, none; and how often both are in one cluster."""
    side = lambda s: labels.select(group, F.col(key).alias(f"{s}_{key}"), F.col(label).alias(f"_{s}l"), F.col(cluster).alias(f"_{s}c"))
    p = pairs.join(side("a"), [group, f"a_{key}"]).join(side("b"), [group, f"b_{key}"])
    n = F.col("_al").cast("int") + F.col("_bl").cast("int")
    kind = F.when(n == 2, "both").when(n == 1, "mixed").otherwise("neither")
    return p.groupBy(kind.alias("labels")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("jaccard").alias("mean_j"), F.median("jaccard").alias("median_j"), F.avg((F.col("_ac") == F.col("_bc")).cast("double")).alias("same_cluster"))


def cluster_summary(df: DataFrame, group: str, cluster: str, score: str, label: str) -> DataFrame:
    """Per cluster (noise left out): size, mean score, positives, purity, and ranks by size and score, ties sharing the smaller rank."""
    c = df.where(F.col(cluster) != -1).groupBy(group, cluster).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg(score), 9).alias("mean_score"), F.count_if(F.col(label)).alias("positives"))
    by = lambda x: F.rank().over(Window.partitionBy(group).orderBy(F.col(x).desc()))
    return c.withColumns({"rank_by_size": by("size"), "rank_by_score": by("mean_score"), "purity": F.col("positives") / F.col("size")})
