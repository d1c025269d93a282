"""Cohort construction: system metrics, classes, folds, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import place
from ..roles import ACCEPTABLE
from .contracts import duplicate_keys, require
from .sets import union_tagged


def system_metrics(df: DataFrame, group: str, rank: str, truth: str, score: str) -> DataFrame:
    """One row for each group, from one aggregate: rank-1's values, best, worst, range, numbers, and near-threshold flags."""
    one = lambda c: F.max(F.when(F.col(rank) == 1, F.col(c)))
    near = F.bool_or(F.col(truth).between(0.18, 0.28))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("members"), one(truth).alias("rank1_truth"), one(score).alias("rank1_score"), F.max(truth).alias("best_truth"), F.min(truth).alias("worst_truth"), (F.max(truth) - F.min(truth)).alias("truth_range"), F.count_if(F.col(truth) >= ACCEPTABLE).alias("n_acceptable"), near.alias("near_threshold"))


CLASSES = {1: "stable_right", 2: "right_with_spread", 3: "rescuable_confident", 4: "rescuable", 5: "wrong_confident", 6: "wrong"}


def six_classes(systems: DataFrame, quantile: float = 0.8) -> DataFrame:
    """A class for each system by rank-1's and the best's correctness, split by the quantile of range (right ones) or score (wrong ones) over complete rows."""
    complete = systems.where("rank1_truth is not null and rank1_score is not null and truth_range is not null")
    cut = complete.agg(F.percentile("truth_range", F.lit(quantile)).alias("cut_range"), F.percentile("rank1_score", F.lit(quantile)).alias("cut_score"))
    right, any_ = F.col("rank1_truth") >= ACCEPTABLE, F.col("best_truth") >= ACCEPTABLE
    wide, sure = F.col("truth_range") >= F.col("cut_range"), F.col("rank1_score") >= F.col("cut_score")
    k = F.when(right & ~wide, 1).when(right, 2).when(any_ & sure, 3).when(any_, 4).when(sure, 5).otherwise(6)
    names = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return complete.crossJoin(cut).withColumn("class_id", k).withColumn("class_name", F.element_at(names, F.col("class_id"))).drop("cut_range", "cut_score")


def class_summary(df: DataFrame, cls: str, source: str, sources: list) -> DataFrame:
    """Systems of each class by source, zeros filled in, with the total."""
    p = df.groupBy(cls).pivot(source, sources).agg(F.count(F.lit(1)))
    names = [str(s) for s in sources]
    p = p.select(cls, *[F.coalesce(F.col(f"`{n}`"), F.lit(0).cast("long")).alias(f"source_{n}") for n in names])
    return p.withColumn("total", sum((F.col(f"source_{n}") for n in names), F.lit(0).cast("long")))


def folds_by_hash(df: DataFrame, key: str, stratum: str, k: int = 5) -> DataFrame:
    """Folds within each stratum in the order of the ids' hashes, dealt in turn. Needs no order among strata."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    return df.withColumn("fold", ((place(stratum, digest, F.col(key)) - 1) % k).cast("int"))


def selection_reason(df: DataFrame, cls: str, near: str, sampled: str, whole: list[int]) -> DataFrame:
    """Why a system is kept: its class is kept whole, it lies near the threshold, it was sampled for diversity; else it isn't."""
    why = F.when(F.col(cls).isin(*whole), "class_kept_whole").when(F.col(near), "boundary_case").when(F.col(sampled), "diversity_sample").otherwise("not_selected")
    return df.withColumn("reason", why)


def freeze_manifest(df: DataFrame, ids: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a list of ids in the list's order, and which ids are missing or were excess. ids: (order, key)."""
    return df.join(ids, key), ids.join(df, key, "left_anti").select(key)


def inventory(df: DataFrame, key: str, files: list[str]) -> DataFrame:
    """(kind, path), one row for each distinct file named by the columns."""
    rows = F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f).alias("path")) for f in files])
    return df.select(F.explode(rows).alias("x")).select("x.kind", "x.path").where("path is not null").distinct()


def plan_summary(jobs: DataFrame, a: str, b: str) -> DataFrame:
    """Jobs, chains, residues, exact duplicates and paired searches of a list of two-chain jobs."""
    same = F.col(a) == F.col(b)
    return jobs.agg(F.count(F.lit(1)).alias("jobs"), (F.count(F.lit(1)) * 2).alias("chains"), F.sum(F.length(a) + F.length(b)).alias("residues"), F.count_if(same).alias("exact_duplicates"), F.count_if(~same).alias("paired_searches"), F.count_if(F.length(a) + F.length(b) < 1500).alias("below_limit"))


def job_status(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """complete / failed / pending for each expected job from what was observed (digest, error), and 'unexpected' for others."""
    j = expected.withColumn("_e", F.lit(True)).join(observed.withColumn("_o", F.lit(True)), key, "full")
    status = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_o").isNull(), "pending").when(F.coalesce(F.col("error"), F.lit("")) != "", "failed").when(F.col("digest") == F.col("want_digest"), "complete").otherwise("stale")
    return j.select(key, status.alias("status"))


def load_sources(spark: SparkSession, paths: dict[str, str], required: list[str], key: str, tag: str = "source") -> DataFrame:
    """Tables of several sources as one, each row with its source's name; raises if a table lacks columns or a key stands twice, in one source or in two."""
    from ..sources.readers import read_table

    all_ = union_tagged({name: read_table(spark, path, required) for name, path in paths.items()}, tag)
    require(duplicate_keys(all_, [key]))
    return all_


def one_seed(pairs: DataFrame, group: str, seed: str, value: int = 0) -> DataFrame:
    """Per group: pairs whose both ends have this seed, those that are valid, and their mean similarity; groups without such pairs too."""
    both = (F.col(f"a_{seed}") == value) & (F.col(f"b_{seed}") == value)
    return pairs.groupBy(group).agg(F.count_if(both).alias("pairs"), F.count(F.when(both, F.col("jaccard"))).alias("valid_pairs"), F.avg(F.when(both, F.col("jaccard"))).alias("mean_j"))
