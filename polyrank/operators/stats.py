"""Aggregations and ranking statistics over candidates and groups.

Statistics of one group rank its rows in a window. Pooled ones, over all rows, rank one row for each distinct score by
``ranges.running``, so that no task orders them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import avg_rank, best_first, place
from ..roles import ACCEPTABLE, HIGH, MEDIUM
from .ranges import running


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def spearman(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """Spearman's rho per ``by`` (or one row): ranks with averaged ties, then Pearson.

    Rows with either missing are left out; null with under 3 rows or a constant side.
    """
    keys = _keys(by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not keys:
        return _pooled_spearman(d, x, y)
    d = d.withColumns({"_rx": avg_rank(x, keys), "_ry": avg_rank(y, keys)})
    # corr() fails on a constant side in ANSI mode
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (F.count(F.lit(1)) >= 3)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(varies, rho).alias("rho"))


def _pooled_spearman(d: DataFrame, x: str, y: str) -> DataFrame:
    """One row. Ranks are of distinct values; a row meets its y's rank by one join, its x's by aggregation alone."""
    pairs = d.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    middle = (F.col("before__m") + (F.col("_m") + 1) / F.lit(2.0)).alias("_r")
    ys = running(pairs.groupBy("_y").agg(F.sum("_n").alias("_m")), "_y", ["_m"]).select("_y", "_m", middle)
    xs = pairs.join(ys.select("_y", "_r"), "_y").groupBy("_x").agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * F.col("_r")).alias("_s"))
    xs = running(xs, "_x", ["_m"]).select("_x", "_m", "_s", middle)
    side = lambda f, v, *more: f.agg(F.sum("_m").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(F.col("_m") * F.col("_r") * F.col("_r")).alias("squares"), *more)
    one = side(xs, "_x", F.sum(F.col("_r") * F.col("_s")).alias("products"))
    both = one.crossJoin(side(ys, "_y").select(F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.col("squares").alias("squares_y")))  # a row each
    n, mean = F.col("n"), (F.col("n") + 1) / F.lit(2.0)
    spread = lambda c: F.col(c) / n - mean * mean
    rho = F.try_divide(F.col("products") / n - mean * mean, F.sqrt(spread("squares") * spread("squares_y")))
    return both.select(F.coalesce(n, F.lit(0)).alias("n"), F.when((F.col("low") < F.col("high")) & (F.col("low_y") < F.col("high_y")) & (n >= 3), rho).alias("rho"))


def roc_auc(df: DataFrame, label: str, score: str, by=None) -> DataFrame:
    """ROC-AUC per ``by`` from rank sums, ties averaged; null if a class is absent. label is boolean; missing scores are left out."""
    keys = _keys(by)
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    if not keys:
        b = running(_blocks(d, label, score, []), score, ["_fp"])
        tp, fp = F.sum("_tp"), F.sum("_fp")
        auc = F.try_divide(F.sum(F.col("_tp") * (F.col("before__fp") + F.col("_fp") / F.lit(2.0))), tp.cast("double") * fp)
        return b.agg(F.coalesce(tp, F.lit(0)).alias("positives"), F.coalesce(fp, F.lit(0)).alias("negatives"), auc.alias("auc"))
    d = d.withColumn("_r", avg_rank(score, keys))
    pos, neg = F.count_if(F.col(label)), F.count_if(~F.col(label))
    auc = (F.sum(F.when(F.col(label), F.col("_r")).otherwise(0.0)) - pos * (pos + 1) / F.lit(2.0)) / (pos * neg)
    return d.groupBy(*keys).agg(pos.alias("positives"), neg.alias("negatives"), F.when((pos > 0) & (neg > 0), auc).alias("auc"))


def _blocks(d: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """One row for each score: _tp positives, _fp others, _n rows."""
    return d.groupBy(*keys, score).agg(F.count_if(F.col(label)).alias("_tp"), F.count_if(~F.col(label)).alias("_fp"), F.count(F.lit(1)).alias("_n"))


def average_precision(df: DataFrame, label: str, score: str, by=None) -> DataFrame:
    """Average precision per ``by``: precision at the end of each block of equal scores, weighted by the recall that the block adds."""
    keys = _keys(by)
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    blocks = _blocks(d, label, score, keys)
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.col(score).desc())
        blocks = blocks.withColumns({"_ctp": F.sum("_tp").over(w), "_cn": F.sum("_n").over(w)})
    else:
        blocks = _from_the_top(blocks, score)
    p = F.sum("_tp")
    return blocks.groupBy(*keys).agg(F.when(p > 0, F.sum(F.col("_tp") * (F.col("_ctp") / F.col("_cn"))) / p).alias("ap"))


def _from_the_top(blocks: DataFrame, score: str) -> DataFrame:
    """Pooled blocks with _ctp and _cn: positives and rows with this score or a higher one."""
    down = blocks.withColumn("_down", -F.col(score))
    return running(down, "_down", ["_tp", "_n"]).withColumns({"_ctp": F.col("before__tp") + F.col("_tp"), "_cn": F.col("before__n") + F.col("_n")})


def brier(df: DataFrame, label: str, probability: str, by=None) -> DataFrame:
    err = F.col(label).cast("double") - F.col(probability)
    return df.groupBy(*_keys(by)).agg(F.avg(err * err).alias("brier"))


def _joined(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys) if keys else out.crossJoin(f)  # without keys each frame is one row
    return out


def metric_performance(df: DataFrame, score: str, truth: str, threshold: float = ACCEPTABLE) -> DataFrame:
    """n, positives, rate, rho, auc and ap of a score, over rows that have it and the truth: one row."""
    d = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).withColumn("_y", F.col(truth) >= threshold)
    n = d.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("_y").cast("double")).alias("rate"))
    return _joined([n, spearman(d, score, truth).select("rho"), roc_auc(d, "_y", score).select("positives", "auc"), average_precision(d, "_y", score)], [])


def candidate_metrics(df: DataFrame, probability: str, truth: str, threshold: float = ACCEPTABLE) -> DataFrame:
    """Rows, positives, auc, ap and brier: one row."""
    d = df.withColumn("_y", F.col(truth) >= threshold)
    n = d.agg(F.count(F.lit(1)).alias("rows"))
    return _joined([n, roc_auc(d, "_y", probability).select("positives", "auc"), average_precision(d, "_y", probability), brier(d, "_y", probability)], [])


def selector_metrics(picks: DataFrame, truth: str, by=None) -> DataFrame:
    """Rates at the three thresholds, mean and median of the picks' truth."""
    rate = lambda t: F.avg((F.col(truth) >= t).cast("double"))
    return picks.groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias("groups"), rate(ACCEPTABLE).alias("rate_acceptable"), rate(MEDIUM).alias("rate_medium"), rate(HIGH).alias("rate_high"), F.avg(truth).alias("mean_truth"), F.median(truth).alias("median_truth"))


def within_group_spearman(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """How rho is spread over groups: number, median, quartiles, share above 0."""
    r = spearman(df, x, y, group).where("rho is not null")
    return r.agg(F.count(F.lit(1)).alias("groups"), F.median("rho").alias("median_rho"), F.percentile("rho", F.lit(0.25)).alias("q25"), F.percentile("rho", F.lit(0.75)).alias("q75"), F.avg((F.col("rho") > 0).cast("double")).alias("share_positive"))


def within_group_auc(df: DataFrame, label: str, score: str, group: str) -> DataFrame:
    """Mean AUC over the groups that have both classes, and their number."""
    return roc_auc(df, label, score, group).where("auc is not null").agg(F.avg("auc").alias("mean_auc"), F.count(F.lit(1)).alias("groups"))


def precision_at_fraction(df: DataFrame, label: str, score: str, fraction: float, ties: list[str]) -> DataFrame:
    """Precision among the best max(1, ceil(n * fraction)) rows, and the lowest score among them; one row.

    The cut is looked for among distinct scores, then among the cut score's rows by each tie column in turn; rows that
    are equal in all of them count positives last. A row a column comes to the driver.
    """
    d = df.where(F.col(score).isNotNull())
    n = d.count()
    left = k = min(n, max(1, math.ceil(n * fraction)))
    hits, cutoff = 0, None
    for c in [score, *ties]:
        blocks = _blocks(d, label, c, []).withColumn("_up", -F.col(c) if c == score else F.col(c))
        at = running(blocks, "_up", ["_tp", "_n"]).where(F.lit(left).between(F.col("before__n") + 1, F.col("before__n") + F.col("_n"))).first()
        if at is None:
            break
        cutoff = at[c] if c == score else cutoff
        hits, left, d, last = hits + at["before__tp"], left - at["before__n"], d.where(F.col(c) == F.lit(at[c])), (at["_tp"], at["_n"])
        if left == at["_n"]:
            break
    if n:
        hits += max(0, left - (last[1] - last[0]))
    return df.sparkSession.createDataFrame([(k, hits / k if k else None, cutoff)], f"selected long, precision double, cutoff {dict(df.dtypes)[score]}")


def ordered(df: DataFrame, score: str, group: str, ties: list[str], descending: bool = True) -> DataFrame:
    return df.withColumn("position", place(group, *best_first(score, ties, descending)))


def recall_at_k(df: DataFrame, label: str, score: str, group: str, k: int, ties: list[str]) -> DataFrame:
    """Share of the groups with a positive that have one among their first k."""
    g = ordered(df, score, group, ties).groupBy(group).agg(F.bool_or(F.col(label)).alias("_any"), F.coalesce(F.bool_or(F.when(F.col("position") <= k, F.col(label))), F.lit(False)).alias("_hit"))
    return g.where("_any").agg(F.count(F.lit(1)).alias("groups"), F.avg(F.col("_hit").cast("double")).alias("recall"))


def first_acceptable(df: DataFrame, label: str, score: str, group: str, rank: str, ties: list[str]) -> DataFrame:
    """Per group with a positive: where the first one stands in the score's order, and the rank column it has."""
    d = ordered(df, score, group, ties).where(F.col(label))
    return d.groupBy(group).agg(F.min("position").alias("position"), F.min_by(rank, "position").alias("original_rank"))


def rerank_report(df: DataFrame, label: str, score: str, truth: str, group: str, rank: str, ties: list[str]) -> DataFrame:
    """Median rho, first-acceptable mean and median, recall at 1, 3 and 5: over all groups, and over those whose rank-1 fails though some succeed."""
    per = ordered(df, score, group, ties).groupBy(group).agg(
        F.bool_or(F.col(label)).alias("_any"),
        F.bool_or((F.col(rank) == 1) & F.col(label)).alias("_one"),
        F.min(F.when(F.col(label), F.col("position"))).alias("_first"),
    )
    rho = spearman(df, score, truth, group).select(group, "rho")
    per = per.join(rho, group, "left")
    both = per.withColumn("subset", F.explode(F.when(F.col("_any") & ~F.col("_one"), F.array(F.lit("all"), F.lit("rescuable"))).otherwise(F.array(F.lit("all")))))
    recall = lambda k: F.avg(F.when(F.col("_any"), (F.col("_first") <= k).cast("double")))
    return both.groupBy("subset").agg(F.count(F.lit(1)).alias("groups"), F.median("rho").alias("median_rho"), F.avg("_first").alias("mean_first"), F.median("_first").alias("median_first"), recall(1).alias("recall_1"), recall(3).alias("recall_3"), recall(5).alias("recall_5"))


def save_break(picks: DataFrame, reference: DataFrame, truth: str, group: str, threshold: float = ACCEPTABLE) -> DataFrame:
    """Groups that a selector saves (its pick is acceptable, the reference's isn't) and breaks."""
    a = picks.select(group, (F.col(truth) >= threshold).alias("_a"))
    b = reference.select(group, (F.col(truth) >= threshold).alias("_b"))
    j = a.join(b, group)
    saves, breaks = F.count_if(F.col("_a") & ~F.col("_b")), F.count_if(~F.col("_a") & F.col("_b"))
    return j.agg(saves.alias("saves"), breaks.alias("breaks"), (saves - breaks).alias("net"))


def top_mean(df: DataFrame, x: str, group: str, k: int = 3) -> DataFrame:
    """Mean of the k largest values of each group, of fewer if it has fewer."""
    d = df.where(F.col(x).isNotNull()).withColumn("_no", place(group, F.col(x).desc()))
    return d.where(F.col("_no") <= k).groupBy(group).agg(F.avg(x).alias("top_mean"))


def first_present(df: DataFrame, columns: list[str], group: str, *order: Column) -> DataFrame:
    """Per group and column: the first value that is not missing, in the order given. Columns may come from different rows."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.select(group, place(group, *order).alias("_no"), *[F.first_value(c, ignoreNulls=True).over(w).alias(c) for c in columns])
    return d.where("_no = 1").drop("_no")


def system_classes(df: DataFrame, label: str, group: str, rank: str, agreement: str, support: str) -> DataFrame:
    """One class for each group: rank-1 right, rescuable, stably wrong (none right, both agreement and support at least 0.8), sampling failure."""
    g = df.groupBy(group).agg(F.coalesce(F.bool_or((F.col(rank) == 1) & F.col(label)), F.lit(False)).alias("_one"), F.bool_or(F.col(label)).alias("_any"), F.bool_and(F.col(label)).alias("_all"), F.max(agreement).alias("_j"), F.max(support).alias("_s"))
    kind = F.when(F.col("_one"), "rank1_correct").when(F.col("_any"), "rescuable").when((F.col("_j") >= 0.8) & (F.col("_s") >= 0.8), "stable_wrong").otherwise("sampling_failure")
    return g.select(group, kind.alias("class"), F.col("_all").alias("all_acceptable"))
