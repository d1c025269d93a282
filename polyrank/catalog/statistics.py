"""Aggregations, ranking statistics and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import CAND, candidates, with_
from ..functions import windows
from ..functions.columns import wilson as wilson_columns
from ..operators import bootstrap, cohort, pairs, selectors, stats
from ..sources.readers import stored
from .registry import query, r, rounded


def Y():
    return F.col("truth") >= 0.23


AVG = "CASE WHEN {v} IS NULL THEN NULL ELSE rank() OVER (PARTITION BY {p} ORDER BY {v} NULLS LAST) + (count({v}) OVER (PARTITION BY {p}, {v}) - 1) / 2.0::DOUBLE END"


def _labelled(spark, sf):
    return candidates(spark, sf).withColumn("y", Y())


@query(with_(CAND, "SELECT g, count(*) AS n, count(DISTINCT seed) AS seeds, count(DISTINCT weight) AS weights, count(DISTINCT kind) AS kinds FROM cand GROUP BY g"))
def group_counts(spark, sf):
    return candidates(spark, sf).groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(c + "s") for c in ("seed", "weight", "kind")])


@query(with_(CAND, "SELECT g, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high, round(stddev_samp(score), 6) AS std, round(max(score) - min(score), 6) AS range FROM cand GROUP BY g"))
def group_moments(spark, sf):
    return candidates(spark, sf).groupBy("g").agg(r(F.avg("score")).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), r(F.stddev_samp("score")).alias("std"), r(F.max("score") - F.min("score")).alias("range"))


@query(with_(CAND, "SELECT g, round(stddev_pop(score), 6) AS pop_std FROM cand GROUP BY g"))
def pop_std(spark, sf):
    return candidates(spark, sf).groupBy("g").agg(r(F.stddev_pop("score")).alias("pop_std"))


@query(with_(CAND, "SELECT g, round(median(score), 6) AS median_score, round(median(truth), 6) AS median_truth FROM cand GROUP BY g"))
def group_median(spark, sf):
    return candidates(spark, sf).groupBy("g").agg(r(F.median("score")).alias("median_score"), r(F.median("truth")).alias("median_truth"))


@query(with_(CAND, "SELECT g, round(quantile_cont(score, 0.025), 6) AS q025, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.8), 6) AS q80, round(quantile_cont(score, 0.975), 6) AS q975 FROM cand GROUP BY g"))
def group_quantiles(spark, sf):
    return candidates(spark, sf).groupBy("g").agg(*[r(F.percentile("score", F.lit(q))).alias(n) for q, n in ((0.025, "q025"), (0.25, "q25"), (0.8, "q80"), (0.975, "q975"))])


@query(with_(CAND, "SELECT g, bool_or(truth >= 0.23) AS any_ok, bool_and(truth >= 0.23) AS all_ok, sum((truth >= 0.23)::INT)::BIGINT AS n_ok, round(avg((truth >= 0.23)::INT), 6) AS rate, count(*) FILTER (truth >= 0.8) AS n_high FROM cand GROUP BY g"))
def group_flags(spark, sf):
    return candidates(spark, sf).groupBy("g").agg(F.bool_or(Y()).alias("any_ok"), F.bool_and(Y()).alias("all_ok"), F.count_if(Y()).alias("n_ok"), r(F.avg(Y().cast("double"))).alias("rate"), F.count_if(F.col("truth") >= 0.8).alias("n_high"))


@query(with_(CAND, "SELECT g, arg_min(score, rank) AS rank1_score, arg_min(truth, rank) AS rank1_truth FROM cand GROUP BY g"))
def value_at_min(spark, sf):
    return candidates(spark, sf).groupBy("g").agg(F.min_by("score", "rank").alias("rank1_score"), F.min_by("truth", "rank").alias("rank1_truth"))


@query(with_(CAND, "SELECT g, round(avg(score), 6) AS top_mean FROM (SELECT g, score, row_number() OVER (PARTITION BY g ORDER BY score DESC) AS k FROM cand) WHERE k <= 3 GROUP BY g"))
def top3_mean(spark, sf):
    return rounded(stats.top_mean(candidates(spark, sf), "score", "g", 3))


@query(with_(CAND, "SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN id % 13 = 0 THEN NULL ELSE kind END AS kind FROM cand) GROUP BY kind"))
def value_counts(spark, sf):
    d = candidates(spark, sf).select(F.when(F.col("id") % 13 != 0, F.col("kind")).alias("kind"))
    n = d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("_all"))).select("kind", "n", r(F.col("n") / F.col("_all")).alias("share"))


@query(with_(CAND, "SELECT fold, " + ", ".join(f"count(*) FILTER (weight = {w}) AS w{w}" for w in (1, 2, 3, 4, 5, 6)) + ", count(*) AS total FROM cand GROUP BY ROLLUP (fold)"))
def crosstab(spark, sf):
    d = candidates(spark, sf)
    body = d.groupBy("fold").pivot("weight", [1, 2, 3, 4, 5, 6]).agg(F.count(F.lit(1))).select("fold", *[F.coalesce(F.col(str(w)), F.lit(0).cast("long")).alias(f"w{w}") for w in range(1, 7)])
    body = body.withColumn("total", sum((F.col(f"w{w}") for w in range(2, 7)), F.col("w1")))
    margin = body.agg(*[F.sum(c).alias(c) for c in body.columns if c != "fold"])
    return body.unionByName(margin.withColumn("fold", F.lit(None).cast("int")))


@query(with_(CAND, "SELECT g, max(score) FILTER (rank = 1) AS rank_1, max(score) FILTER (rank = 2) AS rank_2, max(score) FILTER (rank = 3) AS rank_3 FROM cand WHERE rank <= 3 GROUP BY g"))
def pivot_wide(spark, sf):
    d = candidates(spark, sf).where("rank <= 3")
    return d.groupBy("g").pivot("rank", [1, 2, 3]).agg(F.first("score")).withColumnsRenamed({str(i): f"rank_{i}" for i in (1, 2, 3)})


@query(with_(CAND, "SELECT fold, kind, count(*) AS n, round(avg(score), 6) AS mean_score, round(sum(truth), 6) AS sum_truth, round(median(truth), 6) AS median_truth, count(DISTINCT g) AS groups FROM cand GROUP BY fold, kind"))
def stratum_summary(spark, sf):
    return candidates(spark, sf).groupBy("fold", "kind").agg(F.count(F.lit(1)).alias("n"), r(F.avg("score")).alias("mean_score"), r(F.sum("truth")).alias("sum_truth"), r(F.median("truth")).alias("median_truth"), F.count_distinct("g").alias("groups"))


@query(with_(CAND, """, n AS (SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE score END AS s, CASE WHEN id % 2 = 0 THEN NULL ELSE truth END AS t FROM cand)
SELECT DISTINCT g, first_value(s IGNORE NULLS) OVER w AS s, first_value(t IGNORE NULLS) OVER w AS t FROM n
WINDOW w AS (PARTITION BY g ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""").replace("FROM events)\n,", "FROM events),"))
def first_nonnull(spark, sf):
    d = candidates(spark, sf).select("g", "rank", F.when(F.col("id") % 3 != 0, F.col("score")).alias("s"), F.when(F.col("id") % 2 != 0, F.col("truth")).alias("t"))
    return stats.first_present(d, ["s", "t"], "g", F.col("rank"))


SPEAR = """, rk AS (SELECT *, """ + AVG.format(v="score", p="{p}") + " AS ra, " + AVG.format(v="truth", p="{p}") + " AS rb FROM cand)"


@query(with_(CAND + SPEAR.format(p="1"), "SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM rk"))
def spearman_global(spark, sf):
    return rounded(stats.spearman(candidates(spark, sf), "score", "truth"))


@query(with_(CAND + SPEAR.format(p="g"), "SELECT count(*) AS groups, round(median(rho), 6) AS median_rho, round(quantile_cont(rho, 0.25), 6) AS q25, round(quantile_cont(rho, 0.75), 6) AS q75, round(avg((rho > 0)::INT), 6) AS share_positive FROM (SELECT g, corr(ra, rb) AS rho FROM rk GROUP BY g HAVING count(*) >= 3 AND min(score) < max(score) AND min(truth) < max(truth))"))
def within_spearman(spark, sf):
    return rounded(stats.within_group_spearman(candidates(spark, sf), "score", "truth", "g"))


AUC = ", ar AS (SELECT *, truth >= 0.23 AS y, " + AVG.format(v="{v}", p="{p}") + " AS ra FROM cand), auc AS (SELECT {k} count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, (sum(CASE WHEN y THEN ra ELSE 0 END) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (y) * count(*) FILTER (NOT y), 0) AS auc FROM ar {by})"


@query(with_(CAND + AUC.format(v="score", p="g", k="g,", by="GROUP BY g"), "SELECT g, positives, negatives, round(auc, 6) AS auc FROM auc"))
def roc_auc(spark, sf):
    return rounded(stats.roc_auc(_labelled(spark, sf), "y", "score", "g"))


@query(with_(CAND + AUC.format(v="score", p="g", k="g,", by="GROUP BY g"), "SELECT round(avg(auc), 6) AS mean_auc, count(*) AS groups FROM auc WHERE auc IS NOT NULL"))
def within_group_auc(spark, sf):
    return rounded(stats.within_group_auc(_labelled(spark, sf), "y", "score", "g"))


AP = ", bl AS (SELECT {v} AS v, count(*) FILTER (truth >= 0.23) AS tp, count(*) AS n FROM cand GROUP BY {v}), cm AS (SELECT *, sum(tp) OVER (ORDER BY v DESC) AS ctp, sum(n) OVER (ORDER BY v DESC) AS cn, sum(tp) OVER () AS p FROM bl), ap AS (SELECT sum((tp / p) * (ctp / cn)) AS ap FROM cm)"


@query(with_(CAND + AP.format(v="score"), "SELECT round(ap, 6) AS ap FROM ap"))
def average_precision(spark, sf):
    return rounded(stats.average_precision(_labelled(spark, sf), "y", "score"))


@query(with_(CAND, "SELECT fold, round(avg(pow((truth >= 0.23)::INT - score2 / 100, 2)), 6) AS brier FROM cand GROUP BY fold"))
def brier(spark, sf):
    return rounded(stats.brier(_labelled(spark, sf).withColumn("p", F.col("score2") / 100), "y", "p", "fold"))


@query(with_(CAND + SPEAR.format(p="1") + AUC.format(v="score", p="1", k="", by="") + AP.format(v="score"), "SELECT (SELECT count(*) FROM cand) AS rows, (SELECT round(avg((truth >= 0.23)::INT), 6) FROM cand) AS rate, (SELECT round(corr(ra, rb), 6) FROM rk) AS rho, (SELECT positives FROM auc) AS positives, (SELECT round(auc, 6) FROM auc) AS auc, (SELECT round(ap, 6) FROM ap) AS ap"))
def metric_performance(spark, sf):
    return rounded(stats.metric_performance(candidates(spark, sf), "score", "truth"))


@query(with_(CAND + AUC.format(v="score2", p="1", k="", by="") + AP.format(v="score2"), "SELECT (SELECT count(*) FROM cand) AS rows, (SELECT positives FROM auc) AS positives, (SELECT round(auc, 6) FROM auc) AS auc, (SELECT round(ap, 6) FROM ap) AS ap, (SELECT round(avg(pow((truth >= 0.23)::INT - score2 / 100, 2)), 9) FROM cand) AS brier"))
def candidate_metrics(spark, sf):
    m = stats.candidate_metrics(candidates(spark, sf).withColumn("p", F.col("score2") / 100), "p", "truth")
    return m.select("rows", "positives", r("auc").alias("auc"), r("ap").alias("ap"), r("brier", 9).alias("brier"))


PICK = ", pick AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY g ORDER BY {s} DESC NULLS LAST, id) = 1)"
MET = "count(*) AS groups, round(avg((truth >= 0.23)::INT), 6) AS rate_acceptable, round(avg((truth >= 0.49)::INT), 6) AS rate_medium, round(avg((truth >= 0.8)::INT), 6) AS rate_high, round(avg(truth), 6) AS mean_truth, round(median(truth), 6) AS median_truth"


@query(with_(CAND + PICK.format(s="score"), f"SELECT {MET} FROM pick"))
def selector_metrics(spark, sf):
    return rounded(stats.selector_metrics(selectors.top1(candidates(spark, sf), "score", "g", ["id"]), "truth"))


@query(with_(CAND, "SELECT count(*) AS selected, round(avg((truth >= 0.23)::INT), 6) AS precision, min(score) AS cutoff FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k, count(*) OVER () AS n FROM cand) WHERE k <= greatest(1, ceil(n * 0.1::DOUBLE))"))
def precision_at_fraction(spark, sf):
    return rounded(stats.precision_at_fraction(_labelled(spark, sf), "y", "score", 0.1, ["id"]))


ORD = ", ord AS (SELECT *, truth >= 0.23 AS y, row_number() OVER (PARTITION BY g ORDER BY score DESC NULLS LAST, id) AS position FROM cand)"


@query(with_(CAND + ORD, "SELECT count(*) AS groups, round(avg(hit::INT), 6) AS recall FROM (SELECT g, bool_or(y) AS any_y, coalesce(bool_or(y) FILTER (position <= 3), false) AS hit FROM ord GROUP BY g) WHERE any_y"))
def recall_at_k(spark, sf):
    return rounded(stats.recall_at_k(_labelled(spark, sf), "y", "score", "g", 3, ["id"]))


@query(with_(CAND + ORD, "SELECT g, min(position)::INT AS position, arg_min(rank, position) AS original_rank FROM ord WHERE y GROUP BY g"))
def first_acceptable_rank(spark, sf):
    return stats.first_acceptable(_labelled(spark, sf), "y", "score", "g", "rank", ["id"])


@query(with_(CAND + ORD + SPEAR.format(p="g"), """, per AS (SELECT g, bool_or(y) AS any_y, bool_or(y AND rank = 1) AS one, min(position) FILTER (y) AS first FROM ord GROUP BY g),
rho AS (SELECT g, corr(ra, rb) AS rho FROM rk GROUP BY g HAVING count(*) >= 3 AND min(score) < max(score) AND min(truth) < max(truth)),
sub AS (SELECT 'all' AS subset, * FROM per LEFT JOIN rho USING (g) UNION ALL SELECT 'rescuable', * FROM per LEFT JOIN rho USING (g) WHERE any_y AND NOT one)
SELECT subset, count(*) AS groups, round(median(rho), 6) AS median_rho, round(avg(first), 6) AS mean_first, round(median(first), 6) AS median_first, round(avg((first <= 1)::INT) FILTER (any_y), 6) AS recall_1, round(avg((first <= 3)::INT) FILTER (any_y), 6) AS recall_3, round(avg((first <= 5)::INT) FILTER (any_y), 6) AS recall_5 FROM sub GROUP BY subset""").replace("FROM cand)\n,", "FROM cand),"))
def rerank_report(spark, sf):
    return rounded(stats.rerank_report(_labelled(spark, sf), "y", "score", "truth", "g", "rank", ["id"]))


@query(with_(CAND + PICK.format(s="score"), "SELECT count(*) FILTER (a AND NOT b) AS saves, count(*) FILTER (NOT a AND b) AS breaks, count(*) FILTER (a AND NOT b) - count(*) FILTER (NOT a AND b) AS net FROM (SELECT p.truth >= 0.23 AS a, c.truth >= 0.23 AS b FROM pick p JOIN cand c ON p.g = c.g AND c.rank = 1)"))
def save_break(spark, sf):
    d = candidates(spark, sf)
    return stats.save_break(selectors.top1(d, "score", "g", ["id"]), selectors.rank1(d), "truth", "g")


@query(with_(CAND, """SELECT g, round((k / n + zz / (2 * n)) / (1 + zz / n) - h, 6) AS low, round((k / n + zz / (2 * n)) / (1 + zz / n) + h, 6) AS high FROM (
SELECT *, z * sqrt(k / n * (1 - k / n) / n + zz / (4 * n * n)) / (1 + zz / n) AS h FROM (SELECT g, count(*) FILTER (truth >= 0.23)::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS zz FROM cand GROUP BY g))"""))
def wilson_interval(spark, sf):
    n = candidates(spark, sf).groupBy("g").agg(F.count_if(Y()).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson_columns("k", "n")
    return n.select("g", r(low).alias("low"), r(high).alias("high"))


B = 1000
WEIGHTS = f""", ix AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM (SELECT DISTINCT g FROM cand)), nn AS (SELECT count(*) AS n FROM ix),
dr AS (SELECT b, ('0x' || substr(sha256(b::VARCHAR || '|' || i::VARCHAR), 1, 12))::BIGINT % n AS i FROM range({B}) t(b), ix, nn),
wt AS (SELECT b, g, count(*) AS w FROM dr JOIN ix USING (i) GROUP BY b, g)"""
WAUC = ", s{n} AS (SELECT b, {v} AS v, sum(w) FILTER (truth >= 0.23) AS p, sum(w) FILTER (truth < 0.23) AS q FROM cand JOIN wt USING (g) GROUP BY b, {v}), x{n} AS (SELECT b, coalesce(p, 0) AS p, coalesce(q, 0) AS q, sum(coalesce(q, 0)) OVER (PARTITION BY b ORDER BY v) - coalesce(q, 0) AS below FROM s{n}), a{n} AS (SELECT b, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM x{n} GROUP BY b)"


@query(with_(CAND + WEIGHTS + WAUC.format(n=1, v="score"), "SELECT round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high, count(*) AS replicates FROM a1"))
def bootstrap_pooled(spark, sf):
    d = stored(_labelled(spark, sf).select("g", "score", "y"), "pooled")
    return rounded(bootstrap.pooled_auc_interval(d, "y", "score", "g", B))


@query(with_(CAND + PICK.format(s="score") + WEIGHTS, """, d AS (SELECT p.g, (p.truth >= 0.23)::INT - (c.truth >= 0.23)::INT AS dr, p.truth - c.truth AS dm FROM pick p JOIN cand c ON p.g = c.g AND c.rank = 1),
rp AS (SELECT b, sum(dr * w) / sum(w) AS dr, sum(dm * w) / sum(w) AS dm FROM d JOIN wt USING (g) GROUP BY b)
SELECT (SELECT round(avg(dr), 6) FROM d) AS delta_rate, (SELECT round(avg(dm), 6) FROM d) AS delta_mean, round(quantile_cont(dr, 0.025), 6) AS rate_low, round(quantile_cont(dr, 0.975), 6) AS rate_high, round(quantile_cont(dm, 0.025), 6) AS mean_low, round(quantile_cont(dm, 0.975), 6) AS mean_high FROM rp""").replace("GROUP BY b, g)\n,", "GROUP BY b, g),"))
def bootstrap_paired(spark, sf):
    d = candidates(spark, sf)
    p = stored(selectors.paired(selectors.top1(d, "score", "g", ["id"]), selectors.rank1(d), "truth", "g"), "paired")
    return rounded(bootstrap.paired_difference(p, "a_truth", "b_truth", "g", 0.23, B))


# average precision of each replicate, and both statistics of the whole table
WAP = ", t{n} AS (SELECT b, coalesce(p, 0) AS p, sum(coalesce(p, 0)) OVER w AS tp, sum(coalesce(p, 0) + coalesce(q, 0)) OVER w AS n FROM s{n} WHERE v IS NOT NULL WINDOW w AS (PARTITION BY b ORDER BY v DESC)), p{n} AS (SELECT b, CASE WHEN sum(p) > 0 THEN sum(p * (tp / nullif(n, 0))) / sum(p) END AS ap FROM t{n} GROUP BY b)"
SEEN = ", y{n} AS (SELECT {v} AS v, count(*) FILTER (truth >= 0.23) AS p, count(*) FILTER (truth < 0.23) AS q FROM cand WHERE {v} IS NOT NULL GROUP BY {v}), z{n} AS (SELECT p, q, sum(q) OVER (ORDER BY v) - q AS below, sum(p) OVER (ORDER BY v DESC) AS tp, sum(p + q) OVER (ORDER BY v DESC) AS n FROM y{n}), o{n} AS (SELECT sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auc, CASE WHEN sum(p) > 0 THEN sum(p * (tp / nullif(n, 0))) / sum(p) END AS ap FROM z{n})"


@query(with_(CAND + WEIGHTS + "".join((WAUC + WAP + SEEN).format(n=n, v=v) for n, v in ((1, "score"), (2, "score2"))), """, br AS (SELECT b, sum(e1 * w) / sum(n * w) - sum(e2 * w) / sum(n * w) AS d FROM (SELECT g, count(*) AS n, sum(pow((truth >= 0.23)::INT - score / 1000, 2)) AS e1, sum(pow((truth >= 0.23)::INT - score2 / 100, 2)) AS e2 FROM cand GROUP BY g) JOIN wt USING (g) GROUP BY b)
SELECT 'auc' AS metric, (SELECT round(o1.auc - o2.auc, 6) FROM o1, o2) AS delta, round(quantile_cont(a1.auc - a2.auc, 0.025), 6) AS low, round(quantile_cont(a1.auc - a2.auc, 0.975), 6) AS high, count(*) AS replicates FROM a1 JOIN a2 USING (b)
UNION ALL SELECT 'ap', (SELECT round(o1.ap - o2.ap, 6) FROM o1, o2), round(quantile_cont(p1.ap - p2.ap, 0.025), 6), round(quantile_cont(p1.ap - p2.ap, 0.975), 6), count(p1.ap - p2.ap) FROM p1 JOIN p2 USING (b)
UNION ALL SELECT 'brier', (SELECT round((sum(pow((truth >= 0.23)::INT - score / 1000, 2)) - sum(pow((truth >= 0.23)::INT - score2 / 100, 2))) / count(*), 6) FROM cand), round(quantile_cont(d, 0.025), 6), round(quantile_cont(d, 0.975), 6), count(*) FROM br"""))
def bootstrap_metric_delta(spark, sf):
    d = stored(_labelled(spark, sf).select("g", "y", (F.col("score") / 1000).alias("pa"), (F.col("score2") / 100).alias("pb")), "scored")
    return rounded(bootstrap.metric_difference(d, "y", "pa", "pb", "g", B))


AGREE = "CASE WHEN g % 2 = 0 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END"


@query(with_(CAND, f"""SELECT g, CASE WHEN one THEN 'rank1_correct' WHEN any_y THEN 'rescuable' WHEN j >= 0.8 AND j >= 0.8 THEN 'stable_wrong' ELSE 'sampling_failure' END AS class, all_y AS all_acceptable FROM (
SELECT g, bool_or(rank = 1 AND truth >= 0.95) AS one, bool_or(truth >= 0.95) AS any_y, bool_and(truth >= 0.95) AS all_y, max({AGREE}) AS j FROM cand GROUP BY g)"""))
def system_classes(spark, sf):
    d = candidates(spark, sf).withColumns({"y": F.col("truth") >= 0.95, "j": F.when(F.col("g") % 2 == 0, 0.9).otherwise(0.1)})
    return stats.system_classes(d, "y", "g", "rank", "j", "j")


@query(with_(CAND + PICK.format(s="score"), "SELECT p.g, p.truth AS pick_truth, m.best AS best_truth, round(m.best - p.truth, 6) AS gap FROM pick p JOIN (SELECT g, max(truth) AS best FROM cand GROUP BY g) m ON p.g = m.g"))
def oracle_gap(spark, sf):
    d = candidates(spark, sf)
    best = d.groupBy("g").agg(F.max("truth").alias("best_truth"))
    return selectors.top1(d, "score", "g", ["id"]).select("g", F.col("truth").alias("pick_truth")).join(best, "g").select("g", "pick_truth", "best_truth", r(F.col("best_truth") - F.col("pick_truth")).alias("gap"))


CLUSTER = "CASE WHEN id % 7 = 0 THEN -1 ELSE id % 3 + 1 END"


@query(with_(CAND, f"""SELECT g, cluster, size, mean_score, positives, rank() OVER (PARTITION BY g ORDER BY size DESC)::INT AS rank_by_size, rank() OVER (PARTITION BY g ORDER BY mean_score DESC)::INT AS rank_by_score, round(positives / size, 6) AS purity FROM (
SELECT g, {CLUSTER} AS cluster, count(*) AS size, round(avg(score), 6) AS mean_score, count(*) FILTER (truth >= 0.23) AS positives FROM cand WHERE id % 7 <> 0 GROUP BY ALL)"""))
def cluster_summary(spark, sf):
    return rounded(pairs.cluster_summary(_labelled(spark, sf).withColumn("cluster", F.expr(CLUSTER)), "g", "cluster", "score", "y"))


SYS = ", sy AS (SELECT g, count(*) AS members, max(truth) FILTER (rank = 1) AS rank1_truth, max(score) FILTER (rank = 1) AS rank1_score, max(truth) AS best_truth, min(truth) AS worst_truth, max(truth) - min(truth) AS truth_range, count(*) FILTER (truth >= 0.23) AS n_acceptable, bool_or(truth BETWEEN 0.18 AND 0.28) AS near_threshold FROM cand GROUP BY g)"


@query(with_(CAND + SYS, "SELECT count(*) AS rows, round(avg((rank1_truth >= 0.23)::INT), 6) AS rate, round(corr(ra, rb), 6) AS rho FROM (SELECT *, " + AVG.format(v="rank1_score", p="1") + " AS ra, " + AVG.format(v="rank1_truth", p="1") + " AS rb FROM sy)"))
def system_metric_performance(spark, sf):
    s = cohort.system_metrics(candidates(spark, sf), "g", "rank", "truth", "score")
    return rounded(stats.metric_performance(s, "rank1_score", "rank1_truth").select("rows", "rate", "rho"))


@query(with_(CAND + PICK.format(s="score"), "SELECT truth >= 0.23 AS acceptable, count(*) AS n, round(median(score), 6) AS median_score, round(median(score2), 6) AS median_score2 FROM pick WHERE fold < 3 GROUP BY 1"))
def split_medians(spark, sf):
    p = selectors.top1(candidates(spark, sf), "score", "g", ["id"]).where("fold < 3")
    return p.groupBy(Y().alias("acceptable")).agg(F.count(F.lit(1)).alias("n"), r(F.median("score")).alias("median_score"), r(F.median("score2")).alias("median_score2"))


# windows


@query(with_(CAND, "SELECT g, id, " + AVG.format(v="v", p="g") + " AS avg_rank FROM (SELECT g, id, CASE WHEN id % 11 = 0 THEN NULL ELSE score2 END AS v FROM cand)"))
def avg_rank(spark, sf):
    d = candidates(spark, sf).withColumn("v", F.when(F.col("id") % 11 != 0, F.col("score2")))
    return d.select("g", "id", windows.avg_rank("v", "g").alias("avg_rank"))


@query(with_(CAND, "SELECT g, id, round((" + AVG.format(v="score", p="g") + ") / count(*) OVER (PARTITION BY g) - 0.5, 6) AS within_rank FROM cand"))
def within_rank(spark, sf):
    return candidates(spark, sf).select("g", "id", r(windows.centred_rank("score", "g")).alias("within_rank"))


@query(with_(CAND, "SELECT g, id, round(coalesce((score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0), 0), 6) AS z FROM cand WINDOW w AS (PARTITION BY g)"))
def z_within(spark, sf):
    return candidates(spark, sf).select("g", "id", r(windows.z_within("score", "g")).alias("z"))


@query(with_(CAND, "SELECT g, id, CASE WHEN c IS NOT NULL THEN round(count(*) OVER (PARTITION BY g, c) / count(*) OVER (PARTITION BY g), 6) END AS support FROM (SELECT g, id, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 7 = 0 THEN -1 ELSE id % 3 END AS c FROM cand)"))
def cluster_support(spark, sf):
    d = candidates(spark, sf).withColumn("c", F.expr("CASE WHEN id % 13 = 0 THEN NULL WHEN id % 7 = 0 THEN -1 ELSE id % 3 END"))
    return d.select("g", "id", r(windows.share_of_group("c", "g")).alias("support"))
