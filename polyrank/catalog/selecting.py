"""Selectors, sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import CAND, candidates, with_
from ..functions.windows import place
from ..operators import selectors, stats
from .registry import query, r, rounded
from .statistics import CLUSTER, MET, PICK, Y

COLS = ["g", "id", "score", "truth", "rank"]
NULLED = ", nul AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 OR g % 10 = 0 THEN NULL ELSE score END AS score) FROM cand)"


def _nulled(spark, sf):
    return candidates(spark, sf).withColumn("score", F.when((F.col("id") % 2 != 0) & (F.col("g") % 10 != 0), F.col("score")))


@query(with_(CAND + PICK.format(s="score"), "SELECT g, id, score, truth, rank FROM pick"))
def select_top1(spark, sf):
    return selectors.top1(candidates(spark, sf), "score", "g", ["id"]).select(*COLS)


@query(with_(CAND + NULLED, "SELECT DISTINCT g, first_value(score IGNORE NULLS) OVER w AS score, first_value(truth IGNORE NULLS) OVER w AS truth FROM nul WINDOW w AS (PARTITION BY g ORDER BY score DESC NULLS LAST, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"))
def select_top1_first(spark, sf):
    return stats.first_present(_nulled(spark, sf), ["score", "truth"], "g", F.col("score").desc_nulls_last(), F.col("rank"))


def _battery_sql() -> str:
    one = "SELECT '{n}' AS selector, truth FROM cand QUALIFY row_number() OVER (PARTITION BY g ORDER BY {s} DESC NULLS LAST, id) = 1"
    parts = [one.format(n="score", s="score"), one.format(n="score2", s="score2"), one.format(n="oracle", s="truth"), "SELECT 'rank1', truth FROM cand WHERE rank = 1"]
    return with_(CAND + ", al AS (" + " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts) + ")", f"SELECT selector, {MET} FROM al GROUP BY selector")


@query(_battery_sql())
def selector_battery(spark, sf):
    picks = selectors.battery(candidates(spark, sf), {"score": "score", "score2": "score2"}, "truth", "g", "rank", ["id"])
    return rounded(stats.selector_metrics(picks, "truth", "selector"))


@query(with_(CAND + NULLED, "SELECT g, id, score, truth, rank FROM nul QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC NULLS LAST, CASE WHEN score IS NULL THEN rank END NULLS LAST, id) = 1"))
def select_fallback(spark, sf):
    return selectors.top1_or_rank1(_nulled(spark, sf), "score", "g", "rank", ["id"]).select(*COLS)


@query(with_(CAND, "SELECT g, id, score, truth, rank FROM (SELECT *, max(truth) OVER (PARTITION BY g) AS best FROM cand) QUALIFY row_number() OVER (PARTITION BY g ORDER BY CASE WHEN best < 0.99 THEN rank END NULLS LAST, truth DESC, id) = 1"))
def oracle_pick(spark, sf):
    return selectors.oracle(candidates(spark, sf), "truth", "g", "rank", ["id"], 0.99).select(*COLS)


@query(with_(CAND, "SELECT g, id, score, truth, rank FROM cand WHERE rank = 1"))
def rank1_pick(spark, sf):
    return selectors.rank1(candidates(spark, sf)).select(*COLS)


@query(with_(CAND, "SELECT g, id, score, truth, rank FROM cand QUALIFY row_number() OVER (PARTITION BY g ORDER BY CASE WHEN (g % 10) / 10.0::DOUBLE < 0.5 THEN score2 ELSE -rank END DESC, id) = 1"))
def gated_select(spark, sf):
    d = candidates(spark, sf).withColumn("gate", (F.col("g") % 10) / 10)
    return selectors.gated(d, "gate", 0.5, "score2", "g", "rank", ["id"]).select(*COLS)


@query(with_(CAND, f""", cl AS (SELECT *, {CLUSTER} AS cluster FROM cand),
sz AS (SELECT g, cluster FROM (SELECT g, cluster, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, cluster) AS k FROM cl WHERE cluster <> -1 GROUP BY g, cluster) WHERE k = 2)
SELECT c.g, c.id, c.score, c.truth, c.rank FROM cl c LEFT JOIN sz s ON s.g = c.g WHERE (s.g IS NULL AND rank = 1) OR c.cluster = s.cluster
QUALIFY row_number() OVER (PARTITION BY c.g ORDER BY score DESC, id) = 1""").replace("FROM events)\n,", "FROM events),"))
def cluster_select(spark, sf):
    d = candidates(spark, sf).withColumn("cluster", F.expr(CLUSTER))
    return selectors.from_cluster(d, "cluster", "second", "score2", "score", "g", "rank", ["id"]).select(*COLS)


@query(with_(CAND, """, z AS (SELECT *, round(coalesce((score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0), 0) + coalesce((score2 - avg(score2) OVER w) / nullif(stddev_samp(score2) OVER w, 0), 0), 9) AS combo FROM cand WINDOW w AS (PARTITION BY g))
SELECT g, id, score, truth, rank, round(combo, 6) AS combo FROM z QUALIFY row_number() OVER (PARTITION BY g ORDER BY combo DESC, id) = 1""").replace("FROM events)\n,", "FROM events),"))
def combo_select(spark, sf):
    return selectors.combo(candidates(spark, sf), ["score", "score2"], "g", ["id"]).select(*COLS, r("combo").alias("combo"))


@query(with_(CAND, "SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY score2 DESC NULLS LAST, id) = 1 AS selected_by_model, row_number() OVER (PARTITION BY g ORDER BY rank, id) = 1 AS selected_by_reference FROM cand"))
def selected_flags(spark, sf):
    return selectors.flags(candidates(spark, sf), "score2", "g", "rank", ["id"]).select("g", "id", "selected_by_model", "selected_by_reference")


@query(with_(CAND + PICK.format(s="score"), "SELECT p.g, p.truth AS a_truth, c.truth AS b_truth, true AS in_a, true AS in_b FROM pick p JOIN cand c ON p.g = c.g AND c.rank = 1"))
def paired_alignment(spark, sf):
    d = candidates(spark, sf)
    return selectors.paired(selectors.top1(d, "score", "g", ["id"]), selectors.rank1(d), "truth", "g")


@query(with_(CAND, "SELECT g, id, truth, row_number() OVER (ORDER BY bad DESC, truth, id)::INT AS position FROM (SELECT g, id, truth, truth < 0.23 AS bad FROM cand WHERE rank = 1) QUALIFY position <= 50"))
def failure_cases(spark, sf):
    d = selectors.rank1(candidates(spark, sf)).withColumn("bad", ~Y())
    top = d.orderBy(F.col("bad").desc(), "truth", "id").limit(50)  # a top-k report
    return top.withColumn("one", F.lit(1)).select("g", "id", "truth", place("one", F.col("bad").desc(), F.col("truth"), F.col("id")).alias("position"))
