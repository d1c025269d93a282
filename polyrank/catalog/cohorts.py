"""Cohort construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import CAND, candidates, table, with_
from ..operators import cohort, kernels
from .registry import query, rounded
from .statistics import SYS


def _systems(spark, sf):
    return cohort.system_metrics(candidates(spark, sf), "g", "rank", "truth", "score")


@query(with_(CAND + SYS, "SELECT g, members, rank1_truth, rank1_score, best_truth, worst_truth, round(truth_range, 6) AS truth_range, n_acceptable, near_threshold FROM sy"))
def system_metrics(spark, sf):
    return rounded(_systems(spark, sf))


SIX = SYS + ", qq AS (SELECT quantile_cont(truth_range, 0.8) AS cr, quantile_cont(rank1_score, 0.8) AS cs FROM sy), six AS (SELECT g, CASE WHEN rank1_truth >= 0.23 AND truth_range < cr THEN 1 WHEN rank1_truth >= 0.23 THEN 2 WHEN best_truth >= 0.23 AND rank1_score >= cs THEN 3 WHEN best_truth >= 0.23 THEN 4 WHEN rank1_score >= cs THEN 5 ELSE 6 END AS class_id, near_threshold FROM sy, qq)"


@query(with_(CAND + SIX, "SELECT g, class_id::INT AS class_id, (['stable_right', 'right_with_spread', 'rescuable_confident', 'rescuable', 'wrong_confident', 'wrong'])[class_id] AS class_name FROM six"))
def six_class(spark, sf):
    return cohort.six_classes(_systems(spark, sf)).select("g", "class_id", "class_name")


@query(with_(CAND + SIX, "SELECT class_id::INT AS class_id, count(*) FILTER (g % 2 = 0) AS source_0, count(*) FILTER (g % 2 = 1) AS source_1, count(*) AS total FROM six GROUP BY class_id"))
def class_summary(spark, sf):
    d = cohort.six_classes(_systems(spark, sf)).withColumn("source", (F.col("g") % 2).cast("int"))
    return cohort.class_summary(d, "class_id", "source", [0, 1])


@query(with_(CAND + SIX, "SELECT class_id::INT AS class_id, count(*) AS systems FROM six GROUP BY class_id"))
def class_partition(spark, sf):
    """Written by class and read back: each class is a folder of its own."""
    import uuid

    from ..sources import readers, writers

    readers.table_checkpoint(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/classes-{uuid.uuid4().hex}"
    writers.write_by_class(cohort.six_classes(_systems(spark, sf)).select("g", "class_id"), path, "class_id")
    return spark.read.parquet(path).groupBy("class_id").agg(F.count(F.lit(1)).alias("systems"))


@query()
def maximin_sample(spark, sf):
    """Ten systems of each class, spread out over score, range and number of acceptable members."""
    s = cohort.six_classes(_systems(spark, sf))
    return kernels.maximin_sample(s.withColumn("n", F.col("n_acceptable").cast("double")), "class_name", "g", ["rank1_score", "truth_range", "n"], 10)


@query(with_(CAND + SIX, "SELECT g, CASE WHEN class_id IN (2, 3) THEN 'class_kept_whole' WHEN near_threshold THEN 'boundary_case' WHEN g % 3 = 0 THEN 'diversity_sample' ELSE 'not_selected' END AS reason FROM six"))
def selection_reason(spark, sf):
    s = cohort.six_classes(_systems(spark, sf)).withColumn("sampled", F.col("g") % 3 == 0)
    return cohort.selection_reason(s, "class_id", "near_threshold", "sampled", [2, 3]).select("g", "reason")


@query("SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_custkey::VARCHAR), c_custkey) - 1) % 5)::INT AS fold FROM customer")
def folds_by_hash(spark, sf):
    return cohort.folds_by_hash(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


@query()
def assign_folds(spark, sf):
    return kernels.assign_folds(table(spark, sf, "customer"), "c_custkey", "c_mktsegment")


FROZEN = "ids AS (SELECT row_number() OVER (ORDER BY sha256(c_name), c_custkey)::INT AS position, c_custkey FROM customer WHERE c_custkey % 3 = 0), part_ AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0)"


@query(with_(FROZEN, "SELECT position, c_custkey, c_name, 'found' AS state FROM ids JOIN part_ USING (c_custkey) UNION ALL SELECT NULL, c_custkey, NULL, 'missing' FROM ids ANTI JOIN part_ USING (c_custkey)"))
def manifest_freeze(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    from pyspark.sql import Window

    ids = c.where("c_custkey % 3 = 0").select(F.row_number().over(Window.orderBy(F.sha2("c_name", 256), "c_custkey")).alias("position"), "c_custkey")
    found, missing = cohort.freeze_manifest(c.where("c_custkey % 2 = 0"), ids, "c_custkey", "position")
    return found.withColumn("state", F.lit("found")).unionByName(missing.withColumn("state", F.lit("missing")), allowMissingColumns=True).select("position", "c_custkey", "c_name", "state")


@query("SELECT DISTINCT kind, path FROM (SELECT 'brand' AS kind, p_brand AS path FROM part UNION ALL SELECT 'type', p_type FROM part)")
def inventory_unpivot(spark, sf):
    p = table(spark, sf, "part").withColumnsRenamed({"p_brand": "brand", "p_type": "type"})
    return cohort.inventory(p, "p_partkey", ["brand", "type"])


@query("SELECT count(*) AS jobs, count(*) * 2 AS chains, sum(length(a) + length(b))::BIGINT AS residues, count(*) FILTER (a = b) AS exact_duplicates, count(*) FILTER (a <> b) AS paired_searches, count(*) FILTER (length(a) + length(b) < 1500) AS below_limit FROM (SELECT p_name AS a, CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE p_name || p_brand END AS b FROM part)")
def plan_summary(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("a"), F.when(F.col("p_partkey") % 6 == 0, F.col("p_name")).otherwise(F.concat("p_name", "p_brand")).alias("b"))
    return cohort.plan_summary(p, "a", "b")


@query("WITH e AS (SELECT o_orderkey AS k, md5(o_orderstatus) AS want FROM orders WHERE o_orderkey % 10 <> 9), o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'late' ELSE '' END AS error, md5(CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE o_orderstatus END) AS digest FROM orders WHERE o_orderkey % 4 <> 0) SELECT coalesce(e.k, o.k) AS k, CASE WHEN e.k IS NULL THEN 'unexpected' WHEN o.k IS NULL THEN 'pending' WHEN error <> '' THEN 'failed' WHEN digest = want THEN 'complete' ELSE 'stale' END AS status FROM e FULL JOIN o ON e.k = o.k")
def job_status(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "k")
    e = o.where("k % 10 <> 9").select("k", F.md5(F.col("o_orderstatus").cast("binary")).alias("want_digest"))
    seen = o.where("k % 4 <> 0").select("k", F.when(F.col("k") % 7 == 0, "late").otherwise("").alias("error"), F.md5(F.when(F.col("k") % 11 == 0, "x").otherwise(F.col("o_orderstatus")).cast("binary")).alias("digest"))
    return cohort.job_status(e, seen, "k")


