"""Data-quality contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import CAND, MEMB, candidates, members, table, with_
from ..operators import contracts, pairs
from .registry import query, rounded

TOP = "coalesce((SELECT string_agg(k, ';' ORDER BY k) FROM (SELECT k FROM {t} ORDER BY k LIMIT 5)), '')"
VIOL = "SELECT '{c}' AS \"check\", (SELECT count(*) FROM {t}) AS n, " + TOP + " AS examples"


@query("WITH d AS (SELECT l_orderkey || ',' || l_linenumber AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) " + VIOL.format(c="duplicate_keys", t="d"))
def dq_duplicate_keys(spark, sf):
    return contracts.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH d AS (SELECT o_custkey::VARCHAR AS k FROM orders GROUP BY o_custkey HAVING count(*) <> 10) " + VIOL.format(c="group_size", t="d"))
def dq_group_size(spark, sf):
    return contracts.group_size(table(spark, sf, "orders"), "o_custkey", 10)


@query(with_(CAND, ", n AS (SELECT CASE WHEN id % 11 = 0 THEN NULL ELSE score END AS score, CASE WHEN id % 3 = 0 THEN NULL ELSE score2 END AS score2, truth FROM cand)\n" + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) - count({f}) AS missing, round((count(*) - count({f})) / count(*), 6) AS fraction, (count(*) - count({f})) / count(*) <= 0.2 AS ok FROM n" for f in ("score", "score2", "truth"))).replace("FROM events)\n,", "FROM events),"))
def dq_missingness(spark, sf):
    d = candidates(spark, sf).select(F.when(F.col("id") % 11 != 0, F.col("score")).alias("score"), F.when(F.col("id") % 3 != 0, F.col("score2")).alias("score2"), "truth")
    return rounded(contracts.missingness(d, ["score", "score2", "truth"], 0.2))


@query(with_(CAND, "SELECT fold, count(*) FILTER (truth >= 0.23) AS positives, count(*) FILTER (truth < 0.23) AS negatives, bool_or(truth >= 0.23) AND bool_or(truth < 0.23) AS ok FROM cand GROUP BY fold"))
def dq_two_classes(spark, sf):
    return contracts.two_classes(candidates(spark, sf).withColumn("y", F.col("truth") >= 0.23), "y", ["fold"])


@query(with_(CAND, "SELECT CASE WHEN id % 3 = 0 THEN 'swapped' ELSE 'direct' END AS mode, count(*) AS rows, count(*) FILTER (id % 3 = 0 AND seed <> 1) AS violations FROM cand GROUP BY 1"))
def dq_mapping_policy(spark, sf):
    d = candidates(spark, sf).withColumn("mode", F.when(F.col("id") % 3 == 0, "swapped").otherwise("direct"))
    return contracts.mapping_policy(d, "mode", {"direct": F.lit(True), "swapped": F.col("seed") == 1})


@query(with_(CAND, """, f AS (SELECT g, CASE WHEN id % 500 = 0 THEN 7 ELSE fold END AS fold FROM cand), a AS (SELECT g::VARCHAR AS k FROM f GROUP BY g HAVING count(DISTINCT fold) > 1),
b AS (SELECT e::VARCHAR AS k FROM range(6) t(e) WHERE e NOT IN (SELECT fold FROM f)), c AS (SELECT DISTINCT fold::VARCHAR AS k FROM f WHERE fold NOT IN (0, 1, 2, 3, 4, 5))
""" + " UNION ALL ".join(f"SELECT * FROM ({VIOL.format(c=c, t=t)})" for c, t in (("several_folds", "a"), ("missing_folds", "b"), ("unexpected_folds", "c")))).replace("FROM events)\n,", "FROM events),"))
def dq_fold_integrity(spark, sf):
    d = candidates(spark, sf).withColumn("fold", F.when(F.col("id") % 500 == 0, 7).otherwise(F.col("fold")))
    return contracts.fold_integrity(d, "g", "fold", [0, 1, 2, 3, 4, 5])


@query(with_(CAND, ", d AS (SELECT id::VARCHAR AS k FROM cand WHERE id % 701 = 0 OR id % 907 = 0) " + VIOL.format(c="status", t="d")).replace("FROM events)\n,", "FROM events),"))
def dq_status(spark, sf):
    d = candidates(spark, sf).withColumns({"status": F.when(F.col("id") % 701 == 0, "failed").otherwise("ok"), "error": F.when(F.col("id") % 907 == 0, "late")})
    return contracts.status_ok(d, "status", "error", "id")


@query("WITH d AS (SELECT o_custkey::VARCHAR AS k FROM orders GROUP BY o_custkey HAVING list_sort(list(DISTINCT o_orderkey % 4)) <> [0, 1, 2, 3]) " + VIOL.format(c="expected_set", t="d"))
def dq_expected_set(spark, sf):
    d = table(spark, sf, "orders").select("o_custkey", F.expr("cast(o_orderkey % 4 as int)").alias("seed"))
    return contracts.expected_set(d, "o_custkey", "seed", [0, 1, 2, 3])


@query(with_(CAND, "SELECT 'truth' AS feature, count(*) FILTER (truth < 0.05 OR truth > 0.95) AS violations FROM cand UNION ALL SELECT 'score', count(*) FILTER (score < 0.05 OR score > 0.95) FROM cand"))
def dq_range(spark, sf):
    return contracts.in_range(candidates(spark, sf), ["truth", "score"], 0.05, 0.95)


@query("WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 5) SELECT (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS both, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS left_only, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS right_only")
def dq_keyset_equal(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return contracts.keyset_equal(a, table(spark, sf, "lineitem").where("l_quantity > 5").select(F.col("l_orderkey").alias("k")), ["k"])


@query(with_(MEMB, """, n AS (SELECT g, weight, count(*) AS c FROM memb GROUP BY ALL), e AS (SELECT unnest([1, 2, 3, 4]) AS w)
SELECT g, array_to_string(list_sort([x::VARCHAR FOR x IN [1, 2, 3, 4] IF NOT list_contains(list(weight), x)]), ';') AS missing,
array_to_string(list_sort([x::VARCHAR FOR x IN list(weight) IF NOT list_contains([1, 2, 3, 4], x)]), ';') AS unexpected,
coalesce(array_to_string(list_sort(list(weight::VARCHAR) FILTER (c > 1)), ';'), '') AS duplicate FROM n GROUP BY g""").replace("y.id AND s.g = x.g)\n,", "y.id AND s.g = x.g),"))
def dq_member_diff(spark, sf):
    return contracts.member_diff(members(spark, sf), "g", "weight", [1, 2, 3, 4])


@query(with_(MEMB, "SELECT g, count(*) AS members, (sum(c) / 2)::BIGINT AS pairs, min(c) = count(*) - 1 AND max(c) = count(*) - 1 AS complete FROM (SELECT g, m, count(*) AS c FROM (SELECT g, a AS m FROM prs UNION ALL SELECT g, b FROM prs) GROUP BY ALL) GROUP BY g"))
def dq_pair_coverage(spark, sf):
    return contracts.pair_coverage(pairs.within_groups(members(spark, sf), "g", "id", []), "g", "a_id", "b_id")


@query(with_(CAND, ", d AS (SELECT g::VARCHAR AS k FROM cand GROUP BY g HAVING count(*) FILTER (truth >= 0.99) <> 1) " + VIOL.format(c="one_selected", t="d")).replace("FROM events)\n,", "FROM events),"))
def dq_one_selected(spark, sf):
    return contracts.one_selected(candidates(spark, sf).withColumn("f", F.col("truth") >= 0.99), "g", "f")


@query("SELECT c_nationkey::VARCHAR AS key, 'c_mktsegment' AS attribute, count(DISTINCT c_mktsegment) AS \"values\" FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1")
def dq_conflicts(spark, sf):
    d = table(spark, sf, "customer").withColumn("same", F.col("c_nationkey") % 5)
    return contracts.conflicts(d, "c_nationkey", ["c_mktsegment", "same"])


@query(with_(CAND, "SELECT (truth < 0.23)::INT + (truth >= 0.23 AND truth < 0.5)::INT + (truth >= 0.48)::INT AS classes, count(*) AS rows FROM cand GROUP BY 1"))
def dq_partition(spark, sf):
    return contracts.partition_exact(candidates(spark, sf), {"a": F.expr("truth < 0.23D"), "b": F.expr("truth >= 0.23D and truth < 0.5D"), "c": F.expr("truth >= 0.48D")})


AUDIT = "SELECT 'rows' AS metric, count(*) AS value FROM cand UNION ALL SELECT 'groups', count(DISTINCT g) FROM cand UNION ALL SELECT 'folds', count(DISTINCT fold) FROM cand UNION ALL SELECT 'positives', count(*) FILTER (truth >= 0.23) FROM cand UNION ALL SELECT 'missing_labels', count(*) FILTER (truth IS NULL) FROM cand"


@query(with_(CAND, AUDIT))
def dq_audit_summary(spark, sf):
    return contracts.audit_summary(candidates(spark, sf).withColumn("y", F.col("truth") >= 0.23), "g", "fold", "y")


@query(with_(CAND, "SELECT 'table' AS metric, 'rows' AS key, count(*) AS value FROM cand UNION ALL SELECT 'table', 'groups', count(DISTINCT g) FROM cand UNION ALL SELECT 'missing', 'score', count(*) - count(score) FROM cand UNION ALL SELECT 'missing', 'truth', count(*) - count(truth) FROM cand UNION ALL SELECT 'kind', kind, count(*) FROM cand GROUP BY kind"))
def dq_report(spark, sf):
    return contracts.quality_report(candidates(spark, sf), "g", ["score", "truth"], "kind")


RELEASE = """ex AS (SELECT c_mktsegment AS name, count(*) + (c_mktsegment = 'BUILDING')::INT AS rows, md5(string_agg(c_name, ',' ORDER BY c_custkey)) AS sha256 FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_mktsegment),
ob AS (SELECT c_mktsegment AS name, count(*) AS rows, md5(string_agg(c_name, ',' ORDER BY c_custkey)) AS sha256 FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY c_mktsegment)"""


@query(with_(RELEASE, """SELECT gate, count(name) AS n, coalesce(string_agg(name, ';' ORDER BY name), '') AS examples FROM (VALUES ('missing'), ('unexpected'), ('listed_twice'), ('rows'), ('digest'), ('absolute_path'), ('forbidden_columns')) g(gate) LEFT JOIN (
SELECT 'missing' AS gate, name FROM ex ANTI JOIN ob USING (name) UNION ALL SELECT 'unexpected', name FROM ob ANTI JOIN ex USING (name) UNION ALL SELECT 'rows', ex.name FROM ex JOIN ob USING (name) WHERE ex.rows <> ob.rows
UNION ALL SELECT 'absolute_path', name FROM ob WHERE name = 'AUTOMOBILE' UNION ALL SELECT 'forbidden_columns', name FROM ob WHERE name = 'HOUSEHOLD') USING (gate) GROUP BY gate"""))
def release_gates(spark, sf):
    c = table(spark, sf, "customer")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), ",")
    a = c.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.md5(names.cast("binary")).alias("sha256"))
    expected = a.where("name <> 'MACHINERY'").withColumn("rows", F.col("rows") + (F.col("name") == "BUILDING").cast("int"))
    path = F.concat(F.when(F.col("name") == "AUTOMOBILE", "/").otherwise(""), F.lit("out/"), F.col("name"))
    observed = a.where("name <> 'FURNITURE'").withColumns({"path": path, "columns": F.array(F.lit("id"), F.when(F.col("name") == "HOUSEHOLD", "truth").otherwise("score"))})
    return contracts.release_gates(expected, observed)
