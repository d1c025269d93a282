"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import ATOM, CAND, MEMB, atoms, candidates, members, table, with_
from ..functions.columns import is_null_token, unordered_pair
from ..operators import geometry, joins, selectors, sets, stats
from .registry import query, r, rounded
from .statistics import MET

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
PARTS = """a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem WHERE l_linenumber <> 7),
b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount FROM lineitem WHERE l_quantity <> 3),
c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber + CASE WHEN l_tax = 0.08 THEN 100 ELSE 0 END AS l_linenumber, l_extendedprice, l_tax FROM lineitem)"""
ON = " AND ".join(f"a.{k} = {{x}}.{k}" for k in KEY)


def _parts(spark, sf):
    d = table(spark, sf, "lineitem")
    shifted = d.withColumn("l_linenumber", F.col("l_linenumber") + F.when(F.col("l_tax") == 0.08, 100).otherwise(0))
    return d.where("l_linenumber <> 7").select(*KEY, "l_quantity"), d.where("l_quantity <> 3").select(*KEY, "l_discount"), shifted.select(*KEY, "l_tax")


@query(with_(PARTS, f"SELECT count(*) AS rows, count(*) FILTER (a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL) AS both, count(*) FILTER (b.l_orderkey IS NULL) AS left_only, count(*) FILTER (a.l_orderkey IS NULL) AS right_only FROM a FULL JOIN b ON {ON.format(x='b')}"))
def join_exact_audit(spark, sf):
    a, b, _ = _parts(spark, sf)
    return joins.audit(joins.outer_with_flags(a, b, KEY))


@query(with_(PARTS, " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) FILTER (a.l_orderkey IS NOT NULL AND {x}.l_orderkey IS NOT NULL) AS both, count(*) FILTER ({x}.l_orderkey IS NULL) AS left_only, count(*) FILTER (a.l_orderkey IS NULL) AS right_only FROM a FULL JOIN {x} ON {ON.format(x=x)}" for n, x in (("discounts", "b"), ("taxes", "c")))))
def join_outer_audit(spark, sf):
    a, b, c = _parts(spark, sf)
    return joins.join_with_audit(a, {"discounts": b, "taxes": c}, KEY)[1]


@query("SELECT o.o_custkey, o.o_orderkey, o.o_totalprice, round(s.total, 2) AS total FROM orders o JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) s USING (o_custkey)")
def join_m1_exact(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    s = o.groupBy("o_custkey").agg(r(F.sum("o_totalprice"), 2).alias("total"))
    return joins.exact_join(o, s, ["o_custkey"], many_to_one=True).select("o_custkey", "o_orderkey", "o_totalprice", "total")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) ON o_custkey = c_custkey")
def join_m1_left(spark, sf):
    c = table(spark, sf, "customer").where("c_nationkey <> 3")
    return joins.lookup(table(spark, sf, "orders"), c, {"o_custkey": "c_custkey"}, {"c_mktsegment": "c_mktsegment"}).select("o_orderkey", "c_mktsegment")


@query(with_(MEMB, "SELECT p.g, p.a, p.b, round(x.score, 6) AS a_score, round(y.score, 6) AS b_score FROM prs p JOIN memb x ON x.g = p.g AND x.id = p.a JOIN memb y ON y.g = p.g AND y.id = p.b"))
def join_lookup_other(spark, sf):
    from ..operators import pairs

    m = members(spark, sf)
    p = pairs.within_groups(m, "g", "id", [])
    p = joins.lookup(p, m, {"g": "g", "a_id": "id"}, {"score": "a_score"})
    p = joins.lookup(p, m, {"g": "g", "b_id": "id"}, {"score": "b_score"})
    return rounded(p.select("g", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_score", "b_score"))


@query("SELECT l_orderkey, l_partkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10")
def join_inner_keys(spark, sf):
    p = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, sf, "lineitem").join(p, "l_partkey").select("l_orderkey", "l_partkey", "p_brand")


@query("SELECT o_orderkey, o_orderstatus AS left_value, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS right_value FROM orders WHERE o_orderkey % 9 = 0")
def join_agreement(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    other = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus")))
    return joins.agreement(o, other, ["o_orderkey"], "o_orderstatus")


@query("SELECT c_custkey, c_name, position::INT AS position FROM customer JOIN (SELECT unnest([17, 3, 99, 42, 5]) AS c_custkey, unnest([0, 1, 2, 3, 4]) AS position) USING (c_custkey)")
def semi_ordered(spark, sf):
    return joins.semi_in_list_order(table(spark, sf, "customer"), [17, 3, 99, 42, 5], "c_custkey").select("c_custkey", "c_name", "position")


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_mktsegment = 'BUILDING') USING (o_custkey)")
def anti_exclude(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.exclude(table(spark, sf, "orders"), c, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query(with_(MEMB, "SELECT g, a AS a_id, b AS b_id, seed_a AS a_seed, seed_b AS b_seed FROM prs"))
def pairs_within_group(spark, sf):
    from ..operators import pairs

    return pairs.within_groups(members(spark, sf), "g", "id", ["seed"])


@query(with_(ATOM, "SELECT g, a, b, ra, rb, round(d2, 9) AS d2 FROM near WHERE d2 < 0.15::DOUBLE * 0.15::DOUBLE"))
def distance_join(spark, sf):
    return geometry.near_atoms(atoms(spark, sf), 0.15).select("g", "a", "b", "ra", "rb", r("d2", 9).alias("d2"))


@query(with_(CAND, "SELECT g, id, score >= (SELECT quantile_cont(score, 0.8) FROM cand) AS high FROM cand"))
def quantile_flags(spark, sf):
    d = candidates(spark, sf)
    return joins.with_scalar(d, d.agg(F.percentile("score", F.lit(0.8)).alias("q"))).select("g", "id", (F.col("score") >= F.col("q")).alias("high"))


# set operations


@query("SELECT c_custkey AS key, c_nationkey AS nation, NULL::DOUBLE AS balance, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal, 'supplier' FROM supplier")
def union_tagged(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return sets.union_tagged({"customer": a, "supplier": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))})


@query("SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def keyset_intersect(spark, sf):
    d = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    return sets.intersection(d.where("l_returnflag = 'A'"), d.where("l_returnflag = 'R'"), ["k"])


@query("WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') SELECT k, 'missing_right' AS side FROM a ANTI JOIN b USING (k) UNION ALL SELECT k, 'missing_left' FROM b ANTI JOIN a USING (k)")
def keyset_diff(spark, sf):
    d = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    return sets.difference(d.where("l_returnflag = 'A'"), d.where("l_returnflag = 'R'"), ["k"])


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1")
def dedupe_first(spark, sf):
    d = sets.keep_first(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey")


LEVELS = {
    "text": "text",
    "folded": "lower(trim(text))",
    "prefix": "substr(text, 1, 64)",
    "start": "substr(text, 1, 20)",
    "pair": "CASE WHEN upper(coalesce(source, '')) IN ('', 'UNDEFINED', 'NONE', 'NAN', 'NA') OR upper(coalesce(lang, '')) IN ('', 'UNDEFINED', 'NONE', 'NAN', 'NA') THEN NULL ELSE least(source, lang) || '|' || greatest(source, lang) END",
}
LONG = "lv AS (SELECT doc_id, level, md5(v) AS value FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS level, {e} AS v FROM documents" for n, e in LEVELS.items()) + ") WHERE v IS NOT NULL), la AS (SELECT * FROM lv WHERE doc_id % 2 = 0), lb AS (SELECT * FROM lv WHERE doc_id % 2 = 1)"


def _levels(spark, sf, side):
    """Five identities of a document, as digests: what is compared and shuffled doesn't grow with the texts."""
    d = table(spark, sf, "documents").where(F.col("doc_id") % 2 == side)
    known = ~(is_null_token(F.col("source")) | is_null_token(F.col("lang")))
    values = {"text": F.col("text"), "folded": F.lower(F.trim(F.col("text"))), "prefix": F.substring("text", 1, 64), "start": F.substring("text", 1, 20), "pair": F.when(known, unordered_pair("source", "lang"))}
    return sets.levels_long(d, "doc_id", {n: F.md5(v.cast("binary")) for n, v in values.items()})


@query(with_(LONG + ", n AS (SELECT level, value, count(DISTINCT doc_id) FILTER (doc_id % 2 = 0) AS n_a, count(DISTINCT doc_id) FILTER (doc_id % 2 = 1) AS n_b FROM lv GROUP BY ALL)", "SELECT DISTINCT level, value, CASE doc_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS side, doc_id::VARCHAR AS id, n_a, n_b FROM lv JOIN n USING (level, value) WHERE n_a > 0 AND n_b > 0"))
def overlap_audit(spark, sf):
    return sets.overlap_audit(_levels(spark, sf, 0), _levels(spark, sf, 1))


@query(with_(LONG + ", n AS (SELECT a.level, count(DISTINCT a.value) AS n FROM la a SEMI JOIN lb b ON a.level = b.level AND a.value = b.value GROUP BY a.level)", "SELECT coalesce(sum(n) FILTER (level IN ('text', 'folded')), 0)::BIGINT AS strict_overlaps, coalesce(sum(n) FILTER (level IN ('text', 'folded')), 0) = 0 AS passed FROM n"))
def overlap_gate(spark, sf):
    return sets.overlap_gate(sets.overlap_counts(_levels(spark, sf, 0), _levels(spark, sf, 1), list(LEVELS)), ["text", "folded"])


@query(with_(CAND + ", pk AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, id) = 1), ov AS (SELECT DISTINCT user_id AS g FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)), bo AS (SELECT 'all' AS subset, truth FROM pk UNION ALL SELECT 'without_overlap', truth FROM pk ANTI JOIN ov USING (g))", f"SELECT subset, {MET} FROM bo GROUP BY subset"))
def overlap_sensitivity(spark, sf):
    p = selectors.top1(candidates(spark, sf), "score", "g", ["id"])
    other = table(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("key"))
    both = p.withColumn("subset", F.lit("all")).unionByName(sets.without_overlaps(p, "g", other).withColumn("subset", F.lit("without_overlap")))
    return rounded(stats.selector_metrics(both, "truth", "subset"))
