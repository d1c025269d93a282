"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bindings import CAND, candidates, table, with_
from ..functions import columns as c
from ..functions.windows import imputed
from ..operators import stats
from ..plans import models
from .registry import query, r
from .statistics import AUC


@query("SELECT l_orderkey AS system, l_partkey AS member, l_linenumber AS slot, l_quantity AS amount FROM lineitem WHERE l_returnflag = 'R'")
def normalize_source(spark, sf):
    d = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return d.withColumnsRenamed({"l_orderkey": "system", "l_partkey": "member", "l_linenumber": "slot", "l_quantity": "amount"}).select("system", "member", "slot", "amount")


@query("SELECT l_orderkey, CASE WHEN l_quantity / 2 = floor(l_quantity / 2) THEN (l_quantity / 2)::BIGINT END AS half, l_orderkey::VARCHAR AS key_text FROM lineitem")
def normalize_keys(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", c.whole_number(F.col("l_quantity") / 2).alias("half"), F.col("l_orderkey").cast("string").alias("key_text"))


MESSY = "CASE id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN '-Infinity' WHEN 2 THEN 'abc' WHEN 3 THEN '' ELSE CAST(id AS {t}) END"


@query(with_(CAND, "SELECT id, CASE WHEN id % 5 = 4 THEN id::DOUBLE END AS clean FROM cand"))
def numeric_clean(spark, sf):
    d = candidates(spark, sf).withColumn("text", F.expr(MESSY.format(t="string")))
    return d.select("id", c.finite("text").alias("clean"))


BOOLS = "CASE id % 4 WHEN 0 THEN ' True' WHEN 1 THEN 'false' WHEN 2 THEN 'yes' ELSE NULL END"


@query(with_(CAND, f"SELECT id, coalesce(lower(trim(t)) = 'true', false) AS lenient, CASE WHEN lower(trim(t)) = 'true' THEN true WHEN lower(trim(t)) = 'false' THEN false END AS strict FROM (SELECT id, {BOOLS} AS t FROM cand)"))
def bool_parse(spark, sf):
    d = candidates(spark, sf).withColumn("t", F.expr(BOOLS))
    return d.select("id", c.parsed_bool("t").alias("lenient"), c.parsed_bool("t", strict=True).alias("strict"))


@query(with_(CAND, "SELECT id, truth >= 0.23 AS acceptable FROM cand"))
def label_threshold(spark, sf):
    return candidates(spark, sf).select("id", c.acceptable("truth").alias("acceptable"))


@query(with_(CAND, "SELECT id, CASE WHEN truth < 0.23 THEN 'incorrect' WHEN truth < 0.49 THEN 'acceptable' WHEN truth < 0.8 THEN 'medium' ELSE 'high' END AS band FROM cand"))
def quality_band(spark, sf):
    return candidates(spark, sf).select("id", c.quality_band("truth").alias("band"))


@query(with_(CAND, "SELECT g, CASE WHEN one THEN 'success' WHEN any_y THEN 'ranking' WHEN near THEN 'near_miss' ELSE 'sampling' END AS failure_type FROM (SELECT g, bool_or(rank = 1 AND truth >= 0.9) AS one, bool_or(truth >= 0.9 AND rank <= 5) AS any_y, bool_or(truth BETWEEN 0.8 AND 0.9 AND rank <= 5) AS near FROM cand GROUP BY g)"))
def failure_type(spark, sf):
    g = candidates(spark, sf).groupBy("g").agg(F.bool_or(F.expr("rank = 1 AND truth >= 0.9")).alias("one"), F.bool_or(F.expr("truth >= 0.9 AND rank <= 5")).alias("any_y"), F.bool_or(F.expr("truth BETWEEN 0.8 AND 0.9 AND rank <= 5")).alias("near"))
    return g.select("g", c.first_true([(F.col("one"), "success"), (F.col("any_y"), "ranking"), (F.col("near"), "near_miss")], "sampling").alias("failure_type"))


@query(with_(CAND, "SELECT id, truth BETWEEN 0.18 AND 0.28 AS near FROM cand"))
def near_threshold(spark, sf):
    return candidates(spark, sf).select("id", F.col("truth").between(0.18, 0.28).alias("near"))


@query(with_(CAND, "SELECT id, -score AS minus_score, NULL::DOUBLE AS minus_absent FROM cand"))
def orient_features(spark, sf):
    return candidates(spark, sf).select("id", (-F.col("score")).alias("minus_score"), F.lit(None).cast("double").alias("minus_absent"))


@query("SELECT l_orderkey, l_partkey, least(l_quantity, l_discount * 100, l_tax * 1000) AS low, greatest(l_quantity, l_discount * 100, l_tax * 1000) AS high, round(l_extendedprice / nullif(l_quantity, 0), 6) AS ratio FROM lineitem")
def rowwise_extrema(spark, sf):
    x = [F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 1000]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.least(*x).alias("low"), F.greatest(*x).alias("high"), r(c.ratio("l_extendedprice", "l_quantity")).alias("ratio"))


@query(with_(CAND, "SELECT id, round(coalesce(s, median(s) OVER (PARTITION BY g), 2.0::DOUBLE), 6) AS filled FROM (SELECT id, g, CASE WHEN id % 3 = 0 OR g % 10 = 0 THEN NULL ELSE score END AS s FROM cand)"))
def impute_two_level(spark, sf):
    d = candidates(spark, sf).withColumn("s", F.when((F.col("id") % 3 != 0) & (F.col("g") % 10 != 0), F.col("score")))
    return d.select("id", r(imputed("s", "g", 2.0)).alias("filled"))


@query(with_(CAND, "SELECT id, CASE kind WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' WHEN 'error' THEN 'e' ELSE '?' END AS code FROM cand"))
def dict_map(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("click", "c", "view", "v", "error", "e")])
    return candidates(spark, sf).select("id", F.coalesce(F.try_element_at(names, F.col("kind")), F.lit("?")).alias("code"))


@query(with_(CAND, "SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY truth DESC, id)::INT AS row_no FROM cand"))
def row_order(spark, sf):
    return candidates(spark, sf).select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy(F.col("truth").desc(), "id")).alias("row_no"))


@query(with_(CAND, "SELECT id, round(1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, 0.5::DOUBLE + 0.02::DOUBLE * score - 0.01::DOUBLE * score2)))), 6) AS p FROM cand"))
def logistic_score(spark, sf):
    return candidates(spark, sf).select("id", r(c.logistic(models.linear(0.5, [0.02, -0.01], ["score", "score2"]))).alias("p"))


@query(with_(CAND, "SELECT id, round((coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE score END, 10.0::DOUBLE) - 12.0) / 4.0, 6) AS z FROM cand"))
def zscore_apply(spark, sf):
    d = candidates(spark, sf).withColumn("s", F.when(F.col("id") % 3 != 0, F.col("score")))
    return d.select("id", r(c.standardised("s", 10.0, 12.0, 4.0)).alias("z"))


def _screen_sql() -> str:
    parts = [with_(CAND + AUC.format(v=v, p="1", k="", by=""), f"SELECT '{v}' AS feature, round(abs(auc - 0.5), 6) AS strength, (SELECT count({v}) FROM cand) AS present FROM auc") for v in ("score", "score2", "weight")]
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@query(_screen_sql())
def feature_screen(spark, sf):
    """Numeric columns with at least 100 values and 5 distinct ones, by |AUC - 0.5|: one unpivot, ranks by feature."""
    d = candidates(spark, sf).withColumn("y", F.col("truth") >= 0.23)
    names = [n for n, t in d.dtypes if t in ("double", "int") and n in ("score", "score2", "weight", "seed")]
    support = d.agg(*[F.struct(F.count(n).alias("n"), F.count_distinct(n).alias("d")).alias(n) for n in names]).first()
    used = [n for n in names if support[n]["n"] >= 100 and support[n]["d"] >= 5]
    long = d.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in used])).alias("x")).select("y", "x.*")
    present = long.groupBy("feature").agg(F.count("v").alias("present"))
    return stats.roc_auc(long, "y", "v", "feature").join(present, "feature").select("feature", r(F.abs(F.col("auc") - 0.5)).alias("strength"), "present")


@query(with_(CAND, ", q AS (SELECT quantile_cont(score, 0.05) AS a, quantile_cont(score, 0.95) AS b, quantile_cont(ln(1 + score2), 0.05) AS c, quantile_cont(ln(1 + score2), 0.95) AS d FROM cand)\nSELECT id, round(CASE WHEN b > a THEN least(1, greatest(0, (score - a) / (b - a))) ELSE 0 END, 6) AS scaled, round(CASE WHEN d > c THEN least(1, greatest(0, (ln(1 + score2) - c) / (d - c))) ELSE 0 END, 6) AS log_scaled FROM cand, q").replace("FROM events)\n,", "FROM events),"))
def robust_scale(spark, sf):
    """5-95 % scaling clipped to [0, 1], of one column after log1p; 0 if the quantiles are equal."""
    d = candidates(spark, sf).withColumn("l", F.log1p("score2"))
    q = d.agg(*[F.percentile(x, F.lit(p)).alias(n) for x, p, n in (("score", 0.05, "a"), ("score", 0.95, "b"), ("l", 0.05, "c"), ("l", 0.95, "d"))])
    clip = lambda x, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo))))).otherwise(0.0)
    return d.crossJoin(q).select("id", r(clip("score", "a", "b")).alias("scaled"), r(clip("l", "c", "d")).alias("log_scaled"))


# scalar functions

NAMES = "concat('o', o_orderkey, '__A1_P', o_custkey % 50, '--o', o_orderkey, '__B1_', CASE WHEN o_orderkey % 5 = 0 THEN 'UNDEFINED' ELSE concat('P', o_orderkey % 50) END)"
NAMED = f"nam AS (SELECT o_orderkey AS id, {NAMES} AS name FROM orders), acc AS (SELECT *, split_part(split_part(name, '--', 1), '_', -1) AS a, split_part(split_part(name, '--', 2), '_', -1) AS b FROM nam)"
UNKNOWN = "upper(trim({x})) IN ('', 'UNDEFINED', 'NONE', 'NAN', 'NA')"


def _named(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(NAMES).alias("name"))


@query(with_(NAMED, f"SELECT id, a AS first, b AS second, lower(split_part(name, '__', 1)) AS entry, {UNKNOWN.format(x='b')} AS unknown FROM acc"))
def accession_parse(spark, sf):
    d = _named(spark, sf)
    return d.select("id", c.accession("name", 0).alias("first"), c.accession("name", 1).alias("second"), c.entry_id("name").alias("entry"), c.is_null_token(c.accession("name", 1)).alias("unknown"))


@query(with_(NAMED, f"SELECT id, a = b AND NOT {UNKNOWN.format(x='a')} AND NOT {UNKNOWN.format(x='b')} AS same FROM acc"))
def accession_match(spark, sf):
    return _named(spark, sf).select("id", c.same_known(c.accession("name", 0), c.accession("name", 1)).alias("same"))


@query(with_(NAMED, "SELECT id, least(a, b) || '|' || greatest(a, b) AS pair FROM acc"))
def unordered_pair(spark, sf):
    return _named(spark, sf).select("id", c.unordered_pair(c.accession("name", 0), c.accession("name", 1)).alias("pair"))


@query("SELECT c_custkey, ('0x' || substr(sha256('cohort-1|' || c_name), 1, 16))::UBIGINT::DECIMAL(20,0) AS code FROM customer")
def stable_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", c.stable_hash("c_name", "cohort-1").alias("code"))


@query("SELECT l_orderkey, l_partkey, round(CASE WHEN a <> 0 THEN b / a END, 6) AS fraction, round(CASE WHEN a <> 0 THEN b * 1000.0 / a END, 6) AS per_1000, round(CASE WHEN a + b = 0 THEN 0 ELSE 2.0 * b / (a + b) END, 6) AS density FROM (SELECT l_orderkey, l_partkey, (l_quantity::INT % 4)::DOUBLE AS a, (l_linenumber % 2)::DOUBLE AS b FROM lineitem)")
def guarded_ratios(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.expr("cast(cast(l_quantity as int) % 4 as double)").alias("a"), F.expr("cast(l_linenumber % 2 as double)").alias("b"), F.lit(0.0).alias("zero"))
    return d.select("l_orderkey", "l_partkey", r(c.ratio("b", "a")).alias("fraction"), r(c.ratio("b", "a", 1000.0)).alias("per_1000"), r(c.contact_density("b", "a", "b")).alias("density"))


@query("SELECT l_orderkey, l_partkey, round(k / 2, 6) AS buried, round(ln(1 + k / 2), 6) AS log_buried FROM (SELECT l_orderkey, l_partkey, CASE WHEN l >= 0 THEN l WHEN l >= -greatest(1e-6, 1e-7 * (a + b)) THEN 0 END AS k FROM (SELECT l_orderkey, l_partkey, l_quantity * 30 AS a, l_extendedprice / 100 AS b, l_quantity * 30 + l_extendedprice / 100 - l_quantity * (30 + 5 * (l_linenumber - 3)) AS l FROM lineitem))")
def bsa_summary(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity") * 30).alias("a"), (F.col("l_extendedprice") / 100).alias("b"), F.expr("l_quantity * (30 + 5 * (l_linenumber - 3))").alias("t"))
    half, log = c.buried_area("a", "b", "t")
    return d.select("l_orderkey", "l_partkey", r(half).alias("buried"), r(log).alias("log_buried"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) < 1500")
def length_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n")).where("n < 1500")


@query("SELECT event_id, format('score {:.10g} of {:.10g}, {:.10g}', value, k / 7.0::DOUBLE, value * power(10.0::DOUBLE, event_id % 30 - 12)) AS reason FROM (SELECT event_id, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)")
def reason_text(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").select("event_id", c.reason_text("score ", F.col("value"), " of ", k / 7, ", ", F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 30 - 12)).alias("reason"))


@query("SELECT p_name, p_partkey, p_type, p_brand, p_size FROM part")
def column_contract(spark, sf):
    """Preferred columns first; prices dropped, and none may be left."""
    from ..operators.contracts import preferred_first, without_columns

    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice", "p_name")
    return preferred_first(without_columns(p, ["p_retailprice", "absent"], "price"), ["p_name", "absent", "p_partkey"])


@query("SELECT c_name AS name, c_custkey AS key, 'customer' AS source FROM customer UNION ALL SELECT s_name, s_suppkey + 1000000, 'supplier' FROM supplier")
def load_sources(spark, sf):
    """Two sources' tables, written and read with their contract."""
    import uuid

    from ..operators.cohort import load_sources as load
    from ..sources import readers

    readers.table_checkpoint(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/sources-{uuid.uuid4().hex}"
    paths = {}
    for name, sql in {"customer": "c_name as name, c_custkey as key", "supplier": "s_name as name, s_suppkey + 1000000 as key"}.items():
        paths[name] = f"{folder}/{name}.parquet"
        table(spark, sf, name).selectExpr(*sql.split(", ")).write.parquet(paths[name])
    return load(spark, paths, ["name", "key"], "key")
