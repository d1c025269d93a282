"""How roles are bound to the driver's tables: as DataFrames, and as the same common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candidates: a user is a group, k / 100 of the properties the truth."""
    e = table(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("g"), F.col("event_id").alias("id"), F.col("value").alias("score"), F.expr("cast((event_id * 37) % 101 as double)").alias("score2"), F.expr("cast(get_json_object(props, '$.k') as double) / 100").alias("truth"), F.expr("cast(user_id % 5 as int)").alias("fold"), F.expr("cast(event_id % 5 + 1 as int)").alias("weight"), F.expr("cast(event_id % 4 as int)").alias("seed"), F.col("event_type").alias("kind"), rank.alias("rank"))


CAND = """cand AS (SELECT user_id AS g, event_id AS id, value AS score, ((event_id * 37) % 101)::DOUBLE AS score2,
  (json_extract_string(props, '$.k'))::DOUBLE / 100 AS truth, (user_id % 5)::INT AS fold, (event_id % 5 + 1)::INT AS weight,
  (event_id % 4)::INT AS seed, event_type AS kind, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS rank FROM events)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates of their customer, with the distinct contacts (part % 40, supplier % 7) of their lines as a sorted array."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.expr("cast(o_orderkey % 4 as int)").alias("seed"), F.expr("cast(o_orderkey % 5 + 1 as int)").alias("weight"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.expr("cast(l_partkey % 40 as int)").alias("ra"), F.expr("cast(l_suppkey % 7 as int)").alias("rb")).alias("c"))
    sets = lines.groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("contacts"))
    return o.join(sets, "id", "left").withColumn("contacts", F.coalesce("contacts", F.expr("cast(array() as array<struct<ra:int,rb:int>>)")))


MEMB = """memb AS (SELECT o_custkey AS g, o_orderkey AS id, o_totalprice AS score, (o_orderkey % 4)::INT AS seed, (o_orderkey % 5 + 1)::INT AS weight FROM orders),
con AS (SELECT DISTINCT o.o_custkey AS g, l.l_orderkey AS id, (l_partkey % 40)::INT AS ra, (l_suppkey % 7)::INT AS rb FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
siz AS (SELECT m.*, coalesce(n, 0) AS n FROM memb m LEFT JOIN (SELECT id, count(*) AS n FROM con GROUP BY id) USING (id)),
shr AS (SELECT a.g, a.id AS a, b.id AS b, count(*) AS both_n FROM con a JOIN con b ON a.g = b.g AND a.ra = b.ra AND a.rb = b.rb AND a.id < b.id GROUP BY ALL),
prs AS (SELECT x.g, x.id AS a, y.id AS b, x.n AS n_a, y.n AS n_b, x.seed AS seed_a, y.seed AS seed_b, x.weight AS weight_a, y.weight AS weight_b, coalesce(both_n, 0) AS n_both,
  CASE WHEN x.n > 0 AND y.n > 0 THEN coalesce(both_n, 0)::DOUBLE / (x.n + y.n - coalesce(both_n, 0)) END AS jaccard
  FROM siz x JOIN siz y ON x.g = y.g AND x.id < y.id LEFT JOIN shr s ON s.a = x.id AND s.b = y.id AND s.g = x.g)"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as atoms: two labels make a complex, the even label side A; three vectors in a row a residue."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("cast(label div 2 as int)").alias("g"), F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("side"), F.col("vec_id").alias("atom"), F.expr("vec_id div 3").alias("res"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], F.expr("cast(vec_id % 3 as int)").alias("role"), F.expr("cast(vec_id % 5 as int)").alias("kind"))


ATOM = """atom AS (SELECT (label // 2)::INT AS g, CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END AS side, vec_id AS atom, vec_id // 3 AS res,
  embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (vec_id % 3)::INT AS role, (vec_id % 5)::INT AS kind FROM embeddings),
near AS (SELECT a.g, a.atom AS a, b.atom AS b, a.res AS ra, b.res AS rb, a.role AS role_a, b.role AS role_b, a.kind AS kind_a, b.kind AS kind_b,
  (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM atom a JOIN atom b ON a.g = b.g AND a.side = 'A' AND b.side = 'B')"""


def with_(parts: str, body: str) -> str:
    return f"WITH {parts}\n{body}"
