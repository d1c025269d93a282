"""Sources, sinks and file plumbing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..bindings import MEMB, members, table, with_
from ..sources import readers
from .registry import query, rounded


def _folder(spark) -> str:
    readers.table_checkpoint(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scan-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_csv_roundtrip(spark, sf):
    path = _folder(spark)
    columns = ["c_custkey", "c_name", "c_acctbal"]
    table(spark, sf, "customer").select(*columns).write.option("header", True).option("compression", "gzip").csv(path)
    return readers.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def scan_pruned(spark, sf):
    """Two columns and two predicates: both reach the scan."""
    return table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select("l_orderkey", "l_quantity")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 50 = 7")
def id_list_filter(spark, sf):
    o = table(spark, sf, "orders")
    lines = o.select(F.when(F.col("o_orderkey") % 50 == 7, F.concat(F.lit("  "), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 50 == 8, F.concat(F.lit("# "), F.col("o_orderkey").cast("string"))).otherwise("").alias("value"))
    ids = readers.id_lines(lines, "value")
    return o.join(ids.select(F.col("id").cast("long").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, CASE WHEN k <= 90 THEN k END AS number FROM (SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)")
def json_scalar(spark, sf):
    return table(spark, sf, "events").select("event_id", readers.json_number("props", "$.k", "$.K", high=90.0).alias("number"))


@query("SELECT o_custkey AS system, i AS rank, round(o_totalprice / (i + 1), 6) AS value FROM orders, range(2) t(i)")
def json_explode(spark, sf):
    o = table(spark, sf, "orders")
    doc = F.to_json(F.struct(F.col("o_custkey").alias("system"), F.array(*[F.struct(F.lit(i).alias("rank"), (F.col("o_totalprice") / (i + 1)).alias("value")) for i in range(2)]).alias("predictions")))
    d = readers.explode_json(o.select(doc.alias("doc")), "doc", "system long, predictions array<struct<rank:long,value:double>>", "predictions")
    return rounded(d.select("system", "rank", "value"))


@query()
def discover_files(spark, sf):
    return readers.discover(spark, sf, "*.parquet").select("name", "bytes")


@query()
def artifact_manifest(spark, sf):
    return readers.file_digests(spark, sf, "*.parquet")


@query()
def verify_files(spark, sf):
    """Expected files that are missing or empty."""
    found = readers.discover(spark, sf, "*.parquet")
    want = spark.createDataFrame([(f"{t}.parquet",) for t in ("region", "nation", "absent")], "name string")
    return want.join(found, "name", "left").select("name", F.col("bytes").isNull().alias("missing"), F.coalesce(F.col("bytes") == 0, F.lit(False)).alias("empty"))


NAMES = "concat(c_name, '_unrelaxed_rank_', lpad(cast(c_custkey % 20 as {s}), 3, '0'), '_fam_model_', c_custkey % 5 + 1, '_seed_003.pdb')"


@query("SELECT c_custkey, c_name AS file_id, (c_custkey % 20)::INT AS file_rank, 'fam' AS family, (c_custkey % 5 + 1)::INT AS model, 3::INT AS file_seed FROM customer")
def filename_parse(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.expr(NAMES.format(s="string")).alias("f"))
    return readers.parsed_file_name(d, "f").drop("f")


LETTERS = ["ALA", "GLY", "SER", "LYS", "XXX"]


def _pdb_lines(spark, sf):
    """Atoms of embeddings as fixed-width lines: a structure for each label, chain A for even ids."""
    e = table(spark, sf, "embeddings")
    res = F.element_at(F.array(*[F.lit(x) for x in LETTERS]), (F.expr("vec_id div 2 % 5") + 1).cast("int"))
    chain = F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B")
    line = F.format_string("ATOM  %5d %-4s %3s %s%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.col("vec_id"), F.when(F.col("vec_id") % 7 == 0, " H").otherwise(" CA"), res, chain, F.expr("vec_id div 4"), *[F.col("embedding")[i].cast("double") * 10 for i in range(3)], F.when(F.col("vec_id") % 7 == 0, "H").otherwise("C"))
    return e.select(F.col("label").alias("structure"), F.col("vec_id").alias("n"), line.alias("value"))


PDB = """a AS (SELECT label AS structure, vec_id AS n, vec_id::INT AS serial, 'CA' AS name, (['ALA', 'GLY', 'SER', 'LYS', 'XXX'])[(vec_id // 2) % 5 + 1] AS residue,
  CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS chain, printf('%4d', vec_id // 4) || ' ' AS number, 'C' AS element,
  printf('%8.3f', embedding[1]::DOUBLE * 10)::DOUBLE AS x, printf('%8.3f', embedding[2]::DOUBLE * 10)::DOUBLE AS y, printf('%8.3f', embedding[3]::DOUBLE * 10)::DOUBLE AS z FROM embeddings WHERE vec_id % 7 <> 0),
h AS (SELECT * FROM a WHERE residue <> 'XXX'),
r AS (SELECT *, row_number() OVER (PARTITION BY structure, chain ORDER BY f)::INT AS res FROM (SELECT structure, chain, number, min(n) AS f FROM h GROUP BY ALL)),
heavy AS (SELECT h.* EXCLUDE (n), res FROM h JOIN r USING (structure, chain, number))"""


@query(with_(PDB, "SELECT * FROM heavy"))
def pdb_atoms(spark, sf):
    return readers.pdb_atoms(_pdb_lines(spark, sf))


@query(with_(PDB, "SELECT structure, chain, string_agg(letter, '' ORDER BY res, letter) AS sequence FROM (SELECT DISTINCT structure, chain, res, CASE residue WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'SER' THEN 'S' ELSE 'K' END AS letter FROM heavy) GROUP BY structure, chain"))
def chain_sequence(spark, sf):
    return readers.chain_sequences(readers.pdb_atoms(_pdb_lines(spark, sf)))


@query("SELECT p_partkey, '>' || p_partkey || chr(10) || upper(p_type) || ':' || upper(p_brand) || chr(10) AS text, p_partkey::VARCHAR AS fasta_id, upper(p_type) AS first, upper(p_brand) AS second FROM part")
def fasta_format(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", readers.fasta(F.col("p_partkey").cast("string"), F.upper("p_type"), F.upper("p_brand")).alias("text"))
    return readers.parsed_fasta(p, "text")


A3M = "concat('>', p_partkey % 7 + 101, chr(10), upper(p_brand), chr(10), '>x', chr(10), '--', chr(10), chr(0), CASE WHEN p_partkey % 3 = 0 THEN '> 205 z' ELSE '>none' END, chr(10), upper(p_type), chr(10), chr(0))"


@query(f"SELECT p_partkey, TRY_CAST(nullif(regexp_extract(b, '^\\s*>\\s*([0-9]+)', 1), '') AS INT) AS block, md5(b) AS block_md5 FROM (SELECT p_partkey, unnest(string_split({A3M}, chr(0))) AS b FROM part) WHERE trim(b) <> ''")
def a3m_blocks(spark, sf):
    b = readers.alignment_blocks(table(spark, sf, "part").select("p_partkey", F.expr(A3M).alias("t")), "t")
    return b.select("p_partkey", "block", F.md5(F.col("block_text").cast("binary")).alias("block_md5"))


@query("SELECT p_partkey, sequence, length(sequence)::INT AS columns FROM (SELECT p_partkey, '---' || upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) || '-----' AS sequence FROM part)")
def a3m_pad(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.array(F.struct(F.lit("q").alias("header"), F.upper(F.regexp_replace("p_type", "[^A-Za-z]", "")).alias("sequence"))).alias("rows"))
    d = p.withColumn("rows", readers.padded_alignment(F.col("rows"), F.lit(3), F.lit(5)))
    return d.select("p_partkey", F.col("rows")[0]["sequence"].alias("sequence"), readers.aligned_length(F.col("rows")[0]["sequence"]).alias("columns"))


@query("SELECT p_partkey, concat('q', chr(9), 'r') AS header, upper(t) || lower(b) || upper(b) AS sequence, CASE WHEN p_partkey % 5 = 0 THEN 'columns' WHEN p_partkey % 7 = 0 THEN 'letters' ELSE '' END AS problem FROM (SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z]', '', 'g') AS t, regexp_replace(p_brand, '[^A-Za-z]', '', 'g') AS b FROM part)")
def a3m_pair(spark, sf):
    """Two chains' alignments side by side; every fifth lacks a column and every seventh of the others has a digit."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z]", "")
    row = lambda h, s: F.array(F.struct(F.lit(h).alias("header"), s.alias("sequence")))
    p = table(spark, sf, "part").select("p_partkey", clean("p_type").alias("t"), clean("p_brand").alias("b"))
    d = p.withColumn("rows", readers.paired_alignment(row("q", F.upper("t")), row("r", F.concat(F.lower("b"), F.upper("b")))))
    broken = F.transform("rows", lambda r: F.struct(r["header"].alias("header"), F.when(F.col("p_partkey") % 5 == 0, F.substring(r["sequence"], 2, 1000)).when(F.col("p_partkey") % 7 == 0, F.concat(r["sequence"], F.lit("1"))).otherwise(r["sequence"]).alias("sequence")))
    problem = readers.alignment_problem(broken, F.length("t") + F.length("b"))
    return d.select("p_partkey", F.col("rows")[0]["header"].alias("header"), F.col("rows")[0]["sequence"].alias("sequence"), problem.alias("problem"))


@query(with_(MEMB, "SELECT g, string_agg('seed_' || seed || ':model_' || weight, ';' ORDER BY seed, weight) AS members FROM memb GROUP BY g"))
def member_list(spark, sf):
    return members(spark, sf).groupBy("g").agg(readers.member_list("seed", "weight").alias("members"))


@query("SELECT event_id, CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END AS is_object FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '7' ELSE props || '}' END AS t FROM events)")
def json_root(spark, sf):
    t = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('[', props, ']') WHEN 2 THEN '7' ELSE concat(props, '}') END")
    return table(spark, sf, "events").select("event_id", readers.json_object(t).isNotNull().alias("is_object"))


REPORT = "concat('A B 1 2 asym ', round(k / 1000, 4), ' 0 0 0 0 0 0 x', chr(10), 'B A 1 2 asym ', round(k / 500, 4), ' 0 0 0 0 0 0 x', chr(10), 'A B 1 2 max ', round(CASE WHEN k % 10 = 3 THEN k ELSE k / 500 END, 4), ' 0 0 0 0 0 0 x', chr(10), 'short line')"


@query("SELECT event_id, round(least(a, b), 6) AS low, round((a + b) / 2, 6) AS mean, round(greatest(a, b), 6) AS high, NOT (k % 10 = 3 AND abs(k - b) > 5e-4) AS ok FROM (SELECT event_id, k, round(k / 1000, 4) AS a, round(k / 500, 4) AS b FROM (SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events))")
def report_parse(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return rounded(readers.parsed_report(d.select("event_id", F.expr(REPORT).alias("t")), "t", "event_id"))


@query("SELECT p_partkey, sha256(p_name) AS digest FROM part")
def sha256_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.sha2("p_name", 256).alias("digest"))


