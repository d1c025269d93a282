"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key, of its id and text, so that rows of one id have an order too. Within its source, documents are ordered by that key; the order is
dealt into ranges by the key's first hex digits, so that one source that holds most rows is spread over
``16 ** digits`` tasks. A prefix sum of word counts is the sum of the ranges before (a small table) and a
running sum inside the range. Each source's budget is cut at its exact word; budgets above the source's
size repeat whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, written

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
SEED = "mix-1"
DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def with_keys(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    own = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), own).cast("binary"))
    return docs.withColumns({"_size": word_count(text), "_key": key, "_range": F.substring(key, 1, DIGITS)})


def source_targets(sizes: DataFrame, source: str = "source", weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: its size, weight and target.

    Targets are proportional to weight, none is above ``epochs`` times its source's size, and they add up to all
    sizes: with sources ordered by size / weight, those before the first one that its share fits are full, and
    the rest share what remains. There are as many rows as sources, so one task orders them.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.groupBy(source).agg(F.sum("_size").alias("source_size"))
    t = t.withColumn("_w", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumns({"_cap": F.col("source_size") * float(epochs), "_full_at": F.col("source_size") * float(epochs) / F.col("_w")})
    order = Window.orderBy("_full_at", F.col(source).asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({"_total": F.sum(F.col("source_size").cast("double")).over(everything), "_all_w": F.sum("_w").over(everything), "_caps": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_ws": F.coalesce(F.sum("_w").over(before), F.lit(0.0)), "_no": F.row_number().over(order)})
    t = t.withColumn("_level", (F.col("_total") - F.col("_caps")) / (F.col("_all_w") - F.col("_ws")))
    first = F.struct("_no", "_level")
    t = t.withColumn("_found", F.min(F.when(F.col("_level") <= F.col("_full_at"), first)).over(everything))
    target = F.when(F.col("_no") < F.col("_found._no"), F.col("_cap")).otherwise(F.col("_found._level") * F.col("_w"))
    return t.select(source, "source_size", target.alias("target"))


def mix_plan(keyed: DataFrame, source: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, totals_of: DataFrame | None = None) -> DataFrame:
    """``keyed`` (see ``with_keys``) with source_size, target and taken. All its columns stay.

    totals_of: a frame with the same rows that is cheaper to read for the totals.
    Null sources are one source, last in order. Rows of equal key and id are taken one after the other.
    """
    slim = (totals_of if totals_of is not None else keyed).select(source, "_size", "_range")
    ranges = slim.groupBy(source, "_range").agg(F.sum("_size").alias("_in_range"))
    targets = source_targets(ranges.withColumnRenamed("_in_range", "_size"), source, weights, epochs)
    before = Window.partitionBy(source).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))
    t = targets.withColumnRenamed(source, "_s")
    offsets = offsets.join(t, offsets[source].eqNullSafe(t["_s"])).drop("_s", "_in_range").withColumnsRenamed({source: "_s", "_range": "_r"})
    budget = F.floor(F.col("target") + 0.5)
    offsets = offsets.withColumns({"_budget": budget, "_epochs": F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0)})
    offsets = offsets.withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size")).drop("_budget")
    inside = Window.partitionBy(source, "_range").orderBy("_key", id_col).rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("_run", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    joined = run.join(offsets, run[source].eqNullSafe(offsets["_s"]) & (run["_range"] == offsets["_r"]), "left")
    left = F.col("_rest") - F.col("_offset") - F.col("_run")
    part = F.least(F.col("_size"), F.greatest(F.lit(0), left))
    return joined.withColumn("taken", F.col("_epochs") * F.col("_size") + part).drop("_s", "_r", "_run", "_offset", "_rest", "_epochs")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: whole copies, and one copy cut after its last word where a source's budget ends.

    Documents of which nothing is taken go; those without words too. Columns as in ``docs``; ``n_chars`` follows a cut text.
    """
    whole = docs.select("doc_id", "text", "source", F.struct(*[c for c in docs.columns if c != "text"]).alias("_others"))
    keyed = with_keys(whole)
    slim = keyed.select("source", "_size", "_range", "_key", "doc_id")
    plan = mix_plan(keyed, totals_of=slim, **options).where("taken > 0")
    copies = plan.withColumn("_left", F.explode(F.expr("transform(sequence(1, cast(ceil(taken / _size) as int)), i -> least(_size, taken - (i - 1) * _size))")))
    # A cut text: the longest prefix that holds _left words, white space as it stands. Word by word: a counted
    # repetition in one pattern would recurse as deep as the text has words.
    cut = F.col("_left") < F.col("_size")
    parts = F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    head = F.when(cut, F.array_join(F.slice(parts, F.lit(1), F.col("_left").cast("int")), "")).otherwise(F.col("text"))
    out = {c: F.col("_others")[c] for c in docs.columns if c != "text"} | {"text": head}
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.length(head).cast("long")).otherwise(out["n_chars"])
    return copies.select(*[out[c].alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = written(with_keys(documents(spark, sf_dir, "doc_id", "text", "source")).drop("text"), "mix-keys")
    plan = mix_plan(keyed)
    return plan.select("doc_id", F.col("_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), "taken")


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS wt FROM s),
f AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / wt AS full_at FROM w),
o AS (SELECT *, row_number() OVER q AS num, (SELECT sum(source_size)::DOUBLE FROM f) AS total, (SELECT sum(wt) FROM f) AS all_w,
        coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
        coalesce(sum(wt) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
      FROM f WINDOW q AS (ORDER BY full_at, source NULLS LAST)),
l AS (SELECT *, (total - caps) / (all_w - ws) AS lev FROM o),
c AS (SELECT min(num) AS n0, arg_min(lev, num) AS lev0 FROM l WHERE lev <= full_at),
t AS (SELECT source, source_size, CASE WHEN num < n0 THEN cap ELSE lev0 * wt END AS target FROM l, c),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT d.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - run)))::BIGINT AS taken FROM r
"""
