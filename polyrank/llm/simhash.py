"""SimHash fingerprints and the search for near ones, with DataFrame functions only.

A text's terms are its overlapping pairs of lower-case words; a pair weighs more the longer it is, and counts
as often as it occurs. Each term's 64-bit hash votes with its weight on each bit. Votes for two bits share one
64-bit sum (bit i and bit i + 32, in halves of 32 bits), so that 32 sums count all 64 bits. A task sums its own
documents' terms before anything is shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, hot_keys, join_apart, scratch, written

RADIUS = 3
BLOCKS = 6
#: The longest a pair can count; weights are from 1 to this.
MOST = 15
#: Ranges into which ids are dealt to find each one's successor.
RANGES = 256
_SPACE = r"[\x20\x09-\x0D]+"


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per distinct ``keys``, with fp (long) and n_rows (how many rows had them). Null texts count as empty.

    Rows of equal keys must have equal texts. The term of an empty text is the empty word, so every text has one.
    A bit is set if more than half of the weight votes for it.
    """
    words = df.select(*keys, F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SPACE).alias("_w"))
    pairs = words.select(*keys, F.posexplode(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), F.size("_w")).alias("b"))).alias("_p", "_t"))
    a, b = F.col("_t.a"), F.coalesce(F.col("_t.b"), F.lit(""))
    terms = pairs.select(*keys, "_p", F.xxhash64(a, b).alias("_h"), F.greatest(F.lit(1), F.least(F.lit(MOST), F.length(a) + F.length(b))).cast("long").alias("_v"))
    both = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(both) * F.col("_v")).alias(f"_s{i}") for i in range(32)]
    votes = terms.groupBy(*keys).agg(F.sum("_v").alias("_all"), F.sum(F.when(F.col("_p") == 0, 1).otherwise(0)).alias("n_rows"), *sums)
    low, zero = F.lit((1 << 32) - 1), F.lit(0).cast("long")
    fp = zero
    for i in range(32):
        s = F.col(f"_s{i}")
        fp = fp.bitwiseOR(F.when(s.bitwiseAND(low) * 2 > F.col("_all"), F.lit(1 << i)).otherwise(zero))
        fp = fp.bitwiseOR(F.when(F.shiftrightunsigned(s, 32) * 2 > F.col("_all"), F.lit((1 << (i + 32)) - (1 << 64 if i == 31 else 0))).otherwise(zero))
    return votes.select(*keys, fp.alias("fp"), "n_rows")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks (signed) of the permuted tables: fingerprints within the radius agree on at least ``blocks - radius`` whole blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_fingerprints(queries: DataFrame, all_: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All (q, fp, distance) within the radius, for distinct fingerprints in ``queries`` and ``all_`` (column fp of each), once each.

    Every fingerprint stands in each permuted table under its masked bits; a pair is taken from the first table
    in which both meet. Equal fingerprints are one row, so copies make no pairs.
    """
    masks = block_masks(radius, blocks)

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
        return df.select("fp").where("fp is not null").distinct().select(F.col("fp").alias(name), F.explode(keys).alias("_k")).select(name, F.col("_k.t").alias("_t"), F.col("_k.k").alias("_key"))

    # both sides grow with the data, though the planner takes the exploded one for small: neither is broadcast
    both = tables(queries, "q").hint("merge").join(tables(all_, "fp").hint("merge"), ["_t", "_key"])
    x = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    return both.where((F.bit_count(x) <= radius) & (F.col("_t") == first)).select("q", "fp", F.bit_count(x).alias("distance"))


def successors(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, next_id) for each distinct id that is not null: the next smaller id; after the smallest, the largest.

    Ids are dealt into ranges by approximate quantiles (at most RANGES numbers on the driver); the last of a range
    takes the first of the next, from a table of one row per range.
    """
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    bounds = sorted(set(docs.select(F.col(id_col).cast("double").alias("x")).where("x is not null").approxQuantile("x", [i / RANGES for i in range(1, RANGES)], 0.001)))
    range_of = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("id").cast("double"))) if bounds else F.lit(0)
    ids = ids.withColumn("_range", range_of)
    down = Window.partitionBy("_range").orderBy(F.col("id").desc())
    ids = ids.withColumn("_next", F.lead("id").over(down))
    ranges = ids.groupBy("_range").agg(F.max("id").alias("_top"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("_range", F.coalesce(F.lead("_top").over(Window.orderBy(F.col("_range").desc())), F.max("_top").over(everything)).alias("_top"))
    return ids.join(ranges, "_range").select("id", F.coalesce("_next", "_top").alias("next_id"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), n_chars, next_id and edited of each row.

    edited: the last floor(n_chars / 2) code points replaced by the first as many of the next document (descending
    doc_id, after the last the first). Of several next documents of one id, the one whose text has the smallest hash
    counts; a row without an id has no next document and loses its last half.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slim = base.select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("_half"))
    need = slim.groupBy("doc_id").agg(F.max("_half").alias("_half")).join(successors(docs).withColumnRenamed("id", "doc_id"), "doc_id")
    need = need.select(F.col("doc_id").alias("_for"), F.col("next_id").alias("doc_id"), "_half")
    heads = base.join(need, "doc_id").select(F.col("_for").alias("doc_id"), F.col("doc_id").alias("next_id"), F.xxhash64("text").alias("_th"), F.expr("left(text, _half)").alias("_head"))
    heads = heads.groupBy("doc_id", "next_id").agg(F.min_by("_head", "_th").alias("_head"))
    heads = written(heads, "heads")  # frees what its joins have shuffled
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    out = base.join(heads, "doc_id", "left")
    return out.select("doc_id", "text", n.cast("long").alias("n_chars"), "next_id", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.coalesce(F.substring(F.col("_head"), F.lit(1), half), F.lit(""))).alias("edited"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        one = keep(written(_both_fingerprints(documents(spark, sf_dir, "doc_id", "text")), "fingerprints"))
    next_ = one.groupBy(F.col("doc_id").alias("next_id")).agg(F.min_by("fp", "_th").alias("_next_fp"))
    with scratch() as keep:
        counts = keep(written(one.groupBy("fp").agg(F.sum("n_rows").alias("_n"), F.count(F.lit(1)).alias("_rows")), "fingerprint-counts"))
        near = near_fingerprints(one.where("doc_id % 20 = 0").select("fp"), counts).join(counts, "fp").groupBy("q").agg(F.sum("_n").alias("_near"))
        near = keep(written(near.withColumnRenamed("q", "fp"), "near"))
    both = join_apart(one, near, ["fp"], hot_keys(counts, ["fp"], "_rows"), "left")
    out = both.join(next_, "next_id", "left").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), F.coalesce(likeness(F.col("fp"), F.col("_next_fp")), F.lit(0.0)).alias("near_next"), F.when(F.expr("doc_id % 20 = 0"), F.col("_near") - 1).alias("n_near"))


def _both_fingerprints(docs: DataFrame) -> DataFrame:
    """Each distinct row's fingerprints before and after its edit, and how many rows it stands for."""
    edits = with_edits(docs)
    two = edits.select("doc_id", "next_id", "n_chars", F.xxhash64("text").alias("_th"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t")))).alias("_x"))
    keys = ["doc_id", "next_id", "n_chars", "_th", "edited_sha256"]
    fps = fingerprints(two.select(*keys, F.col("_x.e").alias("_e"), F.col("_x.t").alias("_text")), [*keys, "_e"], "_text")
    return fps.groupBy(*keys).agg(F.max(F.when(F.col("_e") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("_e") == 1, F.col("fp"))).alias("edited_fp"), F.max("n_rows").alias("n_rows"))
