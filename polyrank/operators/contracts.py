"""Data-quality contracts: each gives a table of violations (check, n, examples); ``require`` fails on the driver if any has n > 0."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


class ContractError(ValueError):
    """A table breaks a contract."""


def require_columns(df: DataFrame, columns: list[str], source: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{source} lacks columns: {', '.join(missing)}")
    return df


def require(violations: DataFrame) -> None:
    """Raise with counts and examples if a contract is broken."""
    bad = violations.where("n > 0").collect()
    if bad:
        raise ContractError("; ".join(f"{r['check']}: {r['n']} ({r['examples']})" for r in bad))



def _violations(offenders: DataFrame, check: str, key: str) -> DataFrame:
    """offenders has a string column ``key``."""
    n = offenders.agg(F.count(F.lit(1)).alias("n"))
    some = offenders.select(key).orderBy(key).limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list(key)), ";").alias("examples"))
    return n.crossJoin(some).select(F.lit(check).alias("check"), "n", "examples")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _violations(d.select(F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("_k")), "duplicate_keys", "_k")


def group_size(df: DataFrame, group: str, size: int) -> DataFrame:
    d = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") != size)
    return _violations(d.select(F.col(group).cast("string").alias("_k")), "group_size", "_k")


def missingness(df: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """(feature, missing, fraction, ok) for each column, from one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing")) for c in columns])).alias("x"))
    return rows.select("x.feature", "x.missing", F.try_divide("x.missing", "_n").alias("fraction"), F.coalesce(F.try_divide("x.missing", "_n") <= limit, F.lit(True)).alias("ok"))


def two_classes(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Does each fold (or the table) have both classes?"""
    return df.groupBy(*(by or [])).agg(F.count_if(F.col(label)).alias("positives"), F.count_if(~F.col(label)).alias("negatives")).withColumn("ok", (F.col("positives") > 0) & (F.col("negatives") > 0))


def mapping_policy(df: DataFrame, mode: str, allowed: dict[str, Column]) -> DataFrame:
    """Rows whose mode isn't allowed for them: allowed gives the condition under which a mode may stand."""
    ok = F.lit(False)
    for name, cond in allowed.items():
        ok = ok | ((F.col(mode) == name) & cond)
    return df.groupBy(mode).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations"))


def fold_integrity(df: DataFrame, group: str, fold: str, folds: list[int]) -> DataFrame:
    """Groups in several folds, folds that are missing, folds that aren't expected."""
    several = df.groupBy(group).agg(F.count_distinct(fold).alias("_n")).where("_n > 1")
    found = df.select(fold).distinct()
    expected = df.sparkSession.createDataFrame([(f,) for f in folds], f"{fold} int")
    parts = [(several.select(F.col(group).cast("string").alias("_k")), "several_folds"), (expected.join(found, fold, "left_anti").select(F.col(fold).cast("string").alias("_k")), "missing_folds"), (found.join(expected, fold, "left_anti").select(F.col(fold).cast("string").alias("_k")), "unexpected_folds")]
    out = None
    for d, name in parts:
        v = _violations(d, name, "_k")
        out = v if out is None else out.unionByName(v)
    return out


def status_ok(df: DataFrame, status: str, error: str, key: str) -> DataFrame:
    bad = df.where((F.col(status) != "ok") | F.col(status).isNull() | (F.trim(F.coalesce(F.col(error), F.lit(""))) != ""))
    return _violations(bad.select(F.col(key).cast("string").alias("_k")), "status", "_k")


def expected_set(df: DataFrame, group: str, attribute: str, expected: list) -> DataFrame:
    """Groups whose values of an attribute are not exactly the expected ones."""
    want = F.array_sort(F.array(*[F.lit(x) for x in expected]))
    g = df.groupBy(group).agg(F.array_sort(F.collect_set(attribute)).alias("_s"))
    return _violations(g.where(F.col("_s") != want).select(F.col(group).cast("string").alias("_k")), "expected_set", "_k")


def in_range(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    one = df.agg(*[F.count_if((F.col(c) < low) | (F.col(c) > high) | F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("violations")) for c in columns])).alias("x")).select("x.*")


def keyset_equal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in both tables, in the first only, in the second only."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, keys, "full")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"))


def member_diff(df: DataFrame, group: str, member: str, expected: list) -> DataFrame:
    """Per group, as text: members missing, unexpected, and there twice."""
    want = F.array(*[F.lit(x) for x in expected])
    m = df.groupBy(group, member).agg(F.count(F.lit(1)).alias("_n"))
    g = m.groupBy(group).agg(F.collect_list(member).alias("_have"), F.collect_list(F.when(F.col("_n") > 1, F.col(member))).alias("_twice"))
    text = lambda a: F.array_join(F.array_sort(a).cast("array<string>"), ";")
    return g.select(group, text(F.array_except(want, "_have")).alias("missing"), text(F.array_except("_have", want)).alias("unexpected"), text(F.col("_twice")).alias("duplicate"))


def pair_coverage(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Per group: members seen in pairs, pairs, and whether each member stands in members - 1 of them."""
    both = pairs.select(group, F.explode(F.array(a, b)).alias("_m"))
    m = both.groupBy(group, "_m").agg(F.count(F.lit(1)).alias("_n"))
    return m.groupBy(group).agg(F.count(F.lit(1)).alias("members"), (F.sum("_n") / 2).cast("long").alias("pairs"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi")).select(group, "members", "pairs", ((F.col("_lo") == F.col("members") - 1) & (F.col("_hi") == F.col("members") - 1)).alias("complete"))


def one_selected(df: DataFrame, group: str, flag: str) -> DataFrame:
    g = df.groupBy(group).agg(F.count_if(F.col(flag)).alias("_n")).where("_n <> 1")
    return _violations(g.select(F.col(group).cast("string").alias("_k")), "one_selected", "_k")


def conflicts(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Keys with more than one value of an attribute that is constant by contract."""
    g = df.groupBy(key).agg(*[F.count_distinct(a).alias(a) for a in attributes])
    rows = g.select(F.col(key).cast("string").alias("key"), F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("values")) for a in attributes])).alias("x"))
    return rows.select("key", "x.*").where(F.col("values") > 1)


def partition_exact(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows by the number of classes whose condition they meet: exact if all meet one."""
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions.values()), F.lit(0))
    return df.groupBy(n.alias("classes")).agg(F.count(F.lit(1)).alias("rows"))


def audit_summary(df: DataFrame, group: str, fold: str, label: str) -> DataFrame:
    """Rows, groups, folds and positives, as (metric, value) rows."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"), F.count_distinct(fold).alias("folds"), F.count_if(F.col(label)).alias("positives"), F.count_if(F.col(label).isNull()).alias("missing_labels"))
    names = ["rows", "groups", "folds", "positives", "missing_labels"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")


def quality_report(df: DataFrame, group: str, features: list[str], category: str) -> DataFrame:
    """A long report (metric, key, value): table size, missing values of each feature, and how often each category occurs."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"))
    top = size.select(F.explode(F.array(*[F.struct(F.lit("table").alias("metric"), F.lit(n).alias("key"), F.col(n).alias("value")) for n in ("rows", "groups")])).alias("x")).select("x.*")
    miss = missingness(df, features, 1.0).select(F.lit("missing").alias("metric"), F.col("feature").alias("key"), F.col("missing").alias("value"))
    cats = df.groupBy(F.coalesce(F.col(category).cast("string"), F.lit("missing")).alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(category).alias("metric"), "key", "value")
    return top.unionByName(miss).unionByName(cats)


def without_columns(df: DataFrame, names: list[str], pattern: str | None = None) -> DataFrame:
    """df without some columns (those it lacks don't matter); raises if a column that matches the pattern is left."""
    out = df.drop(*names)
    left = [c for c in out.columns if pattern and re.search(pattern, c)]
    if left:
        raise ContractError(f"columns match {pattern}: {', '.join(left)}")
    return out


def preferred_first(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with these columns first, as far as it has them, and all others after them in their own order."""
    first = [c for c in columns if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def release_gates(expected: DataFrame, observed: DataFrame, forbidden: str = r"(^|_)(truth|label)($|_)") -> DataFrame:
    """(gate, n, examples) of a release: artifacts missing, unexpected, listed twice, with other rows or another digest, with an absolute path, or with columns that a release may not have.

    expected: name, rows, sha256. observed: also path and columns (an array). A release may go out if every n is 0.
    """
    e, o = expected.select("name", F.col("rows").alias("_er"), F.col("sha256").alias("_es")), observed
    both = e.join(o.select("name", "rows", "sha256"), "name")
    gates = {
        "missing": e.join(o, "name", "left_anti"),
        "unexpected": o.join(e, "name", "left_anti"),
        "listed_twice": o.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"),
        "rows": both.where(~F.col("rows").eqNullSafe(F.col("_er"))),
        "digest": both.where(~F.col("sha256").eqNullSafe(F.col("_es"))),
        "absolute_path": o.where(F.col("path").rlike(r"^([A-Za-z]:)?[/\\\\]")),
        "forbidden_columns": o.where(F.exists("columns", lambda c: c.rlike(forbidden))),
    }
    out = None
    for gate, bad in gates.items():
        v = _violations(bad.select(F.col("name").alias("_k")), gate, "_k").withColumnRenamed("check", "gate")
        out = v if out is None else out.unionByName(v)
    return out


def checked_cutoffs(contact: float, **within: float) -> None:
    """Raise unless all cutoffs are finite and above 0, and none is beyond that of contacts."""
    for name, v in {"contact": contact, **within}.items():
        if not math.isfinite(v) or v <= 0:
            raise ContractError(f"{name} cutoff must be finite and above 0")
        if v > contact:
            raise ContractError(f"{name} cutoff is beyond that of contacts")
