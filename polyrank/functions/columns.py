"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..roles import ACCEPTABLE, HIGH, MEDIUM


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """x as a double; what can't be parsed, NaN and infinities are null."""
    d = _c(x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def whole_number(x: Column | str) -> Column:
    """x as a long if it is a whole number, else null: fractions are not cut off."""
    d = finite(x)
    return F.when(F.floor(d) == d, d.cast("long"))


def parsed_bool(x: Column | str, strict: bool = False) -> Column:
    """True for 'true' in any case; else false, or null (strict) unless it is 'false'."""
    t = F.lower(F.trim(_c(x).cast("string")))
    other = F.when(t == "false", False) if strict else F.lit(False)
    return F.when(t == "true", True).otherwise(other)


def acceptable(truth: Column | str, threshold: float = ACCEPTABLE) -> Column:
    return _c(truth) >= threshold


def quality_band(truth: Column | str) -> Column:
    """Left-closed bands."""
    t = _c(truth)
    return F.when(t < ACCEPTABLE, "incorrect").when(t < MEDIUM, "acceptable").when(t < HIGH, "medium").when(t.isNotNull(), "high")


def first_true(branches: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds."""
    out = None
    for cond, label in branches:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def logistic(linear: Column, limit: float = 30.0) -> Column:
    z = F.greatest(F.lit(-limit), F.least(F.lit(limit), linear))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def standardised(x: Column | str, median: Column | float, mean: Column | float, scale: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return (F.coalesce(_c(x), as_col(median)) - as_col(mean)) / as_col(scale)


def ratio(a: Column | str, b: Column | str, times: float = 1.0) -> Column:
    """times * a / b; null where b is 0 or null."""
    return F.when(_c(b) != 0, _c(a) * F.lit(float(times)) / _c(b))


def contact_density(pairs: Column | str, side_a: Column | str, side_b: Column | str) -> Column:
    """2 pairs / (side_a + side_b); 0 without residues."""
    n = _c(side_a) + _c(side_b)
    return F.when(n == 0, F.lit(0.0)).otherwise(_c(pairs) * F.lit(2.0) / n)


def buried_area(a: Column | str, b: Column | str, both: Column | str) -> tuple[Column, Column]:
    """Half of the surface lost by joining, and log1p of it. Losses below zero within tolerance count as 0, others are null."""
    lost = _c(a) + _c(b) - _c(both)
    slack = F.greatest(F.lit(1e-6), (_c(a) + _c(b)) * F.lit(1e-7))
    kept = F.when(lost >= 0, lost).when(lost >= -slack, F.lit(0.0))
    return kept / 2, F.log1p(kept / 2)


#: Texts that stand for an unknown accession.
NULL_TOKENS = ("", "UNDEFINED", "NONE", "NAN", "NA")


def is_null_token(x: Column | str) -> Column:
    return F.coalesce(F.upper(F.trim(_c(x))).isin(*NULL_TOKENS), F.lit(True))


def accession(pair_id: Column | str, side: int) -> Column:
    """The accession of one side (0 or 1) of ``<entry>__<chain>_<accession>--<entry>__<chain>_<accession>``."""
    x = _c(pair_id)
    part = F.substring_index(x, "--", 1) if side == 0 else F.substring(x, F.instr(x, "--") + 2, 1 << 30)
    return F.substring_index(part, "_", -1)


def entry_id(pair_id: Column | str) -> Column:
    return F.lower(F.split_part(_c(pair_id), F.lit("__"), F.lit(1)))


def same_known(a: Column | str, b: Column | str) -> Column:
    """Equal, and neither stands for an unknown."""
    return ~is_null_token(a) & ~is_null_token(b) & (_c(a) == _c(b))


def unordered_pair(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws("|", F.array_sort(F.array(_c(a), _c(b))))


def stable_hash(x: Column | str, seed: str) -> Column:
    """The first 8 bytes of sha256(seed|x) as a number without sign."""
    digest = F.sha2(F.concat(F.lit(seed + "|"), _c(x).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def hash_draw(replicate: Column | str, i: Column | str, n: Column | str) -> Column:
    """A reproducible draw from 0 to n - 1."""
    digest = F.sha2(F.concat(_c(replicate).cast("string"), F.lit("|"), _c(i).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % _c(n)


def wilson(k: Column | str, n: Column | str, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of k of n; null if n is 0."""
    n = F.nullif(_c(n), F.lit(0))
    p = _c(k) / n
    mid = (p + F.lit(z * z) / (2 * n)) / (1 + F.lit(z * z) / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / (1 + F.lit(z * z) / n)
    return mid - half, mid + half


#: One-letter codes of the standard residues.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def residue_letter(name: Column | str) -> Column:
    """One-letter code; X for what isn't standard."""
    table = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(_c(name))), F.lit("X"))


def number_text(x: Column | str) -> Column:
    """A number with ten significant digits and no zeros at the end; with an exponent below 0.0001 and from 10,000,000,000 on."""
    v = _c(x).cast("double")
    text = F.format_string("%.9e", v)
    digits, power = F.substring_index(text, "e", 1), F.substring_index(text, "e", -1).try_cast("int")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = bare(text.try_cast("decimal(28,14)").cast("string"))
    exponent = F.concat(bare(digits), F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(v == 0, "0").when(odd, F.lower(v.cast("string"))).when(power.between(-4, 9), plain).otherwise(exponent)


def reason_text(*parts: Column | str) -> Column:
    """A reason as one text: columns are numbers, strings stand as they are; null if a number is missing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else number_text(p) for p in parts])
