"""Window expressions. Nulls stand for missing values: run ``columns.finite`` on what may hold NaN first."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _parts(partition: str | tuple[str, ...] | list[str]) -> list[str]:
    return [partition] if isinstance(partition, str) else list(partition)


def avg_rank(x: str, partition) -> Column:
    """Ascending rank, ties averaged; null where x is null."""
    p = _parts(partition)
    first = F.rank().over(Window.partitionBy(*p).orderBy(F.col(x).asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*p, x))
    return F.when(F.col(x).isNotNull(), first + (ties - 1) / F.lit(2.0))


def centred_rank(x: str, partition) -> Column:
    """avg_rank / rows of the group (missing ones too) - 0.5."""
    return avg_rank(x, partition) / F.count(F.lit(1)).over(Window.partitionBy(*_parts(partition))) - F.lit(0.5)


def z_within(x: str, partition) -> Column:
    """(x - mean) / sample deviation; 0 where that is undefined."""
    w = Window.partitionBy(*_parts(partition))
    return F.coalesce((F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)), F.lit(0.0))


def imputed(x: str, partition, fallback: Column | float) -> Column:
    """x, else its group's median, else the fallback."""
    other = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    return F.coalesce(F.col(x), F.median(x).over(Window.partitionBy(*_parts(partition))), other)


def share_of_group(x: str, group: str) -> Column:
    """Rows of the group with the same x / rows of the group; null where x is null."""
    same = F.count(F.lit(1)).over(Window.partitionBy(group, x))
    return F.when(F.col(x).isNotNull(), same / F.count(F.lit(1)).over(Window.partitionBy(group)))


def place(partition, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*_parts(partition)).orderBy(*order))


def best_first(score: str, ties: tuple[str, ...] | list[str], descending: bool = True) -> list[Column]:
    """The order of a selector: score (missing last), then the tie columns ascending."""
    s = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    return [s, *[F.col(t).asc_nulls_last() for t in ties]]
