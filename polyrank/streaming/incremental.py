"""Incremental upkeep: when candidates arrive in small batches, only the groups that they touch are computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def touched_groups(batch: DataFrame, all_rows: DataFrame, group: str) -> DataFrame:
    """The rows of the groups that a batch has rows of."""
    return all_rows.join(batch.select(group).distinct(), group, "left_semi")


def upkeep(stream: DataFrame, read_all: Callable[[], DataFrame], store: Callable[[DataFrame], None], write: Callable[[DataFrame, int], None], compute: Callable[[DataFrame], DataFrame], group: str, checkpoint: str):
    """Start a stream that stores each micro-batch and writes ``compute`` of the touched groups, with the batch's number.

    write must replace the groups' earlier results (and may see a batch again after a failure).
    """

    def each(batch: DataFrame, number: int) -> None:
        store(batch)
        write(compute(touched_groups(batch, read_all(), group)), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
