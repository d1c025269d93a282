"""Writers. Tables go through Spark's commit protocol; the small files that a driver writes are replaced as a whole."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Plain(json.JSONEncoder):
    """NumPy's numbers and arrays as Python's, paths as text."""

    def default(self, o):
        return o.tolist() if hasattr(o, "tolist") else str(o) if isinstance(o, Path) else super().default(o)


def as_json(payload: dict, **style) -> str:
    """Sorted JSON. Numbers that JSON lacks (NaN, infinities) are null: the encoder's words for them are read back as null."""
    words = json.loads(_Plain().encode(payload), parse_constant=lambda word: None)
    return json.dumps(words, sort_keys=True, allow_nan=False, **style)


@contextmanager
def replacing(path: str | Path) -> Iterator[BinaryIO]:
    """A file to write that takes the target's place on leaving, if nothing went wrong; else the target stays and the draft goes."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.parent / f"{target.name}.part"
    try:
        with open(draft, "wb") as f:
            yield f
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, target)
    finally:
        draft.unlink(missing_ok=True)


def write_json(path: str | Path, payload: dict) -> None:
    with replacing(path) as f:
        f.write(as_json(payload, indent=2).encode() + b"\n")


def canonical_digest(payload: dict, without: tuple[str, ...] = ("created",)) -> str:
    """sha256 of the compact, sorted JSON without fields that change from run to run."""
    kept = {k: payload[k] for k in payload.keys() - set(without)}
    return hashlib.sha256(as_json(kept, separators=(",", ":")).encode()).hexdigest()


def refuse_to_overwrite(paths: list[str | Path], overwrite: bool = False) -> None:
    there = [str(p) for p in paths if Path(p).exists()]
    if there and not overwrite:
        raise FileExistsError("exists already: " + ", ".join(there))


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """CSV with these columns in this order."""
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def write_small_csv_gz(df: DataFrame, path: str | Path, order: list[str], most_rows: int = 1_000_000) -> None:
    """One gzip file with the same bytes for the same rows; for release tables, which the driver can hold: raises beyond most_rows."""
    rows = df.orderBy(*order).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    text = io.StringIO()
    text.write(",".join(df.columns) + "\n")
    for r in rows:
        text.write(",".join("" if v is None else str(v) for v in r) + "\n")
    with replacing(path) as out, gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as f:
        f.write(text.getvalue().encode())


def write_by_class(df: DataFrame, path: str, cls: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(cls).parquet(path)


def portable(path: str | Path, root: str | Path) -> str:
    """How an artifact names a file: below root if it lies there, else by its name alone, so that no folder of the machine shows."""
    below = os.path.relpath(os.path.realpath(path), os.path.realpath(root))
    return os.path.basename(below) if below.split(os.sep)[0] == os.pardir else below


def write_matrices(rows: DataFrame, path: str, group: str, slot: str, vector: str, mode: str = "errorifexists") -> None:
    """One matrix of 32-bit floats for each group, its rows in slot order, from one row for each slot (``pairs.row_vectors``)."""
    m = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("slot"), F.col(vector).cast("array<float>").alias("row")))).alias("_m"))
    m.select(group, F.transform("_m", lambda r: r["row"]).alias("matrix")).write.mode(mode).parquet(path)
