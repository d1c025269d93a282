"""Readers: tables with pinned schemas, id lists, JSON scalars, file names, structures, sequences, alignments, reports."""

from __future__ import annotations

import io
import tarfile
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import residue_letter
from ..operators.contracts import EXAMPLES, ContractError, _violations, duplicate_keys, require, require_columns

SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a pinned schema; .gz is unpacked by its name."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_table(spark: SparkSession, path: str, required: list[str], key: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet or CSV by the path's ending, checked for columns and unique keys."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = read_csv(spark, path, schema) if schema else spark.read.option("header", True).csv(path)
    require_columns(df, required, path)
    if key:
        require(duplicate_keys(df, key))
    return df


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id) from lines; blank ones and those that start with # don't count."""
    return id_lines(spark.read.text(path), "value")


def id_lines(df: DataFrame, column: str) -> DataFrame:
    t = F.trim(F.col(column))
    return df.select(t.alias("id")).where((F.col("id") != "") & ~F.col("id").startswith("#"))


def checked_ids(ids: DataFrame, expected: int | None = None) -> DataFrame:
    """ids, once they are safe, unique, and as many as expected."""
    n = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.count_if(~F.col("id").rlike(SAFE_ID)).alias("unsafe")).first()
    if not n["n"] or n["n"] != n["d"] or n["unsafe"] or (expected is not None and n["n"] != expected):
        raise ContractError(f"id list: {n['n']} ids, {n['d']} distinct, {n['unsafe']} unsafe, {expected} expected")
    return ids


def json_object(text: Column | str) -> Column:
    """The text if it is one JSON object, else null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.rlike(r"^\s*\{") & (F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1), t)  # in brackets, so that nothing may follow


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of JSON files; raises if one's root isn't an object."""
    d = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    require(_violations(d.where(json_object("text").isNull()).select("path"), "json_root_is_an_object", "path"))
    return d


def json_number(text: Column | str, *paths: str, low: float = 0.0, high: float = 1.0) -> Column:
    """The number that stands under any of the paths: null if none is a number in the range, or if two differ by over 1e-12."""
    t = F.col(text) if isinstance(text, str) else text
    raw = [F.get_json_object(t, p) for p in paths]
    values = [F.when(~r.isin("true", "false"), r.try_cast("double")) for r in raw]
    first = F.coalesce(*values)
    agree = F.lit(True)
    for v in values:
        agree = agree & (v.isNull() | (F.abs(v - first) <= 1e-12))
    return F.when(agree & (first >= low) & (first <= high) & ~F.isnan(first), first)


def explode_json(df: DataFrame, text: str, schema: str, items: str) -> DataFrame:
    """One row for each element of the array field ``items`` of a JSON document."""
    doc = F.from_json(F.col(text), schema)
    return df.select(doc.alias("_d")).select("_d.*").withColumn("_i", F.explode(items)).select(*[c for c in _names(schema) if c != items], "_i.*")


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).fieldNames()


FILE_NAME = r"^(.+)_unrelaxed_rank_([0-9]+)_(.+)_model_([0-9]+)_seed_([0-9]+)\.pdb$"


def parsed_file_name(df: DataFrame, column: str) -> DataFrame:
    """df with file_id, file_rank, family, model and file_seed; null where the name has another form."""
    part = lambda i: F.nullif(F.regexp_extract(F.col(column), FILE_NAME, i), F.lit(""))
    return df.withColumns({"file_id": part(1), "file_rank": part(2).cast("int"), "family": part(3), "model": part(4).cast("int"), "file_seed": part(5).cast("int")})


def discover(spark: SparkSession, paths: str | list[str], glob: str = "*", ids: DataFrame | None = None, sidecar: tuple[str, str] | None = None, most: int | None = None, least: int = 1) -> DataFrame:
    """(path, name, bytes) of the files below one or more folders, by name.

    ids: only files whose file_id is listed. sidecar: (ending, other ending); each file needs a neighbour whose name has
    the other ending. most: so many in order of path. Raises if one file is found twice (folders within one another), if
    a sidecar is missing, or if fewer than ``least`` files match.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    read = lambda p, g: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", g).load(p).select("path", F.col("length").alias("bytes"))
    f = read(roots[0], glob)
    for p in roots[1:]:
        f = f.unionByName(read(p, glob))
    f = f.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if ids is not None:
        f = parsed_file_name(f, "name").join(ids.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("path", "bytes", "name")
    if len(roots) > 1:
        require(duplicate_keys(f, ["path"]))
    if sidecar:
        ending, other = sidecar
        want = f.where(F.col("path").endswith(ending)).select(F.concat(F.expr(f"left(path, length(path) - {len(ending)})"), F.lit(other)).alias("path"))
        lost = [r["path"] for r in want.join(read(roots, "*" + other).select("path"), "path", "left_anti").orderBy("path").limit(EXAMPLES).collect()]
        if lost:
            raise ContractError("sidecars are missing: " + ", ".join(lost))
    if most is not None:
        f = f.orderBy("path").limit(most)
    if least and len(f.limit(least).collect()) < least:
        raise ContractError(f"fewer than {least} files match {glob}")
    return f


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, bytes, sha256) of each file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: An ATOM line's serial, columns 12 to 22, residue number with its letter, and columns from 28 on.
ATOM_LINE = r"^ATOM  ([0-9]{6,}|-[0-9]{5,}|.{0,5})(.{0,11})((?:[0-9]{5,}|-[0-9]{4,}).?|.{0,5})(.*)"


def _atom_lines(lines: DataFrame, text: str) -> DataFrame:
    """The ATOM lines with ``_parts``, the groups of ATOM_LINE.

    Writers let a serial over 99,999 or a residue number over 9,999 push what follows to the right, by a digit each:
    columns 12 and 27 have no digits otherwise, so that a line is cut where the number ends.
    """
    a = lines.where(F.substring(F.col(text), 1, 6) == "ATOM  ")
    parts = F.split(F.regexp_replace(F.col(text), ATOM_LINE, "$1\u0000$2\u0000$3\u0000$4"), "\u0000", 4)
    # a row of its own generator, so that a line is cut once and not for each field
    return a.select("*", F.explode(F.array(parts)).alias("_parts"))


def _atom_field(a: int, b: int) -> Column:
    """b characters from column a on of an ATOM line, trimmed: columns of numbers that fit."""
    part, start = (1, 12) if a < 23 else (3, 28)
    return F.trim(F.substring(F.col("_parts")[part], a - start + 1, b))


def _atom_element() -> Column:
    f = _atom_field
    return F.upper(F.when(f(77, 2) != "", f(77, 2)).otherwise(F.substring(F.regexp_replace(f(13, 4), "[0-9]", ""), 1, 1)))


def pdb_atoms(lines: DataFrame, text: str = "value", structure: str = "structure") -> DataFrame:
    """Heavy atoms of standard residues from fixed-width ATOM lines: structure, serial, name, residue, chain, number, res, x, y, z, element.

    res counts a chain's residues from 1 in file order. lines: structure, text, and their number ``n`` in the file.
    Serials and residue numbers may be wider than their columns. What ``pdb_problems`` finds is left out here.
    """
    f = _atom_field
    a = _atom_lines(lines, text).select(structure, "n", F.trim(F.col("_parts")[0]).try_cast("int").alias("serial"), f(13, 4).alias("name"), f(18, 3).alias("residue"), F.substring(F.col("_parts")[1], 11, 1).alias("chain"), F.col("_parts")[2].alias("number"), f(31, 8).try_cast("double").alias("x"), f(39, 8).try_cast("double").alias("y"), f(47, 8).try_cast("double").alias("z"), _atom_element().alias("element"))
    a = a.where(~F.col("element").isin("H", "D") & (residue_letter("residue") != "X") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    first = a.groupBy(structure, "chain", "number").agg(F.min("n").alias("_first"))
    res = first.withColumn("res", F.row_number().over(Window.partitionBy(structure, "chain").orderBy("_first"))).drop("_first")
    return a.join(res, [structure, "chain", "number"]).drop("n")


def pdb_problems(lines: DataFrame, text: str = "value", structure: str = "structure", chains: int | None = 2) -> DataFrame:
    """(structure, problem, n): structures with several MODELs, another number of chains, atoms of standard residues whose coordinates aren't finite numbers, or such residues without a heavy atom."""
    f = _atom_field
    models = lines.where(F.substring(F.col(text), 1, 6) == "MODEL ").groupBy(structure).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("problem", F.lit("several_models"))
    xyz = [f(a, 8).try_cast("double") for a in (31, 39, 47)]
    finite = F.lit(True)
    for v in xyz:
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    a = _atom_lines(lines, text).where(residue_letter(f(18, 3)) != "X")
    a = a.select(structure, F.substring(F.col("_parts")[1], 11, 1).alias("chain"), F.col("_parts")[2].alias("number"), finite.alias("finite"), (~_atom_element().isin("H", "D")).alias("heavy"))
    bad = a.where("not finite").groupBy(structure).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("coordinates"))
    bare = a.groupBy(structure, "chain", "number").agg(F.bool_or("heavy").alias("any")).where("not any").groupBy(structure).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("residues_without_heavy_atoms"))
    out = models.unionByName(bad).unionByName(bare)
    if chains is not None:
        count = a.groupBy(structure).agg(F.count_distinct("chain").alias("n")).where(F.col("n") != chains)
        out = out.unionByName(count.withColumn("problem", F.lit("chains")))
    return out.select(structure, "problem", "n")


def chain_sequences(residues: DataFrame, structure: str = "structure") -> DataFrame:
    """(structure, chain, sequence) from rows of structure, chain, res, residue; what isn't standard is X."""
    one = residues.select(structure, "chain", "res", residue_letter("residue").alias("_l")).distinct()
    g = one.groupBy(structure, "chain").agg(F.array_sort(F.collect_list(F.struct("res", "_l"))).alias("_r"))
    return g.select(structure, "chain", F.array_join(F.transform("_r", lambda r: r["_l"]), "").alias("sequence"))


def fasta(key: Column | str, first: Column | str, second: Column | str) -> Column:
    """``>id``, and both chains of a complex joined by a colon."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit(">"), c(key), F.lit("\n"), c(first), F.lit(":"), c(second), F.lit("\n"))


def parsed_fasta(df: DataFrame, text: str) -> DataFrame:
    """df with fasta_id, first and second; null unless there are exactly two chains that aren't empty."""
    x = F.col(text)
    m = r"^>([^\n]+)\n([^:\n]+):([^:\n]+)\n?$"
    part = lambda i: F.nullif(F.regexp_extract(x, m, i), F.lit(""))
    return df.withColumns({"fasta_id": part(1), "first": part(2), "second": part(3)})


def archive_member(archives: DataFrame, name: str, most_bytes: int = 2 << 30) -> DataFrame:
    """(path, text, status, error): the one member called ``name`` (in any folder) of each zip or tar archive; archives as read by binaryFile (path, content).

    An archive without exactly one such member, or with a larger one, gives a row with status failed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    row = (path, _member(content, name, most_bytes).decode(), "ok", "")
                except Exception as e:  # noqa: BLE001
                    row = (path, None, "failed", f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "text", "status", "error"), row, strict=True))], pa.schema([(c, pa.string()) for c in ("path", "text", "status", "error")]))

    return archives.select("path", "content").mapInArrow(run, "path string, text string, status string, error string")


def _member(content: bytes, name: str, most_bytes: int) -> bytes:
    file = io.BytesIO(content)
    if zipfile.is_zipfile(file):
        with zipfile.ZipFile(file) as z:
            found = [(i.file_size, i) for i in z.infolist() if not i.is_dir() and i.filename.rsplit("/", 1)[-1] == name]
            return _only(found, name, most_bytes, lambda i: z.read(i))
    file.seek(0)
    with tarfile.open(fileobj=file) as t:
        found = [(i.size, i) for i in t.getmembers() if i.isfile() and i.name.rsplit("/", 1)[-1] == name]
        return _only(found, name, most_bytes, lambda i: t.extractfile(i).read())


def _only(found: list, name: str, most_bytes: int, read) -> bytes:
    if len(found) != 1:
        raise ContractError(f"{len(found)} members are called {name}")
    if found[0][0] > most_bytes:
        raise ContractError(f"{name} has {found[0][0]} bytes")
    return read(found[0][1])


def alignment_blocks(df: DataFrame, text: str) -> DataFrame:
    """(.., block, block_text) of an alignment whose queries' blocks end with a NUL; block is the number in the first header."""
    parts = df.withColumn("_b", F.explode(F.split(F.col(text), "\\x00"))).where("trim(_b) <> ''")
    return parts.withColumns({"block": F.regexp_extract("_b", r"^\s*>\s*([0-9]+)", 1).try_cast("int"), "block_text": F.col("_b")}).drop("_b", text)


def padded_alignment(rows: Column, left: Column, right: Column) -> Column:
    """Alignment rows (array of header, sequence) with gaps for the other chain's columns."""
    return F.transform(rows, lambda r: F.struct(r["header"].alias("header"), F.concat(F.repeat(F.lit("-"), left), r["sequence"], F.repeat(F.lit("-"), right)).alias("sequence")))


def paired_alignment(left: Column, right: Column) -> Column:
    """Rows of two alignments (arrays of header, sequence) put side by side by their place, as far as both have rows; headers are joined by a tab."""
    both = F.slice(F.arrays_zip(left.alias("l"), right.alias("r")), 1, F.least(F.size(left), F.size(right)))
    return F.transform(both, lambda p: F.struct(F.concat_ws("\t", p["l"]["header"], p["r"]["header"]).alias("header"), F.concat(p["l"]["sequence"], p["r"]["sequence"]).alias("sequence")))


def alignment_problem(rows: Column, columns: Column, query: Column | None = None) -> Column:
    """Why an alignment can't be used: no rows, a row that doesn't have that many columns, letters that aren't residues or gaps, a first row that isn't the query; '' if it can."""
    wrong = F.exists(rows, lambda r: aligned_length(r["sequence"]) != columns)
    odd = F.exists(rows, lambda r: ~r["sequence"].rlike(r"^[A-Za-z.\-]*$"))
    out = F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "no_rows").when(odd, "letters").when(wrong, "columns")
    if query is not None:
        out = out.when(F.regexp_replace(rows[0]["sequence"], "[a-z.]", "") != query, "query")
    return out.otherwise("")


def member_list(seed: Column | str, model: Column | str) -> Column:
    """An aggregate: a group's members as text, seed_0:model_1;..., by seed and model."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    rows = F.array_sort(F.collect_list(F.struct(c(seed).alias("s"), c(model).alias("m"))))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("seed_"), r["s"].cast("string"), F.lit(":model_"), r["m"].cast("string"))), ";")


def aligned_length(sequence: Column) -> Column:
    """Columns of an alignment row: insertions (lower case, dots) don't count."""
    return F.length(F.regexp_replace(sequence, "[a-z.]", ""))


def parsed_report(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, low, mean, high, ok) of a report of lines of at least 13 words: two directions ('asym') and their highest ('max').

    ok: two directions of the same two chains, and the stated highest agrees to 5e-4.
    """
    w = F.split(F.trim(F.col("_line")), r"\s+")
    t = df.select(key, F.explode(F.split(F.col(text), "\n")).alias("_line")).select(key, w.alias("w")).where((F.size("w") >= 13) & F.col("w")[4].isin("asym", "max"))
    t = t.select(key, F.col("w")[0].alias("c1"), F.col("w")[1].alias("c2"), F.col("w")[4].alias("kind"), F.col("w")[5].try_cast("double").alias("v"))
    asym = F.col("kind") == "asym"
    g = t.groupBy(key).agg(F.min(F.when(asym, F.col("v"))).alias("low"), F.avg(F.when(asym, F.col("v"))).alias("mean"), F.max(F.when(asym, F.col("v"))).alias("high"), F.count_if(asym).alias("_n"), F.max(F.when(~asym, F.col("v"))).alias("_max"), F.count_distinct(F.when(asym, F.concat_ws(",", "c1", "c2"))).alias("_d"), F.count_distinct(F.when(asym, F.concat_ws(",", F.least("c1", "c2"), F.greatest("c1", "c2")))).alias("_u"))
    return g.select(key, "low", "mean", "high", F.coalesce((F.col("_n") == 2) & (F.col("_d") == 2) & (F.col("_u") == 1) & (F.abs(F.col("_max") - F.col("high")) <= 5e-4), F.lit(False)).alias("ok"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once in the checkpoint folder: what reads it several times doesn't compute it again."""
    spark = df.sparkSession
    table_checkpoint(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_checkpoint(spark: SparkSession) -> None:
    """Make sure checkpoint() has a folder: the session's spark.checkpoint.dir; where it is unset, one of this machine in local mode only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="polyrank-"))
