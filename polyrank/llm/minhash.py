"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles, each as one 64-bit hash; its sketch is the K smallest. Equal sets
are one class, represented by its smallest doc_id, so copies make no pairs. Retained values form inverted lists of
classes. Two sets that are similar enough share at least LEAST of K values but for a chance of about 1e-5 (all the
more of a small whole set), so each class stands only in the lists of its ``size - needed + 1`` rarest values: a
passage that many documents share is dropped where they have values of their own. Lists of up to SMALL classes
give all pairs; a longer one compares its classes with its hub, the one whose values are most common. The share of
common values among the K smallest of the union estimates a pair's similarity and filters; the full sets confirm
it exactly. What is not in its hub's component after that is compared with all that share the hub, in blocks of
BLOCK by BLOCK full sets, each a product of matrices in a task of its own; only links between components come out.
Components come from label propagation with pointer jumping over written tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, documents, drop_table, hot_keys, join_apart, scratch, texts_as_bytes, written

WORDS, K, LEAST, SMALL = 5, 32, 13, 24
#: Sets on each side of a block.
BLOCK = 128
#: Similarity of 75 % or more links.
PERCENT = 75
#: Pairs whose estimate is below are not confirmed; LEAST / K.
ESTIMATE = 0.4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(raws: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes (signed) of each text's distinct shingles: of 5 words each, or of all its words if it has fewer; none without words."""
    number: dict[bytes, int] = {}
    texts = [np.array([number.setdefault(w, len(number)) for w in r.lower().split()], np.int64) for r in raws]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    out = []
    for t in texts:
        h, n = hashes[t], len(t)
        if n >= WORDS:
            x = h[: n - WORDS + 1] * _ODD[0]
            for i in range(1, WORDS):
                x += h[i : n - WORDS + 1 + i] * _ODD[i]
        else:
            x = (h * _ODD[:n]).sum(keepdims=True) + np.uint64(n) if n else h
        out.append(np.unique(_mixed(x).view(np.int64)))
    return out


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n (size of the set), h1, h2 (hash of the set) and sketch (its k smallest hashes) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, 1):
            sets = shingle_sets(texts_as_bytes(b.column(1)))
            h = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "h1": h[:, 0].copy(), "h2": h[:, 1].copy(), "sketch": pa.array([s[:k] for s in sets], pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def alike_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def needed(size: Column) -> Column:
    """How many values two sketches share at least if their sets are similar: exact for whole small sets."""
    return F.when(size <= 24, F.ceil(size * PERCENT / 100)).otherwise(F.lit(LEAST)).cast("int")


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """(v, node, n, common): each class under its rarest values, those that another class has too. common: how common its values are."""
    values = nodes.select("node", "h1", "n", F.explode("sketch").alias("v"))
    counts = written(values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "value-counts")
    rows = join_apart(values, counts, ["v"], hot_keys(counts, ["v"], "c"), "left").select("node", "h1", "n", F.struct(F.coalesce("c", F.lit(1)).alias("c"), "v").alias("x"))
    own = rows.groupBy("node", "h1", "n").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    own = own.withColumn("common", F.aggregate("xs", F.lit(0).cast("long"), lambda s, x: s + x["c"]))
    size = F.size("xs")
    kept = own.select("node", "n", "common", F.explode(F.slice("xs", F.lit(1), size - needed(size) + 1)).alias("x"))
    return written(kept.where("x.c > 1").select(F.col("x.v").alias("v"), "node", "n", "common"), "lists")


def pairs_in_lists(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) that the first round compares, and the long lists."""
    heads = lists.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("common", (-F.col("node")).alias("minus"), F.col("n").alias("hn"))).alias("head")).where("m > 1")
    heads = written(heads.select("v", "m", (-F.col("head.minus")).alias("hub"), F.col("head.hn").alias("hub_n")), "heads")
    hot = hot_keys(heads.where(F.col("m") > SMALL), ["v"], "m")
    long = join_apart(lists, heads.where(F.col("m") > SMALL), ["v"], hot)
    star = long.where((F.col("node") != F.col("hub")) & alike_in_size(F.col("n"), F.col("hub_n"))).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    cold = lists.join(F.broadcast(hot), "v", "left_anti")
    short = cold.join(heads.where(F.col("m") <= SMALL).select("v"), "v").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("xs"))
    left = short.select("xs", F.posexplode("xs").alias("i", "x"))
    both = left.select(F.col("x.node").alias("a"), F.explode(F.filter(F.slice("xs", F.col("i") + 2, F.size("xs")), lambda y: (y["node"] != F.col("x.node")) & alike_in_size(y["n"], F.col("x.n")))["node"]).alias("b"))
    groups = long.select("hub", "node").unionByName(long.select("hub", F.col("hub").alias("node"))).distinct()
    return star.unionByName(both).distinct(), written(groups, "hub-groups")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): the whole sets of the documents in wanted (doc_id)."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, 1):
            yield pa.RecordBatch.from_pydict({"node": b.column(0), "s": pa.array([s.tobytes() for s in shingle_sets(texts_as_bytes(b.column(1)))], pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id")  # wanted grows with the data: one plan at every size
    return written(texts.mapInArrow(sets, "node long, s binary"), "sets")


def similar_in_block(table: pa.Table) -> pa.Table:
    """Links (a, b) between components among the sets of a block: rows of side 0 against those of side 1, one for each component that a row reaches."""
    side = np.array(table.column("side").to_pylist())
    node, comp = np.array(table.column("node").to_pylist(), np.int64), np.array(table.column("comp").to_pylist(), np.int64)
    sets = [np.frombuffer(s, np.int64) for s in table.column("s").to_pylist()]
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    if len(x) and len(y):
        sizes = np.array([len(s) for s in sets])
        values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)  # a value of one set adds to no intersection
        number = np.full(len(values), -1)
        number[shared] = np.arange(len(shared))
        column, row = number[at], np.repeat(np.arange(len(sets)), sizes)
        both = np.zeros((len(x), len(y)), np.int64)
        for c in range(0, len(shared), 4096):
            here = (column >= c) & (column < c + 4096)
            m = np.zeros((len(sets), min(4096, len(shared) - c)), np.float32)
            m[row[here], column[here] - c] = 1
            both += (m[x] @ m[y].T).astype(np.int64)
        union = sizes[x][:, None] + sizes[y][None] - both
        hit = (100 * both >= PERCENT * union) & (both > 0) & (comp[x][:, None] != comp[y][None])
        for i, j in zip(*np.nonzero(hit), strict=True):
            a, b = int(node[x[i]]), int(node[y[j]])
            out.setdefault((a, int(comp[y[j]])), (min(a, b), max(a, b)))
    found = sorted(set(out.values()))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def links_in_hub_groups(groups: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components within each hub's group: what isn't in the hub's component, against the whole group."""
    named = groups.join(labels, "node", "left").select("hub", "node", F.coalesce("comp", "node").alias("comp"))
    named = written(named, "hub-components")
    home = named.where("node = hub").select("hub", F.col("comp").alias("home"))
    hot = hot_keys(written(named.groupBy("hub").agg(F.count(F.lit(1)).alias("m")), "hub-sizes"), ["hub"], "m")
    counts = join_apart(named, home, ["hub"], hot).groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nj"), F.ceil(F.count_if(F.col("comp") != F.col("home")) / BLOCK).cast("int").alias("ni"), F.max("home").alias("home")).where("ni > 0")
    counts = written(counts, "hub-counts")
    rows = join_apart(named, counts, ["hub"], hot)
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    away = rows.where("comp <> home").select("hub", "node", "comp", F.lit(0).alias("side"), block("ni").alias("i"), upto("nj").alias("j"))
    all_ = rows.select("hub", "node", "comp", F.lit(1).alias("side"), upto("ni").alias("i"), block("nj").alias("j"))
    blocks = away.unionByName(all_).join(sets, "node")
    return blocks.groupBy("hub", "i", "j").applyInArrow(similar_in_block, "a long, b long")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose union sketch says that they may be similar."""
    s = nodes.select("node", "sketch")
    both = pairs.join(s.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a").join(s.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    common = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    return both.where(common >= ESTIMATE * F.size(union)).select("a", "b").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.withColumnsRenamed({"node": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "s": "sb"}), "b")
    return written(both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of links (a, b): the smallest node that each reaches."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both-ways")
    table = labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "m").alias("c"))
        jump = step.join(labels.select(F.col("node").alias("c"), F.col("comp").alias("cc")), "c", "left")
        new = written(jump.select("node", F.least("c", F.coalesce("cc", "c")).alias("comp"), F.col("comp").alias("was")), "labels")
        drop_table(table)
        table, labels = new, new.select("node", "comp")
        if not new.where("comp < was").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of docs.

    Documents without words are linked with nothing. Rows of one doc_id share a component, whatever their texts. A row
    without an id is linked with nothing, has no component and is kept. Other columns of docs are not read.
    """
    with scratch() as keep:
        rows = keep(written(sketches(docs), "sketches"))
        names = keep(_classes(docs, rows))
    some, keys = rows.where("n > 0").select("doc_id", "n", "h1", "h2"), ["h1", "h2"]
    named = join_apart(some, names.drop("copies"), keys, hot_keys(names, keys, "copies"), "left")
    named = named.unionByName(rows.where("n = 0").select("doc_id", "n", "h1", "h2", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(h1, h2, component, copies) of each class of equal sets, written."""
    best = rows.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").alias("node"), "n", "sketch")).alias("m"), F.count(F.lit(1)).alias("copies"))
    nodes = written(best.select("h1", "h2", "copies", "m.*"), "classes")
    first, groups = pairs_in_lists(inverted_lists(nodes))
    pairs = written(estimated(first, nodes), "pairs")  # the last that needs the lists
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(groups.select(F.col("node").alias("doc_id"))).distinct()
    sets = full_sets(docs, wanted)
    links = confirmed(pairs, sets)
    labels = components(links)
    more = written(links_in_hub_groups(groups, labels, sets), "more-links")
    if more.limit(1).count():
        labels = components(links.unionByName(more).distinct())
    return written(nodes.select("h1", "h2", "copies", "node").join(labels, "node", "left").select("h1", "h2", "copies", F.coalesce("comp", "node").alias("component")), "components")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id.

    Rows of this id that are equal in all columns are one; those that differ stay: an id alone makes no duplicates.
    Rows without an id are linked with nothing; of those that are equal in all columns one stays.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    own = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns)
    key = "_row_" + "_".join(docs.columns)  # no column's name
    rows = own.unionByName(docs.where("doc_id is null")).withColumn(key, F.xxhash64(*docs.columns))
    return rows.dropDuplicates(["doc_id", key]).drop(key)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other),
m AS (SELECT node, min(other) AS comp FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp, d.doc_id) AS component_id, coalesce(comp, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""
