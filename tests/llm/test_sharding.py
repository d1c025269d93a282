import hashlib

import pytest
from polyrank.llm import sharding
from pyspark.sql import functions as F

from .cases import clashing, empty_documents, odd_documents


def rows(df):
    return sorted((r.doc_id, r.text or "") for r in df.collect())


def test_arrivals_compact_into_target_sizes(spark, tmp_path):
    store = sharding.ShardStore(spark, f"{tmp_path}/store", target_bytes=1 << 30, fanout=3)
    df = odd_documents(spark)
    for i in range(10):
        store.append(df.withColumn("doc_id", F.col("doc_id") + 100 * i).repartition(3))
        store.compact()
    m = store.manifest()
    assert len(m.runs) < 5 and min(len(r.shards) for r in m.runs) == 1
    assert rows(store.read()) == sorted((r.doc_id + 100 * i, r.text or "") for r in df.collect() for i in range(10))
    assert len(store.versions()) == m.version
    early = rows(store.read(version=2))
    assert len(early) == 20
    store.vacuum()
    assert store.versions() == [m.version] and len(rows(store.read())) == 100


def test_a_taken_version_is_not_overwritten(spark, tmp_path):
    store = sharding.ShardStore(spark, f"{tmp_path}/store")
    store.append(odd_documents(spark))
    old = sharding.Manifest(0, None, 0, [])
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(old)
    assert len(rows(store.read())) == 10


def test_query_on_odd_and_empty_documents(spark, tmp_path):
    df = clashing(odd_documents(spark))
    for i in range(9):
        df.where(F.col("doc_id") % 9 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a/documents.parquet")
    df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/a/documents.parquet")
    got = sharding.op7_sharding(spark, f"{tmp_path}/a").collect()
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest() if r.text is not None else "") for r in df.collect() for _ in range(2))
    assert sorted((r.doc_id, r.text_sha256 or "") for r in got) == want
    assert all(r.run is not None and r.shard is not None for r in got)
    empty_documents(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert sharding.op7_sharding(spark, f"{tmp_path}/b").count() == 0


def test_schemas_evolve_or_are_refused(spark, tmp_path):
    store = sharding.ShardStore(spark, f"{tmp_path}/store", fanout=2)
    store.append(spark.createDataFrame([(1,)], "id long"))
    store.append(spark.createDataFrame([(2, "x")], "id long, b string"))
    store.append(spark.createDataFrame([("y",)], "b string"))
    want = [(None, "y"), (1, None), (2, "x")]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, store.read().select("id", "b").collect()), key=key) == want
    store.compact()
    assert len(store.manifest().runs) < 3 and sorted(map(tuple, store.read().select("id", "b").collect()), key=key) == want
    with pytest.raises(ValueError, match="types differ"):
        store.append(spark.createDataFrame([("3",)], "id string"))
    assert store.read(version=1).count() == 1


def test_arrivals_of_one_file_and_of_many(spark, tmp_path, monkeypatch):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat(cast(id as string), 50) as text")
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    got = list(sharding.arrivals(one, f"{tmp_path}/landing"))
    assert len(got) == sharding.FANOUT and sorted(r.doc_id for a in got for r in a.collect()) == list(range(4000))
    df.repartition(12).write.parquet(f"{tmp_path}/many")
    monkeypatch.setattr(sharding, "UNIT", 1 << 10)
    got = list(sharding.arrivals(spark.read.parquet(f"{tmp_path}/many"), f"{tmp_path}/landing2"))
    assert sharding.FANOUT < len(got) and sorted(r.doc_id for a in got for r in a.collect()) == list(range(4000))


def test_every_tier_is_compacted(spark, tmp_path):
    df = spark.range(1700).selectExpr("id as doc_id", "sha2(cast(id as string), 512) as text")
    df.repartition(17).write.parquet(f"{tmp_path}/documents.parquet")
    monkey, sharding.UNIT = sharding.UNIT, 600
    try:
        got = sharding.op7_sharding(spark, str(tmp_path)).collect()
    finally:
        sharding.UNIT = monkey
    assert sorted(r.doc_id for r in got) == list(range(1700)) and len({r.run for r in got}) <= 6
