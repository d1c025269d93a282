import pytest
from polyrank.llm import common
from pyspark.sql import functions as F


def test_hot_keys_join_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    left = spark.range(1000).selectExpr("if(id % 3 = 0, 7, id) as k", "id as v")
    right = spark.range(0, 1000, 2).selectExpr("id as k", "id * 10 as w").union(spark.createDataFrame([(7, 70)], "k long, w long"))
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = common.hot_keys(counts, ["k"], "n")
    assert [r.k for r in hot.collect()] == [7]
    for how in ("inner", "left"):
        key = lambda r: (r.k, r.v)
        assert sorted(common.join_apart(left, right, ["k"], hot, how).select("k", "v", "w").collect(), key=key) == sorted(left.join(right, "k", how).select("k", "v", "w").collect(), key=key)
    assert common.hot_keys(counts.where("k < 0"), ["k"], "n").count() == 0


def test_tables_go_once_nothing_reads_them(spark):
    import os

    with common.scratch() as keep:
        a = common.written(spark.range(5), "a")
        b = keep(common.written(a.where("id > 1"), "b"))
    assert not os.path.exists(a.written_to.removeprefix("file:")) and b.count() == 3
    with pytest.raises(ZeroDivisionError), common.scratch():
        c = common.written(spark.range(2), "c")
        raise ZeroDivisionError
    assert not os.path.exists(c.written_to.removeprefix("file:"))
    x, y = common.written_apart(spark.range(10).where("id < 7"), "x", "id < 3")
    assert (x.count(), y.count()) == (3, 4)
    common.drop_table(x)
    assert y.count() == 4
    none, all_ = common.written_apart(spark.range(3), "y", "id > 9")
    assert (none.count(), all_.count()) == (0, 3)
    common.drop_written(spark)
    assert not os.path.exists(b.written_to.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())
