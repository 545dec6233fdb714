"""Shared folder, tables that are released, joins with hot keys."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quirelight import common


def test_hot_keys(spark):
    """A key that holds most rows is split; the result is that of the plain join."""
    big = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 > 0, (F.col("id") % 7).cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("1", 2), ("nowhere", 3)], "k string, v int")
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        plain = big.join(small, "k", how).select("k", "id", "v")
        spread = common.spread_join(big, small, ["k"], counts, F.xxhash64("id"), 100, how).select("k", "id", "v")
        assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
    assert common.spread_join(big, small, ["k"], counts, F.xxhash64("id")).count() == big.join(small, "k").count()
    assert common.spread_join(big.limit(0), small, ["k"], counts.limit(0), F.xxhash64("id"), 1).count() == 0


def test_release(spark):
    df = common.cut(spark.range(5))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(folder)
    assert common.release(spark) >= 1 and not os.path.isdir(folder)


def test_shared_folder():
    """The setting first, then the context's folder; on a cluster without either an error."""

    def session(conf, given, master):
        option = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)), master=master)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: conf or default), sparkContext=context)

    assert common.shared_dir(session("hdfs://a/b/", "file:/x", "yarn")) == "hdfs://a/b"
    assert common.shared_dir(session(None, "hdfs://a/c", "yarn")) == "hdfs://a/c"
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(None, None, master))
    assert common.shared_dir(session(None, None, "local[4]")).startswith("file:///")
