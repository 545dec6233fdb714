"""Session helpers shared by all operators: tables, cut lineage, size-checked broadcast."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many estimated bytes; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows of one key that one task of a shuffled join takes; keys with more are split.
HOT = 100_000
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder; in local mode, without either, a temporary folder.

    On a cluster without one there is an error: tables on one machine's disk would be lost on the others.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_quirelight_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="quirelight-")
        spark._quirelight_dir = own
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, columnar, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)  # of whatever file system; when the driver's JVM ends
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written so far, and give their number. For long sessions, after a query's result has been used; frames that read the tables can't be used any more."""
    paths, _WRITTEN[:] = list(_WRITTEN), []
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def bounded_broadcast(small: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``small`` with a broadcast hint if ``rows`` (a counted number) stay under ``BROADCAST_BYTES``; else unchanged, so that Spark shuffles."""
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small


def spread_join(big: DataFrame, small: DataFrame, on: list[str], counts: DataFrame, salt: Column, most: int = HOT, how: str = "inner") -> DataFrame:
    """A shuffled join that splits hot keys: ``counts`` has ``(*on, n)``, the rows that a key has in ``big``.

    A key of more than ``most`` rows is cut into parts of about ``most`` by ``salt`` (a hash column of ``big``); the row of ``small``
    is copied to each part. Hot keys are at most rows / ``most``. No row is lost, and each pair comes out once.
    """
    hot = cut(counts.where(F.col("n") > most).groupBy(*on).agg(F.ceil(F.max("n") / most).cast("int").alias("_parts")))
    k = hot.count()
    if not k:
        return big.join(small, on, how)
    hot = bounded_broadcast(hot, k)
    left = big.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(salt, F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    right = small.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def clean_source(col):
    """Sources are compared without case and outer blanks."""
    return F.lower(F.trim(col))
