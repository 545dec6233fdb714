"""Sources: files and folders as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions.text import basename, safe_name

#: Formats by the end of a name; others are rejected.
FORMATS = {"pdf": "pdf", "html": "html", "txt": "text", "conll3": "conll"}


def scan(spark: SparkSession, root: str, pattern: str = "*", shuffle_seed: int | None = None) -> DataFrame:
    """``(path, length, modified)`` of the files under ``root`` whose names fit, recursively; in an order by the seed if given. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = files.select("path", "length", F.col("modificationTime").alias("modified"))
    return files if shuffle_seed is None else files.orderBy(F.rand(shuffle_seed))


def names(files: DataFrame, suffixes: tuple[str, ...], without: bool = False) -> DataFrame:
    """``name`` of the files that end in one of the suffixes, or of the others."""
    name = basename(F.col("path"))
    fits = F.lit(False)
    for s in suffixes:
        fits = fits | F.endswith(name, F.lit(s))
    return files.where(~fits if without else fits).withColumn("name", name)


def whole_texts(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``(path, value)``: each file as one text."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern)
    return reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def file_format(path: Column) -> Column:
    """The format by the end of the name; null for unknown ones."""
    out = F.lit(None).cast("string")
    for suffix, name in FORMATS.items():
        out = F.when(F.endswith(F.lower(path), F.lit(suffix)), name).otherwise(out)
    return out


def dispatch(files: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The files of each known format, and the rejected rest."""
    known = files.withColumn("format", file_format(F.col("path")))
    return {f: known.where(F.col("format") == f) for f in sorted(set(FORMATS.values()))}, known.where("format is null")


def word_list(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """``word`` of a file with one word on each line, of so many characters at least."""
    return spark.read.text(path).where(F.length("value") >= least).select(F.col("value").alias("word"))


def upload(contents: DataFrame, root: str) -> int:
    """Write each ``(filename, content)`` as a file under ``root`` and give their number; a file that is there is replaced, so a task may run again.

    The executors write, to any file system that Arrow knows; names are made safe (their ending stays) and never reach a shell. Null names and contents are left out.
    """
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(root)
    system.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.encode() if isinstance(content, str) else content)
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    ending = F.regexp_extract("filename", r"(\.[0-9A-Za-z]+)?$", 0)
    name = F.concat(safe_name(F.regexp_replace("filename", r"\.[0-9A-Za-z]+$", "")), ending)
    rows = contents.where("filename is not null and content is not null").select(name.alias("filename"), "content")
    return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def cached_state(spark: SparkSession, state: str, paths: DataFrame) -> DataFrame | None:
    """The table kept under ``state`` if it was made of the same set of paths, else None."""
    if not exists(spark, state):
        return None
    kept = spark.read.parquet(state)
    return kept.drop("inputs") if kept.limit(1).where(F.col("inputs") == F.lit(inputs_hash(paths))).count() else None


def keep_state(result: DataFrame, state: str, paths: DataFrame) -> None:
    """Keep a result with the hash of the paths it was made of."""
    result.withColumn("inputs", F.lit(inputs_hash(paths))).write.mode("overwrite").parquet(state)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something lies under a path, of whatever file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def inputs_hash(paths: DataFrame) -> str:
    """A hash of a set of paths that needs no sort: sums of two hashes over the distinct ones, and their number."""
    h = paths.select("path").distinct().agg(F.count("*"), F.sum(F.xxhash64("path").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("x"), "path"))).first()
    return "-".join(map(str, h))
