"""Sinks: what the pipelines write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An address that must not look like an element in written markup (fixed value).
MARKUP_REWRITES = {"<email>": "&lt;email&gt;"}


def write_json(rows: DataFrame, path: str, column: str = "json", mode: str = "overwrite") -> None:
    """One JSON text on each line."""
    rows.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_markup(rows: DataFrame, path: str, by: str, column: str = "markup", mode: str = "overwrite") -> None:
    """Marked-up documents ``(by, value)`` as a table, literal rewrites done; ``files.upload`` makes files of it."""
    out = F.col(column)
    for old, new in MARKUP_REWRITES.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    rows.select(by, out.alias("value")).write.mode(mode).parquet(path)


def write_texts(rows: DataFrame, *paths: str, column: str = "value", mode: str = "overwrite") -> None:
    """Plain texts, to each of the paths (a served copy is a second path); they are made once and copied from the first path."""
    out = rows.select(F.col(column).alias("value"))
    for p in paths:
        out.write.mode(mode).text(p)
        out = rows.sparkSession.read.text(paths[0])


def append_seen(rows: DataFrame, path: str, key: str = "path") -> None:
    """Add keys to the table of what was processed."""
    rows.select(key).distinct().write.mode("append").parquet(path)


def fresh(rows: DataFrame, path: str) -> None:
    """Replace what lies under a path."""
    rows.write.mode("overwrite").parquet(path)


def deliver(rows: DataFrame, send: Callable[[dict], None] | None = None) -> int:
    """Hand each row to a service, on the executors; without one nothing is sent. Rows whose delivery fails are counted, not lost silently."""
    if send is None:
        return 0

    def run(batches):
        import pyarrow as pa

        for b in batches:
            failed = 0
            for r in b.to_pylist():
                try:
                    send(r)
                except OSError:
                    failed += 1
            yield pa.RecordBatch.from_pydict({"failed": [failed]})

    return rows.mapInArrow(run, "failed bigint").agg(F.coalesce(F.sum("failed"), F.lit(0))).first()[0]
