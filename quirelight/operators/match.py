"""Matching known texts against pages, and leaving out what is known."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.functions.text import inner_strip

#: Bytes of texts that one search automaton holds; more texts are searched block after block.
BLOCK_BYTES = 8 << 20


def spaceless(text: Column) -> Column:
    return F.replace(inner_strip(text), F.lit(" "), F.lit(""))


#: The last automaton of a worker, by its block's name: tasks of a stage share it.
_BUILT: dict[str, object] = {}


def _machine(shared: Broadcast, name: str):
    import ahocorasick

    if name not in _BUILT:
        ids: dict[str, list] = {}
        for i, t in pickle.loads(shared.value):
            ids.setdefault(t, []).append(i)
        machine = ahocorasick.Automaton()
        for t, own in ids.items():
            machine.add_word(t, own)
        machine.make_automaton()
        _BUILT.clear()
        _BUILT[name] = machine
    return _BUILT[name]


def occurrences(texts: DataFrame, pages: DataFrame, text_id: str, page_id: str) -> DataFrame:
    """``(text_id, page_id)``: the texts that stand in a page, both without blanks and line feeds.

    The texts become an automaton that reads each page once, whatever their number; it is broadcast in blocks of bounded
    size, so there is neither a join over pairs nor a shuffle. Null and empty texts stand nowhere.
    """
    short = texts.select(F.col(text_id), spaceless(F.col("text")).alias("t")).where("t <> ''").distinct()
    bodies = pages.select(F.col(page_id), spaceless(F.col("text")).alias("t")).where("t <> ''")
    kinds = f"`{text_id}` {short.schema[0].dataType.simpleString()}, `{page_id}` {bodies.schema[0].dataType.simpleString()}"
    found: list[DataFrame] = []

    def search(block: list[tuple]) -> DataFrame:
        shared, name = texts.sparkSession.sparkContext.broadcast(pickle.dumps(block)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _machine(shared, name)
            for b in batches:
                left, right = [], []
                for page, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own = {i for _, x in machine.iter(t) for i in x}
                    left += own
                    right += [page] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(left, b_type), pa.array(right, b.schema.field(0).type)], [text_id, page_id])

        return bodies.mapInArrow(run, kinds)

    from pyspark.sql.pandas.types import to_arrow_type

    b_type = to_arrow_type(short.schema[0].dataType)
    block, size = [], 0
    for r in short.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size > BLOCK_BYTES:
            found.append(search(block))
            block, size = [], 0
    if block or not found:
        found.append(search(block) if block else texts.sparkSession.createDataFrame([], kinds))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def whats_new(texts: DataFrame, pages: DataFrame, text_id: str, page_id: str) -> DataFrame:
    """The distinct texts (stripped within) that stand in some page."""
    there = occurrences(texts, pages, text_id, page_id).select(text_id).distinct()
    return texts.join(there, text_id, "left_semi").select(inner_strip(F.col("text")).alias("text")).distinct()


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among the seen ones; null keys are never seen."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")
