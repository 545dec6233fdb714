"""Problem 2: lines repeated across one source's documents.

Method: each task keeps a mergeable heavy-hitter summary per source (frequent items with the surplus counter
subtracted), the summaries' counts are added up by line, the surviving candidates are counted exactly in a second pass
over all lines, and the confirmed lines are removed by a join whose small side is broadcast if its counted size allows.
Summaries of k counters underestimate by at most N / (k + 1) for N lines, and k is set per source so that this is
half the number of documents a repeated line needs at most: no repeated line can be missed. No group is gathered in one
task, also not for a source that holds most documents.

Two lines are the same if their letters are, leaving out case and the names of months and weekdays standing as words.
Defined results: rows with null source and null, empty or blank texts take no part; lines without a letter are never
repeated; several copies of a line in one document count once and all of them are found; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.common import bounded_broadcast, clean_source, cut

LEAST_DOCS, LEAST_SHARE = 4, 0.2

#: Names that don't tell lines apart (fixed values).
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_CALENDAR = r"(?<![\p{L}\p{N}_])(?:" + "|".join(sorted({x for n in MONTHS + WEEKDAYS for x in (n, n[:3])}, key=lambda x: (-len(x), x))) + r")(?![\p{L}\p{N}_])"


def line_key(line: Column) -> Column:
    """The letters that make a line the same as another; null without any."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(line), _CALENDAR, ""), r"[^\p{L}]+", "")
    return F.when(letters != "", F.xxhash64(letters))


class HeavyHitters:
    """Counts of the most frequent items; merging two summaries keeps the bound N / (k + 1) on what a count lacks."""

    def __init__(self, k: int, items: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.k = k
        self.items = np.zeros(0, np.int64) if items is None else items
        self.counts = np.zeros(0, np.int64) if counts is None else counts

    def add(self, items: np.ndarray, counts: np.ndarray | None = None) -> None:
        both = np.concatenate([self.items, items])
        weights = np.concatenate([self.counts, np.ones(len(items), np.int64) if counts is None else counts])
        self.items, at = np.unique(both, return_inverse=True)
        self.counts = np.bincount(at, weights, len(self.items)).astype(np.int64)
        if len(self.items) > self.k:
            surplus = np.partition(self.counts, len(self.counts) - self.k - 1)[len(self.counts) - self.k - 1]
            self.counts = self.counts - surplus
            self.items, self.counts = self.items[self.counts > 0], self.counts[self.counts > 0]


#: Lines that a task gathers of a source before they go into its summary.
_BUFFER = 50_000


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, HeavyHitters] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        keys = batch.column(2)
        ends, flat = keys.offsets.to_numpy(), keys.values.to_numpy(zero_copy_only=False)
        for n, (source, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if source not in held:
                held[source], waiting[source], size[source] = HeavyHitters(k), [], 0
            waiting[source].append(flat[ends[n] : ends[n + 1]])
            size[source] += int(ends[n + 1] - ends[n])
            if size[source] >= _BUFFER:
                held[source].add(np.concatenate(waiting[source]))
                waiting[source], size[source] = [], 0
    for source, h in held.items():
        if waiting[source]:
            h.add(np.concatenate(waiting[source]))
        yield pa.RecordBatch.from_pydict({"source": pa.array([source] * len(h.items), pa.string()), "k": pa.array([h.k] * len(h.items), pa.int64()), "key": pa.array(h.items), "n": pa.array(h.counts)})


def keyed_lines(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, keys)``: of each document that takes part the key of every line."""
    text = F.col("text")
    lines = F.transform(F.split(text, "\n"), line_key)
    return (
        documents.where(F.col("source").isNotNull() & text.rlike(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]"))
        .select("doc_id", clean_source(F.col("source")).alias("source"), lines.alias("keys"))
    )


def repeated_keys(keyed: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(source, key)`` of the lines that stand in at least so many and such a share of a source's documents."""
    own = F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))
    rows = keyed.select("source", own.alias("own"))
    need = F.greatest(F.lit(least_docs).cast("bigint"), F.ceil(F.col("docs") * least_share - 1e-9))
    # N lines and a need of T documents: with 2 N / T counters the summaries together lack at most T / 2 of a line's documents,
    # so the lines whose counts reach T / 2 are all that may be repeated, and no more than 2 N / T of them are
    sources = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.size("own")).cast("bigint").alias("lines"))
    sources = cut(sources.select("source", need.alias("need"), (F.floor(2 * F.col("lines") / need) + 1).cast("bigint").alias("k")))
    small = bounded_broadcast(sources, sources.count(), 80)
    summaries = rows.join(small, "source").select("source", "k", "own").mapInArrow(_summaries, "source string, k bigint, key bigint, n bigint")
    merged = summaries.groupBy("source", "key").agg(F.sum("n").alias("n")).join(small, "source")
    candidates = cut(merged.where("2 * n >= need").select("source", "key"))
    candidates_small = bounded_broadcast(candidates, candidates.count(), 80)
    counts = rows.select("source", F.explode("own").alias("key")).join(candidates_small, ["source", "key"]).groupBy("source", "key").agg(F.count("*").alias("n"))
    return counts.join(small, "source").where("n >= need").select("source", "key")


def repeated_lines(documents: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(doc_id, line_no)`` of every occurrence of a repeated line."""
    keyed = cut(keyed_lines(documents))
    repeated = cut(repeated_keys(keyed, least_docs, least_share))
    lines = keyed.select("doc_id", "source", F.posexplode("keys").alias("line_no", "key")).where("key is not null")
    return lines.join(bounded_broadcast(repeated, repeated.count(), 80), ["source", "key"]).select("doc_id", F.col("line_no").cast("int"))


def without_repeats(documents: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(doc_id, text)``: every document, its repeated lines taken out; other texts come out unchanged."""
    found = repeated_lines(documents, least_docs, least_share)
    gone = found.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    rest = F.filter(F.split("text", "\n"), lambda line, n: ~F.array_contains("gone", n))
    return documents.select("doc_id", "text").join(gone, "doc_id", "left").select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"))
