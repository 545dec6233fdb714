"""Problem 7: held-out test items that stand in corpus documents.

Method: winnowing. Both sides are cut into words; a k-gram of words is hashed and of every ``WINDOW`` k-grams in a row
the smallest hash is kept as fingerprint. A span of ``k + WINDOW - 1`` equal words always shares a fingerprint, so with
k = 5 and a window of 6 no shared span of 10 words is missed. The fingerprints of documents are joined with those of the
items; around a hit the hashes of the spans of 10 words that hold it are joined with the items' spans, so a fingerprint
that very many items share costs nothing where the span differs. Spans that follow each other in a document and an item
are one: as each of its parts of 10 words has a fingerprint, that is the whole shared span. Items with fewer words
than a span are looked up whole, at every place whose words stand in such items.

The items' spans are broadcast if their counted number allows. Else documents keep the spans whose bit is set in a map of
fixed size that all items' spans have set, and meet the items' spans in a shuffled join that splits hot spans. Either
way the corpus is read once, whatever the number of items. Words and spans are compared by 64-bit hashes.

Defined results: null, empty and blank texts hold nothing and items without a word leak nowhere; an item that occurs
several times with the same id counts once per document and id; ties and repeated documents are judged row by row, and
a document id occurring twice gives one row; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelight.common import BROADCAST_BYTES, cut, spread_join

K, WINDOW, SPAN = 5, 6, 10
#: Bytes of an item's span in a task; bits of the map that stands for spans beyond the bound for broadcasts.
SPAN_BYTES, MAP_BITS = 64, 1 << 27
#: Entries of a worker's memo of words; a full memo is emptied, which changes no result.
MEMO = 400_000

_U = np.uint64

_WORD = re.compile(r"[^\W_]+").findall
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*(?:\r\n|\r|\n)(?=[^\W\d_])")
#: Invisible format characters (category Cf) but the soft hyphen, which may break a word at a line end.
_FORMAT = re.compile("[؀-؅؜۝܏࣢᠎​-‏‪-‮⁠-⁤⁦-⁯﻿￹-￻\U000e0001\U000e0020-\U000e007f]")


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in compatibility form and without case."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _FORMAT.sub("", text))
    if "-\n" in text or "-\r" in text or "- " in text or not text.isascii():
        text = _BROKEN.sub("", text).replace("­", "")
    return _WORD(text.lower() if text.isascii() else text.casefold())


class _Memo(dict):
    """Words to hashes, none of which is 0."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) or 1
        return value


_MEMO = _Memo()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, a 0 behind each text, and where each text begins (and the last one ends)."""
    every = [words(t) for t in texts]
    flat = np.fromiter(chain.from_iterable(chain(map(_MEMO.__getitem__, ws), (0,)) for ws in every), _U, sum(map(len, every)) + len(every))
    return flat, np.concatenate([[0], np.cumsum([len(ws) + 1 for ws in every])]).astype(np.int64)


def grams_at(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams of ``ids`` that begin at some places."""
    h = np.full(len(at), k, _U)
    for j in range(k):
        h = h * _U(0x9E3779B97F4A7C15) + ids[at + j] + _U(1)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Of all k-grams."""
    return grams_at(ids.astype(_U), np.arange(max(0, len(ids) - k + 1)), k)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the fingerprints: the (rightmost) smallest hash of each window; all of a shorter row's smallest."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(rows)) + window - 1 - np.argmin(rows, axis=1))


class Sorted:
    """A set of hashes as a sorted array."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(h), bool)
        return self.values[np.minimum(np.searchsorted(self.values, h), len(self.values) - 1)] == h


class BitMap:
    """A set of hashes as a map of bits; others may share their bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h & _U(8 * len(self.bits) - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@dataclass
class Index:
    """What documents are searched for: the items' fingerprints, spans (with whole short items), short items' words and their numbers of words."""

    marks: Sorted | BitMap
    spans: Sorted | BitMap
    words: Sorted | BitMap
    lengths: list[int]

    def scan(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, word number, number of words and hash of each span of the texts that may be an item's."""
        ids, starts = word_hashes(texts)
        h = grams(ids, K)
        at = winnow(h)
        hit = at[self.marks(h[at])]
        begins = np.unique((hit[:, None] - np.arange(SPAN - K + 1)).ravel())
        found = [(begins[(begins >= 0) & (begins <= len(ids) - SPAN)], SPAN)]
        if self.lengths:
            run = np.concatenate([[0], np.cumsum(~self.words(ids))])
            for k in self.lengths:
                found.append((np.flatnonzero(run[k:] == run[:-k]) if len(run) > k else np.zeros(0, np.int64), k))
        at = np.concatenate([x for x, _ in found])
        size = np.repeat([k for _, k in found], [len(x) for x, _ in found])
        g = np.concatenate([grams_at(ids, x, k) for x, k in found])
        keep = self.spans(g)
        at, size, g = at[keep], size[keep], g[keep]
        row = np.searchsorted(starts, at, "right") - 1
        inside = at + size < starts[row + 1]  # not over a text's end
        at, size, g, row = at[inside], size[inside], g[inside], row[inside]
        return row, at - starts[row], size, g


_GRAMS = "item_id bigint, item bigint, place int, size int, g bigint, mark bigint, word bigint"


def item_grams(items: DataFrame) -> DataFrame:
    """``(item_id, item, place, size, g, mark, word)``: of each item (``item`` is its text's hash) every span of 10 words, or the whole of a shorter one, and its fingerprints and, of a short one, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item_id, item, text in zip(*[c.to_pylist() for c in b.columns]):
                ids = word_hashes([text])[0][:-1]
                if not len(ids):
                    continue
                k = min(SPAN, len(ids))
                g, h = grams(ids, k), grams(ids, K)
                mark, word = (h[winnow(h)], ids[:0]) if k == SPAN else (h[:0], ids)
                n = max(len(g), len(mark), len(word))
                column = lambda x: pa.array([*x.view(np.int64).tolist(), *[None] * (n - len(x))], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item_id] * n, pa.int64()), pa.array([item] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([k] * n, pa.int32()), column(g), column(mark), column(word)],
                    ["item_id", "item", "place", "size", "g", "mark", "word"],
                )

    source = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), F.xxhash64("text").alias("item"), F.col("text").cast("string")).distinct()
    return source.mapInArrow(run, _GRAMS)


def _bit_map(grams: DataFrame, column: str) -> BitMap:
    """The map of a column's hashes, packed in pages on the executors; ``MAP_BITS`` in all."""
    bits = min(MAP_BITS, BROADCAST_BYTES * 8 // 2)
    page = 1 << 15
    at = F.col(column).bitwiseAND(bits - 1)
    pages = grams.where(F.col(column).isNotNull()).groupBy(F.floor(at / page).alias("page")).agg(F.collect_set((at % page).cast("int")).alias("bits"))  # at most ``page`` in a set

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own in b.column(1):
                there = np.zeros(page, np.uint8)
                there[own.values.to_numpy()] = 1
                out.append(np.packbits(there, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["page", "bits"])

    every = np.zeros((max(1, bits // page), page // 8), np.uint8)
    packed = pages.mapInArrow(pack, "page bigint, bits binary").toArrow()
    for n, own in zip(packed.column(0).to_pylist(), packed.column(1).to_pylist()):
        every[n] = np.frombuffer(own, np.uint8)
    return BitMap(every.ravel())


def _matches(documents: DataFrame, items: DataFrame, places: bool) -> DataFrame:
    """``(doc_id, item_id, item, place, at, size)`` of every span of 10 words, or whole shorter item, that a document and an item share; without ``places`` distinct ``(doc_id, item_id)``."""
    source = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    grams = cut(item_grams(items))
    lengths = [r[0] for r in grams.where(F.col("size") < SPAN).select("size").distinct().orderBy("size").collect()]  # nine at most
    small = grams.count() * SPAN_BYTES <= BROADCAST_BYTES
    if small:
        rows = grams.toArrow()
        value = lambda c: rows.column(c).drop_null().to_numpy().view(_U)
        index = Index(Sorted(value("mark")), Sorted(value("g")), Sorted(value("word")), lengths)
        own = rows.filter(rows.column("g").is_valid()).sort_by("g")
        table = tuple(own.column(c).to_numpy() for c in ("g", "item_id", "item", "place"))
    else:
        index, table = Index(_bit_map(grams, "mark"), _bit_map(grams, "g"), _bit_map(grams, "word"), lengths), None
    shared = documents.sparkSession.sparkContext.broadcast((index, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                row, at, size, g = index.scan(part.column(1).to_pylist())
                if not len(row):
                    continue
                g = g.view(np.int64)
                if table is not None:  # each span meets all items that have it
                    lo, hi = np.searchsorted(table[0], g, "left"), np.searchsorted(table[0], g, "right")
                    n = hi - lo
                    which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    row, at, size = np.repeat(row, n), np.repeat(at, n), np.repeat(size, n)
                    item_id, item, place = (c[which] for c in table[1:])
                    if not places:
                        pairs = np.unique(np.stack([row, item_id], axis=1), axis=0)
                        row, item_id = pairs[:, 0], pairs[:, 1]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(item_id)], ["doc_id", "item_id"])
                        continue
                    columns = [item_id, item, place, at.astype(np.int32), size.astype(np.int32)]
                    names = ["item_id", "item", "place", "at", "size"]
                else:
                    columns, names = [g, at.astype(np.int32), size.astype(np.int32)], ["g", "at", "size"]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *map(pa.array, columns)], ["doc_id", *names])

    if small:
        kind = "doc_id bigint, item_id bigint" + (", item bigint, place int, at int, size int" if places else "")
        return source.mapInArrow(run, kind).distinct()
    found = cut(source.mapInArrow(run, "doc_id bigint, g bigint, at int, size int"))
    counts = found.groupBy("g", "size").agg(F.count("*").alias("n"))
    own = grams.where("g is not null").select("g", "size", "item_id", "item", "place")
    met = spread_join(found, own, ["g", "size"], counts, F.xxhash64("doc_id", "at"))
    return met.select("doc_id", "item_id", *(["item", "place", "at", "size"] if places else [])).distinct()


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds ``SPAN`` words in a row of an item, or all of a shorter item."""
    return _matches(documents, items, False)


def spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, item_start, length)``: every longest span of words that a document shares with an item and that makes a leak; starts count words from 0."""
    found = _matches(documents, items, True)
    way = Window.partitionBy("doc_id", "item_id", "item", "size", F.col("at") - F.col("place")).orderBy("at")
    runs = found.withColumn("run", F.col("at") - F.row_number().over(way))
    whole = runs.groupBy("doc_id", "item_id", "item", "size", (F.col("at") - F.col("place")).alias("shift"), "run").agg(F.min("at").alias("start"), F.min("place").alias("item_start"), F.count("*").alias("n"))
    return whole.select("doc_id", "item_id", "start", "item_start", (F.col("n") + F.col("size") - 1).cast("int").alias("length")).distinct()
