"""Problem 1: per-document text quality statistics, and prose told from lists, tables and junk by them.

Method: figures on the words, symbols and lines of each document's main body; a Gaussian mixture fitted to the
standardized figures of all documents by expectation-maximization (each round one pass that adds up small sums per
task); its components mapped to prose, list, table or junk by inspected examples.

Defined results: null, empty and blank texts, and documents of which nothing but template is left, have null figures
and no kind; repeated rows are judged each; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.common import clean_source, cut
from quirelight.llm import pages

#: Words that hold sentences together, in the corpus' languages (fixed values).
FUNCTION_WORDS = frozenset(
    """
    a an the this that these those of to in on at by for from with without over under near between into than as and or but nor
    so if when while because although though until since whereas whether which who whose what how why where there it its it's
    he she they we you i his her their our your my me him them us is isn't are aren't was were be been being am do does doesn't don't did has have
    had not no can could will would may might must shall should each every both either neither some any all most more less few many much
    other another such same own only just also too very then therefore after before during again once soon
    der die das den dem des ein eine einen einem einer eines und oder aber weil obwohl während dass ist sind war hat haben nicht kein keine
    keinen auf aus bei mit nach trotz ohne von vor zu zum zur im am für jeden jede jeder
    le la les l' un une des du de et ou mais car si que qui quand dans sur sous avec sans pour par pendant malgré depuis ce cet cette ces
    est sont ne pas chaque aucun aucune au aux après quelque même
    el los las una unos unas y o pero porque aunque cuando que en con sin por para del al desde esta este estos estas es son no cada
    """.split()
)
FIGURES = ("function", "sentence", "word_length", "symbols", "digits", "ended", "marked", "capitals", "words_a_line", "variety")

_MARK = re.compile(r"(?:[-–—•*o·#+]|\(?\d{1,3}[.)]|\[\d+\]|\d+(?:\.\d+)+)\s")
_ENDS = (".", "!", "?", ".\"", ":", "…")
_LETTERS_BLANKS = bytes(x for x in range(128) if chr(x).isalpha() or chr(x).isspace())
_PLAIN = b".,'\"-;:!?()"
_BEYOND = re.compile(r"[^\W\d_\x00-\x7f]+").findall
_DIGITS = b"0123456789"


def body_lines(lines: list[str], gone: list[bool]) -> list[str]:
    """The main body's lines, without page numbers and empty lines."""
    return [s for s, x in zip(map(str.strip, lines), gone) if not x and s and not (len(s) <= 4 and s.isdigit())]


class _Memo(dict):
    """Tokens to numbers: function word (lowest bit), begins with a capital (1), hash without case (the rest)."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        value = self[token] = (low in FUNCTION_WORDS) | token.istitle() << 1 | (xxhash.xxh32_intdigest(low) >> 2) << 2
        return value


_MEMO = _Memo()
#: Entries of a worker's memo; a full memo is emptied, which changes no result.
MEMO = 400_000


def figures(bodies: list[list[str]]) -> list[np.ndarray | None]:
    """``FIGURES`` of each main body; None for one without any line."""
    if len(_MEMO) > MEMO:
        _MEMO.clear()
    lines = list(chain.from_iterable(bodies))
    text = np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
    tokens = [s.split() for s in lines]
    n = np.array([len(t) for t in tokens], np.int64)
    v = np.fromiter(map(_MEMO.__getitem__, chain.from_iterable(tokens)), np.int64, int(n.sum()))
    line = np.repeat(np.arange(len(lines)), n)
    f, up = np.bincount(line, v & 1, len(lines)), np.bincount(line, v >> 1 & 1, len(lines))
    up[np.array([s.isupper() for s in lines], bool)] = 0
    chars = np.array([len(s) for s in lines], np.int64)
    marked = np.array([_MARK.match(s) is not None for s in lines], bool)
    sentence = ~marked & (f >= 0.17 * n) & (f >= 1) & (n > 2) & (up <= 0.45 * n)
    ended = np.array([s.endswith(_ENDS) for s in lines], bool)
    of = lambda values: np.bincount(text, values, len(bodies))
    code = np.sort(text[line] << 32 | v >> 2)
    different = np.bincount(code[np.concatenate([[True], code[1:] != code[:-1]])] >> 32, minlength=len(bodies)) if len(code) else np.zeros(len(bodies))
    words, total, count = of(n), of(chars), of(np.ones(len(lines)))
    sums = np.stack([of(f), of(chars * sentence), of(ended), of(chars * marked), of(up), different], axis=1)
    out: list[np.ndarray | None] = []
    for k, body in enumerate(bodies):
        if not body:
            out.append(None)
            continue
        raw = "\n".join(body).encode()
        rest = raw.translate(None, _LETTERS_BLANKS)
        marks = rest.translate(None, _DIGITS)
        odd = len(marks.translate(None, _PLAIN))
        if not raw.isascii():  # letters beyond ASCII are no symbols
            odd -= sum(len(x.encode()) for x in _BEYOND("".join(body)))
        w, c, m = words[k], total[k], count[k]
        fw, in_sentences, ends, in_marked, caps, kinds = sums[k]
        out.append(np.array([fw / w, in_sentences / c, min(12.0, (c - w) / w), max(0, odd) / c, (len(rest) - len(marks)) / c, ends / m, in_marked / c, caps / w, np.log1p(w / m), np.log(kinds / np.sqrt(w))]))
    return out


#: Figures of inspected documents, in the order of ``FIGURES``, and what they are: measures, records and logs are tables; bullets,
#: references, contents, contacts and headlines lists; keyword strings, word salad, code, noise and dumps junk.
EXAMPLES = (
    ("table", (0.02, 0, 12, 0.01, 0.31, 0, 0, 0.06, 0.72, 2.25)),
    ("table", (0.04, 0.18, 6.32, 0, 0.24, 0, 0, 0.24, 1.78, 2.44)),
    ("table", (0, 0, 5.64, 0, 0.57, 0, 0.98, 0.01, 4.55, 2.5)),
    ("table", (0.03, 0.05, 6.85, 0.05, 0.32, 0, 0, 0.04, 2.09, 2.5)),
    ("list", (0.17, 0.18, 4.88, 0, 0.07, 0, 0.78, 0.13, 1.7, 2.32)),
    ("list", (0.36, 0, 4.17, 0, 0, 0, 0.95, 0.11, 1.54, 1.55)),
    ("list", (0.12, 0, 6.19, 0.05, 0.13, 0.95, 0.98, 0.64, 2.74, 2.7)),
    ("list", (0.21, 0, 7.65, 0, 0.06, 0, 0.99, 0.41, 2.19, 2.34)),
    ("list", (0, 0, 4.85, 0.07, 0.07, 0, 0, 0.3, 2.06, 2.21)),
    ("list", (0.33, 0.3, 6.54, 0, 0, 0, 0, 0.62, 1.78, 1.7)),
    ("list", (0.09, 0, 4.7, 0, 0, 0, 0.88, 0.16, 3.66, 1.62)),
    ("junk", (0.01, 0, 3.71, 0, 0, 0, 0, 0.02, 2.67, -0.4)),
    ("junk", (0, 0, 7.24, 0, 0, 0.31, 0, 0.01, 2.84, 2)),
    ("junk", (0.01, 0, 6.97, 0, 0, 0.97, 0, 0.12, 2.29, 1.94)),
    ("junk", (0.05, 0.12, 4.93, 0.06, 0.17, 0.27, 0.06, 0.03, 1.58, 2.21)),
    ("junk", (0.01, 0, 4.08, 0.21, 0.04, 0.08, 0, 0.02, 2.37, 2.91)),
    ("junk", (0.06, 0, 12, 0, 0.58, 0, 0, 0.19, 0.83, 1.79)),
    ("junk", (0.2, 0.98, 6.29, 0, 0, 0.98, 0, 0.21, 1.79, 1.63)),
    ("junk", (0.2, 0.94, 6.29, 0, 0, 0.33, 0, 0.24, 4.08, 1.74)),
    ("prose", (0.45, 0.96, 4.13, 0, 0, 0.88, 0, 0.15, 2.98, 2.1)),
    ("prose", (0.46, 0.97, 5.81, 0, 0, 0.7, 0, 0.08, 3.52, 2.18)),
    ("prose", (0.36, 0.93, 7.34, 0.01, 0, 0.5, 0, 0.1, 3.54, 2.08)),
    ("prose", (0.4, 1, 4.7, 0, 0, 0.93, 0, 0.08, 3.43, 1.28)),
    ("prose", (0.43, 0.97, 5.09, 0, 0, 0.86, 0, 0.42, 3.46, 1.55)),
    ("prose", (0.48, 0.96, 4.55, 0, 0, 0.33, 0, 0.08, 2.63, 2.26)),
    ("prose", (0.44, 0.95, 5.62, 0.05, 0, 0.05, 0, 0.08, 2.28, 2.12)),
    ("prose", (0.58, 1, 4.05, 0, 0, 1, 0, 0.05, 3, 1.42)),
    ("prose", (0.42, 0.71, 5.37, 0, 0, 0.35, 0, 0.41, 2.4, 1.35)),
    ("prose", (0.32, 0.6, 7.53, 0, 0, 0.06, 0, 0.1, 2.02, 2.11)),
)
#: Rounds of expectation-maximization; least variance of a standardized figure in a component.
ROUNDS, LEAST_VARIANCE = 10, 0.02
#: Least scale of a figure, as a share of its deviation among the examples.
LEAST_SCALE = 0.3
MEDIA = ("web", "pdf", "txt")


class Mixture:
    """A Gaussian mixture with a variance for each figure, over standardized figures."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray):
        self.shift, self.scale = shift, scale
        self.examples = self.standard(np.array([x[1] for x in EXAMPLES]))
        k, d = self.examples.shape
        self.weights, self.means, self.variances = np.full(k, 1 / k), self.examples.copy(), np.full((k, d), 0.3)
        self.classes = np.array([x[0] for x in EXAMPLES])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) / self.scale

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Posterior share of each component in standardized rows."""
        inverse = 1 / self.variances
        logs = np.log(self.weights) - 0.5 * (np.log(self.variances).sum(axis=1) + (x * x) @ inverse.T - 2 * x @ (self.means * inverse).T + (self.means**2 * inverse).sum(axis=1))
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The expectation's sums over rows: each component's share, and its shares of the figures and of their squares."""
        p = self.shares(x)
        return np.hstack([p.sum(axis=0)[:, None], p.T @ x, p.T @ (x * x)])

    def maximize(self, sums: np.ndarray) -> None:
        d, n = self.means.shape[1], sums[:, 0]
        alive = n > 1e-3 * max(1.0, n.sum() / 1000)
        self.weights = np.maximum(n, 1e-9) / max(1e-9, n.sum())
        means = sums[:, 1 : d + 1] / np.maximum(n, 1e-9)[:, None]
        squares = sums[:, d + 1 :] / np.maximum(n, 1e-9)[:, None]
        self.means[alive] = means[alive]
        self.variances[alive] = np.maximum(LEAST_VARIANCE, squares - means**2)[alive]

    def name_components(self) -> None:
        """Each component is what the examples are that it holds; without any, what the nearest example is."""
        p, kinds = self.shares(self.examples), np.array([x[0] for x in EXAMPLES])
        names = sorted(set(kinds))
        votes = np.stack([p[kinds == k].sum(axis=0) for k in names], axis=1)
        near = ((self.means[:, None, :] - self.examples[None]) ** 2).sum(axis=2).argmin(axis=1)
        self.classes = np.where(votes.sum(axis=1) > 0.2, np.array(names)[votes.argmax(axis=1)], kinds[near])

    def kinds(self, x: np.ndarray) -> np.ndarray:
        """The most likely kind of each row of figures."""
        p, names = self.shares(self.standard(x)), sorted(set(self.classes))
        return np.array(names)[np.stack([p[:, self.classes == k].sum(axis=1) for k in names], axis=1).argmax(axis=1)]


def fit(measured: DataFrame, rounds: int = ROUNDS) -> Mixture:
    """Expectation-maximization over the column ``figures`` of all rows; a task hands on one small matrix of sums in each round."""
    rows = measured.where("figures is not null").select("figures")
    d = len(FIGURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, 2 * d + 1))
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        yield _as_rows(total)

    n, *sums = _gather(rows, moments, 1, d)[0]
    if not n:
        return Mixture(np.zeros(d), np.ones(d))
    shift = np.array(sums[:d]) / n
    # a corpus that is all alike must not be stretched until its documents look unlike
    least = LEAST_SCALE * np.std([x[1] for x in EXAMPLES], axis=0)
    m = Mixture(shift, np.maximum(least, np.sqrt(np.maximum(0, np.array(sums[d:]) / n - shift**2))))
    for _ in range(rounds):

        def expectation(batches: Iterator[pa.RecordBatch], m: Mixture = m) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(m.weights), 2 * d + 1))
            for b in batches:
                total += m.sums(m.standard(b.column(0).flatten().to_numpy().reshape(-1, d)))
            yield _as_rows(total)

        m.maximize(_gather(rows, expectation, len(m.weights), d))
    m.name_components()
    return m


def _as_rows(total: np.ndarray) -> pa.RecordBatch:
    i, j = map(np.ravel, np.indices(total.shape))
    return pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "x": total.ravel()})


def _gather(rows: DataFrame, f, k: int, d: int) -> np.ndarray:
    total = np.zeros((k, 2 * d + 1))
    for r in rows.mapInArrow(f, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # k * (2 d + 1) rows
        total[r[0], r[1]] = r[2]
    return total


def measure(documents: DataFrame, extra=None, ready: pages.Removal | None = None, keep_source: bool = False) -> DataFrame:
    """``(doc_id, figures)`` of every document with a text, and with ``extra`` a column of what it makes of a list of main bodies."""
    ready = ready or pages.removal(documents, MEDIA)
    lookup = ready.lookup()
    shared = documents.sparkSession.sparkContext.broadcast(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bodies = []
                for media, text, site, known, heads in zip(*[c.to_pylist() for c in part.columns[2:]]):
                    lines = text.split("\n")
                    bodies.append(body_lines(lines, lookup(site, known, heads).removed(lines, pages.line_keys(text), media == "web")))
                columns = [part.column(0), pa.array(figures(bodies), pa.list_(pa.float64()))]
                if more:
                    columns.append(pa.array(more(bodies), pa.list_(pa.float64())))
                if keep_source:
                    columns.append(part.column(1))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "figures"] + ["extra"] * bool(extra) + ["source"] * keep_source
    kinds = {"doc_id": "bigint", "figures": "array<double>", "extra": "array<double>", "source": "string"}
    source = ready.documents.select("doc_id", F.coalesce(clean_source(F.col("source")), F.lit("")).alias("source"), "media", "text", "site", "known", "heads")
    return source.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def judged(measured: DataFrame, mixture: Mixture) -> DataFrame:
    """``measured`` with the column ``kind``, null without figures."""
    names = measured.columns
    kinds_of = measured.sparkSession.sparkContext.broadcast(mixture)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(names.index("figures"))
            there = column.is_valid().to_numpy(zero_copy_only=False)
            kinds = np.full(len(there), None, object)
            if there.any():
                kinds[there] = kinds_of.value.kinds(column.flatten().to_numpy().reshape(-1, len(FIGURES)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string())], [*names, "kind"])

    return measured.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema) + ", kind string")


def quality(documents: DataFrame) -> DataFrame:
    """``(doc_id, <figures>, kind)`` of every document; kind is prose, list, table or junk."""
    measured = cut(measure(documents))
    found = judged(measured, fit(measured)).select("doc_id", *[F.col("figures")[n].alias(name) for n, name in enumerate(FIGURES)], "kind")
    return documents.select(F.col("doc_id").cast("bigint")).where("text is null").select("doc_id", *[F.lit(None).cast("double").alias(x) for x in FIGURES], F.lit(None).cast("string").alias("kind")).unionByName(found)


def not_prose(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of the non-blank documents that are list, table or junk."""
    measured = cut(measure(documents))
    return judged(measured, fit(measured)).where("kind <> 'prose'").select("doc_id")
