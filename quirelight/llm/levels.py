"""Problem 8: reading level of each document.

Method: gradient-boosted regression trees over length, vocabulary, syntax and cohesion distributions of the main body.
The number of trees, and the cut points that turn the regression into grades, come from cross-validation in which all
documents of a source are in one fold.

Defined results: as for the subjects; of a document with several grades the mean counts; grades outside 1 to 4 are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.common import cut
from quirelight.llm import evidence, pages, quality
from quirelight.llm.evidence import Evidence, Lexicon, Tokens

GRADES = (1, 2, 3, 4)
TREES, DEPTH, RATE, BINS, LEAST_LEAF, FOLDS = 120, 3, 0.1, 32, 8, 4
_EDGES = np.array([4.5, 7.5, 10.5, 14.5, 19.5, 26.5, 35.5])
_CHARS = np.array([3.5, 5.5, 7.5, 9.5, 12.5])
_CHAR_BIN = np.searchsorted(_CHARS, np.arange(64))


def _spread(values: np.ndarray, owner: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each text's values."""
    mean = np.bincount(owner, values, len(of)) / of
    square = np.bincount(owner, values.astype(float) ** 2, len(of)) / of
    return np.stack([mean, np.sqrt(np.maximum(0, square - mean**2))], axis=1)


def _shares(bins: np.ndarray, owner: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(owner * k + bins, minlength=len(of) * k).reshape(-1, k) / of[:, None]


def cohesion(t: Tokens) -> np.ndarray:
    """Of each text the mean share of a sentence's words of more than three letters that it has in common with the one before.

    Words are sorted by text, word and sentence: a word that stands in neighbouring sentences then stands side by side.
    """
    long = t.chars > 3
    code = (t.text[long] << 44) | (t.hashes[long] << 20) | np.minimum(t.sentence[long] - np.searchsorted(t.owner, t.text[long]), (1 << 20) - 1)
    code = evidence.distinct(code)
    text, at = code >> 44, code & ((1 << 20) - 1)
    sentence = np.searchsorted(t.owner, text) + at
    again = (code[1:] == code[:-1] + 1) & (at[1:] > 0)
    size = np.bincount(sentence, minlength=len(t.sizes))
    both = np.bincount(sentence[1:][again], minlength=len(t.sizes))
    kept = np.zeros(len(t.sizes))
    kept[1:] = both[1:] / np.maximum(1, np.minimum(size[1:], size[:-1]))
    return np.bincount(t.owner, kept, t.n) / np.maximum(1, t.sentences - 1)


def figures(t: Tokens, rows: np.ndarray, terms: Evidence) -> np.ndarray:
    """Vocabulary (shares of sentences by grade, lengths of words), length and syntax of sentences, cohesion between them."""
    words, parts = np.maximum(1, t.words), np.maximum(1, t.sentences)
    different = np.bincount(evidence.distinct((t.text << 24) | t.hashes) >> 24, minlength=t.n)
    single = [t.commas / parts, t.sums(terms.marks[rows, 2]) / words, cohesion(t), different / np.sqrt(words), t.asked / parts]
    return np.hstack(
        [
            terms.shares(t, rows),
            _shares(np.searchsorted(_EDGES, t.sizes), t.owner, parts, len(_EDGES) + 1),
            _shares(_CHAR_BIN[t.chars], t.text, words, len(_CHARS) + 1),
            _spread(t.sizes, t.owner, parts), _spread(t.chars, t.text, words), np.stack(single, axis=1),
        ]
    )


class Features:
    """Level features of main bodies; called on the executors."""

    def __init__(self, terms: Evidence, lexicon: Lexicon):
        self.terms, self.lexicon = terms, lexicon

    def __call__(self, bodies: list[list[str]]) -> list[np.ndarray | None]:
        tokens = Tokens([evidence.running_text(b) for b in bodies], self.lexicon)
        rows = self.terms.row[tokens.places]
        return [x if own else None for x, own in zip(figures(tokens, rows, self.terms), self.terms.english(tokens, rows))]


class Boosted:
    """Regression trees on the residuals, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        self.start = float(y.mean())
        at = np.full(len(y), self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(trees):
            tree = self._tree(b, y - at)
            self.trees.append(tree)
            at += RATE * self._leaf(tree, b)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T)], axis=1)

    @staticmethod
    def _tree(b: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and bin of each inner node (children of k at 2k + 1 and 2k + 2), and the nodes' values."""
        nodes = 2 ** (DEPTH + 1) - 1
        feature, limit, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        rows = {0: np.arange(len(r))}
        for k in range(nodes):
            own = rows.pop(k, None)
            if own is None:
                continue
            value[k] = r[own].mean() if len(own) else 0.0
            if k >= 2**DEPTH - 1 or len(own) < 2 * LEAST_LEAF:
                continue
            best = 1e-9
            for f in range(b.shape[1]):
                v = b[own, f]
                n, s = np.bincount(v, minlength=BINS).cumsum(), np.bincount(v, r[own], BINS).cumsum()
                m = n[-1] - n
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((n >= LEAST_LEAF) & (m >= LEAST_LEAF), s**2 / n + (s[-1] - s) ** 2 / m - s[-1] ** 2 / n[-1], -1.0)
                if gain.max() > best:
                    best, feature[k], limit[k] = gain.max(), f, int(gain.argmax())
            if feature[k] >= 0:
                left = b[own, feature[k]] <= limit[k]
                rows[2 * k + 1], rows[2 * k + 2] = own[left], own[~left]
        return feature, limit, value

    @staticmethod
    def _leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, limit, value = tree
        at = np.zeros(len(b), int)
        for _ in range(DEPTH):
            f = feature[at]
            inner = f >= 0
            at = np.where(inner, 2 * at + 1 + (b[np.arange(len(b)), np.maximum(f, 0)] > limit[at]), at)
        return value[at]

    def staged(self, x: np.ndarray) -> np.ndarray:
        """Predictions after each number of trees."""
        b = self.binned(x)
        return self.start + RATE * np.cumsum([self._leaf(t, b) for t in self.trees], axis=0)

    def predict(self, x: np.ndarray, trees: int) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.start)
        for t in self.trees[:trees]:
            out += RATE * self._leaf(t, b)
        return out


def cut_points(predicted: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between neighbouring grades the point with the fewest errors, those at points nearby counted as well, as single wrong labels would move it."""
    points = []
    window = np.hanning(27)[1:-1]
    for g in GRADES[:-1]:
        below, tries = y <= g, np.linspace(g - 0.05, g + 1.05, 111)
        wrong = np.array([((predicted <= t) != below).sum() for t in tries])
        near = np.convolve(wrong, window / window.sum(), "valid")
        points.append(tries[12:-12][near <= near.min() + 1e-9].mean())
    return np.maximum.accumulate(points)


class Levels:
    """The trees, their number and the cut points; ``accuracy`` is the cross-validated share of right grades."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        out = np.zeros((TREES, len(y)))
        for f in range(FOLDS):
            there = fold == f
            if there.any() and not there.all():
                out[:, there] = Boosted(x[~there], y[~there]).staged(x[there])
        self.trees = int(((out - y) ** 2).mean(axis=1).argmin()) + 1
        self.points = cut_points(out[self.trees - 1], y)
        self.accuracy = float((self.grade(out[self.trees - 1]) == np.round(y)).mean())
        self.model = Boosted(x, y, self.trees)

    def grade(self, predicted: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.points, predicted, "left") + 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.grade(self.model.predict(x, self.trees))


def train(rows: list[tuple[str, str, list]]) -> tuple[Features, Levels] | None:
    """The vocabulary and the trees, from running texts with their grades."""
    lexicon = evidence.fresh_lexicon()
    docs = [(source, body, [g for g in found if g in GRADES]) for source, body, found in rows]
    docs = [d for d in docs if d[2]]
    tokens = Tokens([d[1] for d in docs], lexicon)
    vocabulary = lexicon.vocabulary
    known = Evidence(evidence.no_words(), np.zeros((0, 1)), vocabulary)
    there = known.english(tokens, known.row[tokens.places])
    if there.sum() < 4 * FOLDS:
        return None
    y = np.array([np.mean(d[2]) for d in docs])
    weights = np.eye(len(GRADES))[np.clip(np.round(y).astype(int) - 1, 0, len(GRADES) - 1)] * there[:, None]
    fold, words, x = evidence.folds([d[0] for d in docs], FOLDS), evidence.word_counts(tokens), None
    for f in range(FOLDS):
        part = Evidence(evidence.within(words, fold != f), weights * (fold != f)[:, None], vocabulary)
        own = figures(tokens, part.row[tokens.places], part)
        x = own if x is None else np.where((fold == f)[:, None], own, x)
    terms = Evidence(words, weights, vocabulary)
    return Features(terms, Lexicon(terms.compact(vocabulary))), Levels(x[there], y[there], fold[there])


def levels(documents: DataFrame, labels: DataFrame, most: int = evidence.LABELLED) -> DataFrame:
    """``(doc_id, grade)`` of the English prose documents."""
    ready = pages.removal(documents, quality.MEDIA)
    model = train(evidence.labelled(ready, labels, "grade", most))
    if model is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, grade int")
    features, grader = model
    measured = cut(quality.measure(documents, features, ready))
    found = quality.judged(measured, quality.fit(measured)).where("kind = 'prose' and extra is not null").select("doc_id", "extra")
    shared = documents.sparkSession.sparkContext.broadcast(grader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.predict(x).astype(np.int32))], ["doc_id", "grade"])

    return found.mapInArrow(run, "doc_id bigint, grade int").where(F.col("doc_id").isNotNull())
