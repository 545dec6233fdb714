"""Problem 4: subject areas of each document.

Method: classifier chains over term, source and structure features. Each subject has a logistic regression that also
sees the decisions on the subjects before it in the chain, so that subjects that occur together support each other; the
label combination is decoded by beam search over the chain. The terms' features are made out of fold for the training
documents, which keeps the probabilities calibrated.

Defined results: blank texts, other languages, documents that are no prose or have too few words give no row; labels
that are null, repeated, of unknown documents or unknown subjects are ignored; without any label there are no rows.
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

FOLDS, BEAM, RIDGE = 4, 8, 1.0
#: Subjects of a document at most, as the problem is stated.
MOST = 2


class Features:
    """Term and structure features of main bodies; called on the executors."""

    def __init__(self, terms: Evidence, lexicon: Lexicon):
        self.terms, self.lexicon = terms, lexicon

    def __call__(self, bodies: list[list[str]]) -> list[np.ndarray | None]:
        tokens = Tokens([evidence.running_text(b) for b in bodies], self.lexicon)
        rows = self.terms.row[tokens.places]
        return [x if own else None for x, own in zip(features(self.terms, tokens, rows), self.terms.english(tokens, rows))]


def features(terms: Evidence, tokens: Tokens, rows: np.ndarray) -> np.ndarray:
    return np.hstack([terms.shares(tokens, rows), np.log1p(tokens.sentences)[:, None]])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients by Newton's method; the first column of x is 1 and isn't held back by the ridge."""
    b = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


class Chain:
    """Logistic regressions along the subjects, the frequent first."""

    def __init__(self, x: np.ndarray, y: np.ndarray, sources: list[str]):
        n = y.shape[1]
        self.n = n
        self.order = np.argsort(-y.sum(axis=0), kind="stable")
        self.rates = {s: (y[[t == s for t in sources]].sum(axis=0) + 20 * y.mean(axis=0)) / (sum(t == s for t in sources) + 20) for s in set(sources)}
        self.rate = y.mean(axis=0)
        prior = self.priors(sources)
        self.parts = []
        for k, j in enumerate(self.order):
            self.parts.append(logistic(np.hstack([self.inputs(x, prior, j), y[:, self.order[:k]]]), y[:, j]))

    def priors(self, sources: list[str]) -> np.ndarray:
        p = np.clip(np.array([self.rates.get(s, self.rate) for s in sources]).reshape(-1, self.n), 1e-3, 1 - 1e-3)
        return np.log(p / (1 - p))

    def inputs(self, x: np.ndarray, prior: np.ndarray, j: int) -> np.ndarray:
        n = self.n
        rest = np.delete(x[:, :n], j, axis=1)
        return np.stack([np.ones(len(x)), 4 * x[:, j], 4 * (x[:, j] > 0.15), 4 * rest.max(axis=1, initial=0), x[:, n + j], x[:, 2 * n], prior[:, j]], axis=1)

    def decode(self, x: np.ndarray, sources: list[str], beam: int = BEAM) -> np.ndarray:
        """The likeliest combination of each row, found by beam search."""
        prior = self.priors(sources)
        labels, logs = np.zeros((len(x), 1, self.n)), np.zeros((len(x), 1))
        for k, j in enumerate(self.order):
            own = self.inputs(x, prior, j)
            b = self.parts[k]
            z = (own @ b[: own.shape[1]])[:, None] + labels[:, :, self.order[:k]] @ b[own.shape[1] :]
            yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
            logs = np.concatenate([logs + no, logs + yes], axis=1)
            more = labels.copy()
            more[:, :, j] = 1
            logs[:, logs.shape[1] // 2 :][more.sum(axis=2) > MOST] = -np.inf
            labels = np.concatenate([labels, more], axis=1)
            if logs.shape[1] > beam:
                top = np.argpartition(-logs, beam - 1, axis=1)[:, :beam]
                logs, labels = np.take_along_axis(logs, top, axis=1), np.take_along_axis(labels, top[:, :, None], axis=1)
        return labels[np.arange(len(x)), logs.argmax(axis=1)] > 0.5


def train(rows: list[tuple[str, str, list]], names: list[str]) -> tuple[Features, Chain] | None:
    """The term features and the chain, from running texts with their labels."""
    lexicon = evidence.fresh_lexicon()
    docs = [(source, body, [names.index(s) for s in found if s in names]) for source, body, found in rows]
    docs = [d for d in docs if d[2]]
    tokens = Tokens([d[1] for d in docs], lexicon)
    vocabulary = lexicon.vocabulary
    known = Evidence(evidence.no_words(), np.zeros((0, 1)), vocabulary)
    there = known.english(tokens, known.row[tokens.places])
    if there.sum() < FOLDS:
        return None
    y = np.zeros((len(docs), len(names)))
    for n, d in enumerate(docs):
        y[n, d[2]] = 1
    weights, words = y / y.sum(axis=1, keepdims=True) * there[:, None], evidence.word_counts(tokens)
    fold = np.arange(len(docs)) % FOLDS
    x = np.zeros((len(docs), 2 * len(names) + 1))
    for f in range(FOLDS):
        part = Evidence(evidence.within(words, fold != f), weights * (fold != f)[:, None], vocabulary)
        x[fold == f] = features(part, tokens, part.row[tokens.places])[fold == f]
    terms = Evidence(words, weights, vocabulary)
    sources = [d[0] for d, own in zip(docs, there) if own]
    return Features(terms, Lexicon(terms.compact(vocabulary))), Chain(x[there], y[there], sources)


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = evidence.LABELLED) -> DataFrame:
    """``(doc_id, subject)`` of the English prose documents."""
    names = sorted({r[0] for r in areas.where("subject is not null").select("subject").distinct().collect()})  # the areas are a fixed, short list
    ready = pages.removal(documents, quality.MEDIA)
    model = train(evidence.labelled(ready, labels, "subject", most), names)
    if model is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string")
    features, chain = model
    measured = cut(quality.measure(documents, features, ready, keep_source=True))
    found = quality.judged(measured, quality.fit(measured)).where("kind = 'prose' and extra is not null").select("doc_id", "source", "extra")
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                row, col = np.nonzero(shared.value.decode(x, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array([names[c] for c in col], pa.string())], ["doc_id", "subject"])

    return found.mapInArrow(run, "doc_id bigint, subject string").where(F.col("doc_id").isNotNull())
