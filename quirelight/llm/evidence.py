"""What words say about a class: shared by the subject and the level operators.

Words get the logarithm of how much likelier they are in documents of a class than elsewhere, from a bounded sample of
labelled documents; a sentence goes to the class its words speak for most, or to none; a document has the share of
its sentences that each class got. Words are looked up, so a document costs one pass over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.common import clean_source
from quirelight.llm import pages, quality

#: Labelled documents that models are fitted on at most, those with the smallest hashes of their ids.
LABELLED = 6000
#: Only documents of so many words are judged.
LEAST_WORDS = 40

_HYPHEN = re.compile(r"(?<=[^\W\d_])- (?=[a-zß-ÿ])")
_STOPS = (".", "!", "?", '."')
#: Marks around words; closing marks that may stand behind a sentence's end.
_AROUND, _BEHIND = "\"'“”‘’«»()[]{}<>.,;:!?…*_-–—=+/|\\", "\"'”’»)]"
#: Entries of a worker's memo of tokens; a full memo is emptied, which changes no result.
MEMO = 400_000
#: Words of more than a batch of documents.
MANY = 1 << 18

#: Function words by language that the other languages don't have (fixed values).
ENGLISH = frozenset("the of and to is that it for with by are this be which have not these those whose its how each there you we because although whereas".split())
OTHERS = frozenset(
    "der das und ein eine einen einem ist nicht auf dem den kein keine für mit nach jeden weil obwohl während trotz ohne zeigt "
    "le les une et dans du des qui est sur avec pour mais chaque quand cette ce el los las una unos y porque aunque cuando con sin por cada su un la".split()
)


#: Words that tie clauses (fixed values).
JOINTS = frozenset("because although though whereas while when if until since unless provided insofar inasmuch that which who whose whom but so and or".split())


def running_text(lines: list[str]) -> str:
    """A main body's running text in lower case: headings left out, wrapped lines joined."""
    out: list[str] = []
    fresh, last = True, len(lines) - 1
    for n, s in enumerate(lines):
        end = s.endswith(_STOPS)
        if fresh and not end and len(s) < 70 and s[-1:] != "," and (n == last or lines[n + 1][:1].isupper() and not lines[n + 1].isupper()):
            continue
        out.append(s)
        fresh = end
    text = " ".join(out).lower()
    return _HYPHEN.sub("", text) if "- " in text else text


class Lexicon(dict):
    """Tokens to numbers that say all about them: from the lowest bit on sentence end (1), question or exclamation (1), comma (1),
    word (1), letters (6), hash (24), place in the vocabulary (the rest; 0 for unknown words)."""

    def __init__(self, vocabulary: dict[str, int], grow: bool = False):
        super().__init__()
        self.vocabulary, self.grow = vocabulary, grow

    def __missing__(self, token: str) -> int:
        word = token.strip(_AROUND)
        tail = token.rstrip(_BEHIND)[-1:]
        value = (tail in (".", "!", "?")) | (tail in ("!", "?")) << 1 | (tail == ",") << 2
        if any(map(str.isalpha, word)):
            place = self.vocabulary.setdefault(word, len(self.vocabulary) + 1) if self.grow else self.vocabulary.get(word, 0)
            value |= 8 | min(len(word), 63) << 4 | (xxhash.xxh32_intdigest(word) >> 8) << 10 | place << 34
        if len(self) >= MEMO:
            self.clear()
        self[token] = value
        return value

    def __reduce__(self):
        return Lexicon, (self.vocabulary, self.grow)


class Tokens:
    """Words and sentence ends of several running texts, in one array each."""

    def __init__(self, texts: list[str], lexicon: Lexicon):
        every = [t.split() for t in texts]
        lengths = [len(t) for t in every]
        self.n = n = len(texts)
        v = np.fromiter(map(lexicon.__getitem__, chain.from_iterable(every)), np.int64, sum(lengths))
        text = np.repeat(np.arange(n), lengths)
        ended = np.cumsum(v & 1) - (v & 1)
        self.asked = np.bincount(text, v >> 1 & 1, n)
        self.commas = np.bincount(text, v >> 2 & 1, n)
        is_word = v & 8 > 0
        w, ended, self.text = v[is_word], ended[is_word], text[is_word]
        self.places, self.chars, self.hashes = w >> 34, w >> 4 & 63, w >> 10 & 0xFFFFFF
        self.words = np.bincount(self.text, minlength=n)
        # a sentence begins where a text does or one has ended; sentences without a word fall away
        new = np.ones(len(w), bool)
        new[1:] = (ended[1:] != ended[:-1]) | (self.text[1:] != self.text[:-1])
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(w)))
        self.sentence = np.cumsum(new) - 1
        self.owner = self.text[self.starts]
        self.sentences = np.bincount(self.owner, minlength=n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each text the sum over its words."""
        return np.bincount(self.text, values, self.n)


class Evidence:
    """Log-ratios of words for each of n classes."""

    #: Words count up to so often in a document; need so many counts; a sentence needs this sum for a class.
    MOST, LEAST, NEED = 3, 2.0, 0.7

    def __init__(self, words: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray, vocabulary: dict[str, int]):
        """``words``: document, place in the vocabulary and count of each word of each document; ``weights``: of each document its share in each class."""
        n, size = weights.shape[1], len(vocabulary) + 1
        owner, place, often = words
        often = np.minimum(often, self.MOST)
        counts = np.stack([np.bincount(place, often * weights[owner, j], size) for j in range(n)], axis=1)
        per_class = np.maximum(1e-9, weights.sum(axis=0))
        rate = (counts + 0.3 * per_class / per_class.sum()) / per_class
        p = rate / rate.sum(axis=1, keepdims=True)
        used = (counts.sum(axis=1) >= self.LEAST) & ((p.max(axis=1) > 3 / n) | (n < 6) & (p.max(axis=1) > 1.4 / n))
        used[0] = False
        marks = np.zeros((size, 3))
        for k, group in enumerate((ENGLISH, OTHERS, JOINTS)):
            marks[[vocabulary[w] for w in group if w in vocabulary], k] = 1
        kept = np.flatnonzero(used | (marks.sum(axis=1) > 0))
        self.row = np.zeros(size, np.int64)  # of each place its row; 0 has words that say nothing
        self.row[kept] = np.arange(1, len(kept) + 1)
        self.rows = np.vstack([np.zeros(n), np.where(used[kept, None], np.log(p[kept] * n + 0.05), 0.0)])
        self.marks = np.vstack([np.zeros(3), marks[kept]])
        self.informed = np.concatenate([[False], used[kept]])

    def compact(self, vocabulary: dict[str, int]) -> dict[str, int]:
        """Only the words that have a row, with their rows as places; the evidence is then over these."""
        small = {w: int(self.row[k]) for w, k in vocabulary.items() if self.row[k]}
        self.row = np.arange(len(self.rows))
        return small

    def english(self, tokens: Tokens, rows: np.ndarray) -> np.ndarray:
        """Of each text whether it is English running text of enough words."""
        own, other = (tokens.sums(self.marks[rows, k]) for k in (0, 1))
        return (tokens.words >= LEAST_WORDS) & (own > 2 * other)

    def shares(self, tokens: Tokens, rows: np.ndarray) -> np.ndarray:
        """Of each text and class the share of the sentences, then the words' mean log-ratio."""
        n = self.rows.shape[1]
        if not len(rows):
            return np.zeros((tokens.n, 2 * n))
        # one class at a time, as a row of all classes for each word would fill the driver when models are fitted
        sums = np.stack([np.add.reduceat(self.rows[:, j].take(rows), tokens.starts) for j in range(n)], axis=1) if len(rows) > MANY else np.add.reduceat(self.rows[rows], tokens.starts)
        longer = tokens.sizes > 1
        best = sums.argmax(axis=1)
        sure = longer & (sums.max(axis=1) > self.NEED)
        got = np.bincount(tokens.owner[sure] * n + best[sure], minlength=tokens.n * n).reshape(-1, n)
        of = np.maximum(1, np.bincount(tokens.owner[longer], minlength=tokens.n))
        total = np.stack([np.bincount(tokens.owner, sums[:, j], tokens.n) for j in range(n)], axis=1)
        return np.hstack([got / of[:, None], total / np.maximum(1, tokens.sums(self.informed[rows]))[:, None]])


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def word_counts(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and count of each different known word of each text."""
    every = np.sort(tokens.text << 32 | tokens.places)
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, int)
    return every[first] >> 32, every[first] & 0xFFFFFFFF, np.diff(np.append(first, len(every)))


def no_words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)


def within(words: tuple[np.ndarray, np.ndarray, np.ndarray], there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of some of the documents."""
    keep = there[words[0]]
    return words[0][keep], words[1][keep], words[2][keep]


def fresh_lexicon() -> Lexicon:
    """A lexicon for training, which has the marked words and takes in what comes."""
    return Lexicon({w: n for n, w in enumerate(sorted(ENGLISH | OTHERS | JOINTS), 1)}, grow=True)


def labelled(ready: pages.Removal, labels: DataFrame, value: str, most: int = LABELLED) -> list[tuple[str, str, list]]:
    """``(source, running text of the main body, distinct labels)`` of at most ``most`` labelled documents. The texts are cut on the executors."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set(value)).alias("labels"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    few = ready.documents.join(F.broadcast(own), "doc_id")  # at most ``most`` rows
    few = few.select("doc_id", F.coalesce(clean_source(F.col("source")), F.lit("")).alias("source"), "labels", "media", "text", "site", "known", "heads")
    kinds = {f.name: f.dataType.simpleString() for f in few.schema}
    lookup = ready.lookup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = []
            for media, text, site, known, heads in zip(*[c.to_pylist() for c in b.columns[3:]]):
                lines = text.split("\n")
                gone = lookup(site, known, heads).removed(lines, pages.line_keys(text), media == "web")
                bodies.append(running_text(quality.body_lines(lines, gone)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bodies, pa.string())], ["doc_id", "source", "labels", "body"])

    rows = few.mapInArrow(run, f"doc_id bigint, source string, labels {kinds['labels']}, body string").orderBy("doc_id").toArrow()
    return list(zip(*[rows.column(c).to_pylist() for c in ("source", "body", "labels")]))


def folds(sources: list[str], n: int) -> np.ndarray:
    """A fold for each row; rows of a source are in one fold, and the sources are dealt so that the folds are about equal."""
    sizes, room, of = Counter(sources), [0] * n, {}
    for s, c in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        of[s] = int(np.argmin(room))
        room[of[s]] += c
    return np.array([of[s] for s in sources], int)
