"""Subjects and levels: held-out accuracy, decoding and trees against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from quirelight.llm import evidence, levels, pages, subjects
from quirelight.llm.evidence import Evidence, Lexicon, Tokens

TERMS = {"bio": "cell leaf root seed animal flower bird".split(), "law": "court judge crime witness statute trial".split(), "food": "bread soup oven sauce cake spoon".split()}
PLAIN = "day time place house road friend".split()
KIND = "doc_id bigint, text string, source string, media string, url string"


def subject_sentence(rng, subject):
    w = TERMS[subject] if subject else PLAIN
    return f"The {rng.choice(w)} of the {rng.choice(w)} is not that which {rng.choice(PLAIN)} and {rng.choice(w)} have to be."


def test_tokens():
    lexicon = evidence.fresh_lexicon()
    doc = Tokens(["the cat sat, on it. why not? (12 34) well-known \"end.\"", "", "12 34. !", "no end", "next"], lexicon)
    assert doc.sizes.tolist() == [5, 2, 2, 2, 1] and doc.owner.tolist() == [0, 0, 0, 3, 4]
    assert doc.asked.tolist() == [1, 0, 1, 0, 0] and doc.commas.tolist() == [1, 0, 0, 0, 0] and doc.chars.tolist()[7] == 10
    assert doc.words.tolist() == [9, 0, 0, 2, 1] and doc.sentences.tolist() == [3, 0, 0, 1, 1]
    assert Tokens([], lexicon).sizes.tolist() == []
    assert evidence.running_text(["A Title Here", "Wrapped at the hyphen-", "ated end.", "Next one is longer."]) == "wrapped at the hyphenated end. next one is longer."
    assert evidence.running_text(["ALL OF THE LINES", "ARE IN CAPITALS."]) == "all of the lines are in capitals."


def test_small_memo(monkeypatch):
    monkeypatch.setattr(evidence, "MEMO", 2)
    lexicon = Lexicon({"cat": 1})
    assert Tokens(["cat dog cat bird cat"], lexicon).places.tolist() == [1, 0, 1, 0, 1]


def test_cohesion():
    lexicon = evidence.fresh_lexicon()
    texts = ["the green river runs. the green stone lies. nothing here.", "one single sentence.", "same words. same words."]
    got = levels.cohesion(Tokens(texts, lexicon))
    assert np.allclose(got, [(1 / 3 + 0) / 2, 0, 1.0])


def test_chain_decoding():
    """The beam finds the likeliest of all combinations."""
    rng = np.random.default_rng(0)
    n, names = 300, 4
    y = rng.random((n, names)) < 0.3
    y[y.sum(axis=1) > 2] = False
    x = np.concatenate([np.clip(y * 0.4 + rng.normal(size=(n, names)) * 0.1, 0, 1), y + rng.normal(size=(n, names)) * 0.4, np.ones((n, 1))], axis=1)
    sources = [f"s{k % 5}" for k in range(n)]
    chain = subjects.Chain(x, y.astype(float), sources)
    got = chain.decode(x, sources, beam=16)
    assert (got == y).mean() > 0.95
    prior = chain.priors(sources)
    for row in range(40):
        best = (-np.inf, None)
        for code in range(2**names):
            labels = np.array([code >> k & 1 for k in range(names)], float)
            if labels.sum() > subjects.MOST:
                continue
            total = 0.0
            for k, j in enumerate(chain.order):
                z = np.concatenate([chain.inputs(x, prior, j)[row], labels[chain.order[:k]]]) @ chain.parts[k]
                total -= np.logaddexp(0, -z if labels[j] else z)
            best = max(best, (total, tuple(labels.astype(bool))))
        assert tuple(got[row]) == best[1]


def test_subjects(spark):
    rng = random.Random(0)
    rows, truth = [], {}
    for i in range(240):
        own = rng.choice([["bio"], ["law"], ["food"], ["bio", "law"], []])
        parts = [subject_sentence(rng, s) for s in own for _ in range(6 // len(own))] + [subject_sentence(rng, None) for _ in range(3)]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts), f"s{i % 6}", "txt", None))
        truth[i] = set(own)
    rows += [(900, None, "s0", "txt", None), (901, "", "s0", "txt", None), (902, "Too short is the cell.", "s0", "txt", None), (903, "Das ist der Baum und die Zelle mit dem Blatt auf dem Weg nach der Stadt. " * 8, "s1", "txt", None), (904, "cell;12;99.5;yes\n" * 40, "s1", "txt", None)]
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' as subject", "1 as extra")
    labels = spark.createDataFrame([(i, s) for i in range(150) for s in truth[i]] * 2 + [(None, "bio"), (3, None), (77777, "law"), (5, "unknown")], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(s, "g") for s in TERMS], "subject string, gloss string")
    found = [tuple(r) for r in subjects.subjects(docs, labels, areas).collect()]
    assert len(found) == len(set(found))
    held_out = {(i, s) for i in range(150, 240) for s in truth[i]}
    got = {x for x in found if 150 <= x[0] < 240}
    assert len(got & held_out) / len(got | held_out) > 0.95
    assert not {x for x in found if x[0] >= 900}
    assert subjects.subjects(docs, labels.limit(0), areas).count() == 0
    assert subjects.subjects(docs.limit(0), labels, areas).count() == 0


def test_trees():
    """Boosting fits a step function, and a tree's split is the best of all."""
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = 1.0 + (x[:, 0] > 0.5) + 2 * (x[:, 1] > 0.7) * (x[:, 0] > 0.5)
    model = levels.Boosted(x[:600], y[:600], 60)
    assert np.abs(model.predict(x[600:], 60) - y[600:]).mean() < 0.1
    assert np.allclose(model.staged(x)[-1], model.predict(x, 60))
    b = rng.integers(0, 6, (60, 2))
    r = rng.normal(size=60)
    feature, limit, _ = levels.Boosted._tree(b, r)

    def gain(f, t):
        left = b[:, f] <= t
        n, m = left.sum(), (~left).sum()
        return r[left].sum() ** 2 / n + r[~left].sum() ** 2 / m if min(n, m) >= levels.LEAST_LEAF else -1

    assert max((gain(f, t), f, t) for f in range(2) for t in range(6))[1:] == (feature[0], limit[0])


def test_cut_points_and_folds():
    y = np.array([1, 1, 2, 2, 3, 3, 4, 4.0])
    assert np.allclose(levels.cut_points(y + 0.1, y), [1.6, 2.6, 3.6], atol=0.1)
    f = evidence.folds(["a"] * 5 + ["b"] * 3 + ["c"] * 3, 2)
    assert len(set(f[:5])) == 1 and len(set(f[5:8])) == 1 and f[0] != f[5]


def level_text(rng, grade):
    short = [f"We see the {rng.choice(PLAIN)} and it is big.", f"The {rng.choice(PLAIN)} is for you.", f"It is a {rng.choice(PLAIN)}!"]
    middle = [f"People often compare the {rng.choice(PLAIN)} with the {rng.choice(PLAIN)}, because each of these is used for the same things."]
    high = [f"Researchers generally regard the representation of the {rng.choice(PLAIN)} as a significant consequence, since its interpretation is considerably measured in most circumstances."]
    top = [f"Notwithstanding the characteristic operationalisation of the {rng.choice(PLAIN)}, the terminology through which representation is systematically circumscribed necessitates a disproportionate classification whose phenomenology and interpretability are by this not delineated."]
    pool = [short, middle, high, top][grade - 1]
    return " ".join(rng.choice(pool) for _ in range([16, 8, 6, 4][grade - 1]))


def test_levels(spark):
    rng = random.Random(0)
    truth = {i: rng.choice([1, 2, 3, 4]) for i in range(240)}
    rows = [(i, level_text(rng, g), f"s{i % 6}", "txt", None) for i, g in truth.items()] + [(900, None, "s0", "txt", None), (901, "", "s0", "txt", None), (902, "It is short.", "s0", "txt", None)]
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "7 as grade")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(150)] * 2 + [(None, 1), (3, None), (77777, 2), (5, 9)], "doc_id bigint, grade int")
    found = {r.doc_id: r.grade for r in levels.levels(docs, labels).collect()}
    assert np.mean([found.get(i) == truth[i] for i in range(150, 240)]) > 0.95 and not set(found) & {900, 901, 902}
    assert levels.levels(docs, labels.limit(0)).count() == 0


def test_bounded_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s", "txt", None) for i in range(20)], KIND)
    labels = spark.createDataFrame([(i, "x") for i in range(20)], "doc_id bigint, subject string")
    ready = pages.removal(docs)
    one, two = (evidence.labelled(ready, labels.orderBy(F.rand(k)), "subject", 5) for k in (1, 2))
    assert len(one) == 5 and one == two


def test_evidence():
    lexicon = evidence.fresh_lexicon()
    texts = ["the cell has a leaf. a leaf and a root.", "the court has a judge. a judge and a crime."]
    docs = Tokens(texts * 3, lexicon)
    words = evidence.word_counts(docs)
    e = Evidence(words, np.array([[1.0, 0], [0, 1.0]] * 3), lexicon.vocabulary)
    got = e.shares(docs, e.row[docs.places])
    assert got[0, 0] > got[0, 1] and got[0, 2] > got[0, 3] and got[1, 0] < got[1, 1]
    small = e.compact(lexicon.vocabulary)
    again = Tokens(texts + [""], Lexicon(small))
    assert np.allclose(e.shares(again, e.row[again.places]), [*got[:2], [0.0] * 4])
    assert set(evidence.within(words, np.array([True] + [False] * 5))[0]) == {0}
