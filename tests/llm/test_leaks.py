"""Leaked test items against comparing every window."""

import random
import time

import numpy as np
import pytest

from quirelight.llm import leaks

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = leaks.words(text)
        for i, item in items:
            v = leaks.words(item)
            n = min(10, len(v))
            spans = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            if any(tuple(v[k : k + n]) in spans for k in range(len(v) - n + 1) if n):
                out.add((d, i))
    return out


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("The CAT's 2nd_try", ["the", "cat", "s", "2nd", "try"]), ("momen-\ntum wave-\r\nlength", ["momentum", "wavelength"]), ("ﬁne ２ x²", ["fine", "2", "x2"]), ("a​b soft­hy", ["ab", "softhy"]),
        ("1-\n2 a -\n b", ["1", "2", "a", "b"]), ("exam­\nple", ["example"]), (None, []), ("", []), (" \n ", []), ("Straße STRASSE", ["strasse", "strasse"]),
    ],
)
def test_words(given, wanted):
    assert leaks.words(given) == wanted


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = rng.integers(1, 9, 10)
        a = np.concatenate([rng.integers(1, 9, rng.integers(0, 30)), shared, rng.integers(1, 9, rng.integers(0, 30))])
        b = np.concatenate([rng.integers(1, 9, rng.integers(0, 30)), shared, rng.integers(1, 9, rng.integers(0, 30))])
        fa, fb = (leaks.grams(x, leaks.K)[leaks.winnow(leaks.grams(x, leaks.K))] for x in (a, b))
        assert set(fa.tolist()) & set(fb.tolist())


def test_against_windows(spark):
    rng = random.Random(0)
    vocabulary = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))) for n in range(40)] + [(50, None), (51, ""), (52, "..."), (53, "one, Two three"), (7, "w1 w2 w3 w4 w5 w6 w7")]
    docs = []
    for d in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.6:
            passage = leaks.words(rng.choice(items)[1])
            start = rng.randrange(len(passage) + 1)
            words[10:10] = passage[start : start + rng.choice([9, 10, 11, 30])]
        docs.append((d, rng.choice([" ", "\n", " - "]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    docs += [(200, None), (201, ""), (202, "x one TWO\nthree y"), (203, "one two"), (204, "w0 " * 100_000)]
    found = [tuple(r) for r in leaks.leaks(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as item_id"), spark.createDataFrame(items, ITEMS).selectExpr("*", "'s' as doc_id")).collect()]
    assert set(found) == brute(docs, items) and len(found) == len(set(found)) and len(found) > 30


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([(1, "a b c")], ITEMS)
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0
    assert leaks.leaks(docs.union(docs), items.union(items)).count() == 1


def brute_spans(docs, items):
    """Longest shared runs on each diagonal."""
    out = set()
    for d, text in docs:
        w = leaks.words(text)
        for i, item in items:
            v = leaks.words(item)
            least = min(10, len(v))
            for shift in range(-len(v), len(w)) if v else ():
                k = 0
                for p in range(max(0, shift), min(len(w), shift + len(v)) + 1):
                    if p < min(len(w), shift + len(v)) and w[p] == v[p - shift]:
                        k += 1
                        continue
                    if k >= least:
                        out.add((d, i, p - k, p - k - shift, k))
                    k = 0
    return out


@pytest.mark.parametrize("bound", [64, 1 << 40])
def test_spans(spark, monkeypatch, bound):
    """Whole spans by a broadcast and by a join, also where a hot span is split."""
    monkeypatch.setattr(leaks, "SPAN_BYTES", bound)
    if bound > 64:
        whole = leaks.spread_join
        monkeypatch.setattr(leaks, "spread_join", lambda *a: whole(*a, 2))
    rng = random.Random(1)
    vocabulary = [f"w{n}" for n in range(30)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 9, 10, 30, 60])))) for n in range(20)] + [(3, "w1 w2 w3"), (60, None), (61, "")]
    opening = " ".join(f"o{n}" for n in range(12))
    items += [(100 + n, f"{opening} {rng.choice(vocabulary)} z{n}") for n in range(20)]
    docs = []
    for d in range(40):
        passage = leaks.words(rng.choice(items)[1]) or ["x"]
        start = rng.randrange(len(passage))
        docs.append((d, " ".join([*(rng.choice(vocabulary) for _ in range(20)), *passage[start : start + 40], *(rng.choice(vocabulary) for _ in range(20)), *passage[:15]])))
    docs += [(90, None), (91, "w1 w2 w3"), (92, opening)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = [tuple(r) for r in leaks.spans(d, i).collect()]
    assert set(found) == brute_spans(docs, items) and len(found) == len(set(found)) and max(f[4] for f in found) > 25
    assert {tuple(r) for r in leaks.leaks(d, i).collect()} == brute(docs, items)


def test_common_opening():
    """Items that begin alike cost next to nothing where the texts differ soon after."""
    opening = leaks.word_hashes(["once upon a time there was"])[0][:-1]
    rng = np.random.default_rng(0)
    every = [np.concatenate([opening, rng.integers(1, 2**63, 8, dtype=np.uint64)]) for _ in range(20_000)]
    marks, spans = (np.concatenate(x) for x in zip(*[(leaks.grams(e, 5)[leaks.winnow(leaks.grams(e, 5))], leaks.grams(e, 10)) for e in every]))
    index = leaks.Index(leaks.Sorted(marks), leaks.Sorted(spans), leaks.Sorted(marks[:0]), [])
    text = "once upon a time there was a " + " ".join(f"x{n}" for n in range(150))
    began = time.perf_counter()
    assert not len(index.scan([text] * 100)[0])
    assert (time.perf_counter() - began) / 100 < 0.1
