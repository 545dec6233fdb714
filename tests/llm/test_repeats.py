"""Repeated lines against counting everything, and the heavy-hitter bound."""

import collections
import random
import re

import numpy as np
import pytest

from quirelight.llm import repeats
from quirelight.llm.repeats import HeavyHitters

KIND = "doc_id bigint, source string, text string"


def brute(rows, least_docs=4, share=0.2):
    names = "|".join(sorted({x for n in repeats.MONTHS + repeats.WEEKDAYS for x in (n, n[:3])}, key=len, reverse=True))
    calendar = re.compile(rf"\b(?:{names})\b")
    docs, counts, lines = collections.Counter(), collections.Counter(), {}
    for i, source, text in rows:
        if source is None or text is None or not text.strip():
            continue
        s = source.strip().lower()
        docs[s] += 1
        keys = ["".join(c for c in calendar.sub("", x.lower()) if c.isalpha()) for x in text.split("\n")]
        lines[i] = (s, keys)
        counts.update((s, k) for k in set(keys) if k)
    return {(i, n) for i, (s, keys) in lines.items() for n, k in enumerate(keys) if k and counts[s, k] >= max(least_docs, share * docs[s])}


def test_bound():
    rng = np.random.default_rng(0)
    for k in (5, 20, 100):
        items = rng.zipf(1.3, 20_000) % 3000
        parts = [HeavyHitters(k) for _ in range(4)]
        for n, p in enumerate(parts):
            for chunk in np.array_split(items[n::4].astype(np.int64), 5):
                p.add(chunk)
        merged = HeavyHitters(k)
        for p in parts:
            merged.add(p.items, p.counts)
        true = np.bincount(items)
        kept = dict(zip(merged.items.tolist(), merged.counts.tolist()))
        assert len(kept) <= k
        for item, n in enumerate(true):
            assert n - len(items) / (k + 1) <= kept.get(item, 0) <= n


def test_against_counting(spark):
    rng = random.Random(0)
    common = ["All rights reserved {n}", "Posted on {n} March 2020", "SHARE  this: {n}", "Read more", "12 34", "", "  "]
    rows = []
    for i in range(400):
        source = rng.choice(["a.com", " A.com ", "b.org", "b.org", "c.net", None, "tiny"]) if i % 3 else "a.com"
        lines = [rng.choice(common).format(n=rng.randrange(100)) for _ in range(rng.randrange(4))] + [f"unique {rng.choice('abcdefghij')}{'x' * rng.randrange(30)}" for _ in range(rng.randrange(6))]
        rng.shuffle(lines)
        rows.append((i, source, rng.choice(["\n", "\r\n"]).join(lines) if i % 17 else rng.choice([None, "", " \n "])))
    found = repeats.repeated_lines(spark.createDataFrame(rows, KIND))
    assert found.columns == ["doc_id", "line_no"] and dict(found.dtypes)["line_no"] == "int"
    assert {tuple(r) for r in found.collect()} == brute(rows) and found.count() == found.distinct().count()


def test_hot_source(spark):
    rows = [(i, "hot", f"Same line\nown {'abcdefgh'[i % 8]} {chr(97 + i // 8 % 26)}{chr(97 + i // 208)}") for i in range(1000)]
    assert {tuple(r) for r in repeats.repeated_lines(spark.createDataFrame(rows, KIND).repartition(7)).collect()} == brute(rows)


@pytest.mark.parametrize("n, wanted", [(3, 0), (4, 4)])
def test_threshold(spark, n, wanted):
    rows = [(i, "s", "line" if i < n else f"other {chr(97 + i)}") for i in range(8)]
    assert repeats.repeated_lines(spark.createDataFrame(rows, KIND)).count() == wanted


def test_clean(spark):
    rows = [(i, "s", f"Menu 1\nbody {chr(97 + i)}\nmenu") for i in range(5)] + [(9, None, "menu"), (10, "s", None)]
    out = {r.doc_id: r.text for r in repeats.without_repeats(spark.createDataFrame(rows, KIND).selectExpr("*", "1 as line_no", "'k' as key")).collect()}
    assert out == {**{i: f"body {chr(97 + i)}" for i in range(5)}, 9: "menu", 10: None}


def test_odd(spark):
    few = [(i, f"s{i}", "only line") for i in range(9)] + [(20, "numbers", "1 2\n3"), (21, "numbers", "4")]  # summaries without a line
    assert repeats.repeated_lines(spark.createDataFrame(few, KIND)).count() == 0
    assert repeats.repeated_lines(spark.createDataFrame([], KIND)).count() == 0
    long = [(i, "s", "word " * 50_000 + "\nfoot") for i in range(4)]
    assert repeats.repeated_lines(spark.createDataFrame(long, KIND)).count() == 8
