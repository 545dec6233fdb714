"""Page boilerplate and text quality on made-up sites."""

import random

import numpy as np
import pytest

from quirelight.llm import pages, quality

KIND = "doc_id bigint, text string, source string, media string, url string"
WORDS = "river stone garden winter paper window letter bridge morning song market table summer music".split()


def sentence(rng):
    return f"The {rng.choice(WORDS)} of the {rng.choice(WORDS)} is not as {rng.choice(WORDS)} as it was when the {rng.choice(WORDS)} came to {rng.choice(WORDS)}."


@pytest.fixture(scope="module")
def site():
    """Pages of two sites with their template lines, and documents of other media with the same headings."""
    rng, rows, wanted = random.Random(0), [], set()
    name = lambda: "".join(rng.choice("abcdefg") for _ in range(7)).title()
    for i in range(160):
        host = "one.example" if i % 2 else "two.example"
        lines = [
            (f"Site {host.split('.')[0]} - Welcome", True), ("Home | About | Contact" if rng.random() < 0.9 else None, True), (f"Home > Things > {name()} {rng.choice(WORDS)}", True), (f"About {name()}", False),
            (f"By Ann Other - {rng.randrange(1, 28)} March 20{rng.randrange(10, 24)}", True), ("Summary" if rng.random() < 0.5 else None, False), *[(sentence(rng), False) for _ in range(5)],
            (f"Share {rng.randrange(999)} Tweet {rng.randrange(999)}", True), (sentence(rng), False), (f"var x{rng.randrange(99)} = y{rng.randrange(99)}.push(\"{name()}\");", True), ("Related posts", True),
            (f"Difference Between {name()} and {name()}", True), (f"{name()} is the {rng.choice(WORDS)} that ...", True), (f"{name()} says: {sentence(rng)}", True), (f"Copyright 20{rng.randrange(10, 24)} all rights reserved", True), ("", False),
        ]
        lines = [x for x in lines if x[0] is not None]
        wanted |= {(i, n) for n, x in enumerate(lines) if x[1]}
        rows.append((i, "\n".join(x[0] for x in lines), host if i % 40 else None, "web", f"https://{host}/{i}"))
    rows += [(1000 + i, f"Summary\n{sentence(rng)}\n{name()} - {sentence(rng)}", "papers", "pdf", None) for i in range(160)]
    rows += [(5000, None, "one.example", "web", None), (5001, "", "one.example", "web", None), (5002, " \n ", None, "web", None)]
    return rows, wanted


def test_boilerplate(spark, site):
    rows, wanted = site
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as line_no", "2 as key", "'h' as host").repartition(5)
    found = [tuple(r) for r in pages.boilerplate(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    bodies = {r.doc_id: r.text for r in pages.main_bodies(docs).collect()}
    assert len(bodies) == len(rows) and bodies[5000] is None and bodies[1000] == rows[160][1]
    text = rows[1][1].split("\n")
    assert bodies[1] == "\n".join(x for n, x in enumerate(text) if (1, n) not in wanted)


def test_templates_beyond_the_bound(spark, site, monkeypatch):
    """Where the hashes are too many for a broadcast, documents get their own by a join."""
    monkeypatch.setattr(pages, "TEMPLATE_BYTES", 1 << 30)
    rows, wanted = site
    docs = spark.createDataFrame(rows, KIND)
    assert pages.removal(docs).shared is None
    assert {tuple(r) for r in pages.boilerplate(docs).collect()} == wanted


def test_per_host(spark):
    """A line is removed where it recurs on the page's host, not where another host has it; copied texts lose what is around them on their own host."""
    rng, rows, wanted = random.Random(5), [], set()
    for i in range(120):
        host, other = ("one.example", "two.example") if i % 2 else ("two.example", "one.example")
        lines = [f"Welcome at {host.split('.')[0]}", *[sentence(rng) for _ in range(3)], f"Welcome at {other.split('.')[0]}" if i < 2 else sentence(rng), "All rights reserved"]
        rows.append((i, "\n".join(lines), host, "web", None))
        wanted |= {(i, 0), (i, 5)}
    rows.append((900, rows[9][1], "two.example", "web", None))  # the other site's page
    rows.append((901, rows[11][1], None, "web", "no address"))
    wanted |= {(i, n) for i in (900, 901) for n in (0, 5)}
    for bound in (64, 1 << 40):
        pages.TEMPLATE_BYTES, kept = bound, pages.TEMPLATE_BYTES
        try:
            assert {tuple(r) for r in pages.boilerplate(spark.createDataFrame(rows, KIND).repartition(3)).collect()} == wanted
        finally:
            pages.TEMPLATE_BYTES = kept


def test_copies(spark, site):
    """Many copies of an article on its site are no template."""
    rows, wanted = site
    copies = [(2000 + k, *rows[7][1:]) for k in range(60)]
    found = {tuple(r) for r in pages.boilerplate(spark.createDataFrame(rows + copies, KIND)).collect()}
    assert found == wanted | {(2000 + k, n) for k in range(60) for i, n in wanted if i == 7}


def test_counts_are_exact(spark):
    """Hosts with many different lines lose no document from the counts on either side of the thresholds."""
    rng = random.Random(3)
    own = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(14)) for _ in range(n)]
    rows = []
    for i in range(300):  # 4 pages are needed
        lines = own(20) + (["on four pages"] if i < 4 else []) + (["on three pages"] if i < 3 else []) + (["also in two papers"] if i % 2 else [])
        rows.append((i, "\n".join(lines), "one.example", "web", None))
    for i in range(1000):  # 1 paper may have it
        rows.append((1000 + i, "\n".join(own(6) + (["also in two papers"] if i < 2 else [])), "papers", "pdf", None))
    wanted = [pages.line_keys("on four pages")[0]]
    for parts in (1, 5):
        found = [tuple(r) for r in pages.find_templates(pages.subtree_keys(spark.createDataFrame(rows, KIND).repartition(parts, "doc_id"))).collect()]
        assert found == [("web one.example", wanted[0], 4, False)]


def test_keys():
    keys = pages.line_keys('Share 12 Tweet 3\nSHARE  7 - tweet!\n12 34\nvar a1 = b2("x");\n  var c3 = d44("yy");')
    assert keys[0] == keys[1] != 0 and keys[2] == 0 and keys[3] == keys[4] != 0
    assert pages.label_keys("Ann says: hello") [1] == pages.label_keys("Bob says: bye")[1]
    assert pages.label_keys("no label here") == []
    assert pages.line_keys("Über uns\nüber uns 5")[0] == pages.line_keys("über UNS")[0]


def test_long_labels():
    """A label may end anywhere in a line."""
    long = " ".join([*["abcdefghijklmnopqrstuvwx"] * 7, "says: hello"])
    assert len(long) > 180 and len(pages.label_keys(long)) == 2 and pages.label_keys(long) == pages.label_keys(long + " there")


def test_empty(spark):
    assert pages.boilerplate(spark.createDataFrame([], KIND)).count() == 0


PROSE = ["The cat sat on the mat, and the dog was in the garden when it began to rain.", "It is not easy to say why the river turns to the north, but most of the old maps agree that it does."]


def test_figures():
    f = dict(zip(quality.FIGURES, quality.figures([PROSE])[0]))
    assert f["function"] > 0.4 and f["sentence"] == 1 and f["ended"] == 1 and f["symbols"] == 0 and f["digits"] == 0
    table = dict(zip(quality.FIGURES, quality.figures([["ab;12;34.5;yes", "cd;99;1.25;no"]])[0]))
    assert table["digits"] > 0.3 and table["function"] == 0
    assert quality.figures([]) == [] and quality.figures([[]]) == [None]
    assert [None if x is None else len(x) for x in quality.figures([["x" * 100_000], [], ["a"]])] == [len(quality.FIGURES), None, len(quality.FIGURES)]
    assert dict(zip(quality.FIGURES, quality.figures([["größer Äpfel"]])[0]))["symbols"] == 0


def test_mixture():
    """Expectation-maximization finds the likelihood's way up, and well-parted groups."""
    rng = np.random.default_rng(0)
    examples = np.array([e[1] for e in quality.EXAMPLES])
    x = np.concatenate([examples[n] + rng.normal(size=(60, examples.shape[1])) * 0.02 for n in range(len(examples))])
    m = quality.Mixture(x.mean(axis=0), x.std(axis=0))
    z = m.standard(x)

    def likelihood():
        inverse = 1 / m.variances
        logs = np.log(m.weights) - 0.5 * (np.log(m.variances).sum(axis=1) + (((z[:, None] - m.means) ** 2) * inverse).sum(axis=2))
        return np.logaddexp.reduce(logs, axis=1).sum()

    before = likelihood()
    for _ in range(5):
        m.maximize(m.sums(z))
    assert likelihood() > before
    m.name_components()
    wanted = np.repeat([e[0] for e in quality.EXAMPLES], 60)
    assert ((m.kinds(x) == "prose") == (wanted == "prose")).mean() > 0.99


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(sentence(rng) for _ in range(8)), "a", "txt", None) for i in range(60)]
    rows += [(100 + i, "\n".join(f"{rng.choice(WORDS)};{rng.randrange(999)}.{rng.randrange(99)};19{rng.randrange(10, 99)};{rng.choice(WORDS)};yes" for _ in range(20)), "a", "txt", None) for i in range(30)]
    rows += [(200 + i, " ".join(rng.choice(["cheap", "best"]) + " hat now" for _ in range(80)), "b", "pdf", None) for i in range(30)]
    rows += [(300, None, "a", "txt", None), (301, "", "a", "txt", None), (302, " \n\t", "b", "pdf", None), (303, rows[0][1], None, None, None)]
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as kind", "2 as figures")
    assert {r.doc_id for r in quality.not_prose(docs).collect()} == set(range(100, 130)) | set(range(200, 230))
    kinds = {r.doc_id: r.kind for r in quality.quality(docs).collect()}
    assert len(kinds) == len(rows) and kinds[300] is None and kinds[302] is None and kinds[303] == "prose" and kinds[100] == "table"
    assert quality.not_prose(docs.limit(0)).count() == 0
