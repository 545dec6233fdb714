"""Layout kernels, prose, embeddings, tuning, HTML, sources, streams on small inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirelight.exceptions import ConversionError, EmptyPageConversionError
from quirelight.functions import html
from quirelight.operators import convert, embed, layout, match, prose, sequences, topics, tuning, words
from quirelight.plans import catalogue
from quirelight.plans.registry import Registry
from quirelight.sources import files, sinks
from quirelight.streaming import incremental


def test_blur_and_peaks():
    field = np.zeros((100, 100))
    field[50, 50] = 1
    assert abs(layout.blur(field, 3.0).sum() - 1) < 1e-9 and layout.blur(field, 0.5).argmax() == 5050
    row = np.zeros(100)
    row[[10, 40, 80]] = 1, 2, 1.5
    assert layout.peak_counts(row[None])[0] == 3
    row[45] = 1
    assert layout.peak_counts(row[None])[0] == 3  # too near a higher one
    assert layout.peak_counts(np.zeros((2, 100))).tolist() == [0, 0] and layout.columns_of(np.zeros((1, 100, 100))) == 1


@pytest.mark.parametrize("columns", [1, 2, 3])
def test_columns_and_order(spark, columns):
    rows = [(1, n, 0, f"text {c} {k}", 60.0 + c * 600.0 / columns, 900.0 - 12.0 * k) for n, (c, k) in enumerate((c, k) for k in range(60) for c in range(columns))]
    boxes = spark.createDataFrame(rows, "doc_id bigint, box_index int, page_number int, text string, x double, y double")
    for c in ("line_height", "font_size", "height"):
        boxes = boxes.withColumn(c, F.lit(1.0))
    boxes = boxes.withColumn("tag_attributes", F.array(F.lit("x1")))
    placed = layout.points(layout.distinct_boxes(boxes.union(boxes)))
    assert placed.count() == len(rows)
    assert layout.document_columns(layout.density(placed)).first().columns == columns
    ordered = layout.reading_order(layout.column_labels(placed, F.lit(columns))).orderBy("reading_sequence").collect()
    assert [r.text for r in ordered] == [f"text {c} {k}" for c in range(columns) for k in range(60)]
    assert len(layout.pages_to_columns(layout.column_text(layout.reading_order(layout.column_labels(placed, F.lit(columns))))).first().pages[0]) == columns
    assert layout.density(placed.limit(0)).count() == 0


def test_found_columns(spark, tmp_path):
    """The queries by found columns against the columns that pages were made of."""
    rows, places = [], {1: [60.0], 2: [60.0, 360.0], 3: [60.0, 260.0, 460.0]}
    wanted, texts = {}, {}
    for doc, xs in places.items():
        for page in range(2):
            for k in range(60):
                for c, x in enumerate(xs):
                    n = (page * 60 + k) * len(xs) + c
                    rows.append((doc, n, page, f"text column {c + 1}", ["x1"], 1.0, 1.0, 1.0, x, 900.0 - 12.0 * k))
                    wanted[doc, n] = (c, (page * len(xs) + c) * 60 + k)
                    texts[doc, page, c] = " ".join([f"text column {c + 1}"] * 60)
    kind = "doc_id bigint, box_index int, page_number int, text string, tag_attributes array<string>, line_height double, font_size double, height double, x double, y double"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/boxes.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    labels = {(r.doc_id, r.box_index): (r.columns, r.column_label) for r in run("column_labels")}
    order = {(r.doc_id, r.box_index): r.reading_sequence for r in run("reading_order")}
    assert {k: v[0] for k, v in labels.items()} == {k: len(places[k[0]]) for k in wanted}
    assert order == {k: v[1] for k, v in wanted.items()}
    for doc in places:
        assert len({(v[1], wanted[k][0]) for k, v in labels.items() if k[0] == doc}) == doc
    assert {(r.doc_id, r.page_number, r.column_no): r.column_text for r in run("column_text")} == texts
    assert [(r.doc_id, r.box_index) for r in run("body_mask") if not r.in_body] == []
    spaced = {(r.doc_id, r.box_index): (r.before, r.behind) for r in run("line_distances")}
    assert all(spaced[k] == (12.0, 12.0) for k, (c, seq) in wanted.items() if 0 < seq % 60 < 59)
    # a column has its words (1) and its number 60 times and no other (180 - 3); a page as many columns as found (10) and, with two, as expected (10)
    assert {r.doc_id: r.score for r in run("layout_score")} == {d: 2 * (178 * d + 10 + (10 if d == 2 else 0)) for d in places}


def test_ranges(spark):
    row = spark.range(1).select(tuning.parameter_range(F.lit(10.0), F.lit(70.0)), tuning.fractal_range(F.lit(40.0), F.array(F.lit(10.0), F.lit(40.0), F.lit(70.0))), layout.evaluation_range(F.lit(10.0))).first()
    assert row[0] == [10.0, 30.0, 50.0, 70.0] and row[1] == [20.0, 40.0, 60.0]
    assert row[2] == [5.0, 7.0, 9.0, 11.0, 13.0]


def test_search(spark):
    kind = "trial_id bigint, param string, val double, score double, state map<string,double>, run_at timestamp"
    s = tuning.Search({"a": [10.0, 40.0, 70.0], "b": [0.0, 1.0]})
    best = s.update(spark.createDataFrame([(1, "a", 30.0, 2.0, None, None), (2, "a", 50.0, 1.0, None, None), (3, "b", 0.0, float("nan"), None, None), (4, "b", None, 9.0, None, None)], kind))
    assert best["param"] == "a" and best["mean_val"] == 30.0 and s.sized["a"] == -1 and np.allclose(s.ranges["a"], [10.0, 30.0 - 20 / 3, 30.0 + 20 / 3, 50.0])
    s.update(spark.createDataFrame([(1, "a", 10.0, 2.0, None, None), (2, "a", 50.0, 2.0, None, None)], kind))
    assert s.sized["a"] == 0 and len(s.ranges["a"]) == 6
    assert s.update(spark.createDataFrame([], kind)) == best


def _ks(sample, text):
    points = sorted(set(sample) | set(text))
    return max(abs(sum(c <= p for c in sample) / len(sample) - sum(c <= p for c in text) / len(text)) for p in points)


def test_prose_distance(spark):
    sample = "".join(c * n for c, n in prose.SAMPLE.items())
    texts = ["the foundations of inference are stated here", "12 34 56 78", "é ü zz\n~", "a", "A B C"]
    got = prose.distances(pd.Series([*texts, "", None]))
    assert np.allclose(got[:5], [_ks(sample, t) for t in texts]) and np.isnan(got[5:]).all()
    docs = spark.createDataFrame([(1, "the desire for such a model is strong among those who study representations " * 3 + "\n\n" + "0123456789 " * 30), (2, None), (3, "")], "doc_id bigint, text string")
    kept = {(r.doc_id, r.paragraph_no): r.keep for r in prose.prose_paragraphs(docs).collect()}
    assert kept == {(1, 0): True, (1, 1): False, (3, 0): False}
    assert prose.prose_text(docs, 10).where("doc_id = 1").first().prose == "the desire"


def test_chance():
    """Counted paths against all orders of two samples, and the border of what counts as prose."""
    from itertools import combinations

    for n, m in ((1, 4), (2, 5), (3, 4), (4, 4), (5, 3)):
        orders = []
        for own in combinations(range(n + m), n):
            i = j = far = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in own else (i, j + 1)
                far = max(far, abs(m * i - n * j))
            orders.append(far)
        for h in set(orders):
            assert abs(prose.exact_chance(n, m, h) - np.mean([x >= h for x in orders])) < 1e-12
    assert prose.prose_like(pd.Series(["q", "qq", "zz", "zzz", "he", None, "", "the"])).tolist() == [True, True, False, False, True, False, False, True]
    # the asymptotic chance alone would keep these
    assert [prose.critical() > 1.73, prose.exact_chance(2, 1018, 2036) < 1e-5, prose.exact_chance(3, 1018, 3054) < 1e-7] == [True] * 3


def test_rejects(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>"), (2, "<p> </p>"), (3, None)], "doc_id bigint, html string")
    good, empty = convert.rejects(pages, False)
    assert [r.doc_id for r in good.collect()] == [1] and sorted(r.doc_id for r in empty.collect()) == [2, 3]
    with pytest.raises(EmptyPageConversionError):
        convert.rejects(pages, False, strict=True)
    assert convert.rejects(pages.where("doc_id = 1"), False, strict=True)[1].count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=(30, 8))
    text = spark.createDataFrame([(1, i, list(map(float, v))) for i, v in enumerate(e)], "key int, i int, embedding array<double>")
    phrase = text.where("i between 11 and 13").withColumn("i", F.col("i") - 11)
    scores = embed.sliding_correlation(text, phrase)
    wanted = [sum(float(e[s + k] @ e[11 + k]) for k in range(3)) for s in range(28)]
    assert np.allclose([r.score for r in scores.orderBy("shift").collect()], wanted)
    assert embed.left_border(scores).first().border == int(np.argmax(wanted))
    assert embed.right_border(text, phrase).first().border == int(np.argmax(wanted)) + 3
    # from the start 11 and 12 are covered, from the end 12 and 13
    label = embed.label_peaks(text, phrase, "S").collect()
    assert [r.i for r in label] == [12] and abs(label[0].score - wanted[12]) < 1e-9
    twice = text.union(text.withColumn("i", F.col("i") + 30))
    assert {r.i for r in embed.label_peaks(twice, phrase, "S").collect()} == {12, 42}
    assert {r.i for r in embed.label_peaks(text, text.where("i = 9").withColumn("i", F.lit(0)), "S").collect()} == {int(np.argmax(e @ e[9]))}
    one = embed.left_borders(text, text.where("i = 7").withColumn("i", F.lit(0))).first()
    assert one.border == 7 and abs(one.confidence) < 1e-9  # by distance, not by the longest vector
    assert embed.left_borders(text, phrase).first().border == int(np.argmax(wanted))
    zero = spark.sql("select array(0d, 0d) a, array(1d, 0d) b").select(embed.negative_cosine([(F.col("a"), F.col("b"))]), embed.negative_cosine([(F.col("b"), F.col("b"))]), embed.pad_right(F.col("a"), 4)).first()
    assert zero[0] == -25.0 and zero[1] == 0.0 and zero[2] == [0.0] * 4


def test_html(spark):
    page = '<html><style type="text/css">.x1{left: 10px; color: red} .x1{left:12.5px}</style><style>p{}</style><body><div class="a post"><script>no</script><p>One <b>two</b><li>x<li>y</div> tail <a rel="bookmark" href="u">l</a><a href="v">m</a></body>'
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<div" * 50 + "<p>" * 2000 + "deep")], "page_id bigint, html string")
    assert {r.page_id: r.text for r in html.post_text(rows).collect()} == {1: "One twoxy", 2: None, 3: None, 4: None}
    assert [(r.seq, r.href) for r in html.links(rows, rel=None).where("page_id = 1").orderBy("seq").collect()] == [(0, "u"), (1, "v")]
    assert [r.href for r in html.links(rows).collect()] == ["u"]
    assert [(r.ident, r.prop, r.val) for r in html.style_rules(rows, "page_id").collect()] == [("x1", "left", 12.5)]
    assert html.nodes(rows).where("page_id = 1 and tag = 'li'").count() == 2
    assert [r.text for r in html.content(rows).where("page_id = 1").orderBy("seq").collect()][:2] == ["One ", "two"]
    assert "alert" not in html.sanitized(html.parse('<form>alert</form><i href="javascript:alert" title="t">k</i><!-- c -->'))
    rendered = spark.createDataFrame([(1, '<div data-page-no="1"><div class="t x1 y2">a</div></div><div data-page-no="2"><div class="x3">b</div></div>')], "doc_id bigint, html string")
    assert [(r.box_index, r.page_number, r.text) for r in html.boxes(rendered).orderBy("box_index").collect()] == [(0, 0, "a"), (1, 1, "b")]


def test_html_of_all_pages(spark, tmp_path):
    """Pages with carriage returns or NUL have rows too, and their texts come out as they went in."""
    texts = {1: "a\nb", 2: "a\r\nb & c\r\n", 3: "a\rb < c\nd\r\n", 4: "a\0b"}
    rows = [(k, v, "web") for k, v in texts.items()] + [(5, None, "web"), (6, "x", "pdf")]
    spark.createDataFrame(rows, "doc_id bigint, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in run("html_text")} == {k: "t" + v for k, v in texts.items()}
    assert {r.doc_id: r.text for r in run("html_post")} == texts
    assert sorted((r.doc_id, r.seq, r.href) for r in run("html_links")) == [(k, 0, f"/{k}") for k in texts]


def test_output_paths_of_all_sources(spark, tmp_path):
    rows = [(1, "a.b-c d"), (2, "Reuters"), (3, "it's A/b:1"), (4, None), (5, "é")]
    spark.createDataFrame(rows, "doc_id bigint, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.txt_path for r in catalogue.QUERIES["output_paths"](spark, str(tmp_path)).collect()}
    assert set(found) == {1, 2, 3, 5} and found[1] == "out/txt/a_b_c_d.txt" and found[2] == "out/txt/Reuters.txt"
    assert all(v and v.startswith("out/txt/") for v in found.values())


def test_matching(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "zz"), (3, None), (4, ""), (5, "a  b")], "item_id bigint, text string")
    pages = spark.createDataFrame([(10, "xx a\nb yy"), (11, None), (12, "ab")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in match.occurrences(texts, pages, "item_id", "doc_id").collect()) == [(1, 10), (1, 12), (5, 10), (5, 12)]
    assert [r.text for r in match.whats_new(texts, pages, "item_id", "doc_id").collect()] == ["a b"]
    assert match.unseen(pages, pages.limit(1), "doc_id").count() == 2
    assert match.occurrences(texts.limit(0), pages, "item_id", "doc_id").count() == 0


def test_matching_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(match, "BLOCK_BYTES", 2)
    texts = spark.createDataFrame([(n, f"t{n}") for n in range(6)], "item_id bigint, text string")
    pages = spark.createDataFrame([(1, "t0 t3 t5")], "doc_id bigint, text string")
    assert sorted(r.item_id for r in match.occurrences(texts, pages, "item_id", "doc_id").collect()) == [0, 3, 5]


def test_sequences(spark):
    rows = spark.createDataFrame([("k", n, v) for n, v in enumerate([3, 1, 3, 1, 1, 2])], "k string, n int, v int")
    assert sequences.mode_first(rows, ["k"], "v", "n").first().v == 1
    assert [r.v for r in sequences.repeating(rows, "k", "v", "n").orderBy("place").collect()] == [3, 1]
    assert sequences.repeating(rows, "k", "v", "n", 9).count() == 0
    three = sequences.threewise(rows, "v", "k", "n").orderBy("n").collect()
    assert [(r.before, r["at"], r.after) for r in three][:2] == [(3, 1, 3), (1, 3, 1)]
    gap = spark.createDataFrame([("k", n, v) for n, v in enumerate(["a", None, "b", "c"])], "k string, n int, v string")
    assert [(r.before, r["at"], r.after) for r in sequences.threewise(gap, "v", "k", "n").orderBy("n").collect()] == [("a", None, "b"), (None, "b", "c")]
    inverted = sequences.invert_lists(spark.createDataFrame([("a", [1, 2, 2]), ("b", [2])], "k string, vs array<int>"), "k", "vs")
    assert sorted((r.value, r.k) for r in inverted.collect()) == [(1, "a"), (2, "a"), (2, "b")]
    assert sorted(r.n for r in sequences.shuffled(rows, 1).collect()) == list(range(6))


def test_topics(spark):
    w = spark.createDataFrame([("d1", "t1", 0.5), ("d1", "t0", 0.5), ("d1", "t2", None), ("d2", "t2", 0.1), ("d2", "t2", 0.1)], "doc string, topic string, weight double")
    assert {r.doc: r.topic for r in topics.best_topic(w).collect()} == {"d1": "t0", "d2": "t2"}
    listed = topics.topic_documents(spark.createDataFrame([(f"d{n}", "t") for n in range(100)], "doc string, topic string"), 10).collect()
    assert sorted(d for r in listed for d in r.docs) == sorted(f"d{n}" for n in range(100)) and {r.part for r in listed} <= set(range(10)) and len(listed) > 5
    words = topics.topic_words(spark.createDataFrame([("d1", "Sea the sea land"), ("d2", None)], "doc string, text string"), topics.best_topic(w), most=1)
    assert [tuple(r) for r in words.collect()] == [("t0", "sea", 2, 1)]
    texts = spark.createDataFrame([(1, "The climate model is a climate model and the climate model"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.headword for r in topics.predict_headwords(texts, min_frequency=2).collect()}
    assert got == {1: "climate model", 2: "no topic set", 3: "no topic set"}


def test_lda_takes_all(spark, data, monkeypatch):
    """50 iterations over all documents, and no word of two documents is left out."""
    from pyspark.ml.clustering import LDA

    seen, fit = {}, LDA.fit

    def watched(self, vectors):
        seen.update(iterations=self.getMaxIter(), share=self.getSubsamplingRate(), words=vectors.first().features.size)
        return fit(self.setMaxIter(1), vectors)

    monkeypatch.setattr(LDA, "fit", watched)
    assert catalogue.QUERIES["lda_topics"](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert seen["iterations"] == 50 and seen["share"] == 1.0
    letters = [chr(97 + i) for i in range(26)]
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:2]]  # 35,152
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(2)], "doc_id bigint, text string")
    topics.lda_topics(docs)
    assert seen["words"] == len(words) - 100


def test_words(spark):
    boxes = spark.createDataFrame([(1, 1, "b, c"), (1, 0, "a"), (1, 2, None), (2, 0, "")], "doc_id bigint, reading_sequence int, text string")
    found = words.index_words(boxes)
    assert [(r.word_index, r.word, r.box) for r in found.orderBy("word_index").collect()] == [(0, "a", 0), (1, "b", 1), (2, ",", 1), (3, "c", 1)]
    assert words.document_json(found).first().json == '{"text":"a b , c","indexed_words":{"0":"a","1":"b","2":",","3":"c"},"cuts":[]}'
    assert '"text":"a c , b"' in words.document_json(found, backwards=True).first().json
    assert words.plain_text(found).first().value == "a b , c"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.html").write_text("<p>x</p>")
    (tmp_path / "in/sub/b.txt").write_text("one\n\ntwo")
    (tmp_path / "in/c.odd").write_text("?")
    root = str(tmp_path / "in")
    assert files.scan(spark, root).count() == 3 and files.scan(spark, root, "*.txt", shuffle_seed=1).count() == 1
    known, rejected = files.dispatch(files.scan(spark, root))
    assert known["html"].count() == 1 and known["text"].count() == 1 and rejected.count() == 1
    assert [r.name for r in files.names(files.scan(spark, root), ("html",)).collect()] == ["a.html"]
    assert files.names(files.scan(spark, root), ("html", "txt"), without=True).count() == 1
    texts = files.whole_texts(spark, root, "*.txt")
    assert texts.first().value == "one\n\ntwo"
    state = str(tmp_path / "state")
    assert files.cached_state(spark, state, texts) is None
    files.keep_state(spark.range(3), state, texts)
    assert files.cached_state(spark, state, texts).count() == 3
    assert files.cached_state(spark, state, texts.limit(0)) is None
    (tmp_path / "w").write_text("ab\nabc\nabcd\n")
    assert files.word_list(spark, str(tmp_path / "w")).count() == 2
    files.upload(spark.createDataFrame([("../x;rm", b"1")], "filename string, content binary"), str(tmp_path / "up"))
    assert files.upload(spark.createDataFrame([("a b.txt", "é"), (None, "x"), ("y", None)], "filename string, content string"), str(tmp_path / "up")) == 1
    assert (tmp_path / "up/___x_rm").read_bytes() == b"1" and (tmp_path / "up/a_b.txt").read_text() == "é"
    sinks.write_texts(texts, str(tmp_path / "t1"), str(tmp_path / "t2"))
    sinks.write_markup(spark.createDataFrame([(1, "<email>")], "doc_id bigint, markup string"), str(tmp_path / "m"), "doc_id")
    assert spark.read.parquet(str(tmp_path / "m")).first().value == "&lt;email&gt;"
    sinks.append_seen(texts, str(tmp_path / "seen"))
    sinks.append_seen(texts, str(tmp_path / "seen"))
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 2
    assert sinks.deliver(texts) == 0


def test_stream(spark, tmp_path):
    source, out = tmp_path / "src", str(tmp_path / "out")
    source.mkdir()
    (source / "a.txt").write_text("one")
    (source / "b.txt").write_text("  ")

    def run():
        incremental.run_once(incremental.new_texts(spark, str(source)), str(tmp_path / "log"), lambda b, _: incremental.append_unseen(b, out, "path"))
        return spark.read.parquet(out).count()

    assert run() == 1
    (source / "c.txt").write_text("three")
    assert run() == 2 and run() == 2


def test_registry(spark):
    r = Registry()
    r.converter("a", "b")(lambda df: df.withColumn("b", F.lit(1)))
    r.converter("b", "c")(lambda df: df.withColumn("c", F.lit(2)))
    assert r.convert(spark.range(1), "a", "c").columns == ["id", "b", "c"]
    with pytest.raises(ConversionError):
        r.way("c", "a")


def test_conversions(spark):
    rules = "".join(f".x{c}{{left:{60 + 330 * c}px}}" for c in range(2)) + "".join(f".y{k}{{bottom:{900 - 12 * k}px}}" for k in range(60)) + ".h0{height:9px}.ff0{line-height:1}.fs0{font-size:9px}"
    divs = "".join(f'<div class="t x{c} y{k} h0 ff0 fs0">text {c} {k}</div>' for k in range(60) for c in range(2))
    page = f'<html><head><style type="text/css">{rules}</style></head><body><div data-page-no="1">{divs}</div></body></html>'
    pages = spark.createDataFrame([(1, page)], "doc_id bigint, html string")
    placed = convert.set_geometry(convert._bare(pages), html.style_rules(pages)).where("box_index = 3").first()
    assert (placed.x, placed.y, placed.height, placed.font_size, placed.line_height) == (390.0, 888.0, 9.0, 9.0, 1.0)
    got = [r.word for r in convert.positioned(pages).orderBy("word_index").collect()]
    wanted = [w for c in range(2) for k in range(60) for w in ("text", str(c), str(k))]
    assert got == wanted
    plain = spark.createDataFrame([(2, "<p>One, <b>two</b></p><script>x</script>"), (3, None)], "doc_id bigint, html string")
    assert convert.documents_json(plain, rendered=False).first().json == '{"text":"One , two","indexed_words":{"0":"One","1":",","2":"two"},"cuts":[]}'


def test_small_conversions(spark):
    row = spark.sql("select array('a', 'b', 'c', 'd') c, array('x', 'y') t, '<head></head>' h").select(
        convert.header_id(F.col("c")), convert.header_id(F.col("t")), convert.zip_tags(F.col("c"), F.col("t")), convert.covered(F.col("h")), convert.covered(F.lit("x"))
    ).first()
    assert row[0] == "d" and row[1] is None and [tuple(p) for p in row[2]] == [("a", "x"), ("b", "y")]
    assert row[3].endswith("</style></head>") and row[4].endswith("</style>x")
    found = spark.createDataFrame([("The",), ("qq",)], "word string")
    assert convert.real_words(found).count() == 2 and convert.real_words(found, spark.createDataFrame([("the",)], "word string")).count() == 1
