"""The annotation algebra on golden and crafted annotations."""

import pytest
from pyspark.sql import functions as F

from quirelight.operators import bio

FIRST = ["O"] * 13 + ["U-SUBJECT"] + ["O"] * 13 + ["B-CONTRAST"] + ["I-CONTRAST"] * 4 + ["L-CONTRAST", "U-SUBJECT", "B-CONTRAST"] + ["I-CONTRAST"] * 14 + ["L-CONTRAST", "O"]
FIRST_BIO = ["O"] * 13 + ["B-SUBJECT"] + ["O"] * 13 + ["B-CONTRAST"] + ["I-CONTRAST"] * 5 + ["B-SUBJECT"] + ["I-CONTRAST"] * 16 + ["O"]
SECOND = ["B-SUBJECT"] + ["I-CONTRAST"] * 9 + ["O", "B-SUBJECT", "I-SUBJECT", "B-CONTRAST"] + ["I-CONTRAST"] * 14 + ["O"]
SECOND_BIO = ["B-SUBJECT"] + ["I-CONTRAST"] * 9 + ["O", "B-SUBJECT", "I-SUBJECT"] + ["I-CONTRAST"] * 15 + ["O"]


def tagged(spark, *samples):
    rows = [(s, i, f"w{i}", t) for s, tags in enumerate(samples) for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "sample_id bigint, i int, tok string, tag string")


def test_bioul_to_bio(spark):
    rows = bio.bioul_to_bio(tagged(spark, FIRST, SECOND)).orderBy("sample_id", "i").collect()
    assert [r.bio for r in rows if r.sample_id == 0] == FIRST_BIO
    assert [r.bio for r in rows if r.sample_id == 1] == SECOND_BIO


def test_spans(spark):
    found = bio.spans(tagged(spark, FIRST))
    assert sorted((r.kind, r.span_start, r.span_end) for r in found.collect()) == [("CONTRAST", 27, 33), ("CONTRAST", 34, 50), ("SUBJECT", 33, 34)]
    found = bio.spans(tagged(spark, ["O", "B-SUBJECT", "O", "I-CONTRAST", None, "B-", "B-CONTRAST"]))
    assert sorted((r.part_no, r.kind, r.span_start, r.span_end) for r in found.collect()) == [(1, "CONTRAST", 3, 4), (1, "SUBJECT", 1, 2), (3, "CONTRAST", 6, 7)]
    assert bio.structured_spans(found).first().parts[0][0].text == "w3"


def test_latest_and_trim(spark):
    rows = [(1, 0, "a", "O", "2020-01-01"), (1, 0, "b", "O", "2020-02-01"), (1, 0, "b", "O", "2020-02-01"), (1, 1, "c", "B-X", None), (2, 0, "d", "O", None)]
    t = bio.latest_tokens(spark.createDataFrame(rows, "sample_id bigint, i int, tok string, tag string, at string").withColumn("arrived_at", F.col("at").cast("timestamp")))
    assert sorted(tuple(r) for r in t.collect()) == [(1, 0, "b", "O"), (1, 1, "c", "B-X"), (2, 0, "d", "O")]
    assert sorted(r.tok for r in bio.trim_outside(t).collect()) == ["c", "d"]
    assert sorted(tuple(r) for r in bio.distinct_annotations(t).collect()) == [(1, "c"), (2, "d")]


def test_islands_and_pairs(spark):
    n = spark.createDataFrame([(1, x) for x in (1, 2, 3, 7, 8, 10, 10, None)], "k bigint, n int")
    assert sorted((r.r_start, r.r_end) for r in bio.islands(n, "k", "n").collect()) == [(1, 4), (7, 9), (10, 11)]
    spans = spark.createDataFrame([(1, 0, 3, True, "CONTRAST"), (1, 3, 5, True, "SUBJECT"), (1, 8, 9, True, None), (1, 6, 7, False, "CONTRAST"), (1, 4, 4, True, "SUBJECT")], "sample_id bigint, span_start int, span_end int, able boolean, kind string")
    assert sorted((r.r_start, r.r_end, r.span_start) for r in bio.pair_spans(spans).collect()) == [(0, 5, 0), (0, 5, 3), (8, 9, 8)]
    tags = bio.tags_from_spans(tagged(spark, ["x"] * 10).withColumn("sample_id", F.lit(1).cast("bigint")), spans).orderBy("i").collect()
    assert [r.tag for r in tags] == ["B-CONTRAST", "I-CONTRAST", "I-CONTRAST", "I-SUBJECT", "I-SUBJECT", "O", "O", "O", "B-", "O"]
    assert bio.pair_spans(spans.limit(0)).count() == 0


def test_conflict(spark):
    spans = spark.createDataFrame([(0, 0, 4, True, "CONTRAST"), (0, 1, 2, True, "SUBJECT"), (0, 2, 3, True, "NEW")], "sample_id bigint, span_start int, span_end int, able boolean, kind string")
    tags = bio.tags_from_spans(tagged(spark, ["x"] * 5), spans).orderBy("i").collect()
    assert [r.tag for r in tags] == ["B-CONTRAST", "I-SUBJECT", "I-CONTRAST", "I-CONTRAST", "O"]


def test_conll(spark):
    text = "-DOCSTART- -X- -X- O\n\na  NN  B-NN  B-CONTRAST\nb  VB  O  O\n\n\n\nc  NN  O  O\nbroken line"
    files = spark.createDataFrame([("f", text)], "path string, value string")
    rows = bio.read_conll(files).orderBy("sample_no", "i").collect()
    assert [(r.tok, r.tag) for r in rows] == [("a", "B-CONTRAST"), ("b", "O"), ("c", "O")]
    with pytest.raises(Exception, match="not four fields"):
        bio.read_conll(files, strict=True).collect()
    t = tagged(spark, ["B-CONTRAST", "I-CONTRAST", "B-SUBJECT"], ["B-CONTRAST"])
    lines = bio.conll_lines(t, F.when(F.col("i") == 1, None).otherwise("NN")).orderBy("i").collect()
    assert [r.line for r in lines] == ["w0  NN  B-NN  B-CONTRAST", "w1  UKN  I-UKN  I-CONTRAST", "w2  NN  B-NN  B-SUBJECT"]
    assert {(r.sample_id, r.ok) for r in bio.exactly_two_begins(t).collect()} == {(0, True), (1, False)}
