"""The tokeniser and the cleaners on crafted texts."""

import pytest
from pyspark.sql import functions as F

from quirelight.functions import nested, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("foo, (bar) baz.", ["foo", ",", "bar", ")", "baz", "."]),
        ("can't a/b ...", ["can", "'", "t", "a", "/", "b"]),
        ("U.S.A., e.g.", ["U", ".", "S", ".", "A", ".", ",", "e", ".", "g", "."]),
        ("what?! what!?", ["what", "?", "!", "what", "!"]),
        ("a..b word...", ["a", ".", "b", "word", "."]),
        ('[x] {y} "q"', ["x", "]", "y", "}", '"q"']),
        ("line\nbreak end\n", ["line\nbreak", "end"]),
        ("", []),
        ("   ", []),
        ("((((", []),
    ],
)
def test_tokens(spark, given, wanted):
    assert one(spark, given, text.tokens) == wanted


def test_tokens_of_null_and_long(spark):
    assert one(spark, None, text.tokens) is None
    assert len(one(spark, "ab, " * 20_000, text.tokens)) == 40_000


def test_cleaners(spark):
    assert one(spark, "a  b   c\nd", text.inner_strip) == "a b  cd"
    assert one(spark, "a\n\n\nb", text.collapse_lines) == "a\n\nb"
    assert one(spark, "a-b\nc é1", text.topic_clean) == "abc 1"
    assert one(spark, 'a"b*c‘d’ [e]', text.web_whitelist) == "abc‘d’ [e]"
    assert one(spark, "it's a.b c/d", text.safe_name) == "its_a_b_c_d"
    assert one(spark, "x/y/z.html", text.basename) == "z.html"
    assert one(spark, "abcd", lambda c: text.insert_at(c, 2, "-")) == "ab-cd"
    assert one(spark, "ab", lambda c: text.insert_at(c, 9, "-")) == "ab-"
    assert one(spark, "long- \nword;\nx", text.join_wrapped) == "longword  x"
    assert one(spark, "body Latest Posts more", lambda c: text.cut_after(c, "Latest Posts")) == "body "
    assert one(spark, "a, b!", text.punctuation_token) == "aPCT bPCT"
    assert one(spark, None, text.web_whitelist) is None


def test_word_tag_and_paths(spark):
    row = spark.createDataFrame([(3, "w")], "i int, w string").select(text.word_tag(F.col("i"), F.col("w")), text.word_tag(F.col("i"), F.col("w"), F.lit(0.5)), text.output_paths(F.col("w"), "o")).first()
    assert row[0] == '<z id="z3">w</z>' and "hsl(180" in row[1]
    assert row[2]["json_path"] == "o/json/w.json" and len(row[2]) == 5


def test_nested(spark):
    assert one(spark, [[1, 2], [3]], lambda c: nested.flatten_deep(c, 1), "array<array<int>>") == [1, 2, 3]
    assert one(spark, [[1, 2], [3]], lambda c: nested.map_leaves(c, lambda x: x + 1, 2), "array<array<int>>") == [[2, 3], [4]]
    assert nested.flatten_values([1, 2, ["b", "a", ["c", "d"]], 3]) == [1, 2, "b", "a", "c", "d", 3]
    assert one(spark, '{"a": {"b": 1}, "c": "x"}', nested.json_flat) == {"a_b": "1", "c": "x"}
    assert one(spark, "broken", nested.json_flat) is None
    assert one(spark, '[1, ["b", [2]]]', nested.json_values) == ["1", "b", "2"]
    given = {"body": {"abdomen": [{"arms": {"value": 2}}, {"legs": {"value": 2}}], "hands": {"fingers": {"value": 5}}}}
    wanted = [{2: {"arms": {"abdomen": {"body": {}}}}}, {2: {"legs": {"abdomen": {"body": {}}}}}, {5: {"fingers": {"hands": {"body": {}}}}}]
    assert nested.reversed_paths(given, "value") == wanted
    rows = spark.sql("select named_struct('x', map('a', array(map('p', 1, 'q', 2)), 'b', null)) m union all select named_struct('x', map('b', null, 'a', array(map('q', 2, 'p', 1))))")
    hashes = rows.select(nested.structural_hash(rows, "m").alias("h"))
    assert hashes.distinct().count() == 1
    lists = spark.sql("select map('a', array(1, 2)) m union all select map('a', array(2, 1))")
    assert lists.select(nested.structural_hash(lists, "m")).distinct().count() == 2
