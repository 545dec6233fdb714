"""Documents as indexed words, and what is written of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions.text import tokens, word_tag


def index_words(boxes: DataFrame, doc: str = "doc_id", order: str = "reading_sequence", text: str = "text") -> DataFrame:
    """``(doc, word_index, box, content_index, word)``: the words of a document's boxes, numbered in reading order.

    A box's first number is the sum of the words before it, so only counts are summed over the document, not words sorted.
    """
    cut = boxes.select(doc, order, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("ws"))
    before = F.coalesce(F.sum(F.size("ws")).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cut.withColumn("start", before).select(doc, F.col(order).alias("box"), "start", F.posexplode("ws").alias("content_index", "word"))
    return rows.select(doc, (F.col("start") + F.col("content_index")).alias("word_index"), "box", "content_index", "word")


def index_document(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, word_index, word)`` of whole texts."""
    return documents.select(doc, F.posexplode(tokens(F.col(text))).alias("word_index", "word"))


def marked_up(words: DataFrame, debug: bool = False) -> DataFrame:
    """``tag``: each word's markup."""
    share = F.col("word_index") / F.count("*").over(Window.partitionBy("doc_id")) if debug else None
    return words.withColumn("tag", word_tag(F.col("word_index"), F.col("word"), share))


def document_json(words: DataFrame, doc: str = "doc_id", backwards: bool = False) -> DataFrame:
    """``(doc, json)``: ``{text, indexed_words, cuts}`` of each document; ``backwards`` joins a box's words from last to first."""
    key = F.struct("box", -F.col("word_index"), "word") if backwards else F.struct("word_index", F.lit(0), "word")
    rows = words.groupBy(doc).agg(F.array_sort(F.collect_list(key)).alias("ws"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("word_index", "word")))).alias("indexed_words"))
    text = F.array_join(F.transform("ws", lambda w: w["word"]), " ")
    return rows.select(doc, F.to_json(F.struct(text.alias("text"), "indexed_words", F.array().cast("array<string>").alias("cuts"))).alias("json"))


def plain_text(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, value)``: the words joined by blanks."""
    ws = F.array_sort(F.collect_list(F.struct("word_index", "word")))
    return words.groupBy(doc).agg(F.array_join(F.transform(ws, lambda w: w["word"]), " ").alias("value"))
