"""Topics of documents and their headwords."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.common import bounded_broadcast
from quirelight.functions.text import topic_clean

NO_TOPIC = "no topic set"
#: Phrases: characters at least, words at most, occurrences at least.
MIN_CHARS, MAX_WORDS, MIN_FREQUENCY = 10, 2, 5
#: Documents in one list.
LISTED = 10_000
#: Words that part phrases (fixed values).
STOPWORDS = (
    "a about after again all also always an and another any are as at be because been before being between both but by can could did do does during each"
    " few for from further had has have he her here him his how i if in into is it its many may more most must my no nor not of often on one only or other"
    " our out over own same shall she should since so some sometimes such than that the their them then there these they this those through to too under"
    " until up us usually very was we were what when where whereas which while who whose why will with without would you your"
).split()


def best_topic(weights: DataFrame) -> DataFrame:
    """``(doc, topic)``: the heaviest topic of each document, of equal ones the first by name; null weights don't count, of repeated rows the largest does."""
    rows = weights.where("weight is not null and topic is not null").groupBy("doc", "topic").agg(F.max("weight").alias("weight"))
    return rows.groupBy("doc").agg(F.min_by("topic", F.struct(-F.col("weight"), F.col("topic"))).alias("topic"))


def topic_documents(best: DataFrame, most: int = LISTED) -> DataFrame:
    """``(topic, part, docs)``: the sorted documents of each topic, in lists of about ``most`` at most: a topic with more has several parts, by the documents' hashes."""
    sizes = best.groupBy("topic").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    placed = best.join(bounded_broadcast(sizes, sizes.count()), "topic").withColumn("part", F.pmod(F.xxhash64("doc"), "parts").cast("int"))
    return placed.groupBy("topic", "part").agg(F.array_sort(F.collect_list("doc")).alias("docs"))


def phrases(texts: DataFrame, key: str, text: str = "text", stopwords: list[str] | tuple[str, ...] = tuple(STOPWORDS)) -> DataFrame:
    """``(key, phrase, words, n)``: runs of words between stop words and marks, and how often each stands there."""
    found = _parted(F.col(text), frozenset(stopwords))
    rows = texts.select(key, F.explode(found).alias("phrase"))
    return rows.groupBy(key, "phrase").agg(F.count("*").alias("n")).withColumn("words", F.split("phrase", " "))


def _parted(text: Column, stopwords: frozenset[str]) -> Column:
    """The phrases of each text; many texts at a time, as a set finds a stop word sooner than a pattern of all of them."""
    pieces = re.compile(r"[a-z0-9]+|[\s'-]+|[^a-z0-9\s'-]+", re.ASCII).findall
    kept = frozenset("abcdefghijklmnopqrstuvwxyz0123456789 \t\n\r\f\v'-")

    def phrases_of(t: str | None) -> list[str]:
        out, run = [], []
        for p in pieces((t or "").lower()):
            run.append("|" if p in stopwords or p[0] not in kept else p)
        for x in "".join(run).split("|"):
            if phrase := " ".join(x.split()).strip(" '-"):
                out.append(phrase)
        return out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(phrases_of)

    return run(text)


def keyphrases(texts: DataFrame, key: str, text: str = "text", min_chars: int = MIN_CHARS, max_words: int = MAX_WORDS, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """``(key, phrase, score)`` of rapid automatic keyword extraction: a word scores its degree by its frequency, a phrase the sum of its words' scores.

    Phrases of too few characters, too many words or occurrences, or without a letter, are no candidates and give no degrees.
    """
    found = phrases(texts, key, text).where((F.length("phrase") >= min_chars) & (F.size("words") <= max_words) & (F.col("n") >= min_frequency) & F.col("phrase").rlike("[a-z]"))
    words = found.select(key, "n", F.size("words").alias("size"), F.explode("words").alias("word"))
    scores = words.groupBy(key, "word").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("s"))
    each = found.select(key, "phrase", F.explode("words").alias("word")).join(scores, [key, "word"])
    return each.groupBy(key, "phrase").agg(F.sum("s").alias("score"))


def headwords(texts: DataFrame, key: str, text: str = "text", **limits: int) -> DataFrame:
    """``(key, headword)``: the best keyphrase of each key, of equal ones the first; ``NO_TOPIC`` without any."""
    best = keyphrases(texts, key, text, **limits).groupBy(key).agg(F.min_by("phrase", F.struct(-F.round("score", 9), F.col("phrase"))).alias("headword"))
    return texts.select(key).distinct().join(best, key, "left").select(key, F.coalesce("headword", F.lit(NO_TOPIC)).alias("headword"))


def headword_documents(best: DataFrame, heads: DataFrame) -> DataFrame:
    """``(topic, headword, docs)``: documents by topic and the topic's headword."""
    return topic_documents(best).join(heads, "topic").select("topic", "headword", "part", "docs")


def topic_texts(best: DataFrame, documents: DataFrame, path: Column) -> DataFrame:
    """``(topic, doc, text)``: the cleaned texts of each topic's documents."""
    return documents.select(path.alias("doc"), topic_clean(F.col("text")).alias("text")).join(best, "doc").select("topic", "doc", "text")


def lda_topics(documents: DataFrame, k: int = 8, iterations: int = 50, drop_most_frequent: int = 100, min_docs: int = 2, seed: int = 42) -> DataFrame:
    """``(doc_id, topic)`` by latent Dirichlet allocation, without the most frequent words; every document has one topic, also an empty one.

    The vocabulary is all words of at least ``min_docs`` documents. Each iteration goes over all documents.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    rows = documents.select("doc_id", words.alias("words"))
    counted = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    common = counted.orderBy(F.desc("n"), "word").limit(drop_most_frequent).agg(F.collect_list("word").alias("common"))  # a top-k of fixed size
    common = common.first()[0] or [""]
    rows = rows.withColumn("words", F.filter("words", lambda w: ~F.array_contains(F.array(*map(F.lit, common)), w)))
    known = rows.select("doc_id", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).count()
    model = CountVectorizer(inputCol="words", outputCol="features", vocabSize=max(known, 1), minDF=min_docs).fit(rows)
    vectors = model.transform(rows).select("doc_id", "features")
    shares = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online", subsamplingRate=1.0).fit(vectors).transform(vectors)
    weights = vector_to_array("topicDistribution")
    return shares.select("doc_id", F.coalesce(F.array_position(weights, F.array_max(weights)).cast("int") - 1, F.lit(0)).alias("topic"))


def topic_words(texts: DataFrame, best: DataFrame, doc: str = "doc", text: str = "text", most: int = 10) -> DataFrame:
    """``(topic, word, n, place)``: the most frequent words of each topic's documents, of equals the first by name; stop words don't count."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: (F.length(w) > 2) & ~F.array_contains(F.array(*map(F.lit, STOPWORDS)), w))
    counted = texts.join(best, doc).select("topic", F.explode(words).alias("word")).groupBy("topic", "word").agg(F.count("*").alias("n"))
    # a first cut by hash leaves a few rows of each topic to sort
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))
    few = counted.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64))).withColumn("own", place("topic", "part")).where(F.col("own") <= most)
    return few.withColumn("place", place("topic")).where(F.col("place") <= most).select("topic", "word", "n", "place")


def predict_headwords(texts: DataFrame, key: str = "doc_id", **limits: int) -> DataFrame:
    """``headwords`` of each text by itself."""
    return headwords(texts, key, **limits)


def describe(best: DataFrame) -> DataFrame:
    """``(topic, n_docs, place)``: topics by their number of documents."""
    return best.groupBy("topic").agg(F.count("*").alias("n_docs")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_docs"), "topic")))
