"""Embeddings: padding, sliding correlation of a phrase along a text, borders, similarity.

An embedding is a token's ``array<float>``; texts and phrases are rows ``(key, i, embedding)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.operators.sequences import dilate

#: Share of the highest correlation that counts as a peak; the similarity of vectors without direction.
PEAK, NO_SIMILARITY = 0.93, -25.0


def pad_right(array: Column, length: int) -> Column:
    """Zeros behind, up to the length; longer arrays stay."""
    return F.concat(array, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(array), F.lit(0)).cast("int")))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null if lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN for a vector of zeros."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / norm)


def negative_cosine(pairs: list[tuple[Column, Column]]) -> Column:
    """Minus the mean cosine distance of several layers; ``NO_SIMILARITY`` if it isn't a number."""
    mean = sum(cosine_distance(a, b) for a, b in pairs) / len(pairs)
    return F.when(F.isnan(mean) | mean.isNull(), NO_SIMILARITY).otherwise(-mean)


def sliding_correlation(text: DataFrame, phrase: DataFrame, key: str = "key") -> DataFrame:
    """``(key, shift, score)``: at each shift where the phrase fits the sum of dot products with the text's tokens.

    Tokens of a text meet those of its phrase by the key and are added up by their distance; the phrase is short, so partial sums are made before the exchange.
    """
    n = phrase.groupBy(key).agg(F.count("*").alias("m"))
    sizes = text.groupBy(key).agg(F.count("*").alias("n")).join(n, key)
    left, right = text.select(key, F.col("i").alias("p"), F.col("embedding").alias("a")), phrase.select(key, F.col("i").alias("q"), F.col("embedding").alias("b"))
    pairs = left.join(right, key).where("p >= q").select(key, (F.col("p") - F.col("q")).alias("shift"), dot(F.col("a"), F.col("b")).alias("d"))
    return pairs.groupBy(key, "shift").agg(F.sum("d").alias("score")).join(sizes, key).where("shift <= n - m").select(key, "shift", "score")


def flipped(tokens: DataFrame, key: str = "key") -> DataFrame:
    """Tokens counted from the end."""
    return tokens.withColumn("i", F.max("i").over(Window.partitionBy(key)) - F.col("i"))


def left_border(scores: DataFrame, key: str = "key") -> DataFrame:
    """``(key, border, confidence)``: the shift of the highest correlation, the first of equal ones."""
    best = F.max_by(F.col("shift"), F.struct("score", -F.col("shift")))
    return scores.groupBy(key).agg(best.alias("border"), F.max("score").alias("confidence"))


def nearest_token(text: DataFrame, phrase: DataFrame, key: str = "key") -> DataFrame:
    """``(key, border, confidence)`` of phrases of one token: the text's token of the least cosine distance, the first of equal ones, and that distance."""
    one = phrase.groupBy(key).agg(F.count("*").alias("m"), F.first("embedding").alias("b")).where("m = 1")
    far = text.join(one, key).select(key, "i", cosine_distance(F.col("embedding"), F.col("b")).alias("d"))
    return far.groupBy(key).agg(F.min_by("i", F.struct("d", "i")).alias("border"), F.min("d").alias("confidence"))


def left_borders(text: DataFrame, phrase: DataFrame, key: str = "key") -> DataFrame:
    """``(key, border, confidence)``: by correlation, for phrases of one token by cosine distance."""
    size = Window.partitionBy(key)
    longer = phrase.withColumn("m", F.count("*").over(size)).where("m > 1").drop("m")
    return left_border(sliding_correlation(text, longer, key), key).unionByName(nearest_token(text, phrase, key))


def right_border(text: DataFrame, phrase: DataFrame, key: str = "key") -> DataFrame:
    """``(key, border, confidence)``: the end (exclusive) of the best place, found from the end."""
    size = text.groupBy(key).agg(F.count("*").alias("n"))
    from_end = left_border(sliding_correlation(flipped(text, key), flipped(phrase, key), key), key)
    return from_end.join(size, key).select(key, (F.col("n") - F.col("border")).alias("border"), "confidence")


def label_peaks(text: DataFrame, phrase: DataFrame, label: str, key: str = "key") -> DataFrame:
    """``(key, i, label, score)`` of the tokens that places of near highest correlation cover from both directions.

    Found from the start a place covers its tokens but the last, found from the end its tokens but the first (of phrases of
    one token that one); a token needs both, of the same place or of two. ``score`` is the correlation at the token, 0 where the phrase doesn't fit behind it.
    """
    m = phrase.groupBy(key).agg(F.count("*").alias("m"))
    forth = sliding_correlation(text, phrase, key)
    whole = Window.partitionBy(key)
    peaks = forth.withColumn("peak", F.col("score") >= PEAK * F.max("score").over(whole)).where("peak").join(m, key)
    last = F.greatest(F.col("m") - 2, F.lit(0))
    covers = lambda first: peaks.select(key, F.explode(F.sequence(F.col("shift") + first, F.col("shift") + first + last)).alias("i")).distinct()
    both = covers(F.lit(0)).join(covers(F.when(F.col("m") > 1, 1).otherwise(0)), [key, "i"])
    return both.join(forth.select(key, F.col("shift").alias("i"), "score"), [key, "i"], "left").select(key, "i", F.lit(label).alias("label"), F.coalesce("score", F.lit(0.0)).alias("score"))


def dilated(tokens: DataFrame, mask: str, n: int, key: str = "key") -> DataFrame:
    """The mask carried on over the n - 1 tokens behind."""
    return tokens.withColumn(mask, dilate(F.col(mask), n, Window.partitionBy(key).orderBy("i")))
