"""Annotation algebra over tagged tokens ``(sample_id, i, tok, tag)``: tags to spans and back, CoNLL lines.

Every operator works within a sample: one hash exchange on ``sample_id`` serves all windows and groups of a pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Kinds by importance when spans meet on a token, the most important first (fixed values); a missing kind is last.
IMPORTANCE = ["SUBJECT", "ASPECT", "CONTRAST", "SUBJECT_EXCEPT", "CONTRAST_MARKER", "COMPARISON_MARKER", ""]
OUTSIDE = "O"
#: Header of a CoNLL document (fixed value).
DOCSTART = "-DOCSTART- -X- -X- O"


def _up_to(offset: int) -> WindowSpec:
    """A sample's rows from the first to the row that is ``offset`` from the current one."""
    return Window.partitionBy("sample_id").orderBy("i").rowsBetween(Window.unboundedPreceding, offset)


def latest_tokens(tokens: DataFrame) -> DataFrame:
    """One row for each (``sample_id``, ``i``): the one that arrived last; of equal times the largest (tok, tag).

    Rows are spread by sample alone: tokens seldom repeat, so nothing is lost before the exchange, and what follows within samples needs no other.
    """
    rank = F.struct(F.coalesce(F.col("arrived_at"), F.lit("0001-01-01").cast("timestamp")), F.col("tok"), F.col("tag"))
    return tokens.repartition("sample_id").groupBy("sample_id", "i").agg(F.max(F.struct(rank.alias("rank"), "tok", "tag")).alias("r")).select("sample_id", "i", "r.tok", "r.tag")


def letter(tag: Column) -> Column:
    return F.left(tag, F.lit(1))


def kind(tag: Column) -> Column:
    """The kind of a tag: what follows its first two characters, ``O`` for the tag O, empty for none."""
    return F.when(tag == OUTSIDE, OUTSIDE).otherwise(F.coalesce(F.substring(tag, 3, 1000), F.lit("")))


def bioul_to_bio(tokens: DataFrame, contrast: str = "CONTRAST", subject: str = "SUBJECT") -> DataFrame:
    """BIOUL tags as BIO, in the column ``bio``. Tags of other kinds, and malformed ones, stay as they are.

    A span is open after U or B of either kind and closed by O or the last token of a contrast; within an open span U, B
    and L become I; else U and B begin one.
    """
    tag, begins = F.col("tag"), [f"{x}-{k}" for x in "UB" for k in (contrast, subject)]
    event = F.when(tag.isin(begins), True).when(tag.isin(OUTSIDE, f"L-{contrast}"), False)
    opened = F.coalesce(F.last(event, ignorenulls=True).over(_up_to(-1)), F.lit(False))
    rest = F.substring(tag, 2, 1000)
    bio = F.when(tag.isin(begins), F.concat(F.when(opened, "I").otherwise("B"), rest)).when(tag.isin(f"L-{contrast}", f"L-{subject}"), F.concat(F.lit("I"), rest)).otherwise(tag)
    return tokens.withColumn("bio", bio)


def parts(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """``part_no`` (from 1): a part begins at each B; tokens before the first B are left out."""
    begun = F.sum(F.when(letter(F.col(tag)) == "B", 1).otherwise(0)).over(_up_to(0))
    return tokens.withColumn("part_no", begun.cast("int")).where("part_no > 0")


def spans(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """``(sample_id, part_no, kind, span_start, span_end, n_tokens, text)`` of each part and kind; the end is exclusive, tokens between belong to other kinds."""
    rows = parts(tokens, tag).withColumn("kind", kind(F.col(tag))).where(~F.col("kind").isin(OUTSIDE, ""))
    words = F.array_sort(F.collect_list(F.struct("i", "tok")))
    return rows.groupBy("sample_id", "part_no", "kind").agg(
        F.min("i").alias("span_start"), (F.max("i") + 1).alias("span_end"), F.count("*").alias("n_tokens"), F.array_join(F.transform(words, lambda w: w["tok"]), " ").alias("text"),
    )


def structured_spans(found: DataFrame) -> DataFrame:
    """``(sample_id, parts)``: per sample its parts as arrays of spans."""
    span = F.struct("kind", "span_start", "span_end", "text")
    nested = found.groupBy("sample_id", "part_no").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return nested.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "spans"))), lambda p: p["spans"]).alias("parts"))


def by_kind(found: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates over all parts, by sample and kind."""
    return found.groupBy("sample_id", "kind").agg(*aggregates)


def by_part(found: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates over all kinds, by sample and part."""
    return found.groupBy("sample_id", "part_no").agg(*aggregates)


def trim_outside(tokens: DataFrame) -> DataFrame:
    """Tokens without the O's at either end; samples that are all O stay whole."""
    whole = Window.partitionBy("sample_id")
    inside = F.when(F.coalesce(F.col("tag"), F.lit("")) != OUTSIDE, F.col("i"))
    first, last = F.min(inside).over(whole), F.max(inside).over(whole)
    return tokens.withColumns({"first_in": first, "last_in": last}).where("first_in is null or i between first_in and last_in").drop("first_in", "last_in")


def distinct_annotations(tokens: DataFrame) -> DataFrame:
    """``(sample_id, actual_text)`` of each different annotation without its outer O's; of equal ones the smallest ``sample_id``."""
    words = F.array_sort(F.collect_list(F.struct("i", "tok")))
    texts = trim_outside(tokens).groupBy("sample_id").agg(F.array_join(F.transform(words, lambda w: w["tok"]), " ").alias("actual_text"))
    return texts.groupBy("actual_text").agg(F.min("sample_id").alias("sample_id")).select("sample_id", "actual_text")


def distinct_samples(tokens: DataFrame) -> DataFrame:
    """The whole tokens, outer O's included, of the samples that ``distinct_annotations`` keeps."""
    return tokens.join(distinct_annotations(tokens).select("sample_id"), "sample_id", "left_semi")


def exactly_two_begins(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """``(sample_id, n_b, ok)``: the B's of each sample and whether it may be exported."""
    n = F.count_if(letter(F.col(tag)) == "B")
    return tokens.groupBy("sample_id").agg(n.alias("n_b"), (n == 2).alias("ok"))


def conll_lines(tokens: DataFrame, pos: Column, tag: str = "tag") -> DataFrame:
    """``(sample_id, i, line)``: token, part of speech, tagged part of speech and tag, two blanks between, of samples with exactly two B's.

    A missing part of speech is UKN; rows whose part of speech is SP, and rows that make no line of four fields, are left out.
    """
    named = F.when(F.coalesce(pos, F.lit("")) == "", "UKN").otherwise(pos)
    t = F.col(tag)
    line = F.concat_ws("  ", "tok", named, F.when(letter(t) == OUTSIDE, OUTSIDE).otherwise(F.concat(letter(t), F.lit("-"), named)), t)
    rows = tokens.withColumn("n_b", F.count_if(letter(t) == "B").over(Window.partitionBy("sample_id"))).where("n_b = 2")
    rows = rows.where((named != "SP") & letter(t).isin("B", "I", "O")).select("sample_id", "i", line.alias("line"))
    return rows.where(F.col("line").rlike(r"^[^\s]+  [^\s]+  [^\s]+  [^\s]+"))


def conll_documents(lines: DataFrame, samples: int = 500) -> DataFrame:
    """``(filename, content)``: lines ``(sample_id, i, line)`` as CoNLL documents of about so many samples each, by the samples' hashes."""
    whole = lines.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("sample"))
    parts = -(-lines.select("sample_id").distinct().count() // samples) or 1
    files = whole.groupBy(F.pmod(F.xxhash64("sample_id"), F.lit(parts)).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("sample")), "\n\n").alias("samples"))
    return files.select(F.concat(F.lit("part_"), "part", F.lit(".conll3")).alias("filename"), F.concat(F.lit(DOCSTART + "\n\n"), "samples", F.lit("\n")).alias("content"))


def read_conll(files: DataFrame, strict: bool = False) -> DataFrame:
    """``(path, sample_no, i, tok, pos, pos_tag, tag)`` of whole files ``(path, value)``: samples are parted by empty lines, fields by two blanks.

    Empty samples and lone headers are left out; rows without four fields are an error if ``strict``, else left out.
    """
    samples = files.select("path", F.posexplode(F.split("value", "\n\n")).alias("sample_no", "sample"))
    samples = samples.where((F.trim(F.replace("sample", F.lit("\n"), F.lit(""))) != "") & (F.col("sample") != DOCSTART)).withColumn("sample", F.replace("sample", F.lit(DOCSTART), F.lit("")))
    lines = F.filter(F.transform(F.split("sample", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = samples.select("path", "sample_no", F.posexplode(lines).alias("i", "line")).withColumn("f", F.split("line", "  "))
    good = F.size("f") == 4
    if strict:
        rows = rows.withColumn("f", F.when(good, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not four fields: "), "line")).cast("array<string>")))
    return rows.where(good).select("path", "sample_no", "i", *[F.col("f")[n].alias(c) for n, c in enumerate(("tok", "pos", "pos_tag", "tag"))])


def islands(numbers: DataFrame, key: str, n: str) -> DataFrame:
    """``(key, r_start, r_end)``: runs of whole numbers without gap, the end exclusive."""
    d = numbers.select(key, n).where(F.col(n).isNotNull()).distinct()
    run = F.col(n) - F.row_number().over(Window.partitionBy(key).orderBy(n))
    return d.withColumn("run", run).groupBy(key, "run").agg(F.min(n).alias("r_start"), (F.max(n) + 1).alias("r_end")).drop("run")


def able_spans(editable: DataFrame) -> DataFrame:
    """The spans that are able and not empty, each once."""
    return editable.where("able and span_start < span_end").select("sample_id", "span_start", "span_end", F.coalesce("kind", F.lit("")).alias("kind")).distinct()


def pair_spans(editable: DataFrame) -> DataFrame:
    """``(sample_id, r_start, r_end, span_start, span_end, kind)``: the able spans within each run of covered positions.

    Covered runs are found from the spans' ends (no position is spelled out): a span opens a run if it begins after all earlier
    ends. As a run is the union of its spans, the containment join is a window.
    """
    able = able_spans(editable)
    earlier = Window.partitionBy("sample_id").orderBy("span_start", "span_end", "kind")
    reach = F.max("span_end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    marked = able.withColumn("run", F.sum(F.when(reach.isNull() | (F.col("span_start") > reach), 1).otherwise(0)).over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("sample_id", "run")
    return marked.select("sample_id", F.min("span_start").over(run).alias("r_start"), F.max("span_end").over(run).alias("r_end"), "span_start", "span_end", "kind")


def contained_in(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Spans within ranges ``(sample_id, r_start, r_end)`` of the same sample: an equi-join with a range condition."""
    return inner.join(outer, "sample_id").where("span_start >= r_start and span_end <= r_end")


def tags_from_spans(tokens: DataFrame, editable: DataFrame) -> DataFrame:
    """``(sample_id, i, tok, tag)``: each token's tag by the most important able span on it, O without any.

    A span's first token is B only where its group begins; unknown kinds are less important than known ones, O least.
    """
    grouped = pair_spans(editable)
    marked = grouped.select("sample_id", "r_start", "kind", F.explode(F.sequence("span_start", F.col("span_end") - 1)).alias("i"))
    rank = F.array_position(F.array(*map(F.lit, IMPORTANCE)), F.col("kind"))
    rank = F.when(rank == 0, 99).otherwise(rank)
    tag = F.concat(F.when(F.col("i") == F.col("r_start"), "B-").otherwise("I-"), "kind")
    best = marked.groupBy("sample_id", "i").agg(F.min(F.struct(rank.alias("rank"), tag.alias("tag"))).alias("best"))
    return tokens.select("sample_id", "i", "tok").join(best, ["sample_id", "i"], "left").select("sample_id", "i", "tok", F.coalesce("best.tag", F.lit(OUTSIDE)).alias("tag"))
