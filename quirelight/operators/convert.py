"""Whole conversions: rendered or plain HTML to indexed words, by the operators of layout and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.exceptions import EmptyPageConversionError
from quirelight.functions import html
from quirelight.operators import layout, words

#: Markup that makes the indexed words of a page visible (fixed value).
COVERAGE = "<style>z { background: rgba(255, 200, 0, .4) }</style>"


def set_geometry(boxes: DataFrame, css: DataFrame) -> DataFrame:
    """Boxes with the five properties of their style rules; the distance from the left is x, that from the bottom y."""
    found = layout.css_lookup(boxes, css).withColumnsRenamed({"left": "x", "bottom": "y"})
    return boxes.drop("line_height", "font_size", "height", "x", "y").join(found, ["doc_id", "box_index"])


def header_id(classes: Column, place: int = 4) -> Column:
    """The class that names a division's place in the page's headers, by its place; null where there are fewer."""
    return F.try_element_at(classes, F.lit(place))


def zip_tags(tokens: Column, tags: Column) -> Column:
    """Tokens with their tags by position, as far as both go."""
    n = F.least(F.size(tokens), F.size(tags))
    return F.transform(F.arrays_zip(F.slice(tokens, 1, n).alias("tok"), F.slice(tags, 1, n).alias("tag")), lambda p: F.struct(p["tok"].alias("tok"), p["tag"].alias("tag")))


def real_words(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Words that a list knows; without a list all of them."""
    return found if known is None else found.join(known.select(F.lower("word").alias("w")).distinct(), F.lower(found["word"]) == F.col("w"), "left_semi")


def covered(markup: Column) -> Column:
    """Markup with the style that shows which words were indexed, at the end of its head; at its start without a head."""
    return F.when(F.contains(markup, F.lit("</head>")), F.replace(markup, F.lit("</head>"), F.lit(COVERAGE + "</head>"))).otherwise(F.concat(F.lit(COVERAGE), markup))


def positioned(pages: DataFrame) -> DataFrame:
    """``(doc_id, word_index, box, content_index, word)`` of rendered documents ``(doc_id, html)``: boxes placed by their style rules, body found, columns read in order."""
    return words.index_words(layout.recover(set_geometry(_bare(pages), html.style_rules(pages))))


def _bare(pages: DataFrame) -> DataFrame:
    none = {c: F.lit(None).cast("double") for c in ("line_height", "font_size", "height", "x", "y")}
    return html.boxes(pages).withColumns(none)


def rejects(pages: DataFrame, rendered: bool, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pages ``(doc_id, html)`` that have something to convert, and ``(doc_id, reason)`` of the others; with ``strict`` these are an error."""
    found = (html.boxes(pages) if rendered else html.content(pages, "doc_id")).select("doc_id").distinct()
    empty = pages.join(found, "doc_id", "left_anti").select("doc_id", F.lit("empty page").alias("reason"))
    if strict and (first := empty.first()):
        raise EmptyPageConversionError(f"document {first[0]} has nothing to convert")
    return pages.join(found, "doc_id", "left_semi"), empty


def plain_html(pages: DataFrame) -> DataFrame:
    """``(doc_id, word_index, box, content_index, word)`` of plain pages ``(doc_id, html)``, in the order of the document."""
    return words.index_words(html.content(pages, "doc_id"), order="seq")


def documents_json(pages: DataFrame, rendered: bool) -> DataFrame:
    """``(doc_id, json)`` of rendered or plain pages."""
    return words.document_json(positioned(pages) if rendered else plain_html(pages))
