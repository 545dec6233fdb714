"""Layout recovery: boxes of a rendered page to columns, body, reading order and text.

Boxes are ``(doc_id, box_index, page_number, text, tag_attributes, x, y, ...)``, style rules ``(doc_id, ident, prop, val)``.
All windows are on (``doc_id``, ``page_number``) or coarser by ``doc_id``, so they share exchanges; a page is the unit that must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quirelight.operators.sequences import mode_first, threshold_fill

#: Page size of the reader, and cells of the density grid along an axis.
WIDTH, HEIGHT, GRID = 700.0, 2**0.5 * 700.0, 100
#: Class prefixes in the order in which sorting puts them, and the property each one's rule gives.
PREFIXES = ("ff", "fs", "h", "x", "y")
PROPERTIES = ("line-height", "font-size", "height", "left", "bottom")
#: Distances below this, in page units, count as the same line; share of the median that a body line's distance may be off.
SAME_LINE, SPREAD, LEFT_MARGIN = 0.3, 0.1, 0.05


def _page() -> WindowSpec:
    return Window.partitionBy("doc_id", "page_number")


def attribute_names(classes: Column) -> Column:
    """The classes that name geometry, sorted."""
    wanted = lambda c: c.startswith("x") | c.startswith("y") | c.startswith("h") | c.startswith("ff") | c.startswith("fs")
    return F.array_sort(F.filter(classes, wanted))


def distinct_boxes(boxes: DataFrame) -> DataFrame:
    """One row for each (``doc_id``, ``box_index``): the one with the most known of text and x, then the largest. Spread by document, as all that follows."""
    rank = F.struct((F.col("text").isNotNull().cast("int") + F.col("x").isNotNull().cast("int")).alias("known"), "page_number", "text", "x", "y", "tag_attributes", "line_height", "font_size", "height")
    best = boxes.repartition("doc_id").groupBy("doc_id", "box_index").agg(F.max(rank).alias("b"))
    return best.select("doc_id", "box_index", *[f"b.{c}" for c in ("page_number", "text", "tag_attributes", "line_height", "font_size", "height", "x", "y")])


def rules(css: DataFrame) -> DataFrame:
    """One value for each rule: the largest of repeated ones; null values are none."""
    return css.where("val is not null").groupBy("doc_id", "ident", "prop").agg(F.max("val").alias("val"))


def css_lookup(boxes: DataFrame, css: DataFrame) -> DataFrame:
    """The five geometry properties of each box by its sorted classes; 0 where class, rule or property is missing."""
    one = rules(css).where(F.col("prop").isin(*PROPERTIES))
    declared = one.groupBy("doc_id", "ident").agg(F.map_from_entries(F.collect_list(F.struct("prop", "val"))).alias("declared"))
    named = boxes.select("doc_id", "box_index", F.posexplode_outer(attribute_names(F.col("tag_attributes"))).alias("k", "ident"))
    found = named.join(declared, ["doc_id", "ident"], "left")
    value = lambda k, p: F.coalesce(F.max(F.when(F.col("k") == k, F.try_element_at("declared", F.lit(p)))), F.lit(0.0))
    return found.groupBy("doc_id", "box_index").agg(*[value(k, p).alias(p.replace("-", "_")) for k, p in enumerate(PROPERTIES)])


def points(boxes: DataFrame) -> DataFrame:
    """Boxes with x and y (null is 0), and these by the page's extent, to which the four page corners count."""
    out = boxes.withColumns({"x": F.coalesce("x", F.lit(0.0)), "y": F.coalesce("y", F.lit(0.0))})
    wide = F.greatest(F.max("x").over(_page()), F.lit(WIDTH)) - F.least(F.min("x").over(_page()), F.lit(0.0))
    high = F.greatest(F.max("y").over(_page()), F.lit(HEIGHT)) - F.least(F.min("y").over(_page()), F.lit(0.0))
    return out.withColumns({"nx": F.col("x") / wide, "ny": F.col("y") / high})


def cell(value: Column) -> Column:
    """The grid cell of a normalised coordinate; values beyond the grid are in its outer cells."""
    return F.greatest(F.least((value * GRID).cast("int"), F.lit(GRID - 1)), F.lit(0))


def grid(placed: DataFrame) -> DataFrame:
    """``(doc_id, page_number, gx, gy, n)``: boxes in each cell that has one."""
    return placed.groupBy("doc_id", "page_number", cell(F.col("nx")).alias("gx"), cell(F.col("ny")).alias("gy")).agg(F.count("*").alias("n"))


def _kernel(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def blur(field: np.ndarray, sigma: float, axes: tuple[int, ...] = (0, 1)) -> np.ndarray:
    """Separable Gaussian filter, the field mirrored at its edges."""
    k = _kernel(sigma)
    r = len(k) // 2
    for axis in axes:
        padded = np.pad(field, [(r, r) if a == axis else (0, 0) for a in (0, 1)], "symmetric")
        field = sum(w * (padded[n : n + field.shape[0]] if axis == 0 else padded[:, n : n + field.shape[1]]) for n, w in enumerate(k))
    return field


def _blur_matrix(sigma: float) -> np.ndarray:
    """The filter along one axis as a matrix, the field mirrored at its edges."""
    return blur(np.eye(GRID), sigma, (0,))


def peak_counts(rows: np.ndarray, distance: int = 15, prominence: float = 1e-6) -> np.ndarray:
    """Of each row the number of peaks (the middle of flat ones): the higher first, of equal ones the later, none within ``distance`` of one taken before, and all of some prominence."""
    n, width = rows.shape
    step = np.sign(np.diff(rows, axis=1)).astype(np.int8)
    # of each place the next step that isn't level
    after = np.minimum.accumulate(np.where(step != 0, np.arange(width - 1), width)[:, ::-1], axis=1)[:, ::-1]
    row, left = np.nonzero(step[:, :-1] > 0)
    end = after[row, left + 1]
    falls = end < width
    falls[falls] = step[row[falls], end[falls]] < 0
    row, at = row[falls], (left[falls] + 1 + end[falls]) // 2
    order = np.lexsort((-at, -rows[row, at], row))
    row, at = row[order], at[order]
    kept = np.zeros(len(row), bool)
    open_ = np.ones(len(row), bool)
    while open_.any():  # a round takes one peak of each row
        place = np.flatnonzero(open_)
        first = place[np.concatenate([[True], row[place[1:]] != row[place[:-1]]])]
        kept[first] = True
        taken = np.full(n, -distance * width)
        taken[row[first]] = at[first]
        open_ &= np.abs(at - taken[row]) >= distance
    row, at = row[kept], at[kept]
    top = rows[row, at]
    base = np.full(len(row), -np.inf)
    for way in (-1, 1):
        low, there = top.copy(), np.ones(len(row), bool)
        for k in range(1, width):
            place = at + way * k
            there &= (place >= 0) & (place < width)
            value = rows[row, np.clip(place, 0, width - 1)]
            there &= value <= top
            if not there.any():
                break
            low = np.where(there, np.minimum(low, value), low)
        base = np.maximum(base, low)
    return np.bincount(row[top - base >= prominence], minlength=n)


def columns_of(fine: np.ndarray) -> np.ndarray:
    """Of each page (an array of fields) the most frequent number of peaks of the rows between a tenth and nine tenths of the height, of equally frequent ones the lowest row's; 1 for an empty page."""
    heights = range(GRID // 10, GRID * 9 // 10)
    counts = peak_counts(fine[:, :, heights].transpose(0, 2, 1).reshape(-1, GRID)).reshape(len(fine), -1)
    most = counts.max(initial=0) + 1
    often = np.stack([(counts == k).sum(axis=1) for k in range(1, most)], axis=1) if most > 1 else np.zeros((len(fine), 0), int)
    out = np.ones(len(fine), int)
    for n in range(len(fine)):
        if often.shape[1] and often[n].max():
            tied = np.flatnonzero(often[n] == often[n].max()) + 1
            out[n] = next(c for c in counts[n] if c in tied)
    return out


def density(placed: DataFrame) -> DataFrame:
    """``(doc_id, page_number, box_index, coarse, fine, page_columns)``: densities at the boxes and the page's columns, many pages at a time."""
    coarse, fine = _blur_matrix(3.0), _blur_matrix(0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                boxes = part.column(2)
                sizes, rows = np.diff(boxes.offsets.to_numpy()), boxes.flatten()
                page = np.repeat(np.arange(part.num_rows), sizes)
                gx, gy = (rows.field(c).to_numpy() for c in ("gx", "gy"))
                dotted = np.zeros((part.num_rows, GRID, GRID))
                dotted[page, gx, gy] = 1
                narrow = np.round(fine @ dotted @ fine.T, 12)  # what is level must not differ by the order of sums
                wide, columns = coarse @ dotted @ coarse.T, columns_of(narrow)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n).take(pa.array(page)) for n in (0, 1)], rows.field("box_index"), pa.array(wide[page, gx, gy]), pa.array(narrow[page, gx, gy]), pa.array(columns[page].astype(np.int32))],
                    ["doc_id", "page_number", "box_index", "coarse", "fine", "page_columns"],
                )

    pages = placed.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("box_index", cell(F.col("nx")).alias("gx"), cell(F.col("ny")).alias("gy"))).alias("boxes"))
    return pages.mapInArrow(run, "doc_id bigint, page_number int, box_index int, coarse double, fine double, page_columns int")


def density_field(placed: DataFrame, sigma: float = 3.0) -> DataFrame:
    """``(doc_id, gx, gy, density)``: the pages' blurred grids summed cell by cell; cells of no density are left out."""
    matrix = _blur_matrix(sigma)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                cells = part.column(1)
                page, rows = np.repeat(np.arange(part.num_rows), np.diff(cells.offsets.to_numpy())), cells.flatten()
                dotted = np.zeros((part.num_rows, GRID, GRID))
                dotted[page, rows.field("gx").to_numpy(), rows.field("gy").to_numpy()] = 1
                field = matrix @ dotted @ matrix.T
                page, gx, gy = np.nonzero(field > 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(page)), pa.array(gx.astype(np.int32)), pa.array(gy.astype(np.int32)), pa.array(field[page, gx, gy])], ["doc_id", "gx", "gy", "density"])

    pages = grid(placed).groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("gx", "gy")).alias("cells")).select("doc_id", "cells")
    return pages.mapInArrow(run, "doc_id bigint, gx int, gy int, density double").groupBy("doc_id", "gx", "gy").agg(F.sum("density").alias("density"))


def document_columns(measured: DataFrame) -> DataFrame:
    """``(doc_id, columns)``: the most frequent number of columns of a document's pages, of equally frequent ones the earliest page's."""
    pages = measured.select("doc_id", "page_number", "page_columns").distinct()
    return mode_first(pages, ["doc_id"], "page_columns", "page_number").select("doc_id", F.col("page_columns").alias("columns"))


def column_labels(placed: DataFrame, columns: Column) -> DataFrame:
    """``column_label`` of each box, by its distance from the page's left border."""
    left = F.min(F.when(F.col("nx") > LEFT_MARGIN, F.col("nx"))).over(_page())
    border = F.coalesce(left, F.lit(LEFT_MARGIN))
    label = ((F.col("nx") - border + 0.9) / F.nullif(1 - 2 * border, F.lit(0.0)) * columns).cast("int")
    return placed.withColumn("column_label", F.coalesce(label, F.lit(0)))


def line_distances(labelled: DataFrame) -> DataFrame:
    """``before`` and ``behind``: distances to the neighbours down the columns of a page, in its units; beyond the first and the last line are
    the page's edges. Those of lines of the same height are taken from the line before them."""
    down = _page().orderBy("column_label", F.desc("y"), "box_index")
    up = _page().orderBy(F.desc("column_label"), "y", F.desc("box_index"))
    y, top, bottom = F.col("y"), F.greatest(F.max("y").over(_page()), F.lit(HEIGHT)), F.least(F.min("y").over(_page()), F.lit(0.0))
    out = labelled.withColumns({"d_before": F.abs(y - F.coalesce(F.lag(y).over(down), top)), "d_behind": F.abs(F.coalesce(F.lead(y).over(down), bottom) - y)})
    return out.withColumns({"before": threshold_fill(F.col("d_before"), SAME_LINE, up), "behind": threshold_fill(F.col("d_behind"), SAME_LINE, down)})


def body_mask(spaced: DataFrame) -> DataFrame:
    """``in_body``: whether a distance to a neighbour is within a tenth of the page's median distance; on pages whose median is 0 none is."""
    middle = spaced.select("doc_id", "page_number", F.explode(F.array("before", "behind")).alias("d")).groupBy("doc_id", "page_number").agg(F.median("d").alias("middle"))
    near = lambda c: (F.col(c) > F.col("middle") * (1 - SPREAD)) & (F.col(c) < F.col("middle") * (1 + SPREAD))
    return spaced.join(middle, ["doc_id", "page_number"]).withColumn("in_body", near("before") | near("behind"))


def reading_order(labelled: DataFrame) -> DataFrame:
    """``reading_sequence`` (from 0): pages, in them columns by their mean x, in them boxes from top to bottom."""
    mean_x = F.avg("x").over(Window.partitionBy("doc_id", "page_number", "column_label"))
    order = Window.partitionBy("doc_id").orderBy("page_number", "mean_x", "column_label", F.desc("y"), "box_index")
    return labelled.withColumn("mean_x", mean_x).withColumn("reading_sequence", F.row_number().over(order) - 1)


def column_text(ordered: DataFrame) -> DataFrame:
    """``(doc_id, page_number, column_no, column_text)``: each column's texts in reading order; columns count from 0 on each page."""
    texts = F.array_sort(F.collect_list(F.struct("reading_sequence", F.coalesce("text", F.lit("")).alias("text"))))
    columns = ordered.groupBy("doc_id", "page_number", "column_label").agg(F.min("reading_sequence").alias("first"), F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("column_text"))
    number = F.row_number().over(_page().orderBy("first")) - 1
    return columns.select("doc_id", "page_number", number.alias("column_no"), "column_text")


def pages_to_columns(texts: DataFrame) -> DataFrame:
    """``(doc_id, pages)``: page to column to text."""
    pages = texts.groupBy("doc_id", "page_number").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column_no", "column_text")))).alias("columns"))
    return pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_number", "columns"))).alias("pages"))


def layout_score(texts: DataFrame, columns: DataFrame, expected: int, own_label_counts: bool = False) -> DataFrame:
    """``(doc_id, score)`` of test documents with ``columns`` found: for each page 10 points if the found columns are the expected ones and 10
    if the page has as many, and points for columns that hold the test's words, and their own number and no other.

    ``own_label_counts``: the other numbers are all but the next one, as the scoring was once written, instead of all but the column's own.
    """
    count = lambda j: (F.length("column_text") - F.length(F.replace("column_text", j.cast("string"), F.lit("")))) / F.length(j.cast("string"))
    counted = texts.withColumn("n_columns", F.count("*").over(_page()))
    own, skipped = F.col("column_no") + 1, F.col("column_no") + (2 if own_label_counts else 1)
    others = F.aggregate(F.filter(F.sequence(F.lit(1), F.col("n_columns").cast("int")), lambda j: j != skipped), F.lit(0.0), lambda a, j: a + count(j))
    points_of = F.when(F.contains("column_text", F.lit("text")) & F.contains("column_text", F.lit("column")), 1.0).otherwise(0.0) + F.when(count(own) > 0, 3 * count(own) - 3 * (1 + others)).otherwise(0.0)
    page = counted.groupBy("doc_id", "page_number").agg(F.sum(points_of).alias("s"), F.max("n_columns").alias("n"))
    ten = lambda c: F.when(c, 10.0).otherwise(0.0)
    page = page.join(columns.select("doc_id", "columns"), "doc_id")
    return page.groupBy("doc_id").agg(F.sum(F.col("s") + ten(F.col("columns") == expected) + ten(F.col("n") == F.col("columns"))).alias("score"))


def evaluation_range(number: Column, sigma: float = 0.5, resolution: float = 0.2) -> Column:
    """Values from ``number * (1 - sigma)`` in steps of a share of the whole width, up to below ``number * (1 + sigma)``; empty for 0."""
    steps = int(np.ceil(1 / resolution - 1e-9))
    return F.when(number != 0, F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: number * (1 - sigma) + k * (number * 2 * sigma * resolution))).otherwise(F.array().cast("array<double>"))


def debug_colour(label: Column) -> Column:
    return F.abs(label + 2) / 5


def missing_attributes(results: DataFrame, names: list[str]) -> DataFrame:
    """``missing``: the named columns that are null, zero or empty in a row."""
    empty = [F.when(F.coalesce(F.col(n).cast("string"), F.lit("")).isin("", "0", "0.0", "-0.0", "[]", "{}"), F.lit(n)) for n in names]
    return results.withColumn("missing", F.array_compact(F.array(*empty)))


def recover(boxes: DataFrame) -> DataFrame:
    """The whole way: body boxes of each document in reading order, with ``columns``, ``column_label`` and ``reading_sequence``."""
    placed = points(distinct_boxes(boxes))
    labelled = column_labels(placed.join(document_columns(density(placed)), "doc_id"), F.col("columns"))
    return reading_order(body_mask(line_distances(labelled)).where("in_body"))
