"""Positioned words to raw rows, page by page: rows, period heading, columns, wrapped labels, headings.

All work is by (doc_id, page), so pages spread over the cluster; but for the rows' tops and the headings above them it is windows and
higher-order functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions import text as fn
from tieout.session import bounded_batches

PAGE = ["doc_id", "page"]
# Fixed values, in points: distance within which words are of one row, the band of the page number, how far left of the first
# column values begin, and how far left of an item its heading stands.
ROW_TOLERANCE = 5.0
FOOTER_BAND = 45.0
COLUMN_MARGIN = 45.0
HEADING_INDENT = 1.0
LEAST_PERIODS = 4
# End of fixed values.


def body_words(words: DataFrame) -> DataFrame:
    """SRC2: without the page number."""
    return words.where(F.col("top") < F.col("page_height") - FOOTER_BAND)


Bands = dict[int, list[tuple[int, float]]]


def buckets(tops: list[float], tolerance: float, bands: Bands | None = None) -> list[float]:
    """For each word in order of appearance, the top of the first row within tolerance, which may be its own.

    Rows within tolerance lie in a word's band of that height or in one beside it. bands holds the rows of the words before, by number, and
    takes those found here.
    """
    bands = {} if bands is None else bands
    rows = sum(map(len, bands.values()))
    found = []
    for top in tops:
        band = int(top // tolerance)
        near = [(n, t) for b in range(band - 1, band + 2) for n, t in bands.get(b, ()) if abs(t - top) <= tolerance]
        if not near:
            bands.setdefault(band, []).append((rows, top))
            rows += 1
        found.append(min(near)[1] if near else top)
    return found


def _bucket_batches(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[pa.RecordBatch]:
    """Words come page by page, in order of appearance; the rows of a page go on from batch to batch."""
    at, bands = None, {}
    for batch in batches:
        found = []
        words = zip(*[batch.column(c).to_pylist() for c in (*PAGE, "top")])
        for page, own in groupby(words, itemgetter(slice(len(PAGE)))):
            if page != at:
                at, bands = page, {}
            found += buckets([top for *_, top in own], tolerance, bands)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "bucket"])


def cluster(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """LAY1: words with bucket, the top of the first row within tolerance in order of appearance. A page's words are told their rows as
    they pass by in order, in one task; only the rows found so far are kept."""
    order = ["word_seq", *[c for c in words.columns if c not in (*PAGE, "word_seq")]]
    inorder = bounded_batches(words).repartition(*PAGE).sortWithinPartitions(*PAGE, *order)
    types = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in words.schema], "bucket double"])
    return inorder.mapInArrow(partial(_bucket_batches, tolerance=tolerance), types)


def page_rows(clustered: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row_no, words, line), words from left to right."""
    rows = clustered.groupBy(*PAGE, "bucket").agg(F.array_sort(F.collect_list(F.struct("x0", "word_seq", "text", "x1"))).alias("words"))
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("bucket"))).withColumn("line", _joined("words")).drop("bucket")


def _joined(words: str | Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def headed(rows: DataFrame, issuer: str) -> DataFrame:
    """LAY2, LAY3: rows of pages that have a heading, with header_no, periods, anchors and section_title.

    The heading is the first row of at least four adjacent quarter and year pairs; anchors are the right edges of the
    years; the title is what stands above, without the issuer's own lines. All are windows over the page.
    """
    pair = lambda i: F.struct(
        F.get("words", i)["text"].alias("quarter"), F.get("words", i + 1)["text"].alias("year"), F.get("words", i + 1)["x1"].alias("anchor")
    )
    pairs = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("words") - 1), pair),
        lambda p: F.coalesce(fn.is_quarter(p["quarter"]) & fn.is_year(p["year"]), F.lit(False)),
    )
    page = Window.partitionBy(*PAGE)
    first = F.min(F.when(F.size("_pairs") >= LEAST_PERIODS, F.struct("row_no", "_pairs"))).over(page)
    found = rows.withColumn("_pairs", pairs).withColumn("_h", first).where("_h is not null")
    shown = F.trim("line")
    above = F.when((F.col("row_no") < F.col("_h.row_no")) & (shown != "") & ~shown.startswith(issuer), F.struct("row_no", shown.alias("shown")))
    titled = found.withColumn("_above", F.array_sort(F.collect_list(above).over(page)))
    title = F.array_join(F.transform("_above", lambda x: x["shown"]), " | ")
    return titled.select(
        *rows.columns,
        F.col("_h.row_no").alias("header_no"),
        F.transform("_h._pairs", lambda p: F.concat_ws(" ", p["quarter"], p["year"])).alias("periods"),
        F.transform("_h._pairs", lambda p: p["anchor"]).alias("anchors"),
        F.when(title == "", "unknown").otherwise(title).alias("section_title"),
    )


def assigned(tokens: Column, anchors: Column) -> Column:
    """LAY7: an amount for each column: by place if there are as many tokens as columns, else by the nearest right edge, where
    the first that is not nil counts."""
    number = lambda w: fn.clean_number(w["text"])

    def nearest(w: Column) -> Column:
        gaps = F.transform(anchors, lambda a: F.abs(a - w["x1"]))
        return F.array_position(gaps, F.array_min(gaps)) - 1

    by_edge = lambda j: F.get(F.filter(F.transform(F.filter(tokens, lambda w: nearest(w) == j), number), lambda v: v.isNotNull()), 0)
    columns = F.sequence(F.lit(0), F.size(anchors) - 1)
    return F.when(F.size(tokens) == F.size(anchors), F.transform(tokens, number)).otherwise(F.transform(columns, by_edge))


def lines(words: DataFrame, issuer: str) -> DataFrame:
    """LAY3-LAY7: rows below the heading with label, left edge and values (null where there are none)."""
    below = headed(page_rows(cluster(body_words(words))), issuer).where("row_no > header_no")
    edge = F.array_min("anchors") - COLUMN_MARGIN
    is_value = lambda w: (w["x1"] > F.col("_edge")) & fn.is_value(w["text"])
    split = (
        below.withColumn("_edge", edge)
        .withColumn("_values", F.filter("words", is_value))
        .withColumn("_labels", F.filter("words", lambda w: ~is_value(w)))
        .withColumn("raw_text", _joined("_labels"))
        .withColumn("label", fn.clean_label(F.col("raw_text")))
        .withColumn("x0", F.get("_labels", 0)["x0"])
        .withColumn("_tokens", F.filter("_values", lambda w: w["text"] != "$"))
    )
    last = lambda j: F.coalesce(F.array_position(F.slice("periods", j + 2, F.size("periods")), F.get("periods", j)), F.lit(0)) == 0
    entry = lambda j: F.struct(F.get("periods", j).alias("k"), F.get("_amounts", j).alias("v"))
    kept = F.filter(F.sequence(F.lit(0), F.size("periods") - 1), last)
    return (
        split.withColumn("_amounts", assigned(F.col("_tokens"), F.col("anchors")))
        .withColumn("values", F.when(F.size("_values") > 0, F.map_from_entries(F.transform(kept, entry))))
        .where(~F.col("label").startswith("_"))
        .select(*PAGE, "row_no", "section_title", "label", "raw_text", "x0", "values", F.col("line").alias("source_line"))
    )


def orphan_values(all_lines: DataFrame) -> DataFrame:
    """LAY6: rows that carry values but no label."""
    return all_lines.where("label = '' and values is not null").select(*PAGE, "row_no", "source_line")


def labelled(all_lines: DataFrame, strict: bool) -> DataFrame:
    """LAY6: lines with a label; in strict mode values without one are an error, raised where the row is read."""
    if not strict:
        return all_lines.where("label <> ''")
    message = F.format_string("page %s of %s: a row carried values but no label: %s", F.col("page").cast("string"), "doc_id", F.substring("source_line", 1, 90))
    lost = (F.col("label") == "") & F.col("values").isNotNull()
    return all_lines.where(F.when(lost, F.raise_error(message).cast("boolean")).otherwise(F.col("label") != ""))


def _path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come page by page, from top to bottom; what stands above goes on from batch to batch."""
    at, above, path = None, [], []
    for batch in batches:
        paths = []
        for *page, role, x0, label in zip(*[batch.column(c).to_pylist() for c in (*PAGE, "role", "x0", "label")]):
            if page != at:
                at, above, path = page, [], []
            if role == "heading":
                while above and (x0 is None or above[-1][0] is None or above[-1][0] >= x0):
                    above.pop()
                above.append((x0, label))
                path = [text for _, text in above]
            paths.append(path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.string()))], [*batch.schema.names, "section_path"])


def roles(known: DataFrame) -> DataFrame:
    """LAY8-LAY10: each labelled line's role (item, tail, heading, prefix), the item it belongs to, and the headings above.

    A page is read once from below, for the next item's edge, and once from above: its headings are kept as they stand over each other, so
    the work grows with its lines.
    """
    upto = Window.partitionBy(*PAGE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy(*PAGE).orderBy(F.desc("row_no")).rowsBetween(Window.unboundedPreceding, -1)
    valued = F.col("values").isNotNull()
    known = known.withColumn("_next", F.last(F.when(valued, F.col("x0")), ignorenulls=True).over(below)).withColumn("_n", F.count(F.when(valued, 1)).over(upto))
    heading = F.rtrim("raw_text").endswith(":") | F.coalesce(F.col("x0") < F.col("_next") - HEADING_INDENT, F.lit(False))
    role = F.when(valued, "item").when(fn.starts_lowercase(F.col("label")) & (F.col("_n") > 0), "tail").when(heading, "heading").otherwise("prefix")
    told = known.withColumn("role", role).withColumn("row_ord", F.when(F.col("role") == "prefix", F.col("_n") + 1).otherwise(F.col("_n")).cast("int")).drop("_n", "_next")
    # the windows have brought each page into one task
    inorder = bounded_batches(told).sortWithinPartitions(*PAGE, "row_no")
    return inorder.mapInArrow(_path_batches, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in told.schema], "section_path array<string>"]))


def trailing_prefixes(told: DataFrame) -> DataFrame:
    """Labels that waited for an item to the end of the page."""
    items = told.where("role = 'item'").select(*PAGE, "row_ord").distinct()
    return told.where("role = 'prefix'").join(items, [*PAGE, "row_ord"], "left_anti").select(*PAGE, "row_no", "label")


def extract(words: DataFrame, issuer: str = "\0", strict: bool = True) -> DataFrame:
    """LAY11: raw rows (see schemas.RAW_ROWS). In strict mode a page with values but no label is an error."""
    told = roles(labelled(lines(words, issuer), strict))
    item = lambda c: F.max(F.when(F.col("role") == "item", F.col(c)))
    parts = F.array_sort(F.collect_list(F.when(F.col("role") != "heading", F.struct("row_no", "label"))))
    made = told.groupBy(*PAGE, "row_ord").agg(
        item("section_title").alias("section_title"),
        F.max_by("section_path", F.when(F.col("role") == "item", F.col("row_no"))).alias("section_path"),
        fn.clean_label(F.array_join(F.transform(parts, lambda p: p["label"]), " ")).alias("raw_label"),
        F.max_by("values", F.when(F.col("role") == "item", F.col("row_no"))).alias("values"),
        item("source_line").alias("source_line"),
        F.count_if(F.col("role") == "item").alias("_items"),
    )
    return made.where("_items > 0").select(*PAGE, "row_ord", "section_title", "section_path", "raw_label", "values", "source_line")


def document_periods(words: DataFrame) -> DataFrame:
    """SRC1: the periods of the first page of a document that has a heading."""
    heads = headed(page_rows(cluster(body_words(words))), "\0").where("row_no = header_no")
    return heads.groupBy("doc_id").agg(F.min_by("periods", "page").alias("periods"))
