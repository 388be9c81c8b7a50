"""Where in a document a selection lies, and what of its text it holds.

Everything is keyed by document and shuffled by it; only what a selection touches is kept.
Positions in a page are fractions of its height, from the top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .titles import short_form

# The least extent of a part of a selection, the greatest share of a page's
# height that it may have, tolerances for line rows and paragraph marks, and between runs of a line.
LEAST_EXTENT, MOST_HEIGHT = 0.5, 0.25
LINE_REACH, MARK_REACH, BAND = 0.004, 0.006, 4


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that a join deals out by its keys. Lines and boxes are often made by `explode`, whose
    rows Spark doesn't count when it takes a side for small enough to be broadcast."""
    return rows.hint("merge")


def selection_bands(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, top, bottom: what a selection covers of each page. `parts` has (doc_id,
    x, y, width, height), `pages` (doc_id, page, left, top, right, bottom), in one frame of
    reference. A part lies on the first page that holds its middle."""
    p = parts.where((F.col("width") > LEAST_EXTENT) & (F.col("height") > LEAST_EXTENT)).withColumn("part", F.struct("x", "y", "width", "height"))
    box = pages.select(F.col("doc_id").alias("of"), "page", *[F.col(c).alias(f"p_{c}") for c in ("left", "top", "right", "bottom")])
    middle_x, middle_y = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = middle_x.between(F.col("p_left"), F.col("p_right")) & middle_y.between(F.col("p_top"), F.col("p_bottom"))
    hit = p.select("doc_id", "part", "x", "y", "width", "height").distinct().join(dealt(box), (F.col("doc_id") == F.col("of")) & inside)
    hit = hit.groupBy("doc_id", "part").agg(F.min(F.struct("page", "p_top", "p_bottom")).alias("on")).select("doc_id", "part.*", "on.*")
    tall = F.col("p_bottom") - F.col("p_top")
    hit = hit.where((tall > 0) & (F.col("height") <= tall * MOST_HEIGHT))
    return hit.groupBy("doc_id", "page").agg(F.min((F.col("y") - F.col("p_top")) / tall).alias("top"), F.max((F.col("y") + F.col("height") - F.col("p_top")) / tall).alias("bottom"))


def range_of(first: Column, last: Column) -> Column:
    return F.when(first == last, first).otherwise(F.concat(first, F.lit("-"), last))


def line_places(bands: DataFrame, lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, kind, place: `p. 3:5-9`, by printed pages (page + offset of `offsets`, if any)
    and the numbers of the line rows (doc_id, page, num, y0, y1) that a band touches."""
    row = lines.select(F.col("doc_id").alias("of"), F.col("page").alias("on"), "num", "y0", "y1")
    near = (F.col("doc_id") == F.col("of")) & (F.col("page") == F.col("on")) & (F.col("y1") >= F.col("top") - LINE_REACH) & (F.col("y0") <= F.col("bottom") + LINE_REACH)
    per = bands.join(dealt(row), near, "left").groupBy("doc_id", "page").agg(F.min("num").alias("low"), F.max("num").alias("high"))
    per = per.join(dealt(offsets.select("doc_id", "offset")), "doc_id", "left").withColumn("printed", (F.col("page") + F.coalesce("offset", F.lit(0))).cast("string"))
    ends = per.groupBy("doc_id").agg(F.min(F.struct("page", "printed", "low", "high")).alias("a"), F.max(F.struct("page", "printed", "low", "high")).alias("z"), F.count("low").alias("numbered"))
    a, z = F.col("a.printed"), F.col("z.printed")
    first = F.concat_ws(":", a, F.col("a.low").cast("string"))
    last = F.concat_ws(":", z, F.col("z.high").cast("string"))
    lines_of = F.concat(F.lit("p. "), a, F.lit(":"), range_of(F.col("a.low").cast("string"), F.col("a.high").cast("string")))
    pages_of = F.concat(F.when(a == z, "p. ").otherwise("pp. "), range_of(a, z))
    by_line = (F.col("numbered") > 0) & ((a != z) | F.col("a.low").isNotNull())
    place = F.when(~by_line, pages_of).when(a == z, lines_of).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last))
    return ends.select("doc_id", F.when(by_line, "line").otherwise("page").alias("kind"), place.alias("place"))


def paragraph_places(bands: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, kind, place: `¶¶ 3-5`, for documents with three numbered paragraphs or more.
    `marks` has (doc_id, page, y, num, seq); the last mark at or above a position counts."""
    ends = bands.groupBy("doc_id").agg(F.min(F.struct("page", "top")).alias("a"), F.max(F.struct("page", "bottom")).alias("z"))
    rows = marks.join(dealt(ends), "doc_id")

    def above(page: str, y: str) -> Column:
        return (F.col("page") < F.col(page)) | ((F.col("page") == F.col(page)) & (F.col("y") <= F.col(y) + MARK_REACH))

    each = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("num", "seq").alias("first"),
        F.max_by("num", F.when(above("a.page", "a.top"), F.col("seq"))).alias("start"),
        F.max_by("num", F.when(above("z.page", "z.bottom"), F.col("seq"))).alias("stop"),
    )
    start = F.coalesce("start", "first")
    stop = F.greatest(F.coalesce("stop", start), start)
    place = F.concat(F.when(start == stop, "¶ ").otherwise("¶¶ "), range_of(start.cast("string"), stop.cast("string")))
    return each.where("n >= 3").select("doc_id", F.lit("para").alias("kind"), place.alias("place"))


def places(bands: DataFrame, lines: DataFrame, marks: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, kind, place: paragraphs where a document numbers them, else pages and lines."""
    para = paragraph_places(bands, marks)
    other = line_places(bands, lines, offsets).join(dealt(para.select("doc_id")), "doc_id", "left_anti")
    return para.unionByName(other)


def reference(name: Column, kind: Column, place: Column) -> Column:
    """`(Doe Decl. ¶ 4.)`, `(Mot. at p. 3:5-9.)`"""
    return F.concat(F.lit("("), short_form(name), F.when(kind == "para", " ").otherwise(" at "), place, F.lit(".)"))


def selected_text(glyphs: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, text: the glyphs whose middle lies in the document's box, in reading order.
    `glyphs` has (doc_id, span, place, said, x, y, width, height) and the place (span_x,
    span_y) of its span. Runs whose spans are within `BAND` of the one before in height share
    a line: lines are joined by line ends, runs by spaces."""
    box = boxes.select(F.col("doc_id").alias("of"), "left", "top", "right", "bottom")
    middle_x, middle_y = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = (F.col("width") > 0) & (F.col("height") > 0) & middle_x.between(F.col("left"), F.col("right")) & middle_y.between(F.col("top"), F.col("bottom"))
    rows = glyphs.join(dealt(box), (F.col("doc_id") == F.col("of")) & inside)
    by_span = Window.partitionBy("doc_id", "span").orderBy("place")
    rows = rows.withColumn("new", F.coalesce((F.col("place") - F.lag("place").over(by_span) > 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(by_span))
    runs = rows.groupBy("doc_id", "span", "run").agg(F.min("span_y").alias("y"), F.min("span_x").alias("x"), F.sort_array(F.collect_list(F.struct("place", "said"))).alias("all"))
    down = Window.partitionBy("doc_id").orderBy("y", "x", "span", "run")
    runs = runs.withColumn("new", F.coalesce((F.col("y") - F.lag("y").over(down) > BAND).cast("int"), F.lit(0)))
    runs = runs.withColumn("line", F.sum("new").over(down))
    said = F.array_join("all.said", "").alias("said")
    lines = runs.groupBy("doc_id", "line").agg(F.sort_array(F.collect_list(F.struct("x", "span", "run", said))).alias("runs"))
    text = F.btrim(F.regexp_replace(F.array_join("runs.said", " "), "[ \t]+", " "))
    whole = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", text.alias("text")))).alias("lines"))
    return whole.select("doc_id", F.btrim(F.array_join("lines.text", "\n"), F.lit(" \n")).alias("text"))
