"""Page structure: lines from positioned text, footers, captions, numbers in margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.arrays import let
from ..functions.filing_text import could_be_title_line, looks_like_title, normalized_line, trim
from .ordered import gap_groups

# Tolerances and bands, in units or parts of the page.
SAME_LINE, SPACE_FROM, FOOTER, TITLE_GAP = 2, 5, 0.18, 20
COLUMN, COLUMN_REACH, COLUMN_LEAST, COLUMN_SPAN = 0.25, 16, 8, 0.4
CAPTION_META = r"(?i)^(?:case\s+no|hon\b|honorable|dept\b|department|judge\b|hearing\b|trial\b|time\b|date\b|res\.?\s*id|reservation|assigned|electronically|exempt|reserved|action\s+filed|[a-z.]{2,}\s+filed\b)"
CAPTION_JUNK = r"^[\d)(.,\s|:_-]+$"
SPACES = t.java(r"\s+")


def lines(items: DataFrame) -> DataFrame:
    """doc_id, page_no, line_ix, y, text: items on the first line whose first item is within
    SAME_LINE of theirs, left to right. A page is a group; its items are few."""
    said = items.where(trim(F.col("str")) != "")
    pages = said.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("item_ix", "x", "y", "str"))).alias("items"))
    none = F.struct(F.array().cast("array<double>").alias("seeds"), F.array().cast("array<int>").alias("of"))

    def seat(s: Column, i: Column) -> Column:
        def put(near: Column) -> Column:
            of = F.coalesce(near, F.size(s["seeds"]))
            return F.struct(F.when(near.isNull(), F.array_append(s["seeds"], i["y"])).otherwise(s["seeds"]).alias("seeds"), F.array_append(s["of"], of).alias("of"))

        within = F.transform(s["seeds"], lambda seed, k: F.when(F.abs(seed - i["y"]) <= SAME_LINE, k))
        return let(F.array_min(within), put)

    pages = pages.withColumn("seated", F.aggregate("items", none, seat))
    placed = F.zip_with("items", "seated.of", lambda i, k: F.struct(k.alias("line_ix"), i["x"].alias("x"), i["item_ix"].alias("item_ix"), i["str"].alias("str")))
    rows = pages.select("doc_id", "page_no", F.col("seated.seeds").alias("seeds"), F.explode(placed).alias("i")).select("doc_id", "page_no", "i.*", F.get("seeds", F.col("i.line_ix")).alias("y"))
    rows = rows.groupBy("doc_id", "page_no", "line_ix", "y").agg(F.array_sort(F.collect_list(F.struct("x", "item_ix", "str"))).alias("row"))
    start = F.struct(F.lit("").alias("text"), F.lit(float("-inf")).alias("end"))

    def join(s: Column, i: Column) -> Column:
        apart = (s["text"] != "") & (i["x"] - s["end"] > SPACE_FROM) & ~i["str"].rlike(r"^['’,.;:!?)]") & ~s["text"].rlike(r"[(\[]\z")
        return F.struct(F.concat(s["text"], F.when(apart, " ").otherwise(""), i["str"]).alias("text"), (i["x"] + F.length(i["str"]) * 4.0).alias("end"))

    text = F.aggregate("row", start, join, lambda s: trim(F.regexp_replace(s["text"], SPACES, " ")))
    return rows.select("doc_id", "page_no", "line_ix", "y", text.alias("text"))


def footers(page_lines: DataFrame, pages: DataFrame) -> DataFrame:
    return page_lines.join(pages, ["doc_id", "page_no"]).where((F.col("height") > 0) & (F.col("y") < F.col("height") * FOOTER)).select(*page_lines.columns)


def title_groups(page_lines: DataFrame) -> DataFrame:
    """Lines that could be titles, joined where they are at most TITLE_GAP below each other."""
    rows = page_lines.where(could_be_title_line(F.col("text")))
    rows = gap_groups(rows, ["doc_id", "page_no"], [F.desc("y"), "line_ix"], lambda w: F.lag("y").over(w) - F.col("y") > TITLE_GAP, "title_ix")
    every = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "line_ix", "text")))
    joined = rows.groupBy("doc_id", "page_no", "title_ix").agg(F.max("y").alias("y"), every.alias("all"))
    return joined.select("doc_id", "page_no", "title_ix", "y", trim(F.regexp_replace(F.array_join("all.text", " "), SPACES, " ")).alias("text"))


def footer_titles(footer_lines: DataFrame) -> DataFrame:
    """doc_id, title: the longest title of page 1's footer that page 2's repeats, or else the
    longest; the first of equal ones."""
    titles = title_groups(footer_lines.where("page_no = 1")).where(looks_like_title(F.col("text"))).withColumn("flat", normalized_line(F.col("text")))
    second = footer_lines.where("page_no = 2").groupBy("doc_id").agg(F.collect_set(normalized_line(F.col("text"))).alias("others"))
    rows = titles.join(second, "doc_id", "left")
    again = (F.length("flat") >= 12) & F.exists("others", lambda o: F.contains(o, F.col("flat")) | F.contains(F.col("flat"), o))
    best = F.max_by("text", F.struct(F.coalesce(again, F.lit(False)).alias("again"), F.length("text").alias("n"), -F.col("title_ix")))
    return rows.groupBy("doc_id").agg(best.alias("title"))


def caption_titles(items: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, title of page 1's right column: after `Case No`, up to the next line about the hearing."""
    right = (F.col("x") > F.col("width") * 0.47) & (F.col("y") > F.col("height") * 0.30) & (F.col("y") < F.col("height") * 0.93)
    rows = items.where("page_no = 1").join(pages.where("page_no = 1").drop("page_no"), "doc_id").where(right & (trim(F.col("str")) != ""))
    row = F.floor(F.col("y") + 0.5).alias("row")
    rows = rows.groupBy("doc_id", row).agg(F.array_sort(F.collect_list(F.struct("x", "item_ix", "str"))).alias("all"))
    rows = rows.select("doc_id", "row", trim(F.regexp_replace(F.array_join("all.str", " "), SPACES, " ")).alias("text")).where("text <> ''")
    down = Window.partitionBy("doc_id").orderBy(F.desc("row"))
    case = F.col("text").rlike(t.java(r"(?i)^case\s+no"))
    rows = rows.withColumn("case_row", F.max(F.when(case, F.col("row"))).over(Window.partitionBy("doc_id")))
    rows = rows.where(F.col("case_row").isNull() | (F.col("row") < F.col("case_row"))).where(~F.col("text").rlike(t.java(CAPTION_JUNK)))
    meta = F.col("text").rlike(t.java(CAPTION_META))
    # Metadata before the title is passed over; what comes after the title's end is not.
    rows = rows.withColumn("begun", F.sum(F.when(meta, 0).otherwise(1)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("ended", F.max(meta & (F.col("begun") > 0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.where(~meta & ~F.col("ended")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("row")).alias("down"), "text"))).alias("all"))
    return kept.select("doc_id", F.array_join("all.text", " ").alias("title"))


def line_numbers(items: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, num, top, left: the column of line numbers at the left, if a page
    has one. Candidates group with the first of their group, from the left."""
    rows = items.where(trim(F.col("str")).rlike(r"^\d{1,2}$")).join(pages, ["doc_id", "page_no"])
    rows = rows.select("doc_id", "page_no", trim(F.col("str")).cast("int").alias("num"), "x", (F.col("height") - F.col("y")).alias("top"), "width", F.col("height").alias("page_height"))
    rows = rows.where(F.col("x") <= F.col("width") * COLUMN)
    every = rows.groupBy("doc_id", "page_no", "page_height").agg(F.array_sort(F.collect_list(F.struct("x", "top", "num"))).alias("all")).where(F.size("all") >= COLUMN_LEAST)
    zero = F.struct(F.lit(float("-inf")).alias("seed"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("of"))

    def step(s, c):
        fresh = c["x"] - s["seed"] > COLUMN_REACH
        n = s["n"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, c["x"]).otherwise(s["seed"]).alias("seed"), n.alias("n"), F.concat(s["of"], F.array(n)).alias("of"))

    of = F.aggregate("all", zero, step, lambda s: s["of"])
    each = every.select("doc_id", "page_no", "page_height", F.inline(F.zip_with("all", of, lambda c, g: F.struct(g.alias("column"), c["x"].alias("left"), c["top"].alias("top"), c["num"].alias("num")))))
    sizes = each.groupBy("doc_id", "page_no", "page_height", "column").agg(F.count(F.lit(1)).alias("n"), (F.max("top") - F.min("top")).alias("span"))
    best = sizes.groupBy("doc_id", "page_no", "page_height").agg(F.max_by(F.struct("column", "n", "span"), F.struct("n", -F.col("column"))).alias("best"))
    best = best.where((F.col("best.n") >= COLUMN_LEAST) & (F.col("best.span") >= F.col("page_height") * COLUMN_SPAN)).select("doc_id", "page_no", F.col("best.column").alias("column"))
    return each.join(best, ["doc_id", "page_no", "column"]).select("doc_id", "page_no", "num", "top", "left")


def page_number(text: Column) -> Column:
    """`12`, `Page 12`, `- 12 -` or `12 of 30` as 12, else null."""
    forms = (r"^(\d{1,4})$", r"(?i)^page\s+(\d{1,4})\b", r"^[-–—]\s*(\d{1,4})\s*[-–—]$", r"(?i)^(\d{1,4})\s+of\s+\d{1,4}$")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, t.java(f), 1), F.lit("")) for f in forms]).cast("int")


def document_texts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) of pages joined with a break after each, and pages' ranges
    (doc_id, page_no, start, stop), of which the break is a part."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("item_ix", "str", "has_eol"))), lambda i: F.struct(i["str"].alias("s"), F.when(i["has_eol"], "\n").otherwise(" ").alias("gap")))
    pages = items.groupBy("doc_id", "page_no").agg(said.alias("all"))
    n = F.size("all")
    text = F.array_join(F.transform("all", lambda i, k: F.concat(i["s"], F.when(k < n - 1, i["gap"]).otherwise(""))), "")
    pages = pages.select("doc_id", "page_no", F.concat(text, F.lit("\n\f\n")).alias("text"))
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    ranges = pages.select("doc_id", "page_no", F.length("text").alias("n"), F.sum(F.length("text")).over(w).alias("stop"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("all")).select("doc_id", F.array_join("all.text", "").alias("text"))
    return docs, ranges.select("doc_id", "page_no", (F.col("stop") - F.col("n")).alias("start"), "stop")


def on_pages(cites: DataFrame, ranges: DataFrame) -> DataFrame:
    """Citations with page_no; those that cross a page's end are on none and drop out."""
    r = ranges.select(F.col("doc_id").alias("__doc"), "page_no", F.col("start").alias("__start"), F.col("stop").alias("__stop"))
    inside = (F.col("doc_id") == F.col("__doc")) & (F.col("start") >= F.col("__start")) & (F.col("stop") <= F.col("__stop") - 3)
    return cites.join(r, inside).drop("__doc", "__start", "__stop")


# Of paragraph marks and page numbers: their forms, how far right of the line numbers,
# the part of the page that they may begin in, the width of a column, the margins, the width of a slot.
MARK_FORM, MARK_GAP, MARK_REACH, MARK_COLUMN, LEAST_MARKS = r"^(\d{1,3})[.)](?:\s|\z)", 4, 0.5, 0.03, 3
TOP_MARGIN, BOTTOM_MARGIN, SLOT = 0.12, 0.85, 0.08


def _beside(spans: DataFrame, pages: DataFrame, numbers: DataFrame) -> DataFrame:
    """Spans right of their page's column of line numbers."""
    edge = numbers.groupBy("doc_id", "page_no").agg(F.max(F.col("left") + F.coalesce("width", F.lit(0.0))).alias("edge"))
    rows = spans.join(pages.select("doc_id", "page_no", F.col("width").alias("page_width"), F.col("height").alias("page_height")).where("height > 0"), ["doc_id", "page_no"])
    rows = rows.join(edge, ["doc_id", "page_no"], "left").where(F.col("left") > F.coalesce("edge", F.lit(0.0)) + MARK_GAP)
    return rows.withColumn("said", trim(F.col("said"))).withColumn("y", F.col("top") / F.col("page_height"))


def paragraph_candidates(spans: DataFrame, pages: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc_id, page, y, num, left (parts of the page), seq: spans (doc_id, page_no, seq, said, left,
    top) of the left half that begin with a number and a full stop or bracket. `numbers` are
    the line numbers' places (doc_id, page_no, left, width)."""
    rows = _beside(spans, pages, numbers).where(F.col("left") <= F.col("page_width") * MARK_REACH)
    num = F.nullif(F.regexp_extract("said", t.java(MARK_FORM), 1), F.lit("")).cast("int")
    return rows.select("doc_id", F.col("page_no").alias("page"), "y", num.alias("num"), (F.col("left") / F.col("page_width")).alias("left"), "seq").where("num IS NOT NULL")


def number_candidates(spans: DataFrame, pages: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc_id, page, slot, number: what could be printed page numbers in the margins above and
    below, by the slot they stand in; `ordered.printed_offset` finds the slot that counts pages."""
    rows = _beside(spans, pages, numbers).where((F.col("y") < TOP_MARGIN) | (F.col("y") > BOTTOM_MARGIN))
    slot = F.concat(F.when(F.col("y") < 0.5, "t:").otherwise("b:"), F.floor(F.col("left") / F.col("page_width") / SLOT + 0.5).cast("string"))
    return rows.select("doc_id", F.col("page_no").alias("page"), slot.alias("slot"), page_number(F.col("said")).alias("number")).where("number IS NOT NULL")


def paragraph_marks(candidates: DataFrame) -> DataFrame:
    """doc_id, page, y, num, seq: the marks of a document's numbered paragraphs: of all columns of
    candidates (doc_id, page, y, num, left, seq) the longest run in which each number is one more
    than the one before it on the pages, if there are three. Of equally long runs the one whose
    column is seen first counts, then the earlier."""
    rows = candidates.withColumn("column", F.floor(F.col("left") / MARK_COLUMN + 0.5))
    by = ["doc_id", "column"]
    rows = gap_groups(rows, by, ["page", "y", "seq"], lambda w: F.col("num") != F.lag("num").over(w) + 1, "run")
    runs = rows.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "seq")).alias("at"))
    seen = runs.groupBy(*by).agg(F.min("at").alias("seen"))
    best = runs.join(seen, by).groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "seen", "run", "column")).alias("one")).where(-F.col("one.less") >= LEAST_MARKS)
    kept = rows.join(best.select("doc_id", "one.column", "one.run"), [*by, "run"], "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "seq")).cast("bigint")
    return kept.select("doc_id", "page", "y", "num", place.alias("seq"))
