"""Page plans and stamps: positions, rotations and boxes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turned(angle: Column, by: int = 90) -> Column:
    return F.pmod(angle + by, F.lit(360))


def placed(angle: Column, width: Column, height: Column, text_width: Column, size: float, margin: float, across: str, along: str) -> Column:
    """struct(x, y): where a stamp goes on a page that is shown turned by `angle`."""
    lies = angle.isin(90, 270)
    shown_w, shown_h = F.when(lies, height).otherwise(width), F.when(lies, width).otherwise(height)
    right = {"l": F.lit(float(margin)), "r": shown_w - margin - text_width}.get(across, (shown_w - text_width) / 2)
    up = F.lit(float(margin)) if along == "bottom" else shown_h - margin - size
    x = F.when(angle == 90, width - up).when(angle == 180, width - right).when(angle == 270, up).otherwise(right)
    y = F.when(angle == 90, right).when(angle == 180, height - up).when(angle == 270, height - right).otherwise(up)
    return F.struct(x.alias("x"), y.alias("y"))


def watermark(width: Column, height: Column, text_width: Column, size: float, diagonal: bool = True) -> Column:
    """struct(x, y, degrees): the start of a text whose middle is the page's."""
    turn = F.atan2(height, width) if diagonal else F.lit(0.0)
    x = width / 2 - text_width / 2 * F.cos(turn) - size / 3 * F.sin(turn)
    y = height / 2 - text_width / 2 * F.sin(turn) + size / 3 * F.cos(turn)
    return F.struct(x.alias("x"), y.alias("y"), F.degrees(turn).alias("degrees"))


def fitted(width: Column, height: Column) -> Column:
    """The scale at which an image fits a letter page; never above 1."""
    return F.least(F.lit(1.0), 612 / width, 792 / height)


def header(template: Column, number: Column, total: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{n}"), number.cast("string")), F.lit("{N}"), total.cast("string"))


def quads(rects: Column) -> Column:
    """Corners of rectangles (x, y, w, h) with an area: top left and right, bottom left and right."""
    good = F.filter(rects, lambda r: (r["w"] > 0) & (r["h"] > 0))
    return F.flatten(F.transform(good, lambda r: F.array(r["x"], r["y"] + r["h"], r["x"] + r["w"], r["y"] + r["h"], r["x"], r["y"], r["x"] + r["w"], r["y"])))


def rectangles(points: Column) -> Column:
    """Rectangles of quads, eight numbers each; those without an area are left out."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(points) - 8, F.lit(0)), F.lit(8)), lambda i: i + 8 <= F.size(points))

    def one(i):
        at = lambda k: F.get(points, i + k)
        return F.struct(at(0).alias("x"), at(5).alias("y"), (at(2) - at(0)).alias("w"), (at(1) - at(5)).alias("h"))

    return F.filter(F.transform(starts, one), lambda r: (r["w"] > 0) & (r["h"] > 0))


def identity_plan(documents: DataFrame) -> DataFrame:
    """doc_id, pos, src_index, rotate for every page of documents (doc_id, num_pages)."""
    pages = documents.where("num_pages > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("num_pages") - 1)).alias("pos"))
    return pages.select("doc_id", "pos", F.col("pos").alias("src_index"), F.lit(0).alias("rotate"))


def moved(plan: DataFrame, source: int, before: int) -> DataFrame:
    """Every plan with the page at `source` put before the page at `before`, or last if there is none."""
    place = F.when(F.col("pos") == source, F.lit(before) - 0.5).otherwise(F.col("pos").cast("double"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(place, "pos")) - 1
    return plan.withColumn("__pos", n).withColumn("pos", F.col("__pos")).drop("__pos")


def swapped(plan: DataFrame, at: int, step: int) -> DataFrame:
    """Pages at `at` and its neighbour change places; no neighbour, no change."""
    other = at + step
    last = F.max("pos").over(Window.partitionBy("doc_id"))
    pos = F.when(F.lit(other < 0) | (last < max(at, other)), F.col("pos")).when(F.col("pos") == at, other).when(F.col("pos") == other, at).otherwise(F.col("pos"))
    return plan.withColumn("__pos", pos.cast("int")).withColumn("pos", F.col("__pos")).drop("__pos")


def without_page(plan: DataFrame, at: int) -> DataFrame:
    """Every plan without the page at `at`; the last page of a plan stays."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    rows = plan.withColumn("__n", n).where((F.col("pos") != at) | (F.col("__n") == 1)).drop("__n")
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("int"))


def part_name(base: Column, first: Column, last: Column) -> Column:
    return F.when(first == last, F.format_string("%s p%d.pdf", base, first)).otherwise(F.format_string("%s p%d-%d.pdf", base, first, last))


def touched_pages(marked: Column, total: Column) -> Column:
    """The pages, from 1, whose highlights are written: those that have or had any, and all of
    the document's, each once and in order."""
    every = F.when(total > 0, F.sequence(F.lit(1), total.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_union(F.coalesce(marked.cast("array<int>"), F.array().cast("array<int>")), every))


def page_counts(plan: DataFrame) -> DataFrame:
    """doc_id, n_pages of a plan."""
    return plan.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
