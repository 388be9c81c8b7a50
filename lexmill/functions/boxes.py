"""Boxes and regions on pages: filters, clamps, unions and changes of scale, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The default and the greatest left margin in per cent, the least extent of a region.
MARGIN, MOST_MARGIN, LEAST_REGION = 8, 30, 0.02


def in_margin(x: Column, width: Column, percent: Column) -> Column:
    """Whether a word begins in the left margin that recognition leaves out; no percentage is the default's."""
    cut = width * (F.least(F.lit(float(MOST_MARGIN)), F.greatest(F.lit(0.0), F.coalesce(percent.cast("double"), F.lit(float(MARGIN))))) / 100)
    return (cut > 0) & (x < cut)


def valid_region(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    inside = [v.isNotNull() & v.between(0, 1) for v in (left, top, right, bottom)]
    return F.coalesce(inside[0] & inside[1] & inside[2] & inside[3] & (right - left >= LEAST_REGION) & (bottom - top >= LEAST_REGION), F.lit(False))


def dragged(x0: Column, y0: Column, x1: Column, y1: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """struct(left, top, right, bottom): a drag over a page at (left, top), as its fractions;
    null where that is no valid region."""

    def clamped(v):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    box = [clamped((F.least(x0, x1) - left) / width), clamped((F.least(y0, y1) - top) / height), clamped((F.greatest(x0, x1) - left) / width), clamped((F.greatest(y0, y1) - top) / height)]
    return F.when(valid_region(*box), F.struct(*[b.alias(n) for b, n in zip(box, ("left", "top", "right", "bottom"), strict=True)]))


def outside(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, region: Column) -> Column:
    """Whether a span's middle lies outside a region of the page; without a region, never."""
    across, down = (x + w / 2) / page_w, (y + h / 2) / page_h
    out = (across < region["left"]) | (across > region["right"]) | (down < region["top"]) | (down > region["bottom"])
    return region.isNotNull() & out


def bounds(rects: Column) -> Column:
    """struct(left, bottom, right, top) around rectangles (x, y, w, h) with an area; null without one."""
    good = F.filter(rects, lambda r: (r["w"] > 0) & (r["h"] > 0))

    def of(name, use, with_extent=None):
        return use(F.transform(good, lambda r: r[name] + (r[with_extent] if with_extent else 0)))

    box = F.struct(of("x", F.array_min).alias("left"), of("y", F.array_min).alias("bottom"), of("x", F.array_max, "w").alias("right"), of("y", F.array_max, "h").alias("top"))
    return F.when(F.size(good) > 0, box)


def in_pixels(rects: Column, height: Column, scale: Column) -> Column:
    """Rectangles of a page in points from below, as (left, top, width, height) in pixels from above."""
    good = F.filter(rects, lambda r: (r["w"] > 0) & (r["h"] > 0))

    def one(r):
        return F.struct((r["x"] * scale).alias("left"), ((height - (r["y"] + r["h"])) * scale).alias("top"), (r["w"] * scale).alias("width"), (r["h"] * scale).alias("height"))

    return F.when(height > 0, F.transform(good, one)).otherwise(F.transform(F.filter(rects, lambda r: F.lit(False)), one))


def nearest_pages(pages: DataFrame, middles: DataFrame) -> DataFrame:
    """doc_id, page: the page (doc_id, page, top, height) whose middle is nearest to the
    view's (doc_id, middle); of equally near ones the first."""
    rows = pages.join(middles, "doc_id").withColumn("far", F.abs(F.col("top") + F.col("height") / 2 - F.col("middle")))
    return rows.groupBy("doc_id").agg(F.min_by("page", F.struct("far", "page")).alias("page"))


def extracted(plan: DataFrame, checked: DataFrame) -> DataFrame:
    """The checked entries (doc_id, pos) of a page plan, in its order, renumbered."""
    rows = plan.join(checked.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return rows.withColumn("pos", place.cast(dict(plan.dtypes)["pos"]))


def checked_plan(plan: DataFrame, documents: DataFrame) -> DataFrame:
    """A plan with turns below 360 degrees. It fails where it names a page that isn't there;
    so do documents (doc_id, num_pages) without an entry when they are read."""
    rows = plan.join(documents.select("doc_id", "num_pages"), "doc_id", "right")
    bad = ~F.coalesce(F.col("src_index").between(0, F.col("num_pages") - 1), F.lit(False))
    why = F.when(F.col("pos").isNull(), "A document must keep at least one page.").when(bad, "Page plan references a page that doesn't exist.")
    turn = F.pmod(F.coalesce("rotate", F.lit(0)), F.lit(360))
    return rows.select("doc_id", "pos", "src_index", F.when(why.isNotNull(), F.raise_error(why).cast("int")).otherwise(turn).alias("rotate"))
