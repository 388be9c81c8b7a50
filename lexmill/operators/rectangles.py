"""Joins of rectangles that intersect, by a grid of few levels.

A level's cells are 16 times as wide as those of the level below. A rectangle's own level is the
first whose cells its larger side fits into, so that it lies in four cells of its own level at
most, and in four of each coarser one that any rectangle has. Two rectangles are compared at the
coarser of their levels, in the one cell that holds the corner where their intersection begins:
no pair is compared twice, and a rectangle as large as the page costs no more rows than a small
one. Two rectangles of finer levels don't meet in a coarse cell: what is filed there because
it is large (own) meets all others, what is filed there besides meets only what is large.

Rectangles have (left, top, right, bottom); edges that touch don't intersect. One with a null
or not a number, or whose right is left of its left, meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("left", "top", "right", "bottom")


def _corners(rows: DataFrame, key: str, carried: tuple[Column, ...]) -> DataFrame:
    """key, the sides as doubles and what is `carried`, of rectangles that can meet any."""
    sized = rows.select(*carried, F.col(key).alias("key"), *[F.col(s).cast("double").alias(s) for s in SIDES])
    a, b, c, d = (F.col(s) for s in SIDES)
    side = F.greatest(c - a, d - b)
    return sized.where(F.col("key").isNotNull() & (c >= a) & (d >= b) & ~F.isnan(side) & (side < float("inf")))


def _level(cell: float) -> Column:
    side = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    return F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(cell)) / cell) / 4), F.lit(0)).cast("int")


def _levels(a: DataFrame, b: DataFrame, cell: float) -> list[int]:
    """The levels that rectangles have; a few numbers."""
    both = a.select(_level(cell).alias("level")).union(b.select(_level(cell).alias("level")))
    return sorted(r.level for r in both.distinct().collect())


def _filed(sized: DataFrame, mark: str, cell: float, levels: list[int], every: bool) -> DataFrame:
    """A row for each cell of the rectangle's own and the coarser levels. `own` is in the join's
    key: rows of the first side say whether the level is their own, those of the second meet
    either or, where the level is not their own, only such."""
    coarser = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= _level(cell))
    rows = sized.withColumn("level", F.explode(coarser))
    own = F.col("level") == _level(cell)
    lowest = F.col("level") == levels[0] if levels else F.lit(True)
    meets = F.explode(F.when(own & ~lowest, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    rows = rows.withColumn("own", meets if every else own)
    size = F.lit(cell) * F.pow(F.lit(16.0), F.col("level"))

    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))

    rows = rows.withColumn("cell_x", cells("left", "right")).withColumn("cell_y", cells("top", "bottom"))
    for s in SIDES:
        rows = rows.withColumnRenamed(s, f"{mark}_{s}")
    return rows


def _met(a: DataFrame, b: DataFrame, cell: float, how: str) -> DataFrame:
    """The first side's rows joined to the second's that they meet. Rows are dealt out: Spark
    doesn't count what `explode` makes, when it takes a side for small enough to be broadcast."""
    # Boxes of up to 16 cells share the finest level: fewer rows are filed, and a few more compared.
    cell *= 16
    levels = _levels(a, b, cell)
    x, y = _filed(a, "a", cell, levels, False), _filed(b, "b", cell, levels, True).hint("merge")
    size = F.lit(cell) * F.pow(F.lit(16.0), x["level"])
    meets = (F.col("a_left") < F.col("b_right")) & (F.col("a_right") > F.col("b_left")) & (F.col("a_top") < F.col("b_bottom")) & (F.col("a_bottom") > F.col("b_top"))
    here = (x["cell_x"] == F.floor(F.greatest("a_left", "b_left") / size)) & (x["cell_y"] == F.floor(F.greatest("a_top", "b_top") / size))
    same = [x[c] == y[c] for c in ("key", "level", "own", "cell_x", "cell_y")]
    on = meets & here if how == "inner" else meets
    for s in same:
        on = on & s
    return x.join(y, on, how)


def meeting(rows: DataFrame, others: DataFrame, key: str, cell: float) -> DataFrame:
    """a_row, b_row: pairs of rows of equal `key` whose rectangles intersect, each once. `cell`
    is about the side of the smallest rectangles; any other value gives the same pairs."""
    a, b = (_corners(r, key, (F.struct(*r.columns).alias(f"{m}_row"),)) for r, m in ((rows, "a"), (others, "b")))
    return _met(a, b, cell, "inner").select("a_row", "b_row")


def _hits(rows: DataFrame, others: DataFrame, key: str, cell: float) -> DataFrame:
    """a_row: different rows that meet any other. A row leaves a cell once, however many it
    meets there, and nothing but sides of the others is dealt out."""
    a, b = _corners(rows, key, (F.struct(*rows.columns).alias("a_row"),)), _corners(others, key, ())
    return _met(a, b, cell, "left_semi").select("a_row").distinct()


def touched(rows: DataFrame, others: DataFrame, key: str, cell: float) -> DataFrame:
    """Rows (different ones) whose rectangle intersects any of the others of its key."""
    return _hits(rows, others, key, cell).select("a_row.*")


def untouched(rows: DataFrame, others: DataFrame, key: str, cell: float) -> DataFrame:
    """Rows whose rectangle intersects none of the others of its key."""
    hit = _hits(rows, others, key, cell).select(F.col("a_row").alias("hit"))
    whole = rows.select(F.struct(*rows.columns).alias("row"))
    return whole.join(hit.hint("merge"), F.col("row").eqNullSafe(F.col("hit")), "left_anti").select("row.*")
