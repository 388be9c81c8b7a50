"""How many rows rectangles are filed in: few for each, and none of their pairs leave a cell."""

from pyspark.sql import functions as F

from lexmill.operators import rectangles as rt
from lexmill.plans import name_queries as q

SF = "/root/testdata/sf0.001"


def test_untouched_deals_out_no_pairs_and_broadcasts_nothing(spark):
    plan = q.clear_boxes(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Broadcast" not in plan


def test_few_rows_for_each_rectangle(spark):
    marked, others = q._boxes(spark, SF)
    a, b = rt._corners(marked, "doc_id", ()), rt._corners(others, "doc_id", ())
    levels = rt._levels(a, b, 64.0)
    assert len(levels) == 2
    for rows, every in ((a, False), (b, True)):
        assert rt._filed(rows, "x", 64.0, levels, every).count() < 3 * rows.count()


def test_small_rectangles_are_not_compared_in_coarse_cells(spark):
    # 400 small ones far apart, inside one large: of 160,000 pairs only those with the large one meet.
    small = spark.range(400).selectExpr("1L AS doc", "id", "id % 20 * 200.0D AS left", "id DIV 20 * 200.0D AS top", "id % 20 * 200.0D + 1 AS right", "id DIV 20 * 200.0D + 1 AS bottom")
    large = spark.createDataFrame([(1, 1000, 0.0, 0.0, 9000.0, 9000.0)], small.schema)
    rows = small.union(large)
    sized = rt._corners(rows, "doc", (F.col("id"),))
    levels = rt._levels(sized, sized, 16.0)
    a, b = rt._filed(sized, "a", 16.0, levels, False), rt._filed(sized, "b", 16.0, levels, True)
    assert a.drop("id").join(b, ["key", "level", "own", "cell_x", "cell_y"]).count() < 3000
    assert rt.meeting(rows, rows, "doc", 1.0).count() == 400 + 2 * 400 + 1
    assert rt.untouched(small, large, "doc", 1.0).count() == 0
