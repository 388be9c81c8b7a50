"""Locators join tables of any size: no side is broadcast for being estimated small."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import locators as lc
from lexmill.plans import record_queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [q.selection_places, q.selection_bands, q.selected_texts])
def test_nothing_is_broadcast(spark, query):
    assert "Broadcast" not in query(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_bands_without_lines_or_offsets(spark):
    bands = spark.createDataFrame([(1, 1, 0.1, 0.2), (2, 1, 0.0, 0.5), (2, 3, 0.0, 0.5)], "doc_id long, page int, top double, bottom double")
    lines = spark.range(24).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), (F.col("id") + 1).alias("num"), (F.col("id") / 32).alias("y0"), (F.col("id") / 32 + 1 / 64).alias("y1"))
    none = spark.createDataFrame([], "doc_id long, offset long")
    marks = spark.createDataFrame([], "doc_id long, page int, y double, num int, seq int")
    got = {(r.doc_id, r.kind, r.place) for r in lc.places(bands, lines, marks, none).collect()}
    assert got == {(1, "line", "p. 1:4-7"), (2, "page", "pp. 1-3")}
