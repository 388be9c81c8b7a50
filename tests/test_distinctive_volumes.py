"""The distinctive part of a case's citation begins where its volume's number does."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import resolve as rs

CITES = [
    ("A v. B (1990) 12345 Cal.App.5th 678", "12345 Cal.App.5"),
    ("A v. B (1990) 9999 Cal.App.5th 678", "9999 Cal.App.5"),
    ("A v. B (1990) 0 Cal.App.5th 678", "0 Cal.App.5"),
    ("A v. B, x1234567 U.S. 242", "1234567 U.S. 242"),
    ("§ 5, 12345 Cal.App.5th 678", "§ 5, 12345"),
    ("12345 Nothing 6", None),
]


@pytest.fixture(scope="module")
def parts(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CITES)], "i int, said string")
    return {r.i: r.part for r in rows.select("i", rs.distinctive(F.col("said")).alias("part")).collect()}


@pytest.mark.parametrize("i", range(len(CITES)))
def test_whole_volumes(parts, i):
    assert parts[i] == CITES[i][1]
