"""What finds citations is worked out once for each text and each `v.`."""

from pyspark.sql import functions as F

from lexmill.functions import names as nm
from lexmill.functions import tables as t
from lexmill.operators import citations as ct


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_and_tails_are_worked_out_once(spark):
    docs = spark.createDataFrame([(1, "As held in Chen v. Acme Corp. (1999) 3 Cal.4th 5, 6.")], "doc_id long, text string")
    text = plan(ct.anchored(ct.spotted(docs)))
    for pattern in ("*" + nm.SMALL_WORD, t.TAILS["bb"], t.TAILS["lexis"]):
        assert text.count(pattern) == 1


def test_names_of_odd_tokens(spark):
    # Plain words that are listed, last and not; line ends, wide gaps and small words at either end.
    lefts = {
        "See Doe, et al. ": "Doe",
        "the Cases of Chen ": "Chen",
        "Supra Chen ": "Chen",
        "Headings Llp Chen ": "Chen",
        "by Chen Llp ": "Chen Llp",
        "one\nTwo   Chen of the State ": "Chen of the State",
        "Local 12 Chen ": "Local 12 Chen",
        "held 12 Chen ": "Chen",
        "x\n\nstate chapter\t12 Chen ": "Chen",
        "all small ": None,
        "": None,
        "\r": None,
    }
    df = spark.createDataFrame([(k,) for k in lefts], "left string").withColumn("at", nm.name_start(F.col("left")))
    got = {r["left"]: None if r["at"] is None else r["left"][r["at"] :].strip(" ") for r in df.collect()}
    assert {k: v and v.removesuffix(", et al.") for k, v in got.items()} == lefts
