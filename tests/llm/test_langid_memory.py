"""The language model is fitted where its sample is."""

import os

import numpy as np

from lexmill.llm import langid

SF = "/root/testdata/sf0.001"


def test_the_driver_gets_the_model_alone(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fit, driver = langid.fit, os.getpid()

    def elsewhere(*given):
        assert os.getpid() != driver
        return fit(*given)

    monkeypatch.setattr(langid, "fit", elsewhere)
    one, two = langid.train(docs), langid.train(docs.repartition(5))
    assert one.languages == tuple(sorted(r["lang"] for r in docs.where("lang IS NOT NULL").select("lang").distinct().collect()))
    assert one.table.shape == (langid.BUCKETS, len(one.languages)) and one.bias.shape == (len(one.languages),)
    assert np.array_equal(one.table, two.table) and one.least == two.least


def test_a_sample_without_examples_gives_a_model(spark):
    """Labelled texts that aren't drawn, or have no letters."""
    docs = spark.createDataFrame([(i, "", "a") for i in range(4)], "doc_id long, text string, lang string")
    m = langid.train(docs)
    assert m.languages == ("a",) and m.table.shape == (langid.BUCKETS, 1)
