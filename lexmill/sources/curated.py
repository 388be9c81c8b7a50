"""Curated links: a JSON document of sections of keys, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINKS = "westlaw_url string, lexis_url string, fallback_url string, url string"


def curated_links(spark: SparkSession, path: str) -> DataFrame:
    """section, key and four links of every document at `path`; sections that aren't
    objects of objects are left out."""
    text = spark.read.text(path, wholetext=True)
    sections = F.from_json("value", f"map<string, map<string, struct<{LINKS.replace(' string', ':string')}>>>")
    rows = text.select(F.explode(sections).alias("section", "entries")).select("section", F.explode("entries").alias("key", "links"))
    return rows.select("section", "key", "links.*")


def section_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("section").agg(F.count(F.lit(1)).alias("n_keys"))
