"""The engine's tables in SQL: views of a session over a table of documents.

    register(spark, "documents")
    spark.sql("SELECT key, link FROM lexmill_links JOIN ...")
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resolve as rs
from ..operators import citations as ct
from ..operators import plain_names, titles

NO_LINKS = "section string, key string, westlaw_url string, lexis_url string, fallback_url string, url string"


def named_titles(rows: DataFrame, raw: str = "title") -> DataFrame:
    """`rows` with the kind, target, party label and short form of a printed title, and its simplified name."""
    parsed = titles.parsed(rows.withColumn("raw", F.col(raw)))
    return parsed.select(*rows.columns, "canonical", "target", "party_label", titles.short_form(F.col("canonical")).alias("short_form"), plain_names.simplified(F.col(raw)).alias("simple_name"))


def register(spark: SparkSession, documents: str, curated: str | None = None, named: str | None = None, prefix: str = "lexmill_", provider: str = "westlaw") -> list[str]:
    """Creates temporary views, and gives their names: `citations`, `authorities` and `links` (the
    authorities with links) of a table `documents` (doc_id, text), and `titles` of a table `named`
    (title, and more) if one is given; `curated` is a table of links. What `citations` reads is
    found when the view is made: it is made again for documents that come later."""
    cites = ct.find_citations(spark.table(documents))
    links = spark.table(curated) if curated else spark.createDataFrame([], NO_LINKS)
    flags = [F.bool_or(f).alias(f) for f in ("wl_only", "lexis_only", "slip_only")]
    listed = ct.authorities(cites)
    views = {"citations": cites, "authorities": listed, "links": rs.resolve(listed.join(cites.groupBy("doc_id", "kind", "key").agg(*flags), ["doc_id", "kind", "key"]), links, provider)}
    if named:
        views["titles"] = named_titles(spark.table(named))
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
