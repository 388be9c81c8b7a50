"""Documents as files: local ones, several at once, and what a server answered.

A file is one row with its bytes; bytes are read only where they are used. Names come from
the answer's header, then the URL, or from the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filing_text import file_name_from_disposition, file_name_from_url

# Fixed values.
PDF_TYPE, PDF_NAME = "application/pdf", r"(?i)\.pdf\z"


def is_pdf(name: Column, mime: Column) -> Column:
    """By its type, or else by its name's end."""
    return F.coalesce(mime == PDF_TYPE, F.lit(False)) | F.coalesce(name.rlike(PDF_NAME), F.lit(False))


def name_of(path: Column) -> Column:
    """The last part of a path that Spark lists."""
    return F.element_at(F.split(path, "/"), -1)


def local_files(spark: SparkSession, paths: str | list[str], types: DataFrame | None = None) -> DataFrame:
    """path, source_name, length, modified, editable, content of the PDF files under folders,
    globs or paths, in all their folders. `types` (name, mime) says the type of files that their
    names don't tell."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    rows = files.select("path", name_of(F.col("path")).alias("source_name"), "length", F.col("modificationTime").alias("modified"), "content")
    if types is None:
        return rows.where(is_pdf(F.col("source_name"), F.lit(None).cast("string"))).select("path", "source_name", "length", "modified", F.lit(True).alias("editable"), "content")
    known = types.select(F.col("name").alias("source_name"), "mime").dropDuplicates(["source_name"])
    rows = rows.join(known, "source_name", "left").where(is_pdf(F.col("source_name"), F.col("mime")))
    return rows.select("path", "source_name", "length", "modified", F.lit(True).alias("editable"), "content")


def fetched(answers: DataFrame) -> DataFrame:
    """url, name, editable, content, error of answers (url, status, content_disposition, content):
    the name is the header's, else the URL's; an answer that is no success has an error and no
    content. Fetching itself is the caller's."""
    good = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    name = F.coalesce(F.nullif(file_name_from_disposition(F.col("content_disposition")), F.lit("")), F.nullif(file_name_from_url(F.col("url")), F.lit("")))
    error = F.when(~good, F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
    return answers.select("url", name.alias("name"), F.lit(False).alias("editable"), F.when(good, F.col("content")).alias("content"), error.alias("error"))
