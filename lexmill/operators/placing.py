"""Placing citations on a page's printed text: each takes the nearest place that is still free.

A page's text is its spans with a space between them. Citations come in their order; each is
sought with white space squeezed, takes of the free places of its text the one nearest to
where it starts in the joined text (the first of equally near ones), and no later citation
may begin there. What is not found whole is sought by its most distinctive part.

A page is a group: its citations and text are one row, and all steps are column expressions.
Citations of which no place is free, and of which nothing but white space is sought, are on
none and drop out; so do those of pages without spans. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.arrays import found, let, starts_of
from ..functions.resolve import distinctive

SPACES = t.java(r"\s+")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, t.java(r"^\s+|\s+\z"), "")


def occurrences(text: Column, part: Column) -> Column:
    """Where `part` begins in `text`, from 0, places that overlap included."""
    ahead = F.concat(F.lit(r"(?=\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    # Pieces of a text split before each place: all but the first begin at one.
    pieces = F.split(text, ahead, -1)
    starts = let(pieces, lambda p: starts_of(F.transform(p, lambda x: F.length(x).cast("bigint"))))
    size = F.length(text)
    return F.when(F.contains(text, part) & (part != ""), F.filter(starts, lambda s, i: (s < size) & ((i > 0) | F.startswith(text, part)))).otherwise(F.array().cast("array<bigint>"))


def page_texts(spans: DataFrame) -> DataFrame:
    """doc_id, page_no, text, span_starts of spans (doc_id, page_no, span_ix, said)."""
    every = F.array_sort(F.collect_list(F.struct("span_ix", F.coalesce("said", F.lit("")).alias("said"))))
    rows = spans.groupBy("doc_id", "page_no").agg(every.alias("spans")).select("doc_id", "page_no", F.col("spans.said").alias("said"))
    return rows.select("doc_id", "page_no", F.array_join("said", " ").alias("text"), starts_of(F.transform("said", lambda s: F.length(s).cast("bigint") + 1)).alias("span_starts"))


def _within(starts: Column, at: Column) -> Column:
    """The span (from 0) that an offset lies in."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= at)) - 1, F.lit(0))


def placed(cites: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, seq, start, stop (in the page's text), whole (whether all of the citation
    was found), first_span, last_span. cites: doc_id, page_no, seq (their order), start (in the
    page's joined text), said. pages: as `page_texts` gives them."""
    sought = F.array_sort(F.collect_list(F.struct("seq", "start", trimmed(squeezed(F.coalesce("said", F.lit("")))).alias("said"))))
    rows = cites.groupBy("doc_id", "page_no").agg(sought.alias("cites")).join(pages, ["doc_id", "page_no"])
    rows = rows.withColumn("flat", squeezed(F.col("text")))
    # Runs of several spaces: where each is in the squeezed text, and how much longer it was.
    wide = found(F.col("text"), t.java(r"\s{2,}"))
    extra = F.transform(wide, lambda w: w["stop"] - w["start"] - 1)
    rows = rows.withColumn("wide", let(extra, lambda e: F.zip_with(F.zip_with(wide, starts_of(e), lambda w, b: w["start"] - b), e, lambda at, n: F.struct(at.alias("at"), n.alias("n")))))

    def options(c: Column) -> Column:
        part = F.coalesce(trimmed(squeezed(distinctive(c["said"]))), F.lit(""))

        def of(at: Column) -> Column:
            whole = F.size(at) > 0
            other = F.when(whole, at).otherwise(occurrences(F.col("flat"), part))
            size = F.when(whole, F.length(c["said"])).otherwise(F.length(part)).cast("bigint")
            return F.struct(c["seq"], F.least(c["start"].cast("bigint"), F.length("flat").cast("bigint") - 1).alias("hint"), other.alias("at"), size.alias("size"), whole.alias("whole"))

        return let(occurrences(F.col("flat"), c["said"]), of)

    rows = rows.withColumn("options", F.transform("cites", options))
    kind = "struct<used:array<bigint>,places:array<struct<seq:bigint,at:bigint,size:bigint,whole:boolean>>>"
    none = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<seq:bigint,at:bigint,size:bigint,whole:boolean>>").alias("places")).cast(kind)

    def take(state: Column, c: Column) -> Column:
        free = F.filter(c["at"], lambda m: ~F.array_contains(state["used"], m))
        best = F.array_min(F.transform(free, lambda m: F.struct(F.abs(m - c["hint"]).alias("far"), m.alias("at"))))
        with_it = lambda b: F.struct(F.array_append(state["used"], b["at"]).alias("used"), F.array_append(state["places"], F.struct(c["seq"].cast("bigint").alias("seq"), b["at"].alias("at"), c["size"].alias("size"), c["whole"].alias("whole"))).alias("places"))
        return let(best, lambda b: F.when(b.isNull(), state).otherwise(with_it(b).cast(kind)))

    rows = rows.select("doc_id", "page_no", "wide", "span_starts", F.length("flat").cast("bigint").alias("n"), F.inline(F.aggregate("options", none, take, lambda s: s["places"])))

    def in_text(at: Column) -> Column:
        return at + F.aggregate(F.filter("wide", lambda w: w["at"] < at), F.lit(0).cast("bigint"), lambda s, w: s + w["n"])

    rows = rows.withColumn("start", in_text(F.col("at"))).withColumn("stop", in_text(F.least(F.col("at") + F.col("size") - 1, F.col("n") - 1)) + 1)
    spans = _within(F.col("span_starts"), F.col("start")).alias("first_span"), _within(F.col("span_starts"), F.greatest(F.col("stop") - 1, F.col("start"))).alias("last_span")
    return rows.select("doc_id", "page_no", "seq", "start", "stop", "whole", *spans)
