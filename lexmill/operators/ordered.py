"""Ordered operators: carrying forward, sessions, runs, offsets, as-of joins, registries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

cut = partial(stored, name="spans")


def carry_forward(rows: DataFrame, value: Column, by: list, order: list, name: str) -> DataFrame:
    """The last value that is not null, up to and including the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def gap_groups(rows: DataFrame, by: list, order: list, opens, name: str) -> DataFrame:
    """Numbers groups from 1: opens(row before) says whether a row begins one."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    begins = (first | F.coalesce(opens(w), F.lit(False))).cast("bigint")
    return rows.withColumn("__begins", begins).withColumn(name, F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__begins")


def longest_run(rows: DataFrame, by: list, order: list, number: str, least: int = 3) -> DataFrame:
    """For each key, the longest run in which each number is one more than the one before
    it, if it has `least` rows: first, last and length; of equal ones the first."""
    runs = gap_groups(rows, by, order, lambda w: F.col(number) != F.lag(number).over(w) + 1, "run")
    runs = runs.groupBy(*by, "run").agg(F.min(number).alias("run_first"), F.max(number).alias("run_last"), F.count(F.lit(1)).alias("run_length"))
    best = runs.groupBy(*by).agg(F.max_by(F.struct("run_first", "run_last", "run_length"), F.struct("run_length", -F.col("run"))).alias("best"))
    return best.select(*by, "best.*").where(F.col("run_length") >= least)


def printed_offset(rows: DataFrame, doc: str, slot: str, page: str, number: str) -> DataFrame:
    """For each document the offset from page to printed number that one slot shows on most
    pages: at least two, and never a number below 1; of equal ones the least slot, then offset."""
    seen = rows.withColumn("offset", F.col(number) - F.col(page)).groupBy(doc, slot, "offset")
    seen = seen.agg(F.countDistinct(page).alias("n_pages"), F.min(F.col(page) + F.col("offset")).alias("low")).where("low >= 1 AND n_pages >= 2")
    best = F.min_by(F.struct("offset", "n_pages"), F.struct(-F.col("n_pages"), slot, "offset"))
    return seen.groupBy(doc).agg(best.alias("best")).select(doc, "best.*")


def greedy_spans(rows: DataFrame, by: list, start: str, stop: str, tie: str, stretch: int = 100_000) -> DataFrame:
    """Keeps a span that starts at or after the end of the last that was kept; by start, `tie`, stop.

    A key of at most `stretch` spans is gone through by one task; only larger ones are taken
    apart into ranges."""
    spans = rows.select(*by, start, tie, stop)
    sizes = spans.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    most = sizes.agg(F.max("__n")).first()[0] or 0
    if most <= stretch:
        return _spans_of_small_keys(spans, by, start, stop, tie)
    large = sizes.where(F.col("__n") > stretch).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    small = _spans_of_small_keys(spans.join(large, same, "left_anti"), by, start, stop, tie)
    return small.unionByName(_spans_of_large_keys(spans.join(large, same, "left_semi"), by, start, stop, tie, stretch))


def _spans_of_small_keys(spans: DataFrame, by: list, start: str, stop: str, tie: str) -> DataFrame:
    """Keys in order stream through tasks, which hold no more than the end of the last span kept."""
    n, (a, z) = len(by), (spans.columns.index(start), spans.columns.index(stop))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, end = None, None
        for batch in batches:
            kept = []
            columns = [c.to_pylist() for c in batch.columns]
            for k, first, last in zip(zip(*columns[:n], strict=True), columns[a], columns[z], strict=True):
                free = k != key or (first is not None and end is not None and first >= end)
                if free:
                    key, end = k, last
                kept.append(free)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return spans.repartition(*by).sortWithinPartitions(*by, start, tie, stop).mapInArrow(keep, spans.schema)


def _spans_of_large_keys(spans: DataFrame, by: list, start: str, stop: str, tie: str, stretch: int) -> DataFrame:
    """Each span's successor (the next that can be kept after it) is found inside ranges of
    about `stretch` spans, so that no task holds a whole key; what is kept is then marked
    from each key's first span by doubling the successors."""
    rows = spans
    spans = cut(rows.select(*by, start, tie, stop).withColumn("__id", F.monotonically_increasing_id()))
    parts = spans.count() // stretch
    cuts = spans.agg(F.percentile_approx(start, [i / (parts + 1) for i in range(1, parts + 1)])).first()[0] if parts else None
    cuts = F.array(*[F.lit(c).cast(rows.schema[start].dataType) for c in sorted(set(cuts or ()))])

    # Spans, and after them in order what looks for a successor: beyond the span itself, or
    # before all that start where it ends.
    at_once = F.coalesce(F.col(stop) <= F.col(start), F.col(stop).isNull())
    place = [F.when(at_once, F.col(c)).alias(f"__{n}") for n, c in (("tie", tie), ("stop", stop), ("row", "__id"))]
    seek = spans.select(*by, F.when(at_once, F.col(start)).otherwise(F.col(stop)).alias("__at"), F.when(at_once, 1).otherwise(0).alias("__after"), *place, F.lit(1).alias("__seeks"), F.col("__id").alias("__from"), F.lit(None).cast("bigint").alias("__to"))
    there = spans.select(*by, F.col(start).alias("__at"), F.lit(1).alias("__after"), F.col(tie).alias("__tie"), F.col(stop).alias("__stop"), F.col("__id").alias("__row"), F.lit(0).alias("__seeks"), F.lit(None).cast("bigint").alias("__from"), F.col("__id").alias("__to"))
    order = ["__at", "__after", "__tie", "__stop", "__row", "__seeks"]
    both = there.unionByName(seek).withColumn("__part", F.when(F.col("__at").isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("__at")))))
    heads = both.groupBy(*by, "__part").agg(F.min_by("__to", F.when(F.col("__to").isNotNull(), F.struct(*order))).alias("__head"))
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    heads = heads.withColumn("__later", F.first("__head", ignorenulls=True).over(w)).select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), "__head", "__later")
    w = Window.partitionBy(*by, "__part").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__next", F.last("__to", ignorenulls=True).over(w)).where("__seeks = 1")
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    jumps = cut(found.join(heads, same, "left").select(F.col("__from").alias("a"), F.coalesce("__next", "__later").alias("b")).where("b IS NOT NULL"))
    kept = spans.groupBy(*by).agg(F.min(F.struct(start, tie, stop, "__id")).alias("one")).select(F.col("one.__id").alias("a"))
    kept = cut(kept)
    while True:
        more = cut(kept.join(jumps, "a").select(F.col("b").alias("a")))
        if more.isEmpty():
            break
        kept = cut(kept.unionByName(more))
        jumps = cut(jumps.join(jumps.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
    return spans.join(kept.withColumnRenamed("a", "__id"), "__id", "left_semi").select(*by, start, tie, stop)


def as_of(rows: DataFrame, markers: DataFrame, by: str, at: str, value: str, name: str) -> DataFrame:
    """Each row with the value of the last marker at or before it, in one pass over both."""
    left = rows.withColumn("__marker", F.lit(False)).withColumn("__value", F.lit(None).cast(markers.schema[value].dataType))
    right = markers.select(F.col(by), F.col(at), F.lit(True).alias("__marker"), F.col(value).alias("__value"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, F.col("__marker").desc(), "__value").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(name, F.last("__value", ignorenulls=True).over(w))
    return both.where(~F.col("__marker")).drop("__marker", "__value")


def without_overlaps(rows: DataFrame, taken: DataFrame, by: str, start: str, stop: str, width: int) -> DataFrame:
    """Rows (of integer spans) that no span of `taken` overlaps. Spans are compared only where they
    share a stretch of `width`, so a key's spans don't all meet."""
    def stretches(d):
        return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(stop) - 1, F.col(start))) / width)))

    marked = rows.withColumn("__row", F.struct(*rows.columns))
    near = marked.select("__row", F.col(by).alias("__by"), F.col(start).alias("__s"), F.col(stop).alias("__e"), stretches(rows).alias("__at"))
    other = taken.select(F.col(by).alias("__by"), stretches(taken).alias("__at"), F.col(start).alias("__s2"), F.col(stop).alias("__e2"))
    hit = near.join(other, ["__by", "__at"]).where("__s < __e2 AND __e > __s2").select("__row").distinct()
    return marked.join(hit, "__row", "left_anti").select(*rows.columns)


def first_seen(rows: DataFrame, by: list, order: str, fields: list) -> DataFrame:
    """One row per key: the fields of the first."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*fields), order).alias("one")).select(*by, "one.*")


def registry(events: DataFrame, key: str, order: list, removed: Column, fields: list) -> DataFrame:
    """The last entry of each key that was not removed after it."""
    last = events.withColumn("__gone", removed).groupBy(key).agg(F.max_by(F.struct(*fields, "__gone"), F.struct(*order)).alias("one"))
    return last.select(key, "one.*").where(~F.col("__gone")).drop("__gone")


def running_offsets(rows: DataFrame, by: list, order: list, length: Column, between: int, name: str) -> DataFrame:
    """Where each part begins when parts are joined with `between` characters after each."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(length + between).over(w), F.lit(0)).cast("bigint"))


def chunk(rows: DataFrame, by: list, order: list, size: int, name: str) -> DataFrame:
    """Numbers parts of `size` rows from 0."""
    return rows.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))
