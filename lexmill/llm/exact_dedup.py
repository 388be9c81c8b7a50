"""Exact dedup through an extendible-hash index on shared files.

A text's key is a 64-bit hash of its normalised form. Texts with one key are chained
and told apart by their bytes; a directory that doubles where buckets are overfull
gives each bucket its key range; owner tasks hold contiguous ranges and write them to
the shared folder. Every document is looked up by the directory: a key's prefix gives its
bucket, and inside the bucket the key's chain is compared by the texts' SHA-256.

Copies are counted before anything is shuffled, so a group that holds a third of all
rows costs each map task one row. In the lookup, groups with more than 1/`heavy` of all
rows (of which there are fewer than `heavy`) are broadcast; all others have bounded size.

Cases: a null text counts as empty; an empty table gives an empty result; a null doc_id
is never smallest unless all of its group are null; rows that repeat a doc_id and its
text are copies too, of which one stays; very long texts are hashed whole, and shuffled once
for each task that has them; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, renamed, stored

#: Bits of a key that the directory can use: it never has more than 65,536 entries.
MAX_DEPTH = 16
#: Keys of a bucket, beyond which it splits while there are bits.
CAPACITY = 10_000


class Index(NamedTuple):
    """Two tables in the shared folder: bucket, depth, key, sha, keep_id, copies for each
    different text; prefix, bucket, depth."""

    texts: DataFrame
    directory: DataFrame


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    out = docs.withColumn("__norm", normalised(F.col(text)))
    return out.withColumn("__key", F.xxhash64("__norm")).withColumn("__sha", F.unhex(F.sha2("__norm", 256)))


def split_directory(counts: dict[int, int], capacity: int, depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Buckets (first prefix, last prefix, local depth) after doubling from one bucket
    until none holds more than `capacity` keys or the prefix bits are used up."""
    level = [counts.get(p, 0) for p in range(1 << depth)]
    sums = [level]
    while len(level) > 1:
        level = [level[i] + level[i + 1] for i in range(0, len(level), 2)]
        sums.append(level)
    sums.reverse()
    done, todo = [], [(0, 0)]
    while todo:
        d, p = todo.pop()
        if sums[d][p] > capacity and d < depth:
            todo += [(d + 1, 2 * p + 1), (d + 1, 2 * p)]
        else:
            done.append((p << (depth - d), ((p + 1) << (depth - d)) - 1, d))
    return done


def prefix(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH).cast("int")


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> Index:
    """The index, written to the shared folder in ranges of buckets and keys."""
    spark = docs.sparkSession
    chains = (
        _keyed(docs.select(text, doc_id), text)
        .groupBy("__key", "__norm")  # equal keys are chained; bytes tell them apart
        .agg(F.min(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("copies"))
        .select(
            F.col("__key").alias("key"),
            F.unhex(F.sha2("__norm", 256)).alias("sha"),
            "keep_id",
            "copies",
            prefix(F.col("__key")).alias("prefix"),
        )
    )
    chains = stored(chains, "dedup-chains")
    counts = {r["prefix"]: r["count"] for r in chains.groupBy("prefix").count().collect()}  # at most 2 ** MAX_DEPTH rows
    buckets = split_directory(counts, capacity)
    directory = spark.createDataFrame(
        [(p, first, depth) for first, last, depth in buckets for p in range(first, last + 1) if p in counts],
        "prefix int, bucket int, depth int",
    )
    owned = chains.join(F.broadcast(directory), "prefix").drop("prefix")
    texts = stored(owned.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "dedup-index")
    return Index(texts, stored(directory.coalesce(1), "dedup-directory"))


def look_up(docs: DataFrame, index: Index, text: str = "text", doc_id: str = "doc_id", heavy: int = 1000) -> DataFrame:
    """`docs` with __keep, __copies, __kept and __sha from the index."""
    total = index.texts.agg(F.sum("copies")).first()[0] or 0
    named = index.texts.select(F.col("bucket").alias("__b2"), F.col("key").alias("__k"), F.col("sha").alias("__s"), F.col("keep_id"), F.col("copies"))
    large = F.col("copies") * heavy > F.lit(total)
    hot = named.where(large).select("__k", "__s", F.col("keep_id").alias("__hot_keep"), F.col("copies").alias("__hot_copies"))
    cold = named.where(~large).select("__b2", F.col("__k").alias("__k2"), F.col("__s").alias("__s2"), F.col("keep_id").alias("__cold_keep"), F.col("copies").alias("__cold_copies"))
    keyed = _keyed(docs, text).drop("__norm").withColumn("__p1", prefix(F.col("__key")))
    directory = index.directory.select(F.col("prefix").alias("__p2"), F.col("bucket").alias("__b1"))  # at most 2 ** MAX_DEPTH rows
    keyed = keyed.join(F.broadcast(directory), F.col("__p1") == F.col("__p2"), "left").drop("__p1", "__p2")
    found = keyed.join(F.broadcast(hot), (F.col("__key") == F.col("__k")) & (F.col("__sha") == F.col("__s")), "left")
    is_hot = F.col("__hot_copies").isNotNull()
    # A hot row needs no more: it goes wherever its doc_id hashes to, where nothing has a null sha.
    found = found.withColumn("__k1", F.when(is_hot, F.xxhash64(doc_id, F.lit(7))).otherwise(F.col("__key")))
    found = found.withColumn("__s1", F.when(is_hot, F.lit(None).cast("binary")).otherwise(F.col("__sha")))
    found = found.join(cold, (F.col("__b1") == F.col("__b2")) & (F.col("__k1") == F.col("__k2")) & (F.col("__s1") == F.col("__s2")), "left")
    found = found.withColumn("__keep", F.when(is_hot, F.col("__hot_keep")).otherwise(F.col("__cold_keep")))
    found = found.withColumn("__copies", F.when(is_hot, F.col("__hot_copies")).otherwise(F.col("__cold_copies")))
    found = found.withColumn("__kept", F.col(doc_id).eqNullSafe(F.col("__keep")))
    found = found.drop("__b1", "__b2", "__k", "__s", "__k1", "__s1", "__k2", "__s2", "__hot_keep", "__hot_copies", "__cold_keep", "__cold_copies")
    repeated = docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return found
    # Rows that share doc_id and text: the first of them in storage order stays.
    found = stored(found.withColumn("__row", F.monotonically_increasing_id()), "dedup-rows")
    first = found.where("__kept").groupBy(F.col("__key").alias("__k"), F.col("__sha").alias("__s")).agg(F.min("__row").alias("__first"))
    first = first.select("__first")
    one = found.join(first, F.col("__row") == F.col("__first"), "left")
    return one.withColumn("__kept", F.col("__first").isNotNull()).drop("__first", "__row")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = look_up(docs.select(text, doc_id), build_index(docs, text, doc_id, capacity), text, doc_id)
    return found.select(
        F.col(doc_id).alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__copies").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def first_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    plain, names, (t, i) = renamed(docs, text, doc_id)
    return look_up(plain, build_index(plain, t, i, capacity), t, i).where("__kept").select(*names).toDF(*docs.columns)
