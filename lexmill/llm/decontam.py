"""Benchmark decontamination by spaced-seed hashing.

Each mask is slid over the tokens of test and training texts, and the tokens that it looks
at are hashed; a substituted token spoils only the masks that look at it. Hashes of both
are joined; a hit fixes how the two texts lie over each other, and around it the tokens
are compared one by one, substitutions allowed.

A test text is found in a document if, with the texts so laid, some `LEAST` tokens in a row
(or the whole of a shorter test text) have at least `SAME` of them equal. The masks are
chosen so that none is missed: wherever two of 13 tokens in a row are substituted, a mask
fits between them. A shorter test text is cut into one part more than it may have
substitutions, so that one part is whole; masks of the parts' lengths are slid over the
documents, only if there are such test texts.

Test hashes are broadcast while there are at most `FEW`; beyond that both sides are shuffled
by hash. Documents that have hits are read again to compare tokens, found by a broadcast of
their ids while there are at most `FEW` hits, or by a shuffle.

Cases: null and empty texts have no tokens and match nothing; very long texts are searched
whole; rows that repeat a doc_id or item_id are compared each and reported once; a null
doc_id or item_id is never reported, but `clean` looks at texts only, so their rows count
there; an empty table on either side gives an empty result; other columns, whatever their
names, are not read, and kept by `clean`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, renamed, stored

#: The tokens that a mask looks at (1) and ignores (0). Together they fit all 78 ways to
#: substitute two of 13 tokens.
MASKS = ("1111111", "1101111", "110010111")
#: Tokens in a row, and the share of them that must be equal.
LEAST, SAME = 13, 0.8
#: Test hashes, and hits, up to which they are broadcast (24 bytes each).
FEW = 500_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def windows(h: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """What the masks see at each place of an array of token hashes: array of (at, hash)."""
    seen = []
    for number, mask in enumerate(masks):
        looks = [k for k, c in enumerate(mask) if c == "1"]
        places = F.sequence(F.lit(0), F.size(h) - len(mask))
        each = F.transform(places, lambda i: seen_at(h, i, number, looks))  # noqa: B023
        seen.append(F.when(F.size(h) >= len(mask), each).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>")))
    return F.concat(*seen)


def seen_at(h: Column, i: Column, number: int, looks: list[int]) -> Column:
    return F.struct(i.alias("at"), F.xxhash64(F.lit(number), *[F.get(h, i + k) for k in looks]).alias("hash"))


def cuts(n: int, same: float) -> list[tuple[int, int]]:
    """(start, length) of the parts of a short test text of n tokens."""
    parts = n - math.ceil(n * same - 1e-9) + 1
    edges = [n * k // parts for k in range(parts + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]


def short_seeds(h: Column, lengths: list[int], same: float) -> Column:
    """The parts of a short test text, hashed as masks of ones: array of (at, hash)."""
    out = F.array().cast("array<struct<at:int,hash:bigint>>")
    for n in lengths:
        parts = F.array(*[seen_at(h, F.lit(at), -size, list(range(size))) for at, size in cuts(n, same)])
        out = F.when(F.size(h) == n, parts).otherwise(out)
    return out


def short_windows(h: Column, lengths: list[int], same: float) -> list[Column]:
    """Arrays of (at, hash) for each length of a part, slid over a document's tokens."""
    out = []
    for size in sorted({size for n in lengths for _, size in cuts(n, same)}):
        each = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: seen_at(h, i, -size, list(range(size))))  # noqa: B023
        out.append(F.when(F.size(h) >= size, each).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>")))
    return out


def equal_run(x: Column, y: Column, least: Column, same: float = SAME) -> Column:
    """Whether of some `least` elements in a row at least `same` are equal in both."""
    equal = F.zip_with(x, y, lambda a, b: (a == b).cast("int"))

    def any_run(e):
        starts = F.sequence(F.lit(1), F.size(e) - least + 1)
        return F.exists(starts, lambda i: F.aggregate(F.slice(e, i, least), F.lit(0), lambda t, v: t + v) >= least * same)

    return let(equal, lambda e: F.when(F.size(e) >= least, any_run(e)).otherwise(False))


def contaminated(
    docs: DataFrame,
    tests: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    test_text: str = "text",
    item_id: str = "item_id",
    least: int = LEAST,
    same: float = SAME,
) -> DataFrame:
    """One row per document and test text found in it: doc_id, item_id, n_equal (tokens
    equal as laid best) and n_tokens (of the test text)."""
    items = tests.select(F.col(item_id).alias("item"), hashed(F.col(test_text)).alias("t")).where("item IS NOT NULL")
    items = stored(items.dropDuplicates(["item", "t"]).withColumn("len", F.size("t")), "decontam-items")
    rows = docs.select(F.col(doc_id).alias("row"), hashed(F.col(text)).alias("h")).where(F.col("row").isNotNull())

    # At most least - 1 lengths.
    lengths = sorted(r["len"] for r in items.where(F.col("len").between(1, least - 1)).select("len").distinct().collect())
    long_seeds = F.when(F.col("len") >= least, windows(F.col("t"))).otherwise(short_seeds(F.col("t"), lengths, same))
    seeds = items.select("item", "len", F.inline(long_seeds)).withColumnRenamed("at", "t_at").distinct()
    seeds = stored(seeds, "decontam-seeds")
    few = seeds.limit(FEW + 1).count() <= FEW
    places = F.concat(windows(F.col("h")), *short_windows(F.col("h"), lengths, same))
    found = rows.select("row", F.inline(places)).join(F.broadcast(seeds) if few else seeds, "hash")
    hits = found.select("row", "item", "len", (F.col("at") - F.col("t_at")).alias("shift")).distinct()
    hits = stored(hits, "decontam-hits")
    few = hits.limit(FEW + 1).count() <= FEW
    by_row = hits.groupBy(F.col("row").alias("__row")).agg(F.collect_set(F.struct("item", "len", "shift")).alias("hits"))
    both = rows.join(F.broadcast(by_row) if few else by_row, F.col("row") == F.col("__row"))

    def laid(hit):
        first = F.greatest(hit["shift"], F.lit(0))
        stop = F.least(hit["shift"] + hit["len"], F.size("h"))
        return F.struct(hit["item"].alias("item"), (first - hit["shift"]).alias("skip"), F.slice("h", first + 1, F.greatest(stop - first, F.lit(0))).alias("part"))

    parts = both.select("row", F.inline(F.transform("hits", laid)))
    compared = parts.join(items, "item").withColumn("__t", F.slice("t", F.col("skip") + 1, F.size("part")))
    compared = compared.where(equal_run(F.col("part"), F.col("__t"), F.least(F.lit(least), F.col("len")), same))
    n_equal = F.aggregate(F.zip_with("part", "__t", lambda a, b: (a == b).cast("bigint")), F.lit(0).cast("bigint"), lambda t, v: t + v)
    out = compared.groupBy(F.col("row").alias("doc_id"), F.col("item").alias("item_id"))
    return out.agg(F.max(n_equal).alias("n_equal"), F.max(F.col("len").cast("bigint")).alias("n_tokens"))


def clean(docs: DataFrame, tests: DataFrame, text: str = "text", **kinds) -> DataFrame:
    """The rows of `docs` in which no test text is found, with all their columns."""
    plain, names, (t,) = renamed(docs, text)
    # A text's two hashes stand for its rows, whatever their ids; so for test texts.
    whole = plain.withColumn("k1", F.xxhash64(t)).withColumn("k2", F.xxhash64(t, F.lit(1)))
    kinds = {"test_text": "text"} | kinds
    asked = tests.select(F.xxhash64(kinds["test_text"]).alias("item"), F.col(kinds["test_text"]).alias("said"))
    rows = whole.select(F.struct("k1", "k2").alias("key"), t)
    found = contaminated(rows, asked, t, "key", **kinds | {"test_text": "said", "item_id": "item"})
    found = found.select(F.col("doc_id.k1").alias("f1"), F.col("doc_id.k2").alias("f2")).distinct()
    return whole.join(found, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left_anti").select(*names).toDF(*docs.columns)
