"""Mixing sources to target weights.

Each source's documents are laid end to end and cut into blocks of a fixed number of
words. The mix is a list of slots, dealt over output shards; each slot draws a source,
without replacement from the sources' quotas (so a shard's counts are multinomial given
the totals, and the totals are exact), and within its source the slot's index goes
through a pseudorandom permutation of the source's blocks, epoch by epoch, so that no
block is used more often than `most` times. Slots and blocks are joined by index.

Positions of documents within a source are sums over (source, part) first and within a
part second, with parts by a hash of doc_id, so a source that holds a third of all rows
is dealt over all tasks. Only the table of sources (one row each) meets in one task.

Cases: a null or blank text has size 0, takes part in no block and is taken 0 times; a very
long text lies in many blocks; a null source is a source of its own, last in order; rows
that repeat a doc_id each have their own position and takings; an empty table gives an empty
result. Other columns of the documents, whatever their names, are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, stored

#: Words of a block, slots of an output shard.
BLOCK = 128
SHARD = 4096
#: How often a word may be used at most.
MOST = 3
#: Documents of a (source, part) pair meet in one task; at 10,000 parts that is a ten-thousandth of a source.
PARTS = 10_000
SEED = 20


def keyed(source: Column) -> Column:
    """A key that is never null and differs for each source."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), keyed(F.col(source)).alias("skey"), size.alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """One row per source: skey, place, source_size, weight, target.

    With r = most * size / weight, the sources that stop at their limit are those of
    least r; going through them in that order, the share of weight of the others is
    what is left of the total for each unit of weight left.
    """
    each = sized.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))
    each = each.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int")))
    ratio = Window.orderBy(F.col("source_size") * most / F.col("weight"), "place")
    whole = Window.partitionBy()
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    units = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    each = each.withColumn("level", left / units).withColumn("full", F.col("source_size") * most <= F.col("level") * F.col("weight"))
    # The first that does not stop there has the greatest level of those that do not.
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    target = F.when(F.col("full"), F.col("source_size") * F.lit(float(most))).otherwise(level * F.col("weight"))
    return each.select("skey", "place", "source_size", "weight", target.alias("target"))


def laid(rows: DataFrame, sized: DataFrame, parts: int = PARTS) -> DataFrame:
    """`rows` (skey, doc_id, size and more) of size over 0 with `at`, the position of
    their first word within their source."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(parts)).cast("int")
    by_part = sized.where("size > 0").groupBy("skey", part.alias("part")).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("skey", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("__before"))
    inside = Window.partitionBy("skey", "part").orderBy("doc_id", "size", *(["text"] if "text" in rows.columns else [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.where("size > 0").withColumn("part", part)
    rows = rows.withColumn("__inner", F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("bigint"))
    rows = rows.join(by_part.hint("merge"), ["skey", "part"]).withColumn("at", F.col("__before") + F.col("__inner"))
    return rows.drop("part", "__before", "__inner")


def permuted(i: Column, n: Column, key: Column, rounds: int = 32) -> Column:
    """The place of i in a pseudorandom permutation of 0 .. n-1: in each round a place
    and its partner (their sum is the round's key, modulo n) both stay or both swap."""

    def turn(x, r):
        def swapped(partner):
            return F.when(F.xxhash64(F.greatest(x, partner), key, r, F.lit("bit")) % 2 == 0, partner).otherwise(x)

        return let(F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n), swapped)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, turn)


def slots(plan: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix: one row per slot with (shard, slot, skey, epoch, block).

    Spark takes the rows that a sequence makes for as few as it is made from; joins with
    slots ask for a merge, or all slots would be broadcast.
    """
    plan = plan.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
    # A block holds source_size / blocks words on average.
    quota = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint")
    plan = plan.withColumn("quota", F.least(quota, F.col("blocks") * most))
    running = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("first", F.coalesce(F.sum("quota").over(running), F.lit(0)).cast("bigint"))
    plan = plan.withColumn("total", F.sum("quota").over(Window.partitionBy()))
    # A source's slots are made in runs, so that no task makes all of a large source's.
    run = 4096
    kept = ["skey", "blocks", "first", "total", "quota"]
    each = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / run))
    # A number that grows with the runs, so that they are dealt over tasks and stay so.
    tasks = 1 + (plan.agg(F.sum("quota")).first()[0] or 0) // (16 * run)
    runs = plan.where("quota > 0").select(*kept, F.explode(each).alias("run")).repartition(tasks, "skey", "run")
    each = F.sequence(F.col("run") * run, F.least(F.col("run") * run + run, F.col("quota")) - 1)
    each = runs.select(*kept, F.explode(each).alias("k")).withColumn("epoch", F.floor(F.col("k") / F.col("blocks")))
    out = each.select(
        "skey",
        "epoch",
        permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.xxhash64("skey", "epoch", F.lit(seed))).alias("block"),
        # Which slot of the mix draws this one: the shards' shares of a source are random.
        permuted(F.col("first") + F.col("k"), F.col("total"), F.lit(seed).cast("bigint")).alias("slot"),
    )
    return out.select(F.floor(F.col("slot") / shard).alias("shard"), "slot", "skey", "epoch", "block")


def span(block: Column, size: int) -> tuple[Column, Column]:
    """First and one past the last word of the document that a block holds."""
    start = F.greatest(block * size, F.col("at")) - F.col("at")
    return start, F.least(block * size + size, F.col("at") + F.col("size")) - F.col("at")


def blocks_of(size: int) -> Column:
    return F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("size") - 1) / size))


def filled(plan: DataFrame, cuts: DataFrame, block: int, shard: int, most: int, seed: int) -> DataFrame:
    """Slots of the mix, each with `all`, the pieces of its block in order: (at, and what
    else `cuts` has beside skey and block)."""
    # Every piece has a word, so a block has at most `block` of them.
    pieces = F.struct(*[c for c in cuts.columns if c not in ("skey", "block")])
    whole = cuts.groupBy("skey", "block").agg(F.array_sort(F.collect_list(pieces)).alias("all"))
    return slots(plan, block, shard, most, seed).hint("merge").join(whole, ["skey", "block"])


def mix(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    block: int = BLOCK,
    shard: int = SHARD,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """The mixed corpus, one row per slot: shard, slot, source, epoch, block, doc_ids,
    n_words, text (the words with one space between)."""
    sized = stored(sizes(docs, text, doc_id, source), "mix-sizes")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), keyed(F.col(source)).alias("skey"), F.col(text).alias("text"))
    rows = laid(rows.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")), sized)

    def cut(words):
        def piece(b):
            start, stop = span(b, block)
            return F.struct(b.alias("block"), (stop - start).alias("n"), F.array_join(F.slice(words, (start + 1).cast("int"), (stop - start).cast("int")), " ").alias("piece"))

        return F.transform(blocks_of(block), piece)

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    cuts = rows.select("skey", "at", "doc_id", "source", F.inline(let(words, cut)))
    out = filled(targets(sized, weights, most), cuts, block, shard, most, seed)
    return out.select(
        "shard",
        "slot",
        F.get("all.source", F.lit(0)).alias("source"),
        "epoch",
        "block",
        F.col("all.doc_id").alias("doc_ids"),
        F.aggregate("all.n", F.lit(0).cast("bigint"), lambda t, n: t + n).alias("n_words"),
        F.array_join("all.piece", " ").alias("text"),
    )


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, shard: int = SHARD, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, and taken,
    the words of it that the mix's slots hold. The slots and their blocks are those of
    `mix`, with pieces' sizes in place of their words."""
    sized = stored(sizes(docs), "mix-sizes")
    plan = targets(sized, weights, most)
    rows = laid(sized.drop("source"), sized)
    start, stop = span(F.col("block"), block)
    cuts = rows.withColumn("block", F.explode(blocks_of(block))).select("skey", "block", "at", "doc_id", "size", (stop - start).alias("n"))
    held = filled(plan, cuts, block, shard, most, seed).select("skey", F.inline("all"))
    held = held.select("skey", "doc_id", "at", "size", F.col("n").alias("taken"))
    # Documents that no slot holds have a row, too.
    held = held.unionByName(rows.select("skey", "doc_id", "at", "size", F.lit(0).cast("bigint").alias("taken")))
    taken = held.groupBy("skey", "doc_id", "at", "size").agg(F.sum("taken").alias("taken"))
    every = taken.drop("at").unionByName(sized.where("size = 0").select("skey", "doc_id", "size", F.lit(0).cast("bigint").alias("taken")))
    return every.join(plan.drop("place", "weight"), "skey").select("doc_id", "size", "source_size", "target", "taken")
