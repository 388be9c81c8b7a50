"""Conversation prefix trie by distributed MSD radix partitioning.

Turns are encoded by a dictionary of the different ones, and equal conversations are one
sequence of ids with a weight. All sequences start in the root's bucket. Each round deals a
bucket that is too large for one task by the next turn's id: each new bucket is a node. A
bucket of at most `LOCAL` turns is finished by multikey quicksort in one task, which emits its
nodes with their totals; a longer sequence that is alone in its bucket is a path, and its
nodes come straight from its rows. Totals of the dealt nodes are summed up from the deepest.

Sequences are kept in blocks of `BLOCK` turns and carried by one block, so that no row grows
with a conversation. A turn or a bucket that a third of all rows share is joined by broadcast
(only keys with over 1/`HEAVY` of the rows are, which are fewer than `HEAVY`), and counts are
summed before they are shuffled. The digest of the conversations that end at a node needs all
their ids in order: they are joined in chunks of 512 ids, and a task reads one node's chunks
as a stream.

Rounds are as many as the turns that a bucket of over `LOCAL` turns shares.

Cases: a null conv_id is dropped; turns are ordered by turn (null first), role, text, and rows
that repeat are turns; a null role or text is an empty one; turns are told apart by the SHA-256
of both; an empty table gives an empty result; very long texts are hashed where they are read;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import starts_of
from .common import WORD, stored

#: Turns of a bucket that one task finishes, turns of a block, keys that may be broadcast.
LOCAL, BLOCK, HEAVY = 100_000, 256, 1000
#: Turns that a task of local buckets has, on average.
TASK = 200_000
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, top boolean"


def numbered(turns: DataFrame) -> DataFrame:
    """conv, at (1 for a conversation's first turn), said (a digest), words.

    Turns are numbered inside blocks of turn numbers, and blocks by their counts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv"), "turn", role.alias("role"), text.alias("text")).where("conv IS NOT NULL")
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).cast("bigint")
    rows = rows.withColumn("block", block).withColumn("said", said).withColumn("words", F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("bigint"))
    counts = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("inner", F.row_number().over(order)).join(counts, ["conv", "block"])
    return rows.select("conv", (F.col("first") + F.col("inner")).alias("at"), "said", "words")


def branched(turns: DataFrame, each: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv), (conv, at, said, words): every conversation takes the first h turns of the first
    of its run of `each` ids, then its own after its first h; h is a hash of its id."""
    rows = stored(numbered(turns), "trie-turns")
    convs = rows.select("conv").distinct()
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    wanted = convs.select("conv", h, (F.col("conv") - F.col("conv") % each).alias("base")).where("h > 0")
    heads = rows.where((F.col("at") < most) & (F.col("conv") % each == 0)).withColumnRenamed("conv", "base")
    heads = wanted.join(heads, "base").where("at <= h").select("conv", "at", "said", "words")
    given = heads.groupBy("conv").agg(F.count(F.lit(1)).alias("given"))
    own = rows.withColumn("h", h).where("at > h").join(given, "conv", "left")
    own = own.select("conv", (F.col("at") - F.col("h") + F.coalesce("given", F.lit(0))).alias("at"), "said", "words")
    return convs, heads.unionByName(own)


def dealt(left: DataFrame, right: DataFrame, keys: list[str], uses: str, total: int) -> DataFrame:
    """The inner join of `left` and `right`, which is unique in `keys`; `uses` says how many rows
    of `left` each key has. Keys with many of them are broadcast."""
    heavy = F.col(uses) * HEAVY > total
    hot = F.broadcast(right.where(heavy))  # fewer than HEAVY rows
    cold = left.join(F.broadcast(right.where(heavy).select(*keys)), keys, "left_anti").join(right.where(~heavy), keys)
    return left.join(hot, keys).unionByName(cold)


def encoded(turns: DataFrame) -> DataFrame:
    """conv, block, ids, words (arrays of the block's turns), k1, k2 (hashes of the block)."""
    turns = stored(turns, "trie-rebuilt")
    dictionary = turns.groupBy("said").agg(F.count(F.lit(1)).alias("uses"))
    dictionary = stored(dictionary.withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    rows = dealt(turns, dictionary, ["said"], "uses", turns.count())
    lanes = [F.bit_xor(F.xxhash64("at", "id")).alias("k1"), F.bit_xor(F.xxhash64("id", "at", F.lit(1))).alias("k2")]
    block = F.floor((F.col("at") - 1) / BLOCK).cast("bigint").alias("block")
    rows = rows.groupBy("conv", block).agg(F.array_sort(F.collect_list(F.struct("at", "id", "words"))).alias("all"), *lanes)
    return stored(rows.select("conv", "block", F.col("all.id").alias("ids"), F.col("all.words").alias("words"), "k1", "k2"), "trie-blocks")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, sha) of rows (rep, part, ids) sorted by both, each rep's rows in one stream."""
    now, held = None, None
    out: list[tuple[int, str]] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], names=["rep", "sha"])

    for batch in batches:
        for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if held is None or rep != now:
                if held is not None:
                    out.append((now, held.hexdigest()))
                now, held = rep, hashlib.sha256(ids.encode())
            else:
                held.update(b"," + ids.encode())
        yield made()
        out.clear()
    if held is not None:
        out.append((now, held.hexdigest()))
        yield made()


def sequences(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """rep (the smallest of equal conversations), weight (how many are equal), k (turns), sha."""
    whole = blocks.groupBy("conv").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum(F.size("ids")).alias("k"))
    zero = F.lit(0).cast("bigint")
    members = convs.join(whole, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in ("k", "k1", "k2")])
    chunk = F.call_function("shiftright", F.col("conv"), F.lit(9)).alias("part")
    chunks = members.groupBy("k", "k1", "k2", chunk).agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    chunks = stored(chunks, "trie-members")
    groups = chunks.groupBy("k", "k1", "k2").agg(F.min("first").alias("rep"), F.sum("n").alias("weight"), F.count(F.lit(1)).alias("parts"), F.min("ids").alias("ids"))
    groups = stored(groups, "trie-groups")
    one = groups.where("parts = 1").select("rep", "weight", "k", F.sha2("ids", 256).alias("sha"))
    many = groups.where("parts > 1")
    pieces = chunks.select("k", "k1", "k2", "part", "ids").join(many.select("k", "k1", "k2", "rep"), ["k", "k1", "k2"]).select("rep", "part", "ids")
    shas = pieces.repartition("rep").sortWithinPartitions("rep", "part").mapInArrow(_digests, "rep long, sha string")
    return stored(one.unionByName(many.select("rep", "weight", "k").join(shas, "rep")), "trie-sequences")


def finished(members: list[tuple[int, int, list[int], list[int]]], depth: int, parent: int | None, words: int) -> list[list]:
    """The nodes of a bucket by multikey quicksort: members are (conv, weight, ids, words) of what
    follows the bucket's node, which is at `depth`, has that parent, and ends in a turn of `words`."""
    nodes: list[list] = []

    def node(group: list[int], depth: int, above: int, words: int, at: int) -> int:
        convs = [members[m][0] for m in group]
        weight = sum(members[m][1] for m in group)
        ends = [c for c, m in zip(convs, group, strict=True) if len(members[m][2]) == at]
        up = parent if above < 0 else nodes[above][0]
        nodes.append([min(convs), depth, up, weight, 0, 0, (weight - 1) * words, ends[0] if ends else None, above < 0, above])
        return len(nodes) - 1

    every = list(range(len(members)))
    todo = [(every, 0, node(every, depth, -1, words, 0))]
    while todo:
        group, at, above = todo.pop()
        group = [m for m in group if len(members[m][2]) > at]
        if not group:
            continue
        pivot = members[group[len(group) // 2]][2][at]
        less, equal, more = [], [], []
        for m in group:
            x = members[m][2][at]
            (less if x < pivot else equal if x == pivot else more).append(m)
        if less:
            todo.append((less, at, above))
        if more:
            todo.append((more, at, above))
        todo.append((equal, at + 1, node(equal, depth + at + 1, above, members[equal[0]][3][at], at + 1)))
    for n in reversed(nodes):  # parents stand before their children
        n[5] = n[5] or 1
        if n[9] >= 0:
            up = nodes[n[9]]
            up[4] += 1
            up[5] += n[5]
            up[6] += n[6]
    return [n[:9] for n in nodes]


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kid, depth, parent, w, conv, weight, block, ids, words), sorted by kid, conv, block."""
    names, types = zip(*[c.split() for c in NODES.split(", ")], strict=True)
    kinds = [pa.bool_() if t == "boolean" else pa.int64() for t in types]
    out: list[list] = []

    def made() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for (_, depth, parent, w), bucket in groupby(rows, lambda r: r[:4]):
        members = []
        for (conv, weight), blocks in groupby(bucket, lambda r: r[4:6]):
            ids, words = [], []
            for b in blocks:
                skip = max(0, depth - b[6] * BLOCK)
                ids += (b[7] or [])[skip:]
                words += (b[8] or [])[skip:]
            members.append((conv, weight, ids, words))
        out += finished(members, depth, parent, w)
        if len(out) > 50_000:
            yield made()
            out.clear()
    yield made()


def _paths(moved: DataFrame, blocks: DataFrame, depth: int) -> DataFrame:
    """Nodes of sequences that are alone in their buckets, which are at `depth`."""
    rows = moved.select("conv", "weight", "k", "parent").join(blocks.where(F.col("block") >= (depth - 1) // BLOCK), "conv")
    after = Window.partitionBy("conv").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("sum", F.aggregate("words", F.lit(0).cast("bigint"), lambda s, x: s + x))
    rows = rows.withColumn("rest", F.col("sum") + F.coalesce(F.sum("sum").over(after), F.lit(0)))
    rows = rows.select("*", F.posexplode(starts_of(F.col("words"))).alias("i", "before")).withColumn("depth", F.col("block") * BLOCK + F.col("i") + 1).where(F.col("depth") >= depth)
    first, last = F.col("depth") == depth, F.col("depth") == F.col("k")
    return rows.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(first, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("rest") - F.col("before"))).alias("saved_tokens"),
        F.when(last, F.col("conv")).alias("end_rep"),
        first.alias("top"),
    )


def trie(convs: DataFrame, turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes, one row each, of conversations (conv) with turns (conv, at, said, words)."""
    spark = convs.sparkSession
    blocks = encoded(turns)
    reps = sequences(convs, blocks)
    blocks = blocks.select("conv", "block", "ids", "words")
    kept = blocks.join(reps.where("k > 0").select(F.col("rep").alias("conv")), "conv", "left_semi")
    blocks = stored(kept, "trie-kept")
    root = reps.agg(F.min("rep"), F.sum("weight"), F.sum("k"), F.count(F.lit(1)), F.min(F.when(F.col("k") == 0, F.col("rep")))).first()
    none = spark.createDataFrame([], NODES)
    if not root[3]:
        return with_ends(none, reps)
    first = blocks.where("block = 0").select("conv", "ids", "words")
    moved = reps.select(F.col("rep").alias("conv"), "weight", "k").join(first, "conv", "left")
    moved = moved.withColumn("kid", F.lit(root[0])).withColumn("parent", F.lit(None).cast("bigint")).withColumn("w", F.lit(0).cast("bigint"))
    large = root[2] > local
    kids = spark.createDataFrame([(root[0], None, root[1], 0, root[4])], "kid long, parent long, n_convs long, w long, end_rep long")
    here, depth = moved, 0
    levels, pieces, paths = [], [] if large else [local_rows(moved, blocks, 0)], []
    size = 0 if large else root[2]
    while large:
        levels.append(kids)
        # The bucket's sequences that go on, dealt by their next turn.
        if depth and depth % BLOCK == 0:
            here = here.drop("ids", "words").join(blocks.where(F.col("block") == depth // BLOCK).drop("block"), "conv")
        at = F.lit(depth % BLOCK)
        going = here.where(F.col("k") > depth).select("conv", "weight", "k", "ids", "words", F.col("kid").alias("parent"), F.get("ids", at).alias("id"), F.get("words", at).alias("w"))
        depth += 1
        made = going.groupBy("parent", "id").agg(
            F.min("conv").alias("kid"), F.sum("weight").alias("n_convs"), F.max("w").alias("w"), F.min(F.when(F.col("k") == depth, F.col("conv"))).alias("end_rep"),
            F.count(F.lit(1)).alias("n"), F.sum(F.col("k") - depth).alias("turns"),
        )
        made = stored(made.withColumn("fate", F.when(F.col("turns") <= local, "local").when(F.col("n") == 1, "path").otherwise("large")), "trie-nodes")
        total = made.groupBy("fate").agg(F.sum("n").alias("n"), F.sum("turns").alias("turns")).collect()  # three rows at most
        total = {r["fate"]: (r["n"], r["turns"]) for r in total}
        moved = stored(dealt(going, made.select("parent", "id", "kid", "fate", "n"), ["parent", "id"], "n", sum(n for n, _ in total.values())), "trie-dealt")
        if "local" in total:
            pieces.append(local_rows(moved.where("fate = 'local'"), blocks, depth))
            size += total["local"][1]
        if "path" in total:
            paths.append(_paths(moved.where("fate = 'path'"), blocks, depth))
        large = "large" in total
        kids, here = made.where("fate = 'large'").select("kid", "parent", "n_convs", "w", "end_rep"), moved.where("fate = 'large'")
    nodes = none
    if pieces:
        rows = pieces[0]
        for p in pieces[1:]:
            rows = rows.unionByName(p)
        rows = rows.repartition(size // TASK + 1, "kid").sortWithinPartitions("kid", "conv", "block")
        nodes = rows.mapInArrow(_finish, NODES)
    for p in paths:
        nodes = nodes.unionByName(p)
    nodes = stored(nodes, "trie-finished")
    return with_ends(summed(nodes, levels), reps)


def local_rows(moved: DataFrame, blocks: DataFrame, depth: int) -> DataFrame:
    """The rows of buckets at `depth` that one task finishes each: what is left of the block
    that their sequences are in, and the blocks after it."""
    # At a block's end the sequences still carry the block before, of which nothing is left.
    carried = max(0, (depth - 1) // BLOCK)
    rows = moved.select("kid", F.lit(depth).cast("bigint").alias("depth"), "parent", "w", "conv", "weight", "k", "ids", "words")
    now = rows.withColumn("block", F.lit(carried).cast("bigint"))
    more = rows.where(F.col("k") > (carried + 1) * BLOCK).drop("ids", "words").join(blocks.where(F.col("block") > carried), "conv")
    columns = ["kid", "depth", "parent", "w", "conv", "weight", "block", "ids", "words"]
    return now.select(*columns).unionByName(more.select(*columns))


def summed(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """`nodes` with those of the levels that were dealt, from the deepest to the root."""
    below = nodes.where("top")
    for depth in reversed(range(len(levels))):
        tops = below.where(F.col("depth") == depth + 1).groupBy(F.col("parent_conv_id").alias("kid"))
        tops = tops.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        level = levels[depth].join(tops, "kid").select(
            F.col("kid").alias("conv_id"),
            F.lit(depth).cast("bigint").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            (F.col("saved") + (F.col("n_convs") - 1) * F.col("w")).alias("saved_tokens"),
            "end_rep",
            F.lit(True).alias("top"),
        )
        level = stored(level, "trie-level")
        nodes, below = nodes.unionByName(level), below.unionByName(level)
    return nodes


def with_ends(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    columns = [c.split()[0] for c in NODES.split(", ")][:7]
    ended = nodes.where("end_rep IS NOT NULL").join(reps.select(F.col("rep").alias("end_rep"), F.col("sha").alias("ends_sha256")), "end_rep")
    passed = nodes.where("end_rep IS NULL").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return ended.select(*columns, "ends_sha256").unionByName(passed.select(*columns, "ends_sha256"))


def prefix_trie(turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text), branched: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(*branched(turns), local)
