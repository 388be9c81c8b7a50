"""N-gram Jaccard join by parity sketches, exact, and the components of its links.

A document's set is its distinct word n-grams, hashed to 64 bits. Sets of similar size
share a scheme: with d the greatest symmetric difference that two linked sets of the
scheme can have, the hash space is cut into m = d + 1 + e bands, and each band's word is
the XOR of the hashes in it, so the words that differ between two sets are at most their
symmetric difference. Linked sets have e + 1 equal words at least. All words have one
order, from rare to common (ties by their value; words of empty bands last), and each set
drops its e last: of two linked sets' equal words the first is then kept by both, and a
passage that many documents share costs them only dropped words. A second sketch of 512
parity bits, whose Hamming distance is a lower bound too, rejects most pairs before the
n-grams are compared.

Sets are compared in rounds. In each, every word names two of the sets that keep it, by a
hash that changes with the round; of those that its words name in other components, a set is
compared with the one of the nearest sketch, so a round has at most one pair for each set. Copies
of one text run together in few rounds, however many they are. When a round links fewer
than `FRUITFUL` of the sets that it compares, the sets outside the largest component of a
word's group are compared with all others of the group outside their own component: the
exact end, in which nothing is left out. There, sizes and parity bits are tested inside the
join, and only pairs that they can't refute are made, under the first of their words (each
row knows its set's `EARLY` first, which tell all but a few repeats).

How common a word is, is counted by its group. A word that many sets of one batch share
would gather in one task: there, only the batch's first goes to the word's group, with the
number of all, and the others take the count by a join that Spark can split.

Cases: a null or blank text has an empty set, is linked with nothing, and is its own
component; a text of fewer than n words is one n-gram; very long texts are used whole, and
a set has words in proportion to its size; equal sets are one node, found by a digest; rows
that repeat a doc_id, with equal texts or others, are in one component with the links of
each; a null doc_id has no links and a null component; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed, slices, stored
from .components import connected_components

#: Words of an n-gram and least similarity in per cent, unless a caller has its own.
WORDS, PERCENT = 5, 80
#: Bands beyond d + 1, for each of those.
EXTRA = 0.25
#: Bits of the second sketch.
BITS = 512
#: Sets in one batch from which on a word is dealt out.
CROWD = 8
#: Rows of a word's group that are held to count them; beyond, it is as common as any.
HELD = 20_000
#: Different sets that a task remembers, so as to pass over equal ones.
SEEN = 1_000_000
#: Rounds of one pair for each set before the exact end, and the share of its sets that a
#: round must link to be followed by another.
ROUNDS, FRUITFUL = 4, 1 / 16
#: Words that a row of the exact end knows of its set.
EARLY = 8
#: Documents for which a broadcast of ids is used (8 MB); beyond it the join is shuffled.
FEW = 1_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
#: A set has id, n and sketch. A word has cut, twice the number of its set's words to drop
#: plus which of the set's two schemes it is of, and weight: how many sets of its batch the
#: row stands for, or 0 if another row stands for it.
_MEMBERS = "by long, word long, node long, id long, n int, cut int, weight int, sketch array<long>"


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * _A
        h ^= h >> np.uint64(32)
    return np.unique(h)


def most_apart(total: int, percent: int) -> int:
    """The greatest symmetric difference of two linked sets of `total` n-grams together."""
    return (100 - percent) * total // (100 + percent)


def schemes(n: int, percent: int) -> Iterator[tuple[int, int]]:
    """(scheme, d) of those that a set of n joins: that of its size, as the smaller of a
    pair, and the one before, as the larger."""
    k, low = 0, 1
    before = None
    while True:
        high = low * 100 // percent
        if n <= high:
            break
        before = (k, high)
        k, low = k + 1, high + 1
    for s, top in [(k, high)] + [before] * (before is not None):
        if n <= top * 100 // percent:
            yield s, most_apart(top + top * 100 // percent, percent)


def band_words(h: np.ndarray, scheme: int, d: int, extra: float = EXTRA) -> tuple[np.ndarray, int]:
    """A set's words in a scheme, each mixed with its band and scheme, and how many of them
    to drop beside those of empty bands."""
    m = d + 1 + int(extra * (d + 1))
    band = ((h * _B) >> np.uint64(33)) % np.uint64(m)
    order = np.argsort(band, kind="stable")
    at = band[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    mixed = h[order] * _A
    mixed ^= mixed >> np.uint64(29)
    words, kept = np.bitwise_xor.reduceat(mixed, first), at[first]
    if len(kept) <= d:  # words of empty bands are needed, too: the first ones
        empty = np.setdiff1d(np.arange(m), kept)[: d + 1 - len(kept)]
        words, kept = np.r_[words, np.zeros(len(empty), np.uint64)], np.r_[kept, empty]
    out = (words ^ np.uint64(scheme * 1000003 + 7)) * _A + (kept.astype(np.uint64) + np.uint64(1)) * _C
    return out ^ (out >> np.uint64(31)), len(out) - d - 1


def parity(h: np.ndarray) -> np.ndarray:
    """BITS bits as signed 64-bit words: how many n-grams fall on each, modulo 2."""
    odd = np.bincount(((h * _C) >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _digest(h: np.ndarray) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(h.tobytes(), 1))


def _batch(ids: list, texts: list, n: int, percent: int, seen: set[int]) -> dict[str, list]:
    nodes, sizes, sketches = [], [], []
    words, who, cuts = [], [], []
    for i, text in zip(ids, texts, strict=True):
        h = shingles(text, n)
        g = int(_digest(h))
        nodes.append(g)
        sizes.append(len(h))
        sketches.append(parity(h) if len(h) else None)
        if i is None or not len(h) or g in seen:
            continue
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(g)
        for way, (scheme, d) in enumerate(schemes(len(h), percent)):
            w, drop = band_words(h, scheme, d)
            words.append(w)
            who.append(np.full(len(w), g, np.uint64))
            cuts.append(np.full(len(w), 2 * drop + way, np.int32))
    word = np.concatenate(words) if words else np.empty(0, np.uint64)
    who = np.concatenate(who) if who else np.empty(0, np.uint64)
    cut = np.concatenate(cuts) if cuts else np.empty(0, np.int32)
    order = np.argsort(word, kind="stable")
    word, who, cut = word[order], who[order], cut[order]
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
    many = np.diff(np.r_[start, len(word)])
    weight = np.ones(len(word), np.int32)
    weight[np.repeat(many >= CROWD, many)] = 0
    weight[start] = np.where(many >= CROWD, many, 1)
    # A set, and a word that another row stands for, may go anywhere.
    by = np.where(weight > 0, word, (who * _B) ^ (word * _C))
    node = np.array(nodes, np.uint64)
    k, w = len(node), len(word)
    return {
        "by": np.concatenate([(node + np.arange(k, dtype=np.uint64)) * _C, by]).view(np.int64),
        "word": pa.array(np.concatenate([np.zeros(k, np.int64), word.view(np.int64)]), mask=np.arange(k + w) < k),
        "node": np.concatenate([node, who]).view(np.int64),
        "id": ids + [None] * w,
        "n": pa.array(np.r_[np.array(sizes, np.int32), np.zeros(w, np.int32)], mask=np.arange(k + w) >= k),
        "cut": np.r_[np.zeros(k, np.int32), cut],
        "weight": np.r_[np.zeros(k, np.int32), weight],
        "sketch": sketches + [None] * w,
    }


_ARROW = pa.schema([("by", pa.int64()), ("word", pa.int64()), ("node", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("cut", pa.int32()), ("weight", pa.int32()), ("sketch", pa.list_(pa.int64()))])


def _members(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for part in slices(b, 1):
                got = _batch(part.column(0).to_pylist(), part.column(1).to_pylist(), n, percent, seen)
                yield pa.RecordBatch.from_pydict(got, schema=_ARROW)

    return run


#: common: how many sets share a word, HELD at most; null where a join has to tell.
_FOUND = "word long, node long, id long, n int, cut int, weight int, common int, sketch array<long>"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (by, weight > 0, node): all sets, and the words that more than one
    set has. A group may go over batches, so the last of each batch waits for the next."""
    held: list[np.ndarray] | None = None  # word, node, cut, weight
    over: int | None = None  # the word of a group too large to hold

    def counted(word, node, cut, weight):
        """Complete groups, without repeated sets."""
        new = np.r_[True, (word[1:] != word[:-1])] if len(word) else np.empty(0, bool)
        fresh = new | np.r_[True, node[1:] != node[:-1]] if len(word) else new
        word, node, cut, weight, new = (x[fresh] for x in (word, node, cut, weight, new))
        start = np.flatnonzero(new)
        if not len(start):
            return None
        many = np.diff(np.r_[start, len(word)])
        common = np.repeat(np.minimum(np.add.reduceat(weight, start), HELD), many)
        shared = common > 1
        return told(*(x[shared] for x in (word, node, cut, weight, common)))

    def told(word, node, cut, weight, common):
        k = len(word)
        none = pa.nulls(k, pa.int64())
        cols = [pa.array(word), pa.array(node), none, pa.nulls(k, pa.int32()), pa.array(cut), pa.array(weight), pa.array(common.astype(np.int32)), pa.nulls(k, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=_NAMES)

    for b in batches:
        weight = b.column("weight").to_numpy()
        main = weight > 0
        if not main.all():
            rest = b.filter(pa.array(~main))
            yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in _NAMES[:6]), pa.nulls(rest.num_rows, pa.int32()), rest.column("sketch")], names=_NAMES)
        if not main.any():
            continue
        rows = [b.column(c).fill_null(0).to_numpy()[main] for c in ("word", "node", "cut", "weight")]
        if over is not None:
            same = rows[0] == over
            if same.any():
                first = [x[same] for x in rows]
                yield told(*first, np.full(len(first[0]), HELD))
                rows = [x[~same] for x in rows]
            if not len(rows[0]):
                continue
            over = None
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = np.searchsorted(rows[0] == rows[0][-1], True)
        out = counted(*(x[:last] for x in rows))
        if out is not None and out.num_rows:
            yield out
        held = [x[last:] for x in rows]
        if len(held[0]) > HELD:
            yield told(*held, np.full(len(held[0]), HELD))
            over, held = int(held[0][0]), None
    if held is not None and len(held[0]):
        out = counted(*held)
        if out is not None and out.num_rows:
            yield out


_NAMES = ["word", "node", "id", "n", "cut", "weight", "common", "sketch"]

_SETS = pa.schema([("node", pa.int64()), ("grams", pa.list_(pa.int64()))])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                new = {}
                for t in b.column(1).slice(at, 200).to_pylist():
                    h = shingles(t, n)
                    g = int(_digest(h))
                    if g not in seen:
                        new[g] = h.view(np.int64)
                        seen.add(g)
                if len(seen) >= SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(new), np.uint64).view(np.int64)), pa.array(list(new.values()), pa.list_(pa.int64()))], schema=_SETS)

    return run


def _apart(x: str, y: str):
    """Hamming distance of two sketches."""
    each = [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)]
    total = each[0]
    for e in each[1:]:
        total = total + e
    return total


def _possible(percent: int):
    """Whether two sets' sizes and sketches let them be linked."""
    fits = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
    return fits & (_apart("s1", "s2") * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and more) whose n-grams are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("g1"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("g2"))
    both = F.size(F.array_intersect("g1", "g2"))
    ok = both * (100 + percent) >= (F.size("g1") + F.size("g2")) * percent
    return pairs.join(one, "a").join(two, "b").where(ok).select(*pairs.columns)


def _kept_words(found: DataFrame) -> DataFrame:
    """(word, node): of the words that a set shares, all but the most common."""
    words = found.where("n IS NULL").select("word", "node", "cut", "weight", "common")
    crowds = words.where("weight > 1").groupBy("word").agg(F.max("common").alias("common"))
    dealt = words.where("weight = 0").drop("common").join(crowds, "word")
    every = words.where("weight > 0").select("word", "node", "cut", "common").unionByName(dealt.select("word", "node", "cut", "common"))
    # Rows may repeat; equal ones have one rank.
    order = Window.partitionBy("node", "cut").orderBy(F.col("common").desc(), F.col("word").desc())
    return every.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") > F.floor(F.col("cut") / 2)).select("word", "node").distinct()


def _merged(at: DataFrame, links: DataFrame) -> DataFrame:
    """`at` with components joined by links (ca, cb) of components."""
    moved = connected_components(links, "ca", "cb").select(F.col("node").alias("was"), F.col("component").alias("now"))
    return at.join(moved, at["component"] == moved["was"], "left").select("word", "node", F.coalesce("now", "component").alias("component"))


def _links(words: DataFrame, about: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that have the components of all links: `words` says which nodes may be
    linked. A component is named by one of its nodes, and each link is given as one of the
    components that it joins, once for two components."""
    left = about.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("s").alias("s1"))
    right = about.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("s").alias("s2"))
    at = words.withColumn("component", F.col("node"))
    links = tried = None
    for number in range(ROUNDS):
        one, drawn = F.struct(F.col("node").alias("b"), F.col("component").alias("cb")), F.xxhash64("node", F.lit(number))
        named = at.groupBy("word").agg(F.array(F.min_by(one, drawn), F.max_by(one, drawn)).alias("named"), F.min("component").alias("low"), F.max("component").alias("high"))
        named = named.where("low <> high").select("word", F.inline("named"))
        met = at.join(named, "word").where("component <> cb").select(F.col("node").alias("a"), F.col("component").alias("ca"), "b", "cb").distinct()
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        met = met.join(left, "a").join(right, "b").where(_possible(percent))
        star = met.groupBy("a", "ca").agg(F.min_by(F.struct("b", "cb"), F.struct(_apart("s1", "s2"), "b")).alias("best")).select("a", "ca", "best.*")
        star = stored(star, "near-star")
        found = stored(_linked(star, grams, percent).select("ca", "cb"), "near-links")
        both = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = both if tried is None else tried.unionByName(both)
        links = found if links is None else links.unionByName(found)
        fruitful = found.count() > star.count() * FRUITFUL
        at = stored(_merged(at, found), "near-at")
        # Groups of one component are done.
        spread = at.groupBy("word").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("word")
        at = stored(at.join(spread, "word"), "near-open")
        if not fruitful or at.isEmpty():
            break
    each = at.groupBy("word", "component").agg(F.count(F.lit(1)).alias("k"))
    main = each.groupBy("word").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    # Pairs are made under the first of their equal words, as far as the rows can tell.
    place = F.row_number().over(Window.partitionBy("node").orderBy("word"))
    early = at.withColumn("place", place).where(F.col("place") <= EARLY).groupBy("node").agg(F.sort_array(F.collect_list("word")).alias("early"))
    at = stored(at.join(main, "word").join(about.join(early, "node"), "node"), "near-ends")
    stray = at.where("component <> main").select(F.col("word").alias("w1"), F.struct(F.col("node").alias("node"), F.col("component").alias("c")).alias("one"), F.col("n").alias("n1"), F.col("s").alias("s1"), F.col("early").alias("e1"))
    rest = at.select("word", F.struct(F.col("node").alias("node"), F.col("component").alias("c")).alias("two"), "main", F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("early").alias("e2"))
    apart = (F.col("one.c") != F.col("two.c")) & ((F.col("two.c") == F.col("main")) | (F.col("one.node") > F.col("two.node")))
    first = F.coalesce(F.array_min(F.array_intersect("e1", "e2")) >= F.col("w1"), F.lit(True))
    pairs = stray.join(rest, (F.col("w1") == F.col("word")) & apart & _possible(percent) & first).select(F.least("one", "two").alias("x"), F.greatest("one", "two").alias("y")).distinct()
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).join(tried, ["a", "b"], "left_anti")
    ends = _linked(stored(pairs, "near-pairs"), grams, percent).select("ca", "cb")
    return links.unionByName(ends).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def near_groups(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    members = rows.mapInArrow(_members(n, percent), _MEMBERS)
    members = members.repartition("by").sortWithinPartitions("by", F.col("weight") > 0, "node")
    found = stored(members.mapInArrow(_grouped, _FOUND), "near-members")
    sets = found.where("n IS NOT NULL").select("id", "node", "n", "sketch")
    known = sets.where("id IS NOT NULL AND n > 0")

    words = stored(_kept_words(found), "near-words")
    wanted = stored(words.select("node").distinct(), "near-nodes")
    few = wanted.limit(FEW + 1).count() <= FEW
    about = known.join(F.broadcast(wanted) if few else wanted, "node").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("s"))
    about = stored(about, "near-about")
    ids = about.select("id").distinct()
    # A doc_id that is repeated has the sets of each of its rows; those not wanted meet no pair.
    grams = rows.join(F.broadcast(ids) if few else ids, "id").select("id", "text").mapInArrow(_sets(n), "node long, grams array<long>")
    grams = stored(grams, "near-sets")
    links = _links(words, about, grams, percent)

    # Rows of one doc_id are one: their sets are tied.
    tied = known.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b <> high").select("id", "b")
    links = links.unionByName(known.select("id", F.col("node").alias("a")).join(tied, "id").select("a", "b").where("a <> b"))
    comp = stored(connected_components(links), "near-components")
    nodes = known.groupBy("node").agg(F.min("id").alias("id")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    of = nodes.join(first, "component").select(F.col("node").alias("of"), "component_id")
    # A row without a node of its own meets nothing, wherever it goes.
    has = F.col("id").isNotNull() & (F.col("n") > 0)
    out = sets.withColumn("has", has).withColumn("at", F.when(has, F.col("node")).otherwise(F.xxhash64("id", "node")))
    out = out.join(of, (F.col("at") == F.col("of")) & F.col("has"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def first_of_groups(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose doc_id is their component's, and those without a doc_id."""
    groups = near_groups(docs, n, percent, text, doc_id)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    plain, names, (i,) = renamed(docs, doc_id)
    return plain.join(gone, F.col(i) == F.col("__gone"), "left_anti").select(*names).toDF(*docs.columns)
