"""Spelling variant grouping by letter-parity bitmask bands.

A word's mask has one bit a letter, set where the letter's count is odd, in three bands of
letters about equally frequent. One edit flips at most two bits, so it leaves two bands as
they were or, where a letter of one band takes the place of another's, one band, and flips one
bit in each of the others. Words are joined on bands that are equal so, and lengths that differ
by one at most. A band that no edit touches keeps not only its parities but its letters in
order; the keys hold these too, or else groups would grow with the square of the vocabulary.
What agrees is verified letter by letter inside the join's condition, so that only true pairs
leave it.

Only different words are shuffled: occurrences are counted before that, so a word that makes
up a third of all text costs one row a task.

Cases: a null or empty text has no words, a null doc_id is hashed as an empty string, rows
that repeat are counted each, a text is taken whole whatever its length, an empty table gives
an empty result, ties of counts go to the smallest word, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LETTER = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BANDS = 3


def misspelt(doc: Column, run: Column, every: int) -> Column:
    """`run`, without one letter where `every` divides the hash of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, word: str, shortest: int, fewest: int) -> DataFrame:
    """word, n: words of `shortest` letters that occur `fewest` times."""
    rows = words.select(F.col(word).alias("word")).where(F.length("word") >= shortest)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)


def text_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 6, every: int = 199) -> DataFrame:
    """word: the runs of letters of all texts, lower-cased, some with a letter left out."""
    # A run shorter than the shortest word gives none, with or without a letter less.
    rows = docs.select(F.col(doc_id).alias("doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTER}{{{shortest},}}"), F.lit(0))).alias("run"))
    rows = rows.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    return rows.select(misspelt(F.col("doc"), F.col("run"), every).alias("word"))


def dealt_letters(words: DataFrame) -> list[str]:
    """The letters of all words in `BANDS` strings about equally frequent: the rest of an alphabet,
    so a bounded number, is counted here."""
    seen = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    bands, load = [""] * BANDS, [0] * BANDS
    for r in sorted(seen, key=lambda r: (-r["count"], r["c"])):
        b = load.index(min(load))
        bands[b] += r["c"]
        load[b] += r["count"]
    return bands


def parity(letters: Column, band: str) -> Column:
    """The band's mask: a bit for each of its letters, set where `letters` has an odd number."""

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.position(c, F.lit(band)) - 1) % 64)

    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda m, c: m.bitwiseXOR(bit(c)))


def without(letters: str) -> Column:
    return F.translate("word", letters, "")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: each pair of words (word, n) one edit apart, once.

    A letter that is left out, put in, or replaced by one of its band leaves two bands as they
    were: their masks and their letters, in order. One replaced by a letter of another band
    leaves the third as it was, with its letters in their places, and flips one bit of each of
    the others: the letters of one are the other word's without one. A pair is of one of
    these kinds only."""
    bands = dealt_letters(words)
    masks = [parity(without("".join(bands[:b] + bands[b + 1 :])), bands[b]).alias(f"m{b}") for b in range(BANDS)]
    rows = stored(words.select("word", "n", *masks), "spelling-masks")

    def keyed(kind: int, first: Column, second: Column, letters: Column, mark: str, of: DataFrame = rows) -> DataFrame:
        return of.select(F.lit(kind).alias("kind"), first.alias("m1"), second.alias("m2"), letters.alias("letters"), F.col("word").alias(mark), F.col("n").alias(f"{mark}_n"))

    def joined(left: list[DataFrame], right: list[DataFrame], more: Column) -> DataFrame:
        a, b = left[0], right[0]
        for x, y in zip(left[1:], right[1:], strict=True):
            a, b = a.unionByName(x), b.unionByName(y)
        return a.join(b, ["kind", "m1", "m2", "letters"]).where(more & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "a_n", "b_n")

    others = [tuple(x for x in range(BANDS) if x != b) for b in range(BANDS)]
    sides = [[keyed(b, F.col(f"m{c}"), F.col(f"m{d}"), without(bands[b]), mark) for b, (c, d) in enumerate(others)] for mark in ("a", "b")]
    length = F.length("a") - F.length("b")
    inside = joined(*sides, (length == -1) | ((length == 0) & (F.col("a") < F.col("b"))))
    left, right = [], []
    for b, (c, d) in enumerate(others):
        places = F.translate("word", bands[c] + bands[d], "." * len(bands[c] + bands[d]))
        held = without(bands[b] + bands[d])
        fewer = F.transform(F.sequence(F.lit(1), F.length("held")), lambda i: F.concat(F.substring(F.col("held"), F.lit(1), i - 1), F.substring(F.col("held"), i + 1, F.length("held"))))
        one_less = rows.withColumn("held", held).where("held <> ''").withColumn("fewer", F.explode(F.array_distinct(fewer)))
        left.append(keyed(b, F.col(f"m{b}"), parity(F.col("fewer"), bands[c]), F.concat(places, F.lit(" "), F.col("fewer")), "a", one_less))
        right.append(keyed(b, F.col(f"m{b}"), F.col(f"m{c}"), F.concat(places, F.lit(" "), held), "b"))
    return inside.unionByName(joined(left, right, F.lit(True)))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): where following the forms ends. Counts grow at each step,
    so paths are short; each round joins a path with the rest of it."""
    paths = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = paths.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        if paths.join(ahead, "root", "left_semi").isEmpty():
            return paths
        paths = stored(paths.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def spelling_forms(words: DataFrame, times: int = 5) -> DataFrame:
    """Of a table of different words (word, n): word, form, root, n, n_near, form_n. The form is
    the most frequent word one edit away, if it is `times` as frequent."""
    words = stored(words, "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("near_count"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    often = -F.col("best.less") >= F.col("n") * times
    rows = words.join(best, "word", "left").select(
        "word",
        F.when(often, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("near_count", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(often, -F.col("best.less")).alias("form_n"),
    )
    rows = stored(rows, "spelling-forms")
    return rows.join(rooted(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 6, fewest: int = 5, times: int = 5) -> DataFrame:
    """The words of all texts with the form and the root of each."""
    return spelling_forms(counted(text_words(docs, text, doc_id, shortest), "word", shortest, fewest), times)
