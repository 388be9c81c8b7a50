"""Array expressions: values computed once inside lambdas, running sums, placed matches."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with value computed once: inside a lambda, whatever stands outside
    it is computed again for each element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def starts_of(lengths: Column, step: int = 256) -> Column:
    """Running sums before each element of an array of longs, 0 first.

    Chunks of `step` elements are summed first, so that an array of n elements
    takes about n * step / 2 additions and not n * n / 2.
    """

    def total(a):
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def chunk(i):
        return F.floor(i / step).cast("int")

    def of(a):
        each = F.sequence(F.lit(0), chunk(F.size(a) - 1))
        sums = F.transform(each, lambda c: total(F.slice(a, c * step + 1, F.lit(step))))
        return let(sums, lambda p: let(F.transform(each, lambda c: total(F.slice(p, F.lit(1), c))), lambda before: within(a, before)))

    def within(a, before):
        return F.transform(
            F.sequence(F.lit(0), F.size(a) - 1),
            lambda i: F.get(before, chunk(i)) + total(F.slice(a, chunk(i) * step + 1, i % step)),
        )

    def few(a):
        return F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i)))

    return F.when(F.size(lengths) > 16, let(lengths, of)).when(F.size(lengths) > 0, let(lengths, few)).otherwise(F.array().cast("array<bigint>"))


#: Stand around matches and before their groups while a text is taken apart; a text's own are
#: taken for another noncharacter.
MARK, PART, OTHER = "\ufdd0", "\ufdd1", "\ufdd2"


def unmarked(text: Column) -> Column:
    def of(said):
        return F.when(F.contains(said, F.lit(MARK)) | F.contains(said, F.lit(PART)), F.translate(said, MARK + PART, OTHER * 2)).otherwise(said)

    return let(text, of)


def parts_of(text: Column, pattern: str, groups: int) -> Column:
    """What the pattern's groups match, in one pass, where the pattern matches all of an
    unmarked text from where it begins; else null. A group that takes no part is empty."""
    said = F.regexp_replace(text, pattern, PART + PART.join(f"${k}" for k in range(1, groups + 1)))
    return let(F.split(said, PART, -1), lambda p: F.when(F.size(p) > 1, p))


def holds(text: Column, need: str | tuple[str, ...]) -> Column:
    """Whether a text has a match of a pattern, or any of several strings."""
    if isinstance(need, str):
        return text.rlike(need)
    return reduce(or_, (F.contains(text, F.lit(n)) for n in need))


def found(text: Column, pattern: str, groups: int = 0, need: str | tuple[str, ...] | None = None, clean: bool = False) -> Column:
    """Matches of a pattern that never matches empty, in order: array of (start, stop,
    g0, ..., g<groups>), offsets in code points; groups that took no part are empty. One pass
    marks the matches and names their groups; what lies between the marks gives the places.
    Texts without `need` (see `holds`) are not searched; a `clean` text is unmarked."""
    kind = "array<struct<start:bigint,stop:bigint," + ",".join(f"g{k}:string" for k in range(groups + 1)) + ">>"
    none = F.array().cast(kind)
    marked = F.regexp_replace(text if clean else unmarked(text), pattern, MARK + PART.join(f"${k}" for k in range(groups + 1)) + MARK)

    def spans(pieces):
        def part(i):
            said = F.split(F.get(pieces, 2 * i + 1), PART, -1)
            return F.struct(F.length(F.get(pieces, 2 * i)).cast("bigint").alias("gap"), said.alias("said"))

        return let(F.transform(F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int") - 1), part), lambda z: F.zip_with(z, starts_of(F.transform(z, whole)), placed))

    def whole(x):
        return x["gap"] + F.length(F.get(x["said"], F.lit(0)))

    def placed(x, b):
        fields = [(b + x["gap"]).alias("start"), (b + whole(x)).alias("stop")]
        return F.struct(*fields, *[F.get(x["said"], F.lit(k)).alias(f"g{k}") for k in range(groups + 1)])

    some = let(marked, lambda m: F.when(F.contains(m, F.lit(MARK)), let(F.split(m, MARK, -1), spans)).otherwise(none))
    if need is not None:
        some = F.when(holds(text, need), some)
    return F.coalesce(some, none)
