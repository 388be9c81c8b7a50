"""Personal data: patterns propose spans, checksums confirm them, context sets scores.

Everything is an expression of built-in functions on the row, so no row is shuffled.
Each pattern is written so that Java's engine neither recurses on long runs (possessive
groups loop) nor rescans them (a run is entered at its start or at the end of the match
before, `\\G`); the matches are those of the plain patterns of `KINDS`.

Cases: a null or empty text has no spans; very long texts are searched whole; offsets count
code points; repeated rows and rows without an id are searched each; an empty table gives an
empty result; all columns of the caller are kept, and a new column whose name is taken gets
underscores after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let, renamed, starts_of

#: Kind: pattern. The first four are the base, in the order of ties.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a confirmed span, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|host|server|addr|login",
    "card": "card|visa|master|credit|debit|pay|karte|tarjeta|carte",
    "phone": "phone|tel|call|fax|mobile|telefon|llam",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": r"ssn|social|security|tax|insurance",
}
BONUS = 0.2
#: Spans beyond the base are reported from this score on.
LEAST = 0.5
#: Code points before and after a span in which context words count.
NEAR = 40


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""

    def term(s, i):
        v = F.substring(s, F.length(s) - i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 1, v * 2).otherwise(v)
        return F.when(d > 9, d - 9).otherwise(d)

    def passes(s):
        return F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), F.lit(0), lambda t, i: t + term(s, i)) % 10 == 0

    return let(digits, passes)


def mod97(code: Column) -> Column:
    """Whether an IBAN's remainder by 97 is 1; letters count 10 to 35."""
    plain = F.regexp_replace(code, " ", "")

    def step(s, rest, i):
        c = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    def passes(s):
        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), lambda rest, i: step(s, rest, i)) == 1

    return let(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), passes)


def confirmed(kind: str, s: Column) -> Column:
    n = F.length(digits_of(s))
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        small = lambda p: F.substring(F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0"), 1, 3) <= "255"
        return F.forall(F.split(s, r"\."), lambda p: part(p) & small(p))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits_of(s))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(s, " ", "")).between(15, 34), mod97(s)).otherwise(False)
    if kind == "ssn":
        return ~s.rlike("^(?:000|666|9)") & (F.substring(s, 5, 2) != "00") & (F.substring(s, 8, 4) != "0000")
    return F.lit(True)


def checked(kind: str):
    return lambda s: confirmed(kind, s)


def of_kind(kind: str):
    return lambda z: z["kind"] == kind


def proposed(text: Column, pattern: str, need: str | None = None) -> Column:
    """Matches of a pattern that never matches empty: array of (start, stop, s)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(need)), found).otherwise(F.array().cast("array<string>")) if need else found


def placed(text: Column, pattern: str, matches: Column) -> Column:
    """The matches with their offsets: what lies before, between and after them comes
    from splitting by the same pattern."""
    parts = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)),
        matches,
        lambda gap, m: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("len"), m.alias("s")),
    )

    def spans(p):
        before = starts_of(F.transform(p, lambda x: x["gap"] + x["len"]))
        return F.zip_with(
            p,
            before,
            lambda x, b: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + x["len"]).alias("stop"), x["s"].alias("s")),
        )

    return F.when(F.size(matches) > 0, let(parts, spans)).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,s:string>>"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of sorted (start, rank, stop, kind, ...)."""
    return F.array_join(F.transform(spans, lambda z: F.concat_ws(":", z["kind"], z["start"].cast("string"), z["stop"].cast("string"))), ",")


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with pii_spans: array of (start, rank, stop, kind, value, score) in order."""
    plain, names, (t,) = renamed(docs, text)
    out = plain.withColumn("__text", F.coalesce(F.col(t), F.lit("")))
    for kind, pattern in KINDS.items():
        out = out.withColumn(f"__m_{kind}", proposed(F.col("__text"), pattern, NEEDS.get(kind)))
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        m = F.col(f"__m_{kind}")
        # Most texts have nothing to confirm: only the others are split.
        some = F.exists(m, checked(kind))
        spans = F.filter(placed(F.col("__text"), pattern, m), lambda z: checked(kind)(z["s"]))

        def scored(z):
            near = F.lower(
                F.concat_ws(
                    " ",
                    F.substring(F.col("__text"), F.greatest(z["start"] - NEAR, F.lit(0)).cast("int") + 1, F.least(z["start"], F.lit(NEAR)).cast("int")),
                    F.substring(F.col("__text"), z["stop"].cast("int") + 1, F.lit(NEAR)),
                )
            )
            score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(BONUS)).otherwise(F.lit(0.0)))
            return F.struct(z["start"].alias("start"), F.lit(rank).alias("rank"), z["stop"].alias("stop"), F.lit(kind).alias("kind"), z["s"].alias("value"), score.alias("score"))

        kind_type = "array<struct<start:bigint,rank:int,stop:bigint,kind:string,value:string,score:double>>"
        out = out.withColumn(f"__s_{kind}", F.when(some, F.transform(spans, scored)).otherwise(F.array().cast(kind_type)))
    every = F.array_sort(F.concat(*[F.col(f"__s_{k}") for k in KINDS]))
    rank_of_base = len(BASE)
    out = out.withColumn("pii_spans", F.filter(every, lambda z: (z["rank"] < rank_of_base) | (z["score"] >= LEAST)))
    return out.select(*names, "pii_spans").toDF(*docs.columns, free("pii_spans", docs.columns))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in angle brackets; a span
    that begins inside one replaced before it is covered by that one."""
    found = find_pii(docs, text)
    new = found.columns[-1]
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(
        F.col(new),
        start,
        lambda s, z: F.when(z["start"] < s["at"], F.struct(F.greatest(s["at"], z["stop"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(
                z["stop"].alias("at"),
                F.concat(s["out"], F.array(F.substring(F.col(text), s["at"].cast("int") + 1, (z["start"] - s["at"]).cast("int")), F.concat(F.lit("<"), z["kind"], F.lit(">")))).alias("out"),
            )
        ),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col(text), s["at"].cast("int") + 1, F.length(F.col(text)))),
    )
    return found.withColumn(text, F.when(F.size(new) > 0, done).otherwise(F.col(text)))


def pii_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, all spans and scores."""
    found = find_pii(docs.select(doc_id, text), text)
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda z: z["rank"] < len(BASE))
    return found.select(
        F.col(doc_id).alias("doc_id"),
        *[F.size(F.filter(spans, of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.transform(spans, lambda z: z["score"]).alias("scores"),
    )
