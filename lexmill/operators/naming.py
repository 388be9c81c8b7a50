"""Names of filings: part and volume designators, and telling equal names apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.arrays import found
from ..functions.filing_text import roman_value

# Numbers as words, filings told apart by the ladder, amended pleadings, plural roles.
WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
LADDER = (
    "Demurrer", "Motion", "Petition", "Notice of Motion", "Opposition", "Reply", "Ex Parte Application",
    "Separate Statement", "Reply Separate Statement", "AUMF", "UMF", "Answer", "Cross-Complaint", "Trial Brief",
    "Notice of Non-Opposition", "Notice of Errata", "Errata", "Response to Evid. Objs.", "Response to Objs.",
    "Response to Order to Show Cause", "Memorandum of Points and Authorities", "RJN", "Objection", "Evidence",
)
LADDER_BEGINNINGS = ("RJN ISO ", "Obj. to ", "Evidence ISO ")
AMENDED = ("FAC", "SAC", "TAC", "FACC", "SACC", "TACC")
PLURALS = r"(?i)(?:^|[\s-])(?:plaintiffs|defendants|petitioners|respondents|complainants|claimants|intervenors)$"
DESIGNATOR = r"(?i)\b(vol(?:ume)?s?|pt|part)\s*\.?\s*(?:no\.?\s*)?(\d{1,3}|[ivxl]{1,7}|" + "|".join(WORDS) + r")\b"


def part_volume(raw: Column) -> Column:
    """`Vol. 2` or `Part 1`: the first designator whose number is one, else null."""

    def number(s):
        word = F.array_position(F.array(*[F.lit(w) for w in WORDS]), F.lower(s)).cast("int")
        return F.when(s.rlike("^[0-9]"), s.cast("int")).when(word > 0, word).otherwise(roman_value(s))

    def named(z):
        n = F.when(z["g2"].rlike(r"^\d+$"), F.try_to_number(z["g2"], F.lit("999")).cast("int")).otherwise(number(z["g2"]))
        label = F.when(z["g1"].rlike("(?i)^p"), "Part ").otherwise("Vol. ")
        return F.when(n >= 1, F.concat(label, n.cast("string")))

    names = F.transform(found(raw, t.java(DESIGNATOR), 2), named)
    return F.get(F.filter(names, lambda x: x.isNotNull()), F.lit(0))


def with_part(name: Column, part: Column) -> Column:
    """The name and its designator, unless it ends with it."""
    there = (name == part) | F.endswith(name, F.concat(F.lit(" "), part))
    return F.when(F.coalesce(name, F.lit("")) == "", "").when(part.isNull() | (part == "") | there, name).otherwise(F.concat(name, F.lit(" "), part))


def possessive(label: Column) -> Column:
    return F.concat(label, F.when(label.rlike(PLURALS), "'").otherwise("'s"))


def with_target(canonical: Column, target: Column) -> Column:
    """The filing's name with what it is directed at; null where the kind has no such form."""
    to = {"Demurrer": "Demurrer to ", "Opposition": "Opposition to ", "Reply": "Reply to ", "Notice of Motion": "Notice of "}
    out = F.when(F.coalesce(target, F.lit("")) == "", F.lit(None).cast("string"))
    for kind, lead in to.items():
        out = out.when(canonical == kind, F.concat(F.lit(lead), target))
    out = out.when(canonical.isin("Motion", "Petition", "Ex Parte Application"), target)
    notice = (canonical == "RJN") | F.startswith(canonical, F.lit("RJN ISO "))
    return out.when(notice, F.concat(F.regexp_replace(canonical, r"\.$", ""), F.lit(" to "), F.regexp_replace(target, t.java(r"^Opp\.\s+to\s+"), "")))


def rungs() -> list[Column]:
    """The ladder's five names: target; label; both; name; target and name."""
    c, label = F.col("canonical"), F.nullif(F.col("party_label"), F.lit(""))
    name = F.coalesce(F.nullif(F.col("party_name"), F.lit("")), label)
    full = F.coalesce(with_target(c, F.col("target")), c)

    def of(who, what):
        return F.coalesce(F.concat(possessive(who), F.lit(" "), what), what)

    return [full, of(label, c), of(label, full), of(name, c), of(name, full)]


def disambiguated(entries: DataFrame) -> DataFrame:
    """`entries` (group, id, canonical, target, party, party_label, party_name, part_vol)
    with `name`: filings of a group and kind get the least detailed names that differ.

    Whether a rung's names differ is counted before anything is joined, so a kind that has
    most of a group's filings is no single task's.
    """
    c, part = F.col("canonical"), F.nullif(F.col("part_vol"), F.lit(""))
    rows = entries.withColumn("__part", with_part(c, part))
    for i, rung in enumerate(rungs()):
        rows = rows.withColumn(f"__rung{i}", rung)
    names = ["__part", *[f"__rung{i}" for i in range(5)]]
    counts = rows.groupBy(F.col("group").alias("__group"), F.col("canonical").alias("__canonical")).agg(
        F.count(F.lit(1)).alias("__n"), F.count(part).alias("__parts"), *[F.countDistinct(n).alias(f"__d{n}") for n in names]
    )
    rows = rows.join(counts, F.col("group").eqNullSafe(F.col("__group")) & F.col("canonical").eqNullSafe(F.col("__canonical")))
    chosen = F.coalesce(*[F.when(F.col(f"__d__rung{i}") == F.col("__n"), F.col(f"__rung{i}")) for i in range(5)], F.col("__rung4"))
    climbs = c.isin(*LADDER)
    for lead in LADDER_BEGINNINGS:
        climbs = climbs | F.startswith(c, F.lit(lead))
    party = F.nullif(F.col("party"), F.lit(""))
    name = (
        F.when(F.col("__n") == 1, c)
        .when((F.col("__parts") > 0) & (F.col("__d__part") == F.col("__n")), c)
        .when(c.rlike(t.java(r"\bDecl\.?\b")) | c.isin(*AMENDED), c)
        .when(c == "Complaint", F.coalesce(F.concat(party, F.lit(" Complaint")), c))
        .when(climbs, chosen)
        .otherwise(c)
    )
    none = F.coalesce(c, F.lit("")) == ""
    return rows.withColumn("name", F.when(none, "").otherwise(with_part(name, part))).select(*entries.columns, "name")
