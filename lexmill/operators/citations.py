"""Citation detection: documents in, one row per citation out.

Each detector is a pattern run inside the scan, so that only matches leave it; short-form
and `supra` references are joined to the document's full citations, overlaps with those
are removed by an anti-join, and what still overlaps is settled per document, first come
first served. Only citations are shuffled, never texts. Offsets count code points of the
text as given.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.arrays import found, let, parts_of
from ..functions.names import name_start, unwrapped
from ..functions.storage import stored

FLAGS = ("is_supra", "is_short_form", "wl_only", "lexis_only", "slip_only")
COLUMNS = ("doc_id", "kind", "key", "start", "stop", "match_text", "short", *FLAGS, "rank", "seq")
WHITE = t.java(r"\s+")


def squeezed(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, WHITE, " "), "^ | $", "")


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, t.java(r"^\s+|\s+$"), "")


#: The detectors' patterns, their numbers of groups, and what a text must hold for them: a
#: pattern, or any of several strings.
PATTERNS = {
    "non_v": (t.NON_V_CASE, 13, ("In re", "In Re", "In rE", "In RE", "IN RE", "Estate of", "ship of", "Adoption of", "Marriage of")),
    "cases": (t.CASES, 9, ("Cases",)),
    "uniform": (t.UNIFORM, 1, r"\d-\d"),
    "statute": (t.STATUTE, 3, "(?i)§|sec"),
    "federal": (t.FEDERAL, 2, r"(?i)S\.\s*C\."),
    "court": (t.COURT_RULE, 1, "(?i)court"),
    "conduct": (t.CONDUCT_RULE, 1, "(?i)conduct"),
    "instruction": (t.INSTRUCTION, 2, "(?i)caci"),
    "supra": (t.SUPRA, 1, ("supra",)),
    "short_form": (t.SHORT_FORM, 2, ("v.",)),
}

#: What must come after a `v.` for a form of its tail.
TAIL_NEEDS = {"csm": r"\(", "bb": r"\(", "wl": "WL", "lexis": "LEXIS", "flat": r"\(", "slip": "(?i)case"}
TAIL_GROUPS = {"csm": 6, "bb": 6, "wl": 5, "lexis": 5, "flat": 6, "slip": 4}


def code_names() -> dict[str, str]:
    """Every way to write a code, in small letters without spaces and full stops, and its abbreviation."""
    out = {}
    for pattern, short in t.CODES:
        plain = re.sub(r"\(\?:(?:and\|&|&\|and)\)", "and", pattern)
        plain = re.sub(r"\\s[*+]|\\\.\??| |\.\?", "", plain)
        for form in (re.sub(r"\(\?:(\w+)\)\?", r"\1", plain), re.sub(r"\(\?:\w+\)\?", "", plain)):
            out[form.lower()] = short
    return out


CODE_NAMES = code_names()


def spotted(docs: DataFrame) -> DataFrame:
    """doc_id, the surroundings of each `v.`, and each detector's matches with `said`, what
    the original text has there. It is written once, as every detector reads its part of it,
    and holds no texts but what lies around a `v.`."""
    rows = docs.withColumn("norm", unwrapped(F.col("text")))
    rows = rows.withColumn("anchors", found(F.col("norm"), r"v\.(?<=\sv\.)(?=\s)", need=("v.",), clean=True))
    every = [F.transform(found(F.col("norm"), p, n, need, clean=True), said_too(n)).alias(name) for name, (p, n, need) in PATTERNS.items()]
    return stored(rows.select("doc_id", F.transform("anchors", around).alias("around"), *every), "spotted")


def with_some(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows whose value is not null, with it. It is worked out once: a filter on it would be
    moved below, where it works out the value for itself."""
    return rows.select("*", F.explode(F.filter(F.array(value), lambda x: x.isNotNull())).alias(name))


def around(z: Column, i: Column) -> Column:
    """A `v.` and the text on its left and right, up to the next `v.` each."""
    low = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.col("anchors"), i - 1)["stop"])
    high = F.coalesce(F.get(F.col("anchors"), i + 1)["start"], F.length("norm").cast("bigint"))

    def cut(text, a, b):
        return F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    sides = (cut("norm", low, z["start"]).alias("left"), cut("norm", z["stop"], high).alias("rest"), cut("text", low, high).alias("real"))
    return F.struct(low.alias("low"), z["start"].alias("v"), *sides)


def matches(docs: DataFrame, name: str) -> DataFrame:
    return docs.select("doc_id", F.inline(name))


def said_too(groups: int):
    def one(z):
        said = F.substring(F.col("text"), (z["start"] + 1).cast("int"), (z["stop"] - z["start"]).cast("int"))
        return F.struct(z["start"], z["stop"], *[z[f"g{k}"] for k in range(groups + 1)], said.alias("said"))

    return one


def cites(rows: DataFrame, kind: str, key: Column, rank: int, short: Column | None = None, **flags: Column) -> DataFrame:
    """Rows of COLUMNS. rank: the detector's place among those of an equal start."""
    text = F.lit(None).cast("string")
    return rows.select(
        "doc_id",
        F.lit(kind).alias("kind"),
        key.alias("key"),
        "start",
        "stop",
        F.col("said").alias("match_text"),
        (text if short is None else short).alias("short"),
        *[flags.get(f, F.lit(False)).alias(f) for f in FLAGS],
        F.lit(rank).alias("rank"),
        F.col("start").alias("seq"),
    )


def short_name(name: Column) -> Column:
    bare = F.regexp_replace(trimmed(name), t.java(rf"(?i)^(?:(?:{t.NO_V})\s+|Ex parte\s+|People v\.\s+)+"), "")
    first = F.regexp_extract(bare, t.java(r"^(\S*)"), 1)
    return F.when(first == "", bare).otherwise(F.regexp_replace(first, "[,.;:]+$", ""))


def compact(s: str) -> Column:
    return F.regexp_replace(F.col(s), WHITE, "")


def anchored(docs: DataFrame) -> DataFrame:
    """Full citations with a `v.`: the name walks back from it; of the citation forms after
    it, within reach and before the next `v.`, the earliest decides."""
    rows = with_some(docs.select("doc_id", F.inline("around")), "at", name_start(F.col("left")))

    def tail_of(form: str) -> Column:
        reach = rf"(?s)^(.{{0,{t.TAIL_REACH}}}?)(?-s:({t.TAILS[form]})).*"
        return F.when(F.col("rest").rlike(TAIL_NEEDS[form]), parts_of(F.col("rest"), reach, TAIL_GROUPS[form]))

    rows = with_some(rows, "tails", F.struct(*[tail_of(f).alias(f) for f in t.TAILS])).select("doc_id", "low", "v", "left", "real", "at", "tails.*")

    def g(form: str, k: int) -> Column:
        return F.get(F.col(form), F.lit(k))

    forms = [f for f in t.TAILS if f != "slip"]
    best = F.array_min(F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.length(g(f, 1)).alias("n"), F.lit(i).alias("i"))) for i, f in enumerate(forms)]), lambda x: x.isNotNull()))
    rows = with_some(rows, "form", F.coalesce(F.get(F.array(*[F.lit(f) for f in forms]), best["i"]), F.when(F.col("slip").isNotNull(), "slip")))

    def by_form(**value: Column) -> Column:
        return F.coalesce(*[F.when(F.col("form") == f, v) for f, v in value.items()])

    def reported(f: str, year: int, volume: int) -> Column:
        return F.format_string("(%s) %s %s %s", g(f, year), g(f, volume), F.regexp_replace(g(f, volume + 1), WHITE, ""), g(f, volume + 2))

    tail = by_form(
        csm=reported("csm", 3, 4),
        bb=reported("bb", 6, 3),
        flat=reported("flat", 6, 3),
        wl=F.format_string("%s WL %s", g("wl", 3), g("wl", 4)),
        lexis=F.format_string("%s U.S. Dist. LEXIS %s", g("lexis", 3), g("lexis", 4)),
        slip=F.format_string("Case No. %s (%s)", g("slip", 3), trimmed(g("slip", 4))),
    )
    before = by_form(**{f: g(f, 1) for f in t.TAILS})
    length = by_form(**{f: F.length(g(f, 1)) + F.length(g(f, 2)) for f in t.TAILS})
    other = trimmed(F.regexp_replace(before, t.java(r"[,\s]+$"), ""))
    rows = with_some(rows, "other", let(other, lambda x: F.when(x.rlike("^[A-Z]"), x)))
    first = squeezed(F.expr("substring(left, at + 1)"))
    rows = rows.withColumn("first", first).withColumn("start", F.col("low") + F.col("at")).withColumn("stop", F.col("v") + 2 + length)
    rows = rows.withColumn("said", F.substring("real", F.col("at") + 1, (F.col("stop") - F.col("start")).cast("int")))
    key = F.concat(F.col("first"), F.lit(" v. "), squeezed(F.col("other")), F.lit(" "), tail)
    form = F.col("form")
    return cites(rows, "case", key, 0, short_name(F.col("first")), wl_only=form == "wl", lexis_only=form == "lexis", slip_only=form == "slip")


def year_first(name: Column, year: str, volume: int) -> Column:
    return F.concat(name, F.format_string(" (%s) %s %s %s", F.col(year), F.col(f"g{volume}"), compact(f"g{volume + 1}"), F.col(f"g{volume + 2}")))


def unanchored(docs: DataFrame) -> DataFrame:
    """Cases named without `v.`: In re, Estate of and their like, and "... Cases"."""
    rows = matches(docs, "non_v")
    name = F.concat(F.col("g1"), F.lit(" "), squeezed(F.col("g2")))
    key = F.when(F.col("g3") != "", year_first(name, "g3", 4)).when(F.col("g7") != "", year_first(name, "g10", 7))
    key = key.otherwise(F.concat(name, F.format_string(" %s WL %s", F.col("g11"), F.col("g12"))))
    only = (F.col("g3") == "") & (F.col("g7") == "")
    out = cites(rows, "case", key, 1, short_name(name), wl_only=only)
    rows = matches(docs, "cases")
    name = squeezed(F.col("g1"))
    key = F.when(F.col("g2") != "", year_first(name, "g2", 3)).otherwise(year_first(name, "g9", 6))
    return out.unionByName(cites(rows, "case", key, 2, F.regexp_extract(name, "^([^ ]*)", 1)))


def chained(rows: DataFrame, group: str, item: str, key) -> DataFrame:
    """The further numbers of a chain, which `group` holds and the match ends with."""
    end = F.col("stop") - F.length(group)
    links = found(F.col(group), rf"(?i){t.AND}({item})", 1)
    rows = rows.withColumn("end", end).withColumn("link", F.explode(links))
    said = F.substring("said", (F.col("end") - F.col("start") + F.col("link.start") + 1).cast("int"), F.length("link.g0"))
    return rows.withColumn("said", said).withColumn("start", F.col("end") + F.col("link.start")).withColumn("stop", F.col("end") + F.col("link.stop")).withColumn("key", key(F.col("link.g1")))


def headed(rows: DataFrame, group: str) -> DataFrame:
    """The match without its chain."""
    n = F.length(group)
    rows = rows.withColumn("stop", F.col("stop") - n)
    return rows.withColumn("said", F.substring("said", F.lit(1), (F.col("stop") - F.col("start")).cast("int")))


def statutes(docs: DataFrame) -> DataFrame:
    uniform = matches(docs, "uniform")
    taken = uniform.select("doc_id", F.col("start").alias("s"), F.col("stop").alias("e"))
    rows = matches(docs, "statute")
    names = F.create_map(*[F.lit(x) for pair in CODE_NAMES.items() for x in pair])
    flat = F.replace(F.lower(F.regexp_replace("g1", r"[\s.]+", "")), F.lit("&"), F.lit("and"))
    rows = rows.withColumn("code", F.try_element_at(names, flat))
    head = headed(rows, "g3")
    apart = (head["doc_id"] == taken["doc_id"]) & (head["start"] < taken["e"]) & (head["stop"] > taken["s"])
    head = head.join(taken, apart, "left_anti")
    # A head that gave way takes its chain with it.
    kept = head.select("doc_id", F.col("start").alias("head"))
    more = rows.join(kept, (rows["doc_id"] == kept["doc_id"]) & (rows["start"] == kept["head"]), "left_semi")
    more = chained(more.where("g3 <> ''"), "g3", t.SECTION, lambda s: F.concat("code", F.lit(" § "), s))
    out = cites(uniform, "statute", F.concat(F.lit("UCC § "), F.col("g1")), 3)
    out = out.unionByName(cites(head, "statute", F.concat("code", F.lit(" § "), F.col("g2")), 4)).unionByName(cites(more, "statute", F.col("key"), 4))
    federal = matches(docs, "federal")
    return out.unionByName(cites(federal, "statute", F.concat("g1", F.lit(" U.S.C. § "), "g2"), 5))


def rules(docs: DataFrame) -> DataFrame:
    court = cites(matches(docs, "court"), "rule", F.concat(F.lit("Cal. Rules of Court, rule "), F.col("g1")), 6)
    return court.unionByName(cites(matches(docs, "conduct"), "rule", F.concat(F.lit("Cal. Rules of Prof. Conduct, rule "), F.col("g1")), 7))


def instruction(number: Column) -> Column:
    plain = F.upper(F.regexp_replace(number, WHITE, ""))
    return F.concat(F.lit("CACI No. "), F.regexp_replace(plain, "^VF-?", "VF-"))


def instructions(docs: DataFrame) -> DataFrame:
    rows = matches(docs, "instruction")
    more = chained(rows.where("g2 <> ''"), "g2", t.NUMBER, instruction)
    return cites(headed(rows, "g2"), "caci", instruction(F.col("g1")), 8).unionByName(cites(more, "caci", F.col("key"), 8))


def supras(docs: DataFrame, full: DataFrame) -> DataFrame:
    """`Name, supra`: the document's first full case of that short name, wherever it stands."""
    first = full.where("short <> ''").groupBy(F.col("doc_id").alias("d"), F.col("short").alias("name"))
    first = first.agg(F.min_by(F.struct("key", "wl_only", "lexis_only", "slip_only"), F.struct("start", "rank")).alias("target"))
    rows = matches(docs, "supra").withColumn("name1", short_name(F.col("g1")))
    rows = rows.join(first, (F.col("doc_id") == F.col("d")) & (F.col("name1") == F.col("name")))
    flags = {f: F.col(f"target.{f}") for f in FLAGS[2:]}
    return cites(rows, "case", F.col("target.key"), 9, F.col("name"), is_supra=F.lit(True), **flags)


def party(s: Column) -> Column:
    return squeezed(F.lower(F.regexp_replace(s, "[.,;:'\"’]", "")))


def short_forms(docs: DataFrame, full: DataFrame) -> DataFrame:
    """Bare `X v. Y` of a case that the document cites in full: both parties equal, or the
    first equal and one second a prefix of the other; then the registry's first."""
    parts = t.java(r"^(.+?)\s+v\.\s+(.+?)\s+(?:\(\d{4}\)|\d{4}\s+WL|\d{4}\s+U\.S\.\s*Dist\.\s*LEXIS|Case\s+No\.)")
    known = with_some(full, "p", F.nullif(party(F.regexp_extract("key", parts, 1)), F.lit("")))
    known = with_some(known, "d", F.nullif(party(F.regexp_extract("key", parts, 2)), F.lit(""))).groupBy(F.col("doc_id").alias("doc"), "p", "d")
    known = known.agg(F.min(F.struct("start", "rank", "key", "short", "wl_only", "lexis_only", "slip_only")).alias("target"))
    bare = let(trimmed(F.col("g1")), lambda raw: let(trimmed(F.regexp_replace(raw, t.java(t.LEAD), "")), lambda x: F.struct(x.alias("said"), (F.length(raw) - F.length(x)).alias("cut"))))
    rows = with_some(matches(docs, "short_form"), "bare", bare)
    rows = rows.withColumn("said", F.expr("substring(said, bare.cut + 1)")).withColumn("start", F.col("start") + F.col("bare.cut"))
    # What lies in a full citation is no short form: most of what matches.
    spans = full.select(F.col("doc_id").alias("doc"), F.col("start").alias("s"), F.col("stop").alias("e"))
    rows = rows.join(spans, (F.col("doc_id") == F.col("doc")) & (F.col("start") < F.col("e")) & (F.col("stop") > F.col("s")), "left_anti")
    rows = with_some(rows, "p1", F.nullif(party(F.col("bare.said")), F.lit(""))).withColumn("d1", party(F.col("g2")))
    fits = F.startswith("d", "d1") | F.startswith("d1", "d")
    rows = rows.join(known, (F.col("doc_id") == F.col("doc")) & (F.col("p1") == F.col("p")) & fits)
    rows = rows.groupBy("doc_id", "start", "stop", "said").agg(F.min(F.struct((F.col("d") != F.col("d1")).alias("loose"), "target")).alias("best"))
    flags = {f: F.col(f"best.target.{f}") for f in FLAGS[2:]}
    return cites(rows, "case", F.col("best.target.key"), 10, F.col("best.target.short"), is_short_form=F.lit(True), **flags)


def without_overlaps(all_cites: DataFrame) -> DataFrame:
    """Per document by start, then detector: a citation stays if it starts at or after the
    end of the last that stayed. A citation that starts at or after the end of all before it
    stays whatever they do, so that a document falls apart there; parts of several citations
    are few and short, and each is gone through by itself."""
    fields = [c for c in COLUMNS if c != "doc_id"]
    order = ["start", "rank", "seq", *[c for c in fields if c not in ("start", "rank", "seq")]]
    by = Window.partitionBy("doc_id").orderBy("start", "rank", "seq", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = all_cites.withColumn("part", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("part", F.sum("part").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("all"))
    first = F.struct(F.lit(-1).cast("bigint").alias("end"), F.filter("all", lambda x: F.lit(False)).alias("kept"))
    kept = F.aggregate(
        "all",
        first,
        lambda s, x: F.when(x["start"] >= s["end"], F.struct(x["stop"].alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )
    kept = F.when(F.size("all") == 1, F.col("all")).otherwise(kept)
    return rows.select("doc_id", F.inline(kept)).select(*[c for c in COLUMNS if c not in ("rank", "seq")])


def find_citations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, key, start, stop, match_text, short and flags of all citations."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = spotted(rows)
    # References are joined to the full citations in several ways: these are found once.
    full = stored(anchored(rows).unionByName(unanchored(rows)), "full-citations")
    every = full.unionByName(statutes(rows)).unionByName(rules(rows)).unionByName(instructions(rows))
    return without_overlaps(every.unionByName(supras(rows, full)).unionByName(short_forms(rows, full)))


def authorities(found_cites: DataFrame) -> DataFrame:
    """Distinct authorities of each document in order of a table of authorities: cases,
    statutes, rules, instructions; inside a kind by key as a dictionary orders it."""
    place = F.array_position(F.array(*[F.lit(k) for k in ("case", "statute", "rule", "caci")]), F.col("kind")).cast("int")
    rows = found_cites.groupBy("doc_id", "kind", "key").agg(F.min("start").alias("first_start"), F.count(F.lit(1)).alias("n_cites"))
    by = Window.partitionBy("doc_id").orderBy(place, F.collate("key", "UNICODE"), "key")
    return rows.withColumn("position", F.row_number().over(by).cast("bigint"))
