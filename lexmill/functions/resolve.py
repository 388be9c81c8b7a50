"""Links for citations: a curated table first, then a provider's search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as t


def encoded(s: Column) -> Column:
    """Percent-encoding of a URL's component, as browsers do it."""
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# How the keys of cases end.
REPORTED = t.java(r"\((\d{4})\)\s+(\d{1,4})\s+(\S+?)\s+(\d{1,5})\s*$")
ON_WESTLAW = t.java(r"(\d{4})\s+WL\s+(\d{4,8})\s*$")
ON_LEXIS = t.java(r"(\d{4})\s+U\.S\.\s*Dist\.\s*LEXIS\s+(\d{4,8})\s*$")


def groups(s: Column, pattern: str, template: str, *which: int) -> Column:
    return F.when(s.rlike(pattern), F.format_string(template, *[F.regexp_extract(s, pattern, k) for k in which]))


def reporter_cite(key: Column) -> Column:
    """`13 Cal.App.5th 1152` of a case's key, or its database number, or null."""
    return F.coalesce(
        groups(key, REPORTED, "%s %s %s", 2, 3, 4),
        groups(key, ON_WESTLAW, "%s WL %s", 1, 2),
        groups(key, ON_LEXIS, "%s U.S. Dist. LEXIS %s", 1, 2),
    )


def lexis_case_term(key: Column) -> Column:
    """The case's name and its reporter citation; the key where it has none."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(key, REPORTED, ""), t.java(r"^\s+|\s+$"), ""), "[,;]+$", "")
    cite = groups(key, REPORTED, "%s %s %s", 2, 3, 4)
    return F.when(cite.isNull(), key).when(name == "", cite).otherwise(F.concat(name, F.lit(" "), cite))


def slip_term(key: Column) -> Column:
    """The case's name before `Case No.`."""
    pattern = t.java(r"(?is)^(.*?),?\s*Case\s+No\.\s+")
    name = F.regexp_replace(F.regexp_extract(key, pattern, 1), t.java(r"^\s+|\s+$"), "")
    return F.when(key.rlike(pattern), name).otherwise(key)


def statute_term(key: Column, prefixes: dict[str, str]) -> Column:
    """A statute's key with the provider's name for the code; federal and unknown ones as they are."""
    pattern = t.java(r"^([A-Z]+)\s*§\s*(.+)$")
    code = F.regexp_extract(key, pattern, 1)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), code)
    return F.when(key.rlike(pattern) & name.isNotNull(), F.concat(name, F.lit(" § "), F.regexp_extract(key, pattern, 2))).otherwise(key)


def westlaw_search(term: Column, more: str) -> Column:
    return F.concat(F.lit(t.WESTLAW_SEARCH), encoded(term), F.lit(more))


def westlaw_case(term: Column) -> Column:
    direct = F.concat(F.lit(t.WESTLAW_DOCUMENT), encoded(term))
    return F.when(F.contains(term, F.lit(" WL ")), westlaw_search(term, "&jurisdiction=CA&contentType=CASE")).otherwise(direct)


def lexis_search(term: Column) -> Column:
    return F.concat(F.lit(t.LEXIS_SEARCH), encoded(term))


def built_url(kind: Column, key: Column, slip: Column, lexis: Column) -> Column:
    """The search or document link of a citation without a curated one."""
    number = F.concat(F.lit("CACI "), F.regexp_replace(key, t.java(r"^CACI No\.\s*"), ""))
    uniform = F.regexp_extract(key, "^UCC § (.+)$", 1)
    by_lexis = (
        F.when(kind == "caci", number)
        .when((kind == "case") & slip, slip_term(key))
        .when(kind == "case", lexis_case_term(key))
        .when((kind == "statute") & (uniform != ""), F.concat(F.lit("U.C.C. § "), uniform))
        .when(kind == "statute", statute_term(key, t.LEXIS))
        .otherwise(key)
    )
    by_westlaw = (
        F.when(kind == "caci", westlaw_search(number, "&jurisdiction=CA"))
        .when((kind == "case") & slip, westlaw_case(slip_term(key)))
        .when(kind == "case", westlaw_case(F.coalesce(reporter_cite(key), key)))
        .when((kind == "statute") & (uniform != ""), westlaw_search(F.concat(F.lit("Unif.Commercial Code § "), uniform), "&contentType=STATUTE"))
        .when(kind == "statute", westlaw_search(statute_term(key, t.WESTLAW), "&jurisdiction=CA&contentType=STATUTE"))
        .otherwise(westlaw_search(key, "&jurisdiction=CA"))
    )
    return F.when(lexis, lexis_search(by_lexis)).otherwise(by_westlaw)


def chosen(lexis: Column, prefix: str = "") -> Column:
    """The curated link: the provider's own, the other's, the fallback, the plain one;
    an empty one is none."""
    west, lex, fall, plain = (F.nullif(F.col(prefix + c), F.lit("")) for c in ("westlaw_url", "lexis_url", "fallback_url", "url"))
    return F.coalesce(F.when(lexis, lex).otherwise(west), F.when(lexis, west).otherwise(lex), fall, plain)


def resolve(cites: DataFrame, curated: DataFrame, provider: str = "westlaw") -> DataFrame:
    """`cites` with `link`. curated: section, key and four link columns, one row a key.
    Unpublished decisions go to the one provider that has them."""
    section = F.when(F.col("kind") == "case", "cases").when(F.col("kind") == "statute", "statutes").when(F.col("kind") == "caci", "caci").otherwise("rules")
    links = curated.select(F.col("section").alias("__s"), F.col("key").alias("__k"), "westlaw_url", "lexis_url", "fallback_url", "url")
    rows = cites.withColumn("__section", section)
    rows = rows.join(links, (F.col("__section") == F.col("__s")) & (F.col("key") == F.col("__k")), "left")
    lexis = F.when(F.col("wl_only"), F.lit(False)).when(F.col("lexis_only"), F.lit(True)).otherwise(F.lit(provider == "lexis"))
    rows = rows.withColumn("link", F.coalesce(chosen(lexis), built_url(F.col("kind"), F.col("key"), F.col("slip_only"), lexis)))
    return rows.drop("__section", "__s", "__k", "westlaw_url", "lexis_url", "fallback_url", "url")


# What of a citation is searched for when the whole is not found, in this order.
_SECTION = r"\d+(?:\.\d+)?[a-z]?(?:\([a-z0-9]+\))*"
DISTINCTIVE = (
    rf"§§?\s*{_SECTION}(?:\s*,\s*{_SECTION})?",
    rf"sections?\s+{_SECTION}",
    # A volume's number is taken whole, however long.
    r"(?<!\d)\d++\s+(?:Cal|U\.S|F|S\.\s*Ct|L\.\s*Ed|P|A|N\.[YEW]|S\.[EW]|So)\.?(?:\s*(?:App|Rptr|Supp|2d|3d|4th|5th))*\.?\s*\d{1,5}",
    r"\d{4}\s+(?:WL|U\.S\.\s*Dist\.\s*LEXIS)\s+\d{4,8}",
    r"rules?\s+\d+(?:\.\d+)*(?:\([a-z0-9]+\))*",
    rf"\d+\s+U\.\s*S\.\s*C\.[^a-z]*§§?\s*{_SECTION}",
)


def distinctive(cite: Column) -> Column:
    """The part of a citation that is least likely to be found by chance; null where there is none."""
    return F.coalesce(*[F.regexp_substr(cite, F.lit(t.java(f"(?i){p}"))) for p in DISTINCTIVE])


def opened_file(url: Column, frame: Column, bypass: str) -> Column:
    """Whether a local PDF that is opened in the top frame is shown by the viewer."""
    return (frame == 0) & url.rlike(r"(?i)^file:\/\/.*\.pdf$") & ~F.contains(url, F.lit(bypass))
