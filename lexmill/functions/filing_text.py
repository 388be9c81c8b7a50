"""Scalar functions on text, names and URLs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t
from .arrays import let

SPACE = t.java(r"\s+")
#: White space as a class, its opposite, and its characters.
LIGHT, DARK = f"[{t.WHITE}]", f"[^{t.WHITE}]"
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
PAGE_NUMBER = t.java(r"(?i)^\s*(page\s+)?\d+\s*(of\s+\d+)?\s*$")


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def letters(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z]++", "")


def needs_ocr(text: Column, least: int = 8) -> Column:
    """A page with fewer than `least` characters that are not white space."""
    return ~F.coalesce(text.rlike(f"(?:{DARK}{LIGHT}*+){{{least}}}"), F.lit(False))


def looks_like_title(text: Column) -> Column:
    s = trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(s).between(12, 200), (F.length(letters(s)) >= 8) & ~s.rlike("[a-z]{3}") & ~s.rlike(PAGE_NUMBER)).otherwise(False)


def could_be_title_line(text: Column) -> Column:
    s = trim(F.coalesce(text, F.lit("")))
    return s.rlike("[A-Za-z][^A-Za-z]*+[A-Za-z]") & ~s.rlike("[a-z]{4}") & ~s.rlike(PAGE_NUMBER)


def gibberish(title: Column) -> Column:
    """Few letters, one very long run of them, or few vowels."""
    s = F.coalesce(title, F.lit(""))

    def of(v: Column) -> Column:
        few = (v["n"] < v["dense"] * 0.55) | ((v["n"] >= 6) & (v["vowels"] < v["n"] * 0.30))
        return F.when(v["dense"] == 0, True).otherwise(few | s.rlike("[A-Za-z]{21}"))

    # Each count goes over what the one before left.
    def counts(dense: Column) -> Column:
        def vowels(said: Column) -> Column:
            return F.struct(F.length(dense).alias("dense"), F.length(said).alias("n"), F.length(F.regexp_replace(said, "[^aeiouAEIOU]++", "")).alias("vowels"))

        return let(letters(dense), vowels)

    return let(let(F.regexp_replace(s, f"{LIGHT}++", ""), counts), of)


def normalized_line(text: Column) -> Column:
    bare = F.regexp_replace(text, t.java(r"(?i)\s*[-–—]?\s*page\s+\d+(\s+of\s+\d+)?\s*$"), "")
    return F.upper(F.regexp_replace(bare, SPACE, ""))


def sanitized_pdf_name(name: Column) -> Column:
    clean = trim(F.regexp_replace(name, '[\\\\/:*?"<>|\r\n]+', "_"))
    whole = F.when(clean.rlike(r"(?i)\.pdf$"), clean).otherwise(F.concat(clean, F.lit(".pdf")))
    return F.when(F.coalesce(name, F.lit("")) == "", "document.pdf").otherwise(whole)


def decoded(s: Column) -> Column:
    """Percent-decoding that leaves plus signs, and what can't be decoded, as they are."""
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def file_name_from_url(url: Column) -> Column:
    """A .pdf token of the path or of a query value, else the path's last segment unless
    it is a script's name, else empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    values = F.transform(F.split(query, "&"), lambda p: decoded(F.replace(F.regexp_extract(p, "^[^=]*=?(.*)$", 1), F.lit("+"), F.lit(" "))))
    token = r"(?i)([^/\\?&=#]+\.pdf)(?:[?#]|$)"
    tokens = F.transform(F.concat(F.array(path), values), lambda v: F.regexp_extract(decoded(v), token, 1))
    last = decoded(F.regexp_extract(path, "([^/]+)/*$", 1))
    plain = F.when(last.rlike(r"(?i)\.(aspx|asp|php|jsp|do|cgi|html?)$"), "").otherwise(last)
    return F.coalesce(F.get(F.filter(tokens, lambda v: v != ""), F.lit(0)), plain, F.lit(""))


def file_name_from_disposition(header: Column) -> Column:
    """The extended form first, then the plain one, else empty."""
    extended = trim(F.regexp_extract(header, r"(?i)filename\*\s*=\s*([^;]+)", 1))
    coded = F.regexp_extract(extended, r"^[^']*'[^']*'(.*)$", 1)
    quotes = '^"|"$'
    value = F.when(extended.rlike("^[^']*'[^']*'"), decoded(F.regexp_replace(coded, quotes, ""))).otherwise(F.regexp_replace(extended, quotes, ""))
    quoted = F.regexp_extract(header, r'(?i)filename\s*=\s*"([^"]*)"', 1)
    bare = F.regexp_extract(header, r"(?i)filename\s*=\s*([^;]+)", 1)
    basic = trim(F.when(quoted != "", quoted).otherwise(F.regexp_replace(bare, quotes, "")))
    return F.coalesce(F.when(extended != "", value), basic, F.lit(""))


def csv_escaped(s: Column) -> Column:
    """Quoted only where a comma, a quote or a line feed is."""
    v = F.coalesce(s, F.lit(""))
    return F.when(v.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def html_escaped(s: Column) -> Column:
    out = F.coalesce(s, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def glob_pattern(glob: Column) -> Column:
    """An anchored regular expression for a URL pattern in which * stands for anything."""
    bare = F.regexp_replace(glob, r"^\|", "")
    escaped = F.replace(F.regexp_replace(bare, r"([.+^${}()|\[\]\\?])", r"\\$1"), F.lit("*"), F.lit(".*"))
    begun = F.when(F.startswith(escaped, F.lit("^")), escaped).otherwise(F.concat(F.lit("^"), escaped))
    return F.when(F.endswith(begun, F.lit(".*")) | F.endswith(begun, F.lit("$")), begun).otherwise(F.concat(begun, F.lit(".*")))


def site_pattern(raw: Column) -> Column:
    """A site as typed, as scheme://host/path*; null where there is no host or it isn't valid."""
    s = trim(raw)
    scheme = F.lower(F.regexp_extract(s, r"(?i)^(\*|https?)://", 1))
    rest = F.regexp_replace(s, r"(?i)^(\*|https?)://", "")
    host = F.regexp_extract(rest, "^([^/]*)", 1)
    path = F.regexp_replace(rest, "^[^/]*", "")
    whole = F.when(path.isin("", "/"), "/*").when(F.contains(path, F.lit("*")), path).otherwise(F.concat(path, F.lit("*")))
    out = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, whole)
    return F.when((host != "") & out.rlike(t.java(r"^(\*|https?)://(\*|(\*\.)?[^/*\s]+)/[^\s]*$")), out)


def bates_label(prefix: Column, number: Column, digits: int | Column = 6) -> Column:
    n = F.greatest(number, F.lit(0)).cast("string")
    return F.concat(prefix, F.lpad(n, F.greatest(F.lit(digits), F.length(n)), F.lit("0")))


def page_ranges(text: Column, total: Column) -> Column:
    """`1-3, 5, 8-` as an array of (first, last), clamped to 1..total, in order."""

    def number(s):
        return F.try_to_number(F.nullif(F.regexp_extract(s, r"^\s*([+-]?\d{1,9})", 1), F.lit("")), F.lit("S999999999")).cast("int")

    def span(token):
        ends = F.split(token, "-")
        a = F.when(F.contains(token, F.lit("-")), F.when(trim(ends[0]) == "", 1).otherwise(number(ends[0]))).otherwise(number(token))
        b = F.when(F.contains(token, F.lit("-")), F.when(trim(F.get(ends, F.lit(1))) == "", total).otherwise(number(F.get(ends, F.lit(1))))).otherwise(number(token))
        low, high = (F.greatest(F.lit(1), F.least(total, x)) for x in (a, b))
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(low, high).alias("first"), F.greatest(low, high).alias("last")))

    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: trim(x) != "")
    return F.filter(F.transform(tokens, lambda x: span(trim(x))), lambda x: x.isNotNull())


# The numerals that a part or volume can have.
ROMAN = tuple(f"{tens}{ones}" for tens in ("", "X", "XX", "XXX") for ones in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))[1:]


def roman_value(s: Column) -> Column:
    """1 to 39 for a well-formed numeral, else null."""
    place = F.array_position(F.array(*[F.lit(r) for r in ROMAN]), F.upper(s)).cast("int")
    return F.when(place > 0, place)


def site_patterns(sites: Column) -> Column:
    """The valid patterns of an array of sites as typed, each once, in the order first met."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(sites, F.array().cast("array<string>")), site_pattern), lambda p: p.isNotNull()))


def _leading_number(text: Column) -> Column:
    """The whole number that a text begins with; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), t.java(r"^\s*([+-]?\d{1,30})"), 1), F.lit("")).try_cast("decimal(38,0)")


def bates_digits(typed: Column) -> Column:
    """How many digits a label has: what is typed, from 1 to 12; 6 for nothing, or 0."""
    n = _leading_number(typed)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 6).otherwise(F.greatest(F.lit(1), F.least(F.lit(12), n))).cast("int")


def bates_start(typed: Column) -> Column:
    """The first label's number: what is typed, or 1 for nothing or less than 0."""
    n = _leading_number(typed)
    return F.when(n >= 0, n).otherwise(1).cast("bigint")
