"""Names of documents from file names and printed titles: title casing and simplification.

Both are column expressions. A word's casing depends on its letters, on the word before it,
and on how the raw name wrote it; a name has few words, so the raw words are an array that is
searched. A null name counts as empty.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.arrays import let

# Words that stay small inside a title.
SMALL_WORDS = (
    "a", "an", "the", "for", "and", "nor", "but", "or", "yet", "so", "as", "at", "by", "from", "in", "into", "like", "near", "of", "off",
    "on", "onto", "out", "over", "past", "per", "plus", "than", "thru", "till", "to", "up", "upon", "via", "with", "amid", "anti", "re",
)
# Acronyms, abbreviations and codes as they are written.
ACRONYMS = ("FAC", "SAC", "TAC", "CEQA", "CD", "CEO", "IIED", "LLC", "LLP", "LP", "LLLP", "PC", "GP", "FEHA", "ISO", "MSJ")
ABBREVIATED = ("Inc.", "MtS")
DOTTED = (
    "Civ.", "Pen.", "Evid.", "Bus.", "Prof.", "Fam.", "Gov.", "Govt.", "Saf.", "Lab.", "Prob.", "Veh.", "Welf.", "Inst.", "Corp.", "Ins.", "Rev.", "Tax.",
    "Educ.", "Elec.", "Fin.", "Agric.", "Agr.", "Harb.", "Nav.", "Mil.", "Vet.", "Cont.", "Contract.", "Res.", "Util.", "Sts.", "Hy.", "Unemp.", "Wat.", "Com.", "Proc.",
)
# Shapes of acronyms, and double letters that ordinary short words have.
NO_VOWELS = "(?i)^[bcdfghjklmnpqrstvwxz]{2,5}$"
SMALL_ISLAND = "^[A-Z]+[a-z]{1,2}[A-Z]+$"
DOUBLED = r"(?i)(?!oo|ee|ll|ss|dd|gg|ff)([a-z])\1"
# What a name that was cleaned up is shortened by, in this order.
FIRST_PHRASES = (
    (r"(?i)\b(?:Motion|Mot\.) for Summary Judgment\b", "MSJ"),
    (r"(?i)\b(?:Motion|Mot\.) to Strike\b", "MtS"),
    (r"(?i)\bIn Sup(?:port|p\.)\s+Of\b", "ISO"),
    (r"(?i)\bIn Sup(?:port|p\.)(?=\s|\z)", "ISO"),
)
MEMORANDUM = r"(?i)\b(?:Memorandum|Memo\.|Mem\.|Memo|Mem)\s+of\s+Points\s+(?:and\s+)?Authorities\s+ISO(?:\s+|\z)"
LAST_PHRASES = ((r"(?i)\bDeclaration\b", "Decl."), (r"(?i)\bEvidentiary Objections\b", "Evid. Objs."))
SUPPORTING = ((r"(?i)\bMotion\b", "Mot."), (r"(?i)\bOpposition\b", "Opp."))
PARTIES = ((r"(?i)\bPlaintiffs\b", "Plfs."), (r"(?i)\bPlaintiff\b", "Plf."), (r"(?i)\bDefendants\b", "Defs."), (r"(?i)\bDefendant\b", "Def."))
DECLARATION = r"(?i)\bDeclaration of\s+(.+?)\s+(?:In Support of|ISO)\s+(.+)\z"
NON_OPPOSITION = r"(?i)\bNotice\s+of\s+Non\s*Opposition\b"
REPEATED = r"(?i)\b([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*) \1\b"
NAMELESS, POINTS = "document", "Memo. P. & A."

BREAK = r"(?:[:—–]|--)\z"


class Raw(NamedTuple):
    """The raw name's words: an array of (key, said, dotted), and whether it mixes cases."""

    words: Column
    mixed: Column


def _word(c: str) -> str:
    return c.rstrip(".").lower()


def _canonical(values: tuple[str, ...], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for v in values for x in (_word(v), v)]), key)


def said_as(raw: Column) -> Raw:
    """How the raw name writes each of its words: the letters, and whether a full stop is after them."""
    text = F.coalesce(raw, F.lit(""))
    whole = r"^[^a-zA-Z0-9]*([a-zA-Z0-9](?:[a-zA-Z0-9.]*[a-zA-Z0-9])?)([^a-zA-Z0-9]*)\z"

    def word(tok: Column) -> Column:
        said = F.regexp_extract(tok, whole, 1)
        return F.struct(F.lower(said).alias("key"), said.alias("said"), F.contains(F.regexp_extract(tok, whole, 2), F.lit(".")).alias("dotted"))

    words = F.filter(F.transform(F.split(text, t.java(r"[\s_]+")), word), lambda w: w["key"].rlike("[a-z]"))
    return Raw(words, text.rlike("[A-Z]") & text.rlike("[a-z]"))


def title_cased(text: Column, raw: Raw) -> Column:
    """Words capitalised as in a title: all but small words, which are capitalised first, last
    and after a colon or a dash. Acronyms and abbreviations have their own form; capitals that
    the raw name chose for a word, and shapes that only acronyms have, stay."""
    edges = r"^([^a-zA-Z0-9]*)(.*?)([^a-zA-Z0-9]*)\z"

    def of(both: Column) -> Column:
        pieces, written = both["pieces"], both["written"]

        def cased(tok: Column, i: Column) -> Column:
            def one(w: Column) -> Column:
                bare, key, lead, trail = w["bare"], w["key"], w["lead"], w["trail"]
                first, last = i <= 1, i >= F.size(pieces) - 2
                chosen = F.coalesce(both["mixed"] & w["raw"]["said"].rlike("^[^a-z]*[A-Z][^a-z]*$"), F.lit(False))
                shaped = (F.length(bare) >= 2) & (
                    key.isin([_word(a) for a in t.WESTLAW]) | bare.rlike(NO_VOWELS) | bare.rlike(SMALL_ISLAND) | (chosen & (F.length(bare) <= 5) & bare.rlike(DOUBLED))
                )
                after = (i >= 2) & F.get(pieces, i - 2).rlike(BREAK)
                capital = first | last | after | ~((F.endswith(lead, F.lit("-")) & ~first) | key.isin(list(SMALL_WORDS)))
                plain = F.when(capital, F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substring(bare, 2, 1 << 30)))).otherwise(F.lower(bare))
                acronym, short, dotted = _canonical(tuple(ACRONYMS), key), _canonical(ABBREVIATED, key), _canonical(DOTTED, key)
                dot = dotted.isNotNull() & F.coalesce(w["raw"]["dotted"], F.lit(False))
                return (
                    F.when(tok.rlike(r"^\s*\z") | tok.rlike(r"^[a-zA-Z]\.(?:[a-zA-Z]\.)*[a-zA-Z]?\z") | (bare == ""), tok)
                    .when(acronym.isNotNull(), F.concat(lead, acronym, trail))
                    .when(short.isNotNull(), F.concat(lead, F.when(chosen, F.upper(bare)).otherwise(short), trail))
                    .when(dot, F.concat(lead, F.when(chosen, F.concat(F.upper(bare), F.lit("."))).otherwise(dotted), F.regexp_replace(trail, r"^([^.]*)\.", "$1")))
                    .when(shaped, F.concat(lead, F.coalesce(w["raw"]["said"], F.upper(bare)), trail))
                    .otherwise(F.concat(lead, plain, trail))
                )

            def parts(bare: Column) -> Column:
                known = F.get(F.filter(written, lambda r: r["key"] == F.lower(bare)), F.lit(0))
                return F.struct(bare.alias("bare"), F.lower(bare).alias("key"), F.regexp_extract(tok, edges, 1).alias("lead"), F.regexp_extract(tok, edges, 3).alias("trail"), known.alias("raw"))

            return let(let(F.regexp_extract(tok, f"(?s){edges}", 2), parts), one)

        return F.array_join(F.transform(pieces, cased), "")

    pieces = F.split(F.coalesce(text, F.lit("")), t.java(r"(?<=\s)(?=\S)|(?<=\S)(?=\s)"))
    return let(F.struct(pieces.alias("pieces"), raw.words.alias("written"), raw.mixed.alias("mixed")), of)


def without_repeats(text: Column) -> Column:
    """A word that follows itself stands once; twice over, so that three in a row are one."""
    return F.regexp_replace(F.regexp_replace(text, t.java(REPEATED), "$1"), t.java(REPEATED), "$1")


def replaced(text: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
    for pattern, short in phrases:
        text = F.regexp_replace(text, t.java(pattern), short)
    return text


def counted(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(t.java(rf"(?i)\b{word}\b")))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(t.java(pattern))


def simplified(raw: Column) -> Column:
    """A short name: declarations by their declarant, replies and oppositions by that alone,
    phrases and parties abbreviated, words in title case and none repeated."""
    raw = F.coalesce(raw, F.lit(""))
    flat = F.regexp_replace(raw, "[_-]+", " ")
    clean = F.btrim(F.regexp_replace(F.regexp_replace(flat, "[^a-zA-Z. ]", ""), " +", " "))
    clean = F.regexp_replace(F.regexp_replace(clean, r"\.{2,}", "."), r"^\.+|\.+\z", "")
    said = t.java(DECLARATION)
    declarant = F.element_at(F.split(F.regexp_replace(F.regexp_extract(raw, said, 1), t.java(r"^\s+|\s+\z"), ""), t.java(r"\s+")), -1)
    declared = F.concat(declarant, F.lit(" Decl. ISO "), F.regexp_replace(F.regexp_extract(raw, said, 2), t.java(r"^\s+|\s+\z"), ""))

    def shortened(s: Column) -> Column:
        strikes = _has(flat, r"\bMtS\b|(?i:\bMotion\s+to\s+Strike\b)") | _has(s, r"\bMtS\b")
        supports = _has(flat, r"\bISO\b") | _has(s, r"\bISO\b")
        bare = F.regexp_replace(F.regexp_replace(s, t.java(MEMORANDUM), ""), "^ +| +$", "")

        def named(n: Column) -> Column:
            v = n["bare"]
            reply, opposition = (F.when(n["strikes"], f"MtS {w}").otherwise(w) for w in ("Reply", "Opposition"))
            parties = replaced(v, LAST_PHRASES)
            parties = replaced(F.when(n["supports"], replaced(parties, SUPPORTING)).otherwise(parties), PARTIES)
            return (
                F.when(v == "", POINTS)
                .when(counted(v, "Reply") > 1, reply)
                .when(counted(v, "Opposition") > 1, opposition)
                .when(counted(v, "Motion") > 1, "Motion")
                .when(counted(v, "Reply") > 0, reply)
                .when(~n["supports"] & (counted(v, "Opposition") > 0), opposition)
                .otherwise(F.btrim(F.regexp_replace(parties, " +", " ")))
            )

        return let(F.struct(bare.alias("bare"), strikes.alias("strikes"), supports.alias("supports")), named)

    short = let(clean, lambda c: let(replaced(without_repeats(title_cased(c, said_as(raw))), FIRST_PHRASES), shortened))
    name = F.when(raw.rlike(said), declared).when(_has(flat, NON_OPPOSITION), "Notice of Non-Opposition").when(clean == "", NAMELESS).otherwise(short)
    # A `v` left over from a caption is no part of the name.
    return F.regexp_replace(F.regexp_replace(name, t.java(r"\s+[Vv]\.?\z"), ""), t.java(r"\s+\z"), "")
