"""The name that a document is shown and saved under: from its caption, its footers, or its source.

Each choice is one expression over a row that holds what is known of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filing_text import gibberish, sanitized_pdf_name
from ..functions.tables import java
from .naming import with_part

# What a caption's title begins with, and limits on pages.
TITLE_WORD = r"(?i)\b(declaration|motion|opposition|demurrer|reply|petition|complaint|memorandum|notice|objection|request|order|stipulation|answer|brief|application)\b"
NOTICE = r"(?i)^notice\s+of\s+([a-z][a-z\s'.]*?)(?=\s+(?:and|to|for|on|upon|re|regarding|that|pursuant)\b|[;,()]|$)"
SMALL = ("a", "an", "the", "and", "or", "of", "to", "for", "in", "on", "at", "by", "re")
NOTICE_OF_MOTION = r"(?i)\bnotice\s+of\s+motion\b"
SHORT_NOTICE, BARE_NOTICE = 4, 8
AMENDED = ("FAC", "SAC", "TAC")


def says_declaration(caption: Column) -> Column:
    """Whether the first word of a caption that names a document is `declaration`."""
    return F.coalesce(F.lower(F.regexp_extract(caption, java(TITLE_WORD), 1)) == "declaration", F.lit(False))


def notice_name(caption: Column) -> Column:
    """`Notice of ...` where that is the first document that a caption names, else null."""
    head = F.regexp_substr(caption, F.lit(java(r"(?is)\b(?:declaration|motion|opposition|demurrer|reply|petition|complaint|memorandum|notice|objection|request|order|stipulation|answer|brief|application)\b.*")))
    words = F.split(F.btrim(F.regexp_extract(head, java(NOTICE), 1)), java(r"\s+"))

    def cased(w, i):
        low = F.lower(w)
        return F.when((i > 0) & low.isin(*SMALL), low).otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low))))

    said = F.array_join(F.transform(words, cased), " ")
    return F.when(said != "", F.concat(F.lit("Notice of "), said))


def is_placeholder(title: Column) -> Column:
    return F.coalesce(F.btrim(title).rlike(java(r"(?i)^pleading title\b")), F.lit(False))


def is_form_label(line: Column) -> Column:
    """Whether a footer line begins with `type`, as blank forms' labels do."""
    return F.coalesce(F.btrim(line).rlike(java(r"(?i)^[^A-Za-z]*type\b")), F.lit(False))


def bare_notice(canonical: Column, raw: Column, pages: Column, has_case: Column) -> Column:
    """The kind, `Notice of Motion` for a motion that is only its notice: short and citing no case."""
    only = (canonical == "Motion") & F.coalesce(raw, F.lit("")).rlike(java(NOTICE_OF_MOTION)) & (pages <= BARE_NOTICE) & ~has_case
    return F.when(only, "Notice of Motion").otherwise(canonical)


def source_name(raw: Column, altered: Column, canonical: Column, simplified: Column) -> Column:
    """struct(name, typed): from a file's name; by the naming rules only if it is to be altered."""
    raw = F.nullif(raw, F.lit(""))
    typed = F.coalesce(altered & raw.isNotNull() & canonical.isNotNull(), F.lit(False))
    name = F.when(typed, canonical).when(altered & raw.isNotNull(), F.coalesce(F.nullif(simplified, F.lit("")), raw)).otherwise(F.coalesce(raw, F.lit("PDF")))
    return F.struct(name.alias("name"), typed.alias("typed"))


def naming_mode(override: Column, is_local: Column, usual: Column) -> Column:
    return F.coalesce(F.nullif(override, F.lit("")), F.when(is_local, "source").otherwise(usual))


def title_source(caption: Column, caption_kind: Column, pages: Column, footer_lines: Column, footer_title: Column) -> Column:
    """struct(source, kind): `caption` with the kind that overrides all else, `footer` if its
    title is to be read, or null: nothing but the source names the document."""
    caption = F.nullif(caption, F.lit(""))
    declared = says_declaration(caption) & F.coalesce(caption_kind.rlike(java(r"\bDecl\.?")), F.lit(False))
    notice = F.when(pages < SHORT_NOTICE, notice_name(caption))
    kind = F.when(declared, caption_kind).when(notice.isNotNull(), notice).when(caption.isNotNull() & caption_kind.isin(*AMENDED), caption_kind)
    unread = F.exists(footer_lines, is_form_label) | (F.coalesce(footer_title, F.lit("")) == "") | gibberish(footer_title) | is_placeholder(footer_title)
    return F.struct(F.when(kind.isNotNull(), "caption").when(~unread, "footer").alias("source"), kind.alias("kind"))


def display_name(override: Column, mode: Column, footer_kind: Column, footer_name: Column, source: Column, source_typed: Column, part: Column) -> Column:
    """The name shown: a caption's kind before all; else, of footer and source, the one that
    names a kind of document, by the mode where both or neither do; with part or volume."""
    footer = F.nullif(footer_name, F.lit(""))
    source = F.nullif(source, F.lit(""))
    typed_footer, typed_source = F.when(footer_kind.isNotNull(), footer), F.when(source_typed, source)
    by_footer = F.coalesce(typed_footer, typed_source, footer, source)
    by_source = F.coalesce(typed_source, typed_footer, source, footer)
    return with_part(F.coalesce(F.nullif(override, F.lit("")), F.when(mode == "footer", by_footer).otherwise(by_source)), part)


def renamed_by_user(current: Column, typed: Column) -> Column:
    """struct(name, locked): a name typed by the user wins for good; an empty one reverts."""
    new = F.nullif(F.btrim(F.regexp_replace(typed, r"[\r\n\t]+", " ")), F.lit(""))
    return F.struct(F.coalesce(new, current).alias("name"), F.coalesce(new != current, F.lit(False)).alias("locked"))


def download_name(shown: Column, from_url: Column) -> Column:
    other = F.regexp_replace(F.coalesce(F.nullif(from_url, F.lit("")), F.lit("document")), r"(?i)\.pdf$", "")
    return sanitized_pdf_name(F.coalesce(F.nullif(shown, F.lit("")), other))


def bare_notices(documents: DataFrame) -> DataFrame:
    """`documents` (canonical, raw, num_pages, has_case) with canonical as `bare_notice` has it."""
    return documents.withColumn("canonical", bare_notice(F.col("canonical"), F.col("raw"), F.col("num_pages"), F.col("has_case")))
