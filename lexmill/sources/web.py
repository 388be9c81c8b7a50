"""Web pages as blocks of text, and the citations of their blocks.

A block is the nearest block element around a text, or the text's own element; links,
code, editors and the like are left out. What a style sheet hides can't be known here.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.arrays import found
from ..functions.storage import stored
from ..operators import citations as ct
from ..operators.ordered import carry_forward

# Elements that are blocks, that are left out, and that have no end; the least block.
BLOCKS = frozenset(("p", "li", "td", "th", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "figcaption"))
SKIPPED = frozenset(("a", "code", "pre", "kbd", "samp", "script", "style", "textarea"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
LEAST = 6
BARE_UNIFORM = r"(?i)(?:(?<!§)§(?!§)|\bsections?|\bsecs?\.?)\s*(\d+-\d+(?:\([a-z0-9]+\))*)"
BARE_SECTION = rf"(?i){t.SIGN}({t.SECTION})"


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, element's number, left out
        self.count, self.texts = 0, {}

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
            self.open.pop()  # these end where the next begins
        self.count += 1
        out = tag in SKIPPED or dict(attrs).get("contenteditable") in ("", "true") or bool(self.open and self.open[-1][2])
        self.open.append((tag, self.count, out))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if data.strip() and self.open and not self.open[-1][2] and not any(x[0] in ("head", "title") for x in self.open):
            at = next((n for tag, n, _ in reversed(self.open) if tag in BLOCKS), self.open[-1][1])
            self.texts[at] = self.texts.get(at, "") + data


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for page, html in zip(df["page_id"], df["html"], strict=True):
            reader = _Blocks()
            reader.feed(html or "")
            reader.close()
            rows += [(page, i, text) for i, text in enumerate(x for x in reader.texts.values() if len(x) >= LEAST)]
        yield pd.DataFrame(rows, columns=["page_id", "block_ix", "text"])


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_ix, text, in the order in which blocks first hold text."""
    return pages.select(F.col("page_id").cast("long"), "html").mapInPandas(_split, "page_id long, block_ix long, text string")


def block_citations(rows: DataFrame) -> DataFrame:
    """page_id, block_ix, kind, key, start, stop of blocks' citations: those of the grammar,
    bare sections of the model code, and bare sections of the code named last before them
    on the page."""
    docs = rows.select(F.struct("page_id", "block_ix").alias("doc_id"), "text")
    named = ct.find_citations(docs).select("doc_id", "kind", "key", "start", "stop")
    named = stored(named, "block-citations")

    def bare(pattern):
        spans = found(F.coalesce("text", F.lit("")), t.java(pattern), 1)
        return docs.select("doc_id", F.inline(F.transform(spans, lambda z: F.struct(z["start"], z["stop"], z["g1"].alias("section")))))

    def clear(left, right):
        r = right.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("stop").alias("e"))
        return left.join(r, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("e")) & (F.col("stop") > F.col("s")), "left_anti")

    statute = F.lit("statute").alias("kind")
    uniform = clear(bare(BARE_UNIFORM), named).select("doc_id", statute, F.concat(F.lit("UCC § "), "section").alias("key"), "start", "stop")
    sections = clear(clear(bare(BARE_SECTION), named), uniform)
    code = F.substring_index("key", " § ", 1)
    marks = named.where((F.col("kind") == "statute") & F.contains("key", F.lit(" § "))).select("doc_id", "start", code.alias("code"))
    both = sections.unionByName(marks, allowMissingColumns=True)
    order = ["doc_id.block_ix", "start", F.col("code").isNull()]
    carried = carry_forward(both, F.col("code"), ["doc_id.page_id"], order, "last_code").where("section IS NOT NULL AND last_code IS NOT NULL")
    carried = carried.select("doc_id", statute, F.concat("last_code", F.lit(" § "), "section").alias("key"), "start", "stop")
    return named.unionByName(uniform).unionByName(carried).select("doc_id.*", "kind", "key", "start", "stop")
