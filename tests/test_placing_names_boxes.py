"""Placing citations on pages, simplified names and title casing, rectangles that intersect."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators import placing, plain_names, rectangles


# --- placing ---


def by_hand(cites, spans):
    """Each citation of one page in order, over a list of the places not yet taken."""
    text = " ".join(s or "" for s in spans)
    flat, where, i = "", [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j].isspace():
            j += 1
        flat, where = (flat + " ", [*where, i]) if j > i else (flat + text[i], [*where, i])
        i = max(j, i + 1)
    taken, out = set(), []
    for seq, start, said in sorted(cites):
        said = " ".join((said or "").split())
        at = [m for m in range(len(flat)) if said and flat.startswith(said, m)]
        whole = bool(at)
        if not at:
            part = re.search(r"§§?\s*\d+|\d+ Cal\.4th \d+", said)
            said = part.group() if part else ""
            at = [m for m in range(len(flat)) if said and flat.startswith(said, m)]
        free = [m for m in at if m not in taken]
        if free:
            best = min(free, key=lambda m: (abs(m - min(start, len(flat) - 1)), m))
            taken.add(best)
            out.append((seq, where[best], where[best + len(said) - 1] + 1, whole))
    return out


def place(spark, pages):
    cites = [(d, 1, s, at, said) for d, (c, _) in pages.items() for s, at, said in c]
    spans = [(d, 1, i, said) for d, (_, sp) in pages.items() for i, said in enumerate(sp)]
    c = spark.createDataFrame(cites, "doc_id long, page_no int, seq long, start long, said string").repartition(3)
    s = spark.createDataFrame(spans, "doc_id long, page_no int, span_ix int, said string").repartition(3)
    return placing.placed(c, placing.page_texts(s)).collect()


def test_placing_by_hand(spark):
    rng = random.Random(4)
    pages = {}
    for d in range(60):
        spans = [" ".join(rng.choice(("aa", "aaa", "Civ.", "Code  §", "§ 12", "34 Cal.4th 56", " ", "")) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 6))]
        cites = [(s, rng.randint(0, 80), rng.choice(("aa", "aaa", "aa aa", "Code § 12", "Evid. Code § 12", "X v. Y (1999) 34 Cal.4th 56", "zz", "  ", None))) for s in range(rng.randint(1, 9))]
        pages[d] = (cites, spans)
    got = {}
    for r in place(spark, pages):
        got.setdefault(r.doc_id, []).append((r.seq, r.start, r.stop, r.whole))
    for d, (cites, spans) in pages.items():
        assert sorted(got.get(d, [])) == sorted(by_hand(cites, spans)), (cites, spans)


def test_placing_ties_and_spans(spark):
    spans = ["Civ. Code", "§ 1 and Civ.", "Code § 1", ""]  # the text: Civ. Code § 1 and Civ. Code § 1 .
    cites = [(0, 9, "Civ. Code\n§ 1"), (1, 0, "Civ. Code § 1"), (2, 0, "Civ. Code § 1"), (3, 0, r"\E(?")]
    rows = sorted(place(spark, {1: (cites, spans)}), key=lambda r: r.seq)
    # 9 is as far from 0 as from 18: the first counts; the second takes what is left; a third finds none.
    assert [(r.seq, r.start, r.stop, r.first_span, r.last_span) for r in rows] == [(0, 0, 13, 0, 1), (1, 18, 31, 1, 2)]


def test_placing_empty(spark):
    assert place(spark, {1: ([(0, 0, "a")], [""])}) == []


# --- simplified names ---


NAMES = [
    ("Declaration of Jane GARCIA-LOPEZ in Support of Motion", "GARCIA-LOPEZ Decl. ISO Motion"),
    ("declaration of  A B  ISO the rest V.", "B Decl. ISO the rest"),
    ("Notice_of_Non_Opposition_to_MSJ", "Notice of Non-Opposition"),
    ("reply_to-opposition", "Reply"),
    ("Reply ISO Motion to Strike", "MtS Reply"),
    ("OPPOSITION TO MtS", "MtS Opposition"),
    ("opposition to demurrer", "Opposition"),
    ("opposition re opposition", "Opposition"),
    ("MEMORANDUM OF POINTS & AUTHORITIES IN SUPPORT OF MOTION", "Mot."),
    ("Mem. of Points and Authorities in Supp. of Opposition", "Opp."),
    ("Memo of points authorities in support", "Memo. P. & A."),
    ("the the motion motion for summary judgment", "The MSJ"),
    ("mot. to strike", "MtS"),
    ("motion re motion", "Motion"),
    ("plaintiffs evidentiary objections", "Plfs. Evid. Objs."),
    ("plaintiff's answer", "Plfs. Answer"),
    ("defendant answer", "Def. Answer"),
    ("amended complaint v.", "Amended Complaint"),
    ("1234 !!", "document"),
    ("", "document"),
    (None, "document"),
    ("apple INC report", "Apple INC Report"),
    ("APPLE INC REPORT", "Apple Inc. Report"),
    ("Bus. & Prof. Code", "Bus. Prof. Code"),
    ("bus & prof code", "Bus Prof Code"),
    ("the AAPL of happy corp.", "The AAPL of Happy Corp."),
    ("PhD of the u.s.a. ccp and of", "PhD of the u.s.a. ccp and Of"),
]

CASED = [
    # text, raw, title: positions, breaks and hyphens
    ("the end of the", "the end of the", "The End of The"),
    ("reply: the answer — an end -- to all", "x", "Reply: The Answer — An End -- To All"),
    ("a -of and -word x", "x", "A -of and -word X"),
    ("  two  spaces\there ", "x", "  Two  Spaces\tHere "),
    # acronyms in their own form, with what stands around them
    ("(llc), fac iied ceqa", "x", "(LLC), FAC IIED CEQA"),
    # abbreviations: capitals count only where the raw name has small letters, too
    ("inc inc. mts", "inc", "Inc. Inc.. MtS"),
    ("inc of x", "INC of x", "INC of X"),
    ("inc", "INC", "Inc."),
    # codes with a full stop in the raw name
    ("civ code pen", "Civ. code PEN.", "Civ. Code PEN."),
    ("civ. code", "civ. code", "Civ. Code"),
    ("civ code", "civ code", "civ Code"),
    # shapes: consonants, an island of small letters, double letters that were capitals
    ("mtd of plf", "mtd of PLF", "mtd of PLF"),
    ("sky try", "x", "Sky Try"),
    ("IoT of maD", "IoT maD x", "IoT of Mad"),
    ("aapl apple aall", "AAPL apple AALL", "AAPL Apple AALL"),
    ("aapl x", "AAPL X", "Aapl X"),
    # dotted acronyms as they are
    ("u.s.a. a.", "x", "u.s.a. a."),
    ("2nd naïve É", "x", "2nd Naïve É"),
]


@pytest.fixture(scope="module")
def named(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(NAMES)], "i int, raw string")
    return {r.i: r.name for r in rows.select("i", plain_names.simplified(F.col("raw")).alias("name")).collect()}


@pytest.mark.parametrize("i", range(len(NAMES)))
def test_simplified(named, i):
    assert named[i] == NAMES[i][1]


@pytest.fixture(scope="module")
def cased(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASED)], "i int, said string, raw string")
    return {r.i: r.name for r in rows.select("i", plain_names.title_cased(F.col("said"), plain_names.said_as(F.col("raw"))).alias("name")).collect()}


@pytest.mark.parametrize("i", range(len(CASED)))
def test_title_cased(cased, i):
    assert cased[i] == CASED[i][2]


# --- rectangles ---


BOX = "doc long, id long, left double, top double, right double, bottom double"


def boxes(rng, n, first):
    out = []
    for i in range(n):
        size = rng.choice((1, 1, 2, 5, 300, 100_000, 0))
        x, y = rng.randint(-40, 40) / 2, rng.randint(-40, 40) / 2
        out.append((rng.randint(0, 2), first + i, x, y, x + size * rng.random(), y + size))
    return out


def cross(a, b):
    return a[0] == b[0] and a[2] < b[4] and a[4] > b[2] and a[3] < b[5] and a[5] > b[3]


@pytest.mark.parametrize("cell", [0.5, 4.0, 1000.0])
def test_rectangles_by_every_pair(spark, cell):
    rng = random.Random(int(cell))
    a, b = boxes(rng, 150, 0), boxes(rng, 150, 1000)
    bad = [(0, 5000, None, 0.0, 1.0, 1.0), (0, 5001, 5.0, 0.0, 3.0, 9.0), (0, 5002, float("nan"), 0.0, 1.0, 1.0), (None, 5003, 0.0, 0.0, 9.0, 9.0)]
    left, right = spark.createDataFrame(a + bad, BOX).repartition(3), spark.createDataFrame(b + bad, BOX).repartition(3)
    got = sorted((r.a_row.id, r.b_row.id) for r in rectangles.meeting(left, right, "doc", cell).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if cross(x, y))
    hit = {x for x, _ in got}
    assert sorted(r.id for r in rectangles.touched(left, right, "doc", cell).collect()) == sorted(hit)
    assert sorted(r.id for r in rectangles.untouched(left, right, "doc", cell).collect()) == sorted({x[1] for x in a + bad} - hit)


def test_rectangles_empty(spark):
    none = spark.createDataFrame([], BOX)
    assert rectangles.meeting(none, none, "doc", 1.0).collect() == []
