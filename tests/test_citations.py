"""Detection on short texts: keys, spans, short names and flags."""

import pytest

from lexmill.functions.names import name_start, unwrapped
from lexmill.operators import citations as ct

# Texts and what must be found in them.
PENILLA = "Penilla v. Westmont Corp. (2016) 3 Cal.App.5th 205, 209"
NGUYEN = "Nguyen v. Applied Medical Resources Corp. (2016) 4 Cal.App.5th 232"
WHITLEY = "Conservatorship of Whitley (2010) 50 Cal.4th 1206"

#: text: the keys of its citations in order.
KEYS = {
    f"{WHITLEY}.": [WHITLEY],
    "Estate of Bowles (2008) 169 Cal.App.4th 684.": ["Estate of Bowles (2008) 169 Cal.App.4th 684"],
    "Guardianship of Ann S. (2009) 45 Cal.4th 1110.": ["Guardianship of Ann S. (2009) 45 Cal.4th 1110"],
    "Adoption of Kelsey S. (1992) 1 Cal.4th 816.": ["Adoption of Kelsey S. (1992) 1 Cal.4th 816"],
    "In re Marriage of Bonds (2000) 24 Cal.4th 1.": ["In re Marriage of Bonds (2000) 24 Cal.4th 1"],
    "IN RE DOE (2009) 555 F.3d 100.": ["IN RE DOE (2009) 555 F.3d 100"],
    "Conservatorship of Whitley, 50 Cal.4th 1206 (2010).": [WHITLEY],
    f"{WHITLEY}, 1214. Later: Conservatorship of Whitley, supra, 50 Cal.4th at p. 1214.": [WHITLEY] * 2,
    "In re Marriage of Bonds (2000) 24 Cal.4th 1, 25. In re Marriage of Davis (2015) 61 Cal.4th 846, 850. See In re Marriage of Davis, supra, 61 Cal.4th at p. 850.": [
        "In re Marriage of Bonds (2000) 24 Cal.4th 1",
        *["In re Marriage of Davis (2015) 61 Cal.4th 846"] * 2,
    ],
    "In re Intuniv Antitrust Litig., Civil Action No. 1:16-cv-12653-ADB, 2021 WL 517386 (D. Mass. Feb. 11, 2021).": ["In re Intuniv 2021 WL 517386"],
    "Ford Motor Warranty Cases (2025) 17 Cal.5th 1122.": ["Ford Motor Warranty Cases (2025) 17 Cal.5th 1122"],
    "Code of Civil Procedure sections 598 and 1048(b).": ["CCP § 598", "CCP § 1048(b)"],
    "Civ. Code §§ 1542, 1543, and 1544.": ["CIV § 1542", "CIV § 1543", "CIV § 1544"],
    "U.C.C. § 3-310; Com. Code § 3310; Commercial Code § 2-207(2)": ["UCC § 3-310", "COM § 3310", "UCC § 2-207(2)"],
    "42 U.S.C. § 1983 and 9 U. S. C. § 1": ["42 U.S.C. § 1983", "9 U.S.C. § 1"],
    "Cal. Rules of Court, rule 3.1300(a)(1).": ["Cal. Rules of Court, rule 3.1300"],
    "CACI Nos. 3710, 3711, and VF 3900.": ["CACI No. 3710", "CACI No. 3711", "CACI No. VF-3900"],
    "FAC § 1 is no statute": [],
    "Chillon v. Ford Motor Co., 2023 WL 3035369, at *3 (C.D. Cal. 2023). In Chillon v. Ford the\ncourt.": ["Chillon v. Ford Motor Co. 2023 WL 3035369"] * 2,
    "Lee v. Creditco Info. Sols., Inc. Case No. 30STCV12347 (Super. Ct.)": ["Lee v. Creditco Info. Sols., Inc. Case No. 30STCV12347 (Super. Ct.)"],
    "": [],
}
#: text: what its only citation covers.
SPANS = {
    f"where it “was neither provided nor explained in written English.” ({PENILLA}.)": PENILLA,
    f'It was "one-sided." ({PENILLA}.)': PENILLA,
    f"Who signed it?” ({PENILLA}.)": PENILLA,
    f"a claim against the Co.” ({PENILLA}.)": PENILLA,
    f"obligation to arbitrate. (Ibid.) {NGUYEN} distinguished the cases.": NGUYEN,
    f"again went undefined. (Id. at p. 250.) {NGUYEN} so held.": NGUYEN,
    f"The court so held. ({PENILLA}.)": PENILLA,
    "See Farmers' Insurance Exchange v. Superior Court (1992) 2 Cal.4th 377, 383.": "Farmers' Insurance Exchange v. Superior Court (1992) 2 Cal.4th 377, 383",
    "as stated in Ford Motor Co. v. Superior Court (1973) 35 Cal.App.3d 676, 679.": "Ford Motor Co. v. Superior Court (1973) 35 Cal.App.3d 676, 679",
    f"The court in {WHITLEY}, 1214 held otherwise.": WHITLEY,
}


@pytest.fixture(scope="module")
def cites(spark):
    texts = [*KEYS, *SPANS, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = ct.find_citations(rows).collect()
    return {t: sorted((r for r in found if r.doc_id == i), key=lambda r: r.start) for i, t in enumerate(texts)}


@pytest.mark.parametrize("text", KEYS)
def test_keys(cites, text):
    assert [c.key for c in cites[text]] == KEYS[text]


@pytest.mark.parametrize("text", SPANS)
def test_spans(cites, text):
    assert [c.match_text for c in cites[text]] == [SPANS[text]]


def test_spans_hold_what_they_say_and_do_not_overlap(cites):
    for text, found in cites.items():
        for c in found:
            assert text[c.start : c.stop] == c.match_text
        assert all(a.stop <= b.start for a, b in zip(found, found[1:], strict=False))
    assert not cites[None]


def test_flags(cites):
    last = [t for t in KEYS if t.startswith("Chillon")][0]
    full, short = cites[last]
    assert full.wl_only and short.wl_only and short.is_short_form and not full.is_short_form
    assert [c.slip_only for c in cites[[t for t in KEYS if t.startswith("Lee v.")][0]]] == [True]


def each(spark, use, texts):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string")
    return [r.y for r in rows.select("i", use(F.col("x")).alias("y")).orderBy("i").collect()]


#: Left of a `v.`: what the name is, or None.
LEFT = {
    "See ": None,
    "x in Smith ": "Smith",
    "Juan Carlos Meneses, et al. ": "Juan Carlos Meneses, et al. ",
    "": None,
    "   ": None,
    None: None,
    "so held. (Id. at p. 250.) Nguyen ": "Nguyen",
    "one line\nSmith ": "Smith",
    "one line Smith\n ": None,
    "Jones   Smith  & Co. ": "Smith  & Co. ",
    "held. In re Smith ": "In re Smith",
    "in Local 12 ": "Local 12",
    "and Studio 1220 Inc. ": "Studio 1220 Inc. ",
    "Studio 1220, Inc. ": "Inc. ",
    "the ARGUMENT Smith ": "Smith",
    "Cases Smith ": "Smith",
    "by Baker LLP ": "Baker LLP",
    "by Baker LLP Smith ": "Smith",
    "ex rel. Doe ": "ex rel. Doe",
    "(Estate ": "Estate",
    "in fact. Smith ": "Smith",
    "ended there.” Smith ": "Smith",
    "what? Smith ": "Smith",
    "the smith ": None,
}


def test_names_on_the_left(spark):
    got = each(spark, name_start, list(LEFT))
    for (left, want), at in zip(LEFT.items(), got, strict=True):
        assert (None if at is None else left[at:].rstrip()) == (None if want is None else want.rstrip()), left


def test_line_ends(spark):
    kept = ["Cases\nSmith v. Jones", "a long enough line that is not any heading\n\nb", "x\f\ny", "Heading\nAnother\n", "", None]
    joined = ["one two three four five six seven eight\nnine", "see Smith v. Jones\nhere", "at 12 Cal\nHeading\nis none"]
    assert each(spark, unwrapped, kept) == kept
    assert each(spark, unwrapped, joined) == [x.replace("\n", " ") for x in joined]


def test_many_citations_of_one_document(spark):
    """Overlaps of twenty thousand citations of one document, against going through them in order."""
    import random

    rng = random.Random(9)
    spans = sorted((rng.randrange(60_000), rank, i) for i, rank in enumerate(rng.choices(range(11), k=20_000)))
    rows = [(1, "case", f"k{i}", a, a + rng.choice((1, 2, 5, 40)), "m", None, False, False, False, False, False, rank, a) for a, rank, i in spans]
    kinds = "doc_id long, kind string, key string, start long, stop long, match_text string, short string, is_supra boolean, is_short_form boolean, wl_only boolean, lexis_only boolean, slip_only boolean, rank int, seq long"
    got = [(r.start, r.stop, r.key) for r in ct.without_overlaps(spark.createDataFrame(rows, kinds)).collect()]
    want, end = [], -1
    for r in sorted(rows, key=lambda r: (r[3], r[12], r[13], r[0], r[1], r[2])):
        if r[3] >= end:
            want.append((r[3], r[4], r[2]))
            end = r[4]
    assert sorted(got) == sorted(want)
