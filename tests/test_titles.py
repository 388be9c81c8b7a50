"""Titles, short forms and designators, and names that tell filings apart."""

import pytest
from title_cases import GROUPS, TITLES

from lexmill.operators import naming as nm
from lexmill.operators import titles as tt

FIELDS = ("canonical", "target", "party_label", "party_name", "party")
# Names and their short forms, texts and their designators.
SHORT = {
    "Motion": "Mot.", "Mot. to Strike": "Mot.", "Opposition to Demurrer": "Opp.", "Reply to Opp. to Mot.": "Reply", "Demurrer to SAC": "Demurrer",
    "Doe Decl. ISO Opp.": "Doe Decl.", "Garcia-Lopez Decl. ISO Reply": "Garcia-Lopez Decl.", "Obj. to Anderson Decl.": "Obj.", "Evidence ISO Opp.": "Evid.",
    "Hopkins Complaint": "Compl.", "SAC": "SAC", "Pet. for Writ of Mandate": "Pet.", "Ex Parte App. for Order Shortening Time": "Ex Parte App.", "RJN ISO Opp.": "RJN",
    "UMF": "UMF", "AUMF": "AUMF", "Separate Statement": "Sep. Stmt.", "Proposed Order": "Order", "Proof of Service": "POS", "Notice of Opposition": "Notice",
    "Trial Brief": "Trial Br.", "Cross-Complaint": "Cross-Compl.", "SACC": "SACC", "Response to Evid. Objs.": "Resp. to Objs.",
    "Response to Order to Show Cause": "Resp. to OSC", "Memorandum of Points and Authorities": "MPA", "Case Management Statement": "Case Management Statement", "": "Doc.",
}
PARTS = {
    "APPENDIX OF EVIDENCE VOLUME 1": "Vol. 1", "COMPENDIUM OF EVIDENCE VOLUME 2 OF 4": "Vol. 2", "EXHIBITS, VOL. 3": "Vol. 3", "OPPOSITION VOLUME II": "Vol. 2",
    "DECLARATION OF JOHN DOE VOLUME ONE": "Vol. 1", "SEPARATE STATEMENT PART III": "Part 3", "APPENDIX PART TWO": "Part 2", "EXHIBITS PT. 4": "Part 4", "APPENDIX VOLUME NO. 2": "Vol. 2",
    "ORDER GRANTING IN PART AND DENYING IN PART MOTION": None, "THIS DOCUMENT IS PART OF THE RECORD": None, "PART IIX OF THE FILING": None, "": None,
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(raw,) for raw, _ in TITLES] + [(None,)], "raw string")
    return {r.raw: r for r in tt.parsed(rows).collect()}


@pytest.mark.parametrize(("raw", "want"), TITLES, ids=[raw[:60] for raw, _ in TITLES])
def test_title(parsed, raw, want):
    got = parsed[raw]
    assert {field: got[field] for field in want} == want


@pytest.fixture(scope="module")
def told_apart(spark):
    """All groups at once, each a group of its own."""
    columns = ("canonical", "target", "party", "party_label", "party_name", "part_vol")
    rows = [(i, e["id"], *[e.get(c) for c in columns]) for i, (_, entries, _) in enumerate(GROUPS) for e in entries]
    kinds = "group int, id string, canonical string, target string, party string, party_label string, party_name string, part_vol string"
    out = {}
    for r in nm.disambiguated(spark.createDataFrame(rows, kinds)).collect():
        out.setdefault(r.group, {})[r.id] = r.name
    return out


@pytest.mark.parametrize("i", range(len(GROUPS)), ids=[what for what, _, _ in GROUPS])
def test_told_apart(told_apart, i):
    assert told_apart[i] == GROUPS[i][2]


def test_no_title(parsed):
    assert all(parsed[None][f] is None for f in FIELDS)


def test_short_forms_and_parts(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(s,) for s in SHORT], "s string").select("s", tt.short_form(F.col("s")).alias("x")).collect()
    assert {r.s: r.x for r in rows} == SHORT
    rows = spark.createDataFrame([(s,) for s in PARTS], "s string").select("s", nm.part_volume(F.col("s")).alias("x")).collect()
    assert {r.s: r.x for r in rows} == PARTS
    pairs = [("Evidence ISO Opp.", "Vol. 1"), ("Evidence ISO Opp. Vol. 1", "Vol. 1"), ("Motion", None), ("Motion Part 1", "Part 2")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(nm.with_part(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == ["Evidence ISO Opp. Vol. 1", "Evidence ISO Opp. Vol. 1", "Motion", "Motion Part 1 Part 2"]
