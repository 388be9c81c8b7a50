"""Page structure, page plans, web blocks, curated links and streams on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import filing_text as ft
from lexmill.functions import pages as pg
from lexmill.functions import resolve as rs
from lexmill.operators import citations as ct
from lexmill.operators import layout as lo
from lexmill.sources import curated, web
from lexmill.streaming import registry as rg

ITEMS = "doc_id long, page_no int, item_ix int, str string, has_eol boolean, x double, y double"


def items(spark, rows):
    return spark.createDataFrame([(d, p, i, s, e, float(x), float(y)) for d, p, i, s, e, x, y in rows], ITEMS)


def test_lines_and_footer_titles(spark):
    rows = [
        (1, 1, 0, "PLAINTIFF", False, 10, 60), (1, 1, 1, "'S OPPOSITION TO", False, 60, 61), (1, 1, 2, "DEMURRER", False, 10, 45),
        (1, 1, 3, "Page 1", False, 10, 20), (1, 1, 4, "Body text", False, 10, 500), (1, 2, 0, "PLAINTIFF'S OPPOSITION TO DEMURRER", False, 10, 60),
        (1, 1, 5, " ", False, 0, 0), (2, 1, 0, "SHORT", False, 0, 10),
    ]
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0), (2, 1, 600.0, 800.0)], "doc_id long, page_no int, width double, height double")
    found = lo.lines(items(spark, rows))
    assert [(r.y, r.text) for r in found.where("doc_id = 1 AND page_no = 1").orderBy("line_ix").collect()][0] == (60.0, "PLAINTIFF'S OPPOSITION TO")
    foot = lo.footers(found, pages)
    assert foot.where("text = 'Body text'").count() == 0
    assert {r.doc_id: r.title for r in lo.footer_titles(foot).collect()} == {1: "PLAINTIFF'S OPPOSITION TO DEMURRER"}


def test_caption_titles(spark):
    words = [("Dept. 5", 700), ("Case No. 12", 600), ("DEFENDANT'S", 580), (")", 570), ("ANSWER", 560), ("Hearing: May 1", 540), ("TO COMPLAINT", 520)]
    rows = [(1, 1, i, s, False, 400, y) for i, (s, y) in enumerate(words)] + [(1, 1, 99, "LEFT", False, 10, 590)]
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id long, page_no int, width double, height double")
    assert [r.title for r in lo.caption_titles(items(spark, rows), pages).collect()] == ["DEFENDANT'S ANSWER"]


def test_line_numbers(spark):
    rows = [(1, 1, i, str(i + 1), True, 20 + i % 3, 780 - 25 * i) for i in range(20)] + [(1, 1, 50, "7", True, 100, 300), (2, 1, 0, "1", True, 20, 700)]
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0), (2, 1, 600.0, 800.0)], "doc_id long, page_no int, width double, height double")
    got = lo.line_numbers(items(spark, rows), pages).orderBy("top").collect()
    assert [r.num for r in got] == list(range(1, 21)) and {r.doc_id for r in got} == {1}
    texts = {"12": 12, "Page 12": 12, "– 7 –": 7, "3 of 9": 3, "12345": None, "x": None}
    got = spark.createDataFrame([(s,) for s in texts], "s string").select("s", lo.page_number(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == texts


def test_documents_and_pages(spark):
    rows = [(1, 1, 0, "Civ. Code", False, 0, 0), (1, 1, 1, "§ 1", True, 0, 0), (1, 2, 0, "Pen. Code § 2", True, 0, 0)]
    docs, ranges = lo.document_texts(items(spark, rows))
    assert docs.first().text == "Civ. Code § 1\n\f\nPen. Code § 2\n\f\n"
    got = lo.on_pages(ct.find_citations(docs), ranges).collect()
    assert {(r.key, r.page_no) for r in got} == {("CIV § 1", 1), ("PEN § 2", 2)}


def test_page_plans(spark):
    plan = pg.identity_plan(spark.createDataFrame([(1, 4), (2, 1), (3, 0)], "doc_id long, num_pages int"))

    def order(p):
        return [r.src_index for r in p.where("doc_id = 1").orderBy("pos").collect()]

    assert order(plan) == [0, 1, 2, 3]
    assert order(pg.moved(plan, 3, 1)) == [0, 3, 1, 2] and order(pg.moved(plan, 0, 9)) == [1, 2, 3, 0]
    assert order(pg.swapped(plan, 1, 1)) == [0, 2, 1, 3] and order(pg.swapped(plan, 3, 1)) == [0, 1, 2, 3]
    assert order(pg.without_page(plan, 2)) == [0, 1, 3] and pg.without_page(plan, 0).where("doc_id = 2").count() == 1


def test_boxes(spark):
    row = spark.range(1).select(
        pg.placed(F.lit(90), F.lit(600.0), F.lit(800.0), F.lit(50.0), 10, 24, "r", "bottom").alias("turned"),
        pg.placed(F.lit(0), F.lit(600.0), F.lit(800.0), F.lit(50.0), 10, 24, "l", "top").alias("plain"),
        pg.fitted(F.lit(1224.0), F.lit(100.0)).alias("scale"),
        pg.turned(F.lit(270)).alias("turn"),
        pg.header(F.lit("{n} of {N}"), F.lit(2), F.lit(9)).alias("header"),
        pg.rectangles(pg.quads(F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("w"), F.lit(4.0).alias("h"))))).alias("rects"),
        pg.watermark(F.lit(600.0), F.lit(600.0), F.lit(0.0), 0).alias("mark"),
        ft.site_pattern(F.lit("*.example.com")).alias("site"),
        ft.site_pattern(F.lit("http://ex.com/v2/")).alias("site2"),
        ft.file_name_from_disposition(F.lit("attachment; filename*=UTF-8''a%20b.pdf; filename=\"x.pdf\"")).alias("name"),
        ft.file_name_from_disposition(F.lit('inline; filename="c d.pdf"')).alias("name2"),
        ft.file_name_from_url(F.lit("https://h/x/View.aspx?doc=a%2520b.pdf")).alias("name3"),
    ).first()
    assert tuple(row.turned) == (576.0, 726.0) and tuple(row.plain) == (24.0, 766.0)
    assert row.scale == 0.5 and row.turn == 0 and row.header == "2 of 9"
    assert [tuple(r) for r in row.rects] == [(1.0, 2.0, 3.0, 4.0)] and row.mark.degrees == pytest.approx(45) and row.mark.x == 300
    assert (row.site, row.site2) == ("https://*.example.com/*", "http://ex.com/v2/*")
    assert (row.name, row.name2, row.name3) == ("a b.pdf", "c d.pdf", "a b.pdf")


def test_web(spark):
    html = (
        "<html><head><title>Civ. Code § 9</title></head><body><p>Under Code of Civil Procedure section 437c and <a>Pen. Code § 1</a> § 430.10.</p>"
        "<div>See § 1671 and § 3-310.<script>section 5</script></div><p>x<p>Evid. Code § 352; sections 353</body>"
    )
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>§ 12 alone here</p>")], "page_id long, html string")
    rows = web.blocks(pages).orderBy("page_id", "block_ix").collect()
    assert [(r.page_id, r.text) for r in rows][1] == (1, "See § 1671 and § 3-310.")
    got = {(r.block_ix, r.key) for r in web.block_citations(web.blocks(pages)).where("page_id = 1").collect()}
    assert got == {(0, "CCP § 437c"), (0, "CCP § 430.10"), (1, "CCP § 1671"), (1, "UCC § 3-310"), (2, "EVID § 352"), (2, "EVID § 353")}
    assert web.block_citations(web.blocks(pages)).where("page_id = 3").count() == 0


def test_links(spark, tmp_path):
    data = {"cases": {"A v. B (2001) 1 Cal.4th 2": {"westlaw_url": "", "fallback_url": "f"}}, "statutes": {"CCP § 1": {"lexis_url": "l", "url": "u"}}}
    (tmp_path / "links.json").write_text(json.dumps(data))
    links = curated.curated_links(spark, str(tmp_path / "links.json"))
    assert {r.section: r.n_keys for r in curated.section_counts(links).collect()} == {"cases": 1, "statutes": 1}
    cites = [
        ("case", "A v. B (2001) 1 Cal.4th 2", False, False, False), ("statute", "CCP § 1", False, False, False), ("statute", "UCC § 3-310", False, False, False),
        ("case", "C v. D 2020 WL 12345", True, False, False), ("case", "E v. F Case No. 12-34 (C.D. Cal.)", False, False, True), ("caci", "CACI No. 100", False, False, False),
    ]
    rows = spark.createDataFrame(cites, "kind string, key string, wl_only boolean, lexis_only boolean, slip_only boolean")
    west = {r.key: r.link for r in rs.resolve(rows, links).collect()}
    assert west["A v. B (2001) 1 Cal.4th 2"] == "f" and west["CCP § 1"] == "l"
    assert west["UCC § 3-310"].endswith("?query=Unif.Commercial%20Code%20%C2%A7%203-310&contentType=STATUTE")
    assert west["C v. D 2020 WL 12345"].endswith("?query=2020%20WL%2012345&jurisdiction=CA&contentType=CASE")
    assert west["E v. F Case No. 12-34 (C.D. Cal.)"].endswith("findType=Y&cite=E%20v.%20F")
    lexis = {r.key: r.link for r in rs.resolve(rows, links, "lexis").collect()}
    assert lexis["CACI No. 100"].endswith("pdsearchterms=CACI%20100") and "westlaw" in lexis["C v. D 2020 WL 12345"]


def test_streams(spark, tmp_path):
    rows = [(1, "a", "one", 0), (2, "a", None, 1), (3, "b", "two", 2), (4, "b", "two", 3)]
    events = spark.createDataFrame(rows, "n long, tab string, entry string, s long").withColumn("ts", F.timestamp_seconds("s"))
    src = str(tmp_path / "in")
    for n in (1, 2, 3, 4):
        events.where(F.col("n") == n).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    changes = rg.registry_changes(stream, "tab", "entry", F.col("entry").isNull())
    q = changes.writeStream.outputMode("update").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c1")).start()
    try:
        q.processAllAvailable()
        got = {(r.key, r.old_entry, r.new_entry) for r in spark.table("changes").collect()}
    finally:
        q.stop()
    assert ("b", None, "two") in got and not any(k == "b" and o == n for k, o, n in got)
    batch = rg.debounced(events.withColumn("ts", F.timestamp_millis(F.col("n") * 300)), "tab").collect()
    assert sorted((r.tab, r.n_changes) for r in batch) == [("a", 2), ("b", 2)]
