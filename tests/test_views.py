"""The engine's views give in SQL what the operators give in Python."""

from __future__ import annotations

from lexmill.operators import citations as ct
from lexmill.plans import views


def test_views(spark):
    docs = spark.createDataFrame([(1, "Pen. Code, § 187 and Doe v. Roe (2001) 1 Cal.4th 2, 3. In Doe v. Roe it was so."), (2, None), (3, "none")], "doc_id long, text string")
    docs.createOrReplaceTempView("filings_here")
    spark.createDataFrame([(7, "PLAINTIFF'S OPPOSITION TO DEMURRER"), (8, None)], "id long, title string").createOrReplaceTempView("titles_here")
    curated = spark.createDataFrame([("statutes", "PEN § 187", None, None, "https://links.example.org/187", None)], views.NO_LINKS)
    curated.createOrReplaceTempView("links_here")
    names = views.register(spark, "filings_here", "links_here", "titles_here")
    assert names == ["lexmill_citations", "lexmill_authorities", "lexmill_links", "lexmill_titles"]
    by_sql = spark.sql("SELECT * FROM lexmill_citations ORDER BY doc_id, start").collect()
    assert by_sql == ct.find_citations(docs).orderBy("doc_id", "start").collect() and len(by_sql) == 3
    got = spark.sql("SELECT a.key, a.n_cites, l.link FROM lexmill_authorities a JOIN lexmill_links l USING (doc_id, kind, key) ORDER BY a.position").collect()
    assert [(r.key, r.n_cites) for r in got] == [("Doe v. Roe (2001) 1 Cal.4th 2", 2), ("PEN § 187", 1)] and got[1].link == "https://links.example.org/187"
    titles = spark.sql("SELECT id, canonical, target, party_label, simple_name FROM lexmill_titles ORDER BY id").collect()
    assert tuple(titles[0]) == (7, "Opposition", "Demurrer", "Plaintiff", "Opposition") and titles[1].simple_name == "document"
