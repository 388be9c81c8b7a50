"""Registered queries of locators, records, boxes and document names, with their SQL.

Inputs are made from columns of the driver's tables; the SQL states from the same columns
what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import resolve as rs
from ..operators import document_names as dn
from ..operators import locators as lc
from ..operators import records as rc


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e(sql: str, name: str):
    return F.expr(sql).alias(name)


def _selection(spark, d):
    li, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    parts = li.select(F.col("l_orderkey").alias("doc_id"), e("l_linenumber * 10.0", "x"), e("l_partkey % 380 * 1.0", "y"), F.lit(8.0).alias("width"), e("1.0 + l_suppkey % 40", "height"))
    pages = orders.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page")).selectExpr("doc_id", "page", "0.0D AS left", "(page - 1) * 128.0D AS top", "100.0D AS right", "page * 128.0D AS bottom")
    return orders, parts, pages


def selection_bands(spark, d):
    _, parts, pages = _selection(spark, d)
    return lc.selection_bands(parts, pages)


def selection_places(spark, d):
    orders, parts, pages = _selection(spark, d)
    lines = orders.where("doc_id % 5 < 3").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page")).select("doc_id", "page", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("num"))
    lines = lines.selectExpr("doc_id", "page", "num", "(num - 1) / 32.0D AS y0", "(num - 1) / 32.0D + 1 / 64.0D AS y1")
    marks = orders.where("doc_id % 3 = 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"))
    marks = marks.selectExpr("doc_id", "1 + seq DIV 2 AS page", "(seq % 2) / 2.0D AS y", "seq + 1 AS num", "seq")
    offsets = orders.where("doc_id % 7 > 0").selectExpr("doc_id", "doc_id % 5 AS offset")
    found = lc.places(lc.selection_bands(parts, pages), lines, marks, offsets)
    return found.select("doc_id", "kind", "place", lc.reference(F.lit("Doe Decl. ISO Opp."), F.col("kind"), F.col("place")).alias("reference"))


BANDS = """
    WITH p AS (
        SELECT DISTINCT l_orderkey AS doc_id, l_linenumber * 10.0 AS x, CAST(l_partkey % 380 AS DOUBLE) AS y, CAST(1 + l_suppkey % 40 AS DOUBLE) AS h FROM lineitem
    ), m AS (
        SELECT *, g.page, (g.page - 1) * 128.0 AS t FROM p, (SELECT unnest([1, 2, 3]) AS page) g WHERE x + 4 BETWEEN 0 AND 100 AND y + h / 2 BETWEEN (g.page - 1) * 128 AND g.page * 128
    ), o AS (SELECT doc_id, x, y, h, min(page) AS page, min(t) AS t FROM m GROUP BY ALL HAVING h <= 32
    ), bands AS (SELECT doc_id, page, CAST(min((y - t) / 128) AS DOUBLE) AS top, CAST(max((y + h - t) / 128) AS DOUBLE) AS bottom FROM o GROUP BY doc_id, page)
"""


def swept_registry(spark, d):
    entries = table(spark, d, "events").select(e("CASE user_id % 4 WHEN 0 THEN 'other:' || user_id WHEN 1 THEN 'titledoc:x' ELSE 'titledoc:' || user_id END", "key")).distinct()
    tabs = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("tab_id"))
    return rc.swept(entries, tabs)


def final_names(spark, d):
    orders = table(spark, d, "orders")
    history = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("final_name"))
    names = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), e("IF(o_orderkey % 2 = 0, o_orderpriority, o_orderstatus)", "name"))
    return rc.with_final_names(history, names)


def naming_overrides(spark, d):
    documents = table(spark, d, "customer").select("c_custkey", e("'https://x/' || c_custkey", "url"))
    overrides = table(spark, d, "orders").select(e("'https://x/' || o_custkey", "url"), F.col("o_orderkey").alias("ts"), e("IF(o_orderkey % 3 = 0, 'source', 'footer')", "mode"))
    return rc.with_overrides(documents, overrides).select("c_custkey", dn.naming_mode(F.col("naming_mode"), F.col("c_custkey") % 2 == 0, F.lit("footer")).alias("mode"))


def stored_settings(spark, d):
    part = table(spark, d, "part")
    stored = part.where("p_partkey % 3 = 0").select(e("'k' || p_partkey", "key"), F.col("p_brand").alias("value"))
    return rc.settings(stored, part.select(e("'k' || p_partkey", "key"), F.col("p_type").alias("default")))


def _history(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        e("'2024-01-01T' || lpad(o_orderkey % 24, 2, '0') || ':00:00.' || lpad(o_orderkey % 1000, 3, '0') || 'Z'", "timestamp"),
        e("o_orderpriority || ', \"' || o_orderstatus || '\" & <x>'", "source_title"),
        e("IF(o_orderkey % 2 = 0, NULL, o_orderstatus)", "footer_name"),
        e("IF(o_orderkey % 5 = 0, '', o_orderpriority || '\\n')", "footer_title"),
        e("'F' || o_orderkey", "final_name"),
    )
    return rows.orderBy(F.col("timestamp").desc(), "id").limit(500)  # the history's cap


def history_csv(spark, d):
    return rc.history_csv(_history(spark, d))


def history_html(spark, d):
    return rc.history_html(_history(spark, d))


HISTORY = """
    WITH h AS (
        SELECT o_orderkey AS id, '2024-01-01T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00:00.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || 'Z' AS ts,
            o_orderpriority AS pr, o_orderstatus AS st, o_orderkey AS k
        FROM orders ORDER BY ts DESC, id LIMIT 500
    ), n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id) AS position FROM h)
"""


def outlines(spark, d):
    """One tree of all parts; under every node are up to five."""
    part = table(spark, d, "part")
    return rc.outline(part.select(F.lit(1).alias("doc_id"), F.col("p_partkey").alias("id"), e("IF(p_partkey < 5, NULL, p_partkey DIV 5)", "parent_id"), e("p_partkey % 5", "ordinal"), e("IF(p_partkey % 10 = 0, '', p_name)", "title")))


def native_links(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", e("IF(l_partkey % 4 = 0, 3, 2)", "type"), e("CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'u' END", "url"), e("IF(l_partkey % 2 = 0, 'd', NULL)", "dest"),
        e("l_quantity", "x1"), e("l_discount * 100", "y1"), e("CAST(l_partkey % 50 AS DOUBLE)", "x2"), e("CAST(l_suppkey % 10 AS DOUBLE)", "y2"),
    )
    return rc.native_links(rows).select("l_orderkey", "l_linenumber", "left", "width")


def filled_forms(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    kind = "CASE o_custkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'radio' ELSE 'select' END"
    fields = orders.select("doc_id", F.lit("f").alias("name"), e(kind, "control"), F.col("o_orderstatus").alias("value"), F.array(F.lit("F"), F.lit("N"), F.lit("O")).alias("options"))
    new = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '2' WHEN 2 THEN 'N' WHEN 3 THEN '9' ELSE 'false' END"
    values = orders.where("doc_id % 7 > 1").select("doc_id", F.lit("f").alias("name"), e(new, "new"))
    return rc.filled(fields, values).select("doc_id", "name", "value")


def margin_words(spark, d):
    percent = e("CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN -3 WHEN 3 THEN 0 ELSE l_linenumber * 10 END", "p")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", percent)
    return rows.where(~bx.in_margin(F.col("l_quantity"), F.lit(100.0), F.col("p"))).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n_kept"))


def drag_regions(spark, d):
    c = [F.expr(x) for x in ("l_quantity", "l_linenumber * 8.0D", "CAST(l_partkey % 80 AS DOUBLE)", "CAST(l_suppkey % 64 AS DOUBLE)")]
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bx.dragged(*c, *[F.lit(v) for v in (16.0, 16.0, 32.0, 32.0)]).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "r.left", "r.top", "r.right", "r.bottom")


def box_bounds(spark, d):
    rect = F.struct(F.col("l_quantity").alias("x"), F.expr("CAST(l_partkey % 70 AS DOUBLE)").alias("y"), F.expr("CAST(l_suppkey % 4 AS DOUBLE)").alias("w"), F.expr("CAST(l_linenumber % 3 AS DOUBLE)").alias("h"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(rect).alias("rects"))
    px = bx.in_pixels(F.col("rects"), F.lit(100.0), F.lit(2.0))
    return rows.select("l_orderkey", bx.bounds(F.col("rects")).alias("b"), F.coalesce(F.array_min(F.transform(px, lambda r: r["top"])), F.lit(-1.0)).alias("least_top")).select("l_orderkey", "b.*", "least_top")


def nearest_pages(spark, d):
    pages = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS page", "l_linenumber * 100.0D AS top", "CAST(l_partkey % 64 AS DOUBLE) AS height")
    middles = table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", "CAST(o_custkey % 800 AS DOUBLE) AS middle")
    return bx.nearest_pages(pages, middles)


def extracted_pages(spark, d):
    plan = table(spark, d, "part").selectExpr("p_size AS doc_id", "CAST(p_partkey AS int) AS pos", "p_partkey AS src_index")
    return bx.extracted(plan, plan.where("src_index % 3 > 0"))


def document_names(spark, d):
    """Captions, footers and sources of all kinds, each by its part of a line item's keys."""
    li = table(spark, d, "lineitem")
    rows = li.select(
        "l_orderkey", "l_linenumber",
        e("CASE l_partkey % 4 WHEN 0 THEN 'Declaration of Jane Doe in support of motion' WHEN 1 THEN 'NOTICE OF HEARING ON demurrer' WHEN 2 THEN 'First Amended Complaint' END", "caption"),
        e("CASE l_partkey % 4 WHEN 0 THEN 'Doe Decl. ISO Mot.' WHEN 1 THEN 'Demurrer' WHEN 2 THEN 'FAC' END", "caption_kind"),
        e("l_suppkey % 6", "pages"),
        F.array(F.lit("MOTION TO COMPEL"), e("IF(l_suppkey % 5 = 0, '(TYPE OR PRINT NAME)', 'page')", "x")).alias("lines"),
        e("CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Pleading Title' ELSE 'MOTION TO COMPEL' END", "title"),
        e("IF(l_linenumber % 2 = 0, 'footer', 'source')", "mode"),
        e("IF(l_suppkey % 3 = 0, 'Motion', NULL)", "footer_kind"), e("IF(l_suppkey % 2 = 0, NULL, 'footer name')", "footer_name"),
        e("l_orderkey % 2 = 0", "typed"), e("IF(l_orderkey % 3 = 0, '', 'source name')", "source"), e("IF(l_orderkey % 5 = 0, 'Vol. 2', NULL)", "part"),
    )
    c = F.col
    by = dn.title_source(c("caption"), c("caption_kind"), c("pages"), c("lines"), c("title"))
    name = dn.display_name(by["kind"], c("mode"), c("footer_kind"), c("footer_name"), c("source"), c("typed"), c("part"))
    return rows.select("l_orderkey", "l_linenumber", by["source"].alias("title_source"), by["kind"].alias("caption_name"), name.alias("name"))


def bare_notices(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    cites = orders.where("o_custkey % 3 = 0").select("doc_id", F.lit("case").alias("kind")).unionByName(orders.where("doc_id % 2 = 0").select("doc_id", F.lit("rule").alias("kind")))
    docs = orders.select("doc_id", e("IF(doc_id % 3 = 0, 'Reply', 'Motion')", "canonical"), e("IF(doc_id % 5 = 0, NULL, 'NOTICE  OF MOTION and motion')", "raw"), e("o_custkey % 12", "num_pages"))
    return dn.bare_notices(rc.has_case(cites, docs)).select("doc_id", "canonical", "has_case")


def distinctive_parts(spark, d):
    said = """CASE l_partkey % 7 WHEN 0 THEN 'Civ. Code §§ ' || l_partkey || ', ' || l_suppkey || '(a)' WHEN 1 THEN 'Section ' || l_partkey || '.5(b) of' WHEN 2 THEN 'A v. B (1990) ' || l_suppkey || ' Cal.App.5th ' || l_partkey
        WHEN 3 THEN 'A v. B ' || (2000 + l_linenumber) || ' WL ' || (10000 + l_partkey) WHEN 4 THEN 'Cal. Rules of Court, rule 3.' || l_partkey || '(a)' WHEN 5 THEN 'supra' ELSE (1 + l_suppkey) || ' U.S.C. § ' || l_partkey END"""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rs.distinctive(F.expr(said)).alias("found"))


def changed_lists(spark, d):
    """A customer's orders in time, each with a list of one authority: where the list changes."""
    lists = table(spark, d, "orders").select("o_custkey", "o_orderkey", e("IF(o_orderkey % 9 = 0, 'lexis', 'westlaw')", "provider"), F.array(F.struct(F.lit("case").alias("kind"), F.col("o_orderstatus").alias("key"))).alias("authorities"))
    return rc.changed_lists(lists, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "signature")


def selected_texts(spark, d):
    """An order's priority, a glyph a letter, in spans two to a line; a box over the first letters of the upper lines."""
    spans = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority", F.explode(F.expr("sequence(1, CAST(1 + o_custkey % 7 AS int))")).alias("span"))
    letters = spans.select("doc_id", "span", F.posexplode(F.split("o_orderpriority", "")).alias("place", "said"))
    glyphs = letters.selectExpr("doc_id", "span", "place", "said", "place * 8.0D AS x", "span DIV 2 * 10.0D AS y", "8.0D AS width", "9.0D AS height", "(span % 2) * 1.0D AS span_x", "span DIV 2 * 10.0D AS span_y")
    boxes = table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", "0.0D AS left", "0.0D AS top", "8.0D * (1 + o_orderkey % 4) AS right", "26.0D AS bottom")
    return lc.selected_text(glyphs, boxes)


QUERIES = {
    f.__name__: f
    for f in (
        selection_bands, selection_places, swept_registry, final_names, naming_overrides, stored_settings, history_csv, history_html, outlines, native_links, filled_forms,
        margin_words, drag_regions, box_bounds, nearest_pages, extracted_pages, document_names, bare_notices, distinctive_parts, changed_lists, selected_texts,
    )
}

ORACLE = {
    "selection_bands": BANDS + "SELECT doc_id, CAST(page AS INTEGER) AS page, top, bottom FROM bands",
    "selection_places": BANDS + """, l AS (
        SELECT b.doc_id, b.page, min(n.num) AS low, max(n.num) AS high FROM bands b LEFT JOIN (SELECT unnest(range(1, 25)) AS num) n
            ON b.doc_id % 5 < 3 AND (n.num - 1) / 32 + 1 / 64 >= b.top - 0.004 AND (n.num - 1) / 32 <= b.bottom + 0.004 GROUP BY b.doc_id, b.page
    ), s AS (SELECT *, page + CASE WHEN doc_id % 7 > 0 THEN doc_id % 5 ELSE 0 END AS pr FROM l
    ), e AS (
        SELECT doc_id, arg_min(pr, page) AS a, arg_max(pr, page) AS z, arg_min(struct_pack(v := low), page).v AS al, arg_min(struct_pack(v := high), page).v AS ah, arg_max(struct_pack(v := high), page).v AS zh, count(low) AS k FROM s GROUP BY doc_id
    ), lines AS (
        SELECT doc_id, CASE WHEN k > 0 AND (a <> z OR al IS NOT NULL) THEN 'line' ELSE 'page' END AS kind,
            CASE WHEN NOT (k > 0 AND (a <> z OR al IS NOT NULL)) THEN CASE WHEN a = z THEN 'p. ' || a ELSE 'pp. ' || a || '-' || z END
                WHEN a = z THEN 'p. ' || a || ':' || CASE WHEN al = ah THEN '' || al ELSE al || '-' || ah END
                ELSE 'pp. ' || a || coalesce(':' || al, '') || '-' || z || coalesce(':' || zh, '') END AS place
        FROM e WHERE doc_id % 3 > 0
    ), ends AS (SELECT doc_id, min((page, top)) AS p, max((page, bottom)) AS q FROM bands WHERE doc_id % 3 = 0 GROUP BY doc_id
    ), marks AS (SELECT unnest([1, 2, 3, 4]) AS num, unnest([1, 1, 2, 2]) AS page, unnest([0, 0.5, 0, 0.5]) AS y
    ), paras AS (
        SELECT doc_id, max(CASE WHEN m.page < p[1] OR m.page = p[1] AND m.y <= p[2] + 0.006 THEN num END) AS a, max(CASE WHEN m.page < q[1] OR m.page = q[1] AND m.y <= q[2] + 0.006 THEN num END) AS z
        FROM ends, marks m GROUP BY doc_id
    ), every AS (
        SELECT doc_id, 'para' AS kind, CASE WHEN coalesce(a, 1) >= coalesce(z, 0) THEN '¶ ' || coalesce(a, 1) ELSE '¶¶ ' || coalesce(a, 1) || '-' || z END AS place FROM paras UNION ALL SELECT * FROM lines
    ) SELECT doc_id, kind, place, '(Doe Decl.' || CASE kind WHEN 'para' THEN ' ' ELSE ' at ' END || place || '.)' AS reference FROM every
    """,
    "swept_registry": """
        SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN 'other:' || user_id ELSE 'titledoc:' || user_id END AS key FROM events
        WHERE user_id % 4 = 0 OR user_id % 4 > 1 AND user_id % 3 = 0 AND user_id IN (SELECT c_custkey FROM customer)
    """,
    "final_names": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 3 THEN o_orderstatus ELSE o_orderpriority END AS final_name, o_orderkey % 6 = 3 AND o_orderstatus <> o_orderpriority AS changed FROM orders
    """,
    "naming_overrides": """
        SELECT c_custkey, CASE WHEN m IS NULL THEN CASE WHEN c_custkey % 2 = 0 THEN 'source' ELSE 'footer' END WHEN m % 3 = 0 THEN 'source' ELSE 'footer' END AS mode
        FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
    """,
    "stored_settings": "SELECT 'k' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS value FROM part",
    "history_csv": HISTORY + """
        SELECT CAST(0 AS BIGINT) AS position, chr(65279) || 'Opened,Source name,Footer name,Footer,Final name' AS line
        UNION ALL SELECT position, ts || ',"' || pr || ', ""' || st || '"" & <x>",' || CASE WHEN k % 2 = 0 THEN '' ELSE st END || ',' || CASE WHEN k % 5 = 0 THEN '' ELSE '"' || pr || chr(10) || '"' END || ',F' || k FROM n
    """,
    "history_html": HISTORY + """
        SELECT position, '<tr><td>' || replace(ts[:19], 'T', ' ') || '</td><td>' || pr || ', &quot;' || st || '&quot; &amp; &lt;x&gt;</td><td>' || CASE WHEN k % 2 = 0 THEN '<em style=''color:#aaa''>—</em>' ELSE st END
            || '</td><td>' || CASE WHEN k % 5 = 0 THEN '<em style=''color:#aaa''>—</em>' ELSE pr || chr(10) END || '</td><td>F' || k || '</td></tr>' AS line FROM n
    """,
    "outlines": """
        WITH RECURSIVE w AS (
            SELECT p_partkey AS id, p_name, 1 AS depth, [p_partkey % 5] AS path FROM part WHERE p_partkey < 5
            UNION ALL SELECT p.p_partkey, p.p_name, w.depth + 1, list_append(w.path, p.p_partkey % 5) FROM w JOIN part p ON p.p_partkey >= 5 AND p.p_partkey // 5 = w.id
        ) SELECT 1 AS doc_id, id, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY path) AS position, CASE WHEN id % 10 = 0 OR p_name = '' THEN '(untitled)' ELSE p_name END AS title FROM w
    """,
    "native_links": """
        SELECT l_orderkey, l_linenumber, least(l_quantity, l_partkey % 50) AS left, abs(CAST(l_partkey % 50 AS DOUBLE) - l_quantity) AS width FROM lineitem
        WHERE l_partkey % 4 > 0 AND (l_suppkey % 3 = 1 OR l_partkey % 2 = 0) AND abs(l_partkey % 50 - l_quantity) >= 1 AND abs(l_suppkey % 10 - l_discount * 100) >= 1
    """,
    "filled_forms": """
        SELECT o_orderkey AS doc_id, 'f' AS name, CASE WHEN o_orderkey % 7 <= 1 THEN o_orderstatus ELSE CASE o_custkey % 4
            WHEN 0 THEN ['', '2', 'N', '9', 'false'][1 + o_orderkey % 5] WHEN 1 THEN ['false', 'true', 'true', 'true', 'false'][1 + o_orderkey % 5]
            WHEN 2 THEN CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'O' WHEN 2 THEN 'N' ELSE o_orderstatus END
            ELSE CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 2 THEN 'N' ELSE o_orderstatus END END END AS value FROM orders
    """,
    "margin_words": """
        SELECT l_linenumber, count(*) AS n_kept FROM lineitem WHERE l_quantity >= CASE l_linenumber WHEN 1 THEN 8 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 30 END GROUP BY l_linenumber
    """,
    "drag_regions": """
        WITH r AS (
            SELECT l_orderkey, l_linenumber, [greatest(0, least(1, (v - 16) / 32)) FOR v IN [least(l_quantity, l_partkey % 80), least(l_linenumber * 8.0, l_suppkey % 64), greatest(l_quantity, l_partkey % 80), greatest(l_linenumber * 8.0, l_suppkey % 64)]] AS b FROM lineitem
        ), k AS (SELECT *, b[3] - b[1] >= 0.02 AND b[4] - b[2] >= 0.02 AS ok FROM r)
        SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN CAST(b[1] AS DOUBLE) END AS left, CASE WHEN ok THEN CAST(b[2] AS DOUBLE) END AS top, CASE WHEN ok THEN CAST(b[3] AS DOUBLE) END AS right, CASE WHEN ok THEN CAST(b[4] AS DOUBLE) END AS bottom FROM k
    """,
    "box_bounds": """
        WITH r AS (SELECT l_orderkey, l_quantity AS x, l_partkey % 70 AS y, l_suppkey % 4 AS w, l_linenumber % 3 AS h FROM lineitem)
        SELECT l_orderkey, min(x) FILTER (w > 0 AND h > 0) AS left, CAST(min(y) FILTER (w > 0 AND h > 0) AS DOUBLE) AS bottom, max(x + w) FILTER (w > 0 AND h > 0) AS right, CAST(max(y + h) FILTER (w > 0 AND h > 0) AS DOUBLE) AS top,
            CAST(coalesce(min((100 - y - h) * 2) FILTER (w > 0 AND h > 0), -1) AS DOUBLE) AS least_top FROM r GROUP BY l_orderkey
    """,
    "nearest_pages": """
        SELECT l_orderkey AS doc_id, arg_min(l_linenumber, (abs(l_linenumber * 100.0 + (l_partkey % 64) / 2.0 - o_custkey % 800), l_linenumber)) AS page FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey
    """,
    "extracted_pages": """
        SELECT p_size AS doc_id, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INTEGER) AS pos, p_partkey AS src_index FROM part WHERE p_partkey % 3 > 0
    """,
    "document_names": """
        WITH r AS (
            SELECT *, CASE l_partkey % 4 WHEN 0 THEN 'Doe Decl. ISO Mot.' WHEN 1 THEN CASE WHEN l_suppkey % 6 < 4 THEN 'Notice of Hearing' END WHEN 2 THEN 'FAC' END AS cap,
                CASE WHEN l_suppkey % 3 = 0 AND l_suppkey % 2 = 1 THEN 'footer name' END AS tf, CASE WHEN l_suppkey % 2 = 1 THEN 'footer name' END AS f,
                CASE WHEN l_orderkey % 3 > 0 AND l_orderkey % 2 = 0 THEN 'source name' END AS ts, CASE WHEN l_orderkey % 3 > 0 THEN 'source name' END AS s FROM lineitem
        ), n AS (SELECT *, coalesce(cap, CASE WHEN l_linenumber % 2 = 0 THEN coalesce(tf, ts, f, s) ELSE coalesce(ts, tf, s, f) END) AS nm FROM r)
        SELECT l_orderkey, l_linenumber, CASE WHEN cap IS NOT NULL THEN 'caption' WHEN l_suppkey % 5 > 0 AND l_suppkey % 4 > 1 THEN 'footer' END AS title_source, cap AS caption_name,
            CASE WHEN nm IS NULL THEN '' WHEN l_orderkey % 5 = 0 THEN nm || ' Vol. 2' ELSE nm END AS name FROM n
    """,
    "bare_notices": """
        SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Reply' WHEN o_orderkey % 5 > 0 AND o_custkey % 12 <= 8 AND o_custkey % 3 > 0 THEN 'Notice of Motion' ELSE 'Motion' END AS canonical, o_custkey % 3 = 0 AS has_case FROM orders
    """,
    "distinctive_parts": """
        SELECT l_orderkey, l_linenumber, CASE l_partkey % 7 WHEN 0 THEN '§§ ' || l_partkey || ', ' || l_suppkey || '(a)' WHEN 1 THEN 'Section ' || l_partkey || '.5(b)' WHEN 2 THEN l_suppkey || ' Cal.App.5'
            WHEN 3 THEN (2000 + l_linenumber) || ' WL ' || (10000 + l_partkey) WHEN 4 THEN 'rule 3.' || l_partkey || '(a)' WHEN 6 THEN '§ ' || l_partkey END AS found FROM lineitem
    """,
    "changed_lists": """
        WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'lexis' ELSE 'westlaw' END || '|case:' || o_orderstatus AS signature FROM orders
        ), b AS (SELECT *, lag(signature) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM s) SELECT o_custkey, o_orderkey, signature FROM b WHERE signature IS DISTINCT FROM before
    """,
    "selected_texts": """
        WITH s AS (
            SELECT o_orderkey AS doc_id, span, o_orderpriority[:1 + o_orderkey % 4] AS said FROM (SELECT *, unnest(range(1, 2 + o_custkey % 7)) AS span FROM orders) WHERE span // 2 * 10 + 4.5 <= 26
        ), l AS (SELECT doc_id, span // 2 AS y, string_agg(said, ' ' ORDER BY span % 2, span) AS said FROM s GROUP BY ALL)
        SELECT doc_id, string_agg(said, chr(10) ORDER BY y) AS text FROM l GROUP BY doc_id
    """,
}
