"""Registered queries of page structure, page plans, geometry and document names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import filing_text as ft
from ..functions import pages as pg
from ..functions import resolve as rs
from ..operators import citations as ct
from ..operators import document_names as dn
from ..operators import layout as lo
from ..operators import locators as lc
from ..operators import records as rc
from .record_queries import e, table


def one_each(spark, d):
    """One line item for each order and number."""
    least = [F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")]
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*least)


def _items(spark, d):
    """Line items as items of text: three lines a page, whose items are up to a unit apart."""
    return one_each(spark, d).selectExpr(
        "l_orderkey AS doc_id", "CAST(1 + l_linenumber DIV 5 AS int) AS page_no", "l_linenumber AS item_ix",
        "CASE WHEN l_linenumber % 4 = 3 THEN '''s' ELSE l_linestatus || ' ' || l_returnflag END AS str", "false AS has_eol",
        "10.0D + l_linenumber * 90 AS x", "CAST(60 - 20 * (l_linenumber % 3) + l_partkey % 2 AS DOUBLE) AS y",
    )


def page_lines(spark, d):
    return lo.lines(_items(spark, d)).select("doc_id", "page_no", "line_ix", "text")


def footer_names(spark, d):
    """What page 1's footer, or both pages', call a document."""
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no")).withColumn("height", F.lit(300.0))
    lines = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.explode(F.expr("""array(
            struct(1 AS page_no, 0 AS line_ix, 50.0D AS y, concat('OPPOSITION OF ', upper(o_orderpriority), ' TO') AS text), struct(1 AS page_no, 1 AS line_ix, 38.0D AS y, concat('MOTION ', o_orderkey % 9, ' TO STRIKE') AS text),
            struct(1 AS page_no, 2 AS line_ix, 12.0D AS y, concat('NOTICE OF HEARING ', repeat('AND LONGER ', CAST(o_orderkey % 7 AS int))) AS text), struct(1 AS page_no, 3 AS line_ix, 200.0D AS y, 'MUCH LONGER BUT FAR ABOVE ANY FOOTER THAT THERE IS' AS text), struct(1 AS page_no, 4 AS line_ix, 2.0D AS y, 'Page 1' AS text),
            struct(2 AS page_no, 0 AS line_ix, 50.0D AS y, CASE o_orderkey % 3 WHEN 0 THEN concat('Opposition of ', o_orderpriority, ' to Motion ', o_orderkey % 9, ' to Strike - Page 2') ELSE 'REPLY' END AS text))""")).alias("l"),
    )
    return lo.footer_titles(lo.footers(lines.select("doc_id", "l.*"), pages))


def captions(spark, d):
    """Right columns of first pages: metadata, a case number, the title, the hearing."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_no"),
        F.posexplode(F.expr("""array(
            struct('Dept. 5' AS str, 700.0D AS y, 400.0D AS x), struct(concat('Case No. ', o_orderkey) AS str, 600.0D AS y, 400.0D AS x), struct('LEFT' AS str, 590.0D AS y, 10.0D AS x), struct(')' AS str, 570.0D AS y, 400.0D AS x),
            struct(upper(o_orderpriority) AS str, 580.0D AS y, 480.0D AS x), struct('ANSWER OF' AS str, 580.2D AS y, 400.0D AS x), struct(IF(o_orderkey % 2 = 0, 'TO COMPLAINT', 'Judge: Roe') AS str, 560.0D AS y, 400.0D AS x),
            struct('Hearing: May 1' AS str, 540.0D AS y, 400.0D AS x), struct('AFTER' AS str, 520.0D AS y, 400.0D AS x))""")).alias("item_ix", "i"),
    )
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return lo.caption_titles(rows.select("doc_id", "page_no", "item_ix", "i.str", "i.x", "i.y"), pages)


def line_columns(spark, d):
    """Columns of line numbers of orders' pages: enough of them in two of three, high enough in half."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_no"),
        F.posexplode(F.expr("transform(sequence(1, IF(o_orderkey % 3 = 0, 7, 12)), i -> struct(CAST(i AS string) AS str, 20.0D + i % 3 * 7 AS x, 780.0D - i * IF(o_orderkey % 2 = 0, 40, 10) AS y))")).alias("item_ix", "i"),
    )
    stray = rows.where("item_ix = 0").selectExpr("doc_id", "page_no", "99 AS item_ix", "struct('77' AS str, 100.0D AS x, 300.0D AS y) AS i")
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    found = lo.line_numbers(rows.unionByName(stray).select("doc_id", "page_no", "item_ix", "i.str", "i.x", "i.y"), pages)
    return found.select("doc_id", "num", "top", "left")


def cites_on_pages(spark, d):
    """Items that cite statutes, joined to documents, and the pages of what is found; some
    citations cross a page's end."""
    items = one_each(spark, d).selectExpr(
        "l_orderkey AS doc_id", "l_linenumber AS page_no", "explode(array(struct(0 AS item_ix, 'Under Pen. Code,' AS str, l_partkey % 2 = 0 AS has_eol), struct(1 AS item_ix, concat('§ ', l_partkey, ' and') AS str, true AS has_eol), struct(2 AS item_ix, IF(l_linenumber % 3 = 0, 'Evidence Code', 'none') AS str, true AS has_eol), struct(3 AS item_ix, '' AS str, false AS has_eol))) AS i",
    )
    docs, ranges = lo.document_texts(items.select("doc_id", "page_no", "i.*"))
    return lo.on_pages(ct.find_citations(docs), ranges).select("doc_id", "page_no", "key")


def paragraph_references(spark, d):
    """From numbered spans to paragraphs: line items are spans of their supplier's document, orders
    its pages; the longest run of numbers in one column counts."""
    li = table(spark, d, "lineitem")
    pages = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page_no")).distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))
    spans = li.selectExpr(
        "l_suppkey AS doc_id", "l_orderkey AS page_no", "l_orderkey * 10 + l_linenumber AS seq", "concat(1 + (l_orderkey + l_linenumber) % 9, IF(l_partkey % 2 = 0, '. Text', ')')) AS said",
        "20.0D + l_partkey % 4 * 100 AS left", "CAST(l_linenumber * 100 AS DOUBLE) AS top",
    )
    numbers = pages.where("page_no % 3 = 0").select("doc_id", "page_no", F.lit(10.0).alias("left"), F.lit(12.0).alias("width"))
    marks = lo.paragraph_marks(lo.paragraph_candidates(spans, pages, numbers))
    bands = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list("page_no")).alias("p"))
    bands = bands.select("doc_id", F.explode(F.expr("array(element_at(p, CAST(size(p) DIV 3 + 1 AS int)), element_at(p, size(p)))")).alias("page")).distinct().withColumn("top", F.lit(0.3)).withColumn("bottom", F.lit(0.6))
    return lc.paragraph_places(bands, marks).select("doc_id", "place")


def page_plans(spark, d):
    """Plans of parts' pages after a move, a swap, a removal and a turn, checked."""
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 6 + 1).alias("num_pages"))
    plan = pg.without_page(pg.swapped(pg.moved(pg.identity_plan(docs), 3, 1), 1, 1), 0)
    plan = plan.withColumn("rotate", pg.turned(F.col("src_index") * 90, 270))
    counts = pg.page_counts(plan)
    rows = bx.checked_plan(plan, docs).join(counts, "doc_id")
    return rows.select("doc_id", "pos", "src_index", "rotate", "n_pages", F.array_join(pg.touched_pages(F.array("pos", "src_index"), F.col("n_pages")), ",").alias("touched"))


def page_geometry(spark, d):
    """Stamps, watermarks, image fits, quads and regions from line items' numbers."""
    li = table(spark, d, "lineitem")
    w, h = F.expr("400.0D + l_partkey % 300"), F.expr("500.0D + l_suppkey % 400")
    rect = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.expr("CAST(l_linenumber % 3 AS DOUBLE)").alias("w"), F.lit(5.0).alias("h")), F.struct(w.alias("x"), h.alias("y"), F.lit(2.0).alias("w"), F.lit(3.0).alias("h")))
    region = F.when(F.col("l_linenumber") > 1, F.struct(F.lit(0.2).alias("left"), F.lit(0.1).alias("top"), F.lit(0.7).alias("right"), F.lit(0.9).alias("bottom")))
    mark = pg.watermark(w, h, F.lit(90.0), 12)
    return li.select(
        "l_orderkey", "l_linenumber",
        pg.placed(F.expr("l_orderkey % 4 * 90"), w, h, F.lit(50.0), 10, 24, "r", "bottom").alias("p"), F.struct(*[F.round(mark[c], 6).alias(c) for c in ("x", "y", "degrees")]).alias("m"), F.round(pg.fitted(w * 2, h), 9).alias("scale"),
        pg.header(F.lit("{n} of {N}, {n}"), F.col("l_linenumber"), F.col("l_partkey")).alias("header"), pg.quads(rect).alias("q"),
        bx.outside(F.expr("CAST(l_partkey % 600 AS DOUBLE)"), F.expr("CAST(l_suppkey % 800 AS DOUBLE)"), F.lit(10.0), F.lit(10.0), F.lit(600.0), F.lit(800.0), region).alias("cropped"),
    ).select(
        "l_orderkey", "l_linenumber", F.col("p.x").alias("stamp_x"), F.col("p.y").alias("stamp_y"), F.col("m.x").alias("mark_x"), F.col("m.y").alias("mark_y"), "m.degrees", "scale", "header",
        F.size("q").alias("n_numbers"), F.aggregate("q", F.lit(0.0), lambda s, x: s + x).alias("sum_numbers"), F.size(pg.rectangles(F.col("q"))).alias("n_rects"), "cropped",
    )


def name_fields(spark, d):
    """Names of headers, sites, files and downloads, by parts' columns."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        ft.file_name_from_disposition(e("CASE p_partkey % 4 WHEN 0 THEN 'attachment; filename*=UTF-8''''a%20' || p_partkey || '.pdf; filename=\"x.pdf\"' WHEN 1 THEN 'inline; filename=\"' || p_name || '.pdf\"' WHEN 2 THEN 'inline; FileName= b' || p_partkey || ' ;x' ELSE 'inline' END", "h")).alias("header_name"),
        F.array_join(ft.site_patterns(F.array(e("'*.ex' || p_partkey % 9 || '.com'", "a"), e("'http://h' || p_partkey % 9 || '.org/v/'", "b"), e("'https://*.ex' || p_partkey % 5 || '.com/*'", "c"), F.lit("  "))), " ").alias("sites"),
        ft.normalized_line(e("p_name || '  x – Page ' || p_partkey || ' of 9 '", "l")).alias("line"),
        lo.page_number(e("CASE p_partkey % 5 WHEN 0 THEN 'Page ' || p_size WHEN 1 THEN '– ' || p_size || ' –' WHEN 2 THEN p_size || ' of 99' WHEN 3 THEN p_name ELSE '1' || p_size END", "n")).alias("page_number"),
        pg.part_name(F.col("p_name"), F.col("p_size"), F.col("p_size") + k % 2).alias("part_name"),
        rs.opened_file(e("'file:///a/' || p_name || CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf?bypass' ELSE '.txt' END", "u"), (k % 2).cast("int"), "bypass").alias("opened"),
        dn.download_name(F.when(k % 3 == 0, F.col("p_name")), F.when(k % 3 == 1, F.concat("p_name", F.lit("/x.PDF")))).alias("download"),
        dn.renamed_by_user(F.col("p_name"), F.when(k % 3 == 0, F.lit(" \n ")).when(k % 3 == 1, F.concat(F.lit(" New\t"), "p_name")).otherwise(F.col("p_name"))).alias("r"),
        dn.source_name(F.when(k % 4 > 0, F.col("p_name")), k % 2 == 0, F.when(k % 8 == 2, F.lit("Motion")), F.when(k % 8 == 4, F.lit("Short")).otherwise(F.lit(""))).alias("s"),
    ).select("*", F.col("r.name").alias("renamed"), "r.locked", F.col("s.name").alias("source"), "s.typed").drop("r", "s")


def form_controls(spark, d):
    """Widgets that can be filled in, of all kinds of fields."""
    widgets = table(spark, d, "part").selectExpr(
        "p_partkey", "IF(p_partkey % 11 = 0, NULL, p_name) AS field_name", "p_partkey % 13 = 0 AS push_button", "CAST(p_size % 5 AS DOUBLE) AS width", "CAST(p_partkey % 7 AS DOUBLE) AS height", "CASE p_partkey % 4 WHEN 0 THEN 'Tx' WHEN 1 THEN 'Btn' WHEN 2 THEN 'Ch' ELSE 'Sig' END AS field_type",
        "p_partkey % 3 = 0 AS multi_line", "p_partkey % 3 = 1 AS check_box", "p_partkey % 3 = 2 AS radio_button", "IF(p_partkey % 5 = 0, array(), array('a')) AS options",
    )
    return rc.form_fields(widgets).select("p_partkey", "control")


def first_labels(spark, d):
    """The first label of numberings as they are typed."""
    typed = e("CASE p_partkey % 6 WHEN 0 THEN p_size || 'x' WHEN 1 THEN '' WHEN 2 THEN '-' || p_size WHEN 3 THEN ' 0' WHEN 4 THEN p_name ELSE p_partkey || '' END", "typed")
    rows = table(spark, d, "part").select("p_partkey", "p_brand", typed)
    digits, start = ft.bates_digits(F.col("typed")), ft.bates_start(F.col("typed"))
    return rows.select("p_partkey", digits.alias("digits"), start.alias("start"), ft.bates_label(F.col("p_brand"), start, digits).alias("label"))


QUERIES = {f.__name__: f for f in (first_labels, page_lines, footer_names, captions, line_columns, cites_on_pages, paragraph_references, page_plans, page_geometry, name_fields, form_controls)}

ORACLE = {
    "first_labels": """
        WITH t AS (SELECT p_partkey, p_brand, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 2 THEN -p_size WHEN 3 THEN 0 WHEN 5 THEN p_partkey END AS n FROM part),
        c AS (SELECT p_partkey, p_brand, CAST(CASE WHEN coalesce(n, 0) = 0 THEN 6 ELSE greatest(1, least(12, n)) END AS INTEGER) AS digits, CAST(CASE WHEN n >= 0 THEN n ELSE 1 END AS BIGINT) AS start FROM t)
        SELECT p_partkey, digits, start, p_brand || lpad(start::VARCHAR, greatest(digits, length(start::VARCHAR))::INTEGER, '0') AS label FROM c
    """,
    "page_lines": """
        WITH i AS (
            SELECT l_orderkey AS doc_id, 1 + l_linenumber // 5 AS page_no, l_linenumber AS ix, l_linenumber % 3 AS row, CASE WHEN l_linenumber % 4 = 3 THEN '''s' ELSE l_linestatus || ' ' || l_returnflag END AS s
            FROM (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)
        ), g AS (
            SELECT doc_id, page_no, row, min(ix) AS first, string_agg(CASE WHEN s = '''s' THEN s ELSE ' ' || s END, '' ORDER BY ix) AS t FROM i GROUP BY ALL
        )
        SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY first) - 1 AS INTEGER) AS line_ix, ltrim(t) AS text FROM g
    """,
    "footer_names": """
        WITH t AS (
            SELECT o_orderkey AS doc_id, 'OPPOSITION OF ' || upper(o_orderpriority) || ' TO MOTION ' || o_orderkey % 9 || ' TO STRIKE' AS a, 'NOTICE OF HEARING ' || repeat('AND LONGER ', o_orderkey % 7) AS b FROM orders
        )
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR length(a) >= length(trim(b)) OR length(trim(b)) > 200 THEN a ELSE trim(b) END AS title FROM t
    """,
    "captions": "SELECT o_orderkey AS doc_id, 'ANSWER OF ' || upper(o_orderpriority) || CASE WHEN o_orderkey % 2 = 0 THEN ' TO COMPLAINT' ELSE '' END AS title FROM orders",
    "line_columns": """
        SELECT o_orderkey AS doc_id, CAST(i AS INTEGER) AS num, CAST(20 + i * 40 AS DOUBLE) AS top, CAST(20 + i % 3 * 7 AS DOUBLE) AS left
        FROM (SELECT o_orderkey, unnest(range(1, 13)) AS i FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 2 = 0)
    """,
    "cites_on_pages": "SELECT l_orderkey AS doc_id, l_linenumber AS page_no, 'PEN § ' || min(l_partkey) AS key FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "paragraph_references": """
        WITH c AS (
            SELECT l_suppkey AS doc_id, l_orderkey AS page, l_linenumber * 100 / 800.0 AS y, CAST(1 + (l_orderkey + l_linenumber) % 9 AS INTEGER) AS num, l_orderkey * 10 + l_linenumber AS seq, l_partkey % 4 AS part, round((20 + l_partkey % 4 * 100) / 600.0 / 0.03) AS col FROM lineitem
        ), k AS (
            SELECT * FROM c WHERE part < 3 AND (page % 3 > 0 OR 20 + part * 100 > 26)
        ), g AS (
            SELECT *, CASE WHEN coalesce(num = lag(num) OVER w + 1, false) THEN 0 ELSE 1 END AS b FROM k WINDOW w AS (PARTITION BY doc_id, col ORDER BY page, y, seq)
        ), r AS (
            SELECT *, sum(b) OVER (PARTITION BY doc_id, col ORDER BY page, y, seq ROWS UNBOUNDED PRECEDING) AS run, min(seq) OVER (PARTITION BY doc_id, col) AS seen FROM g
        ), z AS (
            SELECT doc_id, col, run, count(*) AS n, min(seen) AS seen FROM r GROUP BY doc_id, col, run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(seen), run) = 1
        ), m AS (
            SELECT doc_id, page, y, num, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, seq) AS seq FROM r JOIN (SELECT * FROM z WHERE n >= 3) z USING (doc_id, col, run)
        ), p AS (
            SELECT doc_id, list(page ORDER BY page) AS p FROM (SELECT DISTINCT l_suppkey AS doc_id, l_orderkey AS page FROM lineitem) GROUP BY doc_id
        ), f AS (
            SELECT m.doc_id, arg_min(num, seq) AS first, arg_max(num, seq) FILTER (WHERE page < p[len(p) // 3 + 1] OR (page = p[len(p) // 3 + 1] AND y <= 0.306)) AS a, arg_max(num, seq) FILTER (WHERE page < p[-1] OR (page = p[-1] AND y <= 0.606)) AS z
            FROM m JOIN p USING (doc_id) GROUP BY m.doc_id
        ), n AS (SELECT doc_id, coalesce(a, first) AS a, greatest(coalesce(z, a, first), coalesce(a, first)) AS z FROM f)
        SELECT doc_id, CASE WHEN a = z THEN '¶ ' || a ELSE '¶¶ ' || a || '-' || z END AS place FROM n
    """,
    "page_plans": """
        WITH p AS (
            SELECT p_partkey AS doc_id, CASE p_size % 6 + 1 WHEN 1 THEN [0] WHEN 2 THEN [1] WHEN 3 THEN [2, 1] WHEN 4 THEN [1, 3, 2] WHEN 5 THEN [1, 3, 2, 4] ELSE [1, 3, 2, 4, 5] END AS s FROM part
        ), u AS (SELECT doc_id, s, len(s) AS n_pages, unnest(range(len(s))) AS pos FROM p)
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, s[pos + 1] AS src_index, CAST((s[pos + 1] * 90 + 270) % 360 AS INTEGER) AS rotate, n_pages,
            array_to_string(list_sort(list_distinct(list_concat(range(1, n_pages + 1), [pos, s[pos + 1]]))), ',') AS touched FROM u
    """,
    "page_geometry": """
        WITH l AS (
            SELECT *, 400.0 + l_partkey % 300 AS w, 500.0 + l_suppkey % 400 AS h, l_orderkey % 4 AS t, CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 2 END AS k FROM lineitem
        ), a AS (SELECT *, CASE WHEN t % 2 = 1 THEN h ELSE w END - 74 AS r, atan2(h::DOUBLE, w::DOUBLE) AS turn FROM l)
        SELECT l_orderkey, l_linenumber, CAST(CASE t WHEN 1 THEN w - 24 WHEN 2 THEN w - r WHEN 3 THEN 24 ELSE r END AS DOUBLE) AS stamp_x, CAST(CASE t WHEN 1 THEN r WHEN 2 THEN h - 24 WHEN 3 THEN h - r ELSE 24 END AS DOUBLE) AS stamp_y,
            round(w::DOUBLE / 2 - 45 * cos(turn) - 4 * sin(turn), 6) AS mark_x, round(h::DOUBLE / 2 - 45 * sin(turn) + 4 * cos(turn), 6) AS mark_y, round(degrees(turn), 6) AS degrees, round(least(1.0::DOUBLE, 612 / (w::DOUBLE * 2), 792 / h::DOUBLE), 9) AS scale,
            l_linenumber || ' of ' || l_partkey || ', ' || l_linenumber AS header, CAST(k * 8 AS INTEGER) AS n_numbers, CAST(4 * w + 4 * h + 10 + CASE WHEN k = 2 THEN 4 + 8 + 10 + 2 * (l_linenumber % 3) ELSE 0 END AS DOUBLE) AS sum_numbers, CAST(k AS INTEGER) AS n_rects,
            l_linenumber > 1 AND NOT ((l_partkey % 600 + 5) / 600.0 BETWEEN 0.2 AND 0.7 AND (l_suppkey % 800 + 5) / 800.0 BETWEEN 0.1 AND 0.9) AS cropped FROM a
    """,
    "name_fields": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a ' || p_partkey || '.pdf' WHEN 1 THEN p_name || '.pdf' WHEN 2 THEN 'b' || p_partkey ELSE '' END AS header_name,
            'https://*.ex' || p_partkey % 9 || '.com/* http://h' || p_partkey % 9 || '.org/v/*' || CASE WHEN p_partkey % 9 = p_partkey % 5 THEN '' ELSE ' https://*.ex' || p_partkey % 5 || '.com/*' END AS sites,
            upper(replace(p_name, ' ', '')) || 'X' AS line, CAST(CASE p_partkey % 5 WHEN 3 THEN NULL WHEN 4 THEN '1' || p_size ELSE p_size::VARCHAR END AS INTEGER) AS page_number,
            p_name || ' p' || p_size || CASE WHEN p_partkey % 2 = 1 THEN '-' || (p_size + 1) ELSE '' END || '.pdf' AS part_name, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS opened,
            CASE p_partkey % 3 WHEN 0 THEN p_name || '.pdf' WHEN 1 THEN p_name || '_x.pdf' ELSE 'document.pdf' END AS download,
            CASE WHEN p_partkey % 3 = 1 THEN 'New ' || p_name ELSE p_name END AS renamed, p_partkey % 3 = 1 AS locked,
            CASE WHEN p_partkey % 4 = 0 THEN 'PDF' WHEN p_partkey % 8 = 2 THEN 'Motion' ELSE p_name END AS source, p_partkey % 8 = 2 AS typed FROM part
    """,
    "form_controls": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'textarea' ELSE 'text' END WHEN 1 THEN CASE WHEN p_partkey % 3 = 1 THEN 'checkbox' ELSE 'radio' END ELSE 'select' END AS control
        FROM part WHERE p_partkey % 11 > 0 AND p_partkey % 13 > 0 AND p_size % 5 >= 2 AND p_partkey % 7 >= 2 AND (p_partkey % 4 = 0 OR (p_partkey % 4 = 1 AND p_partkey % 3 > 0) OR (p_partkey % 4 = 2 AND p_partkey % 5 > 0))
    """,
}
