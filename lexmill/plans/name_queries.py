"""Registered queries of placing, simplified names and rectangles, with their SQL.

The SQL takes another way than the operators: places one by one in a recursive query, names
by the case that wrote them, rectangles by comparing all pairs of a key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import placing, plain_names, rectangles
from .record_queries import e, table


def placed_cites(spark, d):
    """Words of conversations' turns, some of them twice and one that is nowhere, placed on the
    turn's lines. A turn is a page, its lines are spans."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))
    spans = turns.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("span_ix", "said"))
    word = F.get(F.split("text", "[ \n]"), (F.col("seq") % 5 * 3).cast("int"))
    cites = turns.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seq"))
    cites = cites.select("doc_id", "page_no", F.col("seq").cast("bigint"), ((F.col("seq") * 37) % 101).cast("bigint").alias("start"), F.when(F.col("seq") == 7, "§ nowhere").otherwise(word).alias("said"))
    return placing.placed(cites, placing.page_texts(spans)).select("doc_id", "page_no", "seq", "start", "stop")


def cased_names(spark, d):
    """Title casing: parts' names with words of each tier around them."""
    raw = e(
        """CASE p_partkey % 9
            WHEN 0 THEN p_name || ' of the (llc)' WHEN 1 THEN 'the ' || p_name || ' in' WHEN 2 THEN p_name || ': a reply to' WHEN 3 THEN p_name || ' civ. code PEN. law'
            WHEN 4 THEN 'INC ' || p_name || ' MtS of BPC x' WHEN 5 THEN upper(p_name) || ' INC' WHEN 6 THEN 'u.s.a. ' || p_name || ' AAPL -of corp.'
            WHEN 7 THEN p_name || ' -- and more — to by' ELSE upper(p_name) || ' AAPL MTD CCP' END""",
        "raw",
    )
    return table(spark, d, "part").select("p_partkey", raw).select("p_partkey", plain_names.title_cased(F.col("raw"), plain_names.said_as(F.col("raw"))).alias("name"))


def simple_names(spark, d):
    """Names written from parts' and customers' columns, simplified."""
    parts = table(spark, d, "part").select(
        e("'part'", "kind"),
        F.col("p_partkey").cast("bigint").alias("id"),
        e(
            """CASE p_partkey % 12
                WHEN 0 THEN 'Declaration of Jane ' || p_name || ' in Support of Motion v.' WHEN 1 THEN 'notice_of-non_opposition_to_' || p_name WHEN 2 THEN 'reply to opposition ' || p_name
                WHEN 3 THEN 'Opposition to motion-to-strike ' || p_name WHEN 4 THEN 'MEMORANDUM OF POINTS & AUTHORITIES IN SUPPORT OF MOTION ' || p_name
                WHEN 5 THEN 'the the ' || p_name || ' motion motion_for summary-judgment' WHEN 6 THEN 'plaintiffs evidentiary objections ' || p_name WHEN 7 THEN p_name || ' defendant''s answer'
                WHEN 8 THEN p_name || '_amended complaint v.' WHEN 9 THEN 'motion ' || p_name || ' motion' WHEN 10 THEN '12 & 34 (!)' ELSE 'declaration ISO ' || p_name || ' opposition' END""",
            "raw",
        ),
    )
    customers = table(spark, d, "customer").select(e("'customer'", "kind"), F.col("c_custkey").cast("bigint").alias("id"), e("c_name || ' mot. for summary judgment'", "raw"))
    return parts.unionByName(customers).select("kind", "id", plain_names.simplified(F.col("raw")).alias("name"))


def _boxes(spark, d):
    """Boxes of line items, by supplier; every ninth is a hundred times as high."""
    li = table(spark, d, "lineitem").selectExpr("l_suppkey AS doc_id", "l_orderkey", "l_linenumber", "l_returnflag = 'R' AS marked", "l_partkey % 997 / 1.0D AS left", "l_orderkey % 4999 / 2.0D AS top", "1 + l_quantity / 2.0D AS width", "l_orderkey")
    rows = li.selectExpr("doc_id", "l_orderkey", "l_linenumber", "marked", "left", "top", "left + width AS right", "top + IF(l_orderkey % 9 = 0, 100, 1) * (l_linenumber + 0.5D) AS bottom")
    return rows.where("marked").drop("marked"), rows.where("NOT marked").drop("marked")


def crossing_boxes(spark, d):
    """How many boxes of other line items of their supplier the marked ones intersect."""
    marked, others = _boxes(spark, d)
    pairs = rectangles.meeting(marked, others, "doc_id", 4.0)
    return pairs.groupBy("a_row.l_orderkey", "a_row.l_linenumber").agg(F.count(F.lit(1)).alias("n_met"), F.max("b_row.l_orderkey").alias("last_met"))


def clear_boxes(spark, d):
    """Marked boxes that intersect none."""
    marked, others = _boxes(spark, d)
    return rectangles.untouched(marked, others, "doc_id", 4.0).select("l_orderkey", "l_linenumber")


QUERIES = {f.__name__: f for f in (placed_cites, cased_names, simple_names, crossing_boxes, clear_boxes)}

BOXES = """
    WITH b AS (
        SELECT l_suppkey AS doc_id, l_orderkey, l_linenumber, l_returnflag = 'R' AS marked, CAST(l_partkey % 997 AS DOUBLE) AS x1, l_orderkey % 4999 / 2.0 AS y1,
            l_partkey % 997 + 1 + l_quantity / 2.0 AS x2, l_orderkey % 4999 / 2.0 + CASE WHEN l_orderkey % 9 = 0 THEN 100 ELSE 1 END * (l_linenumber + 0.5) AS y2
        FROM lineitem
    )
"""
MEETS = "NOT b.marked AND a.doc_id = b.doc_id AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1"
#: A part's name in title case.
CASED = "array_to_string([upper(w[1]) || w[2:] for w in string_split(p_name, ' ')], ' ')"

ORACLE = {
    "placed_cites": """
        WITH RECURSIVE t AS (
            SELECT conv_id AS doc_id, turn AS page_no, coalesce(text, '') AS raw, replace(coalesce(text, ''), chr(10), ' ') AS text FROM conversations
        ), c AS (
            SELECT *, string_split(text, ' ')[1 + seq % 5 * 3] AS said, least(seq * 37 % 101, length(text) - 1) AS hint FROM (SELECT *, unnest(range(7)) AS seq FROM t)
        ), o AS (
            SELECT doc_id, page_no, seq, hint, said, list_filter(range(length(text)), lambda p: substring(text, p + 1, length(said)) = said) AS places FROM c
        ), f AS (
            SELECT doc_id, page_no, CAST(0 AS BIGINT) AS seq, [-1::BIGINT] AS used, CAST(NULL AS BIGINT) AS place, 0::BIGINT AS size FROM t
            UNION ALL
            SELECT doc_id, page_no, seq + 1, CASE WHEN took IS NULL THEN used ELSE list_append(used, took) END, took, size
            FROM (
                SELECT f.doc_id, f.page_no, f.seq, f.used, length(o.said) AS size,
                    list_sort(list_transform(list_filter(o.places, lambda p: o.said <> '' AND NOT list_contains(f.used, p)), lambda p: {'far': abs(p - o.hint), 'p': p}))[1].p AS took
                FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_no = f.page_no AND o.seq = f.seq
            )
        )
        SELECT doc_id, page_no, seq - 1 AS seq, place AS start, place + size AS stop FROM f WHERE place IS NOT NULL
    """,
    "cased_names": f"""
        SELECT p_partkey, CASE p_partkey % 9
            WHEN 0 THEN n || ' of the (LLC)' WHEN 1 THEN 'The ' || n || ' In' WHEN 2 THEN n || ': A Reply To' WHEN 3 THEN n || ' Civ. Code PEN. Law'
            WHEN 4 THEN 'INC ' || n || ' MtS of BPC X' WHEN 5 THEN n || ' Inc.' WHEN 6 THEN 'u.s.a. ' || n || ' AAPL -of Corp.' WHEN 7 THEN n || ' -- And More — To By' ELSE n || ' Aapl MTD CCP' END AS name
        FROM (SELECT p_partkey, {CASED} AS n FROM part)
    """,
    "simple_names": f"""
        SELECT 'part' AS kind, CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 12
            WHEN 0 THEN string_split(p_name, ' ')[-1] || ' Decl. ISO Motion' WHEN 1 THEN 'Notice of Non-Opposition' WHEN 2 THEN 'Reply' WHEN 3 THEN 'MtS Opposition' WHEN 4 THEN 'Mot. ' || n
            WHEN 5 THEN 'The ' || n || ' MSJ' WHEN 6 THEN 'Plfs. Evid. Objs. ' || n WHEN 7 THEN n || ' Defs. Answer' WHEN 8 THEN n || ' Amended Complaint' WHEN 9 THEN 'Motion'
            WHEN 10 THEN 'document' ELSE 'Decl. ISO ' || n || ' Opp.' END AS name
        FROM (SELECT p_partkey, p_name, {CASED} AS n FROM part)
        UNION ALL SELECT 'customer', CAST(c_custkey AS BIGINT), 'Customer MSJ' FROM customer
    """,
    "crossing_boxes": f"{BOXES} SELECT a.l_orderkey, a.l_linenumber, count(*) AS n_met, max(b.l_orderkey) AS last_met FROM b a JOIN b ON {MEETS} WHERE a.marked GROUP BY a.l_orderkey, a.l_linenumber",
    "clear_boxes": f"{BOXES} SELECT a.l_orderkey, a.l_linenumber FROM b a WHERE a.marked AND NOT EXISTS (SELECT 1 FROM b WHERE {MEETS})",
}
