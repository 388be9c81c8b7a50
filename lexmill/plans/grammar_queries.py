"""Registered queries of the whole grammar of citations, their links and web citations.

Every order is a text that cites in one of twenty shapes, with numbers and names from its
columns; the SQL says from the same columns what each shape must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import resolve as rs
from ..operators import citations as ct
from ..operators import records as rc
from ..sources import web
from .record_queries import table

NAMES = "array('Aguilar', 'Barton', 'Chen', 'Delgado', 'Evans', 'Foster', 'Garcia', 'Hughes')"
FIRMS = "array('Acme', 'Beacon', 'Cascade', 'Dorado', 'Everest', 'Fulton', 'Granite', 'Harbor')"

SHAPES = (
    "'Held in In re ' || a || ' (' || y || ') ' || v || ' Cal.4th ' || p || '.'",
    "'See Estate of ' || a || ', ' || v || ' Cal.App.4th ' || p || ' (' || y || ').'",
    "'Cf. Guardianship of ' || a || ' Antitrust Litig., No. 12-cv-34, ' || y || ' WL ' || n || ' (D. Mass. Feb. 11, ' || y || ').'",
    "a || ' Warranty Cases (' || y || ') ' || v || ' Cal.5th ' || p || ' so held.'",
    "'Unif. Commercial Code § 3-' || p || '; Com. Code, § ' || n || ' differs.'",
    "'By Bus. & Prof. Code, §§ ' || p || ', ' || (p + 1) || ', and ' || (p + 2) || '(a).'",
    "'A claim under ' || v || ' U.S.C. § ' || n || ' stands.'",
    "'California Rules of Professional Conduct 1.' || p || '(b) forbids it.'",
    "'The jury was told CACI Nos. ' || m || ', ' || (m + 1) || ', and VF ' || (m + 2) || '.'",
    "'See ' || a || ' v. ' || b || ' Corp. (' || y || ') ' || v || ' Cal.4th ' || p || ', 9. Later: ' || a || ', supra, at p. 5.'",
    "a || ' v. ' || b || ' Corp. (' || y || ') ' || v || ' Cal.4th ' || p || '. As in ' || a || ' v. ' || b || ' Corp. the court held.'",
    "a || ' v. ' || b || ', Inc., ' || y || ' WL ' || n || ', at *3 (C.D. Cal. ' || y || ').'",
    "'See ' || a || ' v. ' || b || ', ' || y || ' U.S. Dist. LEXIS ' || n || ' (N.D. Cal. Jan. 2, ' || y || ').'",
    "a || ' v. ' || b || ', Inc. Case No. 30STCV' || n || ' (Super. Ct.) is pending.'",
    "'He cites ' || a || ' v. ' || b || ' Corp., ' || v || ' F.3d ' || p || ' (9th Cir. ' || y || ').'",
    "'He cites ' || a || ' v. ' || b || ' Corp. ' || v || ' U.S. ' || p || ' (' || y || ').'",
    "'Conservatorship of ' || a || ' (' || y || ') ' || v || ' Cal.4th ' || p || ', 9. Later: Conservatorship of ' || a || ', supra, ' || v || ' Cal.4th at p. 9.'",
    "a || ' v. ' || b || ' Motor Co. (' || y || ') ' || v || ' Cal.4th ' || p || '. But ' || a || ' v. ' || b || ' Motor is old.'",
    "'The court relied at some length upon the Code of Civil\\nProcedure section ' || p || '.'",
    "'FAC § ' || p || ' is no statute, and versus is no v. at all.'",
)


def columns(orders):
    return orders.selectExpr(
        "o_orderkey AS doc_id", "o_orderkey % 20 AS shape", f"{NAMES}[o_custkey % 8] AS a", f"{FIRMS}[o_orderkey DIV 20 % 8] AS b",
        "1990 + o_custkey % 30 AS y", "1 + o_custkey % 99 AS v", "1 + o_orderkey % 997 AS p", "10000 + o_orderkey AS n", "100 + o_custkey % 3000 AS m",
    )


def cited(spark, d):
    rows = columns(table(spark, d, "orders"))
    text = F.coalesce(*[F.when(F.col("shape") == i, F.expr(s)) for i, s in enumerate(SHAPES)])
    return ct.find_citations(rows.select("doc_id", text.alias("text")))


def every_citation(spark, d):
    """Authorities of texts of all shapes, in the order of a table of authorities, with how often
    each is cited and how."""
    cites = cited(spark, d)
    how = cites.groupBy("doc_id", "kind", "key").agg(
        F.count_if("is_supra").alias("n_supra"), F.count_if("is_short_form").alias("n_short"), F.bool_or("wl_only").alias("wl_only"), F.bool_or("lexis_only").alias("lexis_only"), F.bool_or("slip_only").alias("slip_only"),
    )
    return ct.authorities(cites).select("doc_id", "kind", "key", "n_cites", "position").join(how, ["doc_id", "kind", "key"])


def every_link(spark, d):
    """The links of all shapes' citations for both providers; nothing is curated."""
    cites = cited(spark, d).select("kind", "key", "wl_only", "lexis_only", "slip_only").distinct()
    none = spark.createDataFrame([], "section string, key string, westlaw_url string, lexis_url string, fallback_url string, url string")
    west = rs.resolve(cites, none).withColumnRenamed("link", "westlaw_link")
    return rs.resolve(west, none, "lexis").select("kind", "key", "westlaw_link", F.col("link").alias("lexis_link"))


def texts_with_cases(spark, d):
    """Which texts cite a case at all."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return rc.has_case(cited(spark, d), orders)


def web_citations(spark, d):
    """Web pages written from pages' keys: a block that names a code, then bare sections in later
    blocks, of the model code in one of three; links and code are no text."""
    rows = table(spark, d, "pages").selectExpr("CAST(page_id AS bigint) AS page_id", "page_id % 700 + 1 AS n", "page_id % 3 AS r")
    html = F.expr(
        """concat('<html><head><title>Civ. Code § 9</title></head><body><p>Before any code, see § ', n, '.</p><p>Under ',
            CASE r WHEN 0 THEN 'Code of Civil Procedure section ' WHEN 1 THEN 'Pen. Code, § ' ELSE 'Evidence Code, § ' END, n, ' and <a>Family Code § 1</a> <code>§ 3</code> § ', n + 1, '.</p>',
            '<ul><li>Then sections ', n + 2, ' is next.<li>', IF(r = 1, concat('Also § 3-', n, ' of the model.'), 'Nothing here'), '</ul></body></html>')"""
    )
    pages = rows.select("page_id", html.alias("html"))
    return web.block_citations(web.blocks(pages)).select("page_id", "block_ix", "kind", "key")


QUERIES = {f.__name__: f for f in (every_citation, every_link, texts_with_cases, web_citations)}

#: doc_id, kind, key, n_cites, supra, short, flag and the two providers' terms; `k` orders a text's keys.
EXPECTED = """
    WITH o AS (
        SELECT o_orderkey AS doc_id, o_orderkey % 20 AS s, ['Aguilar','Barton','Chen','Delgado','Evans','Foster','Garcia','Hughes'][1 + o_custkey % 8] AS a,
            ['Acme','Beacon','Cascade','Dorado','Everest','Fulton','Granite','Harbor'][1 + o_orderkey // 20 % 8] AS b, 1990 + o_custkey % 30 AS y, 1 + o_custkey % 99 AS v, 1 + o_orderkey % 997 AS p, 10000 + o_orderkey AS n, 100 + o_custkey % 3000 AS m
        FROM orders
    ), named AS (
        SELECT *, CASE s WHEN 0 THEN 'In re ' || a WHEN 1 THEN 'Estate of ' || a WHEN 2 THEN 'Guardianship of ' || a WHEN 3 THEN a || ' Warranty Cases' WHEN 16 THEN 'Conservatorship of ' || a
            WHEN 11 THEN a || ' v. ' || b || ', Inc.' WHEN 12 THEN a || ' v. ' || b WHEN 13 THEN a || ' v. ' || b || ', Inc.' WHEN 17 THEN a || ' v. ' || b || ' Motor Co.' ELSE a || ' v. ' || b || ' Corp.' END AS name,
            v || CASE s WHEN 1 THEN ' Cal.App.4th ' WHEN 3 THEN ' Cal.5th ' WHEN 14 THEN ' F.3d ' WHEN 15 THEN ' U.S. ' ELSE ' Cal.4th ' END || p AS cite
        FROM o
    ), x AS (
        SELECT doc_id, s, 1 AS k, 'case' AS kind, name || ' (' || y || ') ' || cite AS key, CASE WHEN s IN (9, 10, 16, 17) THEN 2 ELSE 1 END AS n_cites, cite AS west, name || ' ' || cite AS lexis FROM named WHERE s IN (0, 1, 3, 9, 10, 14, 15, 16, 17)
        UNION ALL SELECT doc_id, s, 1, 'case', name || ' ' || y || ' WL ' || n, 1, y || ' WL ' || n, '' FROM named WHERE s IN (2, 11)
        UNION ALL SELECT doc_id, s, 1, 'case', name || ' ' || y || ' U.S. Dist. LEXIS ' || n, 1, '', name || ' ' || y || ' U.S. Dist. LEXIS ' || n FROM named WHERE s = 12
        UNION ALL SELECT doc_id, s, 1, 'case', name || ' Case No. 30STCV' || n || ' (Super. Ct.)', 1, name, name FROM named WHERE s = 13
        UNION ALL SELECT doc_id, s, 1, 'statute', 'COM § ' || n, 1, 'CA COML § ' || n, 'Cal U Com Code § ' || n FROM o WHERE s = 4
        UNION ALL SELECT doc_id, s, 2, 'statute', 'UCC § 3-' || p, 1, 'Unif.Commercial Code § 3-' || p, 'U.C.C. § 3-' || p FROM o WHERE s = 4
        UNION ALL SELECT doc_id, s, 1 + i, 'statute', 'BPC § ' || t, 1, 'CA BUS & PROF § ' || t, 'Cal Bus & Prof Code § ' || t FROM (SELECT doc_id, s, unnest([0, 1, 2]) AS i, unnest([p::VARCHAR, (p + 1)::VARCHAR, (p + 2) || '(a)']) AS t FROM o WHERE s = 5)
        UNION ALL SELECT doc_id, s, 1, 'statute', v || ' U.S.C. § ' || n, 1, v || ' U.S.C. § ' || n, v || ' U.S.C. § ' || n FROM o WHERE s = 6
        UNION ALL SELECT doc_id, s, 1, 'rule', 'Cal. Rules of Prof. Conduct, rule 1.' || p, 1, 'Cal. Rules of Prof. Conduct, rule 1.' || p, 'Cal. Rules of Prof. Conduct, rule 1.' || p FROM o WHERE s = 7
        UNION ALL SELECT doc_id, s, 1, 'caci', 'CACI No. ' || t, 1, 'CACI ' || t, 'CACI ' || t FROM (SELECT doc_id, s, unnest([m::VARCHAR, (m + 1)::VARCHAR, 'VF-' || (m + 2)]) AS t FROM o WHERE s = 8)
        UNION ALL SELECT doc_id, s, 1, 'statute', 'CCP § ' || p, 1, 'CA CIV PRO § ' || p, 'Cal Code Civ Proc § ' || p FROM o WHERE s = 18
    )
"""
ENCODED = "replace(replace(replace(replace(replace(url_encode({}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"

ORACLE = {
    # A text's keys of one kind differ in few places, where a dictionary orders them as their code points.
    "every_citation": f"""
        {EXPECTED}
        SELECT doc_id, kind, key, CAST(n_cites AS BIGINT) AS n_cites, row_number() OVER (PARTITION BY doc_id ORDER BY key) AS position,
            CAST(s IN (9, 16) AS BIGINT) AS n_supra, CAST(s IN (10, 17) AS BIGINT) AS n_short, s IN (2, 11) AS wl_only, s = 12 AS lexis_only, s = 13 AS slip_only
        FROM x
    """,
    "every_link": f"""
        {EXPECTED}, l AS (
            SELECT DISTINCT kind, key, s,
                CASE WHEN s IN (2, 11) THEN 'https://1.next.westlaw.com/Search/Results.html?query=' || {ENCODED.format("west")} || '&jurisdiction=CA&contentType=CASE' WHEN s = 12 THEN '' WHEN kind = 'case' THEN 'https://1.next.westlaw.com/Link/Document/FullText?findType=Y&cite=' || {ENCODED.format("west")}
                    ELSE 'https://1.next.westlaw.com/Search/Results.html?query=' || {ENCODED.format("west")} || CASE WHEN key LIKE 'UCC%' THEN '&contentType=STATUTE' WHEN kind = 'statute' THEN '&jurisdiction=CA&contentType=STATUTE' ELSE '&jurisdiction=CA' END END AS w,
                'https://plus.lexis.com/search/?pdmfid=1530671&pdsearchterms=' || {ENCODED.format("lexis")} AS x
            FROM x
        )
        SELECT DISTINCT kind, key, CASE WHEN s = 12 THEN x ELSE w END AS westlaw_link, CASE WHEN s IN (2, 11) THEN w ELSE x END AS lexis_link FROM l
    """,
    "texts_with_cases": "SELECT o_orderkey AS doc_id, o_orderkey % 20 IN (0, 1, 2, 3, 9, 10, 11, 12, 13, 14, 15, 16, 17) AS has_case FROM orders",
    "web_citations": """
        WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, page_id % 700 + 1 AS n, page_id % 3 AS r, ['CCP', 'PEN', 'EVID'][1 + page_id % 3] AS c FROM pages)
        SELECT page_id, CAST(b AS BIGINT) AS block_ix, 'statute' AS kind, c || ' § ' || (n + i) AS key FROM (SELECT *, unnest([1, 1, 2]) AS b, unnest([0, 1, 2]) AS i FROM p)
        UNION ALL SELECT page_id, 3, 'statute', 'UCC § 3-' || n FROM p WHERE r = 1
    """,
}
