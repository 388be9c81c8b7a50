"""The registered queries of the engine, and SQL for what each must return.

The driver's tables hold no legal text, so detectors run on filings written from columns
(`filings`), and the SQL derives what they must find from the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filing_text as ft
from ..functions import resolve as rs
from ..operators import citations as ct
from ..operators import naming as nm
from ..operators import ordered as od
from ..operators import titles as tl
from ..sources import web
from ..streaming import registry as rg
from . import grammar_queries, name_queries, page_queries, record_queries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(name: str):
    """A time without a zone as one of the session's zone; only differences are used."""
    return F.col(name).cast("timestamp")


FIRST = ["Aguilar", "Barton", "Chen", "Delgado", "Evans", "Foster", "Garcia", "Hughes"]
SECOND = ["Acme", "Beacon", "Cascade", "Dorado", "Everest", "Fulton", "Granite", "Harbor"]
CODED = (("Code of Civil Procedure section ", "CCP"), ("Pen. Code, § ", "PEN"), ("Evidence Code, § ", "EVID"), ("Bus. & Prof. Code, § ", "BPC"), ("Government Code sections ", "GOV"))


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per order, a sentence with one citation per line item."""
    li = table(spark, sf_dir, "lineitem")
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    case = F.concat(pick(FIRST, s % 8), F.lit(" v. "), pick(SECOND, p % 8), F.format_string(" Corp. (%d) %d Cal.4th %d, %d", 1990 + p % 30, 1 + s % 99, 1 + p % 999, 2 + p % 999))
    statute = F.concat(pick([c for c, _ in CODED], p % 5), (1 + p % 1999).cast("string"))
    rule = F.format_string("Cal. Rules of Court, rule %d.%d(a)", 2 + s % 8, 100 + p % 900)
    caci = F.format_string("CACI No. %d", 100 + p % 3900)
    cite = F.when(n % 4 == 0, case).when(n % 4 == 1, statute).when(n % 4 == 2, rule).otherwise(caci)
    lead = pick(["The court relied on ", "On page 12 of the record, see ", "As held in ", "It was held in "], s % 4)
    line = F.concat(lead, cite, F.when(p % 2 == 0, ". ").otherwise(".\n\n"))
    rows = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("lines"))
    return rows.select("doc_id", F.array_join("lines.line", "").alias("text"))


CITED = """
    SELECT l_orderkey AS doc_id,
        CASE l_linenumber % 4 WHEN 0 THEN 'case' WHEN 1 THEN 'statute' WHEN 2 THEN 'rule' ELSE 'caci' END AS kind,
        CASE l_linenumber % 4
            WHEN 0 THEN ['Aguilar','Barton','Chen','Delgado','Evans','Foster','Garcia','Hughes'][1 + l_suppkey % 8] || ' v. ' ||
                ['Acme','Beacon','Cascade','Dorado','Everest','Fulton','Granite','Harbor'][1 + l_partkey % 8] || ' Corp. (' || (1990 + l_partkey % 30) || ') ' ||
                (1 + l_suppkey % 99) || ' Cal.4th ' || (1 + l_partkey % 999)
            WHEN 1 THEN ['CCP','PEN','EVID','BPC','GOV'][1 + l_partkey % 5] || ' § ' || (1 + l_partkey % 1999)
            WHEN 2 THEN 'Cal. Rules of Court, rule ' || (2 + l_suppkey % 8) || '.' || (100 + l_partkey % 900)
            ELSE 'CACI No. ' || (100 + l_partkey % 3900) END AS key
    FROM lineitem
"""


def authorities(spark, d):
    return ct.authorities(ct.find_citations(filings(spark, d))).select("doc_id", "kind", "key", "n_cites", "position")


def resolved(spark, d):
    """Distinct authorities with links; every tenth part's curated."""
    cites = ct.find_citations(filings(spark, d)).select("kind", "key", "wl_only", "lexis_only", "slip_only").distinct()
    none = F.lit(None).cast("string")
    curated = table(spark, d, "part").where("p_partkey % 10 = 0").select(
        F.lit("caci").alias("section"),
        F.format_string("CACI No. %d", 100 + F.col("p_partkey") % 3900).alias("key"),
        F.lit("").alias("westlaw_url"),
        none.alias("lexis_url"),
        F.concat(F.lit("https://links.example.org/"), F.col("p_partkey") % 3900).alias("fallback_url"),
        none.alias("url"),
    )
    return rs.resolve(cites, curated.distinct()).select("kind", "key", "link")


def page_names(spark, d):
    pages = table(spark, d, "pages")
    name = ft.file_name_from_url(F.col("url"))
    return pages.select("page_id", name.alias("name"), ft.sanitized_pdf_name(name).alias("pdf_name"))


def site_globs(spark, d):
    """URL patterns of all kinds against all pages: the first that fits, allowed before redirected."""
    globs = spark.createDataFrame([(1, 100, "allow", "https://*.example.net/en/*"), (2, 1, "redirect", "http://*"), (3, 1, "redirect", "|https://*.example.com/*.html"), (4, 1, "redirect", "https://*example.org/de/*")], "id int, priority int, action string, glob string")
    rules = globs.withColumn("pattern", ft.glob_pattern(F.col("glob")))
    hit = table(spark, d, "pages").select("page_id", "url").join(F.broadcast(rules), F.expr("url rlike pattern"), "left")
    best = hit.groupBy("page_id").agg(F.max_by(F.struct("action", "id"), F.struct("priority", -F.col("id"))).alias("best"))
    return best.select("page_id", F.coalesce("best.action", F.lit("none")).alias("action"), F.col("best.id").alias("rule_id"))


def text_checks(spark, d):
    text = F.col("text")
    docs = table(spark, d, "documents")
    return docs.select("doc_id", ft.needs_ocr(text).alias("needs_ocr"), ft.gibberish(text).alias("gibberish"), ft.looks_like_title(text).alias("title"), ft.could_be_title_line(text).alias("title_line"))


def escaped(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(ft.csv_escaped(F.col("text"))).alias("csv_md5"), F.md5(ft.html_escaped(F.col("text"))).alias("html_md5"))


def encoded_names(spark, d):
    return table(spark, d, "part").select("p_partkey", rs.encoded(F.concat("p_name", F.lit(" & (!'~*) +é §"), "p_type")).alias("encoded"))


def carried(spark, d):
    ev = table(spark, d, "events")
    code = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return od.carry_forward(ev, code, ["user_id"], ["ts", "event_id"], "last_code").select("event_id", "last_code")


def debounced(spark, d):
    """Bursts of a user's events that are at most an hour apart."""
    ev = table(spark, d, "events")
    rows = od.gap_groups(ev, ["user_id"], ["ts", "event_id"], lambda w: F.unix_seconds(instant("ts")) - F.unix_seconds(F.lag(instant("ts")).over(w)) > 3600, "burst")
    return rows.groupBy("user_id", "burst").agg(F.count(F.lit(1)).alias("n_events"), F.max("event_id").alias("last_event"))


def rescans(spark, d):
    """When each burst of a user's changes is due for a rescan."""
    rows = rg.debounced(table(spark, d, "events").withColumn("ts", instant("ts")), "user_id")
    return rows.select("user_id", F.unix_micros("due").alias("due_us"), "n_changes")


def paragraph_runs(spark, d):
    return od.longest_run(table(spark, d, "lineitem").dropDuplicates(["l_suppkey", "l_orderkey", "l_linenumber"]), ["l_suppkey"], ["l_orderkey", "l_linenumber"], "l_linenumber", 2)


def printed_pages(spark, d):
    li = table(spark, d, "lineitem").withColumn("number", (F.col("l_partkey") % 7).cast("long")).withColumn("page", F.col("l_linenumber").cast("long")).withColumn("slot", F.col("l_returnflag"))
    return od.printed_offset(li, "l_suppkey", "slot", "page", "number").withColumnRenamed("offset", "page_offset")


def kept_spans(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(instant("ts")).alias("start"))
    ev = ev.withColumn("stop", F.col("start") + (F.col("event_id") % 50) * 60_000_000)
    return od.greedy_spans(ev, ["user_id"], "start", "stop", "event_id").select("user_id", "event_id")


def first_of_part(spark, d):
    return od.first_seen(table(spark, d, "lineitem").withColumn("pos", F.col("l_orderkey") * 100 + F.col("l_linenumber")), ["l_partkey"], "pos", ["pos"])


def as_of_markers(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    marks = ev.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("mark"))
    marks = marks.groupBy("user_id", "ts").agg(F.max("mark").alias("mark"))
    return od.as_of(ev.where("event_type <> 'click'").select("user_id", "event_id", "ts"), marks, "user_id", "ts", "mark", "marker").select("event_id", "marker")


def clear_spans(spark, d):
    ev = table(spark, d, "events").withColumn("start", F.unix_seconds(instant("ts"))).withColumn("stop", F.col("start") + F.col("event_id") % 1800)
    rows = ev.where("event_type <> 'purchase'").select("user_id", "event_id", "start", "stop")
    return od.without_overlaps(rows, ev.where("event_type = 'purchase'"), "user_id", "start", "stop", 3600).select("event_id")


def open_entries(spark, d):
    ev = table(spark, d, "events")
    return od.registry(ev, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", ["event_id", "event_type"])


def newest(spark, d):
    """The history's cap: the 500 newest."""
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")


def page_offsets(spark, d):
    return od.running_offsets(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.length("text"), 3, "page_start").select("conv_id", "turn", "page_start")


def stamped(spark, d):
    part = table(spark, d, "part")
    rows = od.chunk(part, ["p_brand"], ["p_partkey"], 20, "chunk")
    return rows.select("p_partkey", "chunk", ft.bates_label(F.concat("p_brand", F.lit("-")), F.col("p_partkey") * 7919, 5).alias("label"))


def ranges(spark, d):
    text = F.concat(F.col("p_size") % 9, F.lit("-"), F.col("p_size"), F.lit(", "), F.col("p_partkey") % 13, F.lit(",x, 8-"))
    part = table(spark, d, "part").select("p_partkey", F.posexplode(ft.page_ranges(text, F.lit(40))).alias("n", "r"))
    return part.select("p_partkey", "n", F.col("r.first").alias("first_page"), F.col("r.last").alias("last_page"))


def ladder(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(
        F.col("c_nationkey").alias("group"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "Motion").otherwise("Demurrer").alias("canonical"),
        F.col("o_orderpriority").alias("target"), F.col("c_mktsegment").alias("party_label"), F.col("c_name").alias("party_name"), F.lit(None).cast("string").alias("party"),
        F.lit(None).cast("string").alias("part_vol"),
    )
    rows = rows.groupBy("group", "canonical", "target", "party_label", "party_name", "party", "part_vol").agg(F.min("id").alias("id"))
    return nm.disambiguated(rows).select("id", "name")


def part_volumes(spark, d):
    text = F.concat(F.lit("EVIDENCE, "), pick(["VOLUME ", "Part ", "VOL. ", "Pt. "], F.col("p_partkey") % 4), pick(["IV", "iix", "12", "XXXIX", "I"], F.col("p_size") % 5), F.lit(" OF THE RECORD"))
    return table(spark, d, "part").select("p_partkey", nm.part_volume(text).alias("part_vol"))


def titles(spark, d):
    """Printed titles written from orders, and what they name. A notice of motion that is
    also the motion loses its lead, and with it the owner."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    owner = F.concat(pick(["Plaintiff", "DEFENDANT", "Receiver", "Creditco"], c % 4), F.lit("'s "))
    name = pick(FIRST, c % 8)
    raw = (
        F.when(k % 6 == 0, F.concat(owner, F.lit("Notice of Motion and Motion to "), pick(["Strike", "COMPEL", "quash"], c % 3), F.lit(" Responses in This Action")))
        .when(k % 6 == 1, F.concat(owner, F.lit("OPPOSITION TO DEMURRER")))
        .when(k % 6 == 2, F.concat(F.lit("Declaration of Jane "), F.upper(name), F.lit(" in Support of Motion to Strike")))
        .when(k % 6 == 3, F.concat(owner, F.lit("Reply to Opposition to Petition for Writ")))
        .when(k % 6 == 4, F.concat(owner, F.lit("Demurrer to SAC Case No. 12STCV345")))
        .otherwise("[PROPOSED] ORDER RE MOTION")
    )
    rows = tl.parsed(table(spark, d, "orders").select("o_orderkey", raw.alias("raw")))
    return rows.select("o_orderkey", "canonical", "target", "party_label", tl.short_form(F.col("canonical")).alias("short_form"))


def page_blocks(spark, d):
    """Blocks of text of all web pages; SQL has no reader of HTML."""
    return web.blocks(table(spark, d, "pages"))


QUERIES = {f.__name__: f for f in (authorities, resolved, page_names, site_globs, text_checks, escaped, encoded_names, carried, debounced, rescans, paragraph_runs, printed_pages, kept_spans, first_of_part, as_of_markers, clear_spans, open_entries, newest, page_offsets, stamped, ranges, ladder, part_volumes, titles, page_blocks)}

ORACLE = {
    "titles": """
        SELECT o_orderkey,
            CASE o_orderkey % 6 WHEN 0 THEN 'Motion' WHEN 1 THEN 'Opposition' WHEN 2 THEN n || ' Decl. ISO Mot.' WHEN 3 THEN 'Reply' WHEN 4 THEN 'Demurrer' ELSE 'Proposed Order' END AS canonical,
            CASE o_orderkey % 6 WHEN 0 THEN 'Mot. to ' || ['Strike','Compel','Quash'][1 + o_custkey % 3] || ' Responses' WHEN 1 THEN 'Demurrer' WHEN 3 THEN 'Opp. to Pet.' WHEN 4 THEN 'SAC' END AS target,
            CASE WHEN o_orderkey % 6 NOT IN (0, 2, 5) THEN ['Plaintiff','Defendant','Receiver','Creditco'][1 + o_custkey % 4] END AS party_label,
            CASE o_orderkey % 6 WHEN 0 THEN 'Mot.' WHEN 1 THEN 'Opp.' WHEN 2 THEN n || ' Decl.' WHEN 3 THEN 'Reply' WHEN 4 THEN 'Demurrer' ELSE 'Order' END AS short_form
        FROM (SELECT *, ['Aguilar','Barton','Chen','Delgado','Evans','Foster','Garcia','Hughes'][1 + o_custkey % 8] AS n FROM orders)
    """,
    "authorities": f"""
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['case', 'statute', 'rule', 'caci'], kind), key) AS position
        FROM (SELECT doc_id, kind, key, count(*) AS n_cites FROM ({CITED}) GROUP BY ALL)
    """,
    "rescans": """
        WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), g AS (
            SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 400000 THEN 0 ELSE 1 END AS b FROM e
        ), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
        SELECT user_id, max(t) + 400000 AS due_us, count(*) AS n_changes FROM s GROUP BY user_id, burst
    """,
    "resolved": f"""
        WITH c AS (SELECT DISTINCT kind, key FROM ({CITED})), p AS (SELECT DISTINCT 'CACI No. ' || (100 + p_partkey % 3900) AS k, p_partkey % 3900 AS n FROM part WHERE p_partkey % 10 = 0),
        e AS (SELECT c.*, p.n, CASE kind WHEN 'case' THEN regexp_extract(key, '\\) (.*)$', 1)
            WHEN 'statute' THEN CASE split_part(key, ' ', 1) WHEN 'CCP' THEN 'CA CIV PRO' WHEN 'PEN' THEN 'CA PENAL' WHEN 'EVID' THEN 'CA EVID' WHEN 'BPC' THEN 'CA BUS & PROF' ELSE 'CA GOVT' END || ' § ' || split_part(key, ' ', 3)
            WHEN 'caci' THEN replace(key, 'CACI No.', 'CACI') ELSE key END AS term FROM c LEFT JOIN p ON c.kind = 'caci' AND c.key = p.k)
        SELECT kind, key, CASE WHEN n IS NOT NULL THEN 'https://links.example.org/' || n
            WHEN kind = 'case' THEN 'https://1.next.westlaw.com/Link/Document/FullText?findType=Y&cite=' || url_encode(term)
            ELSE 'https://1.next.westlaw.com/Search/Results.html?query=' || url_encode(term) || '&jurisdiction=CA' || CASE kind WHEN 'statute' THEN '&contentType=STATUTE' ELSE '' END END AS link FROM e
    """,
    "page_names": """
        WITH s AS (SELECT page_id, split_part(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '.pdf', 1) AS path FROM pages),
        n AS (SELECT page_id, regexp_extract(path, '([^/]+)/*$', 1) AS last FROM s),
        m AS (SELECT page_id, CASE WHEN regexp_matches(last, '(?i)\\.(aspx|asp|php|jsp|do|cgi|html?)$') THEN '' ELSE last END AS name FROM n)
        SELECT page_id, name, CASE WHEN name = '' THEN 'document.pdf' ELSE name || '.pdf' END AS pdf_name FROM m
    """,
    "site_globs": """
        SELECT page_id, CASE WHEN url LIKE 'https://%.example.net/en/%' THEN 'allow' WHEN url LIKE 'http://%' OR url LIKE 'https://%.example.com/%.html%' OR url LIKE 'https://%example.org/de/%' THEN 'redirect' ELSE 'none' END AS action,
            CAST(CASE WHEN url LIKE 'https://%.example.net/en/%' THEN 1 WHEN url LIKE 'http://%' THEN 2 WHEN url LIKE 'https://%.example.com/%.html%' THEN 3 WHEN url LIKE 'https://%example.org/de/%' THEN 4 END AS INTEGER) AS rule_id
        FROM pages
    """,
    "text_checks": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS s, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS n, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS dense,
            length(regexp_replace(coalesce(text, ''), '[^aeiouAEIOU]', '', 'g')) AS v, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS len FROM documents)
        SELECT doc_id, dense < 8 AS needs_ocr, dense = 0 OR n < dense * 0.55 OR regexp_matches(s, '[A-Za-z]{21}') OR (n >= 6 AND v < n * 0.30) AS gibberish,
            len BETWEEN 12 AND 200 AND n >= 8 AND NOT regexp_matches(s, '[a-z]{3}') AND NOT regexp_matches(s, '(?i)^\s*(page\s+)?\d+\s*(of\s+\d+)?\s*$') AS title,
            n >= 2 AND NOT regexp_matches(s, '[a-z]{4}') AND NOT regexp_matches(s, '(?i)^\s*(page\s+)?\d+\s*(of\s+\d+)?\s*$') AS title_line FROM d
    """,
    "escaped": """
        SELECT doc_id, md5(CASE WHEN contains(s, ',') OR contains(s, '"') OR contains(s, chr(10)) THEN '"' || replace(s, '"', '""') || '"' ELSE s END) AS csv_md5,
            md5(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS html_md5 FROM (SELECT doc_id, coalesce(text, '') AS s FROM documents)
    """,
    "encoded_names": """
        SELECT p_partkey, replace(replace(replace(replace(replace(url_encode(p_name || ' & (!''~*) +é §' || p_type), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS encoded FROM part
    """,
    "carried": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_code FROM events",
    "debounced": """
        WITH g AS (SELECT *, CASE WHEN coalesce(floor(epoch(ts)) - lag(floor(epoch(ts))) OVER w > 3600, true) THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst FROM g)
        SELECT user_id, burst, count(*) AS n_events, max(event_id) AS last_event FROM s GROUP BY 1, 2
    """,
    "paragraph_runs": """
        WITH l AS (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, CASE WHEN coalesce(l_linenumber = lag(l_linenumber) OVER w + 1, false) THEN 0 ELSE 1 END AS b FROM l WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)),
        s AS (SELECT *, sum(b) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS run FROM g),
        r AS (SELECT l_suppkey, run, min(l_linenumber) AS run_first, max(l_linenumber) AS run_last, count(*) AS run_length FROM s GROUP BY 1, 2)
        SELECT l_suppkey, run_first, run_last, run_length FROM r WHERE run_length >= 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY run_length DESC, run) = 1
    """,
    "printed_pages": """
        WITH c AS (SELECT l_suppkey, l_returnflag AS slot, CAST(l_partkey % 7 AS BIGINT) - l_linenumber AS off, count(DISTINCT l_linenumber) AS n_pages, min(l_linenumber) AS low FROM lineitem GROUP BY 1, 2, 3)
        SELECT l_suppkey, off AS page_offset, n_pages FROM c WHERE low + off >= 1 AND n_pages >= 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n_pages DESC, slot, off) = 1
    """,
    "kept_spans": """
        WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 50) * 60000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
        k AS (SELECT user_id, event_id, n, t AS stop, true AS kept FROM e WHERE n = 1
            UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.s >= k.stop THEN e.t ELSE k.stop END, e.s >= k.stop FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1)
        SELECT user_id, event_id FROM k WHERE kept
    """,
    "first_of_part": "SELECT l_partkey, min(l_orderkey * 100 + l_linenumber) AS pos FROM lineitem GROUP BY 1",
    "as_of_markers": """
        WITH m AS (SELECT user_id, ts, max(event_id) AS mark FROM events WHERE event_type = 'click' GROUP BY 1, 2)
        SELECT e.event_id, m.mark AS marker FROM (SELECT * FROM events WHERE event_type <> 'click') e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts
    """,
    "clear_spans": """
        WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + event_id % 1800 AS t FROM events)
        SELECT event_id FROM e a WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND a.s < b.t AND a.t > b.s)
    """,
    "open_entries": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'purchase'",
    "newest": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "page_offsets": 'SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_start FROM conversations',
    "stamped": """
        SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 20 AS chunk,
            p_brand || '-' || lpad(CAST(p_partkey * 7919 AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey * 7919 AS VARCHAR))) AS INTEGER), '0') AS label FROM part
    """,
    "ranges": """
        WITH r AS (SELECT p_partkey, 0 AS n, p_size % 9 AS a, p_size AS b FROM part UNION ALL SELECT p_partkey, 1, p_partkey % 13, p_partkey % 13 FROM part UNION ALL SELECT p_partkey, 2, 8, 40 FROM part),
        c AS (SELECT p_partkey, n, greatest(1, least(40, a)) AS a, greatest(1, least(40, b)) AS b FROM r)
        SELECT p_partkey, CAST(n AS INTEGER) AS n, CAST(least(a, b) AS INTEGER) AS first_page, CAST(greatest(a, b) AS INTEGER) AS last_page FROM c
    """,
    "ladder": """
        WITH e AS (SELECT c_nationkey AS g, CASE WHEN o_orderstatus = 'O' THEN 'Motion' ELSE 'Demurrer' END AS c, o_orderpriority AS t, c_mktsegment || chr(39) || 's ' AS l, c_name || chr(39) || 's ' AS p, min(o_orderkey) AS id FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4, 5),
        w AS (SELECT *, CASE c WHEN 'Motion' THEN t ELSE 'Demurrer to ' || t END AS r1 FROM e),
        r AS (SELECT g, c, id, r1, l || c AS r2, l || r1 AS r3, p || c AS r4, p || r1 AS r5 FROM w),
        k AS (SELECT g, c, count(*) AS n, count(DISTINCT r1) AS d1, count(DISTINCT r2) AS d2, count(DISTINCT r3) AS d3, count(DISTINCT r4) AS d4 FROM r GROUP BY 1, 2)
        SELECT id, CASE WHEN n = 1 THEN r.c WHEN d1 = n THEN r1 WHEN d2 = n THEN r2 WHEN d3 = n THEN r3 WHEN d4 = n THEN r4 ELSE r5 END AS name FROM r JOIN k USING (g, c)
    """,
    "part_volumes": """
        WITH p AS (SELECT p_partkey, p_partkey % 4 IN (0, 2) AS vol, ['4', NULL, '12', '39', '1'][1 + p_size % 5] AS n FROM part)
        SELECT p_partkey, CASE WHEN n IS NOT NULL THEN CASE WHEN vol THEN 'Vol. ' ELSE 'Part ' END || n END AS part_vol FROM p
    """,
}

for more in (record_queries, name_queries, grammar_queries, page_queries):
    QUERIES |= more.QUERIES
    ORACLE |= more.ORACLE
