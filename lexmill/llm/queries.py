"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from .chat import collapse_and_render
from .common import table
from .decontam import contaminated
from .exact_dedup import exact_dedup
from .langid import language_report
from .lm import score_texts
from .mixing import mix_report
from .ngram_join import near_groups
from .pieces import encoding_digests
from .pii import pii_report
from .secrets import secret_report
from .spelling import spelling_groups
from .trie import prefix_trie
from .url_rules import judge_urls


def piece_model() -> str:
    """The model file that operator 13's query encodes with."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES = {
    "op1_decontamination": lambda spark, d: contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_chat_collapse": lambda spark, d: collapse_and_render(table(spark, d, "conversations")),
    "op3_pii": lambda spark, d: pii_report(table(spark, d, "documents")),
    "op4_language_id": lambda spark, d: language_report(table(spark, d, "documents")),
    "op5_url_rules": lambda spark, d: judge_urls(table(spark, d, "pages")),
    "op6_mixing": lambda spark, d: mix_report(table(spark, d, "documents")),
    "op7_lm_scoring": lambda spark, d: score_texts(table(spark, d, "documents")),
    "op8_ngram_join": lambda spark, d: near_groups(table(spark, d, "documents"), n=4, percent=85),
    "op9_secrets": lambda spark, d: secret_report(table(spark, d, "documents")),
    "op10_exact_dedup": lambda spark, d: exact_dedup(table(spark, d, "documents")),
    "op11_spelling_variants": lambda spark, d: spelling_groups(table(spark, d, "documents")),
    "op12_prefix_trie": lambda spark, d: prefix_trie(table(spark, d, "conversations")),
    "op13_pieces": lambda spark, d: encoding_digests(table(spark, d, "documents"), piece_model()),
}

#: SQL for the unsigned crc32 of {bytes}, a list of numbers, by a table {tab} of 256 entries.
CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab"
CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"

ORACLE = {
    # Every alignment that shares a token is counted; a run of least(13, len) tokens of which
    # k are equal is one whose k-th equal token after the first lies inside it.
    "op1_decontamination": """
        WITH d AS (
            SELECT doc_id, w, len(w) AS size FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL)
        ), t AS (
            SELECT item_id, w, len(w) AS n, least(13, len(w)) AS run, CAST(ceil(least(13, len(w)) * 0.8) AS BIGINT) AS k
            FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL)
        ), dw AS (
            SELECT doc_id, size, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d
        ), tw AS (
            SELECT item_id, n, run, k, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t
        ), same AS (
            SELECT doc_id, item_id, size, n, run, k, q - p AS shift, p FROM dw JOIN tw USING (word)
        ), laid AS (
            SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS n_equal FROM same
            WHERE least(shift + n, size) - greatest(shift, 0) >= run
        ), runs AS (
            SELECT *, lead(p, CAST(k - 1 AS INTEGER)) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) - p AS wide FROM laid WHERE n_equal >= k
        )
        SELECT doc_id, item_id, max(n_equal) AS n_equal, CAST(max(n) AS BIGINT) AS n_tokens FROM runs WHERE wide < run GROUP BY doc_id, item_id
    """,
    "op2_chat_collapse": """
        WITH c AS (
            SELECT conv_id, list((role, text) ORDER BY turn, role, text) AS said, count(*) AS n FROM conversations GROUP BY conv_id
        ), one AS (
            SELECT min(conv_id) AS conv_id, said, n, count(*) AS copies FROM c GROUP BY said, n
        ), kept AS (
            SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > one.n AND c.said[1] = one.said[1] AND c.said[:one.n] = one.said)
        )
        SELECT k.conv_id, CAST(0 AS BIGINT) AS part, k.n AS n_turns, k.copies AS n_copies,
            string_agg('<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.turn, t.role, t.text) AS text
        FROM kept k JOIN conversations t USING (conv_id) GROUP BY k.conv_id, k.n, k.copies
    """,
    # Every rule is tried on every URL.
    "op5_url_rules": """
        WITH u AS (
            SELECT page_id,
                CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM pages
        ), given(name, says, h, p) AS (
            VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
        ), words AS (
            SELECT unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT ['casino', 'casinos', 'bets', 'betting', 'poker', 'jackpot', 'pills', 'viagra', 'cialis', 'xxx',
                'porn', 'escorts', 'spam', 'ads', 'adserver', 'adclick', 'banners', 'popunder', 'affiliate'] AS w)
        ), own(place, name, regex) AS (
            SELECT place, '^' || word || '^', '(?is)(^|[^a-z0-9])' || word || '([^a-z0-9]|$)' FROM words
            UNION ALL VALUES (20, '||ads.', '(?is)^([^/]*\\.)?ads\\.'), (21, '||track.', '(?is)^([^/]*\\.)?track\\.'),
                (22, '^click^*^redirect^', '(?is)(^|[^a-z0-9])click[^a-z0-9](.*[^a-z0-9])?redirect([^a-z0-9]|$)'), (23, '/wp-content/*/ads/', '(?is)/wp-content/.*/ads/')
        ), judged AS (
            SELECT page_id, host, path,
                (SELECT arg_max(name, length(name)) FROM given WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
                (SELECT arg_min(name, place) FROM own WHERE regexp_matches(host || path, regex)) AS first
            FROM u
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN first END AS pattern,
            CASE WHEN rule IS NOT NULL THEN (SELECT says FROM given WHERE name = rule) WHEN first IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
        FROM judged
    """,
    # All pairs that share a shingle, counted; then what each set reaches.
    "op8_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), g AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] END)) AS s FROM w
        ), sets AS (
            SELECT min(doc_id) AS node, s, len(s) AS n FROM g WHERE len(s) > 0 GROUP BY s
        ), x AS (
            SELECT node, n, unnest(s) AS gram FROM sets
        ), pairs AS (
            SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.gram = b.gram AND a.node < b.node
            GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), edges AS (
            SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
        ), reach(node, root) AS (
            SELECT node, node FROM sets UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node
        ), comp AS (
            SELECT node, min(root) AS component_id FROM reach GROUP BY node
        )
        SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, g.doc_id) AS component_id
        FROM g LEFT JOIN sets ON g.s = sets.s AND len(g.s) > 0 LEFT JOIN comp c ON c.node = sets.node
    """,
    "op10_exact_dedup": """
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
            doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
        FROM t
    """,
    # Two words are one edit apart if one is the other without a letter, or both are alike
    # without the letter at one place.
    "op11_spelling_variants": f"""
        WITH RECURSIVE crc AS ({CRC_TABLE}), runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
        ), seen AS (
            SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
        ), hashed AS (
            SELECT run, k, {CRC.format(bytes="flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))")} AS h
            FROM seen, crc
        ), w AS (
            SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
                SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
        ), cut AS (
            SELECT word, n, i, substring(word, 1, CAST(i - 1 AS INTEGER)) || substring(word, CAST(i + 1 AS INTEGER)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
        ), near AS (
            SELECT DISTINCT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, max(n) AS form_n, min(near) FILTER (WHERE n = most) AS form
            FROM (SELECT *, max(n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word
        ), f AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)
        ), walk(word, root, next) AS (
            SELECT word, word, form FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next
        )
        SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
    """,
    # Nodes are lists of turns; each node is charged to all of its prefixes.
    "op12_prefix_trie": f"""
        WITH crc AS ({CRC_TABLE}), said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), coded AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, dense_rank() OVER (ORDER BY role, text) AS id,
                len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
            FROM said
        ), own AS (
            SELECT conv_id, list(id ORDER BY place) AS ids FROM coded GROUP BY conv_id
        ), size AS (
            SELECT id, any_value(words) AS words FROM coded GROUP BY id
        ), h AS (
            SELECT conv_id, ids, {CRC.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)")} % 4 AS h FROM own, crc
        ), whole AS (
            SELECT h.conv_id, list_concat(coalesce(b.ids[:h.h], []), h.ids[h.h + 1:]) AS ids FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20
        ), members AS (
            SELECT conv_id, ids, unnest(range(len(ids) + 1)) AS depth FROM whole
        ), nodes AS (
            SELECT depth, ids[:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(ids) = depth), '')) AS ends_sha256
            FROM members GROUP BY ALL
        ), kids AS (
            SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
        ), own_saved AS (
            SELECT n.depth, n.path, (n_convs - 1) * coalesce(words, 0) AS saved, n_children IS NULL AS leaf
            FROM nodes n LEFT JOIN kids k ON n.depth = k.depth AND n.path = k.path LEFT JOIN size ON size.id = n.path[-1]
        ), totals AS (
            SELECT above AS depth, path[:above] AS path, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(leaf::INT) AS BIGINT) AS n_leaves
            FROM (SELECT *, unnest(range(depth + 1)) AS above FROM own_saved) GROUP BY ALL
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
        FROM nodes n JOIN totals t ON n.depth = t.depth AND n.path = t.path LEFT JOIN kids k ON n.depth = k.depth AND n.path = k.path
        LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
    """,
}
