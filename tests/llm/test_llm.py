"""The training-data operators against brute force and SQL, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lexmill.llm import chat, components, decontam, exact_dedup, langid, lm, mixing, ngram_join, pii, queries, secrets, url_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, word long, `__key` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names."""
    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"
    texts = {
        0: None, 1: "", 2: " \t\n ", 3: "Hello  World", 4: "hello world", 5: "Hello\nWorld", 6: near, 7: near.replace("xi", "XI"), 8: near + " seven",
        9: "word " * 30_000, 10: "1" * 50_000, 11: "a.b@c." * 5_000, 12: "mail x@y.org, ip 10.0.0.1, card 4111 1111 1111 1111, +1 (555) 555-0100; token = 'abcdef123456'",
        13: "😀 é naïve 9.9.9.9", 14: "AKIA" + "Z" * 20_000,
    }
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "x", 1, "k") for i, t in texts.items()]
    rows += [rows[3], rows[6], (None, "Hello World", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    odd(spark).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty_docs(odd_docs):
    return odd_docs.where("doc_id = -1")


def low(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()


# --- SQL ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {quoted} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(want, key=str)


# --- 1, decontamination ---


def test_decontamination(spark, docs, texts):
    tests = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, tests).collect()}

    def tok(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    want = set()
    bench = {r.item_id: tok(r.text) for r in tests.collect()}
    for d, t in texts.items():
        w = tok(t)
        at = defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        for item, b in bench.items():
            least = min(13, len(b))
            shifts = Counter(i - j for j, x in enumerate(b) for i in at.get(x, ()))
            for shift, n in shifts.items():
                if n >= least * 0.8:
                    e = [0 <= j + shift < len(w) and w[j + shift] == x for j, x in enumerate(b)]
                    inside = [j for j in range(len(b)) if 0 <= j + shift < len(w)]
                    if any(sum(e[j : j + least]) >= least * 0.8 for j in inside if j + least - 1 in inside):
                        want.add((d, item))
    assert found == want


def test_decontamination_tolerates_substitutions(spark):
    words = [f"w{i}" for i in range(40)]
    changed = [("x" if i % 9 == 8 else w) for i, w in enumerate(words)]
    rows = [(1, "start " + " ".join(changed) + " end"), (2, " ".join(words[:12])), (3, "nothing here"), (None, " ".join(words))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    t = spark.createDataFrame([(7, " ".join(words)), (8, "w1 w2"), (9, None), (None, " ".join(words))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, t).collect()} == {(1, 7), (1, 8), (2, 8)}
    assert {r.doc_id for r in decontam.clean(d, t).collect()} == {3}
    assert decontam.contaminated(d, t.where("item_id > 99")).count() == 0 == decontam.contaminated(d.where("doc_id > 99"), t).count()
    assert decontam.clean(d, t.where("item_id > 99")).count() == 4


@pytest.mark.parametrize("few", [500_000, 0])
def test_decontamination_misses_nothing(spark, monkeypatch, few):
    """Test texts of 1 to 16 tokens with all ways of up to three substitutions, broadcast and shuffled."""
    from itertools import combinations

    monkeypatch.setattr(decontam, "FEW", few)
    tests = {n: [f"t{n}x{i}" for i in range(n)] for n in (*range(1, 14), 16)}
    docs = {}
    for n, words in tests.items():
        for k in range(4 if n < 10 else 3):
            for gone in combinations(range(n), k):
                docs[len(docs)] = n, ["head", *(("y" if i in gone else w) for i, w in enumerate(words)), "tail"], gone
    want = set()
    for d, (n, _, gone) in docs.items():
        least = min(13, n)
        if any(least - sum(a <= i < a + least for i in gone) >= 0.8 * least for a in range(n - least + 1)):
            want.add((d, n))
    d = spark.createDataFrame([(i, " ".join(w)) for i, (_, w, _) in docs.items()], "doc_id long, text string")
    t = spark.createDataFrame([(n, " ".join(w)) for n, w in tests.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, t).collect()} == want


def test_decontamination_odd(odd_docs, empty_docs, spark):
    tests = spark.createDataFrame([(1, "hello world"), (2, None), (None, "alpha beta gamma")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(odd_docs, tests).collect()} == {(3, 1), (4, 1), (5, 1)}
    kept = decontam.clean(odd_docs, tests)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 6, 7, 8})
    assert decontam.clean(empty_docs, tests).count() == 0


# --- 2, chat ---


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yes"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (4, None, "user", None),
        (5, 0, "user", ""), (None, 0, "user", "x"),
    ]
    got = {(r.conv_id, r.part): (r.n_turns, r.n_copies, r.text) for r in chat.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(2, 0), (4, 0), (5, 0)}
    assert got[2, 0] == (2, 2, "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n")
    assert got[5, 0] == (1, 1, "<|user|>\n\n<|end|>\n")


def test_chat_long(spark):
    long = [(1, i, "user", f"t{i}") for i in range(600)]
    short = [(2, i, "user", f"t{i}") for i in range(300)]
    got = chat.collapse_and_render(spark.createDataFrame(long + short, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.part, r.n_turns) for r in got) == [(1, 0, 600), (1, 1, 600), (1, 2, 600)]


# --- 3 and 9, spans ---

PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15),
}
SECRETS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(1)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text, kinds):
    return [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m)]


@pytest.mark.parametrize("name,report,kinds", [("pii", pii.pii_report, PII), ("secrets", secrets.secret_report, SECRETS)])
def test_base_spans(docs, odd_docs, name, report, kinds):
    for table in (docs, odd_docs.where("doc_id IS NOT NULL")):
        texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
        rows = report(table).collect()
        assert len(rows) == table.count()
        for r in rows:
            want = base_spans(texts[r.doc_id], kinds)
            assert r.base_sha256 == digest(want), r
            assert [r[f"n_{k}"] for k in kinds] == [sum(w[2] == k for w in want) for k in kinds]
            assert {f"{k}:{a}:{b}" for a, _, k, b in want} <= set(r.spans.split(",")) | {""}


def test_checksums_and_context(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32 here"), (2, "iban GB83 WEST 1234 5698 7654 32 here"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "a.b_c@d.ef_g@h.ij")]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: "", 5: "email:0:10,email:10:17"}


def test_redaction(spark):
    rows = [(1, "to x@y.org now"), (2, None), (3, "plain")]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "to <email> now", 2: None, 3: "plain"}


def test_secret_model(spark):
    from pyspark.sql import functions as F

    model = secrets.train(secrets.default_samples(spark))
    words = {"sk4eC39HqLyjWDarjtT1zdp7dc": True, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYz1": True, "getUserNameFromConfig2": False, "order_line_item_count_22": False}
    rows = spark.createDataFrame([(w,) for w in words], "v string").select("v", secrets.mean_ratio(F.col("v"), model).alias("x")).collect()
    assert {r.v: r.x >= secrets.THRESHOLD for r in rows} == words


def test_secret_precision_and_recall(spark, docs):
    """On labelled samples that were not trained on, whole and cut to 16 characters; and on
    documents, where words are left alone."""
    from pyspark.sql import functions as F

    model = secrets.train(secrets.default_samples(spark, 2000))
    held = secrets.default_samples(spark, 4000).withColumn("n", F.monotonically_increasing_id())
    seen = secrets.default_samples(spark, 2000).select("value")
    held = held.join(seen, "value", "left_anti").withColumn("short", F.substring("value", 1, 16))
    for c in ("value", "short"):
        got = held.groupBy("secret").agg(F.avg((secrets.mean_ratio(F.col(c), model) >= secrets.THRESHOLD).cast("int")).alias("share")).collect()
        share = {r.secret: r.share for r in got}
        assert share[True] >= 0.98 and share[False] <= 0.005
    rows = [(1, "key QwErTzUiOpAsDfGhJkLm now"), (2, "Geschwindigkeitsbegrenzungen INTERNATIONALIZATION getUserNameFromConfig 20240101120000123")]
    assert {r.doc_id: r.n_token for r in secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 0}


def test_clashing_names(docs):
    """Callers' columns stay as they are, whatever their names."""
    from pyspark.sql import functions as F

    names = ("pii_spans", "secret_spans", "lang_pred", "score", "rejected", "__text", "__lang", "__m_email", "__s_hex")
    own = docs.limit(20).withColumns({n: F.lit(n) for n in names})
    for out in (pii.find_pii(own), pii.redact(own), secrets.find_secrets(own), langid.predict(own, langid.train(docs))):
        assert out.columns[: len(own.columns)] == own.columns and len(out.columns) > len(own.columns)
        assert all(r[n] == n for r in out.collect() for n in names)


def test_empty_tables(empty_docs, spark):
    assert pii.pii_report(empty_docs).count() == 0 == secrets.secret_report(empty_docs).count()
    assert mixing.mix_report(empty_docs).count() == 0 == mixing.mix(empty_docs).count()
    assert url_rules.judge_urls(spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 0")).count() == 0
    assert chat.collapse_and_render(spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id < 0")).count() == 0


# --- 4, languages ---


def test_languages(docs, odd_docs, empty_docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.language_report(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    got = {r.doc_id: r for r in langid.language_report(odd_docs).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[10].lang_pred == "und" and got[3].lang_pred == "en"
    assert langid.language_report(empty_docs).count() == 0
    kept = langid.identified(odd_docs)
    assert kept.columns == odd_docs.columns and {0, 1, 2, 10}.isdisjoint({r.doc_id for r in kept.collect()})


def test_unlearned_languages_are_rejected(docs):
    """The calibrated score alone decides: with fewer languages learned, texts of another aren't kept."""
    model = langid.train(docs.where("lang <> 'de'"))
    assert "de" not in model.languages
    rows = langid.predict(docs.select("doc_id", "lang", "text"), model).collect()
    other, clean = [r for r in rows if r.lang == "de"], [r for r in rows if r.lang != "de"]
    assert sum(r.rejected for r in other) >= 0.9 * len(other) and sum(r.rejected for r in clean) <= 0.02 * len(clean)


def test_every_label_is_learned(spark):
    rows = [(100 * k + i, f"l{k:02d}", f"qa{chr(97 + k % 26)}{chr(97 + k // 26)} zo{chr(97 + k // 26)}{chr(97 + k % 26)} " * 3) for k in range(70) for i in range(12)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(model.languages) == 70


# --- 5, URLs ---


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rules = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
    odd_rows = spark.createDataFrame([(-1, None, None), (-2, "net/", None), (-3, "x://A.NET", None), (-4, "x://xnet/", None), (-5, "a://b.org/fr/x?://c.net/", None)], pages.schema)
    pages = pages.unionByName(odd_rows)
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in url_rules.judge_urls(pages).collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fits = []
        for n, v in rules:
            h, _, p = n.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(n), n, v))
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if r.pattern else "allow")


def test_the_index_misses_no_rule(spark):
    """What the index fetches decides as running every pattern on every URL does."""
    texts = ("^ads^", "||shop.", "|a.org/x", "/img/*.png|", "*pixel*", "^a^*^b^", "track*", "end|", "^de^", "-x-")
    rules = tuple(url_rules.pattern_rule(x) for x in texts)
    assert [r.tokens for r in rules] == [("ads",), ("shop",), ("a", "org"), ("img", "png"), (), ("a", "b"), (), (), ("de",), ("x",)]
    urls = [f"http://{h}/{p}" for h in ("ads.net", "my.shop.com", "a.org", "shopper.io", "x.de", "b.tracks.eu") for p in ("", "x/ads", "img/q.png", "img/a.pngx", "apixels", "a/c/b", "the-end", "q-x-y", "DE/Ads.html")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.pattern for r in url_rules.judge_urls(pages, (), rules).collect()}
    for i, u in enumerate(urls):
        fits = [r.name for r in rules if re.match(r.pattern, u.removeprefix("http://"))]
        assert got[i] == next(iter(fits), None), u
    given = url_rules.judge_urls(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    for r in given:
        fits = [x.name for x in url_rules.PATTERN_RULES if re.match(x.pattern, r.host + r.path)]
        assert r.rule is not None or r.pattern == next(iter(fits), None)


# --- 6, mixing ---


def fair(sizes, weights, most=3):
    total, left, full = sum(sizes), set(range(len(sizes))), {}
    while True:
        share = total - sum(full.values())
        units = sum(weights[i] for i in left)
        over = {i for i in left if share * weights[i] / units > most * sizes[i]}
        if not over:
            return [full.get(i, share * weights[i] / units if i in left else 0) for i in range(len(sizes))]
        full |= {i: most * sizes[i] for i in over}
        left -= over


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_mixing(request, which):
    table = request.getfixturevalue(which)
    data = table.select("doc_id", "text", "source").collect()
    rows = mixing.mix_report(table).collect()
    assert len(rows) == len(data)
    sizes = defaultdict(int)
    for r in data:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, fair([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    assert sorted((r.source_size, round(r.target, 6)) for r in rows) == sorted((sizes[r.source], round(want[r.source], 6)) for r in data)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r.target, r.source_size] += r.taken
    for (target, size), n in taken.items():
        assert abs(n - target) <= mixing.BLOCK + 0.01 * size
    assert sorted(rows, key=str) == sorted(mixing.mix_report(table.repartition(5)).collect(), key=str)


def test_mix_texts(docs):
    rows = mixing.mix(docs).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(len(r.text.split()) == r.n_words <= mixing.BLOCK for r in rows)
    report = mixing.mix_report(docs).collect()
    assert sum(r.n_words for r in rows) == sum(r.taken for r in report)
    # A document's takings lie between those of slots that hold it alone and of all that hold it.
    for r in report:
        holding = [x for x in rows if r.doc_id in x.doc_ids]
        assert sum(x.n_words for x in holding if x.doc_ids == [r.doc_id]) <= r.taken <= sum(x.n_words for x in holding)
    texts = {r.doc_id: " ".join(WORD.findall(r.text or "")) for r in docs.collect()}
    for r in rows[:50]:
        assert len(r.doc_ids) > 1 or r.text in texts[r.doc_ids[0]]


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(5).cast("bigint")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


# --- 7, language model ---


def test_lm(docs, odd_docs, empty_docs):
    for table in (docs, odd_docs.where("doc_id IS NOT NULL")):
        words = {r.doc_id: [*WORD.findall(low(r.text)), None] for r in table.collect()}
        count = Counter()
        for r in table.select("doc_id").collect():
            if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
                count.update(words[r.doc_id])
        n, v = sum(count.values()), len(count)
        rows = lm.score_texts(table).collect()
        assert len(rows) == table.count()
        for r in rows:
            w = words[r.doc_id]
            base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
            assert abs(base - r.base_score) <= 1e-6 * max(1, abs(base)) and r.score < 0
    assert lm.score_texts(empty_docs).count() == 0


def test_lm_beats_its_base_wherever_files_are_split(docs):
    one = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    two = {r.doc_id: r for r in lm.score_texts(docs.repartition(7)).collect()}
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(abs(one[i].score - two[i].score) <= 1e-4 * abs(one[i].score) for i in one)


def test_lm_is_normalised():
    import numpy as np

    v = lm.Vocabulary([b"a", b"b", b"c"], np.array([5, 3, 1]), 3, 14, 5, 2)
    p = lm.initial(v)
    c = np.zeros(v.size + 2, np.int64)
    assert abs((10 ** lm.log_probabilities(p, c, c + 1, np.arange(v.size + 2))).sum() - 1) < 1e-5


def test_lm_vocabulary_follows_the_counts(spark):
    """More than 512 words in a fixed order: context tells apart those beyond the 512 most frequent, too."""
    import numpy as np

    words = [f"w{i:04d}" for i in range(1500)]
    train_ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 != 1][:240]
    d = spark.createDataFrame([(i, " ".join(words[600 + 3 * (i % 300) :][:600])) for i in train_ids] + [(10_000, "zz q")], "doc_id long, text string").coalesce(1)
    counts = lm.word_counts(d.select("text"))
    n, kinds = sum(r.c for r in counts.collect()), counts.count()
    v = lm.vocabulary(counts, n, kinds, d.count())
    assert v.size > 512 and v.of.sum() + v.rest.sum() + v.texts == v.total and v.size + v.kinds.sum() == kinds
    far = {bytes(r.word): r.c for r in counts.collect()}.keys() - set(v.words)
    assert all(v.kinds[lm.bucket(w, v.buckets)] > 0 for w in far)
    p = lm.train(d.select("text"), v)
    held = np.array([v.place[w.encode()] for w in words[900:1200]])
    c1, c2 = lm.contexts(held, v)
    after = lm.log_probabilities(p, c1, c2, held)[2:].mean()
    shuffled = lm.log_probabilities(p, c1[2:], c2[2:], np.roll(held[2:], 57)).mean()
    assert after > shuffled + 0.5
    every = np.arange(v.end + 1)
    assert abs((10 ** lm.log_probabilities(p, every * 0 + held[1], every * 0 + held[0], every)).sum() - 1) < 1e-4


# --- 8, n-gram join ---


def brute_groups(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    both = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), m in both.items():
        if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_near_groups(docs, texts, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs, n, percent).collect()}
    assert got == brute_groups(texts, n, percent)


def test_near_groups_of_many_copies(spark):
    """A crowd under one word, chains of links, and equal sets."""
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words if i < 30 else [w if rng.random() > 0.03 else f"x{rng.randrange(9)}" for w in words]) for i in range(90)}
    texts |= {100 + i: " ".join(words[2 * i : 2 * i + 60]) for i in range(60)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(d).collect()}
    assert got == brute_groups(texts, 5, 80)


def test_near_groups_of_repeated_ids(spark):
    """A doc_id with two texts is in one component with the links of both."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    c = " ".join(f"c{i}" for i in range(60))
    for rows, want in (
        ([(1, a), (5, a), (5, b), (7, b + " z")], {1: 1, 5: 1, 7: 1}),
        ([(5, a), (5, b), (7, b + " z")], {5: 5, 7: 5}),
        ([(3, a), (5, b), (5, a), (5, c), (9, b + " y"), (2, c + " x"), (8, "q r s t u v")], {2: 2, 3: 2, 5: 2, 9: 2, 8: 8}),
    ):
        got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want


def test_near_groups_of_a_common_passage(spark, monkeypatch):
    """A passage in all documents, and a large group of copies around the threshold, with
    many rounds and with one before the exact end."""
    import random

    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(passage + [f"u{i}_{j}" for j in range(rng.randrange(8, 60))]) for i in range(150)}
    texts |= {200 + i: " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(50)}" for w in base) for i in range(150)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute_groups(texts, 5, 80)
    for rounds in (ngram_join.ROUNDS, 1):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(d).collect()}
        assert got == want


@pytest.mark.parametrize("crowd,held", [(8, 20_000), (3, 20_000), (3, 5), (1_000, 4)])
def test_words_are_counted(monkeypatch, crowd, held):
    """A word's rows say alike how common it is, in one batch or many, dealt out or not."""
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "HELD", held)
    texts = [f"a b c d e f g h i j k l m n o p {'q' * (i % 7)} {i % 3}" for i in range(40)] + [" ".join(f"z{i}_{j}" for j in range(12)) for i in range(3)]
    rows, nodes = [], {}
    for part in range(3):
        own = texts[part * 15 : part * 15 + 15]
        got = pa.RecordBatch.from_pydict(ngram_join._batch(list(range(len(own))), own, 5, 80, set()), schema=ngram_join._ARROW).to_pylist()
        rows += got
    for r in rows:
        if r["n"] is None:
            nodes.setdefault(r["word"], set()).add(r["node"])
    rows.sort(key=lambda r: (r["by"], r["weight"] > 0, r["node"]))
    for size in (4, 1_000):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], schema=ngram_join._ARROW) for i in range(0, len(rows), size)]
        out = [r for b in ngram_join._grouped(iter(batches)) for r in b.to_pylist()]
        assert sum(r["n"] is not None for r in out) == len(texts)
        common, seen = {}, {}
        for r in out:
            if r["n"] is None:
                seen.setdefault(r["word"], set()).add(r["node"])
                if r["common"]:
                    assert common.setdefault(r["word"], r["common"]) == r["common"] <= held
        assert common.keys() == seen.keys() == {w for w, of in nodes.items() if len(of) > 1}
        assert all(seen[w] == nodes[w] for w in seen)


def test_near_groups_by_shuffle(spark, docs, texts, monkeypatch):
    """More documents than are broadcast."""
    monkeypatch.setattr(ngram_join, "FEW", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs, 4, 85).collect()}
    assert got == brute_groups(texts, 4, 85)


def test_near_groups_odd(odd_docs, empty_docs):
    rows = ngram_join.near_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got[0] == (0, 0) and got[2] == (0, 2) and got[5][1] == got[4][1] == 3 and got[7] == (26, 6) and got[8][1] == 6
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert ngram_join.near_groups(empty_docs).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 300), (300, 250)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 300: 200, 250: 200}


# --- 10, exact dedup ---


def test_dedup_odd(odd_docs, empty_docs):
    rows = exact_dedup.exact_dedup(odd_docs, capacity=2).collect()
    assert len(rows) == odd_docs.count()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert {r.keep_id for r in g} == {min(ids, default=None)} and {r.group_size for r in g} == {len(g)} and sum(r.kept for r in g) == 1
    kept = exact_dedup.first_copies(odd_docs)
    assert kept.columns == odd_docs.columns and {tuple(r)[5:] for r in kept.collect()} == {("x", 1, "k")}
    assert kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty_docs).count() == 0


def test_directory():
    counts = {0: 5, 1: 1, 2: 1, 3: 1, 8: 9}
    buckets = exact_dedup.split_directory(counts, 4, 4)
    assert [b[:2] for b in buckets] == [(0, 0), (1, 1), (2, 3), (4, 7), (8, 8), (9, 9), (10, 11), (12, 15)]


# --- the pipeline ---


def test_pipeline(spark, odd_docs, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        columns = docs.columns
        docs = stage(spark, docs, SF).persist()
        if name == "mixing":
            assert {i for r in docs.collect() for i in r.doc_ids} <= before
            break
        assert docs.columns == columns
        seen[name] = before, {r.doc_id for r in docs.select("doc_id").collect()}
        assert seen[name][1] <= before
    before, after = seen["language"]
    assert len(after) >= 0.98 * len(before)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    before, after = seen["exact_dedup"]
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[i]), i)
    assert after == set(first.values())
    before, after = seen["near_duplicates"]
    assert after == {i for i, (_, c) in brute_groups({i: texts[i] for i in before}, 5, 80).items() if i == c}
    before, after = seen["decontamination"]
    bad = {r.doc_id for r in decontam.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert after == before - bad


def test_pipeline_odd(spark, odd_docs, empty_docs):
    import corpus_pipeline as cp

    for docs in (odd_docs, empty_docs):
        for name, stage in cp.STAGES[:-1]:
            docs = cp.stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == odd_docs.columns
        cp.mixing_stage(spark, docs, SF).count()
