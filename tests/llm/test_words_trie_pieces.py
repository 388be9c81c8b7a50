"""Spelling variants, the prefix trie and piece encoding against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece

from lexmill.llm import pieces, spelling, trie

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x20\x09-\x0d]+")


# --- 11, spelling variants ---


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words, times=5):
    """word -> (form, root, n, n_near, form_n) by comparing every two words."""
    form, near_of = {}, {}
    for w, n in words.items():
        near = [v for v in words if v != w and one_edit(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        near_of[w], form[w] = len(near), best if best is not None and words[best] >= times * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, near_of[w], words[form[w]] if form[w] else None)
    return out


def counted(texts, shortest=6, fewest=5):
    seen = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= shortest and n >= fewest}


def as_found(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_by_every_pair(spark):
    """Few letters and many words: all bands are crowded, and edits of each kind meet."""
    rng = random.Random(5)
    words = {}
    while len(words) < 700:
        w = "".join(rng.choice("abcéÉz") for _ in range(rng.randint(6, 8)))
        words[w] = rng.choice((5, 6, 25, 30, 150, 750))
    rows = spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert len(rows) == len(words) and as_found(rows) == variants(words)


def test_pairs_are_made_once(spark):
    words = [("abcdef", 5), ("abcdeg", 5), ("abcdefg", 5), ("abcdeé", 5), ("bbcdef", 5), ("abcdfe", 5)]
    rows = spelling.near_pairs(spark.createDataFrame(words, "word string, n long")).collect()
    got = Counter(frozenset((r.a, r.b)) for r in rows)
    want = {frozenset((a, b)) for a, _ in words for b, _ in words if a < b and one_edit(a, b)}
    assert set(got) == want and set(got.values()) == {1}


def test_spelling_of_texts(spark):
    """Nulls, empty and long texts, repeated rows, ties, clashing names."""
    rng = random.Random(7)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    texts = [(i, " ".join(rng.choice(stock).title() for _ in range(200))) for i in range(300)]
    texts += [(None, "abcdef " * 7), (7, None), (8, ""), (9, "zzzzzzz, " * 20_000), texts[3], texts[3]]
    rows = [(d, t, 1, "x", "y") for d, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word long, n string, kept string").repartition(5)
    got = as_found(spelling.spelling_groups(docs).collect())
    assert got == variants(counted(texts)) and any(f for f, *_ in got.values())


def test_spelling_of_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert as_found(spelling.spelling_groups(docs).collect()) == variants(counted(texts))
    assert spelling.spelling_groups(docs.limit(0)).collect() == []


# --- 12, prefix trie ---


def rebuilt(turns):
    """conv -> list of (role, text) of conversations that share the first turns of their base."""
    said = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in said.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = said.get(c - c % 20, [])[:h] + own[h:]
    return out


def nodes_of(said):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children[p]
        leaves[p] = sum(leaves[b] for b in below) if below else 1
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        saved[p] = own + sum(saved[b] for b in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], sha))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, at long, said string, kid string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "k") for r in rows], TURNS).repartition(4)


def trie_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def chats(seed, n, words=3, long=0):
    """Conversations over few different turns, with copies, gaps in ids, nulls, ties and repeats."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue
        size = rng.choice((1, 2, 3, 4, 6)) if c % 7 else 5
        for t in range(size):
            text = rng.choice(("a", "b b", "c c c", "", None)[:words])
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(("user", "assistant", None)), "same same" if c % 7 == 0 else text))
    for c in range(n, n + long):
        rows += [(c, t, "user", "x y" if t < 280 else f"z {c} {t % 5}") for t in range(300 + 260 * (c % 2))]
    rows += rows[:3] + [(None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("local", [1, 6, 40, 10_000])
def test_trie_by_prefixes(spark, local):
    rows = chats(1, 120)
    assert trie_rows(trie.prefix_trie(turn_table(spark, rows), local)) == nodes_of(rebuilt(rows))


@pytest.mark.parametrize("local", [300, 100_000])
def test_trie_of_long_conversations(spark, monkeypatch, local):
    """Sequences of several blocks, with shared prefixes beyond a block, and alone in their buckets."""
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [r for r in chats(2, 10, long=0)] + [(40 + c, t, "u", "x y" if t < 36 or c > 2 else f"z {c} {t % 5}") for c in range(5) for t in range(50 + 30 * (c % 2))]
    rows += [(60, t, "u", f"own {t % 3}") for t in range(700)] + [(61, t, "u", f"own {t % 3}") for t in range(700)]
    table = turn_table(spark, rows)
    assert trie_rows(trie.prefix_trie(table, local)) == nodes_of(rebuilt(rows))


def test_trie_many_equal_conversations(spark):
    """Conversations that end at one node are more than a chunk of ids holds."""
    rows = [(c, t, "user", "hot") for c in range(0, 3000, 20) for t in range(2)] + [(c, 0, "user", "hot") for c in range(1, 3000, 2)]
    rows += [(10**15 + 20, 0, None, None)]
    assert trie_rows(trie.prefix_trie(turn_table(spark, rows), 50)) == nodes_of(rebuilt(rows))


def test_trie_turnless_and_empty(spark):
    # Of conversation 21 nothing is left where its base is absent and its turns are fewer than h.
    lone = next(c for c in range(21, 500) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "gone"), (lone, 1, "user", "gone")]
    assert trie_rows(trie.prefix_trie(turn_table(spark, rows))) == nodes_of(rebuilt(rows)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert trie.prefix_trie(turn_table(spark, rows).limit(0)).collect() == []


# --- 13, pieces ---


def hard_texts():
    rng = random.Random(3)
    alphabet = [chr(c) for c in (*range(0, 128), 0xE9, 0x2581, 0x3042, 0x4E2D, 0x1F600, 0x200D, 0xFFFD, 0xE000, 0x10FFFF)] + ["<s>", "</s>", "<unk>", "<0x41>", "  ", "▁▁", "the ", "ing"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    return [*texts, None, "", " ", "   ", "▁", "a" * 20_000, " " * 5_000, "ab " * 30_000, "\n\n", "\u0000", "x▁"]


def test_pieces_are_the_library_s(spark):
    texts = hard_texts()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(4)
    rows = {r.doc_id: r for r in pieces.encoded(docs, MODEL).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = sp.encode(t or "")
        assert rows[i].ids_ == want and rows[i].decoded == sp.decode(want) and rows[i].agrees and rows[i].ids == "clash"
    digests = {r.doc_id: r for r in pieces.encoding_digests(docs, MODEL).collect()}
    for i, t in enumerate(texts):
        want = sp.encode(t or "")
        assert digests[i].n_tokens == len(want) and digests[i].agrees
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()
    assert pieces.encoding_digests(docs.limit(0), MODEL).collect() == []


def test_merging_whole_texts_is_merging_words():
    """The agenda gives the same ids whether words are merged apart or with their text."""
    v = pieces.Vocabulary(MODEL)
    assert v.words is not None
    for t in hard_texts()[:800]:
        marked = pieces.MARK + t.replace(" ", pieces.MARK)
        assert list(v.ids_of(v.merged_text(marked))) == list(v.ids_of(v.merged_word(marked))) == v.encode(t)


def test_decoding_any_ids():
    v = pieces.Vocabulary(MODEL)
    rng = random.Random(11)
    for _ in range(2000):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(259, 32_000), rng.randrange(0, 3))) for _ in range(rng.randint(1, 12))]
        assert v.decode(ids) == v.library.decode(ids), ids


def test_other_models_are_refused(tmp_path):
    other = tmp_path / "other.model"
    data = open(MODEL, "rb").read()
    at = data.rindex(b"\x18\x02\x20\x80\xfa\x01")  # the type of model, before the number of pieces
    other.write_bytes(data[: at + 1] + b"\x01" + data[at + 2 :])
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Vocabulary(str(other))
