"""Words are named without their mark, what a pair makes is known from its rank, and texts of a
batch are joined together."""

import hashlib
import random

import public_tokenizers

from lexmill.llm import pieces
from lexmill.llm.pieces import MARK

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def marked(words):
    return [w if MARK in w else MARK + w for w in words]


def odd_texts(rng):
    parts = ["a", "the", "word", "é", "\n", "\t", "x\ny", MARK, MARK + "the", "😀", "  ", "   ", "q" * 70, "\u0000", "12.5"]
    return ["", " ", "  ", MARK, " a", "a ", "a b", "a  b", *(" ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(800))]


def test_words_are_those_of_the_pattern():
    v = pieces.Vocabulary(MODEL)
    for t in odd_texts(random.Random(7)):
        words = v.words_of(t)
        assert marked(words) == (v.words.findall(MARK + t.replace(" ", MARK)) if t else [])
        # Words met beside one space and beside several are remembered once.
        assert not any(w[1:] and w.rfind(MARK) == 0 for w in words)


def test_odd_texts_are_encoded_as_by_the_library():
    v = pieces.Vocabulary(MODEL)
    texts = odd_texts(random.Random(8))
    for _ in range(2):
        assert v.encode_all(texts) == [v.library.encode(t) for t in texts]
    assert max(map(len, v.held)) <= pieces.LONGEST
    v.older, v.held = v.held, {}
    assert v.encode_all(texts) == [v.library.encode(t) for t in texts]


def test_texts_that_begin_with_no_mark():
    v = pieces.Vocabulary(MODEL)
    v.prefix = ""
    texts = odd_texts(random.Random(9))
    assert v.encode_all(texts) == [list(v.merged(t.replace(" ", MARK))) if t else [] for t in texts]


def test_a_round_of_merges_looks_pairs_up_once():
    v = pieces.Vocabulary(MODEL)
    rng = random.Random(10)
    words = list({"".join(rng.choice("etaoinshr") for _ in range(9)) for _ in range(500)})
    want = {w: v.merged(MARK + w) for w in words}
    looks, places = [], v.pairs.places
    v.pairs.places = lambda left, right: looks.append(len(left)) or places(left, right)
    assert v.merged_words(words, MARK) == want
    assert len(looks) <= 1 + 9  # those of the words, and one for each round
    # Pieces of equal rank: what a pair makes is then looked up, too.
    v.ranks = {p: r // 50 for p, r in v.ranks.items()}
    v.pairs = pieces.Pairs(v.normal, v.ranks)
    assert (v.pairs.made < 0).any()
    assert v.merged_words(words, MARK) == {w: v.merged(MARK + w) for w in words} != want


def test_texts_of_a_batch_are_decoded_together():
    v = pieces.Vocabulary(MODEL)
    rng = random.Random(11)
    special = [v.unknown, *v.silent, *v.bytes.values(), *(v.normal[p] for p in (MARK, MARK + "the", "e"))]
    texts = [[rng.choice(special) if rng.random() < 0.6 else rng.randrange(len(v.written)) for _ in range(rng.randrange(9))] for _ in range(3000)]
    for part in (texts, [[]], [[], []], [], [[*v.silent]], [[], [v.unknown], []]):
        assert v.decode_all(part) == [v.decode(ids) for ids in part] == [v.library.decode(ids) if ids else "" for ids in part]
    # Texts without control ids are not decoded one by one.
    plain = [v.encode(t) for t in odd_texts(rng) if t]
    want = [v.decode(ids) for ids in plain]
    v.decode = None
    assert v.decode_all(plain) == want


def test_digests_of_odd_texts(spark):
    texts = [None, "", " ", "a", "the  end ", "x\ny", "q" * 500, *odd_texts(random.Random(12))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    library = pieces.Vocabulary(MODEL).library
    for rows in (pieces.encoding_digests(docs, MODEL).collect(), pieces.encoding_digests(docs.where("doc_id < 2"), MODEL).collect()):
        for r in rows:
            ids = library.encode(texts[r.doc_id] or "")
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else ""), True)
    assert len(rows) == 2
