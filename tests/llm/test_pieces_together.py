"""New words of one length are merged together."""

import random

import public_tokenizers

from lexmill.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_new_words_are_merged_together():
    v = pieces.Vocabulary(MODEL)
    rng = random.Random(5)
    letters = "etaoinshrdlucmfwypvbgkqjxz" * 4 + "éßñ" + "\n\t\u0000\U0001f600あ▁0123456789.,"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(6000)]
    texts = [" ".join(words[i : i + 30]) for i in range(0, len(words), 30)] + ["", " ", "a" * 5000]
    alone = []
    one = v.merged
    v.merged = lambda w: alone.append(w) or one(w)
    assert v.encode_all(texts) == [v.library.encode(t) for t in texts]
    assert sum(len(w) <= pieces.SHORT for w in alone) < len(words) / 50
    # Words that are remembered, and texts one at a time, give the same.
    assert [v.encode(t) for t in reversed(texts)] == [v.library.encode(t) for t in reversed(texts)]


def test_code_points_that_are_pieces_only_inside_others():
    """Such a vocabulary has symbols that are no pieces."""
    v = pieces.Vocabulary(MODEL)
    v.normal = {p: i for p, i in v.normal.items() if p not in ("q", "x", "▁")}
    v.ranks = {p: r for p, r in v.ranks.items() if p in v.normal}
    v.pairs = pieces.Pairs(v.normal, v.ranks)
    rng = random.Random(6)
    words = list({"▁" + "".join(rng.choice("quxeti\n") for _ in range(6)) for _ in range(2000)})
    assert v.merged_words(words) == {w: v.merged(w) for w in words}
