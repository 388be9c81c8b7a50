"""The texts of a batch are numbers of its different words, and words of a length are merged in place."""

import random
from collections import Counter

import numpy as np
import public_tokenizers

from lexmill.llm import pieces
from lexmill.llm.pieces import MARK

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "etaoinshrdlu" * 6 + "é\n\t\u0000\u0085ߐあ￿\U0001f600\U0010ffff.,09"


def many_words(rng, letters=LETTERS):
    return list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(4000)})


def test_a_word_is_merged_once_a_batch_and_lists_are_made_of_few():
    v = pieces.Vocabulary(MODEL)
    rng = random.Random(13)
    words = many_words(rng)
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(400)]
    seen, merged = Counter(), v.pairs.merged
    v.pairs.merged = lambda symbols: seen.update(map(tuple, symbols.T.tolist())) or merged(symbols)
    batch = v.encode_batch(texts)
    assert [x.tolist() for x in batch.texts()] == [v.library.encode(t) for t in texts]
    assert v.decode_batch(batch) == texts
    different = {w for t in texts for w in t.split(" ")}
    assert len(batch.ends) - 1 == len(different) and len(batch.words) == 60 * 400
    assert sum(seen.values()) > 0.98 * len(different) and len(v.held) < 0.02 * len(different)


def test_odd_words_are_merged_in_place(monkeypatch):
    """Spelt code points of one to four bytes, marks inside words, several spaces, turns of few words."""
    monkeypatch.setattr(pieces, "AT_ONCE", 50)
    v = pieces.Vocabulary(MODEL)
    rng = random.Random(14)
    words = many_words(rng, LETTERS + MARK + " ")
    texts = [*(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)), "", "", " ", MARK * 40, "q" * 90]
    batch = v.encode_batch(texts)
    assert [x.tolist() for x in batch.texts()] == [v.library.encode(t) for t in texts]
    assert v.decode_batch(batch) == [v.library.decode(v.library.encode(t)) for t in texts]
    assert v.agree(texts, batch.texts(), v.decode_batch(batch)) == [True] * len(texts)
    wrong = [np.append(x, 5) for x in batch.texts()]
    assert v.agree(texts, wrong, v.decode_batch(batch)) == v.agree(texts, batch.texts(), ["x" + t for t in texts]) == [False] * len(texts)
    for none in ([], [""], ["", ""]):
        assert v.encode_all(none) == [[] for _ in none] and v.decode_batch(v.encode_batch(none)) == none


def test_no_prefix_and_no_bytes():
    v = pieces.Vocabulary(MODEL)
    rng = random.Random(15)
    words = many_words(rng)
    v.prefix = ""
    texts = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    assert v.encode_all(texts) == [list(v.merged(t.replace(" ", MARK))) for t in texts]
    v.bytes, v.held = {}, {}
    assert v.merged_words(words, MARK) == {w: v.merged(MARK + w) for w in words}
    assert any(v.unknown in ids for ids in v.merged_words(words).values())
