"""Words are counted, looked up and learned by batches, not one by one."""

import math

import numpy as np
import pyarrow as pa

from lexmill.llm import lm

ODD = ["cut off", None, "", " \t\n ", " Lead and trail ", "A\x1cb\x00c\x85d", "😀 É naïve x\x0bq\x0cr", "of the of the", "the " * 3000, "zzz zzq zzz " * 40]


def small():
    rng = np.random.default_rng(3)
    words = [b"the", b"of", b"and", *(b"w%d" % i for i in range(40))]
    return lm.Vocabulary(words, np.sort(rng.integers(50, 900, len(words)))[::-1], len(words), 30_000, 400, 90, np.array([40, 7, 9, 22, 1]), np.array([20, 3, 4, 9, 1]))


def test_tokens_of_a_batch(monkeypatch):
    v, calls, bucket = small(), [], lm.bucket
    monkeypatch.setattr(lm, "bucket", lambda w, n: calls.append(w) or bucket(w, n))
    part = pa.array(["before " * 5, *ODD, "after"]).slice(1, len(ODD))
    ids, begin, far, places = lm.look_up(part, v)
    want, beyond = [], []
    for t, at in zip(ODD, begin, strict=True):
        assert at == len(want)
        for w in (t or "").encode().lower().split():
            if w not in v.place:
                beyond.append((w, len(want)))
            want.append(v.place[w] if w in v.place else v.size + bucket(w, v.buckets))
        want.append(v.end)
    assert ids.tolist() == want and list(zip(far.to_pylist(), places.tolist(), strict=True)) == beyond
    # The ends of words that many tokens share are looked at once.
    assert len(calls) == len({w[-3:] for w, _ in beyond}) < len(beyond) / 3
    c1, c2 = lm.contexts(ids, v, begin)
    for at, end in zip(begin, [*begin[1:], len(ids)], strict=True):
        own = lm.contexts(ids[at:end], v)
        assert c1[at:end].tolist() == own[0].tolist() == [v.start, *ids[at : end - 1]]
        assert c2[at:end].tolist() == own[1].tolist() == [v.start, v.start, *ids[at : end - 1]][: end - at]
    counted = next(lm._counted(iter([pa.RecordBatch.from_arrays([part], ["text"])]))).to_pylist()
    words = [w for t in ODD for w in (t or "").encode().lower().split()]
    assert {r["word"]: r["c"] for r in counted} == {w: words.count(w) for w in set(words)} and len(counted) == len(set(words))


def test_sums_by_id():
    rng = np.random.default_rng(4)
    for at in (np.minimum(rng.pareto(0.5, 3000) * 3, 700).astype(int), np.zeros(50, int), np.arange(9), np.array([5])):
        rows = rng.normal(size=(len(at), 4))
        sums = np.zeros((at.max() + 1, 4))
        np.add.at(sums, at, rows)
        got, g = lm._gathered(at, rows)
        assert sorted(got) == sorted(set(at)) and np.allclose(g, sums[got])


def test_a_step_is_that_of_its_tokens():
    """The gradients of one step, token by token."""
    v, d, n = small(), lm.DIM, 200
    p, c = lm.initial(v), v.counts()
    p["t"], p["u"] = np.c_[p["t"], p.pop("b")], np.c_[p["u"], p.pop("a")]
    old = {k: x.astype(float) for k, x in p.items()}
    seen = {k: np.full(x.shape, 1e-2, np.float32) for k, x in p.items()}
    share, sizes = c.sum(1) / c.sum(), (c > 0).sum(1)
    ids = np.random.default_rng(8).integers(0, v.end + 1, n)
    c1, c2 = lm.contexts(ids, v)
    lm._step(p, seen, v, np.random.default_rng(9), np.cumsum(share), np.log(lm.NOISE * share).astype(np.float32), sizes, c1, c2, ids)
    rng = np.random.default_rng(9)
    drawn = np.searchsorted(np.cumsum(share), rng.random(lm.NOISE))
    picks = rng.random((lm.INSIDE, n), np.float32)
    g = {k: np.zeros(x.shape) for k, x in old.items()}
    for i, (a, b, y) in enumerate(zip(c1, c2, ids, strict=True)):
        k = y // v.width
        r = np.append(old["q"][a] * old["w"][0] + old["q"][b] * old["w"][1], 1)
        g_r = np.zeros(d + 1)
        parts = [("u", k, 1, math.log(lm.NOISE * share[k]))] + [("u", j, 0, math.log(lm.NOISE * share[j])) for j in drawn]
        inside = math.log(lm.INSIDE / sizes[k])
        parts += [("t", y, 1, inside)] + [("t", k * v.width + int(x[i] * sizes[k]), 0, inside) for x in picks]
        for name, at, data, noise in parts:
            pull = data - 1 / (1 + math.exp(noise - r @ old[name][at]))
            g[name][at] += pull * r
            g_r += pull * old[name][at]
        g["q"][a] += g_r[:d] * old["w"][0]
        g["q"][b] += g_r[:d] * old["w"][1]
        g["w"] += np.stack([g_r[:d] * old["q"][a], g_r[:d] * old["q"][b]]) / n * 8
    for k, x in g.items():
        assert np.allclose(p[k], old[k] + lm.RATE * x / np.sqrt(1e-2 + x * x), atol=1e-4), k
