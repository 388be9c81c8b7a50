"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are all runs of 2, 3 and 4 bytes of its lower-cased UTF-8 form, in which
everything in ASCII but letters is one separator; each is hashed to a bucket with an
embedding. The mean embedding of all subwords of the whole text goes through a linear
softmax. Embeddings and softmax are trained together by stochastic gradient descent in
numpy, in one task, on a bounded sample of the documents of every label; the driver gets the
model alone. On a part of the sample that is not
trained on, a temperature calibrates the scores, and the score below which a prediction is
rejected is set so that no more than `REJECT` of correctly predicted texts are.

For prediction, embedding and softmax are multiplied to one table (bucket by language),
which is of fixed size and sent to the tasks; documents are read once and not shuffled.

Cases: a null text, or one without a letter, is `und` with score 0 and rejected; very long
texts are used whole; repeated rows are predicted each; with no labelled rows everything is
`und`; an empty table gives an empty result; other columns are kept and not read, and a new
column whose name is taken gets underscores after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, renamed

BUCKETS = 1 << 13
DIM = 8
#: Labelled documents used for each language, at most.
PER_LANGUAGE = 400
#: Pieces taken evenly from the whole of each sampled text, beside the whole, and their bytes.
PIECES, PIECE = 6, 72
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.5, 4
#: Steps that are taken at least: small samples are gone through more often.
STEPS = 1500
#: Share of correctly predicted texts of the calibration part that may be rejected.
REJECT = 0.001

_CLEAN = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def letters(text: str | None) -> np.ndarray:
    return np.frombuffer(b" " + (text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN) + b" ", np.uint8)


def subwords(b: np.ndarray) -> np.ndarray:
    """Buckets of all runs of 2, 3 and 4 bytes."""
    x = b.astype(np.uint32)
    out = []
    h = x
    for k in (1, 2, 3):
        if len(x) <= k:
            break
        h = h[:-1] * np.uint32(16777619) ^ x[k:]
        out.append(((h * np.uint32(2654435761)) >> np.uint32(19)) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for lang, part, text in zip(df["lang"], df["part"], df["text"], strict=True):
            b = letters(text)
            pieces = [b]
            if len(b) > 2 * PIECE:
                step = (len(b) - PIECE) // PIECES
                pieces += [b[i * step : i * step + PIECE] for i in range(PIECES)]
            for p in pieces:
                at, n = np.unique(subwords(p), return_counts=True)
                if len(at):
                    rows.append((lang, part, at.astype(np.int32).tolist(), (n / n.sum()).astype(np.float32).tolist()))
        yield pd.DataFrame(rows, columns=["lang", "part", "at", "share"])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS by language, in units of the temperature
    bias: np.ndarray
    least: float


def _forward(examples, emb, out, bias):
    at = np.concatenate([a for _, a, _ in examples])
    share = np.concatenate([s for *_, s in examples])[:, None]
    start = np.cumsum([0] + [len(a) for _, a, _ in examples])[:-1]
    mean = np.add.reduceat(emb[at] * share, start)
    z = mean @ out + bias
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return at, share, mean, p / p.sum(1, keepdims=True)


def fit(examples: list, languages: list[str]) -> Model:
    """examples: (language's place, buckets, shares), and held ones for calibration as
    the second list."""
    train, held = examples
    rng = np.random.default_rng(SEED)
    k = len(languages)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    seen_e = np.full((BUCKETS, 1), 1e-4, np.float32)  # AdaGrad's sums
    seen_o = np.full(out.shape, 1e-4, np.float32)
    epochs = max(EPOCHS, math.ceil(STEPS * BATCH / max(1, len(train))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(train))
        for i in range(0, len(order), BATCH):
            batch = [train[j] for j in order[i : i + BATCH]]
            at, share, mean, p = _forward(batch, emb, out, bias)
            p[np.arange(len(batch)), [b[0] for b in batch]] -= 1
            p /= len(batch)
            g_out = mean.T @ p
            g = np.repeat(p @ out.T, [len(b[1]) for b in batch], axis=0) * share
            at_once, where = np.unique(at, return_inverse=True)
            g_emb = np.stack([np.bincount(where, g[:, d], len(at_once)) for d in range(DIM)], 1).astype(np.float32)
            seen_e[at_once] += (g_emb**2).mean(1, keepdims=True)
            emb[at_once] -= rate * 0.2 * g_emb / np.sqrt(seen_e[at_once])
            seen_o += g_out**2
            out -= rate * 0.2 * g_out / np.sqrt(seen_o)
            bias -= rate * 0.1 * p.sum(0)
    heat, least = 1.0, 0.0
    if held:
        *_, p = _forward(held, emb, out, bias)
        truth = np.array([h[0] for h in held])
        z = np.log(p + 1e-12)

        def scores(t):
            q = np.exp(z / t)
            return q / q.sum(1, keepdims=True)

        heat = min(np.geomspace(0.2, 5, 33), key=lambda t: -np.log(scores(t)[np.arange(len(truth)), truth] + 1e-12).mean())
        q = scores(heat)
        right = q.argmax(1) == truth
        if right.any():
            least = float(np.quantile(q.max(1)[right], REJECT))
    return Model(tuple(languages), (emb @ out / heat).astype(np.float32), (bias / heat).astype(np.float32), least)


def _fitted(languages: list[str]):
    place = {k: i for i, k in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = ([], [])
        for b in batches:
            for k, part, at, share in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                examples[part].append((place[k], at.values.to_numpy(), share.values.to_numpy()))
        # A label that fell to the calibration part alone is learned from there.
        learned = {e[0] for e in examples[0]}
        examples[0].extend(e for e in examples[1] if e[0] not in learned)
        m = fit(examples, languages)
        made = [pa.array([m.table.tobytes()], pa.binary()), pa.array([m.bias.tobytes()], pa.binary()), pa.array([m.least], pa.float64())]
        yield pa.RecordBatch.from_arrays(made, ["table", "bias", "least"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learns from documents that are not held out; of each language those that come first
    by a hash of doc_id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    number = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(number)
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 0.0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, PER_LANGUAGE / number[k])) for k in languages], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share"))
    drawn = drawn.orderBy(F.xxhash64("doc_id", F.lit(SEED))).limit(2 * PER_LANGUAGE * len(languages))
    drawn = drawn.select("lang", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) == 0).alias("part"), "text")
    drawn = drawn.coalesce(1).mapInPandas(_examples, "lang string, part boolean, at array<int>, share array<float>")
    got = drawn.mapInArrow(_fitted(languages), "table binary, bias binary, least double").first()
    weights = np.frombuffer(got["table"], np.float32).reshape(BUCKETS, len(languages))
    return Model(tuple(languages), weights, np.frombuffer(got["bias"], np.float32), got["least"])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value

        def one(t):
            if t is None or not m.languages or not any(map(str.isalpha, t)):
                return "und", 0.0, True
            z = m.table[subwords(letters(t))].mean(0, dtype=np.float64) + m.bias
            q = np.exp(z - z.max())
            best = int(q.argmax())
            score = float(q[best] / q.sum())
            return m.languages[best], score, score < m.least

        for s in batches:
            yield pd.DataFrame([one(t) for t in s], columns=["lang_pred", "score", "rejected"])

    plain, names, (t,) = renamed(docs, text)
    new = ("lang_pred", "score", "rejected")
    return plain.withColumn("__lang", run(F.col(t))).select(*names, "__lang.*").toDF(*docs.columns, *[free(c, docs.columns) for c in new])


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    rows = predict(docs.select("doc_id", "text"), train(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is not rejected."""
    model = train(docs)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    rows = predict(plain, model, names[docs.columns.index("text")])
    return rows.where(~F.col("rejected")).select(*names).toDF(*docs.columns)
