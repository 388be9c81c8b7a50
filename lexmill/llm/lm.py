"""LM scoring: a log-bilinear model trained by noise-contrastive estimation.

The model predicts a token from the two before it: the context is the sum of their
embeddings, each weighed by a vector of its position. The output vocabulary follows the
counts of all training documents: every word above a count, chosen so that there are at
most `WIDE` times the square root of the tokens; the end of a text; and for all rarer words
a quarter as many buckets, by a hash of a word's last bytes. Each of these has an embedding
of its own as input and as output. Outputs are dealt to classes of about the square root of
their number: a class's score is the context's product with the class's embedding, plus a
bias, and an output's score inside its class likewise; both are normalised exactly. Inside a
bucket a word has its share of the bucket's counts (with 0.5 added to each, and one unseen
word); so the probabilities of all words sum to 1.

Counts cover all training documents. Training makes one pass over all of them: documents
are dealt to trainers by a hash of id and text, one trainer for each `TRAINER` tokens, so that scores don't
depend on how files are split. Each trainer starts from the same parameters and takes its
documents in the hash's order, and the parameters are averaged, an embedding's by how often
each trainer used it, the rest by tokens. A trainer gives only the embeddings that it used,
so what is gathered grows with the input, and the model with the square root of it.

The vocabulary's counts are sent to the tasks; the counts of all other words are joined to
the documents that hold them, shuffled by word.

Cases: a null or blank text is one token, its end; very long texts are scored whole, in
batches; with no training documents every token is unknown; rows that repeat a doc_id and
rows without one are scored each (the latter train, too); an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDE, DIM = 3, 16
#: Noise classes of a step, and noise words inside a token's class.
NOISE, INSIDE = 32, 2
#: Tokens that a trainer goes through, about.
TRAINER = 8_000_000
STEP, RATE, SEED = 4096, 0.1, 7
#: Contexts that are normalised at a time, small enough for a core's cache.
NORMED = 512
#: Documents that a task scores or trains on at a time.
DOCS = 400


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a column of texts, one after another, and how many each text has."""
    import pyarrow.compute as pc  # in workers only: the driver needs none of it

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().cast(pa.binary())
    each = np.diff(np.asarray(lists.offsets).astype(np.int64))
    # White space at a text's ends, and an empty text, leave empty words.
    real = np.asarray(pc.binary_length(words)) > 0
    if not real.all():
        before = np.r_[0, np.cumsum(real)]
        ends = np.cumsum(each)
        words, each = words.filter(pa.array(real)), before[ends] - before[ends - each]
    return words, each


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = words_of(b.column(0))[0].value_counts()
        yield pa.RecordBatch.from_arrays([c.field(0), c.field(1)], ["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), c: over all of a column `text`."""
    return texts.mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-3:]) % buckets


def bucket_of(word: Column, buckets: int) -> Column:
    return F.crc32(F.substring(word, -3, 3)) % buckets


@dataclass
class Vocabulary:
    """What tasks know of the counts. Ids: a word's place, then buckets, then the end of a
    text; the start of one is an input only."""

    words: list[bytes]  # every word above a count, most frequent first
    of: np.ndarray  # their counts
    size: int
    total: int
    distinct: int
    texts: int
    #: Of each bucket: its words' counts, and how many words.
    rest: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def __post_init__(self):
        self.place = {w: i for i, w in enumerate(self.words)}
        self.known_words = pa.array(self.words, pa.binary())
        self.buckets = len(self.rest)
        self.end = self.size + self.buckets
        self.width = math.isqrt(self.end) + 1  # outputs in a class
        self.classes = -(-(self.end + 1) // self.width)
        self.start = self.classes * self.width
        self.base = math.log10(self.total + 0.5 * (self.distinct + 1))
        self.inside = np.log10(self.rest + 0.5 * (self.kinds + 1))
        # By id; a bucket's words have counts of their own, which are left out here.
        self.known = np.r_[self.of, np.zeros(self.buckets, np.int64), self.texts] > 0
        self.log = np.r_[np.log10(self.of + 0.5), np.zeros(self.buckets), math.log10(self.texts + 0.5)]
        self.share = np.r_[np.zeros(self.size), self.inside, 0]

    def counts(self) -> np.ndarray:
        """By class and place in it; 0 where a class has no output."""
        c = np.zeros(self.start)
        c[: self.end + 1] = np.r_[self.of, self.rest, self.texts] + 0.5
        return c.reshape(self.classes, self.width)


def look_up(texts: pa.Array, v: Vocabulary):
    """Ids of the tokens of a column of texts, where each text's begin, the words beyond the
    known, and the places of their tokens."""
    import pyarrow.compute as pc

    words, each = words_of(texts)
    at = pc.fill_null(pc.index_in(words, value_set=v.known_words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    beyond = at < 0
    far = words.filter(pa.array(beyond))
    tails = pc.binary_slice(far, -3).dictionary_encode()
    of = np.fromiter((bucket(w, v.buckets) for w in tails.dictionary.to_pylist()), np.int64, len(tails.dictionary))
    at[beyond] = of[tails.indices.to_numpy()] + v.size
    ends = np.cumsum(each + 1) - 1
    inner = np.ones(len(at) + len(each), bool)
    inner[ends] = False
    ids = np.full(len(inner), v.end)
    ids[inner] = at
    return ids, ends - each, far, np.flatnonzero(inner)[beyond]


def initial(v: Vocabulary) -> dict[str, np.ndarray]:
    """q: inputs; w: positions; u, a: classes; t, b: outputs inside their class."""
    rng = np.random.default_rng(SEED)
    c = v.counts()
    of = c.sum(1)
    return {
        "q": rng.normal(0, 0.1, (v.start + 1, DIM)).astype(np.float32),
        "w": np.ones((2, DIM), np.float32),
        "u": rng.normal(0, 0.1, (v.classes, DIM)).astype(np.float32),
        "a": np.log(of / of.sum()).astype(np.float32),
        "t": rng.normal(0, 0.1, (v.start, DIM)).astype(np.float32),
        "b": np.log(np.where(c > 0, c, 1e-30) / of[:, None]).ravel().astype(np.float32),
    }


def contexts(ids: np.ndarray, v: Vocabulary, begin: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Input ids of the last and the one before for each token of texts that begin there."""
    last, before = np.empty_like(ids), np.empty_like(ids)
    last[1:], last[begin] = ids[:-1], v.start
    before[1:], before[begin] = last[:-1], v.start
    return last, before


def _gathered(at: np.ndarray, rows: np.ndarray, few: int = 4):
    """Different ids, and the sums of their rows: of the first few rows of an id by rows at a
    time, of more by id."""
    order = np.argsort(at)
    ranked = at[order]
    new = np.ones(len(at) + 1, bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:-1])
    first = np.flatnonzero(new)
    size, first = np.diff(first), first[:-1]
    by = np.argsort(np.minimum(size, few + 1))[::-1]
    size, first = size[by], first[by]
    sums = rows.take(order[first], axis=0)
    for i in range(1, few):
        m = np.count_nonzero(size > i)
        sums[:m] += rows.take(order[first[:m] + i], axis=0)
    if m := np.count_nonzero(size > few):
        more = size[:m] - few
        begin = np.cumsum(more) - more
        rest = np.arange(more.sum()) + np.repeat(first[:m] + few - begin, more)
        sums[:m] += np.add.reduceat(rows.take(order[rest], axis=0), begin, axis=0)
    return ranked[first], sums


def _noise(x: np.ndarray) -> np.ndarray:
    """What NCE adds to a score of noise, in place; for one of data it is 1 more."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(-0.5)
    return x


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _step(p, seen, v, rng, cdf, noise_log, sizes, c1, c2, target):
    """One step of noise-contrastive estimation with AdaGrad: of the class against noise that
    all tokens share, of the output against others of its class. Here outputs and classes hold
    their bias as a last column."""
    n, k = len(target), target // v.width
    drawn = np.searchsorted(cdf, rng.random(NOISE)).clip(0, v.classes - 1)
    own = sizes.take(k)
    outputs = np.empty((1 + INSIDE, n), np.int64)
    outputs[0] = target
    outputs[1:] = k * v.width + np.minimum((rng.random((INSIDE, n), np.float32) * own).astype(np.int64), own - 1)
    q1, q2 = p["q"].take(c1, axis=0), p["q"].take(c2, axis=0)
    r = np.empty((n, DIM + 1), np.float32)
    r[:, :DIM], r[:, DIM] = q1 * p["w"][0] + q2 * p["w"][1], 1
    u, d = p["u"].take(k, axis=0), p["u"].take(drawn, axis=0)
    o = p["t"].take(outputs, axis=0)
    u_pos = _noise(_dot(r, u) - noise_log.take(k)) + np.float32(1)
    u_neg = _noise(r @ d.T - noise_log[drawn])
    inside_log = np.log(INSIDE / own).astype(np.float32)
    t = _noise(np.stack([_dot(r, x) for x in o]) - inside_log)
    t[0] += 1
    rows = np.empty((1 + INSIDE, n, DIM + 1), np.float32)
    np.multiply(t[:, :, None], r, out=rows)
    at, g = _gathered(outputs.ravel(), rows.reshape(-1, DIM + 1))
    g_u = np.concatenate([u_pos[:, None] * r, u_neg.T @ r])
    at_c, g_c = _gathered(np.concatenate([k, drawn]), g_u)
    o *= t[:, :, None]
    u *= u_pos[:, None]
    u += u_neg @ d
    for x in o:
        u += x
    g_r = u[:, :DIM]
    at_q, g_q = _gathered(np.concatenate([c1, c2]), np.concatenate([g_r * p["w"][0], g_r * p["w"][1]]))
    g_w = np.stack([np.einsum("ij,ij->j", g_r, q1), np.einsum("ij,ij->j", g_r, q2)]) / n * 8
    for name, i, x in (("t", at, g), ("u", at_c, g_c), ("q", at_q, g_q), ("w", np.arange(2), g_w)):
        sums = seen[name].take(i, axis=0)
        sums += x * x
        seen[name][i] = sums
        x /= np.sqrt(sums, out=sums)
        x *= np.float32(RATE)
        x += p[name].take(i, axis=0)
        p[name][i] = x


#: A row of parameters: an id's q, t and b, a class's u and a, or w.
ROW = 2 * DIM + 1


def _rows(p, v: Vocabulary) -> np.ndarray:
    out = np.zeros((v.start + 1 + v.classes + 1, ROW), np.float32)
    ids = v.start + 1
    out[:ids, :DIM] = p["q"]
    out[: v.start, DIM : 2 * DIM], out[: v.start, -1] = p["t"], p["b"]
    out[ids:-1, :DIM], out[ids:-1, -1] = p["u"], p["a"]
    out[-1, :-1] = p["w"].ravel()
    return out


def _parameters(rows: np.ndarray, v: Vocabulary) -> dict[str, np.ndarray]:
    ids = v.start + 1
    p = {"q": rows[:ids, :DIM], "t": rows[: v.start, DIM : 2 * DIM], "b": rows[: v.start, -1], "u": rows[ids:-1, :DIM], "a": rows[ids:-1, -1], "w": rows[-1, :-1].reshape(2, DIM)}
    return {k: np.ascontiguousarray(x) for k, x in p.items()}


def _trained(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        p, c = initial(v), v.counts()
        p["t"], p["u"] = np.c_[p["t"], p.pop("b")], np.c_[p["u"], p.pop("a")]
        seen = {k: np.full(x.shape, 1e-2, np.float32) for k, x in p.items()}
        share, sizes = c.sum(1) / c.sum(), (c > 0).sum(1)
        cdf, noise_log = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        rng, n = np.random.default_rng(SEED), 0
        uses = np.zeros(v.start + 1)
        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                target, begin, *_ = look_up(b.column(0).slice(at, DOCS), v)
                c1, c2 = contexts(target, v, begin)
                order = rng.permutation(len(target))
                for i in range(0, len(order), STEP):
                    o = order[i : i + STEP]
                    _step(p, seen, v, rng, cdf, noise_log, sizes, c1[o], c2[o], target[o])
                for ids in (target, c1, c2):
                    uses += np.bincount(ids, minlength=len(uses))
                n += len(target)
        if n:
            weight = np.r_[uses, np.full(v.classes + 1, n)]
            p |= {"t": p["t"][:, :DIM], "b": p["t"][:, DIM], "u": p["u"][:, :DIM], "a": p["u"][:, DIM]}
            rows = _rows(p, v)
            used = np.flatnonzero(weight)
            for i in range(0, len(used), 10_000):
                at = used[i : i + 10_000]
                part = np.ascontiguousarray(rows[at].T)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(weight[at]), *map(pa.array, part)], ["at", "n", *(f"x{k}" for k in range(ROW))])

    return run


def train(texts: DataFrame, v: Vocabulary, known=None) -> dict[str, np.ndarray]:
    """The parameters' averages over all trainers of a column `text`; other columns only
    tell equal texts apart, so that many copies of one are dealt over all trainers."""
    known = known or texts.sparkSession.sparkContext.broadcast(v)
    fields = [f"x{k}" for k in range(ROW)]
    dealt = texts.select("text", F.xxhash64(*texts.columns, F.lit(SEED)).alias("at")).repartition(1 + v.total // TRAINER, "at").sortWithinPartitions("at", "text")
    rows = dealt.select("text").mapInArrow(_trained(known), "at int, n double, " + ", ".join(f"{x} float" for x in fields))
    mean = rows.groupBy("at").agg(*[(F.sum(F.col(x) * F.col("n")) / F.sum("n")).cast("float").alias(x) for x in fields]).toArrow()
    out = _rows(initial(v), v)
    if mean.num_rows:
        at = mean.column("at").to_numpy()
        for k, x in enumerate(fields):
            out[at, k] = mean.column(x).to_numpy()
    return _parameters(out, v)


def _norm(r: np.ndarray, t: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exponentials of r's scores."""
    out = np.empty(len(r), np.float32)
    # No score is above the product of the norms and the greatest bias; that is taken off
    # inside the product, unless it is so far above that the sum might vanish.
    high = np.sqrt(_dot(r, r) * _dot(t, t).max()) + b.max()
    outputs = np.vstack([t.T, b, np.ones(len(b), np.float32)])
    x = np.empty((len(r), r.shape[1] + 2), np.float32)
    x[:, :-2], x[:, -2], x[:, -1] = r, 1, -high
    one = np.ones(len(b), np.float32)
    for i in range(0, len(r), NORMED):
        z = x[i : i + NORMED] @ outputs
        np.matmul(np.exp(z, out=z), one, out=out[i : i + NORMED])
    with np.errstate(divide="ignore"):
        np.log(out, out=out)
    out += high
    far = np.flatnonzero(~(out > high - 60))
    for i in range(0, len(far), STEP):
        z = r[far[i : i + STEP]] @ t.T + b
        top = z.max(1)
        out[far[i : i + STEP]] = top + np.log(np.exp(z - top[:, None]).sum(1))
    return out


def log_probabilities(p, c1: np.ndarray, c2: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities; equal contexts are normalised once, over the classes
    and for each class that they meet."""
    classes = len(p["u"])
    width = len(p["t"]) // classes
    pair, where = np.unique(c1 * len(p["q"]) + c2, return_inverse=True)
    last, before = np.divmod(pair, len(p["q"]))
    r = p["q"].take(last, axis=0) * p["w"][0] + p["q"].take(before, axis=0) * p["w"][1]
    k = target // width
    met, inside = np.unique(k * len(pair) + where, return_inverse=True)
    norm = np.empty(len(met), np.float32)
    cut = np.searchsorted(met, np.arange(classes + 1) * len(pair))
    for i in np.flatnonzero(np.diff(cut)):
        own = slice(cut[i], cut[i + 1])
        outs = slice(i * width, (i + 1) * width)
        norm[own] = _norm(r.take(met[own] - i * len(pair), axis=0), p["t"][outs], p["b"][outs])
    of_class = _norm(r, p["u"], p["a"])
    score = _dot(r.take(where, axis=0), p["u"].take(k, axis=0) + p["t"].take(target, axis=0)) + p["a"].take(k) + p["b"].take(target)
    return (score - of_class.take(where) - norm.take(inside)).astype(np.float64) / math.log(10)


def _scored(known, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = known.value, shared.value
        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                target, begin, far, places = look_up(part.column(1), v)
                lp = log_probabilities(p, *contexts(target, v, begin), target)
                tokens = np.diff(np.r_[begin, len(target)])
                # Far words' own counts come later; here they are left out.
                base = np.add.reduceat(v.log[target], begin) - tokens * v.base
                own = np.add.reduceat(lp - v.share[target], begin)
                seen = np.add.reduceat(v.known[target].astype(np.int64), begin)
                # Each text's different far words.
                far = far.dictionary_encode()
                kinds = max(1, len(far.dictionary))
                text = np.searchsorted(begin, places, "right") - 1
                met, n = np.unique(text * kinds + far.indices.to_numpy(), return_counts=True)
                word = far.dictionary.take(pa.array(met % kinds))
                ends = np.searchsorted(met, np.arange(part.num_rows + 1) * kinds)
                beyond = pa.StructArray.from_arrays([word, pa.array(n, pa.int64())], ["word", "n"])
                columns = [part.column(0), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(own), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), beyond)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base", "score", "far"])

    return run


def vocabulary(counts: DataFrame, words: int, distinct: int, n_texts: int) -> Vocabulary:
    """Every word above a count, and the sums of the buckets of all others."""
    most, least, size = WIDE * math.isqrt(words + n_texts), 1, 0
    # There are at most about sqrt(2 * words) different counts.
    for r in sorted(counts.groupBy("c").count().collect(), key=lambda r: -r["c"]):
        if size + r["count"] > most:
            least = r["c"] + 1
            break
        size += r["count"]
    top = counts.where(F.col("c") >= least).toArrow()
    top = sorted(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    buckets = max(1, len(top) // 4)
    rest, kinds = np.zeros((2, buckets), np.int64)
    far = counts.where(F.col("c") < least).groupBy(bucket_of(F.col("word"), buckets).cast("int").alias("at")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow()
    at = far.column("at").to_numpy()
    rest[at], kinds[at] = far.column("c").to_numpy(), far.column("n").to_numpy()
    return Vocabulary([w for w, _ in top], np.array([c for _, c in top], np.int64), len(top), words + n_texts, distinct + (n_texts > 0), n_texts, rest, kinds)


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    learn = rows.where(~held_out(F.col("doc_id")))
    counts = stored(word_counts(learn.select("text")), "lm-counts")
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_texts = learn.count()
    v = vocabulary(counts, words, distinct, n_texts)
    known = spark.sparkContext.broadcast(v)
    shared = spark.sparkContext.broadcast(train(learn, v, known))
    scored = rows.mapInArrow(_scored(known, shared), "doc_id long, n_tokens long, n_known long, base double, score double, far array<struct<word:binary,n:bigint>>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    # Words beyond the known ones: their counts are joined by word, a document's pieces summed.
    far = scored.select("row", F.inline("far")).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10(F.col("c") + 0.5) * F.col("n")
    far = far.groupBy("row").agg(F.sum(log).alias("far_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("far_known"))
    out = scored.drop("far").join(far, "row", "left")
    far_log = F.coalesce("far_log", F.lit(0.0))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + far_log).alias("base_score"),
        (F.col("score") + far_log).alias("score"),
    )
