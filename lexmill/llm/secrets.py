"""Secret scans: fixed patterns, and a likelihood ratio of two character Markov models.

One model is of random strings, one of ordinary identifiers; both are trained from
labelled samples by counting character pairs in Spark. Each is a table of a fixed number
of transitions, so their log ratio is a constant array in the scoring expression, and no
row is shuffled. A token is a secret if its mean log ratio for each transition is at least
`threshold`. Tokens are runs of 16 or more characters with digits and letters, or of letters
that change from small to capital twice; runs of one case or of digits alone are words and
numbers more often than secrets, and only the fixed patterns find those.

Cases: a null or empty text has no spans; very long texts are searched whole, and very long
runs are one token; offsets count code points; repeated rows and rows without an id are
searched each; an empty table gives an empty result; without labelled samples of a class its
transitions are uniform; all columns of the caller are kept, and a new column whose name is
taken gets underscores after it.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, let, renamed
from .pii import joined, placed, proposed

#: Kind: pattern. Java's engine takes each in one pass; see pii.py.
KINDS = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]++",
    "token": r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])|(?=[A-Za-z+/_=-]*?[a-z][A-Z][A-Za-z+/_=-]*?[a-z][A-Z]))[A-Za-z0-9+/_=-]{16,}+",
}
BASE = ("assign", "access", "hex")
#: What is proposed is what can be long enough: the same matches as KINDS' after the length rule.
PROPOSE = KINDS | {"hex": r"(?:\G|(?<![0-9a-f]))[0-9a-f]{24,}+", "access": r"AKIA[A-Z0-9]{16,}+"}
VALUE = r"""[A-Za-z0-9+/_.=-]+$"""
#: Characters of the models, by place; all others share the last place.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIZE = len(ALPHABET) + 1
#: Mean log ratio (natural) for a transition from which on a token is a secret.
THRESHOLD = 0.35
#: Labelled samples of a class that are used at most.
MOST_SAMPLES = 20_000


def place(c: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(at > 0, at - 1).otherwise(SIZE - 1)


def default_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled samples (value, secret): random strings in base 64, hex and capitals
    from a hash of counters; identifiers joined from common words."""
    words = (
        "get set is has to from with for user name value file path data list map key item index count total number "
        "order line part price date time day month year state code type class node tree text page view model table "
        "row column field column id url host port server client request response error message event handler manager "
        "service config option setting default test sample example build version update delete create insert select "
        "read write open close start stop begin end first last next previous old new max min sum mean input output "
        "left right top bottom width height color image button label window frame thread process memory buffer cache"
    ).split()
    w = F.array(*[F.lit(x) for x in words])

    def word(k):
        return F.get(w, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))).cast("int"))

    digest = F.sha2(F.col("id").cast("string"), 256)
    style = F.pmod(F.col("id"), F.lit(4))
    random = F.when(style == 0, F.substring(digest, 1, 40)).when(style == 1, F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""), 1, 20)))
    random = random.otherwise(F.substring(F.base64(F.unhex(digest)), 1, 40))
    parts = F.array(word(1), word(2), word(3), word(4))
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(100)).cast("string")
    plain = F.when(style == 0, F.array_join(parts, "_")).when(style == 1, F.array_join(F.transform(parts, lambda p: F.initcap(p)), ""))
    plain = plain.when(style == 2, F.concat(F.array_join(parts, "-"), F.lit("-"), number)).otherwise(F.concat(F.upper(F.array_join(parts, "_")), number))
    ids = spark.range(n)
    return ids.select(random.alias("value"), F.lit(True).alias("secret")).unionByName(ids.select(plain.alias("value"), F.lit(False).alias("secret")))


def train(samples: DataFrame, most: int = MOST_SAMPLES) -> list[float]:
    """Log ratios of all SIZE * SIZE transitions, row by row, with 0.5 added to each count.
    Of each class the `most` samples that come first by their hash are used."""
    drawn = None
    for label in (True, False):
        of = samples.where(F.col("secret") == label).select("value", "secret").orderBy(F.xxhash64("value"), "value").limit(most)
        drawn = of if drawn is None else drawn.unionByName(of)
    pairs = drawn.select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair")).where(F.length("pair") == 2)
    cell = place(F.substring("pair", 1, 1)) * SIZE + place(F.substring("pair", 2, 1))
    counts = {(r["secret"], r["cell"]): r["count"] for r in pairs.groupBy("secret", cell.alias("cell")).count().collect()}
    out = []
    for a in range(SIZE):
        rows = []
        for label in (True, False):
            row = [counts.get((label, a * SIZE + b), 0) + 0.5 for b in range(SIZE)]
            rows.append([math.log(x / sum(row)) for x in row])
        out += [r - o for r, o in zip(*rows, strict=True)]
    return out


def mean_ratio(s: Column, model: list[float]) -> Column:
    """The mean log ratio of a string's transitions; 0 for under two characters."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")

    def places(v):
        return F.transform(F.split(v, ""), place)

    def ratio(p):
        steps = F.sequence(F.lit(1), F.size(p) - 1)
        return F.aggregate(steps, F.lit(0.0), lambda t, i: t + F.get(table, F.get(p, i - 1) * SIZE + F.get(p, i))) / (F.size(p) - 1)

    return let(places(s), lambda p: F.when(F.size(p) > 1, ratio(p)).otherwise(0.0))


def confirmed(kind: str, s: Column, model: list[float], threshold: float) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(s, r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)) >= 6
    if kind == "access":
        return F.length(s) >= 20
    if kind == "hex":
        return F.length(s) >= 24
    return mean_ratio(s, model) >= threshold


def good(kind: str, model: list[float], threshold: float):
    return lambda z: confirmed(kind, z["s"], model, threshold)


def named(kind: str, rank: int):
    return lambda z: F.struct(z["start"].alias("start"), F.lit(rank).alias("rank"), z["stop"].alias("stop"), F.lit(kind).alias("kind"), z["s"].alias("value"))


def find_secrets(docs: DataFrame, text: str = "text", samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with secret_spans: array of (start, rank, stop, kind, value) in order."""
    model = train(default_samples(docs.sparkSession) if samples is None else samples)
    plain, names, (t,) = renamed(docs, text)
    out = plain.withColumn("__text", F.coalesce(F.col(t), F.lit("")))
    for kind, pattern in PROPOSE.items():
        out = out.withColumn(f"__m_{kind}", proposed(F.col("__text"), pattern))
    for rank, (kind, pattern) in enumerate(PROPOSE.items()):
        spans = F.filter(placed(F.col("__text"), pattern, F.col(f"__m_{kind}")), good(kind, model, threshold))
        none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string,value:string>>")
        out = out.withColumn(f"__s_{kind}", F.when(F.size(f"__m_{kind}") > 0, F.transform(spans, named(kind, rank))).otherwise(none))
    out = out.withColumn("secret_spans", F.array_sort(F.concat(*[F.col(f"__s_{k}") for k in KINDS])))
    return out.select(*names, "secret_spans").toDF(*docs.columns, free("secret_spans", docs.columns))


def secret_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", samples: DataFrame | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, and all spans."""
    found = find_secrets(docs.select(doc_id, text), text, samples)
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda z: z["rank"] < len(BASE))

    def of(kind):
        return F.size(F.filter(spans, lambda z: z["kind"] == kind)).cast("bigint")

    return found.select(
        F.col(doc_id).alias("doc_id"),
        *[of(k).alias(f"n_{k}") for k in BASE],
        of("token").alias("n_token"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
