"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with literal tokens that any URL it fits must hold. How
often those tokens occur is counted over all URLs; a rule is filed under its rarest. A
URL's tokens fetch the rules filed under them, and only those run their expressions.

Rules of a host and path come first: a rule fits its host and all subdomains if the path
starts with the rule's, and the longest that fits decides. Where none fits, the pattern
rules decide: the fitting one that comes first; without one, allow.

Rules are a list of the caller's, so they and their index are held by the driver and sent
to the tasks; nothing else is, and no URL is shuffled.

Cases: a null URL, or one without `://`, has an empty host and path and is allowed; very
long URLs are handled whole; repeated rows are judged each; an empty table gives an empty
result; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`name` is what is reported; `pattern` runs on `host` + `path` joined, lower-cased
    in the host only; `tokens` are literal tokens (lower-case) that a fitting URL holds, each
    between others' ends."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    length: int = 0


def host_rule(verdict: str, name: str) -> Rule:
    """A rule like `example.net/en/`: host, then the start of the path."""
    host, slash, path = name.partition("/")
    pattern = rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    return Rule(name, verdict, pattern, tuple(re.findall(TOKEN, host)), len(name))


def pattern_rule(text: str, verdict: str = "block") -> Rule:
    """A rule in the notation of filter lists: `*` is anything, `^` a place without a letter
    or digit on one side (or an end), `|` at the start or end is an anchor, `||` the start of
    a host's label. Its tokens are those that stand between separators; a rule without such
    a token is filed under none and runs for every URL."""
    body = text
    start = "(?is).*?"
    if body.startswith("||"):
        body, start = body[2:], r"(?is)(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "(?is)"
    stop = ""
    if body.endswith("|"):
        body, stop = body[:-1], r"\Z"
    edge = r"(?:(?<![a-z0-9])|(?![a-z0-9]))"
    regex = start + "".join({"*": ".*?", "^": edge}.get(c) or re.escape(c) for c in body) + stop
    closed = ("^" if text.startswith("|") else "*") + body + ("^" if stop else "*")
    return Rule(text, verdict, regex, tuple(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", closed.lower())))


#: The given rules; a longer name wins over a shorter.
HOST_RULES = tuple(host_rule(*r) for r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")))
#: The method's own, where no given rule fits: words that advertising, gambling, pills and
#: adult sites have in their addresses.
PATTERN_RULES = tuple(
    pattern_rule(p)
    for p in (
        "^casino^", "^casinos^", "^bets^", "^betting^", "^poker^", "^jackpot^", "^pills^", "^viagra^", "^cialis^", "^xxx^", "^porn^", "^escorts^", "^spam^",
        "^ads^", "^adserver^", "^adclick^", "^banners^", "^popunder^", "^affiliate^", "||ads.", "||track.", "^click^*^redirect^", "/wp-content/*/ads/",
    )
)


def parts():
    """host and path as columns of `url`."""
    has = F.coalesce(F.contains("url", F.lit("://")), F.lit(False))
    host = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, low).otherwise("").alias("host"), F.when(has, path).otherwise("").alias("path")


def rarest(split: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """token: the rules (by place) filed under it. Only the rules' own tokens are counted."""
    wanted = sorted({t for r in rules for t in r.tokens})
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(TOKEN), F.lit(0)))
    seen = split.select(F.explode(F.array_intersect(words, F.array(*[F.lit(t) for t in wanted]))).alias("token"))
    counts = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}
    index: dict[str, list[int]] = {}
    for place, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(place)
    return index


def judge(rules: tuple[Rule, ...], index: dict[str, list[int]], hosted: int):
    """A function of hosts and paths: for each URL the place of the rule that decides, or -1."""

    @F.pandas_udf("int")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = [re.compile(r.pattern) for r in rules]
        word = re.compile(TOKEN)

        def one(host: str, path: str) -> int:
            url = host + path
            places = {p for t in {"", *word.findall(url.lower())} & index.keys() for p in index[t]}
            fits = [p for p in places if run[p].match(url)]
            given = [p for p in fits if p < hosted]
            return max(given, key=lambda p: rules[p].length) if given else min(fits, default=-1)

        for hosts, paths in batches:
            yield pd.Series([one(h, p) for h, p in zip(hosts, paths, strict=True)], dtype="int32")

    return decide


def judge_urls(pages: DataFrame, host_rules: tuple[Rule, ...] = HOST_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule (of the given ones, or null), pattern
    (of the method's own, or null), verdict."""
    rules = (*host_rules, *pattern_rules)
    split = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", *parts())
    index = rarest(split, rules)
    at = judge(rules, index, len(host_rules))("host", "path")
    names = F.array(*[F.lit(r.name) for r in rules])
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    out = split.withColumn("at", at)
    given = F.col("at") < len(host_rules)
    known = F.col("at") >= 0
    return out.select(
        "page_id",
        "host",
        "path",
        F.when(known & given, F.get(names, F.col("at"))).alias("rule"),
        F.when(known & ~given, F.get(names, F.col("at"))).alias("pattern"),
        F.when(known, F.get(verdicts, F.col("at"))).otherwise("allow").alias("verdict"),
    )
