"""Ordered operators against a fold in Python."""

from __future__ import annotations

import random

from lexmill.operators import ordered


def fold(rows):
    kept, end = [], {}
    for k, a, tie, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3])):
        if k not in end or a >= end[k]:
            end[k] = b
            kept.append((k, a, tie, b))
    return sorted(kept, key=str)


def test_greedy_spans_in_ranges(spark):
    """One key with most spans, ranges far smaller than a key, empty spans, repeated rows, a null key; no key is gathered into a row."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        a = rng.randrange(700)
        rows.append((rng.choice([1, 1, 1, 1, 2, None]), a, rng.randrange(900), a + rng.choice([0, 1, 3, 9, 40])))
    rows += rows[:40] + [(7, 5, 1, 5), (7, 5, 1, 5), (7, 5, 2, 9), (7, 9, 0, 9)]
    d = spark.createDataFrame(rows, "k long, a long, t long, b long").select("k", "a", "b", "t")
    for stretch in (50, 100_000):
        got = ordered.greedy_spans(d, ["k"], "a", "b", "t", stretch)
        assert got.columns == ["k", "a", "t", "b"]
        assert sorted(map(tuple, got.collect()), key=str) == fold(rows)
        assert "collect_list" not in got._jdf.queryExecution().toString()
