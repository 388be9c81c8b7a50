"""Streams of the registry: sweeps, restarts, replayed batches; files and answers as documents."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexmill.sources import files
from lexmill.streaming import live

EVENTS = "n long, key string, kind string, entry string, s long"


@pytest.fixture
def rocks(spark):
    name, value = live.STATE_STORE
    spark.conf.set(name, value)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, path, rows):
    """A stream of the rows, one batch for each n."""
    df = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    for n in sorted({r[0] for r in rows}):
        df.where(F.col("n") == n).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def changes_of(spark, stream, before, path, name):
    out = live.live_registry(stream, before, "0 seconds", 60)
    q = out.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(path)).start()
    try:
        q.processAllAvailable()
        return [tuple(r) for r in spark.table(name).select("key", "old_entry", "new_entry", "cause").collect()]
    finally:
        q.stop()


def test_stale_entries_are_swept(rocks, tmp_path):
    rows = [
        (1, "titledoc:1", "set", "one", 0), (1, "titledoc:2", "set", "two", 0),
        (2, "titledoc:1", "seen", None, 50), (3, "titledoc:3", "set", "x", 100), (3, "titledoc:3", "remove", None, 101),
        (4, "other", "set", "o", 103), (5, "other", "seen", None, 104),
    ]
    got = changes_of(rocks, streamed(rocks, tmp_path / "in", rows), None, tmp_path / "c", "swept")
    # The second was not heard of after 0, the first was at 50: at 101 only the second is stale.
    assert ("titledoc:2", "two", None, "stale") in got and not any(k == "titledoc:1" and c == "stale" for k, _, _, c in got)
    assert ("titledoc:1", None, "one", "set") in got and ("other", None, "o", "set") in got
    assert not any(k == "titledoc:3" for k, _, _, _ in got)  # set and removed in one batch: nothing changed


def test_restart_purges_open_documents(rocks, tmp_path):
    before = rocks.createDataFrame([("titledoc:1", "old"), ("naming-override:u", "footer")], "key string, entry string")
    rows = [(1, "titledoc:1", "set", "new", 0), (1, "naming-override:u", "set", "source", 0)]
    got = changes_of(rocks, streamed(rocks, tmp_path / "in", rows), before, tmp_path / "c", "restarted")
    assert sorted(got) == [("naming-override:u", "footer", "source", "set"), ("titledoc:1", None, "new", "set")]


CHANGES = "key string, old_entry string, new_entry string, cause string"


def entry(canonical, label=None, target=None):
    return json.dumps({"canonical": canonical, "party_label": label, "target": target})


def test_replayed_batch_changes_nothing(spark, tmp_path):
    store = live.Store(str(tmp_path / "registry"), live.ENTRY, "id", buckets=4)
    merge = live.renamed(store)

    def batch(n, rows):
        return {r.id: r.name for r in merge(spark.createDataFrame(rows, CHANGES), n).collect()}

    first = [("titledoc:1", None, entry("Reply", "Plaintiff"), "set"), ("titledoc:2", None, entry("Demurrer", "Defendant"), "set"), ("other:1", None, "x", "set")]
    assert batch(0, first) == {1: "Reply", 2: "Demurrer"}
    # A second reply gives both another name; the demurrer's group is not touched.
    second = [("titledoc:3", None, entry("Reply", "Defendant"), "set")]
    names = batch(1, second)
    assert set(names) == {1, 3} and names[1] != "Reply"
    held = sorted(map(tuple, store.rows(spark).collect()), key=str)
    assert batch(1, second) == names and sorted(map(tuple, store.rows(spark).collect()), key=str) == held
    # Swept in the batch that set it: the sweep counts, and the other gets its short name back.
    third = [("titledoc:3", entry("Reply", "Defendant"), entry("Reply", "Cross-Defendant"), "set"), ("titledoc:3", entry("Reply", "Cross-Defendant"), None, "stale")]
    assert batch(2, third) == {1: "Reply"}
    assert sorted(r.id for r in store.rows(spark).collect()) == [1, 2]
    assert sorted(r.id for r in store.rows(spark, 2).collect()) == [1, 2, 3]


def test_subscription(spark, tmp_path):
    rows = [(1, "titledoc:1", "set", entry("Reply", "Plaintiff"), 0), (2, "titledoc:2", "set", entry("Reply", "Defendant"), 1)]
    stream = streamed(spark, tmp_path / "in", rows).select("key", F.lit(None).cast("string").alias("old_entry"), F.col("entry").alias("new_entry"), F.lit("set").alias("cause"))
    seen = []
    q = live.subscribe(stream, live.Store(str(tmp_path / "store"), live.ENTRY, "id", 2), lambda df, b: seen.append((b, sorted(r.id for r in df.collect()))), str(tmp_path / "c"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [(0, [1]), (1, [1, 2])]


def test_override_changes(spark):
    rows = [("naming-override:file:///a.pdf", None, "footer", "set"), ("naming-override:b", "source", "odd", "set"), ("naming-override:c", "source", None, "remove"), ("titledoc:1", None, "x", "set")]
    got = {(r.url, r.mode) for r in live.override_changes(spark.createDataFrame(rows, CHANGES)).collect()}
    assert got == {("file:///a.pdf", "footer"), ("b", None), ("c", None)}


# --- files ---


def test_local_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in (("a b+1%.pdf", b"%PDF-1"), ("deep/B.PDF", b"two"), ("c.txt", b"no"), ("deep/scan", b"typed"), ("x.pdf.bak", b"no")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.source_name: bytes(r.content) for r in files.local_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a b+1%.pdf": b"%PDF-1", "B.PDF": b"two"}
    types = spark.createDataFrame([("scan", "application/pdf"), ("c.txt", "text/plain")], "name string, mime string")
    rows = files.local_files(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "*.txt")], types).select("source_name", "editable", "length").collect()
    assert {(r.source_name, r.editable, r.length) for r in rows} == {("a b+1%.pdf", True, 6), ("B.PDF", True, 3), ("scan", True, 5)}


def test_bytes_are_read_only_where_used(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    plan = files.local_files(spark, str(tmp_path)).select("source_name", "length")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_fetched(spark):
    rows = [
        ("https://ex.com/docs/a.pdf?x=1", 200, 'attachment; filename="b.pdf"', b"1"), ("https://ex.com/docs/c.pdf", 206, None, b"2"),
        ("https://ex.com/docs/d.pdf", 404, None, b"gone"), ("https://ex.com/docs/e.pdf", None, None, None),
    ]
    got = [tuple(r) for r in files.fetched(spark.createDataFrame(rows, "url string, status int, content_disposition string, content binary")).select("name", "content", "error").collect()]
    assert got == [("b.pdf", b"1", None), ("c.pdf", b"2", None), ("d.pdf", None, "HTTP 404"), ("e.pdf", None, "HTTP none")]
