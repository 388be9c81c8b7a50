"""The registry of open documents as a stream: entries that go stale, restarts, and names that
are worked out again for what a batch of changes touched.

`live_registry` needs the RocksDB state store (`STATE_STORE`), which keeps its timers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.naming import disambiguated
from ..operators.records import REGISTERED

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# Fixed values.
OVERRIDE, MODES = "naming-override:", ("source", "footer")
CHANGES = "key string, old_entry string, new_entry string, cause string"


class _Entries(StatefulProcessor):
    """A key's entry, and a timer for when its document counts as closed."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "entry string")

    def _held(self) -> str | None:
        return self.entry.get()[0] if self.entry.exists() else None

    def _set(self, key: str, new: str | None, cause: str) -> Iterator[pd.DataFrame]:
        old = self._held()
        if new is None:
            self.entry.clear()
        else:
            self.entry.update((new,))
        if old != new:
            yield pd.DataFrame({"key": [key], "old_entry": [old], "new_entry": [new], "cause": [cause]}, dtype="object")

    def handleInputRows(self, key, rows, timerValues):
        df = pd.concat(list(rows)).sort_values("ts", kind="stable")
        said = df[df["kind"] != "seen"]
        if len(said):
            last = said.iloc[-1]
            new = last["entry"] if last["kind"] == "set" and not pd.isna(last["entry"]) else None
            yield from self._set(key[0], new, last["kind"])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.entry.exists():
            self.handle.registerTimer(int(df["ts"].iloc[-1].timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._set(key[0], None, "stale")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        # A restart has no open documents yet: their entries are purged, all others kept.
        if not key[0].startswith(REGISTERED):
            self.entry.update((initialState["entry"].iloc[0],))


def live_registry(events: DataFrame, before: DataFrame | None = None, late: str = "10 seconds", idle_seconds: int = 60) -> DataFrame:
    """A stream of changes: key, old_entry, new_entry (null: none) and cause (`set`, `remove`,
    `stale`). events: key, ts, kind (`set` with an entry, `remove`, `seen`), entry. An entry
    whose document is not heard of for `idle_seconds` of event time is swept. `before` has
    the entries (key, entry) of a run that ended: those of open documents are purged."""
    rows = events.select(F.col("key").cast("string"), F.col("ts").cast("timestamp"), "kind", F.col("entry").cast("string")).withWatermark("ts", late)
    first = None if before is None else before.select(F.col("key").cast("string"), F.col("entry").cast("string")).groupBy("key")
    return rows.groupBy("key").transformWithStateInPandas(_Entries(idle_seconds * 1000), CHANGES, "Update", "EventTime", initialState=first)


def override_changes(changes: DataFrame) -> DataFrame:
    """url, mode of the changes (key, new_entry) that set or clear a document's naming; other
    values than the two modes clear it."""
    rows = changes.where(F.startswith("key", F.lit(OVERRIDE)))
    url = F.substring("key", len(OVERRIDE) + 1, 1 << 30)
    return rows.select(url.alias("url"), F.when(F.col("new_entry").isin(*MODES), F.col("new_entry")).alias("mode"))


class Store:
    """Rows by key in a shared folder. Keys are dealt to buckets; a batch writes the buckets that
    it touches as one version, and a bucket's rows are those of its last version. A version is
    made from those before it, so a batch that comes twice writes the same again."""

    def __init__(self, path: str, schema: str, key: str, buckets: int = 64) -> None:
        self.path, self.schema, self.key, self.buckets = path.rstrip("/"), schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def rows(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """What the store holds, before a version if one is given."""
        try:
            every = spark.read.schema(f"{self.schema}, gone boolean, version bigint, bucket int").parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], self.schema)
        if before is not None:
            every = every.where(F.col("version") < before)
        last = every.groupBy("bucket").agg(F.max("version").alias("version"))
        return every.join(F.broadcast(last), ["bucket", "version"]).where("NOT gone").drop("bucket", "version", "gone")  # one row a bucket

    def merge(self, batch: DataFrame, version: int) -> None:
        """`batch`: different keys, rows of the schema and `gone` (whether the key is removed)."""
        spark = batch.sparkSession
        new = batch.withColumn("bucket", self._bucket())
        touched = new.select("bucket").distinct()
        old = self.rows(spark, version).withColumn("gone", F.lit(False)).withColumn("bucket", self._bucket())
        old = old.join(F.broadcast(touched), "bucket", "left_semi").join(new.select(self.key), self.key, "left_anti")
        whole = old.unionByName(new)
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")


ENTRY = "id bigint, canonical string, target string, party_label string, party_name string, party string, part_vol string"


def renamed(store: Store, group: str = "registry") -> Callable[[DataFrame, int], DataFrame]:
    """A function for foreachBatch: merges a batch of changes (key, old_entry, new_entry as JSON,
    cause) of open documents into the store, and gives (id, name) of the documents in the groups
    of equal canonical names that the batch touched, and no others. Of a key's changes in one
    batch the sweep comes last."""

    def merge(changes: DataFrame, batch: int) -> DataFrame:
        spark = changes.sparkSession
        ours = changes.where(F.startswith("key", F.lit(REGISTERED))).withColumn("id", F.expr(f"try_cast(substring(key, {len(REGISTERED) + 1}) AS bigint)")).where("id IS NOT NULL")
        swept = (F.col("cause") == "stale").cast("int")
        ours = ours.groupBy("id").agg(F.min_by("old_entry", swept).alias("old_entry"), F.max_by("new_entry", swept).alias("new_entry"))
        ours = ours.withColumn("said", F.from_json("new_entry", ENTRY)).withColumn("was", F.from_json("old_entry", ENTRY))
        fields = [c.split()[0] for c in ENTRY.split(", ")][1:]
        store.merge(ours.select("id", *[F.col(f"said.{c}").alias(c) for c in fields], F.col("new_entry").isNull().alias("gone")), batch)
        touched = ours.select(F.explode(F.array("said.canonical", "was.canonical")).alias("canonical")).where("canonical IS NOT NULL").distinct()
        rows = store.rows(spark, batch + 1).join(touched, "canonical", "left_semi")
        return disambiguated(rows.withColumn("group", F.lit(group))).select("id", "name")

    return merge


def subscribe(changes: DataFrame, store: Store, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that keeps the store and hands each batch's new names to `sink`."""
    merge = renamed(store)
    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: sink(merge(df, batch), batch)).start()
