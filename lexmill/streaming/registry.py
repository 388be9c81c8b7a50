"""Debounced rescans and the registry of open documents, over batches or streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: a rescan waits until nothing has changed for so long.
QUIET = "400 milliseconds"


def debounced(changes: DataFrame, key: str, ts: str = "ts", late: str = "1 minute", quiet: str = QUIET) -> DataFrame:
    """One row per burst of a key's changes: when the rescan is due, and how many changes
    it covers. On a stream, changes more than `late` behind are dropped."""
    rows = changes.withWatermark(ts, late) if changes.isStreaming else changes
    bursts = rows.groupBy(F.session_window(ts, quiet).alias("burst"), key).agg(F.count(F.lit(1)).alias("n_changes"))
    return bursts.select(key, F.col("burst.end").alias("due"), "n_changes")


def registry_changes(events: DataFrame, key: str, entry: str, removed: Column) -> DataFrame:
    """A stream of the registry's changes: key, old and new entry (null: none), whenever an
    event sets or removes an entry. Events of one batch count in the order of `ts`."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(~removed, F.col(entry).cast("string")).alias("entry"))

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        new = rows["entry"].iloc[-1]
        new = None if pd.isna(new) else new
        if new is None:
            if state.exists:
                state.remove()
        else:
            state.update((new,))
        if new != old:
            yield pd.DataFrame({"key": [k[0]], "old_entry": [old], "new_entry": [new]}, dtype="object")

    return rows.groupBy("key").applyInPandasWithState(update, "key string, old_entry string, new_entry string", "entry string", "update", GroupStateTimeout.NoTimeout)
