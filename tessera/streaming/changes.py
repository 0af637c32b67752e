"""Change feeds: snapshot differences, stateful change detection, event windows, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", content: str = "hash") -> DataFrame:
    """key, change (created, modified, deleted), old_hash, new_hash between two snapshots: one full outer
    join. Deletions need both snapshots; a file source doesn't show them."""
    a = old.select(F.col(key).alias("k"), F.col(content).alias("old_hash"))
    b = new.select(F.col(key).alias("j"), F.col(content).alias("new_hash"))
    joined = a.join(b, F.col("k") == F.col("j"), "full_outer")
    change = F.when(F.col("k").isNull(), "created").when(F.col("j").isNull(), "deleted").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    return joined.select(F.coalesce("k", "j").alias(key), change.alias("change"), "old_hash", "new_hash").filter("change is not null")


def change_feed(files: DataFrame, key: str = "path", content: str = "hash", time: str = "ts") -> DataFrame:
    """key, change, ts of a stream of file states: created at first sight, modified when a later state has
    other content. State is the last hash and time of each key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_hash, last_ms = state.get if state.exists else (None, -1)
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            ms = int(row.ts.value // 1_000_000)
            if last_hash is None:
                out.append((k[0], "created", row.ts))
            elif row.hash != last_hash and ms >= last_ms:
                out.append((k[0], "modified", row.ts))
            else:
                continue
            last_hash, last_ms = row.hash, ms
        state.update((last_hash, last_ms))
        yield pd.DataFrame(out, columns=["key", "change", "ts"])

    rows = files.select(F.col(key).cast("string").alias("key"), F.col(content).alias("hash"), F.col(time).alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, change string, ts timestamp", "hash string, ms long", "append", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, key: str, time: str, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """key, start, end, n: bursts of events of a key, closed after a gap. Works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(events: DataFrame, time: str, by: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, by, n: tumbling or sliding windows. Works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def subscribed(events: DataFrame, hooks: DataFrame, kind: str = "event_type") -> DataFrame:
    """Each event once for each enabled hook that subscribes to its kind; hooks (hook, enabled, kinds) are
    configuration and stay small, Spark decides by their size whether to broadcast them."""
    wanted = hooks.filter("enabled").select("hook", F.explode("kinds").alias("_kind"))
    return events.join(wanted, F.col(kind) == F.col("_kind")).drop("_kind")


def upsert(batch: DataFrame, current: DataFrame, key: str, time: str) -> DataFrame:
    """The current table with the batch's latest row of each key in place of the old one."""
    latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), time).alias("r")).select("r.*")
    return current.join(latest.select(key), key, "left_anti").unionByName(latest)
