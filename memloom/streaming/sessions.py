"""Event-driven operators as Structured Streaming; each takes a streaming or a static frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark, path: str, schema=None, files_per_trigger: int | None = 1) -> DataFrame:
    """A Parquet file or folder as a stream; the schema is that of the files there unless given.

    Without ``files_per_trigger`` all that is there is one batch.
    """
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        events = reader.parquet(path)
    else:  # a stream reads folders, so one file is picked out of its folder
        events = reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    zoneless = [c for c, kind in events.dtypes if kind == "timestamp_ntz"]
    return events.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else events


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, events, value): sessions closed by ``gap`` of silence; rows later than ``late`` are dropped."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def debounce(changes: DataFrame, quiet: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """(path, changed_at, changes): one row per burst of changes of a path, once it has been quiet."""
    w = changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.max("ts").alias("changed_at"), F.count("*").alias("changes"))
    return w.select("path", "changed_at", "changes")


def gap_windows(queries: DataFrame, window: str = "24 hours", slide: str = "6 hours", low: float = 0.5, late: str = "1 day") -> DataFrame:
    """(space_id, start, queries, low, share): how many queries of each sliding window were answered badly."""
    w = queries.withWatermark("logged_at", late).groupBy("space_id", F.window("logged_at", window, slide).alias("w"))
    out = w.agg(F.count("*").alias("queries"), F.sum(F.when(F.coalesce("avg_score", F.lit(0.0)) < low, 1).otherwise(0)).alias("low"))
    return out.select("space_id", F.col("w.start").alias("start"), "queries", "low", F.round(F.col("low") / F.col("queries") + 1e-9, 6).alias("share"))


def once_within(triggers: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Triggers without their repetitions inside the watermark."""
    return triggers.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def cooldown(triggers: DataFrame, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """(key, ts): triggers of a key at least ``seconds`` after the last that went through; state is one time per key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for pdf in batches for t in pdf["ts"])
        out = []
        for t in times:
            us = int(t.value // 1000)
            if last is None or us - last >= seconds * 1_000_000:
                out.append(t)
                last = us
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(out), "ts": out})

    return triggers.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key string, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def stability(events: DataFrame, increase: float = 0.15, daily: float = 0.9, buckets: int = 65_536) -> DataFrame:
    """(node_id, at, stability): reinforcements raise a node's stability to 1 at most, days without lower it; state is two numbers per node.

    The nodes of a hash bucket are folded in one call, as a call costs far more
    than a node's few events.  Few buckets suit few large batches, many suit small
    ones, as a bucket's state is written whole; a stream keeps the number it began with.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
        new = pd.concat(batches, ignore_index=True).sort_values("ts", kind="stable", ignore_index=True)
        out = []
        for node, us in zip(new["node_id"], new["ts"].astype("datetime64[us]").astype("int64").tolist()):
            value, last = known.get(node, (0.1, None))
            days = 0.0 if last is None else max(0.0, (us - last) / 86_400e6)
            value = min(1.0, (value * daily**days if days > 1 else value) + increase)
            known[node] = value, us if last is None else max(last, us)
            out.append(value)
        state.update((list(known), [v for v, _ in known.values()], [t for _, t in known.values()]))
        yield pd.DataFrame({"node_id": new["node_id"], "at": new["ts"], "stability": out})

    bucket = F.pmod(F.xxhash64("node_id"), F.lit(buckets)).alias("bucket")
    return events.select("node_id", "ts", bucket).groupBy("bucket").applyInPandasWithState(step, "node_id string, at timestamp, stability double", "nodes array<string>, value array<double>, last array<long>", "append", GroupStateTimeout.NoTimeout)
