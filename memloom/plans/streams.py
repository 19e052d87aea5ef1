"""The streaming operators run to the end over stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memloom.plans.base import query, r6
from memloom.sources import tables as T
from memloom.sources.shared import shared_dir
from memloom.streaming import sessions as ST


def drain(stream, spark, mode: str = "append"):
    """Run a stream over what is there and read what it wrote."""
    base = f"{shared_dir(spark)}/memloom/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(
    "event_sessions",
    """with e as (select *, case when ts > lag(ts) over (partition by user_id order by ts, event_id) + interval 12 hour or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end n from events), s as (select *, sum(n) over (partition by user_id order by ts, event_id) g from e)
select user_id, min(ts) as start, count(*) as events, round(sum(value), 6) as value from s group by user_id, g""",
)
def event_sessions(spark, d):
    """Sessions of users: the streaming aggregation over the static table."""
    return ST.sessions(T.table(spark, d, "events")).select("user_id", "start", "events", r6("value").alias("value"))


@query("gap_windows")
def gap_windows(spark, d):
    """The same aggregation as a stream; the last open windows stay in state, as the watermark has not passed them."""
    return drain(ST.gap_windows(ST.read_events(spark, f"{d}/query_log.parquet")), spark)


@query("trigger_cooldown")
def trigger_cooldown(spark, d):
    """Events of one type as triggers, 300 seconds apart."""
    e = ST.read_events(spark, f"{d}/events.parquet").select(F.col("event_type").alias("key"), "ts")
    return drain(ST.cooldown(e), spark)


@query("node_stability")
def node_stability(spark, d):
    """Every delivery of a result strengthens its node, in the order of time: one batch, as the cut of a table into files is no order."""
    e = ST.read_events(spark, f"{d}/retrieve_results.parquet", files_per_trigger=None).where("node_id is not null").select("node_id", F.col("retrieved_at").alias("ts"))
    return drain(ST.stability(e, buckets=max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), spark)
