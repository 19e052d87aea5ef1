from datetime import datetime, timedelta

from pyspark.sql import functions as F

from memloom.plans.streams import drain
from memloom.streaming import sessions as ST

T0 = datetime(2025, 1, 1)


def folder(spark, tmp_path, rows, schema):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_sessions_close_by_silence(spark, tmp_path):
    rows = [[(1, at(0), 1.0), (1, at(60), 2.0), (2, at(0), 1.0)], [(1, at(7200), 4.0)], [(3, at(900000), 0.0)], [(3, at(900001), 0.0)]]
    path = folder(spark, tmp_path, rows, "user_id long, ts timestamp, value double")
    out = drain(ST.sessions(ST.read_events(spark, path), "1 hour", "1 minute"), spark)
    assert {(r["user_id"], r["start"], r["events"], r["value"]) for r in out.collect()} == {(1, at(0), 2, 3.0), (2, at(0), 1, 1.0), (1, at(7200), 1, 4.0)}


def test_cooldown_and_repetitions(spark, tmp_path):
    rows = [[("a", at(0)), ("a", at(100)), ("a", at(301)), ("b", at(5))]]
    path = folder(spark, tmp_path, rows, "key string, ts timestamp")
    out = drain(ST.cooldown(ST.read_events(spark, path)), spark)
    assert {(r["key"], r["ts"]) for r in out.collect()} == {("a", at(0)), ("a", at(301)), ("b", at(5))}
    once = drain(ST.once_within(ST.read_events(spark, path), "key"), spark)
    assert sorted(r["key"] for r in once.collect()) == ["a", "b"]


def test_stability_rises_and_fades(spark, tmp_path):
    path = folder(spark, tmp_path, [[("n", at(0)), ("n", at(60)), ("n", at(10 * 86400 + 60))]], "node_id string, ts timestamp")
    out = [r["stability"] for r in drain(ST.stability(ST.read_events(spark, path)), spark).orderBy("at").collect()]
    assert [round(x, 6) for x in out] == [0.25, 0.4, round(0.4 * 0.9**10 + 0.15, 6)]


def test_static_frames_work_too(spark):
    q = spark.createDataFrame([("s", at(0), 0.9), ("s", at(3600), 0.1), ("s", at(3700), None)], "space_id string, logged_at timestamp, avg_score double")
    got = ST.gap_windows(q, "6 hours", "6 hours").collect()
    assert [(r["queries"], r["low"]) for r in got] == [(3, 2)]
    c = spark.createDataFrame([("p", at(0)), ("p", at(0.2)), ("p", at(5))], "path string, ts timestamp")
    assert sorted(r["changes"] for r in ST.debounce(c).collect()) == [1, 2]
    assert ST.sessions(spark.createDataFrame([], "user_id long, ts timestamp, value double")).select(F.count("*")).first()[0] == 0
