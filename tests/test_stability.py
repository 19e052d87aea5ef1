from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np

from memloom.plans.streams import drain, node_stability
from memloom.streaming import sessions as ST

T0 = datetime(2025, 1, 1)
SCHEMA = "node_id string, retrieved_at timestamp"


def fold(rows):
    own, out = defaultdict(list), []
    for n, t in rows:
        own[n].append(t)
    for n, times in own.items():
        value, last = 0.1, None
        for t in sorted(times):
            days = 0.0 if last is None else (t - last) / timedelta(days=1)
            value, last = min(1.0, (value * 0.9**days if days > 1 else value) + 0.15), t
            out.append((n, t, round(value, 9)))
    return sorted(out)


def test_files_in_any_order_fold_in_the_order_of_time(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"n{int(i)}", T0 + timedelta(seconds=int(t))) for i, t in zip(rng.integers(0, 400, 3000), rng.integers(0, 200 * 86400, 3000))]
    for part in (rows[:1000], rows[1000:2000], rows[2000:] + [(None, T0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/retrieve_results.parquet")
    assert sorted((r["node_id"], r["at"], round(r["stability"], 9)) for r in node_stability(spark, str(tmp_path)).collect()) == fold(rows)


def test_state_is_kept_over_batches_and_costs_a_call_a_bucket(spark, tmp_path):
    rows = [(f"n{i}", T0 + timedelta(hours=k * 20 + i % 7)) for k in range(3) for i in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[300 * k : 300 * (k + 1)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    e = ST.read_events(spark, f"{tmp_path}/in").withColumnRenamed("retrieved_at", "ts")
    assert sorted((r["node_id"], r["at"], round(r["stability"], 9)) for r in drain(ST.stability(e, buckets=5), spark).collect()) == fold(rows)
