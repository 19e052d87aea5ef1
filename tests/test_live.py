import datetime as dt

import duckdb
import numpy as np

from memloom.operators import search, spread
from memloom.plans import live  # noqa: F401  (registers)
from memloom.plans.base import ORACLES, QUERIES


def test_live_candidates_agree_with_sql(spark, tmp_path):
    """An observation without a node holds its place among the nearest, and a text delivered with two summaries is one text."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(90, 460):
        text = " ".join(rng.choice(words, 12))
        rows.append((f"o{i:05d}", None if i % 5 == 1 else f"n{i:05d}", f"s{i % 2}", text if i % 9 else " ", text[:20], [round(float(x), 4) for x in rng.normal(size=64)] if i % 11 else None))
    rows += [(*r[:4], "another summary", r[5]) for r in rows if r[0] in ("o00200", "o00202")]
    spark.createDataFrame(rows, "obs_id string, node_id string, space_id string, content string, summary string, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/observations.parquet")
    con = duckdb.connect()
    con.execute(f"create view observations as select * from '{tmp_path}/observations.parquet/*.parquet'")
    got = QUERIES["live_candidates"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES['live_candidates']})").fetchall()
    found = got.collect()
    assert want and sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_retrieve_live_agrees_with_sql(spark, tmp_path):
    """Rows delivered twice, archived nodes, a node without a row, two stored rows of one node, edges of all three kinds."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)] + ["architecture", "depends", "function", "recently", "config"]
    node = lambda i: f"n{i:05d}"
    write = lambda name, rows, kind: spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    when = lambda i: dt.datetime(2025, 1 + i % 11, 3, 4, 5, 6)
    obs = [(f"o{i:05d}", node(i), f"s{i % 2}", " ".join(rng.choice(words, 12)), "", [round(float(x), 4) for x in rng.normal(size=64)] if i % 11 else None, [0.1, 0.5, 0.9][i % 3], when(i)) for i in range(90, 460)]
    write("observations", obs + [(*r[:7], when(n + 1)) for n, r in enumerate(obs[:60])], "obs_id string, node_id string, space_id string, content string, summary string, embedding array<float>, surprise_score double, ingested_at timestamp")
    tags = [["python"], ["markdown"], ["config"], [], None]
    rows = [(f"s{i % 2}", node(i), f"/conversation/sess-{i % 25}/o{i}", f"x{i}", None, int(i % 10 == 0), "conversation_observation" if i % 3 else "file", tags[i % 5], 0.5 + i % 4 / 10, when(i), when(i + 1), None if i % 2 else when(i + 2), i % 17 == 0) for i in range(90, 460) if i % 41]
    rows += rows[:40] + [(*r[:4], "another summary", *r[5:]) for r in rows[100:130]]
    write("nodes", rows, "space_id string, node_id string, path string, name string, summary string, layer int, role_type string, tags array<string>, confidence double, created_at timestamp, updated_at timestamp, canonical_time timestamp, is_archived boolean")
    pair = lambda: rng.choice(np.arange(90, 460), 2, replace=False)
    write("similar_nodes", [(f"s{a % 2}", node(a), node(b), float(round(rng.random(), 3)), when(int(a))) for a, b in (pair() for _ in range(900))], "space_id string, node_id string, similar_node_id string, score double, linked_at timestamp")
    found = [(f"q{q:03d}", f"s{q % 2}", node(a), f"/conversation/sess-{a % 25}/o{a}", 0, 0.5, 0.5, float(round(rng.random(), 3)), when(q)) for q in range(80) for a in rng.choice(np.arange(90, 460), 12, replace=False)]
    write("retrieve_results", found, "query_id string, space_id string, node_id string, path string, layer int, score double, vector_sim double, activation double, retrieved_at timestamp")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in ("observations", "nodes", "similar_nodes", "retrieve_results"):
        kinds = con.execute(f"describe select * from '{tmp_path}/{name}.parquet/*.parquet'").fetchall()
        con.execute(f"create view {name} as select " + ", ".join(f"{c}::timestamp as {c}" if kind.startswith("TIMESTAMP") else c for c, kind, *_ in kinds) + f" from '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["retrieve_live"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES['retrieve_live']})").fetchall()
    assert want and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_activation_in_tiles_is_that_of_joins(spark):
    rng = np.random.default_rng(4)
    some = lambda: f"n{rng.integers(25)}"
    rows = [(f"q{q}", f"n{i}", i + 1, float(rng.random()), 0 if i % 5 else None, f"/f{i % 4}") for q in range(9) for i in range(15)]
    edges = list({(f"q{q}", some(), some(), rng.choice(["CO_ACTIVATED_WITH", "ABSTRACTS_TO", "other"]).item()) for q in range(9) for _ in range(60)})
    c = spark.createDataFrame([*rows, rows[1]], "query_id string, node_id string, fr int, sim double, layer int, folder string")
    e = spark.createDataFrame([(*x, float(rng.random())) for x in edges], "query_id string, src string, dst string, rel_type string, eff double")
    want = {(r["query_id"], r["node_id"]): r["act"] for r in spread.activate(spark.createDataFrame(rows, c.schema).selectExpr("query_id", "node_id", "sim as act"), e, attention=spread.ATTENTION).collect()}
    out = spread.activate_tiles(c, e, 9, tile=4)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()  # no round moves its sums
    for r in out.collect():
        assert abs(r["act"] - want[r["query_id"], r["node_id"]]) < 1e-9 and r["layer"] == 0
        assert r["deg"] == sum((x[1] == r["node_id"]) + (x[2] == r["node_id"]) for x in edges if x[0] == r["query_id"])
        assert r["dup"] == sum(x[0] == r["query_id"] and x[4] == 0 and x[5] == f"/f{int(r['node_id'][1:]) % 4}" for x in [*rows, rows[1]]) - 1
    assert out.count() == 9 * 12 + 1


def test_a_row_that_comes_twice_is_one_neighbour(spark):
    v = [("s", f"o{i}", [1.0, i / 10]) for i in range(6)]
    df = spark.createDataFrame([*v, v[1], v[0]], "space_id string, id string, vec array<double>")
    got = sorted((r["rank"], r["node_id"]) for r in search.vector_top_k(df.where("id = 'o0'"), df, 3).collect())
    assert got == [(1, "o1"), (2, "o2"), (3, "o3")]
