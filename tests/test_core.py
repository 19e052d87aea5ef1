import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import scoring as S, vec as V
from memloom.operators import graph as G, parse, search, spread, store
from memloom.operators.components import connected_components
from memloom.plans import learning, memory, retrieval
from memloom.sources.shared import materialize
from memloom.sources.small import join_small


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def L(x):
    return F.lit(float(x))


@pytest.mark.parametrize("w, a, b, want", [(0.5, 0.8, 0.6, 0.5046), (0.0, 0.5, 0.5, 0.005), (0.3, 1, 1, 0.317), (0.5, 0, 0.9, 0.495), (0.4, 0, 1, 0.396), (1.0, 1, 1, 1.0)])
def test_hebbian(spark, w, a, b, want):
    assert value(spark, S.hebbian(L(w), L(a), L(b))) == pytest.approx(want, abs=1e-9)


def test_decays(spark):
    assert value(spark, S.exponential_decay(L(1), L(10))) == pytest.approx(math.exp(-1))
    assert value(spark, S.exponential_decay(L(1), L(-3))) == 1
    assert value(spark, S.evidence_decay(L(0.5), L(10), L(4))) == pytest.approx(0.388165, abs=1e-6)


def test_effective_weight_of_no_mix_is_the_weight(spark):
    assert value(spark, S.effective_weight(L(0.7), L(0), L(0), L(0))) == pytest.approx(0.7)
    assert value(spark, S.effective_weight(L(-0.7), L(1), L(0), L(0))) == 0


def test_cosine_edges(spark):
    a = lambda *x: F.array(*[L(v) for v in x])
    assert value(spark, V.cosine(a(1, 0), a(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert value(spark, V.cosine(a(0, 0), a(1, 1))) == 0 and value(spark, V.cosine(a(1), a(1, 1))) == 0


def test_fused_similarity(spark):
    f = lambda sim, v, t, r: value(spark, S.fused_similarity(L(sim), F.lit(v), F.lit(t), F.lit(r)))
    assert f(0.99, True, True, 1) == 1.0 and f(0.5, True, False, None) == 0.5
    assert [round(f(0, False, True, r), 2) for r in (1, 5, 29, 80)] == [0.95, 0.87, 0.4, 0.4]


def test_edge_kinds(spark):
    k = lambda sim, co, a, b: value(spark, S.edge_kind(L(sim), L(co), F.lit(a), F.lit(b))[0])
    assert [k(0.8, 0, 2, 2), k(0.2, 0.6, 2, 2), k(0.5, 0.6, 2, 2), k(0.5, 0, 2, 3), k(0.8, 0, 2, 3), k(0.8, 0, 3, 2), k(0.1, 0, 2, 2)] == [
        "ANALOGOUS_TO", "CONTRASTS_WITH", "COMPOSES_WITH", "BRIDGES", "GENERALIZES_TO", "SPECIALIZES", "INFLUENCES"
    ]


@pytest.mark.parametrize("n, want", [(1, [100.0]), (2, [100.0, 0.0]), (5, [100.0, 75.0, 50.0, 25.0, 0.0]), (10, [100.0, 88.9, 77.8, 66.7, 55.6, 44.4, 33.3, 22.2, 11.1, 0.0])])
def test_percentile_confidence(spark, n, want):
    df = spark.createDataFrame([("q", f"n{i}", 1.0 - i / 10) for i in range(n)], "q string, id string, s double")
    got = retrieval.confidence(df, "q", [F.desc("s"), "id"]).orderBy("rank").collect()
    assert [r["percentile"] for r in got] == want
    assert all(r["level"] == ("HIGH" if p >= 90 else "MEDIUM" if p >= 40 else "LOW") for r, p in zip(got, want))


EDGES = [("A", "C", 0.6), ("B", "C", 0.3), ("C", "D", 0.5), ("C", "E", 0.2), ("D", "E", 0.4)]
SEEDS = [("A", 0.9), ("B", 0.8), ("C", 0.4), ("D", 0.2), ("E", 0.1)]


def graph(spark, kind):
    rows = [("q", s, d, kind, w) for s, d, w in EDGES] + [("q", "B", "D", "CONTRADICTS", 0.25)]
    return spark.createDataFrame([("q", n, a) for n, a in SEEDS], "query_id string, node_id string, act double"), spark.createDataFrame(rows, "query_id string, src string, dst string, rel_type string, eff double")


def test_learned_activation(spark):
    got = {r["node_id"]: r["act"] for r in spread.activate(*graph(spark, "CO_ACTIVATED_WITH")).collect()}
    assert got == pytest.approx({"A": 0.650250, "B": 0.578000, "C": 1.0, "D": 0.420272, "E": 0.342583}, abs=1e-6)


def test_attention_activation(spark):
    got = {r["node_id"]: r["act"] for r in spread.activate(*graph(spark, "ASSOCIATED_WITH"), attention={"ASSOCIATED_WITH": 0.65}).collect()}
    assert got == pytest.approx({"A": 0.650250, "B": 0.578000, "C": 1.0, "D": 0.170017, "E": 0.262051}, abs=1e-6)


def test_final_score(spark):
    got = []
    for sim, act, deg in ((0.9, 0.650250, 1), (0.8, 0.578, 2), (0.4, 1.0, 4), (0.2, 0.420272, 3), (0.1, 0.342583, 2)):
        zero = L(0)
        got.append(value(spark, S.final_score(L(sim), L(act), L(1), L(0.7), F.lit(0), F.lit(deg), F.lit(0), zero, zero, F.lit(False))))
    assert got == pytest.approx([0.769623, 0.660511, 0.526245, 0.260178, 0.204886], abs=1e-6)


def test_expand_hops_types_and_caps(spark):
    e = spark.createDataFrame([("a", f"b{i}", "ASSOCIATED_WITH", 1.0 - i / 100, 0.5) for i in range(60)] + [("b0", "c", "CO_ACTIVATED_WITH", 0.9, 0.9), ("b0", "x", "ASSOCIATED_WITH", 0.9, 0.9), ("c", "d", "CO_ACTIVATED_WITH", 0.9, 0.9)], "src string, dst string, rel_type string, weight double, eff double")
    got = {(r["src"], r["dst"]) for r in spread.expand(spark.createDataFrame([("q", "a")], "query_id string, node_id string"), e).collect()}
    assert got == {("a", f"b{i}") for i in range(50)} | {("b0", "c")}


def brute_components(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {a: find(a) for a in parent}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(f"n{rnd.randrange(200):03d}", f"n{rnd.randrange(200):03d}") for _ in range(120)] + [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(70)] + [("loop", "loop"), ("h", "h1")] + [("h", f"h{k}") for k in range(50)]
    df = spark.createDataFrame(edges + [(None, "x"), ("x", None)] + edges[:5], "src string, dst string")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == brute_components(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_bfs_triangles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("a", "a"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "a")], "root string, node string")
    assert {(r["node"], r["distance"]) for r in G.bfs(seeds, e, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert [r["node"] for r in G.bfs(seeds, e, 3, most=2).orderBy("distance", "node").collect()] == ["a", "b"]
    assert {tuple(r) for r in G.triangles(e).collect()} == {("a", "b", "c"), ("a", "c", "d")}


def brute_dbscan(points, eps, least):
    n = len(points)
    u = [np.array(v) / np.linalg.norm(v) for _, v in points]
    near = [[j for j in range(n) if j != i and round(float(u[i] @ u[j]), 6) >= 1 - eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    comp = brute_components([(points[i][0], points[j][0]) for i in range(n) if core[i] for j in [i, *near[i]] if core[j]])
    return {points[i][0]: comp[points[i][0]] if core[i] else min((comp[points[j][0]] for j in near[i] if core[j]), default=None) for i in range(n)}


@pytest.mark.parametrize("seed, eps, least", [(0, 0.1, 3), (1, 0.3, 2), (2, 0.05, 4)])
def test_dbscan(spark, seed, eps, least):
    rng = np.random.default_rng(seed)
    points = [(f"o{i:03d}", (np.eye(6)[i % 6] + rng.normal(size=6) * 0.25).tolist()) for i in range(90)]
    df = spark.createDataFrame([("g", i, v) for i, v in points], "grp string, id string, vec array<double>")
    for tile in (8192, 20):
        assert {r["id"]: r["cluster"] for r in G.dbscan(df, eps, least, tile).collect()} == brute_dbscan(points, eps, least)


def test_nearest_tiles_agree(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([("g", f"o{i:03d}", (np.eye(3)[i % 3] + rng.normal(size=3) * 0.1).tolist()) for i in range(60)] + [("g", f"c{i}", [1.0, 1.0, 1.0]) for i in range(6)], "grp string, id string, vec array<double>")
    whole = {tuple(r) for r in G.nearest(df, 3, 0.9).collect()}
    assert {tuple(r) for r in G.nearest(df, 3, 0.9, tile=7).collect()} == whole
    pairs = {(r["a"], r["b"]): r["sim"] for r in G.similar_pairs(df, 0.9).collect()}
    ids = [r["id"] for r in df.collect()]
    want = {(a, b, -s, n) for a in ids for n, (s, b) in enumerate(sorted((-pairs[min(a, b), max(a, b)], b) for b in ids if (min(a, b), max(a, b)) in pairs)[:3], 1)}
    assert whole == want


def test_dbscan_goldens(spark):
    x = [("a", [1.0, 0.01, 0.0]), ("b", [1.0, 0.02, 0.0]), ("c", [1.0, 0.03, 0.0])]
    y = [("d", [0.01, 1.0, 0.0]), ("e", [0.02, 1.0, 0.0]), ("f", [0.03, 1.0, 0.0])]
    labels = lambda p, eps, n: {r["cluster"] for r in G.dbscan(spark.createDataFrame([("g", i, v) for i, v in p], "grp string, id string, vec array<double>"), eps, n).collect()}
    assert labels(x, 0.2, 2) == {"a"} and labels(x + y, 0.2, 2) == {"a", "d"}
    assert labels([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0])], 0.3, 2) == {None}


def test_similar_pairs_tiles_agree(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(f"g{i % 2}", f"o{i:03d}", (np.eye(4)[i % 4] + rng.normal(size=4) * 0.3).tolist()) for i in range(80)], "grp string, id string, vec array<double>")
    whole = {tuple(r) for r in G.similar_pairs(df, 0.8).collect()}
    assert whole and {tuple(r) for r in G.similar_pairs(df, 0.8, tile=9).collect()} == whole


def test_mean_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1.0), ("a", [3.0, 6.0], 3.0), ("b", [5.0, 5.0], 2.0)], "k string, vec array<double>, w double")
    assert {r["k"]: r["mean"] for r in G.mean_vectors(df, "k", weight=F.col("w")).collect()} == {"a": [2.5, 5.0], "b": [5.0, 5.0]}


def test_vector_top_k_and_bm25(spark):
    rng = np.random.default_rng(3)
    v = [(f"s{i % 2}", f"o{i:02d}", rng.normal(size=5).tolist()) for i in range(40)]
    df = spark.createDataFrame(v, "space_id string, id string, vec array<double>")
    got = {(r["query_id"], r["node_id"]) for r in search.vector_top_k(df.where("id < 'o04'"), df, 3).collect()}
    want = set()
    for s, i, x in v[:4]:
        near = sorted((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6), j) for t, j, y in v if t == s and j != i)[:3]
        want |= {(i, j) for _, j in near}
    assert got == want
    docs = spark.createDataFrame([("s", "n1", "red cat cat"), ("s", "n2", "red dog"), ("s", "n3", ""), ("t", "n4", "cat")], "space_id string, node_id string, text string")
    q = spark.createDataFrame([("s", "q", "Cat? cat!"), ("s", "none", "...")], "space_id string, query_id string, text string")
    assert [(r["query_id"], r["node_id"]) for r in search.bm25_top_k(q, docs).collect()] == [("q", "n1")]


def test_crdt_merge_is_order_free(spark):
    cols = "src string, dst string, rel_type string, weight double, evidence long, dim_semantic double, dim_coactivation double"
    a = spark.createDataFrame([("x", "y", "CO_ACTIVATED_WITH", 0.3, 2, 0.1, 1.0), ("x", "z", "ASSOCIATED_WITH", 0.5, 1, 0.9, 0.0)], cols)
    b = spark.createDataFrame([("x", "y", "CO_ACTIVATED_WITH", 0.2, 5, 0.4, 0.0), ("x", "z", "ASSOCIATED_WITH", 0.6, 1, 0.2, 0.0)], cols)
    one, two = sorted(map(tuple, learning.crdt_merge(a, b).collect())), sorted(map(tuple, learning.crdt_merge(b, a).collect()))
    assert one == two == [("x", "y", "CO_ACTIVATED_WITH", 0.3, 7, 0.4, 1.0), ("x", "z", "ASSOCIATED_WITH", 0.6, 1, 0.9, 0.0)]


def test_truncation_keeps_the_budget(spark):
    rows = [("g", f"c{i}", "critical", 0.9 - i / 100, 300, "word. " * 200) for i in range(10)] + [("g", f"i{i}", "important", 0.7 - i / 100, 150, "x " * 300) for i in range(15)] + [("g", "b", "background", 0.1, 30, "y"), ("h", "only", "critical", 0.9, 9000, "z" * 36000)]
    df = spark.createDataFrame(rows, "grp string, id string, tier string, relevance double, tokens int, content string").repartition(5)
    got = {r["id"]: r["action"] for r in memory.truncate_tiers(df).collect()}
    assert [got[f"c{i}"] for i in range(10)] == ["kept"] * 6 + ["cut"] * 4
    assert [got[f"i{i}"] for i in range(15)] == ["kept"] * 10 + ["omitted"] * 5
    assert got["b"] == "summarised" and got["only"] == "kept"
    assert memory.truncate_tiers(df.limit(0)).count() == 0


def test_signal_fold_composes(spark):
    rnd = random.Random(2)
    # the composition of clamped steps is what signal_strength folds days with
    for _ in range(50):
        steps = [rnd.random() < 0.5 for _ in range(20)]
        s, c, lo, hi = 0.5, 0.0, -9.0, 9.0
        for up in steps:
            d, low, high = (0.15, -9.0, 1.0) if up else (-0.05, 0.1, 9.0)
            s = min(1.0, s + 0.15) if up else max(0.1, s - 0.05)
            c, lo, hi = c + d, min(high, max(low, lo + d)), min(high, max(low, hi + d))
        assert min(hi, max(lo, 0.5 + c)) == pytest.approx(s)


def test_upsert_and_import_modes(spark):
    old = spark.createDataFrame([("s", "n1", "/a", "A", None, ["t"], 1, None), ("s", "n2", "/b", "B", "sum", [], 3, None)], "space_id string, node_id string, path string, name string, summary string, tags array<string>, version int, updated_at timestamp")
    items = spark.createDataFrame([("s", "/a", None, "A2", None, None), ("s", "/c", None, "C", None, None), ("s", None, "n9", "N", None, None), ("s", "/c", None, "C", None, None)], "space_id string, path string, node_id string, name string, summary string, tags array<string>")
    got = {r["name"]: (r["change"], r["version"], r["tags"]) for r in store.upsert_nodes(old, items, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert got == {"A2": ("updated", 2, ["t"]), "B": ("kept", 3, []), "C": ("created", 1, None), "N": ("created", 1, None)}
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.import_rows(a, b, ["k"], "skip")) == [(1, "x"), (2, "y"), (3, "w")]
    assert rows(store.import_rows(a, b, ["k"], "overwrite")) == [(1, "x"), (2, "z"), (3, "w")]
    with pytest.raises(ValueError):
        store.import_rows(a, b, ["k"], "error")


def test_export_round_trip_and_damage(spark, tmp_path):
    df = spark.createDataFrame([("n1", False, [1.0]), ("n2", True, [2.0]), ("n3", None, None)], "node_id string, is_archived boolean, embedding array<double>")
    store.export_space({"nodes": df}, f"{tmp_path}/e", embeddings=False)
    manifest, back = store.read_export(spark, f"{tmp_path}/e")
    assert manifest["tables"]["nodes"]["rows"] == 2 and back["nodes"].columns == ["node_id", "is_archived"]
    back["nodes"].limit(1).write.mode("append").parquet(f"{tmp_path}/e/nodes.parquet")
    with pytest.raises(ValueError):
        store.read_export(spark, f"{tmp_path}/e")


def test_retention(spark):
    rows = [(f"b{i}", "full", f"2025-01-{i + 1:02d}", 10, i == 0) for i in range(6)] + [("old", "partial", "2020-01-01", 10, False)]
    df = spark.createDataFrame(rows, "backup_id string, kind string, created_at string, bytes long, keep_forever boolean").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r["backup_id"]: r["verdict"] for r in store.backup_retention(df, F.lit("2025-02-01").cast("timestamp"), {"full": 4, "partial": 4}, 365, 40).collect()}
    assert got == {"b0": "kept", "b1": "beyond count", "b2": "above quota", "b3": "kept", "b4": "kept", "b5": "kept", "old": "too old"}


SOURCES = {
    "a.py": ("class Foo:\n    def bar(self):\n        pass\n\n# doc\ndef baz():\n    pass\nMAX_SIZE = 3\n_private = 1\n", {("class", "Foo"), ("method", "bar"), ("function", "baz"), ("constant", "MAX_SIZE")}),
    "a.go": ("type Store struct {\n}\nfunc (s *Store) Get() {}\nfunc helper() {}\nconst Limit = 3\n", {("struct", "Store"), ("method", "Get"), ("function", "helper"), ("constant", "Limit")}),
    "a.rs": ("pub struct P;\npub fn run() {}\nenum E {}\ntrait T {}\n", {("struct", "P"), ("function", "run"), ("enum", "E"), ("trait", "T")}),
    "A.java": ("public class A {\n  public static final int MAX = 1;\n  public int get(int x) {\n", {("class", "A"), ("constant", "MAX"), ("method", "get")}),
    "a.ts": ("export interface I {}\nexport async function go() {}\nexport const f = (x: number) => x;\nconst LIMIT = 3;\ntype T = string;\n", {("interface", "I"), ("function", "go"), ("function", "f"), ("constant", "LIMIT"), ("type", "T")}),
    "a.c": ("#define SIZE 3\nstruct node {\nstatic int count(int a) {\n", {("macro", "SIZE"), ("struct", "node"), ("function", "count")}),
    "a.sql": ("CREATE TABLE users (\ncreate or replace view v as\n", {("table", "users"), ("view", "v")}),
    "a.proto": ("message M {\nservice S {\n  rpc Do (M) returns (M);\n", {("message", "M"), ("service", "S"), ("rpc", "Do")}),
    "a.tf": ('resource "x" "main" {\nvariable "v" {\n', {("resource", "main"), ("variable", "v")}),
    "Makefile": ("CC = gcc\nall: x\n", {("constant", "CC"), ("target", "all")}),
    "Dockerfile": ("FROM base AS build\nENV A=1\n", {("stage", "build"), ("variable", "A")}),
    "a.toml": ("[tool]\nname = 1\n", {("section", "tool"), ("key", "name")}),
    "a.md": ("# Title\ntext\n## Part\n", {("heading", "Title"), ("heading", "Part")}),
    "a.kt": ("data class K(val a: Int)\nfun go() {}\n", {("class", "K"), ("function", "go")}),
    "a.sh": ("run() {\nHOME_DIR=/x\n", {("function", "run"), ("constant", "HOME_DIR")}),
    "a.graphql": ("type Q {\nenum E {\n", {("type", "Q"), ("enum", "E")}),
    "a.cu": ("__global__ void add(int n) {\n", {("kernel", "add")}),
    "a.lua": ("local function f()\nfunction M.g()\n", {("function", "f"), ("function", "M.g")}),
    "a.cs": ("namespace N.M {\npublic class C {\n  public int Get(int a) {\n", {("namespace", "N.M"), ("class", "C"), ("method", "Get")}),
}


def test_symbols_by_language(spark):
    df = spark.createDataFrame([("s", f"x/{p}", t) for p, (t, _) in SOURCES.items()] + [("s", "x/none.zzz", "def f(): pass"), ("s", "x/null.py", None), ("s", "x/bom.py", "﻿def first():\r\n    pass\r\n")], "space_id string, file_path string, content string")
    got = defaultdict(set)
    for r in parse.symbols(df).collect():
        got[r["file_path"]].add((r["kind"], r["name"]))
    assert got.pop("x/bom.py") == {("function", "first")}
    assert dict(got) == {f"x/{p}": want for p, (_, want) in SOURCES.items()}


def test_resolution_order(spark):
    names = spark.createDataFrame([("s", "run", "a/b/x.py", 3), ("s", "run", "a/b/c/y.py", 1), ("s", "run", "z.py", 9), ("s", "solo", "q/w.py", 2), ("s", "two", "q/1.py", 1), ("s", "two", "r/2.py", 1)], "space_id string, name string, file_path string, line int")
    calls = spark.createDataFrame([("s", "a/b/x.py", 10, "run"), ("s", "a/b/other.py", 1, "run"), ("s", "e/f.py", 1, "run"), ("s", "e/f.py", 2, "solo"), ("s", "e/f.py", 3, "two"), ("s", "e/f.py", 4, "missing")], "space_id string, file_path string, line int, target string")
    got = {(r["file_path"], r["target"]): (r["found_in"], r["method"]) for r in parse.resolve(calls, names).collect()}
    assert got == {("a/b/x.py", "run"): ("a/b/x.py", "same_file"), ("a/b/other.py", "run"): ("a/b/c/y.py", "same_package"), ("e/f.py", "solo"): ("q/w.py", "global_unique")}


def test_sections():
    text = "intro words here\n## One\n" + "a " * 30 + "\n## Tiny\nb\n## Two\n" + "c " * 30
    got = parse.split_sections(text, 10, 5)
    assert [h for h, _ in got] == ["One", "Tiny / Two"] and got[0][1].startswith("intro words here\n\na") and got[1][1].startswith("b\n\nc")
    assert parse.split_sections("short ## text", 2000) == [("", "short ## text")]


def test_join_small_either_way(spark):
    a, b = spark.range(20).withColumnRenamed("id", "k"), spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    for limit in (100, 2):
        assert join_small(a, b, "k", limit=limit).where("v = 1").count() == 5


def test_materialize_gives_the_rows_back(spark):
    assert materialize(spark.range(7), "t").agg(F.sum("id")).first()[0] == 21


def test_repository_pages_and_vectors(spark, tmp_path):
    from memloom.sources import files

    root = tmp_path / "repo"
    for name, text in (("src/a.py", "x = 1\n"), ("src/b.md", "# t"), ("vendor/c.py", "y"), ("big.py", "z" * 300), ("bin.py", "a\x00b")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = {r["file_path"]: r["content"] for r in files.read_repository(spark, str(root), "s", [".py"], ["vendor"], largest=200).collect()}
    assert got == {"src/a.py": "x = 1\n"}
    html = "<html><style>p{}</style><h2 class='x'>Part &amp; parcel</h2><p>One<br>two</p><script>1</script></html>"
    assert value(spark, files.strip_html(F.lit(html))) == "## Part & parcel\nOne\ntwo"
    v = value(spark, files.hashed_vector(F.lit("Graph graph memory"), 16))
    assert len(v) == 16 and sum(x * x for x in v) == pytest.approx(1) and value(spark, files.hashed_vector(F.lit(None).cast("string"), 4)) == [0.0] * 4
    (tmp_path / "e.json").write_text('{"a": 1}\nnot json\n')
    assert [r["_corrupt"] for r in files.read_json_events(spark, str(tmp_path / "e.json"), "a int").collect()] == [None, "not json"]


def test_written_tables_go_with_the_driver(spark, monkeypatch):
    from memloom.sources import shared

    monkeypatch.setattr(shared, "_WRITTEN", {})
    kept, dropped = shared.materialize(spark.range(5), "kept"), shared.materialize(spark.range(6), "dropped")
    shared.drop_materialized(spark, dropped)
    folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://"))
    assert kept.count() == 5 and len(shared._WRITTEN) == 1 and os.path.isdir(folder)
    shared._forget()
    assert not os.path.isdir(folder) and not shared._WRITTEN
