from collections import defaultdict

import numpy as np

from memloom.llm.bisect import bisect, bisecting_leaves, describe_clusters, node_pairs, similarity_clusters
from memloom.llm.vectors import most_similar, vector_classes

SCHEMA = "grp string, obs string, vec array<float>, sim double"


def rows_of(seed=0, n=160, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dim) * 0.35 if i % 3 else rng.normal(size=dim)
        rows.append(("a" if i % 4 else "b", f"o{i:04d}", [float(np.float32(x)) for x in v], 0.0))
    rows += [("a", f"c{i}", rows[1][2], 0.0) for i in range(12)]  # copies of one vector
    rows += [("a", "s1", [2 * x for x in rows[2][2]], 0.0)]  # the same direction, another length
    rows += [("a", "z", [0.0] * dim, 0.0), ("a", "short", [1.0] * 4, 0.0), ("a", "null", None, 0.0), (None, "nogrp", rows[0][2], 0.0), ("a", None, rows[0][2], 0.0), ("a", "hole", [None] * dim, 0.0), ("a", "inf", [float("inf")] + [1.0] * (dim - 1), 0.0)]
    return rows + rows[:20]


def usable(rows, dim=16):
    out = {}
    for g, o, v, _ in rows:
        if g is not None and o is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            out[o] = (g, np.array(v, np.float32).astype(float))
    return out


def sims(rows):
    u = usable(rows)
    ids = sorted(u)
    s = {}
    for a in ids:
        for b in ids:
            if a < b and u[a][0] == u[b][0]:
                x, y = u[a][1], u[b][1]
                s[a, b] = round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 6)
    return u, s


def test_most_similar_matches_brute_force_for_any_tile_size(spark):
    rows = rows_of()
    u, s = sims(rows)
    want = set()
    for a in u:
        near = sorted((-s[min(a, b), max(a, b)], b) for b in u if b != a and u[b][0] == u[a][0])[:5]
        want |= {(a, b, -k) for k, b in near if -k >= 0.8}
    df = spark.createDataFrame(rows, SCHEMA)
    for tile, dense in ((7, 64), (64, 3), (16384, 64), (16384, 2)):
        got = {(r["id"], r["similar"], r["sim"]) for r in most_similar(df, "grp", "obs", "vec", 5, 0.8, 16, tile, dense).collect()}
        assert got == want


def test_clusters_match_closure_by_brute_force(spark):
    rows = rows_of(1)
    u, s = sims(rows)
    parent = {a: a for a in u}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (a, b), k in s.items():
        if k >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for a in u:
        groups[find(a)].append(a)
    want = {(a, min(m), len(m)) for m in groups.values() if len(m) >= 8 for a in m}
    df = spark.createDataFrame(rows, SCHEMA)
    for node in (9, 24, 16384):
        found = similarity_clusters(df, "grp", "obs", "vec", 0.8, 8, 16, node)
        assert {(r["id"], r["cluster"], r["size"]) for r in found.collect()} == want
    told = describe_clusters(found, df, "obs", "vec", 3, 16).collect()
    assert {(r["cluster"], r["size"]) for r in told} == {(c, n) for _, c, n in want} and all(len(r["typical"]) == 3 for r in told)


def test_far_nodes_are_dropped_before_they_are_compared(spark):
    rng = np.random.default_rng(6)
    centres = np.linalg.qr(rng.normal(size=(16, 8)))[0].T
    rows = [("a", f"o{i:04d}", [float(x) for x in centres[i % 8] + rng.normal(size=16) * 0.03], 0.0) for i in range(400)]
    rows += [("a", f"r{i:04d}", [float(x * (i + 1)) for x in centres[0]], 0.0) for i in range(90)]  # one direction, many lengths
    df = spark.createDataFrame(rows, SCHEMA)
    _, classes = vector_classes(df, "grp", "obs", "vec", 16, 1)
    leaves = bisecting_leaves(classes, np.arccos(0.8) / 2, 40).toPandas()
    assert len(leaves) == classes.count() and leaves.groupby("node").size().max() <= 40
    pairs = node_pairs(spark.createDataFrame(leaves), 0.8).toPandas()
    nodes = leaves["node"].nunique()
    assert nodes <= len(pairs) < nodes * (nodes + 1) / 4
    found = similarity_clusters(df, "grp", "obs", "vec", 0.8, 8, 16, 40).toPandas()
    assert found["cluster"].nunique() == 8 and len(found) == 490


def test_many_dimensions_are_exact(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(4, 1500))
    rows = [("a", f"o{i:02d}", [float(np.float32(x)) for x in base[i % 4] + rng.normal(size=1500) * 0.4], 0.0) for i in range(24)]
    u = {o: np.array(v) / np.linalg.norm(v) for _, o, v, _ in rows}
    want = {(a, b, round(float(u[a] @ u[b]), 6)) for a in u for b in sorted((b for b in u if b != a), key=lambda b: (-round(float(u[a] @ u[b]), 6), b))[:3] if u[a] @ u[b] >= 0.8}
    got = {(r["id"], r["similar"], r["sim"]) for r in most_similar(spark.createDataFrame(rows, SCHEMA), "grp", "obs", "vec", 3, 0.8, 1500).collect()}
    assert got == want and want


def test_bisect_leaves_are_compact_or_small():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(1, 8)) + rng.normal(size=(200, 8)) * 0.05, np.ones((90, 8))])
    u = x / np.sqrt((x * x).sum(1))[:, None]
    leaves = bisect(u, 0.3, 10)
    assert sorted(i for rows, _ in leaves for i in rows) == list(range(len(u)))
    for rows, compact in leaves:
        m = u[rows].mean(0)
        assert (u[rows] @ (m / np.sqrt(m @ m)) >= np.cos(0.3)).all() if compact else len(rows) <= 10


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert most_similar(none, "grp", "obs", "vec").count() == 0
    assert similarity_clusters(none, "grp", "obs", "vec").count() == 0
