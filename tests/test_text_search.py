import math
import re
from collections import Counter

import numpy as np

from memloom.operators import search


def brute(queries, docs, k):
    """BM25 term by term, as the statement of ``bm25_topk`` has it."""
    split = lambda x: [t for t in re.split(r"[\W_]+", (x or "").lower()) if t]
    want = {}
    asked = {(s, q, t) for s, q, x in queries for t in split(x)}
    for space in {s for s, _, _ in docs} - {None}:
        own = [(n, split(x)) for s, n, x in docs if s == space]
        avg = sum(len(t) for _, t in own) / len(own)
        rows = Counter((n, len(t), w) for n, t in own for w in t)
        df = Counter(w for _, _, w in rows)
        for s, q, w in asked:
            if s == space:
                for (n, length, x), tf in rows.items():
                    if x == w:
                        want[q, n] = want.get((q, n), 0) + math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    out = {}
    for q in {q for q, _ in want}:
        best = sorted((-round(x + 1e-9, 6), n) for (p, n), x in want.items() if p == q)[:k]
        out |= {(q, n, -x): r + 1 for r, (x, n) in enumerate(best)}
    return out


def frames(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words, n, p=np.arange(1, 31) / 465))
    docs = [(f"s{i % 2}", f"n{i:03d}", text(1 + i % 7)) for i in range(160)] + [("s0", "n000", "w1 w2 w29 w29"), ("s1", "n000", "w29 w3"), ("s0", "empty", ""), ("s0", "none", None), (None, "lost", "w29")]
    queries = [(f"s{i % 2}", f"q{i}", text(4)) for i in range(12)] + [("s0", "two", "w29 w28"), ("s0", "two", "w28 w1"), ("s0", "both", "w29 w3"), ("s1", "both", "w29 w3"), ("s0", "mute", "..."), (None, "lost", "w29"), ("s9", "away", "w29")]
    return queries, docs, spark.createDataFrame(queries, "space_id string, query_id string, text string"), spark.createDataFrame(docs, "space_id string, node_id string, text string")


def test_bm25_tiles_agree_with_brute_force(spark):
    """Texts of one query ask for a term once, spaces of a query add up, and the cut into tiles decides nothing."""
    queries, docs, q, d = frames(spark)
    want = brute(queries, docs, 9)
    for tiles in ({}, {"query_tile": 3, "doc_tile": 25}):
        got = {(r["query_id"], r["node_id"], r["score"]): r["rank"] for r in search.bm25_top_k(q, d, 9, **tiles).collect()}
        assert got == want


def test_bm25_moves_no_postings(spark):
    """Documents and queries meet in a cogroup by tile; postings and scores of all pairs aren't joined row by row."""
    _, _, q, d = frames(spark)
    plan = search.bm25_top_k(q, d, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "term" not in re.findall(r"Join .*", plan).__str__()
