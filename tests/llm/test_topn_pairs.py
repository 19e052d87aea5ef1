import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from memloom.llm.cooccur import _gram, clean_tag, pair_lift
from memloom.llm.topn import top_n_per_group


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is None or i is None or s is None or math.isnan(s):
            continue
        best[g, i] = max(best.get((g, i), -math.inf), s)
    by = defaultdict(list)
    for (g, i), s in best.items():
        by[g].append((-s, i))
    return {(g, i, p) for g, x in by.items() for p, (_, i) in enumerate(sorted(x)[:n], 1)}


def test_top_n_matches_brute_force_with_hot_group_ties_nulls(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else f"g{rnd.randrange(60)}", f"n{rnd.randrange(400):04d}", rnd.choice([0.1, 0.5, 0.5, 0.9, rnd.random()])) for _ in range(4000)]
    rows += [(None, "n1", 1.0), ("g1", None, 1.0), ("g1", "n1", None), ("g1", "n2", float("nan")), ("one", "n1", 0.0)] + rows[:50]
    df = spark.createDataFrame(rows, "g string, item string, s double").withColumns({"position": F.lit(7), "_place": F.lit("x"), "_g": F.lit(1)}).repartition(7)
    for n in (1, 10):
        got = {(r["g"], r["item"], r["position"]) for r in top_n_per_group(df, "g", "s", "item", n).collect()}
        assert got == brute_top(rows, n)


def test_top_n_one_group_over_many_partitions(spark):
    rows = [("g", f"i{k:05d}", float(k % 7)) for k in range(5000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r["g"], r["item"], r["position"]) for r in top_n_per_group(spark.createDataFrame(rows, "g string, item string, s double"), "g", "s", "item", 25).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == brute_top(rows, 25)


def test_top_n_of_nothing(spark):
    assert top_n_per_group(spark.createDataFrame([], "g string, item string, s double"), "g", "s", "item").count() == 0


def brute_pairs(rows, least, share, lift):
    sets = defaultdict(set)
    for b, t in rows:
        if b is not None:
            sets[b]
            if t is not None:
                sets[b].add(t)
    s, n = len(sets), Counter(t for x in sets.values() for t in x)
    both = Counter(p for x in sets.values() for p in combinations(sorted(x), 2))
    return {(a, b, k) for (a, b), k in both.items() if k >= least and k >= share * s and k * s >= lift * n[a] * n[b]}


def test_pair_lift_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for b in range(900):
        topic = rnd.randrange(12)
        rows += [(f"b{b}", f"t{topic}-{rnd.randrange(3)}") for _ in range(3)] + [(f"b{b}", f"x{rnd.randrange(300)}") for _ in range(4)]
    rows += [("huge", f"x{k}") for k in range(300)] + [("huge", "x1")] * 5 + [(None, "x1"), ("empty", None)]
    df = spark.createDataFrame(rows, "basket string, item string").withColumn("n", F.lit(1))
    got = {(r["item_a"], r["item_b"], r["n_ab"]) for r in pair_lift(df, "basket", "item", 6, 0.005, 4.0).collect()}
    assert got == brute_pairs(rows, 6, 0.005, 4.0) and got


def test_pair_lift_of_nothing(spark):
    assert pair_lift(spark.createDataFrame([], "b string, i string"), "b", "i").count() == 0


def test_clean_tag(spark):
    rows = [(" #Foo ", "foo"), ("##a", "#a"), ("  ", None), ("#", None), (None, None), ("A b", "a b")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", clean_tag(F.col("t"))).collect())


def test_gram_passes_sums_on_without_losing_counts():
    rng = np.random.default_rng(1)
    rows = sorted({(f"b{k // 9:04d}", int(x)) for k, x in enumerate(rng.integers(0, 60, 27_000))})
    pdf = pd.DataFrame(rows, columns=["basket", "item"])
    want = Counter()
    for _, part in pdf.groupby("basket"):
        want.update(combinations(sorted(part["item"]), 2))
    for block, held in ((256, 256), (16, 2), (8, 1)):
        got = Counter()
        for out in _gram(iter([pdf[:5000], pdf[5000:5000], pdf[5000:]]), block, held):
            for x, y, n in zip(out["x"], out["y"], out["n"]):
                got[x, y] += n
        assert got == want
