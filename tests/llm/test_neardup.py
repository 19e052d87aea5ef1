import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from memloom.llm.neardup import PAGE, _join_subtrees, _levels, _needed, near_duplicates, pairs_within


def texts(seed, n, vocabulary):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    rows = []
    for i in range(n):
        if i % 4 == 0 or not rows:
            t = [rnd.choice(words) for _ in range(rnd.randrange(4, 60))]
        else:
            t = rnd.choice(rows)[2].split()
            for _ in range(rnd.randrange(0, max(1, len(t) // 4) + 1)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            if rnd.random() < 0.3:
                rnd.shuffle(t)
        rows.append((f"s{rnd.randrange(3)}", f"o{i:05d}", " ".join(t)))
    return rows


def brute(rows, threshold, least):
    t = Fraction(str(threshold))
    once = {}
    for g, i, x in rows:
        if g is None or i is None or x is None:
            continue
        w = re.findall("[a-z0-9]+", x.lower())
        if len(w) >= least:
            once[i] = (g, frozenset(w))
    parent = {i: i for i in once}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(once)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            (ga, wa), (gb, wb) = once[a], once[b]
            if ga == gb and len(wa & wb) >= t * len(wa | wb):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in once:
        groups[find(i)].append(i)
    return {(i, min(m), len(m)) for m in groups.values() for i in m}


def check(spark, rows, threshold=0.7, tile=8192):
    df = spark.createDataFrame(rows, "grp string, id string, text string").withColumns({"cid": F.lit(1), "words": F.lit("x"), "size": F.lit(0)})
    found = near_duplicates(df, "grp", "id", "text", threshold, 8, tile)
    got = {(r["id"], r["cluster"], r["size"]) for r in found.collect()}
    assert got == brute(rows, threshold, 8)
    return found


def test_matches_brute_force(spark):
    rows = texts(1, 320, 400)
    long = " ".join(f"q{k}" for k in range(6000))
    rows += [("s0", "long1", long), ("s0", "long2", long + " extra"), ("s0", "null", None), ("s0", "empty", ""), ("s0", "few", "a b c"), (None, "nog", rows[0][2]), ("s0", None, rows[0][2]), ("s0", "sep", "A-b_c D,e f g h i j K")]
    rows += [("s1", "rep", "same same same same same same same same"), ("s1", "rep2", "same same same same same same same same same")] + rows[:30]
    found = check(spark, rows)
    groups = defaultdict(list)
    for i, c, _ in brute(rows, 0.7, 8):
        groups[c].append(i)
    want = {(a, b) for m in groups.values() for a in m for b in m if a < b}
    assert {(r["id_a"], r["id_b"]) for r in pairs_within(found, 4).collect()} == want


def test_hot_subtrees_are_cut_into_tiles(spark):
    # so few words that every subtree holds most records
    check(spark, texts(2, 240, 24), tile=16)


def test_other_threshold(spark):
    check(spark, texts(3, 200, 200), threshold=0.8)


def test_needed_is_the_least_overlap():
    for t in (Fraction(7, 10), Fraction(8, 10), Fraction(1)):
        for a in range(1, 40):
            for b in range(1, 40):
                o = int(_needed(np.array([a]), np.array([b]), t)[0])
                assert o >= t * (a + b - o) and (o - 1) < t * (a + b - o + 1)


def test_of_nothing(spark):
    found = near_duplicates(spark.createDataFrame([], "grp string, id string, text string"), "grp", "id", "text")
    assert found.count() == 0 and pairs_within(found).count() == 0


def test_meeting_in_one_group_is_not_enough(spark):
    rows = [("s", "a", "one b c d e f g h"), ("s", "b", "one i j k l m n o"), ("s", "c", "p q r s t u v w")]
    df = spark.createDataFrame(rows, "grp string, id string, text string")
    assert {r["size"] for r in near_duplicates(df, "grp", "id", "text").collect()} == {1}


def test_tree_of_boxes_loses_no_pair():
    rng = np.random.default_rng(4)
    t = Fraction("0.7")
    rows = []
    for run, (n, tiles) in enumerate([(1, 1), (700, 1), (900, 2), (2, 2), (40, 1)]):
        base = rng.integers(0, 3, (12, 128)).astype(np.uint8)
        for k in range(n):
            v = base[k % 12].copy()
            v[rng.integers(0, 128, rng.integers(0, 30))] = rng.integers(0, 3)
            own = int(rng.integers(0, tiles)) if n > 2 else 0
            rows.append(("a", run, 0, tiles - 1, own, run * 10_000 + k, v))
    pdf = pd.DataFrame([(g, r, lo, hi, own, cid, int(v.sum()), 0, (v[::2] | (v[1::2] << 4)).tobytes()) for g, r, lo, hi, own, cid, v in rows], columns=["grp", "g", "lo", "hi", "own", "cid", "size", "place", "point"])
    pdf["side"] = pdf["own"] != pdf["lo"]
    pdf = pdf.sort_values(["grp", "g", "lo", "hi", "side", "size", "point"]).drop(columns="side").reset_index(drop=True)
    got = {(a, b) for out in _join_subtrees(t)(iter([pdf])) for a, b in zip(out["a"], out["b"])}
    want = set()
    for _, part in pd.DataFrame(rows, columns=["grp", "g", "lo", "hi", "own", "cid", "v"]).groupby("g"):
        x, cid, own = np.stack(part["v"].to_numpy()).astype(int), part["cid"].to_numpy(), part["own"].to_numpy()
        size = x.sum(1)
        for i in range(len(x)):
            o = np.minimum(x[i], x).sum(1)
            ok = (o >= _needed(np.full(len(x), size[i]), size, t)) & (cid > cid[i])
            if part["lo"].iloc[0] != part["hi"].iloc[0]:
                ok &= own != own[i]
            want |= {(cid[i], c) for c in cid[ok]}
    assert got == want and len(want) > 1000
    levels = _levels(np.zeros(5000, int), np.zeros(5000, bool))
    assert [len(x) for x in levels] == [313, 20, 2, 1] and PAGE == 16
