"""Clusters of mutually similar vectors: distributed bisecting k-means, closed over links.

Method: every group starts as one node.  Nodes above ``NODE`` rows are split in
two across the cluster, with centres fitted on a bounded sample of the node;
below that a node fits one task, which goes on splitting its part of largest
dispersion until each leaf is compact or small.  A compact leaf has an angular
radius of at most half the link angle, so by the triangle inequality all its
members are linked and it acts as one unit.  The nodes are the tiles of what is
left to compare: pairs of nodes whose centres and radii rule a link out are
dropped before anything is shipped, and so are blocks of members within a pair.
Exact products of the rest join units that touch; the components of units are
the clusters.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from memloom.llm.vectors import BLOCK, spread, vector_classes
from memloom.llm.workers import batched, grouped
from memloom.operators.components import connected_components
from memloom.sources.shared import materialize
from memloom.sources.small import join_small

NODE = 16384  # rows of a node that one task splits on
SAMPLE = 2048  # rows the two centres of a larger node are fitted on; every row is then assigned
SMALL = 48  # a leaf this small is not split further; its members are compared one by one
SIDE = 0.1  # share of a node's sample that each side of a cluster-wide split gets at least, so that splitting ends


def _units(rows: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def two_means(u: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Two spherical centres: started from the row farthest from the mean and the row farthest from that one."""
    far = int(np.argmin(u @ u.mean(0)))
    c = np.stack([u[far], u[int(np.argmin(u @ u[far]))]])
    side = None
    for _ in range(rounds):
        s = u @ c.T
        new = s[:, 1] > s[:, 0]
        if side is not None and (new == side).all():
            break
        side = new
        for k in (0, 1):
            m = u[side == k].sum(0)
            n = np.sqrt(m @ m)
            if n > 1e-12:
                c[k] = m / n
    return c


def bisect(u: np.ndarray, radius: float, small: int = SMALL) -> list[tuple[np.ndarray, bool]]:
    """``(row numbers, compact)`` of the leaves; the node of largest dispersion is split first."""
    near, done, heap, tick = math.cos(radius), [], [], 0

    def put(rows: np.ndarray) -> None:
        nonlocal tick
        mean = u[rows].sum(0)
        length = np.sqrt(mean @ mean)
        if length > 1e-12 and (u[rows] @ (mean / length)).min() >= near + 1e-9:
            done.append((rows, True))
        elif len(rows) <= small:
            done.append((rows, False))
        else:
            # n - |sum| is the summed distance to the centre on the sphere.
            heapq.heappush(heap, (-(len(rows) - length), tick, rows))
            tick += 1

    put(np.arange(len(u)))
    while heap:
        _, _, rows = heapq.heappop(heap)
        part = u[rows]
        s = part @ two_means(part).T
        right = s[:, 1] > s[:, 0]
        if right.all() or not right.any():  # no two directions left to tell apart
            right = np.arange(len(rows)) % 2 == 0
        put(rows[right])
        put(rows[~right])
    return done


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """The two centres of a node and where between them it is cut; no centres where its rows have but one direction."""
    u = _units(pdf["raw"])
    c = two_means(u).astype(np.float32).astype(np.float64)
    away = u @ c[1] - u @ c[0]
    at = 0.0
    if not SIDE <= (away > 0).mean() <= 1 - SIDE:
        at = float(np.median(away))
    if not SIDE <= (away > at).mean() <= 1 - SIDE:
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "c0": [None], "c1": [None], "at": [0.0]})
    return pd.DataFrame({"node": [pdf["node"].iloc[0]], "c0": [c[0].astype(np.float32).tobytes()], "c1": [c[1].astype(np.float32).tobytes()], "at": [at]})


def _assign(it):
    for pdf in it:
        if not len(pdf):
            continue
        side, has = pdf["coin"].to_numpy() > 0, pdf["c0"].notna().to_numpy()
        if has.any():
            part = pdf[has]
            u = _units(part["raw"])
            c0, c1 = (np.frombuffer(b"".join(part[k]), np.float32).reshape(len(part), -1).astype(np.float64) for k in ("c0", "c1"))
            side[has] = (u * c1).sum(1) - (u * c0).sum(1) > part["at"].to_numpy()
        pdf["node"] = pdf["node"] + np.where(side, "1", "0")
        yield pdf[["grp", "cls", "raw", "head", "node"]]


def _leaves(radius: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u = _units(pdf["raw"])
        heads = pdf["head"].to_numpy()
        leaf, unit = np.empty(len(pdf), object), heads.copy()
        for rows, compact in bisect(u, radius):
            first = heads[rows].min()
            leaf[rows] = first
            if compact:
                unit[rows] = first
        # Centre and radius of the node stand in its first row.
        m = u.sum(0)
        m /= max(np.sqrt(m @ m), 1e-12)
        centre = np.full(len(pdf), None, object)
        centre[0] = m.tobytes()
        reach = np.full(len(pdf), math.acos(min(1.0, max(-1.0, float((u @ m).min())))) + 1e-9)
        return pd.DataFrame({"grp": pdf["grp"], "cls": pdf["cls"], "raw": pdf["raw"], "head": heads, "node": pdf["node"], "leaf": leaf, "unit": unit, "centre": centre, "reach": reach})

    return run


def bisecting_leaves(classes: DataFrame, radius: float, node: int = NODE) -> DataFrame:
    """(grp, cls, raw, head, node, leaf, unit, centre, reach) of every vector class; a unit is a compact leaf or a single class."""
    schema = "grp string, cls binary, raw binary, head string, node string"
    rows = classes.select("grp", "cls", "raw", "head", F.concat("grp", F.lit("/")).alias("node"))
    small = None
    while True:
        # At most rows / node nodes are that large, and a sample of each goes to a task of its own.
        large = materialize(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > node), "large")
        done = join_small(rows, large, "node", "left_anti")
        small = done if small is None else small.unionByName(done)
        if not large.limit(1).count():
            break
        # Only the rows of nodes that are still too large are written again.
        marked = join_small(rows, large, "node", "inner")
        sample = marked.where(F.pmod(F.xxhash64("cls", F.lit(7)), F.col("n")) < 2 * SAMPLE)
        drawn = sample.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("cls"))).where(F.col("r") <= SAMPLE)
        centres = materialize(drawn.groupBy("node").applyInPandas(grouped(_fit), "node string, c0 binary, c1 binary, at double"), "centres")
        coined = marked.drop("n").withColumn("coin", F.pmod(F.xxhash64("cls", "node"), F.lit(2)).cast("int"))
        rows = materialize(join_small(coined, centres, "node").mapInPandas(batched(_assign), schema), "nodes")
    return spread(small, "node").groupBy("node").applyInPandas(
        grouped(_leaves(radius)), "grp string, cls binary, raw binary, head string, node string, leaf string, unit string, centre binary, reach double"
    )


def node_pairs(leaves: DataFrame, least: float) -> DataFrame:
    """(pair, grp, lo, hi): the pairs of nodes of a group, a node with itself among them, between which centres and radii leave room for a link."""
    nodes = materialize(leaves.where("centre is not null").select("grp", "node", "centre", "reach"), "tree")
    angle = math.acos(least) + 1e-6

    def near(it):
        for pdf in it:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[k]), np.float64).reshape(len(pdf), -1) for k in ("centre", "other"))
                apart = np.arccos(np.clip((a * b).sum(1), -1, 1)) - pdf["reach"] - pdf["far"]
                yield pdf.loc[(apart <= angle) | (pdf["lo"] == pdf["hi"]), ["grp", "lo", "hi"]]

    other = nodes.select("grp", F.col("node").alias("hi"), F.col("centre").alias("other"), F.col("reach").alias("far"))
    pairs = nodes.withColumnRenamed("node", "lo").join(other, "grp").where("lo <= hi").mapInPandas(near, "grp string, lo string, hi string")
    return materialize(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")


def _touching(least: float):
    angle = math.acos(least) + 1e-6

    def blocks(u: np.ndarray):
        for i in range(0, len(u), BLOCK):
            part = u[i : i + BLOCK]
            m = part.sum(0)
            m /= max(np.sqrt(m @ m), 1e-12)
            yield i, part, m, math.acos(min(1.0, max(-1.0, float((part @ m).min()))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        pdf = pdf.sort_values(["leaf", "unit"])
        a, b = pdf[pdf["node"] == lo], pdf[pdf["node"] == hi]
        if not len(a) or not len(b):
            return pd.DataFrame({"src": [], "dst": []}, dtype=object)
        ua, ub = _units(a["raw"]), _units(b["raw"])
        fa, fb = ua.astype(np.float32), ub.astype(np.float32)
        names = pd.unique(pdf["unit"])
        at = {n: i for i, n in enumerate(names)}
        na, nb = np.array([at[x] for x in a["unit"]]), np.array([at[x] for x in b["unit"]])
        parent = np.arange(len(names))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        right = [(i, m, r, slice(i, i + BLOCK)) for i, _, m, r in blocks(ub)]
        for i, part, m, r in blocks(ua):
            for j, w, q, on in right:
                if (lo == hi and j < i) or math.acos(min(1.0, max(-1.0, float(m @ w)))) - r - q > angle:
                    continue
                s = fa[i : i + BLOCK] @ fb[on].T
                # One mark per pair of units, not per pair of rows.
                ca, cb = na[i : i + len(part)], nb[on]
                sa, sb = np.flatnonzero(np.r_[True, ca[1:] != ca[:-1]]), np.flatnonzero(np.r_[True, cb[1:] != cb[:-1]])
                if not (s >= least - 1e-5).any():
                    continue
                top = np.maximum.reduceat(np.maximum.reduceat(s, sa, 0), sb, 1)
                for x, y in zip(*np.nonzero(top >= least - 1e-5)):
                    p, t = find(ca[sa[x]]), find(cb[sb[y]])
                    if p == t:
                        continue
                    if top[x, y] < least + 1e-5:
                        # So close to the limit that only the rounded double counts.
                        ea, eb = slice(i + sa[x], i + (sa[x + 1] if x + 1 < len(sa) else len(ca))), slice(j + sb[y], j + (sb[y + 1] if y + 1 < len(sb) else len(cb)))
                        if not (np.round(ua[ea] @ ub[eb].T, 6) >= least).any():
                            continue
                    parent[max(p, t)] = min(p, t)
        root = np.array([find(x) for x in range(len(names))])
        tied = root != np.arange(len(names))
        return pd.DataFrame({"src": names[tied], "dst": names[root[tied]]})

    return run


def similarity_clusters(df: DataFrame, group, item: str, vector: str, least: float = 0.8, smallest: int = 8, dim: int = 64, node: int = NODE) -> DataFrame:
    """``(grp, id, cluster, size)`` of the members of clusters with ``smallest`` members or more.

    Two vectors of a group are linked at a cosine (double precision, six
    decimals) of ``least`` or more; clusters are closed over links and named by
    their smallest id.  Unusable vectors (null, of another length, all zero, with
    null or infinite numbers) and null groups belong to none; repeated ids count
    once; equal vectors are linked.  A group may be of any size.
    """
    members, classes = vector_classes(df, group, item, vector, dim, 1)
    members, classes = materialize(members, "members"), materialize(classes, "classes")
    leaves = materialize(bisecting_leaves(classes, math.acos(least) / 2, node), "leaves")
    pairs = node_pairs(leaves, least)
    ends = pairs.select("pair", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("node"))
    placed = leaves.select("node", "raw", "leaf", "unit").join(ends, "node")
    links = spread(placed, "pair").groupBy("pair").applyInPandas(grouped(_touching(least)), "src string, dst string")
    components = connected_components(links)
    named = leaves.select("cls", "unit").join(components.withColumnRenamed("node", "unit"), "unit", "left").select("cls", F.coalesce("component", "unit").alias("c"))
    placed = members.join(named, "cls")
    counts = placed.groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("cluster")).where(F.col("size") >= smallest)
    return placed.join(counts, "c").select("grp", "id", "cluster", "size")


def _sums(it):
    total: dict = {}
    for pdf in it:
        if not len(pdf):
            continue
        u = _units(pdf["raw"])
        code, names = pd.factorize(pdf["cluster"])
        part = np.zeros((len(names), u.shape[1]))
        np.add.at(part, code, u)
        for name, row in zip(names, part):
            old = total.get(name)
            total[name] = row if old is None else old + row
        if len(total) > 4096:
            yield pd.DataFrame({"cluster": list(total), "part": list(total.values())})
            total = {}
    if total:
        yield pd.DataFrame({"cluster": list(total), "part": list(total.values())})


def describe_clusters(clusters: DataFrame, df: DataFrame, item: str, vector: str, typical: int = 3, dim: int = 64) -> DataFrame:
    """``(grp, cluster, size, typical)``: each cluster's size and the members nearest to its centre.

    The centre is the mean of the members' unit vectors; nearness is rounded to
    six decimals and ties go to the smaller id.
    """
    members, classes = vector_classes(df, F.lit(""), item, vector, dim, 1)
    rows = clusters.join(members.select("id", "cls"), "id").join(classes.select("cls", "raw"), "cls").select("grp", "cluster", "size", "id", "raw")
    rows = materialize(rows, "clustered")
    parts = rows.mapInPandas(batched(_sums), "cluster string, part array<double>")
    centres = parts.select("cluster", F.posexplode("part").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x")).groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre")
    )

    def near(it):
        for pdf in it:
            if len(pdf):
                c = np.stack(pdf["centre"].to_numpy())
                c /= np.maximum(np.sqrt((c * c).sum(1)), 1e-12)[:, None]
                yield pd.DataFrame({"grp": pdf["grp"], "cluster": pdf["cluster"], "size": pdf["size"], "id": pdf["id"], "near": np.round((_units(pdf["raw"]) * c).sum(1), 6)})

    scored = rows.join(centres, "cluster").mapInPandas(near, "grp string, cluster string, size long, id string, near double")
    first = scored.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("near"), "id"))).where(F.col("r") <= typical)
    return first.groupBy("grp", "cluster", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("typical"))
