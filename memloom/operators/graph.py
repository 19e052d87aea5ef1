"""Graph operators as joins: traversal with a visited set, triangles, similarity links, density clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from memloom.operators.components import connected_components
from memloom.sources.shared import materialize
from memloom.sources.small import join_small

TILE = 8192


def bfs(seeds: DataFrame, edges: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """``(root, node, distance)`` of all nodes within ``depth`` steps of each root, at their least distance.

    ``seeds`` is (root, node), ``edges`` (src, dst); rounds are unrolled, a node is
    entered once per root.  ``most`` keeps that many nodes per root, nearest and
    smallest first.
    """
    found = materialize(seeds.select("root", "node", F.lit(0).alias("distance")).distinct(), "bfs")
    edge = edges.select("src", "dst").distinct()
    frontier = found
    for d in range(1, depth + 1):
        if most is not None:  # what is farther than a root's ``most`` nearest can't be among them
            frontier = frontier.join(found.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("root"), "root", "left_anti")
        step = frontier.join(edge, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(found.select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(d)), "bfs")
        found = found.unionByName(frontier)
    if most is not None:
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("distance", "node"))).where(F.col("r") <= most).drop("r")
    return found


def triangles(edges: DataFrame) -> DataFrame:
    """``(a, b, c)`` with a < b < c, each undirected triangle once.

    Edges point from the end of lower degree to the other, so no node has more
    than the root of twice the edges as successors, and a hub makes few pairs.
    """
    one = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).where("x <> y").distinct()
    deg = one.select(F.explode(F.array("x", "y")).alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    dx, dy = deg.select(F.col("n").alias("x"), F.col("k").alias("kx")), deg.select(F.col("n").alias("y"), F.col("k").alias("ky"))
    low = (F.col("kx") < F.col("ky")) | ((F.col("kx") == F.col("ky")) & (F.col("x") < F.col("y")))
    out = one.join(dx, "x").join(dy, "y").select(F.when(low, F.col("x")).otherwise(F.col("y")).alias("u"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("v"))
    pair = out.join(out.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = pair.join(one.select(F.col("x").alias("v"), F.col("y").alias("w")), ["v", "w"])
    three = closed.select(F.array_sort(F.array("u", "v", "w")).alias("t"))
    return three.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def _tiles(vectors: DataFrame, tile: int) -> tuple[DataFrame, list[str]]:
    """Rows of (grp, id, vec, ...) once for each pair of tiles of their group; groups up to ``tile`` rows are one tile."""
    large = vectors.groupBy("grp").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).where("tiles > 1")
    own = join_small(vectors, large, "grp").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    keys = ["grp", "lo", "hi"]
    return both.drop("tiles", "other").repartition(4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys), keys


def _blocks(pdf: pd.DataFrame, least: float):
    """(rows of side lo, rows of side hi, products) in blocks of rows; products below ``least`` and doubled ones are -2."""
    lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    pdf = pdf.sort_values("id")
    a, b = pdf[pdf["own"] == lo], pdf[pdf["own"] == hi]
    if not len(a) or not len(b):
        return
    unit = lambda p: (lambda x: x / np.sqrt((x * x).sum(1))[:, None])(np.stack(p["vec"].to_numpy()).astype(np.float64))
    ua, ub = unit(a), unit(b)
    for i in range(0, len(ua), 512):
        s = np.round(ua[i : i + 512] @ ub.T + 1e-9, 6)
        if lo == hi:
            s[np.arange(s.shape[1])[None, :] <= np.arange(i, i + len(s))[:, None]] = -2
        s[s < least] = -2
        yield a.iloc[i : i + 512], b, s


def similar_pairs(vectors: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """``(grp, a, b, sim)`` with a < b of one group at a cosine of ``least`` or more (six decimals).

    ``vectors`` is (grp, id, vec), of one length.  Groups of more than ``tile``
    rows are cut into tiles, joined in pairs by different tasks; the result holds
    every such pair, so it is for limits that few pairs reach.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"grp": [], "a": [], "b": [], "sim": []}, dtype=object)]
        for a, b, s in _blocks(pdf, least):
            r, c = np.nonzero(s > -2)
            x, y = a["id"].to_numpy()[r], b["id"].to_numpy()[c]
            out.append(pd.DataFrame({"grp": pdf["grp"].iloc[0], "a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "sim": s[r, c]}))
        return pd.concat([x for x in out if len(x)] or out[:1], ignore_index=True)

    spread, keys = _tiles(vectors.select("grp", "id", "vec"), tile)
    return spread.groupBy(*keys).applyInPandas(run, f"grp {dict(vectors.dtypes)['grp']}, a string, b string, sim double")


def nearest(vectors: DataFrame, k: int, least: float, tile: int = TILE) -> DataFrame:
    """``(id, other, sim, rank)``: the ``k`` nearest others of the group at ``least`` or more, ties by id.

    A pair of tiles passes on ``k`` rows per vector at most, however dense the group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best: dict = {}
        for a, b, s in _blocks(pdf, least):
            ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
            for own, other, m in ((ia, ib, s), (ib, ia, s.T)):
                # Ids are in order, so a stable sort breaks ties by id.
                top = np.argsort(-m, axis=1, kind="stable")[:, :k]
                sim = np.take_along_axis(m, top, 1)
                for n in np.flatnonzero(sim[:, 0] > -2):
                    rows = best.setdefault(own[n], [])
                    rows += [(-v, other[t]) for v, t in zip(sim[n], top[n]) if v > -2]
                    if len(rows) > 8 * k:
                        best[own[n]] = sorted(rows)[:k]
        rows = [(i, o, -v) for i, x in best.items() for v, o in sorted(x)[:k]]
        return pd.DataFrame(rows, columns=["id", "other", "sim"])

    spread, keys = _tiles(vectors.select("grp", "id", "vec"), tile)
    offers = spread.groupBy(*keys).applyInPandas(run, "id string, other string, sim double")
    return offers.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))).where(F.col("rank") <= k)


def dbscan(vectors: DataFrame, eps: float = 0.1, min_samples: int = 3, tile: int = TILE) -> DataFrame:
    """``(grp, id, cluster)``: density clusters by cosine distance, named by their smallest core point; noise is null.

    A point is core with ``min_samples`` *other* points within ``eps``; border
    points join the neighbouring cluster of smallest name.  Two passes over the
    tiles, one that counts neighbours and one that ties core points: each passes
    on a row per point and tile pair, never a row per neighbour.
    """
    least = round(1 - eps, 9)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict = {}
        for a, b, s in _blocks(pdf, least):
            near = s > -2
            for ids, n in ((a["id"], near.sum(1)), (b["id"], near.sum(0))):
                for i, k in zip(ids.to_numpy()[n > 0], n[n > 0]):
                    total[i] = total.get(i, 0) + int(k)
        return pd.DataFrame({"id": list(total), "n": list(total.values())}, dtype=None if total else object)

    def tie(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        touched: dict = {}
        for a, b, s in _blocks(pdf, least):
            ia, ib, ca, cb = a["id"].to_numpy(), b["id"].to_numpy(), a["core"].to_numpy(), b["core"].to_numpy()
            near = s > -2
            for n in np.flatnonzero(near.any(1)):
                at = np.flatnonzero(near[n])
                cores = ib[at[cb[at]]]
                if ca[n]:
                    for other in cores:
                        x, y = find(ia[n]), find(other)
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                    for other in ib[at[~cb[at]]]:
                        touched.setdefault(other, set()).add(ia[n])
                elif len(cores):
                    touched.setdefault(ia[n], set()).update(cores)
            # A border point needs one core point of each cluster beside it.
            touched = {p: {find(x) for x in c} for p, c in touched.items()}
        rows = [(x, find(x), True) for x in parent if find(x) != x] + [(p, c, False) for p, cs in touched.items() for c in {find(x) for x in cs}]
        return pd.DataFrame(rows, columns=["src", "dst", "inner"])

    spread, keys = _tiles(vectors.select("grp", "id", "vec"), tile)
    core = spread.groupBy(*keys).applyInPandas(count, "id string, n long").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id")
    core = materialize(core, "core")
    marked, keys = _tiles(vectors.select("grp", "id", "vec").join(core.withColumn("core", F.lit(True)), "id", "left").fillna({"core": False}), tile)
    ties = materialize(marked.groupBy(*keys).applyInPandas(tie, "src string, dst string, inner boolean"), "ties")
    named = core.join(connected_components(ties.where("inner")).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    border = ties.where("not inner").join(named.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("cluster").alias("cluster"))
    return vectors.select("grp", "id").join(named.unionByName(border), "id", "left").select("grp", "id", "cluster")


def split_clusters(members: DataFrame, most: int = 200, depth: int = 2, least: int = 3) -> DataFrame:
    """``members`` (cluster, id, path, ...) with ``prefix`` and ``hidden_id``: clusters up to ``most`` stay whole.

    Larger ones are parted by the first ``depth`` segments of the path, then cut
    in runs of ``most`` by id; parts below ``least`` make no node.  A null or
    empty path is ``_unknown_``, and a path ends at #.
    """
    parts = F.filter(F.split(F.regexp_replace("path", "#.*$", ""), "/"), lambda x: x != "")
    prefix = F.when(F.coalesce("path", F.lit("")) == "", "_unknown_").when(F.size(parts) <= depth, F.col("path")).otherwise(F.array_join(F.slice(parts, 1, depth), "/"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    m = members.withColumn("prefix", prefix).join(sizes, "cluster")
    run = F.floor((F.row_number().over(Window.partitionBy("cluster", "prefix").orderBy("id")) - 1) / most)
    large = m.where(F.col("size") > most).withColumn("hidden_id", F.concat_ws("#", "cluster", "prefix", run.cast("string")))
    whole = m.where(F.col("size") <= most).withColumn("hidden_id", F.col("cluster").cast("string"))
    both = whole.unionByName(large).drop("size")
    kept = both.groupBy("hidden_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("hidden_id")
    return both.join(kept, "hidden_id", "left_semi")


def mean_vectors(rows: DataFrame, key, vector: str = "vec", weight=None) -> DataFrame:
    """Element-wise (weighted) mean by key, summed per position so that any group is added in parallel."""
    keys = [key] if isinstance(key, str) else list(key)
    w = F.lit(1.0) if weight is None else weight
    cells = rows.select(*keys, w.alias("w"), F.posexplode(vector).alias("pos", "x"))
    sums = cells.groupBy(*keys, "pos").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("x"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
