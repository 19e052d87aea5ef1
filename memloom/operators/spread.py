"""Bounded expansion and spreading activation for many queries at once, as unrolled joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from memloom.functions import scoring as S

#: Attention by edge type.
ATTENTION = {"CO_ACTIVATED_WITH": 0.85, "ASSOCIATED_WITH": 0.65, "GENERALIZES": 0.65, "ABSTRACTS_TO": 0.60, "TEMPORALLY_ADJACENT": 0.45}
STRUCTURAL = ("ASSOCIATED_WITH", "GENERALIZES", "ABSTRACTS_TO")
LEARNED = ("CO_ACTIVATED_WITH",)
QUERIES = 64  # queries whose activation spreads in one task


def expand(seeds: DataFrame, edges: DataFrame, hops: tuple[tuple[str, ...], ...] = (STRUCTURAL, LEARNED), per_node: int = 50, total: int = 5000) -> DataFrame:
    """``(query_id, src, rel_type, dst, eff)``: edges found from the seeds, hop by hop, each edge once.

    ``seeds`` is (query_id, node_id), ``edges`` (src, dst, rel_type, weight, eff);
    each hop follows its own edge types, keeps the ``per_node`` heaviest edges of
    a frontier node and the ``total`` heaviest of a query.  A node is left once.
    If ``seeds`` has a column ``hops``, one value a query, a query goes no further.
    """
    most = "hops" if "hops" in seeds.columns else F.lit(len(hops)).alias("hops")
    frontier, seen, found = seeds.select("query_id", most, "node_id").distinct(), None, None
    for hop, kinds in enumerate(hops):
        out = frontier.where(F.col("hops") > hop).withColumnRenamed("node_id", "src").join(edges.where(F.col("rel_type").isin(*kinds)), "src")
        near = Window.partitionBy("query_id", "src").orderBy(F.desc("weight"), "dst", "rel_type")
        out = out.withColumn("r", F.row_number().over(near)).where(F.col("r") <= per_node)
        wide = Window.partitionBy("query_id").orderBy(F.desc("weight"), "src", "dst", "rel_type")
        out = out.withColumn("r", F.row_number().over(wide)).where(F.col("r") <= total).select("query_id", "hops", "src", "rel_type", "dst", "eff")
        found = out if found is None else found.unionByName(out)
        seen = frontier if seen is None else seen.unionByName(frontier)
        frontier = out.select("query_id", "hops", F.col("dst").alias("node_id")).distinct().join(seen, ["query_id", "node_id"], "left_anti")
    return found.drop("hops").distinct()


def activate(seeds: DataFrame, edges: DataFrame, steps: int = 2, decay: float = 0.15, attention: dict | None = None) -> DataFrame:
    """``(query_id, node_id, act)`` after ``steps`` rounds.

    ``seeds`` is (query_id, node_id, act), ``edges`` (query_id, src, dst,
    rel_type, eff).  Without ``attention`` only learned edges carry, each divided
    by the root of the node's learned in-degree; with it every type carries by
    its weight, divided by the root of the weights' sum (1 at least).
    ``CONTRADICTS`` edges are taken off, at nodes that something else reaches.
    """
    act = seeds.select("query_id", "node_id", S.clamp(F.col("act")).alias("act"))
    if attention is None:
        carrying = edges.where("rel_type = 'CO_ACTIVATED_WITH'").withColumn("w", F.lit(1.0))
    else:
        carrying = edges.where("rel_type <> 'CONTRADICTS'").withColumn("w", S.lookup(F.col("rel_type"), attention, 0.5)).where("w > 0.01")
    into = Window.partitionBy("query_id", "dst")
    carrying = carrying.select("query_id", "src", "dst", (F.col("eff") * F.col("w") / F.greatest(F.lit(1.0), F.sqrt(F.sum("w").over(into)))).alias("k"))
    reached = carrying.select("query_id", "dst").distinct()
    against = edges.where("rel_type = 'CONTRADICTS'").join(reached, ["query_id", "dst"], "left_semi").select("query_id", "src", "dst", (-F.abs("eff")).alias("k"))
    flows = carrying.unionByName(against)
    for _ in range(steps):
        kept = act.select("query_id", "node_id", S.clamp((1 - decay) * F.col("act")).alias("x"))
        sent = flows.join(act.withColumnRenamed("node_id", "src"), ["query_id", "src"]).select("query_id", F.col("dst").alias("node_id"), (F.col("act") * F.col("k")).alias("x"))
        act = kept.unionByName(sent).groupBy("query_id", "node_id").agg(S.clamp(F.round(F.sum("x"), 12)).alias("act"))
    return act


def _spread(steps: int, decay: float):
    """Activation of the queries of a tile: rows and edges as numbers, a round a sum by target."""

    def run(key, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        n, e = len(rows), len(edges)
        query = pd.factorize(pd.concat([rows["query_id"], edges["query_id"]]))[0]
        node = pd.factorize(pd.concat([rows["node_id"], edges["src"], edges["dst"]]))[0]
        most = int(node.max(initial=0)) + 1
        places, at = np.unique(np.concatenate([query[:n] * most + node[:n], query[n:] * most + node[n : n + e], query[n:] * most + node[n + e :]]), return_inverse=True)
        mine, src, dst = at[:n], at[n : n + e], at[n + e :]
        add = lambda where, what=None: np.bincount(where, what, len(places))
        weight = edges["w"].to_numpy(float)
        k = edges["eff"].to_numpy(float) * weight / np.maximum(1.0, np.sqrt(add(dst, weight)))[dst]
        first = ~rows.duplicated(["query_id", "fr"]).to_numpy()
        act = add(mine[first], np.clip(rows["sim"].to_numpy(float)[first], 0.0, 1.0))
        for _ in range(steps):
            act = np.clip(np.round((1 - decay) * act + add(dst, act[src] * k), 12), 0.0, 1.0)
        rows["act"], rows["deg"] = act[mine], (add(src) + add(dst))[mine]
        rows = rows[rows["layer"].notna()]
        return rows.assign(dup=np.minimum(3, rows.groupby(["query_id", "folder"], dropna=False, sort=False)["fr"].transform("size") - 1)).drop(columns=["tile", "folder"])

    return run


def activate_tiles(rows: DataFrame, edges: DataFrame, queries: int, steps: int = 2, decay: float = 0.15, attention: dict = ATTENTION, tile: int = QUERIES) -> DataFrame:
    """``rows`` with ``act`` as `activate` has it, ``deg``, a node's ends of edges, and ``dup``, up to 3 others of its folder.

    ``rows`` is (query_id, node_id, fr, sim, layer, folder, ...), ``edges`` (query_id,
    src, dst, rel_type, eff) without CONTRADICTS.  A candidate is a number ``fr`` of a
    query: rows that double one start it once.  Rows without a layer, which have no
    live node, start too but are not returned.  The ``queries``, about so many, are put
    together in tiles, each of which is one task: neither flows nor activations move
    between rounds.
    """
    own = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries // tile)))).cast("int").alias("tile")
    carrying = edges.select(own, "query_id", "src", "dst", "eff", S.lookup(F.col("rel_type"), attention, 0.5).alias("w"))
    left = rows.select(own, *rows.columns)
    kinds = [f"`{n}` {t}" for n, t in rows.dtypes if n != "folder"] + ["act double", "deg long", "dup int"]
    return left.groupBy("tile").cogroup(carrying.groupBy("tile")).applyInPandas(_spread(steps, decay), ", ".join(kinds))


def with_effect(edges: DataFrame, decayed_at: Column | None = None) -> DataFrame:
    """``eff``: decayed weight times the dimension mix; learned edges that decayed below 0.05 are dropped."""
    weight = F.col("weight")
    if decayed_at is not None:
        learned = S.evidence_decay(weight, S.days_between(decayed_at, F.col("updated_at")), F.col("evidence"), 0.005)
        weight = F.when(F.col("rel_type") == "CO_ACTIVATED_WITH", learned).otherwise(weight)
    out = edges.withColumn("weight", F.round(weight, 9)).where("rel_type <> 'CO_ACTIVATED_WITH' or weight >= 0.05")
    return out.withColumn("eff", S.effective_weight(F.col("weight"), F.col("dim_semantic"), F.col("dim_temporal"), F.col("dim_coactivation")))
