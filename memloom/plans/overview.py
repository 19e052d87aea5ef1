"""Queries made of other queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import vec as V
from memloom.operators import search
from memloom.operators.kmeans import kmeans
from memloom.plans import extras, memory, retrieval
from memloom.plans.base import LEARNED, NODES, ORACLES, PAIRS, query, r6
from memloom.plans.graph import CHILD, node_vectors
from memloom.sources import tables as T
from memloom.sources.shared import materialize


def _joined(*names: str) -> str:
    first, *rest = [f"({ORACLES[n]})" for n in names]
    return first + " a " + " ".join(f"join {x} x{i} using (obs_id)" for i, x in enumerate(rest))


@query("observation_quality")
def observation_quality(spark, d):
    """0.40 of specificity, 0.35 of actionability, 0.25 of context; low below 0.3, high above 0.7."""
    q = extras.specificity(spark, d).join(memory.actionability(spark, d), "obs_id")
    q = q.withColumn("q", F.round(0.40 * F.col("specificity") + 0.35 * F.col("actionability") + 0.25 * F.col("context_richness"), 9))
    return q.select("obs_id", r6("q").alias("quality"), F.when(F.col("q") < 0.3, "low").when(F.col("q") > 0.7, "high").otherwise("medium").alias("grade"))


ORACLES["observation_quality"] = (
    "select obs_id, round(q + 1e-9, 6) as quality, case when q < 0.3 then 'low' when q > 0.7 then 'high' else 'medium' end as grade from "
    f"(select obs_id, round(0.40 * specificity + 0.35 * actionability + 0.25 * context_richness, 9) q from {_joined('specificity', 'actionability')})"
)


@query(
    "concept_search",
    f"""with {CHILD}, qs as (select distinct obs_id, space_id, embedding::double[] v from observations where len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0 and space_id is not null and substr(obs_id, 2)::bigint % 100 = 0),
s as (select q.obs_id query_id, n.node_id, round(list_cosine_similarity(q.v, c.v), 6) sim from qs q join nodes_m n on n.space_id = q.space_id and n.layer >= 2 join nv c on c.node_id = n.node_id)
select query_id, node_id, sim, r as rank from (select *, row_number() over (partition by query_id order by sim desc, node_id) r from s where sim >= 0.5) where r <= 10""",
)
def concept_search(spark, d):
    """The ten concepts (layer 2 and above) nearest to every observation whose number is divisible by 100, from 0.5."""
    q = retrieval.vectors(spark, d).where(F.substring("id", 2, 20).cast("long") % 100 == 0)
    upper = T.nodes(spark, d).where("layer >= 2").select("space_id", "node_id")
    corpus = node_vectors(spark, d).join(upper, "node_id").select("space_id", F.col("node_id").alias("id"), "vec")
    return search.vector_top_k(q, corpus, 10, 0.5).withColumn("rank", F.col("rank").cast("long"))


@query(
    "learning_freeze",
    f"with {PAIRS} select s.space_id, coalesce(s.is_protected, false) as frozen, count(p.src) as pairs, case when coalesce(s.is_protected, false) then 0 else count(p.src) end as applied from spaces s left join pairs p using (space_id) group by 1, 2",
)
def learning_freeze(spark, d):
    """What learning would write per space; frozen (protected) spaces take nothing."""
    p = T.coactivation_pairs(spark, d).groupBy("space_id").agg(F.count("*").alias("n"))
    frozen, n = F.coalesce("is_protected", F.lit(False)), F.coalesce("n", F.lit(0))
    return T.table(spark, d, "spaces").join(p, "space_id", "left").select("space_id", frozen.alias("frozen"), n.alias("pairs"), F.when(frozen, F.lit(0)).otherwise(n).alias("applied"))


@query(
    "space_overview",
    f"""with {NODES}, {LEARNED}, n as (select space_id, count(*) c, max(layer) l from nodes_m group by 1), e as (select space_id, count(*) c from learned group by 1), q as (select space_id, count(distinct query_id) c, avg(avg_score) s from (select distinct query_id, space_id, avg_score from query_log) group by 1), f as (select space_id, count(distinct file_path) c from code_elements group by 1)
select s.space_id, coalesce(n.c, 0) as nodes, coalesce(n.l, 0) as top_layer, coalesce(e.c, 0) as learned_edges, coalesce(q.c, 0) as queries, round(coalesce(q.s, 0), 6) as mean_score, coalesce(f.c, 0) as files from spaces s left join n using (space_id) left join e using (space_id) left join q using (space_id) left join f using (space_id)""",
)
def space_overview(spark, d):
    """One row per space: nodes, layers, learned edges, queries and files."""
    n = T.nodes(spark, d).groupBy("space_id").agg(F.count("*").alias("nodes"), F.max("layer").alias("top_layer"))
    e = T.learned_edges(spark, d).groupBy("space_id").agg(F.count("*").alias("learned_edges"))
    q = T.table(spark, d, "query_log").select("query_id", "space_id", "avg_score").distinct().groupBy("space_id").agg(F.count_distinct("query_id").alias("queries"), F.avg("avg_score").alias("s"))
    f = T.table(spark, d, "code_elements").groupBy("space_id").agg(F.count_distinct("file_path").alias("files"))
    s = T.table(spark, d, "spaces").select("space_id")
    for side in (n, e, q, f):
        s = s.join(side, "space_id", "left")
    s = s.fillna(0)
    return s.select("space_id", "nodes", "top_layer", "learned_edges", "queries", r6("s").alias("mean_score"), "files")


@query(
    "kmeans_labels",
    f"""with recursive {CHILD}, p as (select n.space_id, c.node_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) u from nv c join nodes_m n using (node_id) where n.layer = 3),
c0 as (select space_id, min(node_id) node_id from p group by 1), s0 as (select c0.space_id, u from c0 join p using (space_id, node_id)),
c1 as (select space_id, node_id, u from (select p.*, row_number() over (partition by p.space_id order by round(list_dot_product(p.u, s.u), 9), p.node_id) r from p join s0 s using (space_id)) where r = 1)
select p.space_id, p.node_id, case when round(list_dot_product(p.u, b.u), 9) > round(list_dot_product(p.u, a.u), 9) then 1 else 0 end as side from p join s0 a using (space_id) join c1 b using (space_id)""",
)
def kmeans_labels(spark, d):
    """The farthest-first start of k-means with two centres: each top-layer node and the side it falls on."""
    n = T.nodes(spark, d).where("layer = 3").select("space_id", "node_id")
    p = node_vectors(spark, d).join(n, "node_id").select("space_id", "node_id", V.unit(F.col("vec")).alias("u"))
    a = p.groupBy("space_id").agg(F.min_by("u", "node_id").alias("a"))
    near = F.round(V.dot(F.col("u"), F.col("a")), 9)
    b = p.join(a, "space_id").groupBy("space_id").agg(F.min_by("u", F.struct(near, "node_id")).alias("b"))
    side = F.when(F.round(V.dot(F.col("u"), F.col("b")), 9) > near, 1).otherwise(0)
    return p.join(a, "space_id").join(b, "space_id").select("space_id", "node_id", side.alias("side"))


@query("kmeans_rounds")
def kmeans_rounds(spark, d, k: int = 2):
    """k-means of all vectors of each space, from the farthest-first start to rest."""
    v = materialize(retrieval.vectors(spark, d).select(F.col("space_id").alias("grp"), "id", "vec"), "kmeans")
    return kmeans(v, k).withColumnsRenamed({"grp": "space_id", "id": "obs_id"})
