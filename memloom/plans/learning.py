"""Learned edges: generation, decay, pruning, merging, session links."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from memloom.functions import scoring as S, vec as V
from memloom.operators import graph as G
from memloom.plans.base import ASSOC, EDGES, HIER, LEARNED, NODES, NOW_SQL, PAIRS, RESULTS, query, r6
from memloom.plans.graph import CHILD, node_vectors
from memloom.plans.retrieval import VECTORS, vectors
from memloom.plans.stats import DECAYED, decayed_edges, degrees
from memloom.sources import tables as T


@query("coactivation_pairs", f"with {PAIRS} select query_id, src, dst, round(product, 6) as product from pairs")
def coactivation_pairs(spark, d):
    return T.coactivation_pairs(spark, d).select("query_id", "src", "dst", r6("product").alias("product"))


@query("hebbian_edges", f"with {LEARNED} select space_id, src, dst, round(weight, 6) as weight, evidence, surprise from one")
def hebbian_edges(spark, d):
    return T.learned_edges(spark, d).where("src < dst").select("space_id", "src", "dst", r6("weight").alias("weight"), "evidence", "surprise")


@query(
    "code_coactivation",
    f"""with {RESULTS}, c as (select r.query_id, r.space_id, r.node_id, row_number() over (partition by r.query_id order by r.score desc nulls last, r.node_id) k from res r join (select distinct node_id from nodes where role_type = 'code') n using (node_id)),
p as (select a.space_id, least(a.node_id, b.node_id) src, greatest(a.node_id, b.node_id) dst, count(*) n from c a join c b on a.query_id = b.query_id and a.k < b.k where a.k <= 20 and b.k <= 20 group by 1, 2, 3)
select space_id, src, dst, n as times, round(least(1.0, 0.1 + 0.05 * (n - 1)), 6) as weight from p""",
)
def code_coactivation(spark, d):
    """The 20 best code results of a query strengthen each other: 0.1 at first, 0.05 more each time, up to 1."""
    code = T.table(spark, d, "nodes").where("role_type = 'code'").select("node_id").distinct()
    c = T.results(spark, d).join(code, "node_id", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "node_id"))).where("k <= 20")
    b = c.select("query_id", F.col("node_id").alias("other"), F.col("k").alias("j"))
    p = c.join(b, "query_id").where("k < j").groupBy("space_id", F.least("node_id", "other").alias("src"), F.greatest("node_id", "other").alias("dst")).agg(F.count("*").alias("times"))
    return p.withColumn("weight", r6(F.least(F.lit(1.0), 0.1 + 0.05 * (F.col("times") - 1))))


@query("prune_decayed", f"with {LEARNED}, {DECAYED} select src, dst, round(decayed, 6) as decayed from decw where decayed < 0.05")
def prune_decayed(spark, d):
    return decayed_edges(spark, d).where("decayed < 0.05").select("src", "dst", r6("decayed").alias("decayed"))


@query("prune_excess", f"with {LEARNED} select src, dst from (select *, row_number() over (partition by src order by round(weight, 9) desc, dst) r from learned) where r > 50")
def prune_excess(spark, d):
    w = Window.partitionBy("src").orderBy(F.round("weight", 9).desc(), "dst")
    return T.learned_edges(spark, d).withColumn("r", F.row_number().over(w)).where("r > 50").select("src", "dst")


@query(
    "offline_decay",
    f"""with {LEARNED}, x as (select src, dst, evidence, weight * exp(-0.01 * greatest(0.0, date_diff('microsecond', updated_at, {NOW_SQL}) / 86400000000.0)) nw, weight from one)
select src, dst, round(nw, 6) as new_weight, round((1 - nw / weight) * 100, 6) as decay_percent, case when nw <= 0 then 'prune' when nw >= 0.05 then 'keep' when evidence >= 3 then 'protected' else 'prune' end as action from x""",
)
def offline_decay(spark, d):
    """Exponential decay of every learned edge and what the job does with it."""
    e = T.learned_edges(spark, d).where("src < dst")
    e = e.withColumn("nw", S.exponential_decay(F.col("weight"), S.days_between(T.now(), F.col("updated_at")), 0.01))
    action = F.when(F.col("nw") <= 0, "prune").when(F.col("nw") >= 0.05, "keep").when(F.col("evidence") >= 3, "protected").otherwise("prune")
    return e.select("src", "dst", r6("nw").alias("new_weight"), r6((1 - F.col("nw") / F.col("weight")) * 100).alias("decay_percent"), action.alias("action"))


@query(
    "offline_prune",
    f"with {EDGES} select rel_type, case when weight <= 0 then 'prune' when weight >= 0.12 then 'keep' when evidence >= 3 then 'protected' when updated_at < {NOW_SQL} - interval 30 day then 'prune' else 'keep' end as action, count(*) as edges from edges_m group by 1, 2",
)
def offline_prune(spark, d):
    """Edges below the weight limit with little evidence, not touched for 30 days."""
    old = F.col("updated_at") < T.now() - F.expr("interval 30 days")
    action = F.when(F.col("weight") <= 0, "prune").when(F.col("weight") >= 0.12, "keep").when(F.col("evidence") >= 3, "protected").when(old, "prune").otherwise("keep")
    return T.edges(spark, d).groupBy("rel_type", action.alias("action")).agg(F.count("*").alias("edges"))


@query(
    "tombstone_nodes",
    f"""with {EDGES}, dg as (select node_id, count(*) degree from (select src node_id from edges_m union all select dst from edges_m) group by 1), ab as (select src node_id from hier where rel_type = 'ABSTRACTS_TO' union select dst from hier where rel_type = 'ABSTRACTS_TO'),
lo as (select node_id, max(created_at) last_obs from observations group by 1)
select n.node_id, case when ab.node_id is not null then 'abstraction_chain' when coalesce(degree, 0) > 1 then 'high_degree' when last_obs >= {NOW_SQL} - interval 90 day then 'recent_observation' else 'tombstone' end as verdict
from nodes_m n left join dg using (node_id) left join ab using (node_id) left join lo using (node_id)""",
)
def tombstone_nodes(spark, d):
    """Little connected, not observed for 90 days, in no abstraction chain."""
    e = T.edges(spark, d)
    chain = T.hierarchy_edges(spark, d).where("rel_type = 'ABSTRACTS_TO'").select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("chained", F.lit(True))
    last = T.table(spark, d, "observations").groupBy("node_id").agg(F.max("created_at").alias("last_obs"))
    n = T.nodes(spark, d).select("node_id").join(degrees(e), "node_id", "left").join(chain, "node_id", "left").join(last, "node_id", "left")
    verdict = F.when(F.col("chained"), "abstraction_chain").when(F.coalesce("degree", F.lit(0)) > 1, "high_degree").when(F.col("last_obs") >= T.now() - F.expr("interval 90 days"), "recent_observation").otherwise("tombstone")
    return n.select("node_id", verdict.alias("verdict"))


def crdt_merge(mine, theirs):
    """Order does not matter and nothing is lost: heaviest weight, summed evidence, largest dimensions; other types keep the heaviest weight only."""
    both = mine.unionByName(theirs)
    learned = F.col("rel_type") == "CO_ACTIVATED_WITH"
    return both.groupBy("src", "dst", "rel_type").agg(
        F.max("weight").alias("weight"), F.when(learned, F.sum("evidence")).otherwise(F.max("evidence")).alias("evidence"), F.max("dim_semantic").alias("dim_semantic"), F.max("dim_coactivation").alias("dim_coactivation"),
    )


@query(
    "crdt_edge_merge",
    f"""with {NODES}, {ASSOC}, {HIER}, {LEARNED}, b as (select src, dst, rel_type, weight, evidence, dim_semantic, dim_coactivation from one union all select src, dst, 'CO_ACTIVATED_WITH', dim_semantic, evidence, dim_semantic, dim_coactivation from assoc)
select src, dst, rel_type, round(max(weight), 6) as weight, sum(evidence)::bigint as evidence, round(max(dim_semantic), 6) as dim_semantic, max(dim_coactivation) as dim_coactivation from b group by 1, 2, 3""",
)
def crdt_edge_merge(spark, d):
    cols = ["src", "dst", "rel_type", "weight", "evidence", "dim_semantic", "dim_coactivation"]
    mine = T.learned_edges(spark, d).where("src < dst").select(cols)
    theirs = T.similar_edges(spark, d).withColumn("rel_type", F.lit("CO_ACTIVATED_WITH")).withColumn("weight", F.col("dim_semantic")).select(cols)
    m = crdt_merge(mine, theirs)
    return m.select("src", "dst", "rel_type", r6("weight").alias("weight"), "evidence", r6("dim_semantic").alias("dim_semantic"), "dim_coactivation")


@query(
    "session_coactivation",
    """with o as (select distinct obs_id, session_id, created_at, coalesce(surprise_score, 0) s from observations where session_id is not null and created_at is not null),
p as (select a.session_id, a.obs_id a, b.obs_id b, date_diff('microsecond', a.created_at, b.created_at) / 1000000.0 dt, greatest(a.s, b.s) s from o a join o b on a.session_id = b.session_id and (a.created_at < b.created_at or (a.created_at = b.created_at and a.obs_id < b.obs_id)))
select session_id, a, b, round(1.0 - dt / 3600.0 * 0.9, 6) as proximity, round(least(1.0, 0.99 * 0.1 * case when s >= 0.7 then 2.0 when s >= 0.4 then 1.5 else 1.0 end + 0.02 * (1.0 - dt / 3600.0 * 0.9)), 6) as weight from p where dt <= 3600""",
)
def session_coactivation(spark, d):
    """Pairs of one session less than an hour apart; all others of a session share the floor of 0.1 and are not written out.

    A range join over hour buckets: a session of any length compares neighbours in time only.
    """
    o = T.observations(spark, d, "session_id", "created_at", "surprise_score").where("session_id is not null and created_at is not null")
    o = o.select("session_id", "obs_id", F.unix_micros("created_at").alias("t"), F.coalesce("surprise_score", F.lit(0.0)).alias("s")).withColumn("h", F.floor(F.col("t") / 3_600_000_000))
    a = o.select("session_id", F.col("obs_id").alias("a"), F.col("t").alias("ta"), F.col("s").alias("sa"), F.explode(F.array("h", F.col("h") + 1)).alias("h"))
    b = o.select("session_id", F.col("obs_id").alias("b"), F.col("t").alias("tb"), F.col("s").alias("sb"), "h")
    p = a.join(b, ["session_id", "h"]).where("(ta < tb or (ta = tb and a < b)) and tb - ta <= 3600000000")
    near = 1.0 - (F.col("tb") - F.col("ta")) / 1_000_000.0 / 3600.0 * 0.9
    weight = S.hebbian(0.1 * S.surprise_factor(F.greatest("sa", "sb")), near, F.lit(1.0))
    return p.select("session_id", "a", "b", r6(near).alias("proximity"), r6(weight).alias("weight"))


@query(
    "associate_on_ingest",
    f"""with {VECTORS}, s as (select a.obs_id a, b.obs_id b, round(list_cosine_similarity(a.v, b.v), 6) sim from vecs a join vecs b on a.space_id = b.space_id and a.obs_id <> b.obs_id)
select a as src, b as dst, sim as dim_semantic, 0.5::double as weight from (select *, row_number() over (partition by a order by sim desc, b) r from s where sim >= 0.7) where r <= 5""",
)
def associate_on_ingest(spark, d):
    """Each observation is linked to its five nearest at 0.7 or more."""
    top = G.nearest(vectors(spark, d).withColumnRenamed("space_id", "grp"), 5, 0.7)
    return top.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("sim").alias("dim_semantic"), F.lit(0.5).alias("weight"))


@query(
    "refresh_stale_edges",
    f"with {CHILD}, {ASSOC} select e.src, e.dst, round(1 - list_cosine_similarity(a.v, b.v) / 2, 6) as stale_semantic, round(list_cosine_similarity(a.v, b.v), 6) as weight from assoc e join nv a on a.node_id = e.src join nv b on b.node_id = e.dst join nodes_m s on s.node_id = e.src where s.updated_at > e.updated_at",
)
def refresh_stale_edges(spark, d):
    """Links of nodes that changed since: both figures the refresh writes."""
    v = node_vectors(spark, d)
    changed = T.nodes(spark, d).select(F.col("node_id").alias("src"), F.col("updated_at").alias("changed"))
    e = T.similar_edges(spark, d).join(changed, "src").where("changed > updated_at").select("src", "dst")
    x = e.join(v.withColumnsRenamed({"node_id": "src", "vec": "va"}), "src").join(v.withColumnsRenamed({"node_id": "dst", "vec": "vb"}), "dst")
    cos = V.cosine(F.col("va"), F.col("vb"))
    return x.select("src", "dst", r6(1 - cos / 2).alias("stale_semantic"), r6(cos).alias("weight"))


@query(
    "orphans_by_ingest",
    f"with {NODES} select n.space_id, n.node_id, case when s.is_protected then 'protected' else 'orphan' end as state from nodes_m n join spaces s using (space_id) where n.updated_at < s.last_ingest_at and not n.is_archived",
)
def orphans_by_ingest(spark, d):
    s = T.table(spark, d, "spaces").select("space_id", "last_ingest_at", "is_protected")
    n = T.nodes(spark, d).where("not is_archived").join(s, "space_id").where("updated_at < last_ingest_at")
    return n.select("space_id", "node_id", F.when(F.col("is_protected"), "protected").otherwise("orphan").alias("state"))


@query(
    "archive_effects",
    f"with {EDGES}, ar as (select space_id, node_id from nodes_m where is_archived) select ar.space_id, count(distinct ar.node_id) as archived, count(e.src) as edges_out from ar left join edges_m e on e.src = ar.node_id group by 1",
)
def archive_effects(spark, d):
    """Archived nodes of each space and the edges that leave them."""
    ar = T.nodes(spark, d).where("is_archived").select("space_id", "node_id")
    e = T.edges(spark, d).select(F.col("src").alias("node_id"), "dst")
    return ar.join(e, "node_id", "left").groupBy("space_id").agg(F.count_distinct("node_id").alias("archived"), F.count("dst").alias("edges_out"))
