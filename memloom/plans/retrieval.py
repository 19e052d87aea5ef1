"""Retrieval: vector and text search, fusion, expansion, activation, scoring, confidence."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from memloom.functions import scoring as S, vec as V
from memloom.operators import search, spread
from memloom.plans.base import EDGES, NODES, NOW_SQL, RESULTS, query, r6
from memloom.sources import tables as T
from memloom.sources.shared import materialize

VECTORS = """vecs as (select distinct obs_id, space_id, embedding::double[] v from observations where len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0 and space_id is not null)"""


def vectors(spark, d):
    return T.observations(spark, d, "space_id", "embedding").where(V.usable(F.col("embedding")) & F.col("space_id").isNotNull()).select("space_id", F.col("obs_id").alias("id"), F.col("embedding").alias("vec"))


@query(
    "vector_topk",
    f"""with {VECTORS}, s as (select q.obs_id query_id, c.obs_id node_id, round(list_cosine_similarity(q.v, c.v), 6) + 0 sim from vecs q join vecs c on q.space_id = c.space_id and q.obs_id <> c.obs_id where substr(q.obs_id, 2)::bigint % 100 = 0)
select query_id, node_id, sim, r as rank from (select *, row_number() over (partition by query_id order by sim desc, node_id) r from s) where r <= 20""",
)
def vector_topk(spark, d):
    """The 20 nearest of every observation whose number is divisible by 100, against all of its space."""
    v = vectors(spark, d)
    q = v.where(F.substring("id", 2, 20).cast("long") % 100 == 0)
    return search.vector_top_k(q, v, 20).withColumn("rank", F.col("rank").cast("long"))


@query(
    "bm25_topk",
    f"""with {NODES}, q as (select distinct query_id, space_id, query_text from query_log), docs as (select space_id, node_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, path, summary)), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') t from nodes_m),
st as (select space_id, count(*) n, avg(len(t)) al from docs group by 1), asked as (select distinct query_id, space_id, unnest(list_filter(regexp_split_to_array(lower(query_text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) term from q),
post as (select space_id, node_id, len(t) l, unnest(t) term from docs), tf as (select space_id, node_id, l, term, count(*) tf from post group by all), df as (select space_id, term, count(*) df from tf group by all),
sc as (select query_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / al))), 6) + 0 score from asked join tf using (space_id, term) join df using (space_id, term) join st using (space_id) group by all)
select query_id, node_id, score, r as rank from (select *, row_number() over (partition by query_id order by score desc, node_id) r from sc) where r <= 100""",
)
def bm25_topk(spark, d):
    q = T.table(spark, d, "query_log").select("space_id", "query_id", F.col("query_text").alias("text")).distinct()
    docs = T.nodes(spark, d).select("space_id", "node_id", F.concat_ws(" ", "name", "path", "summary").alias("text"))
    top = search.bm25_top_k(q, docs)
    return top.select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))


FUSE = f"""{RESULTS},
vl as (select * from (select *, row_number() over (partition by query_id order by round(vector_sim, 9) desc, node_id) vr from res where vector_sim is not null) where vr <= 200),
tl as (select query_id, node_id, s, row_number() over (partition by query_id order by s desc, node_id) tr from (select query_id, node_id, max(score) s from bm25_results where score is not null and not isnan(score) and node_id is not null group by 1, 2)),
tk as (select * from tl where tr <= 100),
fz as (select coalesce(vl.query_id, tk.query_id) query_id, coalesce(vl.node_id, tk.node_id) node_id, vl.vector_sim, vr, tr,
  coalesce(0.7 / (60 + vr), 0) + coalesce(0.3 / (60 + tr), 0) rrf from vl full outer join tk on vl.query_id = tk.query_id and vl.node_id = tk.node_id),
fu as (select *, case when vr is not null and tr is not null then least(1.0, vector_sim + 0.05) when vr is not null then vector_sim else greatest(0.4, 0.95 - 0.02 * (tr - 1)) end sim,
  row_number() over (partition by query_id order by round(rrf, 12) desc, node_id) fr from fz)"""


def fused(spark, d):
    """The 200 vector and 100 text candidates of every query with both ranks, the fused rank and the similarity each counts as.

    Both limits are applied before the shuffle too, so a query with very many results sends a few hundred rows a task.
    """
    w = Window.partitionBy("query_id")
    v = T.results(spark, d).where("vector_sim is not null").withColumn("vr", F.row_number().over(w.orderBy(F.round("vector_sim", 9).desc(), "node_id"))).where("vr <= 200").select("query_id", "node_id", "vector_sim", "vr")
    t = T.table(spark, d, "bm25_results").where("score is not null and not isnan(score) and node_id is not null").groupBy("query_id", "node_id").agg(F.max("score").alias("s"))
    t = t.withColumn("tr", F.row_number().over(w.orderBy(F.desc("s"), "node_id"))).where("tr <= 100").select("query_id", "node_id", "tr")
    both = v.join(t, ["query_id", "node_id"], "full_outer")
    rrf = F.coalesce(0.7 / (60 + F.col("vr")), F.lit(0.0)) + F.coalesce(0.3 / (60 + F.col("tr")), F.lit(0.0))
    sim = S.fused_similarity(F.col("vector_sim"), F.col("vr").isNotNull(), F.col("tr").isNotNull(), F.col("tr"))
    return both.withColumn("rrf", rrf).withColumn("sim", sim).withColumn("fr", F.row_number().over(w.orderBy(F.round("rrf", 12).desc(), "node_id")))


@query("rrf_fusion", f"with {FUSE} select query_id, node_id, vr as vector_rank, tr as text_rank, fr as fused_rank, round(rrf, 9) as rrf, round(sim, 6) as sim from fu")
def rrf_fusion(spark, d):
    lng = lambda c: F.col(c).cast("long")
    return fused(spark, d).select("query_id", "node_id", lng("vr").alias("vector_rank"), lng("tr").alias("text_rank"), lng("fr").alias("fused_rank"), F.round("rrf", 9).alias("rrf"), r6("sim").alias("sim"))


CONF = """round(case when n = 1 then 100.0 else round(100.0 * (n - 1 - (r - 1)) / (n - 1) + 1e-9, 1) end, 1)"""


def confidence(df, group, order):
    """Percentile rank within the group and its level; ties are broken by the order given."""
    w = Window.partitionBy(group)
    r, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    with_p = df.withColumn("rank", r).withColumn("n", n)
    pct = F.when(F.col("n") == 1, 100.0).otherwise(F.round(100.0 * (F.col("n") - F.col("rank")) / (F.col("n") - 1) + 1e-9, 1))
    return with_p.withColumn("percentile", pct).withColumn("level", F.when(pct >= 90, "HIGH").when(pct >= 40, "MEDIUM").otherwise("LOW"))


@query(
    "percentile_confidence",
    f"with {RESULTS}, k as (select query_id, node_id, score, row_number() over (partition by query_id order by score desc, node_id) r, count(*) over (partition by query_id) n from res where score is not null), p as (select *, {CONF} pct from k) select query_id, node_id, r as rank, pct as percentile, case when pct >= 90 then 'HIGH' when pct >= 40 then 'MEDIUM' else 'LOW' end as level from p",
)
def percentile_confidence(spark, d):
    ok = T.results(spark, d).where("score is not null")
    return confidence(ok, "query_id", [F.desc("score"), "node_id"]).select("query_id", "node_id", F.col("rank").cast("long").alias("rank"), "percentile", "level")


@query("temporal_filter", f"with {NODES} select space_id, node_id from nodes_m where at_ >= timestamp '2025-03-01' and at_ < timestamp '2025-06-01'")
def temporal_filter(spark, d):
    """``[after, before)`` on the content time, else the system time."""
    return T.nodes(spark, d).where("at >= timestamp '2025-03-01' and at < timestamp '2025-06-01'").select("space_id", "node_id")


@query("extension_filter", f"with {NODES} select space_id, node_id, path from nodes_m where (path like '%.go#%' or path like '%.go' or path like '%.py#%' or path like '%.py') and not (path like '%.md#%' or path like '%.md')")
def extension_filter(spark, d):
    has = lambda *exts: F.exists(F.array(*[F.lit(f".{e}") for e in exts]), lambda e: F.col("path").endswith(e) | F.col("path").contains(F.concat(e, F.lit("#"))))
    return T.nodes(spark, d).where(has("go", "py") & ~has("md")).select("space_id", "node_id", "path")


@query("tag_filter", f"with {NODES} select space_id, node_id from nodes_m where list_contains(tags, 'conversation') and len(list_filter(tags, lambda t: starts_with(t, 'obs_type:'))) > 0")
def tag_filter(spark, d):
    """All of one list of tags, and any with a prefix."""
    want = F.array(F.lit("conversation"))
    return T.nodes(spark, d).where((F.size(F.array_except(want, "tags")) == 0) & F.exists("tags", lambda t: t.startswith("obs_type:"))).select("space_id", "node_id")


@query(
    "visibility_filter",
    "select distinct obs_id, coalesce(visibility, 'global') as visibility from observations where coalesce(visibility, 'global') <> 'private' or agent_id = (select min(agent_id) from observations)",
)
def visibility_filter(spark, d):
    """Not private, or owned by the asking agent; rows without a visibility are read as global."""
    o = T.observations(spark, d, "visibility", "agent_id")
    me = o.agg(F.min("agent_id")).first()[0]  # stands for the agent who asks
    seen = F.coalesce("visibility", F.lit("global"))
    return o.where((seen != "private") | (F.col("agent_id") == F.lit(me))).select("obs_id", seen.alias("visibility")).distinct()


@query(
    "path_redundancy",
    f"with {RESULTS} select query_id, node_id, least(3, count(*) over (partition by query_id, regexp_replace(path, '/[^/]*$', '')) - 1)::bigint as redundant from res where path is not null",
)
def path_redundancy(spark, d):
    w = Window.partitionBy("query_id", F.regexp_replace("path", "/[^/]*$", ""))
    return T.results(spark, d).where("path is not null").select("query_id", "node_id", F.least(F.lit(3).cast("long"), F.count("*").over(w) - 1).alias("redundant"))


EFF = f"""ef0 as (select *, case when rel_type = 'CO_ACTIVATED_WITH' then weight * pow(1 - 0.005 / sqrt(greatest(1.0, evidence)), greatest(0.0, date_diff('microsecond', updated_at, {NOW_SQL}) / 86400000000.0)) else weight end dw from edges_m),
ef as (select space_id, src, dst, rel_type, round(dw, 9) weight, least(1.0, greatest(0.0, round(dw, 9)) * case when 0.6 * dim_semantic + 0.2 * dim_temporal + 0.2 * dim_coactivation = 0 then 1.0 else 0.6 * dim_semantic + 0.2 * dim_temporal + 0.2 * dim_coactivation end) eff
  from ef0 where rel_type <> 'CO_ACTIVATED_WITH' or round(dw, 9) >= 0.05)"""


@query("effective_edges", f"with {EDGES}, {EFF} select src, dst, rel_type, round(weight, 6) as weight, round(eff, 6) as eff from ef")
def effective_edges(spark, d):
    return spread.with_effect(T.edges(spark, d), T.now()).select("src", "dst", "rel_type", r6("weight").alias("weight"), r6("eff").alias("eff"))


@query("neighbor_cap", f"with {EDGES}, {EFF} select src, dst, rel_type from (select *, row_number() over (partition by src order by weight desc, dst, rel_type) r from ef) where r <= 50")
def neighbor_cap(spark, d):
    e = spread.with_effect(T.edges(spark, d), T.now())
    return e.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "rel_type"))).where("r <= 50").select("src", "dst", "rel_type")


EXPAND = f"""{EDGES}, {EFF}, {FUSE.replace(RESULTS + ",", "")},
seed as (select query_id, node_id, sim from fu where fr <= 50),
h1 as (select query_id, src, rel_type, dst, eff, weight from (select *, row_number() over (partition by query_id order by weight desc, src, dst, rel_type) g from (select s.query_id, e.*, row_number() over (partition by s.query_id, e.src order by weight desc, dst, rel_type) r
  from seed s join ef e on e.src = s.node_id where rel_type in ('ASSOCIATED_WITH', 'GENERALIZES', 'ABSTRACTS_TO')) where r <= 50) where g <= 5000),
fr1 as (select distinct query_id, dst node_id from h1 where not exists (select 1 from seed s where s.query_id = h1.query_id and s.node_id = h1.dst)),
h2 as (select query_id, src, rel_type, dst, eff, weight from (select *, row_number() over (partition by query_id order by weight desc, src, dst, rel_type) g from (select s.query_id, e.*, row_number() over (partition by s.query_id, e.src order by weight desc, dst, rel_type) r
  from fr1 s join ef e on e.src = s.node_id where rel_type = 'CO_ACTIVATED_WITH') where r <= 50) where g <= 5000),
ex as (select distinct query_id, src, rel_type, dst, eff from (select query_id, src, rel_type, dst, eff from h1 union all select query_id, src, rel_type, dst, eff from h2))"""


def expansion(spark, d):
    """(fused candidates, their expansion), both written once as several later joins read them."""
    cand = materialize(fused(spark, d), "fused")
    edges = materialize(spread.with_effect(T.edges(spark, d), T.now()).select("src", "dst", "rel_type", "weight", "eff"), "effective")
    return cand, spread.expand(cand.where("fr <= 50"), edges)


@query("expand_2hop", f"with {EXPAND} select query_id, src, rel_type, dst, round(eff, 6) as eff from ex")
def expand_2hop(spark, d):
    return expansion(spark, d)[1].withColumn("eff", r6("eff"))


def _act_sql(carry: str, w: str) -> str:
    return f"""ca0 as (select *, {w} w from ex where {carry}), ca as (select query_id, src, dst, eff * w / greatest(1.0, sqrt(sum(w) over (partition by query_id, dst))) k from ca0),
a0 as (select query_id, node_id, least(1.0, greatest(0.0, sim)) act from fu),
a1 as (select query_id, node_id, least(1.0, greatest(0.0, round(sum(x), 12))) act from (select query_id, node_id, 0.85 * act x from a0 union all select ca.query_id, ca.dst, a0.act * k from ca join a0 on a0.query_id = ca.query_id and a0.node_id = ca.src) group by 1, 2),
a2 as (select query_id, node_id, least(1.0, greatest(0.0, round(sum(x), 12))) act from (select query_id, node_id, 0.85 * act x from a1 union all select ca.query_id, ca.dst, a1.act * k from ca join a1 on a1.query_id = ca.query_id and a1.node_id = ca.src) group by 1, 2)"""


LEARNED_ACT = _act_sql("rel_type = 'CO_ACTIVATED_WITH'", "1.0::double")
ATT_ACT = _act_sql("true", "case rel_type when 'CO_ACTIVATED_WITH' then 0.85::double when 'ABSTRACTS_TO' then 0.6::double else 0.65::double end")


@query("spread_activation", f"with {EXPAND}, {LEARNED_ACT} select query_id, node_id, round(act, 6) as act from a2")
def spread_activation(spark, d):
    cand, ex = expansion(spark, d)
    return spread.activate(cand.select("query_id", "node_id", F.col("sim").alias("act")), ex).withColumn("act", r6("act"))


@query("attention_activation", f"with {EXPAND}, {ATT_ACT} select query_id, node_id, round(act, 6) as act from a2")
def attention_activation(spark, d):
    cand, ex = expansion(spark, d)
    return spread.activate(cand.select("query_id", "node_id", F.col("sim").alias("act")), ex, attention=spread.ATTENTION).withColumn("act", r6("act"))


RETRIEVE = f"""with {EXPAND}, {LEARNED_ACT},
dg as (select query_id, node_id, count(*) deg from (select query_id, src node_id from ex union all select query_id, dst from ex) group by 1, 2),
soft as (select query_id, max((lower(query_text) like '%recent%' or lower(query_text) like '%latest%' or lower(query_text) like '%newest%' or lower(query_text) like '%what changed%' or lower(query_text) like '%updated%' or lower(query_text) like '%updates to%')::int) soft from query_log group by 1),
cd as (select f.query_id, f.node_id, f.sim, a.act, coalesce(g.deg, 0) deg, n.layer, n.confidence, n.path, list_contains(n.tags, 'config') config, greatest(0.0, date_diff('microsecond', n.at_, {NOW_SQL}) / 86400000000.0) as days, coalesce(s.soft, 0) soft,
  least(3, count(*) over (partition by f.query_id, regexp_replace(n.path, '/[^/]*$', '')) - 1) dup
  from fu f join nodes_m n on n.node_id = f.node_id join a2 a on a.query_id = f.query_id and a.node_id = f.node_id left join dg g on g.query_id = f.query_id and g.node_id = f.node_id left join soft s on s.query_id = f.query_id where not n.is_archived),
sc as (select *, (0.55 * sim + 0.30 * act + 0.10 * case when soft = 1 then 3 else 1 end * exp(-(case when layer = 0 then 0.05 when layer = 1 then 0.02 else 0.01 end) * days) + 0.05 * confidence - case when layer = 0 then 0.08 * ln(1 + deg) else 0 end - 0.12 * dup) * case when config then 1.15 else 1.0 end score from cd),
rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, node_id) r from sc),
tp as (select *, count(*) over (partition by query_id) n from rk where r <= 20),
cf as (select *, {CONF} pct from tp)
select query_id, node_id, r as rank, round(score, 6) as score, round(sim, 6) as sim, round(act, 6) as activation, pct as percentile, case when pct >= 90 then 'HIGH' when pct >= 40 then 'MEDIUM' else 'LOW' end as level from cf"""


@query("retrieve_full", RETRIEVE)
def retrieve_full(spark, d, top_k: int = 20):
    """The whole pipeline for every logged query: fuse, expand, activate, score, rank, confidence.

    Only recall candidates are scored; nodes found by expansion feed activation
    and degree.  Recency weighs three times where the query's words ask for recent things.
    """
    cand, ex = expansion(spark, d)
    ex = materialize(ex, "expansion")
    act = spread.activate(cand.select("query_id", "node_id", F.col("sim").alias("act")), ex)
    deg = ex.select("query_id", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("query_id", "node_id").agg(F.count("*").alias("deg"))
    low = F.lower("query_text")
    words = ("recent", "latest", "newest", "what changed", "updated", "updates to")
    soft = T.table(spark, d, "query_log").groupBy("query_id").agg(F.max(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))).alias("soft"))
    n = T.nodes(spark, d).where("not is_archived").select("node_id", "layer", "confidence", "path", "tags", "at")
    c = cand.select("query_id", "node_id", "sim").join(n, "node_id").join(act, ["query_id", "node_id"]).join(deg, ["query_id", "node_id"], "left").join(soft, "query_id", "left")
    dup = F.count("*").over(Window.partitionBy("query_id", F.regexp_replace("path", "/[^/]*$", ""))) - 1
    rec = S.recency(S.days_between(T.now(), F.col("at")), F.col("layer")) * F.when(F.coalesce("soft", F.lit(False)), 3).otherwise(1)
    zero = F.lit(0.0)
    c = c.withColumn("dup", dup).withColumn("score", S.final_score(F.col("sim"), F.col("act"), rec, F.col("confidence"), F.col("layer"), F.coalesce("deg", F.lit(0)), F.col("dup"), zero, zero, F.array_contains("tags", "config")))
    top = c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "node_id"))).where(F.col("rank") <= top_k)
    out = confidence(top.drop("rank"), "query_id", [F.round("score", 9).desc(), "node_id"])
    return out.select("query_id", "node_id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"), r6("sim").alias("sim"), r6("act").alias("activation"), "percentile", "level")
