"""Boosts, penalties, anomalies, lookups and the remaining composite queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from memloom.functions import rules as R, scoring as S, vec as V
from memloom.operators import graph as G
from memloom.plans.base import ASSOC, EDGES, HIER, LEARNED, NODES, NOW_SQL, RESULTS, query, r6
from memloom.plans.graph import CHILD, PAIRS_SQL, node_vectors
from memloom.plans.retrieval import vectors
from memloom.plans.text import QL, queries
from memloom.sources import tables as T

BOOST_STOP = "[" + ", ".join(R.quoted(w) for w in R.KEYWORD_STOP) + "]"


@query(
    "path_match_scores",
    f"""with {NODES}, {RESULTS}, {QL}, h as (select distinct query_id, regexp_replace(lower(unnest(regexp_extract_all(query_text, '(?i)\\b([\\w\\-]+/[\\w\\-./]+)', 1))), '/$', '') hint from ql),
c as (select r.query_id, r.node_id, lower(n.path) p, h.hint, string_split(h.hint, '/') hp, string_split(lower(n.path), '/') pp from res r join h using (query_id) join nodes_m n using (node_id) where n.path is not null),
s as (select query_id, node_id, case when contains(p, hint) then 0.5 + 0.5 * length(hint) / length(p) else 0.3 * len(list_filter(hp, lambda x: len(list_filter(pp, lambda y: contains(y, x) or contains(x, y))) > 0)) / len(hp) end sc from c)
select query_id, node_id, round(max(sc), 6) as path_score from s group by 1, 2 having max(sc) > 0""",
)
def path_match_scores(spark, d):
    """How well each result's path meets the paths its query names."""
    h = queries(spark, d).select("query_id", F.explode(F.regexp_extract_all("query_text", F.lit(r"(?i)\b([\w\-]+/[\w\-./]+)"), F.lit(1))).alias("h")).select("query_id", F.regexp_replace(F.lower("h"), "/$", "").alias("hint")).distinct()
    n = T.nodes(spark, d).where("path is not null").select("node_id", F.lower("path").alias("p"))
    c = T.results(spark, d).select("query_id", "node_id").join(h, "query_id").join(n, "node_id")
    hp, pp = F.split("hint", "/"), F.split("p", "/")
    met = F.size(F.filter(hp, lambda x: F.exists(pp, lambda y: y.contains(x) | x.contains(y))))
    score = F.when(F.col("p").contains(F.col("hint")), 0.5 + 0.5 * F.length("hint") / F.length("p")).otherwise(0.3 * met / F.size(hp))
    return c.groupBy("query_id", "node_id").agg(F.max(score).alias("s")).where("s > 0").select("query_id", "node_id", r6("s").alias("path_score"))


@query(
    "keyword_boost",
    f"""with {NODES}, {RESULTS}, {QL}, k as (select query_id, list_filter(list_transform(regexp_split_to_array(lower(query_text), '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^a-z0-9_]+', ''), '[^a-z0-9_]+$', '')), lambda w: length(w) >= 2 and not list_contains({BOOST_STOP}, w)) kw from ql),
c as (select r.query_id, r.node_id, r.score, lower(coalesce(n.name, '')) nm, lower(coalesce(n.summary, '')) sm, kw from res r join k using (query_id) join nodes_m n using (node_id) where len(kw) > 0 and r.score is not null),
m as (select *, list_sum(list_transform(kw, lambda w: (case when contains(nm, w) then 2 else 0 end + case when contains(sm, w) then 1 else 0 end + case when list_contains(regexp_split_to_array(nm || ' ' || sm, '[^a-z0-9_]+'), w) then 1 else 0 end)::double)) / (4.0 * len(kw)) mt from c)
select query_id, node_id, round(score + 0.2 * mt, 6) as boosted, row_number() over (partition by query_id order by round(score + 0.2 * mt, 9) desc, node_id) as rank from m""",
)
def keyword_boost(spark, d, factor: float = 0.2):
    """Results lifted by how their names and summaries meet the query's words, and ranked again."""
    bare = F.transform(F.split(F.lower("query_text"), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, "^[^a-z0-9_]+", ""), "[^a-z0-9_]+$", ""))
    k = queries(spark, d).select("query_id", F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.isin(R.KEYWORD_STOP)).alias("kw")).where(F.size("kw") > 0)
    blank = F.lit("")
    n = T.nodes(spark, d).select("node_id", F.lower(F.coalesce("name", blank)).alias("nm"), F.lower(F.coalesce("summary", blank)).alias("sm"))
    c = T.results(spark, d).where("score is not null").select("query_id", "node_id", "score").join(k, "query_id").join(n, "node_id").withColumn("ws", F.split(F.concat_ws(" ", "nm", "sm"), "[^a-z0-9_]+"))
    hit = lambda a, w: a + F.when(F.col("nm").contains(w), 2.0).otherwise(0.0) + F.when(F.col("sm").contains(w), 1.0).otherwise(0.0) + F.when(F.array_contains("ws", w), 1.0).otherwise(0.0)
    c = c.withColumn("b", F.col("score") + factor * F.aggregate("kw", F.lit(0.0), hit) / (4.0 * F.size("kw")))
    return c.select("query_id", "node_id", r6("b").alias("boosted"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("b", 9).desc(), "node_id")).cast("long").alias("rank"))


@query(
    "stale_reference_penalty",
    f"with {NODES}, {ASSOC}, e as (select a.src, date_diff('microsecond', s.at_, t.at_) / 86400000000.0 dd from assoc a join nodes_m s on s.node_id = a.src join nodes_m t on t.node_id = a.dst) select src as node_id, round(max(least(0.15, 0.05 * (dd - 30) / 30)), 6) as penalty from e where dd > 30 group by 1",
)
def stale_reference_penalty(spark, d, days: float = 30.0, most: float = 0.15):
    """A node that links to one newer by more than ``days`` is marked down, by the worst of its links."""
    n = T.nodes(spark, d).select("node_id", "at")
    e = T.similar_edges(spark, d).select("src", "dst").join(n.withColumnsRenamed({"node_id": "src", "at": "a"}), "src").join(n.withColumnsRenamed({"node_id": "dst", "at": "b"}), "dst")
    e = e.withColumn("dd", (F.unix_micros("b") - F.unix_micros("a")) / 86_400_000_000.0).where(F.col("dd") > days)
    return e.groupBy(F.col("src").alias("node_id")).agg(r6(F.max(F.least(F.lit(most), 0.05 * (F.col("dd") - days) / days))).alias("penalty"))


@query(
    "attention_rerank",
    f"""with {CHILD}, {ASSOC}, rt as (select space_id, min(node_id) root from nodes_m join nv using (node_id) group by 1), e as (select a.*, list_cosine_similarity(q.v, t.v) cs from assoc a join rt on rt.space_id = a.space_id join nv q on q.node_id = rt.root join nv t on t.node_id = a.dst),
k as (select src, dst, least(1.0, greatest(0.0, 0.5 * cs + 0.5 * (0.4 * weight + 0.3 * dim_semantic + 0.2 * dim_coactivation + 0.1 * dim_temporal))) att from e)
select src, dst, round(att, 6) as attention from (select *, row_number() over (partition by src order by round(att, 9) desc, dst) r from k) where r <= 5""",
)
def attention_rerank(spark, d, per_node: int = 5):
    """Each node's five links that matter most to a query vector (here that of the space's first node)."""
    v = node_vectors(spark, d)
    root = T.nodes(spark, d).select("space_id", "node_id").join(v.select("node_id"), "node_id", "left_semi").groupBy("space_id").agg(F.min("node_id").alias("node_id")).join(v, "node_id").select("space_id", F.col("vec").alias("q"))
    e = T.similar_edges(spark, d).join(root, "space_id").join(v.withColumnsRenamed({"node_id": "dst", "vec": "t"}), "dst")
    signal = 0.4 * F.col("weight") + 0.3 * F.col("dim_semantic") + 0.2 * F.col("dim_coactivation") + 0.1 * F.col("dim_temporal")
    e = e.withColumn("att", S.clamp(0.5 * V.cosine(F.col("q"), F.col("t")) + 0.5 * signal))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.round("att", 9).desc(), "dst"))).where(F.col("r") <= per_node).select("src", "dst", r6("att").alias("attention"))


@query("duplicate_anomalies", f"with {PAIRS_SQL} select space_id, a, b, sim, case when sim >= 0.99 then 'critical' else 'warning' end as severity from sp where sim >= 0.95")
def duplicate_anomalies(spark, d):
    p = G.similar_pairs(vectors(spark, d).withColumnRenamed("space_id", "grp"), 0.95)
    return p.select(F.col("grp").alias("space_id"), "a", "b", "sim", F.when(F.col("sim") >= 0.99, "critical").otherwise("warning").alias("severity"))


@query(
    "stale_anomalies",
    f"with {NODES}, x as (select node_id, floor(date_diff('microsecond', updated_at, {NOW_SQL}) / 86400000000.0) dd from nodes_m where not is_archived) select node_id, round(dd / (dd + 30), 6) as confidence, case when dd > 90 then 'warning' else 'info' end as severity from x where dd > 30",
)
def stale_anomalies(spark, d):
    n = T.nodes(spark, d).where("not is_archived").select("node_id", F.floor(S.days_between(T.now(), F.col("updated_at"))).alias("dd")).where("dd > 30")
    return n.select("node_id", r6(F.col("dd") / (F.col("dd") + 30)).alias("confidence"), F.when(F.col("dd") > 90, "warning").otherwise("info").alias("severity"))


@query(
    "consult_confidence",
    f"with {RESULTS}, k as (select query_id, score, row_number() over (partition by query_id order by score desc, node_id) r, count(*) over (partition by query_id) n from res where score is not null) select query_id, round(least(0.95, avg(case when r <= 5 then score end) * case when any_value(n) >= 10 then 1.2 when any_value(n) >= 5 then 1.1 else 1.0 end), 6) as confidence from k group by 1",
)
def consult_confidence(spark, d):
    """The mean of the five best, more trusted the more was found, 0.95 at most."""
    w = Window.partitionBy("query_id")
    k = T.results(spark, d).where("score is not null").withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "node_id"))).withColumn("n", F.count("*").over(w))
    boost = F.when(F.first("n") >= 10, 1.2).when(F.first("n") >= 5, 1.1).otherwise(1.0)
    return k.groupBy("query_id").agg(F.least(F.lit(0.95), F.avg(F.when(F.col("r") <= 5, F.col("score"))) * boost).alias("c")).select("query_id", r6("c").alias("confidence"))


@query(
    "watchdog_levels",
    f"select space_id, round(date_diff('microsecond', last_ingest_at, {NOW_SQL}) / 3600000000.0 * 0.0001, 6) as decay, case when date_diff('microsecond', last_ingest_at, {NOW_SQL}) / 3600000000.0 * 0.0001 >= 0.9 then 'force' when date_diff('microsecond', last_ingest_at, {NOW_SQL}) / 3600000000.0 * 0.0001 >= 0.6 then 'warn' when date_diff('microsecond', last_ingest_at, {NOW_SQL}) / 3600000000.0 * 0.0001 >= 0.3 then 'nudge' else 'nominal' end as level from spaces where last_ingest_at is not null",
)
def watchdog_levels(spark, d, rate: float = 0.0001):
    decay = (F.unix_micros(T.now()) - F.unix_micros("last_ingest_at")) / 3_600_000_000.0 * rate
    s = T.table(spark, d, "spaces").where("last_ingest_at is not null").withColumn("x", decay)
    return s.select("space_id", r6("x").alias("decay"), F.when(F.col("x") >= 0.9, "force").when(F.col("x") >= 0.6, "warn").when(F.col("x") >= 0.3, "nudge").otherwise("nominal").alias("level"))


@query(
    "conversation_boost",
    f"""with {LEARNED}, ob as (select node_id, max(surprise_score) s from observations where obs_type in ('correction', 'decision') group by 1), dr as (select r.*, case when ob.node_id is not null then 1 + 0.2 * least(1.0, coalesce(ob.s, 0)) end db from res r left join ob using (node_id) where r.score is not null),
lk as (select l.src node_id, max(weight) w from learned l join ob on ob.node_id = l.dst group by 1) select query_id, dr.node_id, round(score * coalesce(db, 1 + 0.2 * coalesce(w, 0) * 0.5), 6) as boosted from dr left join lk using (node_id)""",
)
def conversation_boost(spark, d):
    """Results that are decisions or corrections themselves rise by their surprise, those linked to one by half the link."""
    ob = T.table(spark, d, "observations").where("obs_type in ('correction', 'decision')").groupBy("node_id").agg(F.max("surprise_score").alias("s")).withColumn("direct", F.lit(True))
    link = T.learned_edges(spark, d).select(F.col("src"), F.col("dst").alias("node_id"), "weight").join(ob.select("node_id"), "node_id", "left_semi").groupBy(F.col("src").alias("node_id")).agg(F.max("weight").alias("w"))
    r = T.results(spark, d).where("score is not null").join(ob, "node_id", "left").join(link, "node_id", "left")
    zero = F.lit(0.0)
    boost = F.when(F.col("direct"), 1 + 0.2 * F.least(F.lit(1.0), F.coalesce("s", zero))).otherwise(1 + 0.2 * F.coalesce("w", zero) * 0.5)
    return r.select("query_id", "node_id", r6(F.col("score") * boost).alias("boosted"))


@query(
    "recall_union",
    f"""with {NODES}, {RESULTS}, k as (select r.query_id, r.node_id, r.vector_sim, case when n.layer = 0 then 'observation' when n.layer = 1 then 'theme' else 'concept' end kind from res r join nodes_m n using (node_id) where n.role_type = 'conversation_observation' and r.vector_sim is not null),
c as (select * from (select *, row_number() over (partition by query_id, kind order by vector_sim desc, node_id) r from k) where r <= 20) select query_id, node_id, kind, rk as rank from (select *, row_number() over (partition by query_id order by vector_sim desc, node_id) rk from c) where rk <= 10""",
)
def recall_union(spark, d):
    """Twice the wanted number from each of three classes, put together and cut to ten."""
    n = T.nodes(spark, d).where("role_type = 'conversation_observation'").select("node_id", F.when(F.col("layer") == 0, "observation").when(F.col("layer") == 1, "theme").otherwise("concept").alias("kind"))
    k = T.results(spark, d).where("vector_sim is not null").select("query_id", "node_id", "vector_sim").join(n, "node_id")
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("vector_sim"), "node_id"))
    c = k.withColumn("r", best("query_id", "kind")).where("r <= 20")
    return c.withColumn("rank", best("query_id").cast("long")).where("rank <= 10").select("query_id", "node_id", "kind", "rank")


@query(
    "coalesced_refs",
    f"with {NODES}, sy as (select space_id, min(element_id) element_id, name from code_elements where kind = 'function' group by 1, 3), q as (select distinct query_id, space_id, regexp_extract(query_text, '([A-Za-z_][A-Za-z0-9_]*[A-Z_][A-Za-z0-9_]*)', 1) w from query_log), nn as (select space_id, name, min(node_id) node_id from nodes_m group by 1, 2) select query_id, coalesce(nn.node_id, sy.element_id) as target, case when nn.node_id is not null then 'node' else 'symbol' end as found from q left join nn on nn.space_id = q.space_id and nn.name = w left join sy on sy.space_id = q.space_id and sy.name = w where coalesce(nn.node_id, sy.element_id) is not null",
)
def coalesced_refs(spark, d):
    """The node of a name, or else the symbol."""
    q = T.table(spark, d, "query_log").select("query_id", "space_id", F.regexp_extract("query_text", "([A-Za-z_][A-Za-z0-9_]*[A-Z_][A-Za-z0-9_]*)", 1).alias("name")).distinct()
    n = T.nodes(spark, d).groupBy("space_id", "name").agg(F.min("node_id").alias("node_id"))
    s = T.table(spark, d, "code_elements").where("kind = 'function'").groupBy("space_id", "name").agg(F.min("element_id").alias("element_id"))
    j = q.join(n, ["space_id", "name"], "left").join(s, ["space_id", "name"], "left")
    target = F.coalesce("node_id", "element_id")
    return j.where(target.isNotNull()).select("query_id", target.alias("target"), F.when(F.col("node_id").isNotNull(), "node").otherwise("symbol").alias("found"))


@query("link_directions", f"with {ASSOC} select src as node_id, dst as other, 'out' as direction from assoc where dim_semantic >= 0.9 union select dst, src, 'in' from assoc where dim_semantic >= 0.9")
def link_directions(spark, d):
    """Outgoing and incoming links of every node, as one set."""
    e = T.similar_edges(spark, d).where("dim_semantic >= 0.9")
    return e.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), F.lit("out").alias("direction")).union(e.select("dst", "src", F.lit("in"))).distinct()


@query("explanations", f"with {RESULTS} select query_id, node_id, case when vector_sim >= 0.7 and activation >= 0.3 then 'similar and active' when vector_sim >= 0.7 then 'similar' when activation >= 0.3 then 'active' else 'weak' end as reason, round(least(1.0, 0.6 * greatest(0.0, coalesce(vector_sim, 0)) + 0.4 * coalesce(activation, 0)), 6) as confidence from res")
def explanations(spark, d):
    zero = F.lit(0.0)
    sim, act = F.col("vector_sim"), F.col("activation")
    reason = F.when((sim >= 0.7) & (act >= 0.3), "similar and active").when(sim >= 0.7, "similar").when(act >= 0.3, "active").otherwise("weak")
    return T.results(spark, d).select("query_id", "node_id", reason.alias("reason"), r6(F.least(F.lit(1.0), 0.6 * F.greatest(zero, F.coalesce(sim, zero)) + 0.4 * F.coalesce(act, zero))).alias("confidence"))


@query(
    "rerank_blend",
    f"with {RESULTS}, k as (select query_id, node_id, score, activation, row_number() over (partition by query_id order by score desc, node_id) r from res where score is not null) select query_id, node_id, round(case when r <= 30 then 0.6 * score + 0.4 * coalesce(activation, 0.5) else 0.95 * score end, 6) as blended from k",
)
def rerank_blend(spark, d):
    """The 30 best blended with a second, supplied score (here the activation; 0.5 where it is missing), the tail marked down."""
    k = T.results(spark, d).where("score is not null").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")))
    return k.select("query_id", "node_id", r6(F.when(F.col("r") <= 30, 0.6 * F.col("score") + 0.4 * F.coalesce("activation", F.lit(0.5))).otherwise(0.95 * F.col("score"))).alias("blended"))


@query(
    "action_calibration",
    "with o as (select distinct obs_id, obs_type, created_at, coalesce(surprise_score, 0) < 0.5 ok from observations where obs_type is not null and created_at is not null), k as (select *, row_number() over (partition by obs_type order by created_at desc, obs_id desc) r from o) select obs_type as action, count(*) as outcomes, round(avg(ok::int), 6) as success from k where r <= 100 group by 1",
)
def action_calibration(spark, d):
    """The share of good outcomes among the last hundred of each kind."""
    o = T.observations(spark, d, "obs_type", "created_at", "surprise_score").where("obs_type is not null and created_at is not null")
    k = o.withColumn("r", F.row_number().over(Window.partitionBy("obs_type").orderBy(F.desc("created_at"), F.desc("obs_id")))).where("r <= 100")
    return k.groupBy(F.col("obs_type").alias("action")).agg(F.count("*").alias("outcomes"), r6(F.avg(F.when(F.coalesce("surprise_score", F.lit(0.0)) < 0.5, 1).otherwise(0))).alias("success"))


@query(
    "blast_radius",
    f"with {NODES}, {EDGES.replace(NODES + ', ', '')}, n as (select space_id, count(*) c, sum(case when is_archived then 1 else 0 end) a from nodes_m group by 1), e as (select space_id, count(*) c, sum((weight < 0.12)::int) a from edges_m group by 1) select s.space_id, case when s.is_protected then 'protected' when n.a > 0.05 * n.c then 'too many nodes' when coalesce(e.a, 0) > 0.10 * coalesce(e.c, 0) then 'too many edges' else 'allowed' end as verdict from spaces s join n using (space_id) left join e using (space_id)",
)
def blast_radius(spark, d):
    """Whether a clean-up may run: at most a twentieth of the nodes and a tenth of the edges, no protected space."""
    n = T.nodes(spark, d).groupBy("space_id").agg(F.count("*").alias("n"), F.sum(F.col("is_archived").cast("int")).alias("na"))
    e = T.edges(spark, d).groupBy("space_id").agg(F.count("*").alias("e"), F.sum(F.when(F.col("weight") < 0.12, 1).otherwise(0)).alias("ea"))
    s = T.table(spark, d, "spaces").join(n, "space_id").join(e, "space_id", "left").fillna(0, ["e", "ea"])
    verdict = F.when(F.col("is_protected"), "protected").when(F.col("na") > 0.05 * F.col("n"), "too many nodes").when(F.col("ea") > 0.10 * F.col("e"), "too many edges").otherwise("allowed")
    return s.select("space_id", verdict.alias("verdict"))


@query("node_pages", f"with {NODES}, k as (select space_id, node_id, row_number() over (partition by space_id order by node_id) r from nodes_m) select space_id, node_id, (r - 1) // 500 as page from k")
def node_pages(spark, d):
    """Pages of 500 nodes in the order of their ids."""
    k = T.nodes(spark, d).select("space_id", "node_id", F.row_number().over(Window.partitionBy("space_id").orderBy("node_id")).alias("r"))
    return k.select("space_id", "node_id", F.floor((F.col("r") - 1) / 500).alias("page"))


@query(
    "concern_nodes",
    f"with {NODES}, t as (select space_id, node_id, unnest(list_filter(tags, lambda t: starts_with(t, 'concern:'))) tag from nodes_m) select space_id, tag, count(distinct node_id) as members, min(node_id) as first_member from t group by 1, 2 having count(distinct node_id) >= 3",
)
def concern_nodes(spark, d):
    """One pattern node per concern that at least three nodes of a space share."""
    t = T.nodes(spark, d).select("space_id", "node_id", F.explode(F.filter("tags", lambda t: t.startswith("concern:"))).alias("tag"))
    return t.groupBy("space_id", "tag").agg(F.count_distinct("node_id").alias("members"), F.min("node_id").alias("first_member")).where("members >= 3")


@query(
    "comparison_groups",
    f"with {NODES}, b as (select distinct space_id, node_id, regexp_replace(regexp_extract(name, '([A-Z][a-z]+)[A-Z]?[a-z0-9]*$', 1), '^$', '') base from nodes_m where role_type = 'code'), g as (select space_id, base, count(*) n, min(node_id) f from b where base <> '' group by 1, 2) select space_id, base, n as members, f as first_member from g where n between 2 and 6",
)
def comparison_groups(spark, d):
    """Code nodes of one space whose names end alike, two to six of them."""
    b = T.nodes(spark, d).where("role_type = 'code'").select("space_id", "node_id", F.regexp_extract("name", "([A-Z][a-z]+)[A-Z]?[a-z0-9]*$", 1).alias("base")).distinct().where("base <> ''")
    return b.groupBy("space_id", "base").agg(F.count("*").alias("members"), F.min("node_id").alias("first_member")).where("members between 2 and 6")


@query(
    "concept_merge",
    f"""with {CHILD}, c as (select n.space_id, n.node_id, v, row_number() over (partition by n.space_id order by n.node_id) r from nodes_m n join nv using (node_id) where n.layer = 3), m as (select n.space_id, n.node_id, v from nodes_m n join nv using (node_id) where n.layer = 2),
p as (select m.node_id cluster, c.node_id concept, round(list_cosine_similarity(m.v, c.v), 6) sim, row_number() over (partition by m.node_id order by round(list_cosine_similarity(m.v, c.v), 6) desc, c.node_id) r from m join c on c.space_id = m.space_id) select cluster, concept, sim from p where r = 1 and sim > 0.90""",
)
def concept_merge(spark, d):
    """Clusters that go into an existing concept above: the nearest at more than 0.90."""
    n = T.nodes(spark, d).where("layer in (2, 3)").select("space_id", "node_id", "layer")
    v = node_vectors(spark, d).join(n, "node_id")
    p = G.similar_pairs(v.select(F.col("space_id").alias("grp"), F.col("node_id").alias("id"), "vec"), 0.900001)
    both = p.select("a", "b", "sim").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    low = n.where("layer = 2").select(F.col("node_id").alias("a"))
    high = n.where("layer = 3").select(F.col("node_id").alias("b"))
    x = both.join(low, "a", "left_semi").join(high, "b", "left_semi").groupBy("a").agg(F.min(F.struct((-F.col("sim")).alias("k"), "b")).alias("m"))
    return x.select(F.col("a").alias("cluster"), F.col("m.b").alias("concept"), (-F.col("m.k")).alias("sim"))


@query(
    "degree_caps",
    f"with {EDGES}, dg as (select node_id, count(*) degree from (select src node_id from edges_m union all select dst from edges_m) group by 1) select n.space_id, count(*) as below from nodes_m n left join dg using (node_id) where coalesce(degree, 0) < 10 group by 1",
)
def degree_caps(spark, d):
    """Nodes of fewer than ten edges, by space."""
    deg = T.edges(spark, d).select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return T.nodes(spark, d).join(deg, "node_id", "left").where("coalesce(degree, 0) < 10").groupBy("space_id").agg(F.count("*").alias("below"))


@query(
    "version_conflicts",
    "with e as (select space_id, count(*) expected from query_log group by 1) select s.space_id, s.ingest_count as version, e.expected, case when s.ingest_count = e.expected then 'applied' when s.ingest_count > e.expected then 'conflict' else 'ahead' end as state from spaces s join e using (space_id)",
)
def version_conflicts(spark, d):
    """Updates that expect a version: applied on equality, refused otherwise."""
    e = T.table(spark, d, "query_log").groupBy("space_id").agg(F.count("*").alias("expected"))
    v = F.col("ingest_count")
    return T.table(spark, d, "spaces").join(e, "space_id").select("space_id", v.alias("version"), "expected", F.when(v == F.col("expected"), "applied").when(v > F.col("expected"), "conflict").otherwise("ahead").alias("state"))


@query(
    "context_triggers",
    f"with {QL}, t as (" + " union all ".join(f"select query_id, '{k}' as trigger, " + " + ".join(f"contains(lower(query_text), {R.quoted(w)})::int" for w in v) + " as n from ql" for k, v in R.TRIGGERS.items()) + ") select query_id, trigger, n as keywords from t where n > 0",
)
def context_triggers(spark, d):
    """What a query's words suggest looking at, and how many of them do."""
    low = F.lower("query_text")
    count = lambda v: F.size(F.filter(F.array(*[F.lit(w) for w in v]), lambda w: low.contains(w)))
    per = F.array(*[F.struct(F.lit(k).alias("trigger"), count(v).alias("n")) for k, v in R.TRIGGERS.items()])
    return queries(spark, d).select("query_id", F.explode(per).alias("t")).where("t.n > 0").select("query_id", F.col("t.trigger").alias("trigger"), F.col("t.n").alias("keywords"))


@query(
    "result_conflicts",
    f"""with {NODES}, {RESULTS}, {QL}, x as (select r.query_id, r.node_id, r.score, lower(coalesce(n.summary, '')) sm, lower(coalesce(n.name, '')) nm, lower(q.query_text) q from res r join nodes_m n using (node_id) join ql q using (query_id) where r.score is not null),
c as (select query_id, node_id, 'deprecated' kind from x where contains(sm, 'deprecated') and score > 0.7 union all select query_id, node_id, 'advised against' from x where (contains(sm, 'avoid') or contains(sm, 'don''t') or contains(sm, 'do not')) and score > 0.6
  union all select query_id, node_id, 'naming' from x where (contains(sm, 'naming') or contains(nm, 'convention')) and score > 0.65
  union all select query_id, node_id, 'opposite' from x where score > 0.6 and ((contains(q, 'sync') and contains(sm, 'async')) or (contains(q, 'class') and contains(sm, 'function')) or (contains(q, 'sql') and contains(sm, 'nosql')) or (contains(q, 'rest') and contains(sm, 'graphql'))))
select distinct query_id, node_id, kind from c""",
)
def result_conflicts(spark, d):
    """Results that speak against what is asked for."""
    blank = F.lit("")
    n = T.nodes(spark, d).select("node_id", F.lower(F.coalesce("summary", blank)).alias("sm"), F.lower(F.coalesce("name", blank)).alias("nm"))
    x = T.results(spark, d).where("score is not null").select("query_id", "node_id", "score").join(n, "node_id").join(queries(spark, d).select("query_id", F.lower("query_text").alias("q")), "query_id")
    sm, q, s = F.col("sm"), F.col("q"), F.col("score")
    opposite = (q.contains("sync") & sm.contains("async")) | (q.contains("class") & sm.contains("function")) | (q.contains("sql") & sm.contains("nosql")) | (q.contains("rest") & sm.contains("graphql"))
    kinds = F.array_compact(
        F.array(
            F.when(sm.contains("deprecated") & (s > 0.7), "deprecated"), F.when((sm.contains("avoid") | sm.contains("don't") | sm.contains("do not")) & (s > 0.6), "advised against"),
            F.when((sm.contains("naming") | F.col("nm").contains("convention")) & (s > 0.65), "naming"), F.when(opposite & (s > 0.6), "opposite"),
        )
    )
    return x.select("query_id", "node_id", F.explode(kinds).alias("kind")).distinct()


IDENT = r"[a-z][A-Z]|[A-Z]{2,}[a-z]|[A-Za-z]_|_[A-Za-z]"


@query(
    "specificity",
    f"""with ob as (select distinct obs_id, content from observations where content is not null and content <> ''), w as (select obs_id, content, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') ws from ob),
k as (select obs_id, content, len(ws) n, len(list_filter(ws, lambda x: regexp_matches(regexp_replace(x, '[.,;:!?()\\[\\]{{}}"''`]+$', ''), '{IDENT}') or (contains(regexp_replace(x, '[.,;:!?()\\[\\]{{}}"''`]+$', ''), '.') and regexp_matches(x, '[a-z]') and strlen(regexp_replace(x, '[.,;:!?()\\[\\]{{}}"''`]+$', '')) > 5))) i,
  len(list_filter(ws, lambda x: list_contains([{", ".join(R.quoted(v) for v in R.VAGUE)}], lower(regexp_replace(x, '[.,;:!?]+$', ''))))) vague from w)
select obs_id, round(least(1.0, greatest(0.0, case when n >= 30 then 0.3 when n >= 15 then 0.2 when n >= 5 then 0.1 else 0 end + case when n = 0 then 0 when i / n >= 0.15 then 0.3 when i / n >= 0.08 then 0.2 when i / n >= 0.03 then 0.1 else 0 end + case when regexp_matches(content, '[0-9]') then 0.1 else 0 end
  + case when contains(content, '/') and ({R.contains_any_sql('content', R.PATH_SIGNS)} or starts_with(content, '/')) then 0.15 else 0 end + case when contains(content, chr(34)) or contains(content, chr(39)) or contains(content, '`') then 0.1 else 0 end - case when n > 0 and vague / n > 0.3 then 0.15 else 0 end)), 6) as specificity from k""",
)
def specificity(spark, d):
    """The third part of an observation's quality: length, identifiers, numbers, paths, quotes, less vague words."""
    o = T.observations(spark, d, "content").where("content is not null and content <> ''")
    o = o.withColumn("ws", F.filter(F.split("content", r"\s+"), lambda x: x != "")).withColumn("n", F.size("ws"))
    bare = lambda x: F.regexp_replace(x, "[.,;:!?()\\[\\]{}\"'`]+$", "")
    ident = F.size(F.filter("ws", lambda x: bare(x).rlike(IDENT) | (bare(x).contains(".") & x.rlike("[a-z]") & (F.octet_length(bare(x)) > 5)))) / F.greatest("n", F.lit(1))
    vague = F.size(F.filter("ws", lambda x: F.lower(F.regexp_replace(x, "[.,;:!?]+$", "")).isin(R.VAGUE))) / F.greatest("n", F.lit(1))
    c, n = F.col("content"), F.col("n")
    score = F.when(n >= 30, 0.3).when(n >= 15, 0.2).when(n >= 5, 0.1).otherwise(0.0)
    score = score + F.when(n == 0, 0.0).when(ident >= 0.15, 0.3).when(ident >= 0.08, 0.2).when(ident >= 0.03, 0.1).otherwise(0.0) + F.when(c.rlike("[0-9]"), 0.1).otherwise(0.0)
    score = score + F.when(c.contains("/") & (R.contains_any(c, R.PATH_SIGNS) | c.startswith("/")), 0.15).otherwise(0.0) + F.when(c.contains('"') | c.contains("'") | c.contains("`"), 0.1).otherwise(0.0) - F.when(vague > 0.3, 0.15).otherwise(0.0)
    return o.select("obs_id", r6(S.clamp(score)).alias("specificity"))


@query(
    "node_symbols",
    f"with {NODES}, {HIER}, k as (select space_id, node_id, path, string_split(path, '#')[1] file_ from nodes_m where role_type = 'code'), f as (select a.node_id, b.node_id symbol, row_number() over (partition by a.node_id order by b.node_id) r from k a join k b on a.space_id = b.space_id and a.file_ = b.file_ and contains(b.path, '#') where a.node_id <> b.node_id) select node_id, symbol from f where r <= 20",
)
def node_symbols(spark, d):
    """The first 20 symbols in the file of each code node."""
    k = T.nodes(spark, d).where("role_type = 'code'").select("space_id", "node_id", "path", F.split("path", "#")[0].alias("file"))
    b = k.where(F.col("path").contains("#")).select("space_id", "file", F.col("node_id").alias("symbol"))
    f = k.join(b, ["space_id", "file"]).where("node_id <> symbol").withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy("symbol"))).where("r <= 20")
    return f.select("node_id", "symbol")


@query(
    "recall_filter",
    "select distinct obs_id from observations where created_at >= timestamp '2025-03-01' and created_at < timestamp '2025-09-01' and obs_type in ('decision', 'correction', 'learning') and session_id is not null",
)
def recall_filter(spark, d):
    """Creation time, types and session together."""
    o = T.table(spark, d, "observations").where("created_at >= timestamp '2025-03-01' and created_at < timestamp '2025-09-01'")
    return o.where(F.col("obs_type").isin("decision", "correction", "learning") & F.col("session_id").isNotNull()).select("obs_id").distinct()


@query("keyword_cleaning", f"with {QL}, c as (select query_id, query_text, trim(regexp_replace(regexp_replace(query_text, '(?i)recent changes to|recent|latest|updated', '', 'g'), '\\s+', ' ', 'g')) t from ql) select query_id, case when t = '' then query_text else t end as cleaned from c")
def keyword_cleaning(spark, d):
    """Time words off, blanks collapsed, never empty."""
    t = F.trim(F.regexp_replace(F.regexp_replace("query_text", "(?i)recent changes to|recent|latest|updated", ""), r"\s+", " "))
    return queries(spark, d).select("query_id", F.when(t == "", F.col("query_text")).otherwise(t).alias("cleaned"))
