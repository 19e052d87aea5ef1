"""Graph statistics, health, distributions and trends."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from memloom.functions import scoring as S
from memloom.plans.base import ASSOC, EDGES, HIER, LEARNED, NODES, NOW_SQL, RESULTS, query, r6
from memloom.sources import tables as T


@query("scan_active_nodes", f"with {NODES} select space_id, node_id, path, layer, confidence from nodes_m where not is_archived")
def scan_active_nodes(spark, d):
    return T.nodes(spark, d).where("not is_archived").select("space_id", "node_id", "path", "layer", "confidence")


@query("layer_counts", f"with {NODES} select space_id, layer, count(*) as nodes from nodes_m where not is_archived group by all")
def layer_counts(spark, d):
    return T.nodes(spark, d).where("not is_archived").groupBy("space_id", "layer").agg(F.count("*").alias("nodes"))


@query("edge_type_counts", f"with {EDGES} select rel_type, count(*) as edges, round(avg(weight), 6) as avg_weight, round(max(weight), 6) as max_weight from edges_m group by rel_type")
def edge_type_counts(spark, d):
    return T.edges(spark, d).groupBy("rel_type").agg(F.count("*").alias("edges"), r6(F.avg("weight")).alias("avg_weight"), r6(F.max("weight")).alias("max_weight"))


def degrees(edges):
    """(node_id, degree) over both directions."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


DEGREES = "deg as (select node_id, count(*) degree from (select src node_id from edges_m union all select dst from edges_m) group by 1)"


@query(
    "hub_nodes",
    f"with {EDGES}, {DEGREES} select space_id, node_id, degree, r as rank from (select n.space_id, n.node_id, degree, row_number() over (partition by n.space_id order by degree desc, n.node_id) r from nodes_m n join deg using (node_id)) where r <= 10",
)
def hub_nodes(spark, d):
    ranked = T.nodes(spark, d).select("space_id", "node_id").join(degrees(T.edges(spark, d)), "node_id")
    w = Window.partitionBy("space_id").orderBy(F.desc("degree"), "node_id")
    return ranked.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10")


@query(
    "orphan_nodes",
    f"with {EDGES} select space_id, node_id, layer from nodes_m n where not exists (select 1 from edges_m e where e.src = n.node_id) and not exists (select 1 from edges_m e where e.dst = n.node_id)",
)
def orphan_nodes(spark, d):
    linked = T.edges(spark, d).select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return T.nodes(spark, d).select("space_id", "node_id", "layer").join(linked, "node_id", "left_anti")


SPACE_STATS = f"""with {EDGES}, {DEGREES},
obs as (select node_id, count(distinct obs_id) observations, max(case when len(embedding) = 64 then 1 else 0 end) embedded from observations group by 1),
per as (select n.space_id, count(*) nodes, coalesce(sum(o.observations), 0)::bigint observations, sum(coalesce(o.embedded, 0))::bigint embedded, avg(coalesce(g.degree, 0)) avg_degree,
  max(coalesce(g.degree, 0)) max_degree, sum(case when g.degree is null then 1 else 0 end)::bigint orphans,
  sum(case when n.created_at >= {NOW_SQL} - interval 90 day then 1 else 0 end)::bigint created_90d, sum(case when n.created_at >= {NOW_SQL} - interval 180 day then 1 else 0 end)::bigint created_180d
  from nodes_m n left join deg g using (node_id) left join obs o using (node_id) group by 1),
le as (select space_id, count(*) learned_edges, avg(weight) avg_w, max(weight) max_w from edges_m where rel_type = 'CO_ACTIVATED_WITH' group by 1),
stats as (select per.*, round(embedded / nodes, 6) as coverage, coalesce(learned_edges, 0)::bigint as learned_edges, round(coalesce(avg_w, 0), 6) as avg_learned_weight, round(coalesce(max_w, 0), 6) as max_learned_weight
  from per left join le using (space_id))
"""


def space_stats_frame(spark, d):
    edges = T.edges(spark, d)
    obs = T.table(spark, d, "observations").groupBy("node_id").agg(F.count_distinct("obs_id").alias("observations"), F.max(F.when(F.size("embedding") == 64, 1).otherwise(0)).alias("embedded"))
    n = T.nodes(spark, d).join(degrees(edges), "node_id", "left").join(obs, "node_id", "left")
    recent = lambda days: F.sum(F.when(F.col("created_at") >= T.now() - F.expr(f"interval {days} days"), 1).otherwise(0))
    per = n.groupBy("space_id").agg(
        F.count("*").alias("nodes"), F.coalesce(F.sum("observations"), F.lit(0)).alias("observations"), F.sum(F.coalesce("embedded", F.lit(0))).alias("embedded"),
        F.avg(F.coalesce("degree", F.lit(0))).alias("avg_degree"), F.max(F.coalesce("degree", F.lit(0))).alias("max_degree"), F.sum(F.when(F.col("degree").isNull(), 1).otherwise(0)).alias("orphans"),
        recent(90).alias("created_90d"), recent(180).alias("created_180d"),
    )
    le = edges.where("rel_type = 'CO_ACTIVATED_WITH'").groupBy("space_id").agg(F.count("*").alias("le"), F.avg("weight").alias("aw"), F.max("weight").alias("mw"))
    return per.join(le, "space_id", "left").select(
        *per.columns, r6(F.col("embedded") / F.col("nodes")).alias("coverage"), F.coalesce("le", F.lit(0)).alias("learned_edges"),
        r6(F.coalesce("aw", F.lit(0.0))).alias("avg_learned_weight"), r6(F.coalesce("mw", F.lit(0.0))).alias("max_learned_weight"),
    )


@query("space_stats", SPACE_STATS + "select * replace (round(avg_degree, 6) as avg_degree) from stats")
def space_stats(spark, d):
    return space_stats_frame(spark, d).withColumn("avg_degree", r6("avg_degree"))


@query("space_health", SPACE_STATS + "select space_id, round(least(1.0, greatest(0.0, 0.4 * embedded / nodes + 0.3 * (1 - orphans / nodes) + 0.3 * least(1.0, created_90d / nodes))), 6) as health from stats")
def space_health(spark, d):
    s = space_stats_frame(spark, d)
    health = 0.4 * F.col("embedded") / F.col("nodes") + 0.3 * (1 - F.col("orphans") / F.col("nodes")) + 0.3 * F.least(F.lit(1.0), F.col("created_90d") / F.col("nodes"))
    return s.select("space_id", r6(S.clamp(health)).alias("health"))


DECAYED = f"""dec as (select *, greatest(0.0, date_diff('microsecond', updated_at, {NOW_SQL}) / 86400000000.0) as days from learned),
decw as (select *, weight * pow(1 - 0.05 / sqrt(greatest(1.0, evidence * surprise)), days) decayed from dec)"""


def decayed_edges(spark, d):
    e = T.learned_edges(spark, d).withColumn("days", S.days_between(T.now(), F.col("updated_at")))
    return e.withColumn("decayed", S.evidence_decay(F.col("weight"), F.col("days"), F.col("evidence") * F.col("surprise")))


@query(
    "learning_edge_stats",
    f"""with {LEARNED}, {DECAYED} select space_id, count(*) as edges, round(avg(weight), 6) as avg_weight, round(avg(decayed), 6) as avg_decayed, round(avg(evidence), 6) as avg_evidence, max(evidence) as max_evidence,
  round(avg(surprise), 6) as avg_surprise, max(surprise) as max_surprise, sum((evidence >= 5)::int)::bigint as strong, sum((surprise >= 1.5)::int)::bigint as surprising, sum((decayed < 0.05)::int)::bigint as below,
  round(avg(days), 6) as avg_days, round(max(days), 6) as max_days from decw group by space_id""",
)
def learning_edge_stats(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return decayed_edges(spark, d).groupBy("space_id").agg(
        F.count("*").alias("edges"), r6(F.avg("weight")).alias("avg_weight"), r6(F.avg("decayed")).alias("avg_decayed"), r6(F.avg("evidence")).alias("avg_evidence"), F.max("evidence").alias("max_evidence"),
        r6(F.avg("surprise")).alias("avg_surprise"), F.max("surprise").alias("max_surprise"), n(F.col("evidence") >= 5).alias("strong"), n(F.col("surprise") >= 1.5).alias("surprising"),
        n(F.col("decayed") < 0.05).alias("below"), r6(F.avg("days")).alias("avg_days"), r6(F.max("days")).alias("max_days"),
    )


DIST = f"""with {RESULTS}, ok as (select * from res where score is not null),
dist as (select query_id, count(*) n, avg(score) mean, stddev_pop(score) sd, min(score) lo, max(score) hi, quantile_cont(score, [0.1, 0.25, 0.5, 0.75, 0.9]) q, min(space_id) space_id, min(retrieved_at) at_ from ok group by 1)
"""


def distributions(spark, d):
    ok = T.results(spark, d).where("score is not null")
    return ok.groupBy("query_id").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.min("score").alias("lo"), F.max("score").alias("hi"),
        F.percentile("score", F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("q"), F.min("space_id").alias("space_id"), F.min("retrieved_at").alias("at"),
    )


@query("score_distribution", DIST + "select query_id, n, round(mean, 6) as mean, round(sd, 6) as sd, lo, hi, round(hi - lo, 6) as spread, round(q[1], 6) as q10, round(q[2], 6) as q25, round(q[3], 6) as q50, round(q[4], 6) as q75, round(q[5], 6) as q90 from dist")
def score_distribution(spark, d):
    x = distributions(spark, d)
    cut = {f"q{p}": r6(F.col("q")[i]) for i, p in enumerate((10, 25, 50, 75, 90))}
    return x.select("query_id", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), "lo", "hi", r6(F.col("hi") - F.col("lo")).alias("spread"), *[c.alias(k) for k, c in cut.items()])


@query(
    "distribution_alerts",
    DIST + """, al as (select query_id, list_filter([case when n > 5 and sd < 0.05 then 'low_stddev' end, case when n > 5 and mean < 0.4 then 'low_mean' end, case when n > 5 and hi - lo < 0.1 then 'compressed' end], lambda x: x is not null) a from dist)
select query_id, array_to_string(a, ',') as alerts from al where len(a) > 0""",
)
def distribution_alerts(spark, d):
    x, many = distributions(spark, d), F.col("n") > 5
    a = F.array_compact(F.array(F.when(many & (F.col("sd") < 0.05), "low_stddev"), F.when(many & (F.col("mean") < 0.4), "low_mean"), F.when(many & (F.col("hi") - F.col("lo") < 0.1), "compressed")))
    return x.withColumn("a", a).where(F.size("a") > 0).select("query_id", F.concat_ws(",", "a").alias("alerts"))


@query(
    "rolling_scores",
    DIST + "select query_id, round(avg(mean) over (partition by space_id order by at_, query_id rows between 99 preceding and current row), 6) as rolling_mean, count(*) over (partition by space_id order by at_, query_id rows between 99 preceding and current row) as in_window from dist",
)
def rolling_scores(spark, d):
    w = Window.partitionBy("space_id").orderBy("at", "query_id").rowsBetween(-99, 0)
    return distributions(spark, d).select("query_id", r6(F.avg("mean").over(w)).alias("rolling_mean"), F.count("*").over(w).alias("in_window"))


@query(
    "score_trend",
    DIST + """, k as (select space_id, mean, row_number() over (partition by space_id order by at_ desc, query_id desc) r, count(*) over (partition by space_id) c from dist),
h as (select space_id, round(avg(case when r <= c // 2 then mean end) - avg(case when r > c // 2 then mean end), 9) delta from k where c >= 2 group by 1)
select space_id, round(delta, 6) as delta, case when delta > 0.05 then 'improving' when delta < -0.05 then 'degrading' else 'stable' end as trend, abs(delta) >= 0.1 as significant from h""",
)
def score_trend(spark, d):
    """The newer half of a space's queries against the older half."""
    w = Window.partitionBy("space_id")
    k = distributions(spark, d).withColumn("r", F.row_number().over(w.orderBy(F.desc("at"), F.desc("query_id")))).withColumn("half", F.floor(F.count("*").over(w) / 2)).withColumn("c", F.count("*").over(w))
    h = k.where("c >= 2").groupBy("space_id").agg(F.round(F.avg(F.when(F.col("r") <= F.col("half"), F.col("mean"))) - F.avg(F.when(F.col("r") > F.col("half"), F.col("mean"))), 9).alias("delta"))
    trend = F.when(F.col("delta") > 0.05, "improving").when(F.col("delta") < -0.05, "degrading").otherwise("stable")
    return h.select("space_id", r6("delta").alias("delta"), trend.alias("trend"), (F.abs("delta") >= 0.1).alias("significant"))


OBS_FLAGS = "ob as (select distinct obs_id, space_id, obs_type, is_volatile, stability_score, pinned, created_at, tier, importance_score, surprise_score from observations)"


@query(
    "volatile_stats",
    f"with {OBS_FLAGS} select space_id, coalesce(is_volatile, false) as is_volatile, count(*) as observations, round(avg(stability_score), 6) as avg_stability, min(stability_score) as min_stability, max(stability_score) as max_stability from ob group by 1, 2",
)
def volatile_stats(spark, d):
    o = T.observations(spark, d, "space_id", "is_volatile", "stability_score")
    g = o.groupBy("space_id", F.coalesce("is_volatile", F.lit(False)).alias("is_volatile"))
    return g.agg(F.count("*").alias("observations"), r6(F.avg("stability_score")).alias("avg_stability"), F.min("stability_score").alias("min_stability"), F.max("stability_score").alias("max_stability"))


@query("review_stats", f"with {OBS_FLAGS} select obs_type, coalesce(tier, 'none') as tier, count(*) as observations from ob where obs_type is not null group by 1, 2")
def review_stats(spark, d):
    o = T.observations(spark, d, "obs_type", "tier").where("obs_type is not null")
    return o.groupBy("obs_type", F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("observations"))


@query(
    "edge_type_dominance",
    f"with {EDGES}, c as (select space_id, rel_type, count(*) n from edges_m group by 1, 2), t as (select *, sum(n) over (partition by space_id) total from c) select space_id, rel_type as dominant, round(n / total, 6) as share from t where n > 0.5 * total",
)
def edge_type_dominance(spark, d):
    c = T.edges(spark, d).groupBy("space_id", "rel_type").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("space_id")))
    return c.where("n > 0.5 * total").select("space_id", F.col("rel_type").alias("dominant"), r6(F.col("n") / F.col("total")).alias("share"))


ENTROPY = f"""with {LEARNED}, p as (select space_id, avg((evidence >= 5)::int) p from learned group by 1),
ent as (select space_id, round(case when p <= 0 or p >= 1 then 0.0 else -(p * log2(p) + (1 - p) * log2(1 - p)) end, 6) entropy from p)"""


def edge_entropy_frame(spark, d):
    p = T.learned_edges(spark, d).groupBy("space_id").agg(F.avg(F.when(F.col("evidence") >= 5, 1).otherwise(0)).alias("p"))
    e = F.when((F.col("p") <= 0) | (F.col("p") >= 1), 0.0).otherwise(-(F.col("p") * F.log2("p") + (1 - F.col("p")) * F.log2(1 - F.col("p"))))
    return p.select("space_id", r6(e).alias("entropy"))


@query("edge_weight_entropy", ENTROPY + " select space_id, entropy from ent")
def edge_weight_entropy(spark, d):
    return edge_entropy_frame(spark, d)


@query(
    "space_freshness",
    f"""select space_id, round(date_diff('microsecond', last_ingest_at, {NOW_SQL}) / 3600000000.0, 6) as hours, last_ingest_at is null or date_diff('microsecond', last_ingest_at, {NOW_SQL}) / 3600000000.0 >= 24 as stale, ingest_count from spaces""",
)
def space_freshness(spark, d):
    hours = (F.unix_micros(T.now()) - F.unix_micros("last_ingest_at")) / 3_600_000_000.0
    return T.table(spark, d, "spaces").select("space_id", r6(hours).alias("hours"), (F.col("last_ingest_at").isNull() | (hours >= 24)).alias("stale"), "ingest_count")


ASSESS = f"""{ENTROPY}, nn as (select distinct space_id, node_id from nodes), sim as (select node_id id from similar_nodes where score is not null and node_id <> similar_node_id union select similar_node_id from similar_nodes where score is not null and node_id <> similar_node_id union select src from learned),
orph as (select space_id, avg((s.id is null)::int) orphan_ratio, count(*) nodes from nn left join sim s on s.id = nn.node_id group by 1),
{DECAYED}, le as (select space_id, count(*) edges, sum((decayed < 0.05)::int) below from decw group by 1),
{OBS_FLAGS}, o as (select space_id, avg((coalesce(obs_type, '') = 'correction')::int) corrections, avg((not coalesce(is_volatile, false))::int) permanent from ob group by 1),
a as (select s.space_id, case when coalesce(edges, 0) < 1 then 0.3 when edges < 10000 then 0.6 when edges < 50000 then 0.9 else 0.7 end retrieval,
  greatest(0, 1.0 - case when orphan_ratio > 0.2 then 0.3 when orphan_ratio > 0.1 then 0.1 else 0 end - case when corrections > 0.15 then 0.2 else 0 end - case when date_diff('second', last_ingest_at, {NOW_SQL}) > 86400 then 0.2 else 0 end) memory,
  greatest(0, 1.0 - case when coalesce(edges, 0) > 0 and below / edges > 0.3 then 0.3 else 0 end - case when coalesce(entropy, 0) < 0.5 then 0.2 else 0 end) edge, coalesce(permanent, 0.5) task
  from spaces s left join orph using (space_id) left join le using (space_id) left join ent using (space_id) left join o using (space_id))
select space_id, round(retrieval, 6) as retrieval, round(memory, 6) as memory, round(edge, 6) as edge, round(task, 6) as task, round(0.30 * retrieval + 0.25 * memory + 0.25 * edge + 0.20 * task, 6) as overall from a"""


@query("self_assessment", ASSESS)
def self_assessment(spark, d):
    linked = T.similar_edges(spark, d).select("src", "dst").unionByName(T.learned_edges(spark, d).select("src", "dst")).select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("linked", F.lit(1))
    orph = T.table(spark, d, "nodes").select("space_id", "node_id").distinct().join(linked, "node_id", "left").groupBy("space_id").agg(F.avg(F.when(F.col("linked").isNull(), 1).otherwise(0)).alias("orphan_ratio"))
    le = decayed_edges(spark, d).groupBy("space_id").agg(F.count("*").alias("edges"), F.sum(F.when(F.col("decayed") < 0.05, 1).otherwise(0)).alias("below"))
    o = T.observations(spark, d, "space_id", "obs_type", "is_volatile").groupBy("space_id").agg(
        F.avg(F.when(F.col("obs_type") == "correction", 1).otherwise(0)).alias("corrections"), F.avg(F.when(F.coalesce("is_volatile", F.lit(False)), 0).otherwise(1)).alias("permanent")
    )
    s = T.table(spark, d, "spaces").join(orph, "space_id", "left").join(le, "space_id", "left").join(edge_entropy_frame(spark, d), "space_id", "left").join(o, "space_id", "left")
    edges = F.coalesce("edges", F.lit(0))
    zero = F.lit(0.0)
    phase = S.learning_phase(edges)
    retrieval = F.when(phase == "cold", 0.3).when(phase == "learning", 0.6).when(phase == "warm", 0.9).otherwise(0.7)
    age = F.unix_seconds(T.now()) - F.unix_seconds("last_ingest_at")
    memory = F.greatest(zero, 1.0 - F.when(F.col("orphan_ratio") > 0.2, 0.3).when(F.col("orphan_ratio") > 0.1, 0.1).otherwise(0.0) - F.when(F.col("corrections") > 0.15, 0.2).otherwise(0.0) - F.when(age > 86400, 0.2).otherwise(0.0))
    edge = F.greatest(zero, 1.0 - F.when((edges > 0) & (F.col("below") / edges > 0.3), 0.3).otherwise(0.0) - F.when(F.coalesce("entropy", zero) < 0.5, 0.2).otherwise(0.0))
    task = F.coalesce("permanent", F.lit(0.5))
    a = s.select("space_id", retrieval.alias("retrieval"), memory.alias("memory"), edge.alias("edge"), task.alias("task"))
    overall = 0.30 * F.col("retrieval") + 0.25 * F.col("memory") + 0.25 * F.col("edge") + 0.20 * F.col("task")
    return a.select("space_id", *[r6(c).alias(c) for c in ("retrieval", "memory", "edge", "task")], r6(overall).alias("overall"))


@query("learning_phase", f"with {LEARNED}, c as (select space_id, count(*) n from learned group by 1) select s.space_id, coalesce(n, 0)::bigint as edges, case when coalesce(n, 0) < 1 then 'cold' when n < 10000 then 'learning' when n < 50000 then 'warm' else 'saturated' end as phase from spaces s left join c using (space_id)")
def learning_phase(spark, d):
    n = T.learned_edges(spark, d).groupBy("space_id").agg(F.count("*").alias("n"))
    e = F.coalesce("n", F.lit(0))
    return T.table(spark, d, "spaces").join(n, "space_id", "left").select("space_id", e.alias("edges"), S.learning_phase(e).alias("phase"))


@query(
    "hierarchy_counts",
    f"with {NODES}, {HIER} select rel_type, count(distinct src) as children, count(distinct dst) as parents, count(*) as edges from hier group by 1",
)
def hierarchy_counts(spark, d):
    return T.hierarchy_edges(spark, d).groupBy("rel_type").agg(F.count_distinct("src").alias("children"), F.count_distinct("dst").alias("parents"), F.count("*").alias("edges"))


@query(
    "stale_edge_stats",
    f"with {NODES}, {ASSOC}, x as (select a.space_id, s.updated_at > a.updated_at or t.updated_at > a.updated_at as stale from assoc a join nodes_m s on s.node_id = a.src join nodes_m t on t.node_id = a.dst) select space_id, count(*) as edges, sum(stale::int)::bigint as stale from x group by 1",
)
def stale_edge_stats(spark, d):
    n = T.nodes(spark, d).select("node_id", "updated_at")
    e = T.similar_edges(spark, d).select("space_id", "src", "dst", F.col("updated_at").alias("linked"))
    x = e.join(n.select(F.col("node_id").alias("src"), F.col("updated_at").alias("u1")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("updated_at").alias("u2")), "dst")
    return x.groupBy("space_id").agg(F.count("*").alias("edges"), F.sum(F.when((F.col("u1") > F.col("linked")) | (F.col("u2") > F.col("linked")), 1).otherwise(0)).alias("stale"))
