"""Retrieval from the queries themselves: vector and text search, hints, fusion, expansion, activation, gated scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from memloom.functions import rules as R, scoring as S, vec as V
from memloom.operators import search, spread
from memloom.plans.base import EDGES, NOW_SQL, query, r6
from memloom.plans.retrieval import ATT_ACT, CONF, EFF, VECTORS, confidence
from memloom.plans.text import CLASS_SQL, CODE_SQL, query_class
from memloom.sources import tables as T
from memloom.sources.shared import materialize
from memloom.sources.small import join_small

SPLIT = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
PICK = lambda i: "case c " + " ".join(f"when '{k}' then {v[i]}" for k, v in R.HINTS.items()) + " end"
LOW = "lower(query_text)"
ARCH_SQL = R.contains_any_sql(LOW, R.ARCHITECTURE)
SOFT_SQL = R.contains_any_sql(LOW, R.SOFT_TEMPORAL)

#: The observations whose number is divisible by 100, as queries against all of their space.
LIVE = f"""{VECTORS},
ob_l as (select distinct obs_id, space_id, node_id, case when trim(content) <> '' then content else summary end txt from observations where space_id is not null and node_id is not null),
lq as (select obs_id query_id, space_id, txt query_text from ob_l where substr(obs_id, 2)::bigint % 100 = 0),
lk as (select *, {CLASS_SQL} c, coalesce({CODE_SQL}, false) code, coalesce({ARCH_SQL}, false) arch, coalesce({SOFT_SQL}, false) soft from lq),
lh as (select *, {PICK(0)} seeds, {PICK(1)} hops, {PICK(2)}::double vw, {PICK(3)}::double tw from lk),
lv as (select * from (select *, row_number() over (partition by query_id order by sim desc, obs_id) vr from (select q.obs_id query_id, c.obs_id, round(list_cosine_similarity(q.v, c.v), 6) + 0 sim from vecs q join vecs c on q.space_id = c.space_id and q.obs_id <> c.obs_id where substr(q.obs_id, 2)::bigint % 100 = 0)) where vr <= 200),
ldoc as (select space_id, obs_id, {SPLIT.format('txt')} t from ob_l), lst as (select space_id, count(*) n, avg(coalesce(len(t), 0)) al from ldoc group by 1),
lask as (select distinct query_id, space_id, unnest({SPLIT.format('query_text')}) term from lq),
ltf as (select space_id, obs_id, l, term, count(*) tf from (select space_id, obs_id, len(t) l, unnest(t) term from ldoc) group by all), ldf as (select space_id, term, count(*) df from ltf group by all),
lsc as (select query_id, obs_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / al))), 6) + 0 score from lask join ltf using (space_id, term) join ldf using (space_id, term) join lst using (space_id) where query_id <> obs_id group by all),
lt as (select * from (select *, row_number() over (partition by query_id order by score desc, obs_id) tr from lsc) where tr <= 100),
lb as (select coalesce(lv.query_id, lt.query_id) query_id, coalesce(lv.obs_id, lt.obs_id) obs_id, sim vsim, vr, tr from lv full outer join lt on lv.query_id = lt.query_id and lv.obs_id = lt.obs_id),
fu as (select lb.query_id, o.node_id, vr, tr, coalesce(vw / (60 + vr), 0) + coalesce(tw / (60 + tr), 0) rrf, case when vr is not null and tr is not null then least(1.0, vsim + 0.05) when vr is not null then vsim else greatest(0.4, 0.95 - 0.02 * (tr - 1)) end sim,
  row_number() over (partition by lb.query_id order by round(coalesce(vw / (60 + vr), 0) + coalesce(tw / (60 + tr), 0), 12) desc, o.node_id) fr, seeds, hops, code, arch, soft from lb join lh using (query_id) join ob_l o using (obs_id))"""


def asked(texts: DataFrame) -> DataFrame:
    """(query_id, space_id, query_text) with what the text asks for: class, hints, gates, soft time."""
    q = texts.where(F.substring("obs_id", 2, 20).cast("long") % 100 == 0).select(F.col("obs_id").alias("query_id"), "space_id", F.col("text").alias("query_text")).distinct()
    low = F.lower("query_text")
    code = R.contains_any(low, R.CODE) | F.exists(F.array(*[F.lit(w) for w in R.CODE_EDGES]), lambda w: low.endswith(w) | low.startswith(F.concat(w, F.lit(" "))))
    table = F.create_map(*[x for name, v in R.HINTS.items() for x in (F.lit(name), F.struct(*[F.lit(y).alias(n) for n, y in zip(("seeds", "hops", "vw", "tw"), v)]))])
    no = F.lit(False)
    q = q.withColumn("h", table[query_class(F.col("query_text"))]).withColumn("code", F.coalesce(code, no)).withColumn("arch", F.coalesce(R.contains_any(low, R.ARCHITECTURE), no)).withColumn("soft", F.coalesce(R.contains_any(low, R.SOFT_TEMPORAL), no))
    return q.select("query_id", "space_id", "query_text", "h.*", "code", "arch", "soft")


def candidates(spark, d) -> DataFrame:
    """200 by vector and 100 by text of every query, fused with the weights its class asks for."""
    stored = T.table(spark, d, "observations").where("space_id is not null")
    o = materialize(stored.where("node_id is not null").select("obs_id", "space_id", "node_id", T.text_of().alias("text")).distinct(), "texts")
    q = materialize(asked(o), "asked")
    # Not distinct: the search counts what was delivered again once.
    v = materialize(stored.where(V.usable(F.col("embedding"))).select("space_id", F.col("obs_id").alias("id"), F.col("embedding").alias("vec")), "vectors")
    near = search.vector_top_k(v.where(F.substring("id", 2, 20).cast("long") % 100 == 0), v, 200).select("query_id", F.col("node_id").alias("obs_id"), F.col("sim").alias("vsim"), F.col("rank").alias("vr"))
    docs = o.select("space_id", F.col("obs_id").alias("node_id"), "text")
    # One more than asked for, as a query finds its own text too.
    hits = search.bm25_top_k(q.select("space_id", "query_id", F.col("query_text").alias("text")), docs, 101).where("query_id <> node_id")
    w = Window.partitionBy("query_id")
    text = hits.withColumn("tr", F.row_number().over(w.orderBy("rank"))).where("tr <= 100").select("query_id", F.col("node_id").alias("obs_id"), "tr")
    both = join_small(near.join(text, ["query_id", "obs_id"], "full_outer"), q.drop("space_id", "query_text"), "query_id", "inner").join(o.select("obs_id", "node_id"), "obs_id")
    rrf = F.coalesce(F.col("vw") / (60 + F.col("vr")), F.lit(0.0)) + F.coalesce(F.col("tw") / (60 + F.col("tr")), F.lit(0.0))
    sim = S.fused_similarity(F.col("vsim"), F.col("vr").isNotNull(), F.col("tr").isNotNull(), F.col("tr"))
    both = both.withColumn("rrf", rrf).withColumn("sim", sim)
    return both.withColumn("fr", F.row_number().over(w.orderBy(F.round("rrf", 12).desc(), "node_id")))


@query("live_candidates", f"with {LIVE} select query_id, node_id, vr as vector_rank, tr as text_rank, fr as fused_rank, round(rrf, 9) as rrf, round(sim, 6) as sim from fu")
def live_candidates(spark, d):
    lng = lambda c: F.col(c).cast("long")
    return candidates(spark, d).select("query_id", "node_id", lng("vr").alias("vector_rank"), lng("tr").alias("text_rank"), lng("fr").alias("fused_rank"), F.round("rrf", 9).alias("rrf"), r6("sim").alias("sim"))


HOPS = """seed as (select query_id, node_id, hops from fu where fr <= seeds),
h1 as (select query_id, src, rel_type, dst, eff, hops from (select *, row_number() over (partition by query_id order by weight desc, src, dst, rel_type) g from (select s.query_id, s.hops, e.*, row_number() over (partition by s.query_id, e.src order by weight desc, dst, rel_type) r
  from seed s join ef e on e.src = s.node_id where rel_type in ('ASSOCIATED_WITH', 'GENERALIZES', 'ABSTRACTS_TO')) where r <= 50) where g <= 5000),
fr1 as (select distinct query_id, dst node_id from h1 where hops > 1 and not exists (select 1 from seed s where s.query_id = h1.query_id and s.node_id = h1.dst)),
h2 as (select query_id, src, rel_type, dst, eff from (select *, row_number() over (partition by query_id order by weight desc, src, dst, rel_type) g from (select s.query_id, e.*, row_number() over (partition by s.query_id, e.src order by weight desc, dst, rel_type) r
  from fr1 s join ef e on e.src = s.node_id where rel_type = 'CO_ACTIVATED_WITH') where r <= 50) where g <= 5000),
ex as (select distinct query_id, src, rel_type, dst, eff from (select query_id, src, rel_type, dst, eff from h1 union all select * from h2))"""

#: What a class of query does to the weights of similarity, activation and upper layers.
GATES = {"code": (1.3, 0.7, 0.85), "architecture": (0.85, 1.2, 1.25), "generic": (1.0, 1.0, 1.0)}
#: Decay a day at the base by kind of source, and the factor a code query gives a kind of file.
DECAY = {"documentation": 0.01, "markdown": 0.01, "config": 0.03, "configuration": 0.03, "conversation": 0.10, "conversation_observation": 0.10, "changelog": 0.08}
LANGUAGES = ["python", "go", "rust", "java", "typescript", "javascript", "c", "cpp", "csharp", "ruby", "php", "scala", "kotlin", "swift"]
NOT_CODE = {"config": 0.5, "configuration": 0.5, "documentation": 0.7, "markdown": 0.7}

GATE = lambda i: f"case when code then {GATES['code'][i]} when arch then {GATES['architecture'][i]} else {GATES['generic'][i]} end"
RHO_SQL = "case when layer = 1 then 0.02 when layer > 1 then 0.01 " + " ".join(f"when list_contains(tags, '{t}') then {v}" for t, v in DECAY.items()) + " else 0.05 end"
KIND_SQL = "case when len(list_filter(tags, lambda t: list_contains([" + ", ".join(f"'{t}'" for t in LANGUAGES) + "], t))) > 0 then 1.0 " + " ".join(f"when list_contains(tags, '{t}') then {v}" for t, v in NOT_CODE.items()) + " else 1.0 end"
RETRIEVE = f"""with {EDGES}, {EFF}, {LIVE}, {HOPS}, {ATT_ACT},
dg as (select query_id, node_id, count(*) deg from (select query_id, src node_id from ex union all select query_id, dst from ex) group by 1, 2),
cd as (select f.*, a.act, coalesce(g.deg, 0) deg, n.layer, n.confidence, n.tags, greatest(0.0, date_diff('microsecond', n.at_, {NOW_SQL}) / 86400000000.0) as days, least(3, count(*) over (partition by f.query_id, regexp_replace(n.path, '/[^/]*$', '')) - 1) dup
  from fu f join nodes_m n on n.node_id = f.node_id join a2 a on a.query_id = f.query_id and a.node_id = f.node_id left join dg g on g.query_id = f.query_id and g.node_id = f.node_id where not n.is_archived),
co as (select *, 0.55 * {GATE(0)} * sim + 0.30 * {GATE(1)} * act core from cd),
sc as (select *, (core + 0.10 * case when soft then 3 else 1 end * exp(-({RHO_SQL}) * days) + 0.05 * confidence + case when layer > 0 then ({GATE(2)} - 1.0) * core else 0.0 end - case when layer = 0 then 0.08 * ln(1 + deg) else 0 end - 0.12 * dup)
  * case when code then {KIND_SQL} when list_contains(tags, 'config') then 1.15 else 1.0 end score from co),
rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, node_id) r from sc),
tp as (select *, count(*) over (partition by query_id) n from rk where r <= 20),
cf as (select *, {CONF} pct from tp)
select query_id, node_id, r as rank, round(score, 6) as score, round(sim, 6) as sim, round(act, 6) as activation, pct as percentile, case when pct >= 90 then 'HIGH' when pct >= 40 then 'MEDIUM' else 'LOW' end as level from cf"""


def gate(i: int):
    return F.when(F.col("code"), GATES["code"][i]).when(F.col("arch"), GATES["architecture"][i]).otherwise(GATES["generic"][i])


def decay_rate(layer, tags):
    """By layer, at the base by the kind of source that the tags name."""
    rate = F.when(layer == 1, 0.02).when(layer > 1, 0.01)
    for tag, value in DECAY.items():
        rate = rate.when(F.array_contains(tags, tag), value)
    return rate.otherwise(0.05)


def kind_factor(tags):
    """What a code query makes of a file that is no code."""
    factor = F.when(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in LANGUAGES])), 1.0)
    for tag, value in NOT_CODE.items():
        factor = factor.when(F.array_contains(tags, tag), value)
    return factor.otherwise(1.0)


@query("retrieve_live", RETRIEVE)
def retrieve_live(spark, d, top_k: int = 20):
    """From text and vector to ranked nodes, for every observation whose number is divisible by 100.

    Both searches, the hints of the query's class (seeds, hops, weights), fusion,
    expansion from that many seeds over that many hops, attention activation, and
    the score with its gates, decay by tags, factor by kind of file and confidence.
    """
    cand = materialize(candidates(spark, d), "fused")
    edges = materialize(spread.with_effect(T.edges(spark, d), T.now()).select("src", "dst", "rel_type", "weight", "eff"), "effective")
    ex = materialize(spread.expand(cand.where("fr <= seeds").select("query_id", "node_id", "hops"), edges), "expansion")
    tags = F.col("tags")
    n = T.nodes(spark, d).where("not is_archived").select(
        "node_id", "layer", "confidence", decay_rate(F.col("layer"), tags).alias("rate"), S.days_between(T.now(), F.col("at")).alias("days"), kind_factor(tags).alias("kind"),
        F.when(F.array_contains(tags, "config"), 1.15).otherwise(1.0).alias("config"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"),
    )
    c = spread.activate_tiles(cand.select("query_id", "node_id", "fr", "sim", "code", "arch", "soft").join(n, "node_id", "left"), ex, cand.where("fr = 1").count())
    c = c.withColumn("core", S.ALPHA * gate(0) * F.col("sim") + S.BETA * gate(1) * F.col("act"))
    layer = F.col("layer")
    recent = F.when(F.col("soft"), 3).otherwise(1) * F.exp(-F.col("rate") * F.col("days"))
    score = F.col("core") + S.GAMMA * recent + S.DELTA * F.col("confidence") + F.when(layer > 0, (gate(2) - 1.0) * F.col("core")).otherwise(0.0) - F.when(layer == 0, S.PHI * F.log(1 + F.col("deg"))).otherwise(0.0) - S.KAPPA * F.col("dup")
    c = c.withColumn("score", score * F.when(F.col("code"), F.col("kind")).otherwise(F.col("config")))
    order = [F.round("score", 9).desc(), "node_id"]
    top = c.select("query_id", "node_id", "score", "sim", "act").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top_k)
    out = confidence(top.drop("rank"), "query_id", order)
    return out.select("query_id", "node_id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"), r6("sim").alias("sim"), r6("act").alias("activation"), "percentile", "level")
