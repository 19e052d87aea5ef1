"""Composite surprise, corrections, requests, evidence, symbol search, deletion, transfer of edges, themes and summaries."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from memloom.plans.base import EDGES, NODES, QUERIES, query, r6
from memloom.plans.memory import OBS
from memloom.sources import tables as T
from memloom.sources.small import join_small

TEXT_SQL = "coalesce(case when trim(content) <> '' then content else summary end, '')"


@query(
    "surprise_scores",
    """with t as @term_novelty@, c as @correction_scores@, e as @embedding_novelty@, o as (select distinct obs_id from observations)
select obs_id, round(least(1.0, 0.4 * coalesce(c.correction, 0) + 0.25 * coalesce(t.novelty, 0) + 0.25 * coalesce(e.novelty, 0)), 6) as surprise from o left join t using (obs_id) left join c using (obs_id) left join e using (obs_id)""",
)
def surprise_scores(spark, d):
    """Correction, unusual terms and distance from the latest; contradiction counts nothing as nothing measures it."""
    part = lambda name, col, to: QUERIES[name](spark, d).select("obs_id", F.col(col).alias(to))
    o = T.observations(spark, d).join(part("term_novelty", "novelty", "t"), "obs_id", "left").join(part("correction_scores", "correction", "c"), "obs_id", "left").join(part("embedding_novelty", "novelty", "e"), "obs_id", "left")
    zero = F.lit(0.0)
    return o.select("obs_id", r6(F.least(F.lit(1.0), 0.4 * F.coalesce("c", zero) + 0.25 * F.coalesce("t", zero) + 0.25 * F.coalesce("e", zero))).alias("surprise"))


@query(
    "explicit_corrections",
    f"""with {OBS}, s as (select obs_id, session_id, obs_type, surprise_score, {TEXT_SQL} txt, lag({TEXT_SQL}) over (partition by session_id order by coalesce(created_at, timestamp '1970-01-01'), obs_id) was from ob where session_id is not null)
select obs_id, 'CORRECTION: Incorrect: ' || was || ' | Correct: ' || txt as content, greatest(0.9, coalesce(surprise_score, 0)) as surprise from s where obs_type = 'correction' and was is not null""",
)
def explicit_corrections(spark, d):
    """A correction of a session against what was said before it, at a surprise of 0.9 or more; the first of a session corrects nothing."""
    o = T.observations(spark, d, "session_id", "obs_type", "content", "summary", "surprise_score", "created_at").where("session_id is not null").withColumn("txt", F.coalesce(T.text_of(), F.lit("")))
    order = [F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp")), "obs_id"]
    s = o.withColumn("was", F.lag("txt").over(Window.partitionBy("session_id").orderBy(*order))).where("obs_type = 'correction' and was is not null")
    return s.select("obs_id", F.concat(F.lit("CORRECTION: Incorrect: "), "was", F.lit(" | Correct: "), "txt").alias("content"), F.greatest(F.lit(0.9), F.coalesce("surprise_score", F.lit(0.0))).alias("surprise"))


TIMES = [("t0", "2026-01-15", None), ("t1", None, "2026-02-01T10:00:00Z"), ("t2", "2026-01-15", "2026-02-01"), ("t3", "yesterday", None), ("t4", None, None), ("t5", "2026-13-45", "2026-03-01"), ("t6", "2026-01-15T08:30:00+02:00", ""), ("t7", "15.01.2026", "soon")]
STAMP = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2}))?$"
_lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v + "'"
_values = lambda rows: ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)


def _when_sql(c: str) -> str:
    return f"case when regexp_matches({c}, '{STAMP}') then try_cast(case when length({c}) = 10 then {c} || 'T00:00:00Z' else {c} end as timestamptz) at time zone 'UTC' end"


@query(
    "explicit_times",
    f"""with r(request_id, a, b) as (values {_values(TIMES)}), t as (select request_id, a, b, {_when_sql('a')} x, {_when_sql('b')} y from r)
select request_id, case when x is null and y is null then 'none' else 'hard' end as mode, strftime(x, '%Y-%m-%d %H:%M:%S') as after_at, strftime(y, '%Y-%m-%d %H:%M:%S') as before_at,
  case when x is null and y is null then 0.0::double else 1.0::double end as confidence, concat_ws(', ', case when x is not null then 'after ' || a end, case when y is not null then 'before ' || b end) as description from t""",
)
def explicit_times(spark, d):
    """Bounds a request states itself: a hard intent that is sure; what is no date or time with zone is ignored."""
    t = spark.createDataFrame(TIMES, "request_id string, a string, b string")
    at = lambda c: F.when(F.col(c).rlike(STAMP), F.expr(f"try_cast({c} as timestamp)"))
    t = t.withColumn("x", at("a")).withColumn("y", at("b"))
    none = F.col("x").isNull() & F.col("y").isNull()
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    said = F.concat_ws(", ", F.when(F.col("x").isNotNull(), F.concat(F.lit("after "), "a")), F.when(F.col("y").isNotNull(), F.concat(F.lit("before "), "b")))
    return t.select("request_id", F.when(none, "none").otherwise("hard").alias("mode"), text("x").alias("after_at"), text("y").alias("before_at"), F.when(none, 0.0).otherwise(1.0).alias("confidence"), said.alias("description"))


REQUESTS = [("r0", "s-a", "auth", False, None, None, None), ("r1", "", "auth", False, 10, 5, 2), ("r2", None, None, True, 1000, 100, 5), ("r3", "s-a", None, False, 0, 101, 6), ("r4", "x" * 257, "", False, 1001, 0, -1), ("r5", "s-a", "q", True, 1, 1, 0)]


@query(
    "request_checks",
    f"""with r(request_id, space_id, query_text, has_embedding, candidate_k, top_k, hop_depth) as (values {_values(REQUESTS)})
select request_id, concat_ws(', ', case when coalesce(space_id, '') = '' then 'space_id: required' when length(space_id) > 256 then 'space_id: max=256' end, case when coalesce(query_text, '') = '' and not has_embedding then 'query_text: required_without' end,
  case when candidate_k <> 0 and candidate_k < 1 then 'candidate_k: min=1' when candidate_k > 1000 then 'candidate_k: max=1000' end, case when top_k <> 0 and top_k < 1 then 'top_k: min=1' when top_k > 100 then 'top_k: max=100' end,
  case when hop_depth < 0 then 'hop_depth: min=0' when hop_depth > 5 then 'hop_depth: max=5' end) as faults from r""",
)
def request_checks(spark, d):
    """What is wrong with a retrieval request; nothing gives an empty text.  Numbers left out or zero take their defaults."""
    r = spark.createDataFrame(REQUESTS, "request_id string, space_id string, query_text string, has_embedding boolean, candidate_k int, top_k int, hop_depth int")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""

    def span(c: str, low: int, high: int, free: int | None) -> Column:
        below = F.col(c) < low if free is None else (F.col(c) != free) & (F.col(c) < low)
        return F.when(below, f"{c}: min={low}").when(F.col(c) > high, f"{c}: max={high}")

    space = F.when(empty("space_id"), "space_id: required").when(F.char_length("space_id") > 256, "space_id: max=256")
    text = F.when(empty("query_text") & ~F.col("has_embedding"), "query_text: required_without")
    return r.select("request_id", F.concat_ws(", ", space, text, span("candidate_k", 1, 1000, 0), span("top_k", 1, 100, 0), span("hop_depth", 0, 5, None)).alias("faults"))


@query(
    "evidence_metrics",
    """with r as (select distinct query_id, node_id from retrieve_results where node_id is not null), s as (select node_id, count(*) n from @node_symbols@ group by 1)
select query_id, count(*) as results, count(s.n) as with_evidence, coalesce(sum(s.n), 0)::bigint as symbols, round(count(s.n) / count(*), 6) as compliance_rate, round(case when count(s.n) > 0 then sum(s.n) / count(s.n) else 0 end, 6) as avg_symbols from r left join s using (node_id) group by 1""",
)
def evidence_metrics(spark, d):
    """Of each query's results, those whose file defines symbols."""
    s = QUERIES["node_symbols"](spark, d).groupBy("node_id").agg(F.count("*").alias("n"))
    r = T.results(spark, d).select("query_id", "node_id").distinct().join(s, "node_id", "left")
    a = r.groupBy("query_id").agg(F.count("*").alias("results"), F.count("n").alias("with_evidence"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))
    rate = F.col("with_evidence") / F.col("results")
    return a.select("query_id", "results", "with_evidence", "symbols", r6(rate).alias("compliance_rate"), r6(F.when(F.col("with_evidence") > 0, F.col("symbols") / F.col("with_evidence")).otherwise(0.0)).alias("avg_symbols"))


#: Symbol searches: free text goes before file, file before kind, kind before name; * in a name stands for anything.
SEARCHES = [("s0", "prune", None, "class", None, None), ("s1", None, None, "function", None, True), ("s2", None, None, None, "load*", None), ("s3", None, None, None, "mergeLayer", None), ("s4", None, "zz/none.go", "function", None, None), ("s5", None, None, "class", "load*", False)]


def _match_sql(q, file, kind, name, exported) -> str:
    by = f"contains(lower(name), '{q}')" if q else f"file_path = '{file}'" if file else f"kind = '{kind}'" if kind else f"regexp_full_match(name, '{name.replace('*', '.*')}')"
    return by + ("" if exported is None else f" and exported = {str(exported).lower()}")


@query(
    "symbol_search",
    "with s as @code_symbols@, m as (" + " union all ".join(f"select '{i}' as search_id, space_id, file_path, line, kind, name, exported from s where {_match_sql(*rest)}" for i, *rest in SEARCHES) + """)
select search_id, space_id, file_path, line, kind, name, r as rank from (select *, row_number() over (partition by search_id order by exported desc, name, space_id, file_path, line) r from m) where r <= 50""",
)
def symbol_search(spark, d):
    """Symbols by text, file, kind or name, the exported first, 50 of each search; one scan answers all searches."""
    s = QUERIES["code_symbols"](spark, d).select("space_id", "file_path", "line", "kind", "name", "exported")

    def match(q, file, kind, name, exported) -> Column:
        by = F.lower("name").contains(q) if q else F.col("file_path") == file if file else F.col("kind") == kind if kind else F.col("name").rlike("^" + name.replace("*", ".*") + "$")
        return by if exported is None else by & (F.col("exported") == exported)

    hit = F.filter(F.array(*[F.when(match(*rest), F.lit(i)) for i, *rest in SEARCHES]), lambda x: x.isNotNull())
    m = s.withColumn("search_id", F.explode(hit))
    order = [F.desc("exported"), "name", "space_id", "file_path", "line"]
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("search_id").orderBy(*order)).cast("long")).where("rank <= 50").select("search_id", "space_id", "file_path", "line", "kind", "name", "rank")


@query("json_props", "select event_type, count(*) as events, count(try_cast(json_extract_string(props, '$.k') as bigint)) as with_k, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as total from events group by 1")
def json_props(spark, d):
    """A number out of a JSON column; what is no JSON or has no such field is null."""
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return T.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count(k).alias("with_k"), F.sum(k).alias("total"))


@query(
    "deleted_nodes",
    f"""with {EDGES}, gone as (select distinct space_id, node_id from nodes_m where is_archived), hit as (select space_id, rel_type from edges_m e where exists (select 1 from gone g where g.node_id = e.src) or exists (select 1 from gone g where g.node_id = e.dst))
select g.space_id, g.nodes, coalesce(h.edges, 0) as edges, coalesce(h.learned, 0) as learned from (select space_id, count(*) nodes from gone group by 1) g left join (select space_id, count(*) edges, count(*) filter (where rel_type = 'CO_ACTIVATED_WITH') learned from hit group by 1) h using (space_id)""",
)
def deleted_nodes(spark, d):
    """What deleting the archived nodes of each space takes with it: the nodes, their edges on either side, the learned among them."""
    gone = T.nodes(spark, d).where("is_archived").select("space_id", "node_id").distinct()
    ends = gone.select("node_id").distinct()
    e = T.edges(spark, d).select("space_id", "src", "dst", "rel_type")
    flag = lambda c: ends.select(F.col("node_id").alias(c), F.lit(True).alias(c + "_gone"))
    hit = join_small(join_small(e, flag("src"), "src"), flag("dst"), "dst").where("src_gone or dst_gone")
    counts = hit.groupBy("space_id").agg(F.count("*").alias("edges"), F.count_if(F.col("rel_type") == "CO_ACTIVATED_WITH").alias("learned"))
    zero = F.lit(0).cast("long")
    return gone.groupBy("space_id").agg(F.count("*").alias("nodes")).join(counts, "space_id", "left").select("space_id", "nodes", F.coalesce("edges", zero).alias("edges"), F.coalesce("learned", zero).alias("learned"))


@query(
    "merged_edges",
    f"""with {EDGES}, m as @merge_redundant@, t as (select coalesce(a.survivor, e.src) src, coalesce(b.survivor, e.dst) dst, e.rel_type, e.weight, e.evidence from edges_m e left join m a on a.node_id = e.src left join m b on b.node_id = e.dst where a.survivor is not null or b.survivor is not null)
select src, dst, rel_type, round(max(weight), 6) as weight, sum(evidence)::bigint as evidence, count(*) as merged from t where src <> dst group by 1, 2, 3""",
)
def merged_edges(spark, d):
    """The edges of nodes that merge, at their survivors: the heaviest weight, all evidence; what would join a node to itself is dropped."""
    m = QUERIES["merge_redundant"](spark, d)
    e = T.edges(spark, d).select("src", "dst", "rel_type", "weight", "evidence")
    to = lambda c: m.select(F.col("node_id").alias(c), F.col("survivor").alias("to_" + c))
    t = e.join(to("src"), "src", "left").join(to("dst"), "dst", "left").where("to_src is not null or to_dst is not null")
    t = t.select(F.coalesce("to_src", "src").alias("src"), F.coalesce("to_dst", "dst").alias("dst"), "rel_type", "weight", "evidence").where("src <> dst")
    return t.groupBy("src", "dst", "rel_type").agg(r6(F.max("weight")).alias("weight"), F.sum("evidence").alias("evidence"), F.count("*").alias("merged"))


@query(
    "observation_themes",
    f"""with {OBS}, c as @dbscan_labels@, k as (select cluster, coalesce(obs_type, 'untyped') t, count(*) n from c join ob using (obs_id) where cluster is not null group by 1, 2), s as (select cluster, sum(n)::bigint size, list(t order by n desc, t) ts from k group by 1)
select cluster, size, 'Theme: ' || array_to_string(ts[1:3], ', ') as name, 'Theme of ' || size || ' observations, mostly ' || ts[1] as summary from s""",
)
def observation_themes(spark, d):
    """A theme for each density cluster, named after its three commonest kinds of observation."""
    c = QUERIES["dbscan_labels"](spark, d).where("cluster is not null").select("obs_id", "cluster")
    o = T.observations(spark, d, "obs_type").select("obs_id", F.coalesce("obs_type", F.lit("untyped")).alias("t"))
    k = c.join(o, "obs_id").groupBy("cluster", "t").agg(F.count("*").alias("n"))
    s = k.groupBy("cluster").agg(F.sum("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "t"))), lambda x: x["t"]).alias("ts"))
    return s.select("cluster", "size", F.concat(F.lit("Theme: "), F.array_join(F.slice("ts", 1, 3), ", ")).alias("name"), F.concat(F.lit("Theme of "), "size", F.lit(" observations, mostly "), F.col("ts")[0]).alias("summary"))


@query(
    "structural_summaries",
    """with e as (select distinct element_id, space_id, kind, name, replace(coalesce(file_path, split_part(path, '#', 1)), '\\', '/') file from code_elements where space_id is not null and coalesce(file_path, path) is not null),
f as (select space_id, file, count(*) filter (where kind = 'function') n, list(name order by name, element_id) filter (where kind = 'function' and name is not null) names from e group by 1, 2)
select space_id, file as file_path, regexp_replace(file, '^.*/', '') || ' in ' || case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') else '.' end || case when n = 0 then ', no functions' else ', ' || n || ' functions: ' || array_to_string(coalesce(names, [])[1:5], ', ') end as summary from f""",
)
def structural_summaries(spark, d):
    """What a file is and holds, where nobody has summarised it: its name, folder, and its first five functions."""
    file = F.translate(F.coalesce("file_path", F.split("path", "#")[0]), "\\", "/")
    e = T.table(spark, d, "code_elements").where("space_id is not null and coalesce(file_path, path) is not null").select("element_id", "space_id", "kind", "name", file.alias("file")).distinct()
    is_f = F.col("kind") == "function"
    f = e.groupBy("space_id", "file").agg(F.count_if(is_f).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(is_f & F.col("name").isNotNull(), F.struct("name", "element_id")))), lambda x: x["name"]).alias("names"))
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    held = F.when(F.col("n") == 0, ", no functions").otherwise(F.concat(F.lit(", "), "n", F.lit(" functions: "), F.array_join(F.slice("names", 1, 5), ", ")))
    return f.select("space_id", F.col("file").alias("file_path"), F.concat(F.regexp_replace("file", "^.*/", ""), F.lit(" in "), folder, held).alias("summary"))


COMPARED = [("c0", ["parser", "tokenizer"]), ("c1", ["cache", "index", "queue"])]


def _targets_sql(words: list[str]) -> str:
    return " + ".join(f"(contains(lower(coalesce(name, '')), '{w}') or contains(lower(coalesce(summary, '')), '{w}'))::int" for w in words)


@query(
    "comparison_boosts",
    f"with {NODES}, m as (" + " union all ".join(f"select '{i}' as comparison_id, space_id, node_id, tags, ({_targets_sql(w)}) / {len(w)} as ratio from nodes_m where ({_targets_sql(w)}) > 0" for i, w in COMPARED) + ") select comparison_id, space_id, node_id, round(case when list_contains(tags, 'comparison') then 0.3 + 0.3 * ratio else 0.1 + 0.1 * ratio end, 6) as boost from m",
)
def comparison_boosts(spark, d):
    """What a node gains for naming the things a query compares; a comparison node gains three times as much."""
    n = T.nodes(spark, d).withColumn("low", F.lower(F.coalesce("name", F.lit("")))).withColumn("more", F.lower(F.coalesce("summary", F.lit(""))))
    share = lambda words: sum(((F.col("low").contains(w) | F.col("more").contains(w)).cast("int") for w in words), F.lit(0)) / len(words)
    each = n.withColumn("c", F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("id"), share(w).alias("ratio")) for i, w in COMPARED]), lambda x: x["ratio"] > 0)))
    ratio = F.col("c.ratio")
    return each.select(F.col("c.id").alias("comparison_id"), "space_id", "node_id", r6(F.when(F.array_contains("tags", "comparison"), 0.3 + 0.3 * ratio).otherwise(0.1 + 0.1 * ratio)).alias("boost"))


@query(
    "orphan_actions",
    "with o as @orphan_nodes@, s as (select space_id, bool_or(coalesce(is_protected, false)) p from spaces group by 1) select space_id, coalesce(p, false) as is_protected, count(*) as orphans, (case when coalesce(p, false) then 0 else count(*) end)::bigint as deletable, count(*) filter (where layer > 0) as upper from o left join s using (space_id) group by space_id, p",
)
def orphan_actions(spark, d):
    """Nodes without edges of each space, and how many of them may be deleted: none of a protected space."""
    p = T.table(spark, d, "spaces").groupBy("space_id").agg(F.bool_or(F.coalesce("is_protected", F.lit(False))).alias("p"))
    o = join_small(QUERIES["orphan_nodes"](spark, d), p, "space_id").withColumn("p", F.coalesce("p", F.lit(False)))
    a = o.groupBy("space_id", "p").agg(F.count("*").alias("orphans"), F.count_if(F.col("layer") > 0).alias("upper"))
    return a.select("space_id", F.col("p").alias("is_protected"), "orphans", F.when(F.col("p"), F.lit(0).cast("long")).otherwise(F.col("orphans")).alias("deletable"), "upper")
