"""Text rules: query classes, time expressions, constraints, concerns, sources, keywords, gaps."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from memloom.functions import rules as R
from memloom.plans.base import NODES, ORACLES, RESULTS, query, r6
from memloom.sources import tables as T

QL = "ql as (select distinct query_id, space_id, query_text from query_log where query_text is not null)"
C = R.contains_any_sql
LOW = "lower(query_text)"


def queries(spark, d):
    return T.table(spark, d, "query_log").where("query_text is not null").select("query_id", "space_id", "query_text").distinct()


CODE_SQL = "(" + C(LOW, R.CODE) + " or " + " or ".join(f"ends_with({LOW}, '{w}') or starts_with({LOW}, '{w} ')" for w in R.CODE_EDGES) + ")"
CLASS_SQL = f"""case when {C(LOW, R.SYMBOL)} or regexp_matches(query_text, '{R.SYMBOL_SHAPE}') then 'symbol_lookup' when {CODE_SQL} then 'code' when {C(LOW, R.RELATIONSHIP)} then 'relationship'
  when {C(LOW, R.DATA_FLOW)} then 'data_flow' when {C(LOW, R.ARCHITECTURE)} then 'architecture' else 'generic' end"""


def query_class(text):
    low = F.lower(text)
    code = R.contains_any(low, R.CODE) | F.exists(F.array(*[F.lit(w) for w in R.CODE_EDGES]), lambda w: low.endswith(w) | low.startswith(F.concat(w, F.lit(" "))))
    return (
        F.when(R.contains_any(low, R.SYMBOL) | text.rlike(R.SYMBOL_SHAPE), "symbol_lookup").when(code, "code").when(R.contains_any(low, R.RELATIONSHIP), "relationship")
        .when(R.contains_any(low, R.DATA_FLOW), "data_flow").when(R.contains_any(low, R.ARCHITECTURE), "architecture").otherwise("generic")
    )


def _hint_sql(i: int, kind: str) -> str:
    return "case c " + " ".join(f"when '{k}' then {str(v[i]).lower()}" for k, v in R.HINTS.items()) + f" end::{kind}"


@query("query_hints", f"with {QL}, k as (select query_id, {CLASS_SQL} c from ql) select query_id, c as query_type, {_hint_sql(0, 'int')} as seeds, {_hint_sql(1, 'int')} as hops, {_hint_sql(2, 'double')} as vector_weight, {_hint_sql(3, 'double')} as text_weight, {_hint_sql(4, 'boolean')} as expansion from k")
def query_hints(spark, d):
    k = queries(spark, d).select("query_id", query_class(F.col("query_text")).alias("query_type"))
    table = F.create_map(*[x for name, v in R.HINTS.items() for x in (F.lit(name), F.struct(*[F.lit(y).alias(f"h{i}") for i, y in enumerate(v)]))])
    h = table[F.col("query_type")]
    return k.select("query_id", "query_type", h["h0"].alias("seeds"), h["h1"].alias("hops"), h["h2"].alias("vector_weight"), h["h3"].alias("text_weight"), h["h4"].alias("expansion"))


ASKED = ["recent changes to auth", "last 7 days of ingest", "since 2026-01-15", "between 2026-01-01 and 2026-02-01", "auth module", "what broke in the last 2 weeks", "before March 2026", "since Jan 2026 updates to the parser", "latest and newest results", "before 2025-12-31", "this month", "last week"]
EXTRA = " union all ".join(f"select 'x{i:02d}' query_id, {R.quoted(t)} query_text" for i, t in enumerate(ASKED))
HARD = [r"\b(?:in\s+)?the\s+last\s+(\d+)\s+(days?|weeks?|months?)\b", r"\blast\s+(\d+)\s+(days?|weeks?|months?)\b", r"\bthis\s+week\b", r"\bthis\s+month\b", r"\bthis\s+year\b", r"\blast\s+week\b", r"\blast\s+month\b", r"\bsince\s+(\d{4}-\d{2}-\d{2})\b", rf"\bsince\s+({R.MONTHS})\s+(\d{{4}})\b", r"\bbefore\s+(\d{4}-\d{2}-\d{2})\b", rf"\bbefore\s+({R.MONTHS})\s+(\d{{4}})\b", r"\bbetween\s+(\d{4}-\d{2}-\d{2})\s+and\s+(\d{4}-\d{2}-\d{2})\b"]
SOFT_N = " + ".join(f"contains({LOW}, {R.quoted(k)})::int" for k in R.SOFT_TEMPORAL)
RULE_SQL = "case " + " ".join(f"when regexp_matches(query_text, '(?i){p}') then {i}" for i, p in enumerate(HARD)) + " end"
DAYS_SQL = "try_cast(regexp_extract(query_text, '(?i)\\blast\\s+(\\d+)\\s+(days?|weeks?|months?)\\b', 1) as int) * case lower(regexp_extract(query_text, '(?i)\\blast\\s+(\\d+)\\s+(day|week|month)s?\\b', 2)) when 'day' then 1 when 'week' then 7 else 30 end"
NOWD = "date '2025-12-01'"


def _month_sql(word: str) -> str:
    return (
        f"try_cast(regexp_extract(query_text, '(?i)\\b{word}\\s+({R.MONTHS})\\s+(\\d{{4}})\\b', 2) || '-' || lpad(((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(regexp_extract(query_text, '(?i)\\b{word}\\s+({R.MONTHS})\\s+(\\d{{4}})\\b', 1), 1, 3))) + 2) // 3)::varchar, 2, '0') || '-01' as date)"
    )


@query(
    "temporal_intents",
    f"""with ql as (select distinct query_id, query_text from query_log where query_text is not null union all {EXTRA}), k as (select *, {RULE_SQL} rule, {SOFT_N} soft from ql)
select query_id, case when rule is not null then 'hard' when soft > 0 then 'soft' else 'none' end as mode, case when rule is not null then 0.9::double when soft > 1 then 0.85::double when soft = 1 then 0.7::double else 0.0::double end as confidence,
  case rule when 0 then ({NOWD} - {DAYS_SQL})::date when 1 then ({NOWD} - {DAYS_SQL})::date when 2 then {NOWD} when 3 then date '2025-12-01' when 4 then date '2025-01-01' when 5 then date '2025-11-24' when 6 then date '2025-11-01'
    when 7 then try_cast(regexp_extract(query_text, '(?i)\\bsince\\s+(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) as date) when 8 then {_month_sql('since')} when 11 then try_cast(regexp_extract(query_text, '(?i)\\bbetween\\s+(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) as date) end::varchar as after_date,
  case rule when 9 then try_cast(regexp_extract(query_text, '(?i)\\bbefore\\s+(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) as date) when 10 then {_month_sql('before')} when 11 then try_cast(regexp_extract(query_text, '(?i)\\band\\s+(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) as date) end::varchar as before_date from k""",
)
def temporal_intents(spark, d):
    """Time expressions of the logged queries and of a dozen fixed ones: twelve rules, the first that matches, else soft words."""
    q = T.table(spark, d, "query_log").where("query_text is not null").select("query_id", "query_text").distinct()
    q = q.unionByName(spark.createDataFrame([(f"x{i:02d}", t) for i, t in enumerate(ASKED)], "query_id string, query_text string"))
    text, low = F.col("query_text"), F.lower("query_text")
    rule = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(HARD))):
        rule = F.when(text.rlike("(?i)" + p), i).otherwise(rule)
    soft = F.aggregate(F.array(*[F.when(low.contains(k), 1).otherwise(0) for k in R.SOFT_TEMPORAL]), F.lit(0), lambda a, x: a + x)
    part = lambda p, g: F.regexp_extract(text, "(?i)" + p, g)
    last = r"\blast\s+(\d+)\s+(day|week|month)s?\b"
    unit = F.when(F.lower(part(last, 2)) == "day", 1).when(F.lower(part(last, 2)) == "week", 7).otherwise(30)
    today = F.to_date(T.now())
    iso = lambda s: F.to_date(F.try_to_timestamp(F.nullif(s, F.lit("")), F.lit("yyyy-MM-dd")))

    def month(word: str):
        p = rf"\b{word}\s+({R.MONTHS})\s+(\d{{4}})\b"
        number = F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(part(p, 1), 1, 3))) + 2) / 3)
        return F.make_date(F.nullif(part(p, 2), F.lit("")).try_cast("int"), number.cast("int"), F.lit(1))

    n = F.nullif(part(last, 1), F.lit("")).try_cast("int")
    q = q.withColumn("rule", rule).withColumn("soft", soft)
    r = F.col("rule")
    after = (
        F.when(r.isin(0, 1), F.date_sub(today, n * unit)).when(r == 2, F.trunc(today, "week")).when(r == 3, F.trunc(today, "month")).when(r == 4, F.trunc(today, "year")).when(r == 5, F.date_sub(today, 7)).when(r == 6, F.add_months(today, -1))
        .when(r == 7, iso(part(r"\bsince\s+(\d{4}-\d{2}-\d{2})", 1))).when(r == 8, month("since")).when(r == 11, iso(part(r"\bbetween\s+(\d{4}-\d{2}-\d{2})", 1)))
    )
    before = F.when(r == 9, iso(part(r"\bbefore\s+(\d{4}-\d{2}-\d{2})", 1))).when(r == 10, month("before")).when(r == 11, iso(part(r"\band\s+(\d{4}-\d{2}-\d{2})", 1)))
    mode = F.when(r.isNotNull(), "hard").when(F.col("soft") > 0, "soft").otherwise("none")
    conf = F.when(r.isNotNull(), 0.9).when(F.col("soft") > 1, 0.85).when(F.col("soft") == 1, 0.7).otherwise(0.0)
    return q.select("query_id", mode.alias("mode"), conf.alias("confidence"), after.cast("string").alias("after_date"), before.cast("string").alias("before_date"))


ISO = r"\d{4}-\d{2}-\d{2}"
DATES = [rf"(?m)^##\s+\[[\d.]+\]\s*[-–—]\s*({ISO})", rf"(?i)(?:version|release|v)\s*[\d.]+\s*\(({ISO})\)", rf"(?im)^(?:date|created|modified|updated|last[- ]modified|last[- ]updated)\s*:\s*({ISO})", rf"\b({ISO})\b"]
NATURAL = rf"(?i)\b({R.MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"


@query(
    "canonical_dates",
    "with x as (select doc_id, substr(text, 1, 500) t from documents where text is not null), y as (select doc_id, coalesce("
    + ", ".join(f"try_cast(nullif(regexp_extract(t, {R.quoted(p)}, 1), '') as date)" for p in DATES)
    + ") dt from x) select distinct doc_id, dt::varchar as canonical_date from y where dt >= date '2000-01-01' and dt <= date '2026-12-01'",
)
def canonical_dates(spark, d):
    """The content date of a text: changelog, version, metadata, then any ISO date, in its first 500 characters."""
    t = T.table(spark, d, "documents").where("text is not null").select("doc_id", F.substring("text", 1, 500).alias("t"))
    found = F.coalesce(*[F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract("t", p, 1), F.lit("")), F.lit("yyyy-MM-dd"))) for p in DATES])
    return t.withColumn("canonical_date", found).where("canonical_date between date '2000-01-01' and date '2026-12-01'").select("doc_id", F.col("canonical_date").cast("string").alias("canonical_date")).distinct()


BOOST = {"decision": 0.2, "correction": 0.15}
TEXTS = [("f1", "decision", "We must always validate user input before storing"), ("f2", "decision", "We must never use raw SQL queries directly"), ("f3", "learning", "We should prefer using interfaces over concrete types"), ("f4", "context", "The weather is nice today"), ("f5", "correction", "Actually the deadline is due by Friday and drafts are not allowed")]
CON_RULES = [(k, p, c) for k, rules in R.CONSTRAINTS.items() for p, c in rules]
CON_SQL = " union all ".join(f"select obs_id, '{k}' kind, least(1.0, {c} + b) conf from t where regexp_matches(content, '(?i){p.replace(chr(39), chr(39) * 2)}')" for k, p, c in CON_RULES)
FIX = " union all ".join(f"select '{i}', '{k}', {R.quoted(t)}" for i, k, t in TEXTS)


@query(
    "constraint_detection",
    f"with t as (select obs_id, content, case obs_type when 'decision' then 0.2 when 'correction' then 0.15 else 0.0 end b from (select distinct obs_id, obs_type, content from observations where content is not null union all {FIX})), h as ({CON_SQL}) select obs_id, kind as constraint_type, round(max(conf)::double, 6) as confidence from h where conf >= 0.6 group by 1, 2",
)
def constraint_detection(spark, d):
    """The surest match of each of five classes of constraint, from 0.6; decisions and corrections count for more."""
    t = T.observations(spark, d, "obs_type", "content").where("content is not null").unionByName(spark.createDataFrame(TEXTS, "obs_id string, obs_type string, content string"))
    boost = F.when(F.col("obs_type") == "decision", 0.2).when(F.col("obs_type") == "correction", 0.15).otherwise(0.0)
    per = [F.struct(F.lit(kind).alias("kind"), F.greatest(*[F.when(F.col("content").rlike("(?i)" + p), F.lit(c)).otherwise(0.0) for p, c in rules]).alias("c")) for kind, rules in R.CONSTRAINTS.items()]
    x = t.select("obs_id", boost.alias("b"), F.explode(F.array(*per)).alias("m")).where("m.c > 0")
    conf = F.least(F.lit(1.0), F.round(F.col("m.c") + F.col("b"), 9))
    return x.select("obs_id", F.col("m.kind").alias("constraint_type"), r6(conf).alias("confidence")).where("confidence >= 0.6")


SRC_TEXTS = [("f1", "see jira ticket 1"), ("f2", "github.com/x/y"), ("f3", "in slack"), ("f4", "nothing here"), ("f5", "figma.com/a and notion page")]


@query(
    "data_source_refs",
    "with t as (select doc_id::varchar id, lower(text) x from documents where text is not null union all " + " union all ".join(f"select '{i}', '{t}'" for i, t in SRC_TEXTS) + "), r as ("
    + " union all ".join(f"select '{k}' source, id from t where regexp_matches(x, {R.quoted(p)})" for k, p in R.SOURCES.items())
    + ") select source, count(distinct id) as texts from r group by 1",
)
def data_source_refs(spark, d):
    """How many texts speak of each outside system."""
    t = T.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.lower("text").alias("x")).unionByName(spark.createDataFrame(SRC_TEXTS, "id string, x string"))
    hits = F.array_compact(F.array(*[F.when(F.col("x").rlike(p), F.lit(k)) for k, p in R.SOURCES.items()]))
    return t.select("id", F.explode(hits).alias("source")).groupBy("source").agg(F.count_distinct("id").alias("texts"))


@query(
    "concern_tags",
    "with e as (select distinct element_id, lower(coalesce(path, '')) p, lower(coalesce(content, '')) c from code_elements), r as ("
    + " union all ".join(f"select element_id, '{k}' concern from e where {C('p', v)} or {C('c', v)}" for k, v in R.CONCERNS.items())
    + ") select element_id, concern from r",
)
def concern_tags(spark, d):
    e = T.table(spark, d, "code_elements").select("element_id", F.lower(F.coalesce("path", F.lit(""))).alias("p"), F.lower(F.coalesce("content", F.lit(""))).alias("c")).distinct()
    hits = F.array_compact(F.array(*[F.when(R.contains_any(F.col("p"), v) | R.contains_any(F.col("c"), v), F.lit(k)) for k, v in R.CONCERNS.items()]))
    return e.select("element_id", F.explode(hits).alias("concern"))


@query("config_files", f"select distinct space_id, file_path from code_elements where {C('lower(file_path)', R.CONFIG_PATHS)}")
def config_files(spark, d):
    return T.table(spark, d, "code_elements").where(R.contains_any(F.lower("file_path"), R.CONFIG_PATHS)).select("space_id", "file_path").distinct()


SUGGEST = f"""case when {C('nm', R.RISK)} or {C('sm', R.RISK)} then 'risk' when {C('nm', R.PROCESS)} or {C('pt', R.PROCESS)} then 'process' when {C('nm', R.CONCEPT)} or {C('pt', R.CONCEPT)} or {C('sm', R.CONCEPT)} then 'concept' else 'context' end"""


@query(
    "suggestions",
    f"""with {NODES}, {RESULTS}, t as (select query_id, node_id, score, row_number() over (partition by query_id order by score desc, node_id) r from res where score is not null),
x as (select t.*, lower(coalesce(n.name, '')) nm, lower(coalesce(n.path, '')) pt, lower(coalesce(n.summary, '')) sm, coalesce(nullif(n.summary, ''), n.name, '') body from t join nodes_m n using (node_id) where r <= 15),
y as (select *, {SUGGEST} kind, row_number() over (partition by query_id, lower(substr(body, 1, 50)) order by r) u from x where body <> '') select query_id, node_id, kind, r as rank from y where u = 1""",
)
def suggestions(spark, d):
    """The 15 best results of each query, classified, the first of each beginning kept."""
    w = Window.partitionBy("query_id")
    t = T.results(spark, d).where("score is not null").withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "node_id")).cast("long")).where("rank <= 15").select("query_id", "node_id", "rank")
    n = T.nodes(spark, d).select("node_id", "name", "path", "summary")
    blank = F.lit("")
    x = t.join(n, "node_id").withColumn("body", F.coalesce(F.nullif("summary", blank), "name", blank)).where("body <> ''")
    nm, pt, sm = (F.lower(F.coalesce(c, blank)) for c in ("name", "path", "summary"))
    kind = F.when(R.contains_any(nm, R.RISK) | R.contains_any(sm, R.RISK), "risk").when(R.contains_any(nm, R.PROCESS) | R.contains_any(pt, R.PROCESS), "process").when(R.contains_any(nm, R.CONCEPT) | R.contains_any(pt, R.CONCEPT) | R.contains_any(sm, R.CONCEPT), "concept").otherwise("context")
    y = x.withColumn("kind", kind).withColumn("u", F.row_number().over(Window.partitionBy("query_id", F.lower(F.substring("body", 1, 50))).orderBy("rank"))).where("u = 1")
    return y.select("query_id", "node_id", "kind", "rank")


STOP = "[" + ", ".join(R.quoted(w) for w in R.KEYWORD_STOP) + "]"


@query(
    "top_keywords",
    f"""with o as (select distinct obs_id, space_id, content, summary from observations where space_id is not null), w as (select space_id, unnest(regexp_extract_all(lower(concat_ws(' ', content, summary)), '[a-z0-9_-]+')) w from o), c as (select space_id, w, count(*) n from w where length(w) >= 3 and not list_contains({STOP}, w) group by 1, 2 having count(*) >= 2)
select space_id, w as keyword, n as times, r as rank from (select *, row_number() over (partition by space_id order by n desc, w) r from c) where r <= 10""",
)
def top_keywords(spark, d):
    o = T.observations(spark, d, "space_id", "content", "summary").where("space_id is not null")
    w = o.select("space_id", F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "content", "summary")), F.lit("[a-z0-9_-]+"), F.lit(0))).alias("keyword")).where((F.length("keyword") >= 3) & ~F.col("keyword").isin(R.KEYWORD_STOP))
    c = w.groupBy("space_id", "keyword").agg(F.count("*").alias("times")).where("times >= 2")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("space_id").orderBy(F.desc("times"), "keyword")).cast("long")).where("rank <= 10")


QSTOP = "[" + ", ".join(R.quoted(w) for w in R.QUERY_STOP) + "]"


@query(
    "query_gaps",
    f"""with q as (select distinct query_id, space_id, query_text, avg_score from query_log), t as (select unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(query_text), '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^[.,?!"'']+', ''), '[.,?!"'']+$', '')), lambda w: strlen(w) > 2 and not list_contains({QSTOP}, w)))) term from q where coalesce(avg_score, 0) < 0.5 and query_text is not null),
c as (select term, count(*) n from t group by 1 having count(*) >= 3), a as (select count(*) n from q) select term, c.n as occurrences, round(least(1.0, greatest(0.1, 10.0 * c.n / a.n)), 6) as priority from c cross join a""",
)
def query_gaps(spark, d):
    """Terms that come back in at least three badly answered queries."""
    q = T.table(spark, d, "query_log").select("query_id", "space_id", "query_text", "avg_score").distinct()
    total = q.count()
    bare = F.transform(F.split(F.lower("query_text"), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, "^[.,?!\"']+", ""), "[.,?!\"']+$", ""))
    keep = F.array_distinct(F.filter(bare, lambda w: (F.octet_length(w) > 2) & ~w.isin(R.QUERY_STOP)))
    t = q.where("coalesce(avg_score, 0) < 0.5 and query_text is not null").select(F.explode(keep).alias("term"))
    c = t.groupBy("term").agg(F.count("*").alias("occurrences")).where("occurrences >= 3")
    return c.withColumn("priority", r6(F.least(F.lit(1.0), F.greatest(F.lit(0.1), 10.0 * F.col("occurrences") / F.lit(total)))))


@query(
    "tag_failures",
    f"""with {NODES}, s as (select node_id, avg(score) s from retrieve_results where score is not null and not isnan(score) group by 1), g as (select tags, count(*) n, avg(coalesce(s, 0)) a from nodes_m left join s using (node_id) group by 1 having count(*) >= 5 and avg(coalesce(s, 0)) < 0.5),
t as (select unnest(tags) tag, n, a from g), u as (select tag, sum(n)::bigint n, avg(a) a from t group by 1 having sum(n) >= 5), k as (select *, row_number() over (order by round(a, 9), tag) r from u) select tag as domain, n as nodes, round(a, 6) as avg_score from k where r <= 10""",
)
def tag_failures(spark, d):
    """The ten tags whose groups of nodes are answered worst."""
    s = T.table(spark, d, "retrieve_results").where("score is not null and not isnan(score)").groupBy("node_id").agg(F.avg("score").alias("s"))
    g = T.nodes(spark, d).join(s, "node_id", "left").groupBy("tags").agg(F.count("*").alias("n"), F.avg(F.coalesce("s", F.lit(0.0))).alias("a")).where("n >= 5 and a < 0.5")
    u = g.select(F.explode("tags").alias("tag"), "n", "a").groupBy("tag").agg(F.sum("n").alias("nodes"), F.avg("a").alias("a")).where("nodes >= 5")
    return u.orderBy(F.round("a", 9), "tag").limit(10).select(F.col("tag").alias("domain"), "nodes", r6("a").alias("avg_score"))


@query(
    "dominant_types",
    "with o as (select distinct obs_id, space_id, obs_type, surprise_score from observations where obs_type is not null and space_id is not null), c as (select space_id, obs_type, count(*) n from o group by 1, 2), m as (select space_id, avg(coalesce(surprise_score, 0)) s from o group by 1) select c.space_id, arg_min(obs_type, (-n, obs_type)) as dominant, round(any_value(s), 6) as mean_surprise from c join m using (space_id) group by 1",
)
def dominant_types(spark, d):
    """The most frequent type of each space, ties by name, and the mean surprise."""
    o = T.observations(spark, d, "space_id", "obs_type", "surprise_score").where("obs_type is not null and space_id is not null")
    c = o.groupBy("space_id", "obs_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("surprise_score", F.lit(0.0))).alias("s"))
    return c.groupBy("space_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "obs_type"))["obs_type"].alias("dominant"), r6(F.sum("s") / F.sum("n")).alias("mean_surprise"))


@query(
    "dominant_prefixes",
    f"with {NODES}, c as (select space_id, split_part(path, '/', 2) dir, count(*) n from nodes_m where path is not null group by 1, 2), t as (select *, sum(n) over (partition by space_id) total, row_number() over (partition by space_id order by n desc, dir) r from c) select space_id, case when n > 0.5 * total then dir else 'mixed' end as prefix from t where r = 1",
)
def dominant_prefixes(spark, d):
    w = Window.partitionBy("space_id")
    c = T.nodes(spark, d).where("path is not null").groupBy("space_id", F.split("path", "/")[1].alias("dir")).agg(F.count("*").alias("n"))
    t = c.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "dir"))).where("r = 1")
    return t.select("space_id", F.when(F.col("n") > 0.5 * F.col("total"), F.col("dir")).otherwise("mixed").alias("prefix"))


@query(
    "path_hints",
    f"with {QL}, m as (select query_id, unnest(list_concat(regexp_extract_all(query_text, '(?i)\\b((?:lib|src|cmd|internal|pkg|services?|modules?|components?|frontend|backend|api|apps?)/[\\w\\-./]+)', 1), regexp_extract_all(query_text, '(?i)\\b([\\w\\-]+/[\\w\\-]+/[\\w\\-./]+\\.(?:ts|tsx|js|jsx|go|py|rs|java|rb))\\b', 1), regexp_extract_all(query_text, '(?i)\\b([\\w\\-]+(?:Module|Service|Controller|Handler|Repository))\\b', 1))) h from ql) select distinct query_id, regexp_replace(lower(h), '/$', '') as hint from m where length(h) > 2",
)
def path_hints(spark, d):
    text = F.col("query_text")
    found = F.concat(
        *[F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in (r"\b((?:lib|src|cmd|internal|pkg|services?|modules?|components?|frontend|backend|api|apps?)/[\w\-./]+)", r"\b([\w\-]+/[\w\-]+/[\w\-./]+\.(?:ts|tsx|js|jsx|go|py|rs|java|rb))\b", r"\b([\w\-]+(?:Module|Service|Controller|Handler|Repository))\b")]
    )
    m = queries(spark, d).select("query_id", F.explode(found).alias("h")).where("length(h) > 2")
    return m.select("query_id", F.regexp_replace(F.lower("h"), "/$", "").alias("hint")).distinct()



@query("gap_interviews")
def gap_interviews(spark, d):
    """Questions for the ten most pressing gaps."""
    g = query_gaps(spark, d).where("priority >= 0.1 and occurrences >= 3").orderBy(F.desc("priority"), F.desc("occurrences"), "term").limit(10)
    return g.select("term", "priority", F.concat(F.lit("Queries about '"), "term", F.lit("' come back with low scores ("), F.col("occurrences").cast("string"), F.lit(" times). What should an answer contain?")).alias("question"))


ORACLES["gap_interviews"] = (
    "select term, priority, 'Queries about ''' || term || ''' come back with low scores (' || occurrences || ' times). What should an answer contain?' as question "
    f"from ({ORACLES['query_gaps']}) where priority >= 0.1 and occurrences >= 3 order by priority desc, occurrences desc, term limit 10"
)
