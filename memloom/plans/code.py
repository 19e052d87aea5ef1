"""Source files: symbols, relations, resolution; pages: sections."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from memloom.functions.languages import EXTENSIONS, LANGUAGES
from memloom.functions.rules import quoted
from memloom.operators import parse, relate
from memloom.plans.base import query, r6
from memloom.sources import tables as T
from memloom.sources.shared import materialize

_MAP = "case ext " + " ".join(f"when '{k}' then '{v}'" for k, v in EXTENSIONS.items()) + " end"
_RULES = "case language " + " ".join(
    f"when '{lang}' then case " + " ".join(f"when regexp_matches(text_, {quoted(p)}) then struct_pack(kind := '{kind}', name := regexp_extract(text_, {quoted(p)}, 1))" for kind, p in rules) + " end" for lang, rules in LANGUAGES.items()
) + " end"
LINES = f"""fl as (select distinct space_id, file_path, content, case when contains(nm, '.') then regexp_extract(nm, '\\.([^.]+)$', 1) else nm end ext from (select *, lower(regexp_extract(file_path, '([^/\\\\]+)$', 1)) nm from code_elements where kind = 'module' and content is not null)),
li as (select space_id, file_path, {_MAP} as language, unnest(ls) text_, generate_subscripts(ls, 1)::int line from (select *, string_split(regexp_replace(regexp_replace(content, '^﻿', ''), '\r\n?', chr(10), 'g'), chr(10)) ls from fl)),
pv as (select *, lag(text_) over (partition by space_id, file_path order by line) prev from li), rl as (select *, {_RULES} s from pv),
sy as (select space_id, file_path, language, line, s.kind as kind, s.name as name, case when language = 'go' then regexp_matches(s.name, '^[A-Z]') when language in ('typescript', 'javascript') then regexp_matches(text_, '^\\s*export\\b') when language = 'rust' then regexp_matches(text_, '^\\s*pub\\b')
  when language in ('java', 'csharp', 'kotlin') then regexp_matches(text_, '^\\s*public\\b') when language = 'python' then not starts_with(s.name, '_') else true end as exported, coalesce(regexp_matches(prev, '^\\s*(//|#|\\*|/\\*|--)'), false) as doc from rl where s is not null and s.name <> '')"""


def files(spark, d):
    return T.table(spark, d, "code_elements").where("kind = 'module'").select("space_id", "file_path", "content").distinct()


@query("code_symbols", f"with {LINES} select * from sy")
def code_symbols(spark, d):
    return parse.symbols(files(spark, d))


@query("symbol_stats", f"with {LINES} select language, kind, count(*) as symbols, sum(exported::int)::bigint as exported from sy group by 1, 2")
def symbol_stats(spark, d):
    return parse.symbols(files(spark, d)).groupBy("language", "kind").agg(F.count("*").alias("symbols"), F.sum(F.col("exported").cast("int")).alias("exported"))


SPEC = "least(1.0, 0.5 + case when kind = 'constant' then 0.2 else 0 end + case when regexp_matches(name, '^[A-Z0-9_]{2,}$') and contains(name, '_') then 0.15 else 0 end + case when exported then 0.1 else 0 end + case when doc then 0.1 else 0 end)"


@query("symbol_lookup", f"with {LINES}, k as (select *, {SPEC} sp from sy where starts_with(lower(name), 'merge')), r as (select *, row_number() over (partition by space_id order by sp desc, name, file_path, line) r from k) select space_id, name, file_path, line, round(sp, 6) as specificity, r as rank from r where r <= 50")
def symbol_lookup(spark, d, prefix: str = "merge"):
    """Symbols whose name begins so, the most specific first, 50 per space."""
    s = parse.symbols(files(spark, d)).where(F.lower("name").startswith(prefix)).withColumn("sp", parse.specificity(F.col("kind"), F.col("name"), F.col("exported"), F.col("doc")))
    w = Window.partitionBy("space_id").orderBy(F.desc("sp"), "name", "file_path", "line")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 50").select("space_id", "name", "file_path", "line", r6("sp").alias("specificity"), "rank")


RELS = f"""{LINES}, im as (select space_id, file_path, line, 'IMPORTS' relation, coalesce({", ".join(f"nullif(regexp_extract(text_, {quoted(parse.IMPORT)}, {g}), '')" for g in range(1, 6))}) target from li),
ca as (select space_id, file_path, line, 'CALLS' relation, unnest(regexp_extract_all(text_, {quoted(parse.CALL)}, 1)) target from li), re as (select * from im where target is not null union all select * from ca)"""


@query("relation_counts", f"with {RELS} select relation, count(*) as relations, count(distinct target) as targets from re group by 1")
def relation_counts(spark, d):
    return parse.relations(files(spark, d)).groupBy("relation").agg(F.count("*").alias("relations"), F.count_distinct("target").alias("targets"))


RESOLVE = f"""with {RELS}, c as (select distinct space_id, file_path, line, target, regexp_replace(file_path, '/[^/]*$', '') dir from re where relation = 'CALLS'), g as (select space_id, name, count(*) n from sy group by 1, 2),
o as (select c.*, s.file_path found_in, s.line found_line, case when s.file_path = c.file_path then 1.0 when s.dir = c.dir or starts_with(s.dir, c.dir || '/') then 0.9 when g.n = 1 then 0.5 end conf
  from c join (select *, regexp_replace(file_path, '/[^/]*$', '') dir from sy) s on s.space_id = c.space_id and s.name = c.target join g on g.space_id = c.space_id and g.name = c.target),
k as (select *, row_number() over (partition by space_id, file_path, line, target order by conf desc, found_in, found_line) r from o where conf is not null)
select space_id, file_path, line, target, found_in, found_line, case conf when 1.0 then 'same_file' when 0.9 then 'same_package' else 'global_unique' end as method, conf::double as confidence from k where r = 1"""


@query("resolved_calls", RESOLVE)
def resolved_calls(spark, d):
    f = files(spark, d)
    calls = parse.relations(f).where("relation = 'CALLS'").distinct()
    return parse.resolve(calls, materialize(parse.symbols(f), "symbols"))


@query("code_relations")
def code_relations(spark, d):
    """Every import, parent, interface and call by the language's own rules; ``relation_counts`` keeps to what its statement counts."""
    return relate.relations(files(spark, d))


@query("resolved_relations")
def resolved_relations(spark, d):
    """Where the targets of ``code_relations`` are declared: same file, same package, import by path suffix, only place of the space."""
    f = files(spark, d)
    return relate.resolve_all(materialize(relate.relations(f), "relations"), materialize(parse.symbols(f), "symbols"))


@query("document_sections")
def document_sections(spark, d):
    """Sections of all documents: those of 200 words and more are cut at headings, sections below 40 words merge forward."""
    pages = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return parse.sections(pages, 200, 40).withColumnRenamed("id", "doc_id")


@query(
    "element_symbols",
    f"with {LINES}, fn as (select distinct space_id, file_path, name from code_elements where kind = 'function') select space_id, file_path, name, min(line) as line from fn join sy using (space_id, file_path, name) group by 1, 2, 3",
)
def element_symbols(spark, d):
    """Where the stored function elements are declared in their files."""
    fn = T.table(spark, d, "code_elements").where("kind = 'function'").select("space_id", "file_path", "name").distinct()
    return parse.symbols(files(spark, d)).join(fn, ["space_id", "file_path", "name"]).groupBy("space_id", "file_path", "name").agg(F.min("line").alias("line"))
