"""The pN_ queries and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.llm.bisect import describe_clusters, similarity_clusters
from memloom.llm.cooccur import clean_tag, pair_lift
from memloom.llm.encode import encode_corpus
from memloom.llm.handwritten import file_origins
from memloom.llm.neardup import near_duplicates, pairs_within
from memloom.llm.pack import pack
from memloom.llm.stuffing import spam_scores
from memloom.llm.topn import top_n_per_group
from memloom.llm.vectors import most_similar


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "retrieve_results")
    return top_n_per_group(rows, "query_id", "score", "node_id", 10).select("query_id", "node_id")


def p5_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``p5_found`` with their scores and exact positions."""
    return top_n_per_group(_table(spark, sf_dir, "retrieve_results"), "query_id", "score", "node_id", 10).select("query_id", "node_id", "score", F.col("position").cast("bigint").alias("position"))


P5_BODY = """ from (
  select query_id, node_id, max(score) score, row_number() over (partition by query_id order by max(score) desc, node_id) r
  from retrieve_results
  where query_id is not null and node_id is not null and score is not null and not isnan(score)
  group by query_id, node_id
) where r <= 10
"""
P5_SQL = "select query_id, node_id" + P5_BODY
P5_POSITIONS_SQL = "select query_id, node_id, score, r as position" + P5_BODY


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of ``p2_found`` with the sessions holding both, each and any, and the lift over chance."""
    rows = _table(spark, sf_dir, "observations").select("session_id", F.explode_outer("tags").alias("tag"))
    pairs = pair_lift(rows.select("session_id", clean_tag(F.col("tag")).alias("tag")), "session_id", "tag")
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", F.col("baskets").alias("sessions"), F.round("lift", 6).alias("lift"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pairs(spark, sf_dir).select("tag_a", "tag_b")


P2_BODY = """
with raw as (select session_id, unnest(case when len(tags) > 0 then tags else [null] end) t from observations where session_id is not null),
tagged as (select distinct session_id, trim(regexp_replace(lower(trim(t)), '^#', '')) t from raw where t is not null),
clean as (select * from tagged where t <> ''),
s as (select count(distinct session_id) s from observations),
n as (select t, count(*) n from clean group by t),
xy as (select a.t ta, b.t tb, count(*) nxy from clean a join clean b on a.session_id = b.session_id and a.t < b.t group by 1, 2)
{} from xy join n na on na.t = ta join n nb on nb.t = tb cross join s
where nxy >= 6 and nxy >= 0.005 * s and nxy * s >= 4.0 * na.n * nb.n
"""
P2_SQL = P2_BODY.replace("{}", "select ta as tag_a, tb as tag_b")
P2_PAIRS_SQL = P2_BODY.replace("{}", "select ta as tag_a, tb as tag_b, nxy as n_ab, na.n as n_a, nb.n as n_b, s as sessions, round(nxy * s::double / (na.n * nb.n), 6) as lift")


def p3_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "observations")
    found = most_similar(rows, "space_id", "obs_id", "embedding", 5, 0.8)
    return found.select(F.col("grp").alias("space_id"), F.col("id").alias("obs_id"), F.col("similar").alias("similar_obs_id"), F.col("sim").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = p3_similar(spark, sf_dir)
    return kept.select(F.least("obs_id", "similar_obs_id").alias("obs_id_a"), F.greatest("obs_id", "similar_obs_id").alias("obs_id_b")).distinct()


USABLE_SQL = """
usable as (select obs_id, any_value(space_id) space_id, any_value(node_id) node_id, any_value(embedding)::double[] v from observations
  where len(embedding) = 64 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0 group by obs_id)"""

P3_BODY = f"""
with {USABLE_SQL},
sims as (select a.space_id, a.obs_id, b.obs_id other, round(list_cosine_similarity(a.v, b.v), 6) sim
  from usable a join usable b on a.space_id = b.space_id and a.obs_id <> b.obs_id),
kept as (select * from (select *, row_number() over (partition by obs_id order by sim desc, other) r from sims) where r <= 5 and sim >= 0.8)
"""
P3_SQL = P3_BODY + "select distinct least(obs_id, other) as obs_id_a, greatest(obs_id, other) as obs_id_b from kept"
P3_SIMILAR_SQL = P3_BODY + "select space_id, obs_id, other as similar_obs_id, sim as score, r as rank from kept"


def _with_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "nodes").groupBy("space_id", "node_id").agg(F.max(F.coalesce("layer", F.lit(0))).alias("layer"))
    rows = _table(spark, sf_dir, "observations").select("obs_id", "space_id", "node_id", "embedding")
    placed = rows.join(nodes, ["space_id", "node_id"], "left").where("space_id is not null")
    return placed.withColumn("grp", F.concat_ws("/", "space_id", F.coalesce("layer", F.lit(0)).cast("string")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_clusters(_with_layer(spark, sf_dir), "grp", "obs_id", "embedding", 0.8, 8)
    return found.select(F.col("id").alias("obs_id"), F.col("cluster").alias("cluster_obs_id"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_layer(spark, sf_dir)
    found = describe_clusters(similarity_clusters(rows, "grp", "obs_id", "embedding", 0.8, 8), rows, "obs_id", "embedding", 3)
    split = F.split("grp", "/")
    return found.select(split[0].alias("space_id"), split[1].cast("int").alias("layer"), F.col("cluster").alias("cluster_obs_id"), "size", "typical")


P4_SQL = f"""
with recursive {USABLE_SQL},
placed as (select u.obs_id, u.v, u.space_id || '/' || coalesce(n.layer, 0) g from usable u
  left join (select space_id, node_id, max(coalesce(layer, 0)) layer from nodes group by all) n on n.space_id = u.space_id and n.node_id = u.node_id),
link as (select a.obs_id a, b.obs_id b from placed a join placed b on a.g = b.g and a.obs_id <> b.obs_id where round(list_cosine_similarity(a.v, b.v), 6) >= 0.8),
reach(root, id) as (select obs_id, obs_id from placed union select r.root, l.b from reach r join link l on l.a = r.id where l.b > r.root),
named as (select id, min(root) c from reach group by id)
select id as obs_id, c as cluster_obs_id from named where c in (select c from named group by c having count(*) >= 8)
"""


def observation_text():
    """content, or summary where content is null or blank"""
    return F.when(F.col("content").rlike(r"(?U)\S"), F.col("content")).otherwise(F.col("summary"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "observations").select("space_id", "obs_id", observation_text().alias("text"))
    return near_duplicates(rows, "space_id", "obs_id", "text", 0.7, 8).withColumnsRenamed({"grp": "space_id", "id": "obs_id", "cluster": "group_obs_id"})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = p1_groups(spark, sf_dir).withColumnsRenamed({"obs_id": "id", "group_obs_id": "cluster"})
    return pairs_within(groups).withColumnsRenamed({"id_a": "obs_id_a", "id_b": "obs_id_b"})


P1_BODY = r"""
with recursive texts as (select obs_id, any_value(space_id) space_id,
    any_value(regexp_extract_all(lower(case when regexp_matches(content, '\S') then content else summary end), '[a-z0-9]+')) w
  from observations group by obs_id),
sets as (select obs_id, space_id, list_distinct(w) w from texts where len(w) >= 8),
words as (select obs_id, space_id, unnest(w) x from sets),
shared as (select a.obs_id a, b.obs_id b, count(*) o from words a join words b on a.space_id = b.space_id and a.x = b.x and a.obs_id < b.obs_id group by 1, 2),
hit as (select a, b from shared join sets sa on sa.obs_id = a join sets sb on sb.obs_id = b where 10 * o >= 7 * (len(sa.w) + len(sb.w) - o)),
link as (select a, b from hit union all select b, a from hit),
reach(root, id) as (select obs_id, obs_id from sets union select r.root, l.b from reach r join link l on l.a = r.id where l.b > r.root),
named as (select id, min(root) c from reach group by id)
"""
P1_SQL = P1_BODY + "select x.id as obs_id_a, y.id as obs_id_b from named x join named y on x.c = y.c and x.id < y.id"
P1_GROUPS_SQL = P1_BODY + "select space_id, id as obs_id, c as group_obs_id, count(*) over (partition by c) as size from named join sets on obs_id = id"


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = p7_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n"))
    return pack(sized, _table(spark, sf_dir, "token_budgets"), "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packing of each budget uses and leaves."""
    per = p8_packed(spark, sf_dir).groupBy("budget_id", "capacity").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return per.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))



def p6_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "code_elements").where("kind = 'module'")
    return file_origins(files.select("space_id", F.coalesce("file_path", F.split("path", "#")[0]).alias("file_path"), "content"), "space_id", "file_path", "content", tools=False)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_origins(spark, sf_dir).where("not hand_written").select("space_id", "file_path")


def p6_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of ``bm25_results`` that lie in files which aren't hand-written."""
    hits = _table(spark, sf_dir, "bm25_results").select("space_id", F.expr("substring(split(path, '#')[0], 2)").alias("plain")).distinct()
    found = p6_found(spark, sf_dir).withColumn("plain", F.translate("file_path", "\\", "/"))
    return hits.join(found, ["space_id", "plain"]).select("space_id", "file_path")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_scores(_table(spark, sf_dir, "documents"), "doc_id", "text", 100)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("is_spam").select("doc_id")


QUERIES = {"p6_found": p6_found, "p6_origins": p6_origins, "p6_hits": p6_hits, "p9_found": p9_found, "p9_scores": p9_scores, "p7_ids": p7_ids, "p8_packed": p8_packed, "p8_fill": p8_fill, "p1_found": p1_found, "p1_groups": p1_groups, "p4_found": p4_found, "p4_clusters": p4_clusters, "p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p3_similar": p3_similar, "p5_found": p5_found, "p5_positions": p5_positions}
ORACLES = {"p1_found": P1_SQL, "p1_groups": P1_GROUPS_SQL, "p4_found": P4_SQL, "p2_found": P2_SQL, "p2_pairs": P2_PAIRS_SQL, "p3_found": P3_SQL, "p3_similar": P3_SIMILAR_SQL, "p5_found": P5_SQL, "p5_positions": P5_POSITIONS_SQL}


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
