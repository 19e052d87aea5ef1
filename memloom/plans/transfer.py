"""Ingest, export, import and retention over the stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memloom.operators import store
from memloom.plans.base import ASSOC, NODES, NOW_SQL, query
from memloom.sources import tables as T
from memloom.sources.shared import shared_dir

ITEMS = "it as (select distinct space_id, '/' || replace(path, '\\', '/') path, name, summary, tags, element_id from code_elements)"


@query(
    "ingest_upsert",
    f"""with {NODES}, {ITEMS}, one as (select * from (select *, row_number() over (partition by space_id, path order by element_id desc) r from it) where r = 1)
select coalesce(n.space_id, i.space_id) as space_id, coalesce(n.path, i.path) as path, coalesce(i.name, n.name) as name, case when n.path is not null and i.path is not null then 2 else 1 end as version, case when n.path is null then 'created' when i.path is null then 'kept' else 'updated' end as change
from nodes_m n full outer join one i on n.space_id = i.space_id and n.path = i.path""",
)
def ingest_upsert(spark, d):
    """All code elements offered to the nodes again: met by path, else created."""
    items = T.table(spark, d, "code_elements").select("space_id", F.concat(F.lit("/"), F.translate("path", "\\", "/")).alias("path"), "name", "summary", "tags", F.col("element_id").alias("node_id")).distinct()
    old = T.nodes(spark, d).select("space_id", "node_id", "path", "name", "summary", "tags", F.lit(1).alias("version"), "updated_at")
    return store.upsert_nodes(old, items, T.now()).select("space_id", "path", "name", "version", "change")


@query(
    "ingest_batches",
    "with e as (select distinct event_id, user_id, event_type, ts, value from events), b as (select user_id as batch_id, event_id as item, case when event_type = 'error' then null else event_type end source, case when value < 5 then null else ts end t from e) select batch_id, item, case when source is null or t is null then 'error' else 'ok' end as status, case when source is null then 'source is missing' when t is null then 'timestamp is missing' end as error from b",
)
def ingest_batches(spark, d):
    e = T.table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value").distinct()
    items = e.select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("item"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("source"), F.when(F.col("value") >= 5, F.col("ts")).alias("timestamp"), F.lit("").alias("path"), F.lit("").alias("content"))
    return store.ingest_states(items, most=10**9)


@query("export_roundtrip", f"with {NODES}, {ASSOC} select 'nodes' as entity, count(*) as rows from nodes_m where not is_archived union all select 'edges', count(*) from assoc union all select 'observations', count(distinct obs_id) from observations")
def export_roundtrip(spark, d):
    """Everything exported to the shared folder, read again against its manifest and counted."""
    folder = f"{shared_dir(spark)}/memloom/export-{uuid.uuid4().hex}"
    store.export_space({"nodes": T.nodes(spark, d), "edges": T.similar_edges(spark, d), "observations": T.observations(spark, d, "space_id", "content", "tags")}, folder)
    _, back = store.read_export(spark, folder)
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("entity"), "rows") for name, df in back.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


HALF = "mi as (select distinct node_id, name, layer from nodes_m where substr(node_id, -1) in ('0','1','2','3','4','5')), th as (select distinct node_id, 'new ' || name as name, layer from nodes_m where substr(node_id, -1) in ('4','5','6','7','8','9'))"


@query("import_skip", f"with {NODES}, {HALF} select * from mi union all select * from th where node_id not in (select node_id from mi)")
def import_skip(spark, d):
    return store.import_rows(*_halves(spark, d), ["node_id"], "skip")


@query("import_overwrite", f"with {NODES}, {HALF} select * from th union all select * from mi where node_id not in (select node_id from th)")
def import_overwrite(spark, d):
    return store.import_rows(*_halves(spark, d), ["node_id"], "overwrite")


def _halves(spark, d):
    """Two overlapping exports of the same nodes."""
    n = T.nodes(spark, d).select("node_id", "name", "layer").distinct()
    last = F.substring("node_id", -1, 1)
    return n.where(last.between("0", "5")), n.where(last.between("4", "9")).withColumn("name", F.concat(F.lit("new "), "name"))


BACKUPS = "bk as (select space_id backup_id, case when ingest_count % 2 = 0 then 'full' else 'partial' end kind, coalesce(last_ingest_at, created_at) created_at, ingest_count bytes, coalesce(is_protected, false) keep_forever from spaces)"


@query(
    "backup_retention",
    f"""with {BACKUPS}, r as (select *, row_number() over (partition by kind order by created_at desc, backup_id desc) nth from bk), f as (select *, case when keep_forever then 'kept' when nth > case kind when 'full' then 5 else 8 end then 'beyond count' when created_at < {NOW_SQL} - interval 250 day then 'too old' else 'kept' end fv from r),
q as (select *, sum(case when fv = 'kept' then bytes else 0 end) over () total, coalesce(sum(case when fv = 'kept' and not keep_forever then bytes else 0 end) over (order by created_at, backup_id rows between unbounded preceding and 1 preceding), 0) freed from f)
select backup_id, case when fv <> 'kept' then fv when total - freed > 12000 and not keep_forever then 'above quota' else 'kept' end as verdict from q""",
)
def backup_retention(spark, d):
    """One backup per space: five full and eight partial ones, 250 days, 12,000 units."""
    s = T.table(spark, d, "spaces")
    b = s.select(F.col("space_id").alias("backup_id"), F.when(F.col("ingest_count") % 2 == 0, "full").otherwise("partial").alias("kind"), F.coalesce("last_ingest_at", "created_at").alias("created_at"), F.col("ingest_count").alias("bytes"), F.coalesce("is_protected", F.lit(False)).alias("keep_forever"))
    return store.backup_retention(b, T.now(), {"full": 5, "partial": 8}, 250, 12_000)
