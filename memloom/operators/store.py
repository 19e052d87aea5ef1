"""Snapshots of tables: upserts, batch ingest with row states, export and import, retention of backups."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert_nodes(nodes: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """The next snapshot of ``nodes`` after ``items`` (space_id, path, node_id, name, summary, tags).

    An item meets a node of its space by path, or by id if it has no path; a met
    node takes the item's non-null fields, one more version and the time; the
    rest become nodes.  Several items for one key count as one, the last by id.
    """
    key = F.concat_ws("|", "space_id", F.coalesce("path", "node_id"))
    last = items.withColumn("k", key).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("node_id")))).where("r = 1").drop("r")
    old = nodes.withColumn("k", key)
    i = last.select("k", *[F.col(c).alias(f"new_{c}") for c in ("space_id", "path", "node_id", "name", "summary", "tags")], F.lit(True).alias("given"))
    both = old.join(i, "k", "full_outer")
    met = F.col("given") & F.col("node_id").isNotNull()
    made = F.sha2(F.concat_ws("/", "new_space_id", F.coalesce("new_path", "new_node_id")), 256)
    return both.select(
        F.coalesce("space_id", "new_space_id").alias("space_id"), F.coalesce("node_id", "new_node_id", F.concat(F.lit("n"), F.substring(made, 1, 16))).alias("node_id"), F.coalesce("path", "new_path").alias("path"),
        F.coalesce("new_name", "name").alias("name"), F.coalesce("new_summary", "summary").alias("summary"), F.coalesce("new_tags", "tags").alias("tags"),
        F.when(met, F.col("version") + 1).otherwise(F.coalesce("version", F.lit(1))).alias("version"), F.when(F.col("given"), now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(met, "updated").when(F.col("given"), "created").otherwise("kept").alias("change"),
    )


def ingest_states(items: DataFrame, most: int = 2000) -> DataFrame:
    """``(batch_id, item, status, error)``: items without source or timestamp fail alone, the others go on.

    ``items`` is (batch_id, item, source, timestamp, path, content); a batch of
    more than ``most`` items is refused whole.
    """
    n = F.count("*").over(Window.partitionBy("batch_id"))
    bad = F.when(n > most, "batch too large").when(F.coalesce(F.trim("source"), F.lit("")) == "", "source is missing").when(F.col("timestamp").isNull(), "timestamp is missing").when(F.length("path") > 512, "path is too long")
    return items.withColumn("error", bad).select("batch_id", "item", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error")


PROFILES = {"full": ("nodes", "edges", "observations", "symbols"), "codebase": ("nodes", "symbols"), "cms": ("observations",), "learned": ("edges",), "metadata": ()}


def export_space(tables: dict[str, DataFrame], folder: str, profile: str = "full", since: str | None = None, embeddings: bool = True) -> dict:
    """Write the tables of a profile below ``folder`` as Parquet, with a manifest; archived nodes stay out.

    ``since`` keeps rows updated at or after that time.  The manifest has each
    table's rows and an order-free checksum, and is written last: a folder
    without one is no export.
    """
    spark = next(iter(tables.values())).sparkSession
    manifest = {"id": uuid.uuid4().hex, "profile": profile, "since": since, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "tables": {}}
    for name in PROFILES[profile]:
        if name not in tables:
            continue
        df = tables[name]
        if "is_archived" in df.columns:
            df = df.where("not coalesce(is_archived, false)")
        if since is not None and "updated_at" in df.columns:
            df = df.where(F.col("updated_at") >= F.lit(since).cast("timestamp"))
        if not embeddings and "embedding" in df.columns:
            df = df.drop("embedding")
        df.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")
        back = spark.read.parquet(f"{folder}/{name}.parquet")
        r = back.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).alias("h")).first()
        manifest["tables"][name] = {"rows": r["n"], "checksum": str(r["h"])}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def read_export(spark, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and tables of an export; a table that does not have the rows and checksum told raises."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    out = {}
    for name, told in manifest["tables"].items():
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
        if r["n"] != told["rows"] or str(r["h"]) != told["checksum"]:
            raise ValueError(f"{name} differs from its manifest")
        out[name] = df
    return manifest, out


def import_rows(mine: DataFrame, theirs: DataFrame, keys: list[str], mode: str = "skip") -> DataFrame:
    """``mine`` with the rows of ``theirs``: ``skip`` keeps mine on conflict, ``overwrite`` takes theirs, ``error`` raises on any conflict."""
    if mode == "error":
        if mine.join(theirs.select(keys), keys, "left_semi").limit(1).count():
            raise ValueError("rows of the import exist already")
        return mine.unionByName(theirs)
    if mode == "overwrite":
        return mine.join(theirs.select(keys), keys, "left_anti").unionByName(theirs)
    if mode == "skip":
        return mine.unionByName(theirs.join(mine.select(keys), keys, "left_anti"))
    raise ValueError(f"unknown mode {mode}")


def backup_retention(backups: DataFrame, now: Column, keep: dict[str, int], max_age_days: int, quota: int) -> DataFrame:
    """``(backup_id, verdict)``: beyond the newest N of its type, too old, or, oldest first, above the quota; keep-forever is exempt.

    ``backups`` is (backup_id, kind, created_at, bytes, keep_forever).
    """
    limit = F.create_map(*[F.lit(x) for kv in keep.items() for x in kv])[F.col("kind")]
    b = backups.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("created_at"), F.desc("backup_id"))))
    old = F.col("created_at") < now - F.make_dt_interval(F.lit(max_age_days))
    first = F.when(F.col("keep_forever"), "kept").when(F.col("nth") > limit, "beyond count").when(old, "too old").otherwise("kept")
    b = b.withColumn("first", first)
    # What the oldest deletable ones before this one already free decides whether this one must go, too.
    left = F.sum(F.when(F.col("first") == "kept", F.col("bytes")).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    freed = F.sum(F.when((F.col("first") == "kept") & ~F.col("keep_forever"), F.col("bytes")).otherwise(0)).over(Window.partitionBy(F.lit(1)).orderBy("created_at", "backup_id").rowsBetween(Window.unboundedPreceding, -1))
    over = left - F.coalesce(freed, F.lit(0)) > quota
    return b.select("backup_id", F.when(F.col("first") != "kept", F.col("first")).when(over & ~F.col("keep_forever"), "above quota").otherwise("kept").alias("verdict"))
