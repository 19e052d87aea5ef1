"""The stored tables as the model tables: repeated rows once, null defaults, typed edges.

Every reader takes (spark, folder) and returns a lazy frame; filters and column
choices of the caller reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from memloom.functions import scoring as S

#: As-of clock of all reports, so that results do not depend on the day they are made.
NOW = "2025-12-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    # Parquet timestamps without a zone are read as UTC.
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def nodes(spark: SparkSession, folder: str, once: bool = True) -> DataFrame:
    """One row per node; null layer 0, confidence 0.6, tags empty, is_archived false; ``at`` is the time scoring goes by.

    Without ``once`` repeated rows stay, for what they can't change: nothing moves then.
    """
    df = table(spark, folder, "nodes")
    return (df.distinct() if once else df).withColumns(
        {
            "layer": F.coalesce("layer", F.lit(0)),
            "confidence": F.coalesce("confidence", F.lit(0.6)),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "is_archived": F.coalesce("is_archived", F.lit(False)),
            "at": F.coalesce("canonical_time", "updated_at"),
        }
    )


def observations(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per observation with the given columns; deliveries differ in nothing but ``ingested_at``."""
    return table(spark, folder, "observations").select("obs_id", *[c for c in columns if c != "obs_id"]).distinct()


def text_of(content: str = "content", summary: str = "summary") -> Column:
    return F.when(F.trim(content) != "", F.col(content)).otherwise(F.col(summary))


def similar_edges(spark: SparkSession, folder: str) -> DataFrame:
    """``ASSOCIATED_WITH``: links found at ingest, weight 0.5, the similarity as semantic dimension."""
    df = table(spark, folder, "similar_nodes").where("score is not null and node_id <> similar_node_id")
    once = df.groupBy("space_id", F.col("node_id").alias("src"), F.col("similar_node_id").alias("dst")).agg(F.max("score").alias("dim_semantic"), F.max("linked_at").alias("updated_at"))
    return once.select(
        "space_id", "src", "dst", F.lit("ASSOCIATED_WITH").alias("rel_type"), F.lit(0.5).alias("weight"), "dim_semantic", F.lit(0.0).alias("dim_temporal"),
        F.lit(0.0).alias("dim_coactivation"), F.lit(1).cast("long").alias("evidence"), F.lit(1.0).alias("surprise"), "updated_at",
    )


def hierarchy_edges(spark: SparkSession, folder: str) -> DataFrame:
    """``GENERALIZES`` (layer 0 to 1) and ``ABSTRACTS_TO`` (above): a node and the first node one layer up in its session."""
    read = lambda once: nodes(spark, folder, once).where("role_type = 'conversation_observation'").withColumn("session", F.split("path", "/")[2])
    n, up = read(True), read(False).where("layer > 0").groupBy("space_id", "session", (F.col("layer") - 1).alias("layer")).agg(F.min("node_id").alias("dst"))
    return n.join(up, ["space_id", "session", "layer"]).select(
        "space_id", F.col("node_id").alias("src"), "dst", F.when(F.col("layer") == 0, "GENERALIZES").otherwise("ABSTRACTS_TO").alias("rel_type"), F.col("confidence").alias("weight"),
        F.lit(0.0).alias("dim_semantic"), F.lit(0.0).alias("dim_temporal"), F.lit(0.0).alias("dim_coactivation"), F.lit(1).cast("long").alias("evidence"), F.lit(1.0).alias("surprise"), "updated_at",
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval results, a node once per query: its best score, similarity and activation."""
    df = table(spark, folder, "retrieve_results").where("node_id is not null")
    return df.groupBy("query_id", "space_id", "node_id").agg(
        F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score"),
        F.max(F.when(~F.isnan("vector_sim"), F.col("vector_sim"))).alias("vector_sim"),
        F.max(F.when(~F.isnan("activation"), F.col("activation"))).alias("activation"),
        F.max("layer").alias("layer"),
        F.min("path").alias("path"),
        F.min("retrieved_at").alias("retrieved_at"),
    )


def coactivation_pairs(spark: SparkSession, folder: str, per_query: int = 200, of_node: DataFrame | None = None) -> DataFrame:
    """The ``per_query`` pairs of highest activation product of each query, of eligible base nodes.

    A pair of ranks i < j has i * j - i * (i + 1) / 2 pairs at least as high, so
    only pairs up to that bound are formed; a query of any size forms a few hundred.
    ``of_node`` (node_id, s), a row per node, adds ``s``: the greater one of both ends,
    0 if neither has one.
    """
    ok = results(spark, folder).where((F.coalesce("layer", F.lit(0)) == 0) & (F.col("activation") >= 0.2))
    ok = ok.withColumn("s", F.lit(None).cast("double")) if of_node is None else ok.join(of_node, "node_id", "left")
    ranked = ok.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("activation"), "node_id"))).where(F.col("i") <= per_query + 1)
    a = ranked.select("query_id", "space_id", F.col("node_id").alias("n1"), F.col("activation").alias("a1"), F.col("i").alias("i"), "retrieved_at", F.coalesce("s", F.lit(0.0)).alias("s1"))
    b = ranked.select("query_id", F.col("node_id").alias("n2"), F.col("activation").alias("a2"), F.col("i").alias("j"), F.coalesce("s", F.lit(0.0)).alias("s2"))
    pairs = a.join(b, "query_id").where((F.col("i") < F.col("j")) & (F.col("i") * F.col("j") - F.col("i") * (F.col("i") + 1) / 2 <= per_query))
    pairs = pairs.withColumn("product", F.round(F.col("a1") * F.col("a2"), 9)).withColumn("src", F.least("n1", "n2")).withColumn("dst", F.greatest("n1", "n2"))
    top = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("product"), "i", "j"))).where(F.col("r") <= per_query)
    out = top.select("query_id", "space_id", "src", "dst", "product", "retrieved_at", "a1", "a2", F.greatest("s1", "s2").alias("s"))
    return out.drop("s") if of_node is None else out


def learned_edges(spark: SparkSession, folder: str) -> DataFrame:
    """``CO_ACTIVATED_WITH`` in both directions: pairs folded in time through the Hebbian rule."""
    surprise = observations(spark, folder, "node_id", "surprise_score").groupBy("node_id").agg(F.max("surprise_score").alias("s"))
    pairs = coactivation_pairs(spark, folder, of_node=surprise)
    steps = pairs.groupBy("space_id", "src", "dst").agg(
        F.array_sort(F.collect_list(F.struct("retrieved_at", "query_id", "product"))).alias("steps"), F.count("*").alias("evidence"), F.max("retrieved_at").alias("updated_at"), F.max("s").alias("s")
    )
    factor = steps.withColumn("surprise", S.surprise_factor(F.col("s")))
    weight = F.aggregate("steps", F.lit(0.1) * F.col("surprise"), lambda w, x: S.hebbian(w, x["product"], F.lit(1.0)))
    # Both directions from one row: a union would fold every edge twice.
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    return factor.select("space_id", both, weight.alias("weight"), "evidence", "surprise", "updated_at").select(
        "space_id", "e.src", "e.dst", F.lit("CO_ACTIVATED_WITH").alias("rel_type"), "weight", F.lit(0.0).alias("dim_semantic"), F.lit(0.0).alias("dim_temporal"),
        F.lit(1.0).alias("dim_coactivation"), "evidence", "surprise", "updated_at",
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return similar_edges(spark, folder).unionByName(hierarchy_edges(spark, folder)).unionByName(learned_edges(spark, folder))
