"""Connected components as a loop of joins and aggregations.

Every round lets each node take the smallest label among itself and its
neighbours and then jump to the label of that label, so the number of rounds is
logarithmic in the diameter for the usual shapes and at worst its length.  Each
round is written to the shared folder; the loop stops when no label changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memloom.sources.shared import drop_materialized, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """Label every node that occurs in ``edges`` with the smallest node id of its component.

    Returns ``(node, component)``.  Direction, repeated edges and self loops do
    not matter; edges with a null end are ignored; an empty input gives no rows.
    Ids may be of any ordered type.  Raises if ``max_rounds`` does not suffice
    instead of returning partial labels.
    """
    spark = edges.sparkSession
    # The edges are read several times; they are worked out once.
    pair = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"), "pairs")
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(pair.where("a <> b").select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct(), "edges")
    loops = pair.where("a = b").select(F.col("a").alias("node"))
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels"
    )
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        nxt = materialize(
            moved.join(jump, "low", "left").select("node", "was", F.least("low", F.coalesce("further", "low")).alias("label")), "labels"
        )
        changed = nxt.where("label <> was").limit(1).count()
        drop_materialized(spark, labels)
        labels = nxt.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = labels.select("node", F.col("label").alias("component"))
    alone = loops.distinct().join(out.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return out.unionByName(alone)
