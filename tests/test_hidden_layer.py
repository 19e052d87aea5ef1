"""Clusters of base nodes and how large ones are cut."""

from pyspark.sql import functions as F

from memloom.operators import graph as G


def test_clusters_are_cut_above_the_limit_only(spark):
    rows = [("a", f"a{k:03}", "/x/y/z") for k in range(21)] + [("b", f"b{k:03}", "/p/q/r" if k < 203 else "/p/s/r") for k in range(206)] + [("c", "c0", None), ("c", "c1", "")]
    got = G.split_clusters(spark.createDataFrame(rows, "cluster string, id string, path string")).groupBy("hidden_id").agg(F.count("*").alias("n")).collect()
    assert {r["hidden_id"]: r["n"] for r in got} == {"a": 21, "b#p/q#0": 200, "b#p/q#1": 3, "b#p/s#0": 3}
