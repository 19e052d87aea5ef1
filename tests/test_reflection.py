"""Reflection from each query's own nodes."""

import os

import pytest
from pyspark.sql import functions as F

from memloom.operators import graph as G
from memloom.plans import registry

QUERIES = registry.queries()
FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_bfs_stops_where_a_root_is_full(spark):
    edges = spark.createDataFrame([(0, k) for k in range(1, 6)] + [(k, k + 10) for k in range(1, 6)] + [(9, 1)], "src int, dst int")
    seeds = spark.createDataFrame([("r", 0), ("s", 9)], "root string, node int")
    got = sorted((r["root"], r["node"], r["distance"]) for r in G.bfs(seeds, edges, 3, 4).collect())
    assert got == [("r", 0, 0), ("r", 1, 1), ("r", 2, 1), ("r", 3, 1), ("s", 1, 1), ("s", 9, 0), ("s", 11, 2)]


@needs_tables
def test_reflection_starts_from_each_query(spark):
    near = QUERIES["vector_topk"](spark, FOLDER).select("query_id").distinct().count()
    got = QUERIES["reflect_queries"](spark, FOLDER)
    assert got.where("distance = 0").select("root").distinct().count() == near > 0
    assert got.groupBy("root").count().agg(F.max("count")).first()[0] <= 200
