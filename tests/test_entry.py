"""The registered queries at the smallest size, against DuckDB where there is a statement."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = ["layer_counts", "space_health", "score_distribution", "rrf_fusion", "percentile_confidence", "hebbian_edges", "session_coactivation", "observation_relevance", "term_novelty", "temporal_intents", "constraint_detection", "ingest_upsert", "backup_retention"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    told = duck.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in told.description].index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in told.fetchall()) and got


def test_flagship_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
