"""All core queries by name, each with the DuckDB statement it is compared with."""

from __future__ import annotations

from memloom.plans import base, code, extras, graph, learning, live, memory, overview, retrieval, stats, streams, text, transfer, lifecycle  # noqa: F401


def flagship(spark, sf_dir):
    return base.QUERIES["retrieve_full"](spark, sf_dir)


def queries():
    return base.QUERIES


def oracle_sql():
    return base.ORACLES
