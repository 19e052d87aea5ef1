"""Registration of queries and the common table expressions of their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F

from memloom.sources.tables import NOW

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def r6(column):
    """Six decimals in both engines: means of given decimals often lie exactly between two, so both are nudged up."""
    return F.round(F.col(column) + 1e-9 if isinstance(column, str) else column + 1e-9, 6)


def _nudged(sql: str) -> str:
    """``round(x, 6)`` as ``r6`` does it."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = _nudged(sql[start + 6 : end - 1])
        out.append(sql[at:start] + (f"round(({inner[:-3]}) + 1e-9, 6)" if inner.endswith(", 6") else f"round({inner})"))
        at = end
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None):
    """Registers a query; ``@other@`` in its statement stands for the statement of another query."""

    def add(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = re.sub(r"@(\w+)@", lambda m: f"({ORACLES[m[1]]})", _nudged(sql))
        return run

    return add


NODES = """nodes_m as (select distinct space_id, node_id, path, name, summary, coalesce(layer, 0) layer, role_type, coalesce(tags, []) tags,
  coalesce(confidence, 0.6) confidence, created_at, updated_at, canonical_time, coalesce(is_archived, false) is_archived, coalesce(canonical_time, updated_at) as at_ from nodes)"""

ASSOC = """assoc as (select space_id, node_id src, similar_node_id dst, 'ASSOCIATED_WITH' rel_type, 0.5::double weight, max(score) dim_semantic, 0.0::double dim_temporal,
  0.0::double dim_coactivation, 1::bigint evidence, 1.0::double surprise, max(linked_at) updated_at from similar_nodes where score is not null and node_id <> similar_node_id group by all)"""

HIER = """conv as (select *, split_part(path, '/', 3) as session_ from nodes_m where role_type = 'conversation_observation'),
ups as (select space_id, session_, layer - 1 as layer, min(node_id) dst from conv where layer > 0 group by 1, 2, 3),
hier as (select c.space_id, c.node_id src, u.dst, case when c.layer = 0 then 'GENERALIZES' else 'ABSTRACTS_TO' end rel_type, c.confidence weight, 0.0::double dim_semantic, 0.0::double dim_temporal,
  0.0::double dim_coactivation, 1::bigint evidence, 1.0::double surprise, c.updated_at from conv c join ups u using (space_id, session_, layer))"""

RESULTS = """res as (select query_id, space_id, node_id, max(case when not isnan(score) then score end) score, max(case when not isnan(vector_sim) then vector_sim end) vector_sim,
  max(case when not isnan(activation) then activation end) activation, max(layer) as layer, min(path) as path, min(retrieved_at) retrieved_at
  from retrieve_results where node_id is not null group by query_id, space_id, node_id)"""

PAIRS = f"""{RESULTS},
elig as (select *, row_number() over (partition by query_id order by activation desc, node_id) i from res where coalesce(layer, 0) = 0 and activation >= 0.2),
allpairs as (select a.query_id, a.space_id, least(a.node_id, b.node_id) src, greatest(a.node_id, b.node_id) dst, round(a.activation * b.activation, 9) product, a.retrieved_at, a.i ia, b.i ib
  from elig a join elig b on a.query_id = b.query_id and a.i < b.i),
pairs as (select * from (select *, row_number() over (partition by query_id order by product desc, ia, ib) r from allpairs) where r <= 200)"""

LEARNED = f"""{PAIRS},
sur as (select node_id, max(surprise_score) s from observations group by 1),
steps as (select space_id, src, dst, list(product order by retrieved_at, query_id) p, count(*) evidence, max(retrieved_at) updated_at from pairs group by all),
fac as (select st.*, case when greatest(coalesce(s1.s, 0), coalesce(s2.s, 0)) >= 0.7 then 2.0::double when greatest(coalesce(s1.s, 0), coalesce(s2.s, 0)) >= 0.4 then 1.5::double else 1.0::double end surprise
  from steps st left join sur s1 on s1.node_id = src left join sur s2 on s2.node_id = dst),
one as (select space_id, src, dst, 'CO_ACTIVATED_WITH' rel_type, list_reduce(list_prepend(0.1::double * surprise, p), lambda w, x: least(1.0::double, greatest(0.0::double, 0.99::double * w + 0.02::double * x))) weight,
  0.0::double dim_semantic, 0.0::double dim_temporal, 1.0::double dim_coactivation, evidence::bigint evidence, surprise, updated_at from fac),
learned as (select * from one union all select space_id, dst, src, rel_type, weight, dim_semantic, dim_temporal, dim_coactivation, evidence, surprise, updated_at from one)"""

EDGES = f"""{NODES}, {ASSOC}, {HIER}, {LEARNED}, edges_m as (select * from assoc union all select * from hier union all select * from learned)"""

NOW_SQL = f"timestamp '{NOW}'"
