"""Exact vector search and BM25 text search for many queries at once."""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from memloom.sources.shared import materialize
from memloom.sources.small import join_small

QUERY_TILE, CORPUS_TILE = 2048, 16_384  # rows of a space that meet in one task
BLOCK = 256  # queries multiplied at a time: 32 MB of products
TEXT_QUERY_TILE, TEXT_TILE = 4096, 16_384  # the same of texts
COUNTED = 1 << 19  # terms whose documents a task counts before it passes them on


def _once(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one id and one vector once."""
    several = rows["id"].duplicated(keep=False).to_numpy()
    if not several.any():
        return rows
    again = rows[several].assign(vec=[np.asarray(v).tobytes() for v in rows.loc[several, "vec"]]).duplicated(["id", "vec"]).to_numpy()
    keep = np.ones(len(rows), bool)
    keep[np.flatnonzero(several)[again]] = False
    return rows[keep]


def _nearest(k: int, least: float):
    def run(key, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"query_id": [], "node_id": [], "sim": []}, dtype=object)
        asked, rows = _once(asked), _once(rows)
        q, x = (np.stack(p["vec"].to_numpy()).astype(np.float64) for p in (asked, rows))
        q, x = (y / np.sqrt((y * y).sum(1))[:, None] for y in (q, x))
        ids, names = asked["id"].to_numpy(), rows["id"].to_numpy()
        rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")
        place = {n: i for i, n in enumerate(names)}
        self_at = np.array([place.get(i, -1) for i in ids])
        out = []
        for i in range(0, len(q), BLOCK):
            s = np.round(q[i : i + BLOCK] @ x.T + 1e-9, 6)
            mine = np.flatnonzero(self_at[i : i + BLOCK] >= 0)
            s[mine, self_at[i : i + BLOCK][mine]] = -2
            low = np.full(len(s), max(least, -1.0))
            if s.shape[1] > k:
                low = np.maximum(low, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            r, c = np.nonzero(s >= low[:, None])
            order = np.lexsort((rank[c], -s[r, c], r))
            r, c = r[order], c[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append(pd.DataFrame({"query_id": ids[i + r[first]], "node_id": names[c[first]], "sim": s[r[first], c[first]]}))
        return pd.concat(out, ignore_index=True)

    return run


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int = 20, least: float = -1.0, query_tile: int = QUERY_TILE, corpus_tile: int = CORPUS_TILE) -> DataFrame:
    """``(query_id, node_id, sim, rank)``: the ``k`` most similar of the same space, ties by node_id.

    Both frames are (space_id, id, vec) with vectors of one length.  Queries and
    corpus of a space are cut into tiles, each pair of which meets in one task and
    passes on ``k`` rows per query; a space without queries does not move.  A query
    does not find itself.  A row that comes several times counts once.
    """
    sizes = lambda df, tile, name: df.groupBy("space_id").agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    # A row per space that is asked.
    cut = materialize(sizes(queries, query_tile, "qs").join(sizes(corpus, corpus_tile, "cs"), "space_id"), "tiles")
    asked = join_small(queries.select("space_id", "id", "vec"), cut, "space_id", "inner").select(
        F.col("space_id").alias("g"), F.pmod(F.xxhash64("id"), "qs").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), F.col("id").alias("id"), F.col("vec").alias("vec")
    )
    rows = join_small(corpus.select("space_id", "id", "vec"), cut, "space_id", "inner").select(
        F.col("space_id").alias("space"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qt"), F.pmod(F.xxhash64("id"), "cs").cast("int").alias("ct"), F.col("id").alias("id"), F.col("vec").alias("vec")
    )
    local = asked.groupBy("g", "q", "c").cogroup(rows.groupBy("space", "qt", "ct")).applyInPandas(_nearest(k, least), "query_id string, node_id string, sim double")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "node_id")))
    return ranked.where(F.col("rank") <= k)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words(text: Column) -> Column:
    """The ``terms`` with a blank between each two: a string moves at a fraction of an array's bytes."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def _counted(most: int):
    """(space_id, term, df): the documents of a space in which a term stands, per task; a term may come again."""

    def run(batches):
        found: dict[str, Counter] = {}
        told = lambda: pa.RecordBatch.from_pydict({"space_id": [s for s, c in found.items() for _ in c], "term": [t for c in found.values() for t in c], "df": [n for c in found.values() for n in c.values()]}, OCCURRENCES)
        for batch in batches:
            for space, text in zip(batch["space_id"].to_pylist(), batch["t"].to_pylist()):
                if space not in found:
                    found[space] = Counter()
                found[space].update(set(text.split(" ")))
            if sum(map(len, found.values())) > most:
                yield told()
                found = {}
        yield told()

    return run


OCCURRENCES = pa.schema([("space_id", pa.string()), ("term", pa.string()), ("df", pa.int64())])


def _texts(k: int, k1: float, b: float):
    """Scores of a tile of queries over a tile of documents: a row of sums over the documents, a query at a time."""

    def run(key, asked: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], []]
        if len(asked) and len(docs):
            docs = docs.iloc[np.argsort(docs["node_id"].fillna("").to_numpy(), kind="stable")]
            names, node = pd.unique(docs["node_id"]), pd.factorize(docs["node_id"], use_na_sentinel=False)[0]
            code: dict[str, int] = {}
            wants = [[code.setdefault(t, len(code)) for t in terms] for terms in asked["terms"]]
            # (term, document, times) of the terms that are asked.
            texts = [t.split(" ") for t in docs["t"]]
            rows = np.repeat(np.arange(len(docs)), [len(t) for t in texts])
            found = np.fromiter(map(code.get, chain.from_iterable(texts), repeat(-1)), np.int64, len(rows))
            at, tf = np.unique(found[found >= 0] * len(docs) + rows[found >= 0], return_counts=True)
            term, row = np.divmod(at, len(docs))
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * docs["len"].to_numpy()[row] / asked["avg_len"].iloc[0]))
            # Texts of one node add up.
            first = np.flatnonzero(np.diff(term * len(names) + node[row], prepend=-1))
            part, place, term = (np.add.reduceat(part, first) if len(first) else part), node[row][first], term[first]
            start = np.searchsorted(term, np.arange(len(code) + 1))
            total = np.zeros(len(names))
            for query, codes, idf, parted in zip(asked["query_id"], wants, asked["idf"], asked["parted"]):
                total[:] = 0
                for c, weight in zip(codes, idf):
                    total[place[start[c] : start[c + 1]]] += weight * part[start[c] : start[c + 1]]
                hit = np.flatnonzero(total)
                if len(hit) > k and not parted:  # a part of a sum decides nothing
                    low = np.partition(total[hit], len(hit) - k)[len(hit) - k]
                    hit = hit[total[hit] >= low - 2e-6]
                    hit = hit[np.lexsort((hit, -np.round(total[hit] + 1e-9, 6)))[:k]]
                out[0].append(np.full(len(hit), query, dtype=object))
                out[1].append(names[hit])
                out[2].append(total[hit])
        return pd.DataFrame({n: np.concatenate(x) if x else np.array([], dtype=kind) for n, x, kind in zip(("query_id", "node_id", "score"), out, (object, object, float))})

    return run


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int = 100, k1: float = 1.2, b: float = 0.75, query_tile: int = TEXT_QUERY_TILE, doc_tile: int = TEXT_TILE) -> DataFrame:
    """``(query_id, node_id, score, rank)`` by Okapi BM25 within the query's space.

    ``queries`` is (space_id, query_id, text), ``docs`` (space_id, node_id, text);
    statistics are per space.  Query terms count once; texts without terms find
    nothing.  Queries and documents of a space are cut into tiles, each pair of
    which meets in one task and passes on ``k`` rows per query: neither postings
    nor scores move.  A query of several spaces passes on all, as its scores add up.
    """
    d = docs.where("space_id is not null").select("space_id", "node_id", words(F.col("text")).alias("t"))
    d = d.withColumn("len", F.when(F.col("t") == "", 0).otherwise(F.length("t") - F.length(F.replace("t", F.lit(" "))) + 1))
    d = materialize(d.groupBy("space_id", "node_id", "len").agg(F.array_join(F.collect_list("t"), " ").alias("t"), F.count("*").alias("copies")), "terms")
    stats = d.groupBy("space_id").agg(F.sum("copies").alias("n"), (F.sum(F.col("len") * F.col("copies")) / F.sum("copies")).alias("avg_len"), F.ceil(F.count("*") / doc_tile).cast("int").alias("cs"))
    df = d.where("len > 0").select("space_id", "t").mapInArrow(_counted(COUNTED), "space_id string, term string, df long").groupBy("space_id", "term").agg(F.sum("df").alias("df"))
    asked = queries.select("space_id", "query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct().join(df, ["space_id", "term"]).join(stats, "space_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.groupBy("space_id", "query_id").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("x"), F.first("avg_len").alias("avg_len"), F.first("cs").alias("cs"))
    asked = materialize(asked.select("space_id", "query_id", F.col("x.term").alias("terms"), F.col("x.idf").alias("idf"), "avg_len", "cs", (F.count("*").over(Window.partitionBy("query_id")) > 1).alias("parted")), "wanted")
    # A row per space that is asked.
    cut = materialize(asked.groupBy("space_id").agg(F.ceil(F.count("*") / query_tile).cast("int").alias("qs"), F.first("cs").alias("cs")), "tiles")
    left = join_small(asked.drop("cs"), cut, "space_id", "inner").select(
        F.col("space_id").alias("g"), F.pmod(F.xxhash64("query_id"), "qs").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), "query_id", "terms", "idf", "avg_len", "parted"
    )
    right = join_small(d.where("len > 0"), cut, "space_id", "inner").select(
        F.col("space_id").alias("space"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qt"), F.pmod(F.xxhash64("node_id"), "cs").cast("int").alias("ct"), "node_id", "len", "t"
    )
    local = left.groupBy("g", "q", "c").cogroup(right.groupBy("space", "qt", "ct")).applyInPandas(_texts(k, k1, b), "query_id string, node_id string, score double")
    scored = local.repartition("query_id").groupBy("query_id", "node_id").agg(F.round(F.sum("score") + 1e-9, 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")))
    return ranked.where(F.col("rank") <= k)
