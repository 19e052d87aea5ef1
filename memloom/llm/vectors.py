"""Most similar vectors of every vector: a block matrix join over int8 tiles.

Method: unit vectors are quantised to int8 with the exact length of their
rounding error, groups are cut into tiles, and each pair of tiles is multiplied
in integers.  The error lengths bound the true cosine on both sides, so a pair
is dropped only when it provably is not among the k best or below the
threshold.  What survives is recomputed in double precision and merged.
Equal vectors are one class throughout and never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from memloom.llm.workers import batched, cogrouped, grouped
from memloom.sources.shared import materialize
from memloom.sources.small import enough_tasks, join_small

TILE = 16384
BLOCK = 512
ROUNDING = 1e-6
DENSE = 64  # candidates of a vector in a pair of tiles, beyond which they aren't listed
NONE = np.zeros(0, np.int64)


def _usable(dim: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column("vec")
            right = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), dim), False))
            b = b.filter(pa.array(right))
            if not b.num_rows:
                continue
            flat = b.column("vec").flatten()
            x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            keep = np.isfinite(x).all(1) & (x != 0).any(1)
            raw = np.ascontiguousarray(x[keep].astype(np.float32))
            b = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("id"), pa.array([r.tobytes() for r in raw], pa.binary())], ["grp", "id", "raw"])

    return run


def vector_classes(df: DataFrame, group, item: str, vector: str, dim: int = 64, firsts: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)`` of the usable vectors.

    A vector is usable with exactly ``dim`` finite numbers, not all zero; a null
    id or group drops the row; an id delivered again counts once.
    ``members``: (grp, id, cls).  ``classes``: one row per different vector of a
    group, (grp, cls, raw, ids, head) with float32 bytes, the ``firsts``
    smallest ids of its copies and the smallest of all.
    """
    rows = df.select(F.expr(group).cast("string").alias("grp") if isinstance(group, str) else group.alias("grp"), F.col(item).alias("id"), F.col(vector).alias("vec"))
    parsed = enough_tasks(rows.where("grp is not null and id is not null and vec is not null"), "id").mapInArrow(batched(_usable(dim)), "grp string, id string, raw binary")
    coded = parsed.withColumn("cls", F.unhex(F.md5(F.concat(F.col("raw"), F.encode("grp", "utf-8")))))
    members = coded.select("grp", "id", "cls").distinct()
    # The rank limit is applied before the shuffle too, so a vector with millions of copies sends a few rows per task.
    ranked = coded.withColumn("r", F.dense_rank().over(Window.partitionBy("grp", "cls").orderBy("id"))).where(F.col("r") <= firsts)
    classes = ranked.groupBy("grp", "cls").agg(F.first("raw").alias("raw"), F.array_sort(F.collect_set("id")).alias("ids"))
    return members, classes.withColumn("head", F.col("ids")[0])


def tiled(classes: DataFrame, tile: int = TILE, key: str = "cls") -> DataFrame:
    """A row of ``classes`` for each pair of tiles of its group it takes part in: (grp, lo, hi, own) added.

    Only groups of more than ``tile`` rows are in the joined table, so it has at
    most rows / tile of them.
    """
    large = classes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("grp", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    k = F.coalesce("tiles", F.lit(1))
    own = join_small(classes, large, "grp").withColumn("own", F.pmod(F.xxhash64(key), k).cast("int")).withColumn("tiles", k)
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return both.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "tiles")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread groups over tasks by key; the number is fixed, as these tasks are heavy for their bytes."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _quantise(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        if not len(pdf):
            continue
        x = np.frombuffer(b"".join(pdf["raw"]), np.float32).reshape(len(pdf), -1).astype(np.float64)
        u = x / np.sqrt((x * x).sum(1))[:, None]
        step = np.abs(u).max(1) / 127
        q = np.rint(u / step[:, None])
        err = np.sqrt(((u - q * step[:, None]) ** 2).sum(1)) + 1e-9
        q8 = q.astype(np.int8)
        yield pd.DataFrame({"grp": pdf["grp"], "cid": pdf["cid"], "q": [r.tobytes() for r in q8], "step": step, "err": err})


def _tile_candidates(k: int, least: float, dense: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        sides = []
        for tile in dict.fromkeys((lo, hi)):
            p = pdf[pdf["own"] == tile]
            q = np.frombuffer(b"".join(p["q"]), np.int8).reshape(len(p), -1) if len(p) else np.zeros((0, 1), np.int8)
            # A product is at most 127 * 127 * dimensions: below 2^24 float32 has it exactly, whatever the order of addition, and float64 beyond.
            q = q.astype(np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64)
            sides.append((q, p["step"].to_numpy(np.float64), p["err"].to_numpy(np.float64), p["cid"].to_numpy()))
        rows, partners = [], []
        for x, y in [(0, 0)] if lo == hi else [(0, 1), (1, 0)]:
            (qx, sx, ex, cx), (qy, sy, ey, cy) = sides[x], sides[y]
            if not len(qx) or not len(qy):
                continue
            # |u.w - u'.w'| <= |e||w'| + |u'||f| + |e||f|, and |u'| <= 1 + |e|; scaling an exact
            # product of at most (1 + |e|)(1 + |f|) twice in float32 errs by less than 1e-6, for which 1e-5 stands.
            f = float(ey.max())
            eps = (ex * (1 + f) + f * (1 + ex) + ex * f + 1e-5).astype(np.float32)
            wide = np.zeros(len(qy), bool)
            for i in range(0, len(qx), BLOCK):
                on = slice(i, i + BLOCK)
                s = (qx[on] @ qy.T) * sy.astype(np.float32)
                s *= sx[on, None].astype(np.float32)
                if x == y:
                    s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
                near = s >= (least - ROUNDING - eps[on])[:, None]
                many = np.flatnonzero(near.sum(1) > k)
                if len(many):
                    # What cannot reach the k-th best even at the ends of both error bounds.
                    kth = np.partition(s[many], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    near[many] &= s[many] >= (kth - 2 * eps[on][many] - 2 * ROUNDING)[:, None]
                n = near.sum(1)
                crowd = np.flatnonzero(n > dense)
                if len(crowd):
                    # Too alike for the bounds: these rows are compared with all such columns in double precision.
                    wide |= near[crowd].any(0)
                    rows += cx[on][crowd].tolist()
                    partners += [NONE] * len(crowd)
                    near[crowd] = False
                    n[crowd] = 0
                r, c = np.nonzero(near)
                has = np.flatnonzero(n)
                rows += cx[on][has].tolist()
                partners += np.split(cy[c], np.cumsum(n[has])[:-1]) if len(has) else []
            if wide.any():
                rows.append(-1)  # no class: it only names the vectors that the rows above need
                partners.append(cy[wide])
        out = pd.DataFrame({"a": np.array(rows, np.int64), "partners": pd.Series(partners, dtype=object)})
        return out.assign(grp=pdf["grp"].iloc[0], lo=lo, hi=hi)[["grp", "lo", "hi", "a", "partners"]]

    return run


def _best(own: np.ndarray, to: np.ndarray, sim: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each ``own``, ties by ``rank``."""
    order = np.lexsort((rank[to], -sim, own))
    o = own[order]
    return order[np.arange(len(o)) - np.searchsorted(o, o) < k]


def _exact(k: int, least: float):
    def run(key, pairs: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(vectors):
            return pd.DataFrame({"cid": [], "to": [], "sim": []}, dtype=object)
        order = np.argsort(vectors["cid"].to_numpy())
        cid, head = vectors["cid"].to_numpy()[order], vectors["head"].to_numpy()[order]
        x = np.frombuffer(b"".join(vectors["raw"].to_numpy()[order]), np.float32).reshape(len(cid), -1).astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        rank = np.argsort(np.argsort(head))
        pairs = pairs[pairs["a"] >= 0]
        sizes = pairs["partners"].map(len).to_numpy(np.int64)
        own, to, sim = [], [], []
        few = pairs[sizes > 0]
        if len(few):
            ia = np.searchsorted(cid, np.repeat(few["a"].to_numpy(), sizes[sizes > 0]))
            ib = np.searchsorted(cid, np.concatenate(few["partners"].to_numpy()))
            for i in range(0, len(ia), 65536):
                j, m = ia[i : i + 65536], ib[i : i + 65536]
                s = np.round(np.einsum("ij,ij->i", x[j], x[m]) / (norm[j] * norm[m]), 6)
                own.append(j[s >= least])
                to.append(m[s >= least])
                sim.append(s[s >= least])
        crowd = np.searchsorted(cid, pairs["a"].to_numpy()[sizes == 0])
        for i in range(0, len(crowd), 256):
            j = crowd[i : i + 256]
            s = np.round((x[j] @ x.T) / (norm[j][:, None] * norm), 6)
            s[np.arange(len(j)), j] = -2
            if s.shape[1] > k:
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                s[s < kth[:, None]] = -2
            r, c = np.nonzero(s >= least)
            best = _best(r, c, s[r, c], rank, k)
            own.append(j[r[best]])
            to.append(c[best])
            sim.append(s[r[best], c[best]])
        if not own:
            return pd.DataFrame({"cid": [], "to": [], "sim": []}, dtype=object)
        own, to, sim = np.concatenate(own), np.concatenate(to), np.concatenate(sim)
        best = _best(own, to, sim, rank, k)
        return pd.DataFrame({"cid": cid[own[best]], "to": cid[to[best]], "sim": sim[best]})

    return run


def most_similar(df: DataFrame, group: str, item: str, vector: str, k: int = 5, least: float = 0.8, dim: int = 64, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """``(grp, id, similar, sim, rank)``: the ``k`` most similar others of each vector's group, if at least ``least``.

    Similarity is the cosine in double precision, rounded to six decimals; ties
    go to the smaller id.  Vectors of another length, all zero, null or with
    null or infinite numbers take no part; repeated ids count once.  The result
    is exact: the int8 products only discard pairs their error bounds rule out.
    Where more than ``dense`` others of a vector lie within the bounds of its k
    best, they are not listed but compared in double precision by the block, so
    a crowd of near-equal vectors costs products, not rows.
    """
    members, classes = vector_classes(df, group, item, vector, dim, k + 1)
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    coded = classes.select("grp", "cid", "raw").mapInPandas(batched(_quantise), "grp string, cid long, q binary, step double, err double")
    keys = ["grp", "lo", "hi"]
    candidates = materialize(
        spread(tiled(coded, tile, "cid"), *keys).groupBy(*keys).applyInPandas(grouped(_tile_candidates(k, least, dense)), "grp string, lo int, hi int, a long, partners array<long>"), "candidates"
    )
    named = [F.col("grp").alias("g"), F.col("lo").alias("l"), F.col("hi").alias("h")]
    wanted = candidates.select(*named, F.explode(F.concat(F.array("a"), "partners")).alias("cid")).distinct()
    vectors = wanted.join(classes.select("cid", "raw", "head"), "cid")
    offers = candidates.groupBy(*keys).cogroup(vectors.groupBy("g", "l", "h")).applyInPandas(cogrouped(_exact(k, least)), "cid long, to long, sim double")
    heads = classes.select("cid", "ids", "head", F.lit(1.0).alias("sim"))
    # A crowded vector is compared with all vectors at hand, so another pair of tiles may offer the same.
    offers = offers.groupBy("cid", "to").agg(F.max("sim").alias("sim"))
    offered = offers.join(heads.select(F.col("cid").alias("to"), "ids", "head"), "to")
    best = offered.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("sim"), "head"))).where(F.col("r") <= k).select("cid", "sim", "ids")
    # A class offers its smallest ids to its own members as well.
    own = heads.where(F.size("ids") > 1).select("cid", "sim", "ids")
    choice = best.unionByName(own).select("cid", "sim", F.explode("ids").alias("similar"))
    top = choice.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("sim"), "similar"))).where(F.col("r") <= k + 1).select("cid", "sim", "similar")
    # Of k + 1 offers a member has at most itself to leave out.
    lists = top.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("down"), "similar"))).alias("offers"))
    mine = members.join(classes.select("cls", "cid").join(lists, "cid"), "cls").select("grp", "id", F.slice(F.filter("offers", lambda o: o["similar"] != F.col("id")), 1, k).alias("offers"))
    return mine.select("grp", "id", F.posexplode("offers")).select("grp", "id", F.col("col.similar").alias("similar"), (-F.col("col.down")).alias("sim"), (F.col("pos") + 1).alias("rank"))
