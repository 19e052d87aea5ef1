"""Groups of records that share most of their words: a join over count-vector R-trees.

Method: the distinct words of a record are hashed into groups, and the record
becomes the point of its group counts.  The words two records share are at most
the summed minima of their points, and for two boxes of points the summed minima
of the upper corners; what falls below the needed overlap is dropped unseen.

The root of the tree routes by rare groups: with the groups of every record in
one order, rarest first, two records that reach the threshold must meet in one
of their first ``n - ceil(t * n) + 1`` groups, so a subtree holds the points that
have a group in that prefix, and only points of one subtree are compared.  A
subtree is packed bottom-up: its rows, sorted by size and coordinates, into pages,
pages into nodes of as many, and so on up to one root, each with the upper corner
and the range of sizes of what is below.  It is joined with itself from the root
down, and only pairs of boxes whose bound reaches the needed overlap are opened.
A subtree with very many rows is cut into tiles that are joined in pairs by
different tasks.  What survives is compared word for word, and groups are closed
over the matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.llm.vectors import spread
from memloom.llm.workers import batched, cogrouped
from memloom.operators.components import connected_components
from memloom.sources.shared import materialize
from memloom.sources.small import join_small

GROUPS, MOST_GROUPS = 1 << 18, 1 << 22  # fine groups, as many as records within these bounds; their frequencies are a table of 32 MB at most
DIMS = 128  # coordinates of a point, four bits each
PAGE = 16  # rows of a page, pages of a node, nodes of a node above
TILE = 8192
PAIRS = 1 << 16  # row pairs compared at a time: three arrays of 8 MB


def _needed(a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """The smallest overlap of sets of these sizes whose share of the union is t or more."""
    # o / (a + b - o) >= t  <=>  o >= t (a + b) / (1 + t), in whole numbers
    num, den = t.numerator, t.numerator + t.denominator
    return -((-num * (a + b)) // den)


def _frequencies(groups: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups, np.int64)
        for b in it:
            words = b.column("words")
            flat = words.flatten().to_numpy(zero_copy_only=False) & (groups - 1)
            row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
            total += np.bincount(np.unique(row * groups + flat) & (groups - 1), minlength=groups)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "n"])

    return run


def _route(frequency, t: Fraction):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequency.value
        for b in it:
            words = b.column("words")
            sizes = np.diff(words.offsets.to_numpy()).astype(np.int64)
            flat = words.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            g = flat & (len(often) - 1)
            point = np.zeros((len(sizes), DIMS), np.int32)
            np.add.at(point, (row, (flat >> 40) & (DIMS - 1)), 1)
            point = np.minimum(point, 15).astype(np.uint8)
            packed = point[:, ::2] | (point[:, 1::2] << 4)
            order = np.lexsort((g, often[g], row))
            start = np.cumsum(sizes) - sizes
            place = np.arange(len(row)) - np.repeat(start, sizes)
            prefix = sizes - -((-sizes * t.numerator) // t.denominator) + 1
            r, gs = row[order], g[order]
            # A group of one record has no second one to meet; a group twice in a record counts once.
            keep = (place < prefix[r]) & (often[gs] > 1)
            keep[1:] &= ~((gs[1:] == gs[:-1]) & (r[1:] == r[:-1]))
            r, gs, at = r[keep], gs[keep], place[keep]
            take = pa.array(r)
            blobs = pa.array([x.tobytes() for x in packed], pa.binary()).take(take)
            yield pa.RecordBatch.from_arrays(
                [b.column("grp").take(take), pa.array(gs.astype(np.int32)), b.column("cid").take(take), pa.array(sizes[r].astype(np.int32)), pa.array(at.astype(np.int32)), blobs],
                ["grp", "g", "cid", "size", "place", "point"],
            )

    return run


def _pairs_of(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, x, y) with x < na[i], y < nb[i]."""
    n = na * nb
    i = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return i, k // nb[i], k % nb[i]


def _levels(run: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """First rows of the boxes of each level, pages first and at last one root for each run and side; rows lie in order."""
    first = np.arange(len(run))
    levels = []
    while True:
        r, o = run[first], own[first]
        change = np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])]
        begin = np.maximum.accumulate(np.where(change, np.arange(len(first)), 0))
        first = first[(np.arange(len(first)) - begin) % PAGE == 0]
        levels.append(first)
        if len(first) == change.sum():
            return levels


def _join_subtrees(t: Fraction):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of the whole runs in ``pdf``, which is sorted by run, side, size and point."""
        run, own = pdf["run"].to_numpy(), (pdf["own"] != pdf["lo"]).to_numpy()
        size, place = pdf["size"].to_numpy(np.int64), pdf["place"].to_numpy(np.int64)
        packed = np.frombuffer(b"".join(pdf["point"]), np.uint8).reshape(len(pdf), -1)
        point = np.empty((len(pdf), DIMS), np.uint8)
        point[:, ::2], point[:, 1::2] = packed & 15, packed >> 4
        over = size - point.sum(1, dtype=np.int64)  # what the four bits could not hold
        levels = _levels(run, own)
        boxes = [(np.maximum.reduceat(point, f), np.maximum.reduceat(over, f), np.minimum.reduceat(size, f), np.maximum.reduceat(size, f)) for f in levels]
        a_out, b_out = [], []

        def open_pairs(level: int, p: np.ndarray, q: np.ndarray) -> None:
            """Boxes ``p`` and ``q`` of a level, some at a time; those that may hold a match are opened, depth first."""
            first = levels[level]
            end = np.r_[first[1:], len(run)]
            top, most, least, largest = boxes[level]
            for c in range(0, len(p), PAIRS // 4):
                x, y = p[c : c + PAIRS // 4], q[c : c + PAIRS // 4]
                live = (largest[x] * t.denominator >= t.numerator * least[y]) & (largest[y] * t.denominator >= t.numerator * least[x]) & ((x != y) | (end[x] - first[x] > 1))
                x, y = x[live], y[live]
                bound = np.minimum(top[x], top[y]).sum(1, dtype=np.int64) + np.minimum(most[x], most[y])
                live = bound >= _needed(least[x], least[y], t)
                x, y = x[live], y[live]
                if not level:
                    compare_rows(first, end, x, y)
                    continue
                kids = np.searchsorted(levels[level - 1], np.r_[first, len(run)])
                step = PAIRS // (PAGE * PAGE)
                for d in range(0, len(x), step):
                    xd, yd = x[d : d + step], y[d : d + step]
                    i, u, v = _pairs_of(kids[xd + 1] - kids[xd], kids[yd + 1] - kids[yd])
                    u, v = kids[xd][i] + u, kids[yd][i] + v
                    once = (xd != yd)[i] | (u <= v)
                    open_pairs(level - 1, u[once], v[once])

        def compare_rows(first: np.ndarray, end: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
            step = PAIRS // (PAGE * PAGE)
            for d in range(0, len(p), step):
                x, y = p[d : d + step], q[d : d + step]
                k, u, v = _pairs_of(end[x] - first[x], end[y] - first[y])
                ra, rb = first[x][k] + u, first[y][k] + v
                need = _needed(size[ra], size[rb], t)
                # The sizes, and the words from the place of the meeting on, limit the overlap as well.
                fit = ((ra < rb) | (x != y)[k]) & (np.minimum(size[ra] - place[ra], size[rb] - place[rb]) >= need)
                ra, rb, need = ra[fit], rb[fit], need[fit]
                good = np.minimum(point[ra], point[rb]).sum(1, dtype=np.int64) + np.minimum(over[ra], over[rb]) >= need
                a_out.append(ra[good])
                b_out.append(rb[good])

        # The root of a run is joined with itself, those of two sides with each other.
        roots = levels[-1]
        begin = np.flatnonzero(np.r_[True, run[roots][1:] != run[roots][:-1]])
        sides = np.diff(np.r_[begin, len(roots)])
        alone = (pdf["lo"] == pdf["hi"]).to_numpy()[roots[begin]]
        met = alone | (sides == 2)
        open_pairs(len(levels) - 1, begin[met], np.where(alone, begin, begin + 1)[met])
        if not a_out:
            return pd.DataFrame({"grp": [], "a": [], "b": []}, dtype=object)
        ra, rb = np.concatenate(a_out), np.concatenate(b_out)
        cid, grp = pdf["cid"].to_numpy(), pdf["grp"].to_numpy()
        return pd.DataFrame({"grp": grp[ra], "a": np.minimum(cid[ra], cid[rb]), "b": np.maximum(cid[ra], cid[rb])}).drop_duplicates()

    def go(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition holds whole (grp, g, lo, hi) runs in order; the last run of a batch may go on in the next.
        rest = None

        def ready(part: pd.DataFrame) -> pd.DataFrame:
            n = part.groupby("run")["cid"].transform("size")
            return part[n > 1]

        for pdf in it:
            rest = pdf if rest is None or not len(rest) else pd.concat([rest, pdf], ignore_index=True)
            if not len(rest):
                continue
            key = rest[["grp", "g", "lo", "hi"]]
            rest["run"] = (key != key.shift()).any(axis=1).cumsum().to_numpy()
            done = rest["run"] < rest["run"].iloc[-1]
            if done.any() and done.sum() >= 20_000:
                part = ready(rest[done])
                if len(part):
                    yield compare(part)
                rest = rest[~done].drop(columns="run")
            else:
                rest = rest.drop(columns="run")
        if rest is not None and len(rest):
            key = rest[["grp", "g", "lo", "hi"]]
            part = ready(rest.assign(run=(key != key.shift()).any(axis=1).cumsum().to_numpy()))
            rest = None
            if len(part):
                yield compare(part)

    return go


def _verify(t: Fraction):
    def run(key, pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs):
            return pd.DataFrame({"src": [], "dst": []}, dtype=object)
        pairs = pairs[["a", "b"]].drop_duplicates().sort_values("a")
        cids = rows["cid"].to_numpy()
        order = np.argsort(cids)
        cids, heads = cids[order], rows["head"].to_numpy()[order]
        lists = [rows["words"].iloc[i] for i in order]
        sizes = np.array([len(x) for x in lists], np.int64)
        code = np.unique(np.concatenate(lists), return_inverse=True)[1]
        start = np.r_[0, np.cumsum(sizes)]
        a, b = np.searchsorted(cids, pairs["a"].to_numpy()), np.searchsorted(cids, pairs["b"].to_numpy())
        parent = np.arange(len(cids))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        has = np.zeros(int(code.max()) + 1, bool)
        bounds = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
        for s, e in zip(bounds[:-1], bounds[1:]):
            x, others = a[s], b[s:e]
            mine = code[start[x] : start[x + 1]]
            has[mine] = True
            n = sizes[others]
            at = np.repeat(start[others] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.add.reduceat(has[code[at]].astype(np.int64), np.cumsum(n) - n)
            has[mine] = False
            for y in others[shared >= _needed(np.full(len(n), sizes[x]), n, t)]:
                p, q = find(x), find(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        root = np.array([find(x) for x in range(len(cids))])
        tied = root != np.arange(len(cids))
        return pd.DataFrame({"src": heads[tied], "dst": heads[root[tied]]})

    return run


def near_duplicates(df: DataFrame, group: str, item: str, text, threshold: float = 0.7, min_words: int = 8, tile: int = TILE) -> DataFrame:
    """``(grp, id, cluster, size)``: every record with enough words, with the smallest id of its group of near-duplicates.

    Words are the runs of a-z and 0-9 in the lower-cased text.  Records of one
    ``group`` match when both have ``min_words`` words (repeats counted) and the
    distinct words they share are at least ``threshold`` of those of both; groups
    are closed over matches, ``size`` counts their records (1: no match).  Texts
    that are null, empty or too short, and rows with a null id or group, are left
    out; an id delivered again counts once.  Records with the same set of words
    are one point throughout.  The search is exact up to equal 64-bit hashes of
    different words of one group.
    """
    spark = df.sparkSession
    t = Fraction(str(threshold))
    column = F.col(text) if isinstance(text, str) else text
    words = df.select(F.col(group).alias("grp"), F.col(item).alias("id"), F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    sets = words.where("grp is not null and id is not null").where(F.size("w") >= min_words).select(
        "grp", "id", F.array_sort(F.transform(F.array_distinct("w"), lambda x: F.xxhash64(x))).alias("words")
    )
    named = sets.withColumn("cls", F.unhex(F.md5(F.concat(F.encode("grp", "utf-8"), F.encode(F.to_json("words"), "utf-8")))))
    # Read three times below; short rows beside the texts they stand for.
    members = materialize(named.select("grp", "id", "cls").distinct(), "members")
    # Ids that are given while the rows are written stay what they are once read back.
    classes = materialize(
        named.groupBy("grp", "cls").agg(F.min("id").alias("head"), F.first("words").alias("words")).withColumn("cid", F.monotonically_increasing_id()), "classes"
    )
    groups = min(MOST_GROUPS, max(GROUPS, 1 << classes.count().bit_length()))
    counted = classes.select("words").mapInArrow(batched(_frequencies(groups)), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    table = np.zeros(groups, np.int64)
    seen = counted.toPandas()  # at most as many rows, whatever the collection
    table[seen["g"].to_numpy()] = seen["n"].to_numpy()
    frequency = spark.sparkContext.broadcast(table)
    routed = materialize(
        classes.select("grp", "cid", "words").mapInArrow(batched(_route(frequency, t)), "grp string, g int, cid long, size int, place int, point binary"), "routed"
    )
    # At most rows / tile subtrees are large enough to be cut.
    often = routed.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("g")
    hot = join_small(routed.select("grp", "g"), often, "g", "left_semi").groupBy("grp", "g").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).where("tiles > 1")
    cut = join_small(routed, materialize(hot, "hot"), ["grp", "g"]).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = cut.withColumn("own", F.pmod(F.xxhash64("cid"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = ["grp", "g", "lo", "hi"]
    subtrees = (
        spread(own.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("tiles", "other"), *keys)
        .sortWithinPartitions(*keys, F.expr("own <> lo"), "size", "point")
    )
    candidates = materialize(subtrees.mapInPandas(batched(_join_subtrees(t)), "grp string, a long, b long"), "candidates")
    large = classes.groupBy("grp").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).where("tiles > 1")
    placed = join_small(candidates, large, "grp").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    ta, tb = F.pmod(F.xxhash64("a"), F.col("tiles")), F.pmod(F.xxhash64("b"), F.col("tiles"))
    pairs = placed.select("grp", F.least(ta, tb).alias("lo"), F.greatest(ta, tb).alias("hi"), "a", "b")
    wanted = pairs.select(F.col("grp").alias("g"), F.col("lo").alias("l"), F.col("hi").alias("h"), F.explode(F.array("a", "b")).alias("cid")).distinct()
    rows = wanted.join(classes.select("cid", "head", "words"), "cid")
    links = pairs.groupBy("grp", "lo", "hi").cogroup(rows.groupBy("g", "l", "h")).applyInPandas(cogrouped(_verify(t)), "src string, dst string")
    components = connected_components(links)
    cluster = classes.select("cls", F.col("head").alias("node")).join(components, "node", "left").select("cls", F.coalesce("component", "node").alias("cluster"))
    told = members.join(cluster, "cls")
    return told.join(told.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("grp", "id", "cluster", "size")


def pairs_within(clusters: DataFrame, block: int = 512) -> DataFrame:
    """``(id_a, id_b)``: every pair of one cluster, smaller id first; a large cluster's pairs are made by many tasks."""
    rows = clusters.where("size > 1").select("cluster", "id", F.ceil(F.col("size") / block).cast("int").alias("cuts"))
    left = rows.select("cluster", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), "cuts").cast("int").alias("cut"))
    right = rows.select("cluster", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    return left.join(right, ["cluster", "cut"]).where("id_a < id_b").select("id_a", "id_b")
