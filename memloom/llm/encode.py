"""Token ids of a whole corpus with a public tokenizer, encoding shared chunks once.

Method: texts are cut wherever a rolling hash over the preceding characters hits
a mask, so equal passages give equal chunks wherever they stand.  Chunks that
occur more than once in the corpus are encoded once and joined back; the others
are encoded where they are, and a text without shared chunks never moves.

A chunk's ids are right in every text only between the first and the last place
in it at which the tokenizer's pre-tokenizer starts a piece whatever surrounds
it; what lies outside may be part of a piece that reaches over the cut.  So the
joins are repaired: from the last such place of a chunk to the first of the next
the text is encoded again as a whole, and where a chunk has no such place the
join is widened over it, until both ends agree with the ids on either side.

A piece of the pattern is a run of letters, of digits, or of other visible signs,
each with at most one blank before it, a contraction, or white space.  So a place
behind a visible character of one kind (but for an apostrophe) and before a
character of another kind starts a piece in any surroundings, and nothing before
it is read differently for what comes after.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from memloom.llm.workers import batched
from memloom.sources.shared import materialize
from memloom.sources.small import enough_tasks, join_small

BITS_A_KEY = 16  # of the filter of recurring chunks: one chunk in sixteen that doesn't recur is taken for one
MOST_BITS = 1 << 28  # of the filter, 32 MB; beyond, chunks must recur more often to be in it
HOT = 100_000  # occurrences of a chunk, from which on its ids are joined in several parts
WINDOW = 8  # characters under the rolling hash
MASK = 127  # one cut in 128
SHORT = 16  # characters of a chunk at least
BATCH_CHARS = 1 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The white space of the pattern.
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNKNOWN, LETTER, DIGIT, SIGN, BLANK, APOSTROPHE = range(6)


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("memloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every character; unknown where versions of Unicode might differ on it."""
    out = np.zeros(0x110000, np.uint8)
    then = unicodedata.ucd_3_2_0.category
    for c in range(0x30000):  # beyond, no character is as old as that version
        old, new = then(chr(c)), unicodedata.category(chr(c))
        if old != "Cn" and old[0] == new[0]:
            out[c] = {"L": LETTER, "N": DIGIT}.get(new[0], SIGN)
    out[[ord(c) for c in _BLANKS]] = BLANK
    out[0xD800:0xE000] = UNKNOWN
    out[ord("'")] = APOSTROPHE
    return out


def sure(kind: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character in any surroundings; never at the first."""
    k = np.where(kind == APOSTROPHE, SIGN, kind)
    out = np.zeros(len(kind), bool)
    before = kind[:-1]
    out[1:] = (k[1:] != k[:-1]) & (kind[1:] != UNKNOWN) & (before != UNKNOWN) & (before != BLANK) & (before != APOSTROPHE)
    return out


def cuts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending places in ``points`` at which its texts, beginning at ``starts``, are cut; their own ends left out."""
    n = len(points) - WINDOW
    if n < 1:
        return np.zeros(0, np.int64)
    two = points[:-1].astype(np.uint64) << np.uint64(32) | points[1:]
    h = np.zeros(n, np.uint64)
    for k in range(0, WINDOW, 2):
        h = (h ^ two[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(((h >> np.uint64(40)) & np.uint64(MASK)) == 0) + WINDOW
    return at[at - starts[np.searchsorted(starts, at, "right") - 1] >= SHORT]


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, texts put together, their starts, cuts, sure places) of some texts at a time; empty ones are left out."""
    rows, size = [], 0
    for i, t in enumerate([*texts, None]):
        if rows and (t is None and i == len(texts) or size > BATCH_CHARS):
            whole = "".join(texts[r] for r in rows)
            points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = np.cumsum([0, *(len(texts[r]) for r in rows)])
            yield rows, whole, starts, cuts(points, starts[:-1]), np.flatnonzero(sure(kinds()[points]))
            rows, size = [], 0
        if t:
            rows.append(i)
            size += len(t)


def _bounds(start: int, end: int, at: np.ndarray) -> list[int]:
    """The ends of the chunks of a text."""
    a, b = np.searchsorted(at, [start, end], "right")
    return [start, *(x for x in at[a:b].tolist() if x < end), end]


def _places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        hashes = [
            xxhash.xxh3_64_intdigest(whole[s:e]) for rows, whole, starts, at, _ in _pieces(b.column("text").to_pylist()) for k in range(len(rows)) for s, e in _ends(_bounds(int(starts[k]), int(starts[k + 1]), at))
        ]
        key, n = np.unique(np.array(hashes, np.uint64).view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


def _ends(bounds: list[int]) -> Iterator[tuple[int, int]]:
    return zip(bounds[:-1], bounds[1:])


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    """A column of int32 lists; None is null."""
    sizes = np.array([0 if x is None else len(x) for x in parts], np.int64)
    flat = np.concatenate([x for x in parts if x is not None and len(x)] or [np.zeros(0, np.uint32)]).astype(np.int32)
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    null = np.array([x is None for x in parts], bool)
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array(null))


def segments(text: str, bounds: list[int], places: np.ndarray, recurs) -> list[tuple[bool, int, int, int]]:
    """(shared, from, to, chunk) of the parts of ``text``, in order: cores of chunks that recur, and the joins between them.

    ``bounds`` are the ends of the chunks, ``places`` where pieces surely start.
    """
    out = []
    done = bounds[0]
    first = np.searchsorted(places, bounds[:-1], "right").tolist()
    last = (np.searchsorted(places, bounds[1:], "left") - 1).tolist()
    for k, (s, e) in enumerate(_ends(bounds)):
        # The first place that counts needs both of its characters in the chunk, so it lies behind the cut.
        if last[k] > first[k] and recurs(text[s:e]):
            a, b = int(places[first[k]]), int(places[last[k]])
            if a > done:
                out.append((False, done, a, k))
            out.append((True, a, b, k))
            done = b
    if done < bounds[-1]:
        out.append((False, done, bounds[-1], len(bounds)))
    return out


def _encode(shared, path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, enc = shared.value, encoding(path)
        size = len(bits) * 8
        nothing = np.zeros(0, np.uint32)

        def recurs(chunk: str) -> bool:
            h = xxhash.xxh3_64_intdigest(chunk) % size
            return bool(bits[h >> 3] >> (h & 7) & 1)

        def batches(rows: list[tuple], b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(rows), 2048):
                part = list(zip(*rows[s : s + 2048]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0], b.schema.field("id").type), pa.array(part[1], pa.int32()), pa.array(part[2]), _lists(part[3]), pa.array(part[4], pa.binary()), pa.array(part[5], pa.string())],
                    ["id", "pos", "whole", "ids", "key", "core"],
                )

        for b in it:
            ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
            for used, whole, starts, at, places in _pieces(texts):
                rows: list[tuple] = []
                for k, r in enumerate(used):
                    bounds = _bounds(int(starts[k]), int(starts[k + 1]), at)
                    inside = places[np.searchsorted(places, bounds[0], "right") : np.searchsorted(places, bounds[-1], "left")]
                    parts = segments(whole, bounds, inside, recurs)
                    for pos, (common, s, e, chunk) in enumerate(parts):
                        if common:
                            raw = whole[bounds[chunk] : bounds[chunk + 1]]
                            rows.append((ids[r], pos, False, None, xxhash.xxh3_128_digest(raw), whole[s:e]))
                        else:
                            rows.append((ids[r], pos, len(parts) == 1, enc.encode_to_numpy(whole[s:e], disallowed_special=()), None, None))
                yield from batches(rows, b)
            yield from batches([(ids[r], 0, True, nothing, None, None) for r, t in enumerate(texts) if not t], b)

    return run


def _encode_once(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), _lists([enc.encode_to_numpy(c, disallowed_special=()) for c in b.column("core").to_pylist()])], ["key", "n", "shared"])

    return run


def _filter(counted: DataFrame) -> np.ndarray:
    """A bit for each chunk that occurs again; its size goes by their number.

    Where they are more than the largest filter is for, those that occur more
    often go first: the ids are the same either way, only fewer chunks are
    encoded once.
    """
    steps = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().toPandas().sort_values("step", ascending=False)  # a row per doubling
    fits = steps[steps["count"].cumsum() <= MOST_BITS // BITS_A_KEY]
    keys = int(fits["count"].sum())
    bits = 1 << max(16, (keys * BITS_A_KEY - 1).bit_length()) if keys else 1 << 16
    table = np.zeros(bits // 32, np.uint32)
    if keys:
        least = 1 << int(fits["step"].min())
        unsigned = F.col("key").cast("decimal(20,0)") + F.when(F.col("key") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0))
        place = F.pmod(unsigned, F.lit(bits)).cast("long")
        words = counted.where(F.col("n") >= least).select(place.alias("p")).groupBy(F.floor(F.col("p") / 32).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("v")).toPandas()
        table[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).astype(np.uint32)
    return table.view(np.uint8)


def encode_corpus(df: DataFrame, item: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(item, ids)``: the token ids of every text, without special tokens.

    One row per id; null and empty texts get an empty list; an id delivered again
    counts once; rows with a null id are dropped.  Strings that look like special
    tokens are ordinary text.  The whole text is encoded, whatever its length.
    ``vocabulary`` is a file of byte-level BPE ranks that every executor can read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(item).alias("id"), F.col(text).alias("text")).where("id is not null")
    again = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if again.limit(1).count():
        rows = join_small(rows, again, "id", "left_anti").unionByName(join_small(rows, again, "id", "left_semi").dropDuplicates(["id"]))
    rows = enough_tasks(rows, "id")
    counted = materialize(rows.mapInArrow(batched(_places), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "chunks")
    shared = spark.sparkContext.broadcast(_filter(counted))
    kind = dict(rows.dtypes)["id"]
    parts = materialize(rows.mapInArrow(batched(_encode(shared, vocabulary)), f"id {kind}, pos int, whole boolean, ids array<int>, key binary, core string"), "parts")
    whole = parts.where("whole").select(F.col("id").alias(item), "ids")
    # Of a chunk's occurrences each task passes on one.
    once = parts.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.first("core").alias("core")).mapInArrow(batched(_encode_once(vocabulary)), "key binary, n long, shared array<int>")
    once = materialize(once, "encoded")
    hot = once.where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).cast("int").alias("cuts"))  # at most parts / HOT rows
    pieces = join_small(parts.where("key is not null").select("id", "pos", "key"), hot, "key").withColumn("cut", F.pmod(F.xxhash64("id"), F.coalesce("cuts", F.lit(1))).cast("int"))
    offered = once.select("key", "shared", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / HOT), F.lit(1)).cast("int") - 1)).alias("cut"))
    told = pieces.join(offered, ["key", "cut"]).select("id", "pos", F.col("shared").alias("ids")).unionByName(parts.where("not whole and key is null").select("id", "pos", "ids"))
    ordered = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("p"))
    return whole.unionByName(ordered.select(F.col("id").alias(item), F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")))
