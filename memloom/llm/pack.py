"""Filling containers of fixed capacity: cost-balanced packing.

Method: the cost of a sequence is linear in its tokens plus quadratic in the
tokens of each document (attention stays within a document).  Documents go, in
descending size, to the sequence of lowest cost that has room.  Documents are
dealt to shards by the hash of their id and each shard is packed by one task.
The sequences a shard could not fill are emptied, dealt to new, fewer shards of
the same size and packed again, for as long as that saves sequences.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from memloom.llm.workers import grouped
from memloom.sources.shared import materialize

SHARD = 50_000  # documents packed by one task
FULL = 0.97
MOST_BUDGETS = 1000
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each item; ``sizes`` is descending and none exceeds ``capacity``."""
    n = -(-int(sizes.sum()) // capacity)
    room = [capacity] * n
    open_ = [(0.0, k) for k in range(n)]  # by cost; may hold sequences without room for the item at hand
    parked: list[tuple[int, int, float]] = []  # by room, until items are small enough
    out = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        while parked and -parked[0][0] >= s:
            _, k, cost = heapq.heappop(parked)
            heapq.heappush(open_, (cost, k))
        while open_ and room[open_[0][1]] < s:
            cost, k = heapq.heappop(open_)
            if room[k]:
                heapq.heappush(parked, (-room[k], k, cost))
        if open_:
            cost, k = heapq.heappop(open_)
        else:
            cost, k = 0.0, len(room)
            room.append(capacity)
        room[k] -= s
        out[i] = k
        heapq.heappush(open_, (cost + LINEAR * s + QUADRATIC * s * s, k))
    return out


def _pack(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        k = assign(pdf["n_tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]))
        fill = np.bincount(k, weights=pdf["n_tokens"].to_numpy(float))
        name = f"{pdf['budget_id'].iloc[0]}-{level}-{pdf['shard'].iloc[0]}-"
        return pdf.assign(container=[name + str(x) for x in k], fill=fill[k].astype("int64"))

    return run


def _rounds(rest: DataFrame, schema: str, shard_rows: int) -> DataFrame:
    """``rest`` packed: rows of full sequences leave after each round, the others go round again."""
    done, before, level = [], {}, 1
    full = F.col("fill") >= FULL * F.col("capacity")
    while True:
        # A row per budget, of which there is a handful.
        n = {r["budget_id"]: r["n"] for r in rest.groupBy("budget_id").agg(F.count("*").alias("n")).collect()}
        if not n:
            break
        shards = F.coalesce(*[F.when(F.col("budget_id") == F.lit(b), F.lit(max(1, -(-k // shard_rows)))) for b, k in n.items()])
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.lit(level)), shards))
        packed = materialize(dealt.repartition("budget_id", "shard").groupBy("budget_id", "shard").applyInPandas(grouped(_pack(level)), schema), "packed")
        used = {r["budget_id"]: r["n"] for r in packed.where(~full).groupBy("budget_id").agg(F.count_distinct("container").alias("n")).collect()}
        done.append(packed.where(full))
        # One shard can't be mixed any further, and a budget whose sequences became no fewer won't.
        again = [b for b, k in used.items() if n[b] > shard_rows and k < before.get(b, k + 1)]
        loose = packed.where(~full)
        done.append(loose.where(~F.col("budget_id").isin(again)) if again else loose)
        if not again:
            break
        rest, before, level = loose.where(F.col("budget_id").isin(again)).drop("container", "fill"), used, level + 1
    out = done[0] if done else None
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack(sized: DataFrame, budgets: DataFrame, item: str, shard_rows: int = SHARD) -> DataFrame:
    """``(budget_id, capacity, container, item, piece, start, n_tokens)`` for every budget.

    ``sized`` has (item, n) with n tokens, ``budgets`` (budget_id, capacity_tokens).
    A text above the capacity is split into pieces of the capacity, each filling a
    container, and a rest that is packed like other texts; no other is split.
    Texts of no tokens (null or empty) need no room and are left out, as are null
    ids and budgets whose capacity is null or below one.
    """
    # Read several times below; a row of two numbers beside the text it stands for.
    docs = materialize(sized.select(F.col(item).alias("id"), F.col("n").cast("long").alias("n")).where("id is not null and n > 0"), "sized")
    plans = budgets.where("budget_id is not null and capacity_tokens >= 1").select("budget_id", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    # Every text is set against every budget by definition; there are a handful, which become a literal.
    told = plans.limit(MOST_BUDGETS + 1).collect()
    if len(told) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets: pack them in several calls")
    kind = plans.schema["budget_id"].dataType
    each = docs.withColumn("plan", F.explode(F.array(*[F.struct(F.lit(r["budget_id"]).cast(kind).alias("budget_id"), F.lit(r["capacity"]).alias("capacity")) for r in told]).cast(T.ArrayType(plans.schema))))
    each = each.select("id", "n", "plan.budget_id", "plan.capacity")
    whole = F.floor(F.col("n") / F.col("capacity")).cast("long")
    full = each.where("n >= capacity").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1))).select(
        "budget_id", "capacity", F.concat_ws("-", F.col("budget_id").cast("string"), F.lit("f"), F.col("id").cast("string"), F.col("piece").cast("string")).alias("container"),
        "id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("n_tokens"),
    )
    rest = each.where("n % capacity > 0").select(
        "budget_id", "capacity", "id", whole.alias("piece"), (whole * F.col("capacity")).alias("start"), (F.col("n") % F.col("capacity")).alias("n_tokens"),
        F.lit(0).cast("long").alias("shard"),
    )
    kind = dict(docs.dtypes)["id"]
    schema = f"budget_id {dict(plans.dtypes)['budget_id']}, capacity long, id {kind}, piece long, start long, n_tokens long, shard long, container string, fill long"
    columns = ["budget_id", "capacity", "container", "id", "piece", "start", "n_tokens"]
    packed = _rounds(rest, schema, shard_rows)
    out = full.select(columns) if packed is None else full.select(columns).unionByName(packed.select(columns))
    return out.withColumnRenamed("id", item)
