"""The N highest rows of every group, by one global sort instead of a window per group.

Method: rows are range-partitioned and sorted on (group, score descending, id).
Each partition counts its rows per group; the counts of a group's earlier
partitions, prefix-summed, turn a row's place in its partition into its exact
position in the group.  A group of any size is spread over as many partitions
as the range partitioner gives it; a partition passes on at most N rows of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T


def _leaders(group: str, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One pass over a sorted partition: a group is one run of rows, which may span batches.
        part = TaskContext.get().partitionId()
        now, seen, kept = None, 0, []

        def close():
            whole = pd.concat(kept, ignore_index=True)
            whole["_part"], whole["_count"] = part, seen
            return whole

        for pdf in batches:
            if not len(pdf):
                continue
            change = (pdf[group] != pdf[group].shift()).cumsum()
            place = pdf.groupby(change).cumcount() + 1
            sizes = pdf.groupby(change).size()
            out = []
            first_same = now is not None and pdf[group].iloc[0] == now
            if first_same:
                place = place + (change == 1) * seen
            elif now is not None:
                out.append(close())
            runs = len(sizes)
            lead = pdf.assign(_place=place.astype("int64"), _run=change.values)
            lead = lead[lead["_place"] <= n]
            if first_same:
                seen += int(sizes.iloc[0])
                kept.append(lead[lead["_run"] == 1].drop(columns="_run"))
                if runs > 1:
                    out.append(close())
            if runs > 1 or not first_same:
                start = 2 if first_same else 1
                middle = lead[(lead["_run"] >= start) & (lead["_run"] < runs)]
                if len(middle):
                    middle = middle.assign(_part=part, _count=sizes.loc[middle["_run"]].values)
                    out.append(middle.drop(columns="_run"))
                now, seen = pdf[group].iloc[-1], int(sizes.iloc[-1])
                kept = [lead[lead["_run"] == runs].drop(columns="_run")]
            if out:
                yield pd.concat(out, ignore_index=True)
        if now is not None:
            yield close()

    return run


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int = 10) -> DataFrame:
    """``(group, item, score, position)`` of the first ``n`` items per group, score descending, item ascending.

    A row with a null group, null item, or a null or NaN score is dropped.  An
    item given more than once in a group counts once, with its highest score, so
    repeated rows and later deliveries change nothing.  Groups with fewer items
    give what they have; an empty table gives no rows.  Other columns of ``df``
    are ignored, whatever their names.
    """
    clean = (
        df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).cast("double").alias("_s"))
        .where("_g is not null and _i is not null and _s is not null and not isnan(_s)")
        .groupBy("_g", "_i")
        .agg(F.max("_s").alias("_s"))
    )
    ranged = clean.repartitionByRange(F.col("_g"), F.col("_s").desc(), F.col("_i")).sortWithinPartitions(F.col("_g"), F.col("_s").desc(), F.col("_i"))
    schema = T.StructType([*clean.schema.fields, T.StructField("_place", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_count", T.LongType())])
    leaders = ranged.mapInPandas(_leaders("_g", n), schema)
    in_order = Window.partitionBy("_g").orderBy("_part", "_place")
    before = F.sum(F.when(F.col("_place") == 1, F.col("_count")).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_count")
    return (
        leaders.withColumn("position", F.col("_place") + before)
        .where(F.col("position") <= n)
        .select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), "position")
    )
