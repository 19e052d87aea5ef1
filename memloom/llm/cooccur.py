"""Pairs of items that share baskets more often than chance: a blocked Gram matrix.

Method: baskets become binary rows over the frequent items, rows are cut into
record blocks and columns into item blocks, and each task adds up the
transpose-products of its record blocks.  The sums of all tasks are added per
pair and set against the product of the marginals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

RECORD_BLOCK = 2048
ITEM_BLOCK = 256
HELD = 256  # sums of pairs of item blocks that a task holds, 128 MB; more are passed on and added up behind it


def _gram(batches: Iterator[pd.DataFrame], item_block: int = ITEM_BLOCK, held: int = HELD) -> Iterator[pd.DataFrame]:
    # A partition holds whole baskets, sorted; a basket's items may span batches.
    total: dict[tuple[int, int], np.ndarray] = {}

    def add(items: np.ndarray, rows: np.ndarray, n: int) -> Iterator[pd.DataFrame]:
        """Adds the products of one record block; sums are passed on when they become too many."""
        block = items // item_block
        sparse = {}  # of each item block the columns that are not empty
        for b in np.unique(block):
            on = block == b
            columns, at = np.unique(items[on] % item_block, return_inverse=True)
            x = np.zeros((n, len(columns)), np.float32)
            x[rows[on], at] = 1
            sparse[int(b)] = columns, x
        for i, (ci, xi) in sparse.items():
            for j, (cj, xj) in sparse.items():
                if i <= j:
                    if (i, j) not in total:
                        if len(total) >= held:
                            yield from sums()
                        total[i, j] = np.zeros((item_block, item_block), np.int64)
                    # A record block has 2048 rows, so float32 holds its counts exactly.
                    total[i, j][np.ix_(ci, cj)] += (xi.T @ xj).astype(np.int64)

    def sums() -> Iterator[pd.DataFrame]:
        for (i, j), m in total.items():
            a, b = np.nonzero(np.triu(m, 1) if i == j else m)
            yield pd.DataFrame({"x": a + i * item_block, "y": b + j * item_block, "n": m[a, b]})
        total.clear()

    rest = pd.DataFrame({"basket": [], "item": []}, dtype=object)
    for pdf in batches:
        rest = pd.concat([rest, pdf], ignore_index=True) if len(rest) else pdf
        code = (rest["basket"] != rest["basket"].shift()).cumsum().to_numpy() - 1
        whole = (code[-1] // RECORD_BLOCK) * RECORD_BLOCK if len(code) else 0  # the last block stays open
        for lo in range(0, whole, RECORD_BLOCK):
            on = slice(*np.searchsorted(code, [lo, lo + RECORD_BLOCK]))
            yield from add(rest["item"].to_numpy(np.int64)[on], code[on] - lo, RECORD_BLOCK)
        rest = rest[code >= whole]
    if len(rest):
        code = (rest["basket"] != rest["basket"].shift()).cumsum().to_numpy() - 1
        yield from add(rest["item"].to_numpy(np.int64), code, int(code[-1]) + 1)
    yield from sums()


def pair_lift(baskets: DataFrame, basket: str, item: str, min_count: int = 6, min_share: float = 0.005, min_lift: float = 4.0) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, baskets, lift)`` of pairs with enough shared baskets and enough lift.

    ``baskets`` has a row per basket and item; a row with a null item only makes
    its basket count.  Null baskets are dropped, repeated rows count once, the
    smaller item comes first.  A pair is kept with n_ab >= min_count,
    n_ab >= min_share * S and n_ab * S >= min_lift * n_a * n_b, S being the
    number of baskets.  An item in fewer baskets than that is left out first,
    which loses no pair, as n_ab is never above n_a.

    At most sum(n) / (min_share * S) items remain: the mean basket size divided
    by ``min_share``, whatever the number of baskets.  A task holds the sums of
    HELD pairs of item blocks and passes on the rest.
    A single huge basket contributes each remaining item once.
    """
    spark = baskets.sparkSession
    rows = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null")
    number = rows.agg(F.count_distinct("basket").alias("baskets"))
    s = number.first()["baskets"]
    pairs = rows.where("item is not null").distinct()
    # Whole numbers throughout: 0.005 * s in floating point can land beside the limit.
    least, lift = max(min_count, math.ceil(Fraction(str(min_share)) * s)), Fraction(str(min_lift))
    marginal = pairs.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # The frequent items are bounded as said above, so numbering them in one task is too.
    numbered = marginal.select("item", "n", (F.row_number().over(Window.orderBy("item")) - 1).alias("id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = (
        pairs.join(numbered.select("item", "id"), "item")
        .select("basket", F.col("id").alias("item"))
        .repartition(parts, "basket")
        .sortWithinPartitions("basket")
    )
    counts = coded.mapInPandas(_gram, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n_ab"))
    a = numbered.select(F.col("id").alias("x"), F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = numbered.select(F.col("id").alias("y"), F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    return (
        counts.where(F.col("n_ab") >= least)
        .join(a, "x")
        .join(b, "y")
        .withColumn("baskets", F.lit(s).cast("long"))
        .withColumn("lift", F.col("n_ab") * F.col("baskets") / (F.col("n_a") * F.col("n_b")))
        .where(F.col("n_ab") * F.col("baskets") * lift.denominator >= F.col("n_a") * F.col("n_b") * lift.numerator)
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", "baskets", "lift")
    )


def clean_tag(tag):
    """Outer blanks off, lower case, one leading ``#`` off; blank becomes null."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(tag)), "^#", ""))
    return F.when(bare != "", bare)
