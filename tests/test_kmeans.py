"""k-means against plain rounds in numpy."""

import numpy as np

from memloom.operators.kmeans import kmeans


def test_rounds_go_on_until_nothing_moves(spark):
    dice = np.random.default_rng(3)
    x = dice.normal(size=(300, 8)) + np.repeat(dice.normal(size=(3, 8)), 100, 0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    start = [0]
    while len(start) < 3:
        start.append(int(np.round((u @ u[start].T).max(1), 9).argmin()))
    c, first = u[start], None
    while True:
        own = (u @ c.T).argmax(1)
        first = own if first is None else first
        new = np.array([u[own == j].sum(0) / np.linalg.norm(u[own == j].sum(0)) for j in range(3)])
        if np.allclose(new, c, atol=1e-12):
            break
        c = new
    df = spark.createDataFrame([("s", f"{i:03}", v.tolist()) for i, v in enumerate(x)], "grp string, id string, vec array<double>").repartition(3)
    got = {int(r["id"]): r["label"] for r in kmeans(df, 3).collect()}
    assert [got[i] for i in range(300)] == own.tolist() != first.tolist()
    assert kmeans(df.limit(0), 2).count() == 0
