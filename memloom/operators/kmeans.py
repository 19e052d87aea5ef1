"""Spherical k-means by group, farthest-first start, rounds until no centre moves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _units(part: pd.DataFrame) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in part["vec"]])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.round(x @ centres.T, 9).argmax(1)


def _start(vectors: DataFrame, k: int) -> dict[str, np.ndarray]:
    """The row of smallest id, then k - 1 times the row whose nearest centre is farthest, smallest id first among equals."""
    centres: dict = {}
    for _ in range(k):

        def pick(batches, centres=dict(centres)):
            best: dict = {}
            for pdf in batches:
                for g, part in pdf.groupby("grp"):
                    x = _units(part)
                    near = np.round((x @ centres[g].T).max(1), 9) if g in centres else np.zeros(len(x))
                    for i in np.lexsort((part["id"].to_numpy(str), near))[:1]:
                        row = (float(near[i]), part["id"].iloc[i], x[i].tolist())
                        best[g] = min(best.get(g, row), row)
            yield pd.DataFrame([(g, *v) for g, v in best.items()], columns=["grp", "near", "id", "u"])

        found: dict = {}
        for r in vectors.mapInPandas(pick, "grp string, near double, id string, u array<double>").collect():  # a row per task and group
            row = (r["near"], r["id"], r["u"])
            found[r["grp"]] = min(found.get(r["grp"], row), row)
        centres = {g: np.vstack([centres[g], v[2]]) if g in centres else np.array([v[2]]) for g, v in found.items()}
    return centres


def kmeans(vectors: DataFrame, k: int = 2, rounds: int = 1000) -> DataFrame:
    """``(grp, id, label)`` of (grp, id, vec): Lloyd rounds until no centre moves; an error if ``rounds`` do not suffice.

    Tasks send sums per group and centre.  A centre that loses all its rows
    stays where it was.  Vectors must be usable, without zero norm.
    """
    centres = _start(vectors, k)
    for _ in range(rounds):

        def add(batches, centres=centres):
            sums: dict = {}
            for pdf in batches:
                for g, part in pdf.groupby("grp"):
                    x = _units(part)
                    own = _nearest(x, centres[g])
                    for c in np.unique(own):
                        sums[g, c] = sums.get((g, c), 0.0) + x[own == c].sum(0)
            yield pd.DataFrame([(g, int(c), v.tolist()) for (g, c), v in sums.items()], columns=["grp", "c", "s"])

        total: dict = {}
        for r in vectors.mapInPandas(add, "grp string, c int, s array<double>").collect():
            total[r["grp"], r["c"]] = total.get((r["grp"], r["c"]), 0.0) + np.array(r["s"])
        moved = {g: v.copy() for g, v in centres.items()}
        for (g, c), s in total.items():
            if np.linalg.norm(s) > 0:
                moved[g][c] = s / np.linalg.norm(s)
        still = all(np.abs(moved[g] - centres[g]).max() < 1e-9 for g in centres)
        centres = moved
        if still:
            break
    else:
        raise RuntimeError(f"k-means has not come to rest in {rounds} rounds")

    def label(batches):
        for pdf in batches:
            for g, part in pdf.groupby("grp"):
                yield pd.DataFrame({"grp": g, "id": part["id"], "label": _nearest(_units(part), centres[g])})

    return vectors.mapInPandas(label, "grp string, id string, label int")
