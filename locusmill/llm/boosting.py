"""Small gradient-boosted trees in numpy, and their form as Spark expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    """A tree's value for every row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = tree_values(tree[2], x[low]), tree_values(tree[3], x[~low])
    return out


def train_trees(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, share: float = 1.0, seed: int = 3) -> tuple[float, list]:
    """Logistic gradient boosting with exact splits on a bounded example set: (base score, trees).
    A tree is a leaf value or (feature, threshold, left, right); left is x <= threshold.  With a
    share below 1 each tree sees a random part of the rows."""
    rng = np.random.default_rng(seed)
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    f = np.full(len(y), base)
    cuts = [np.unique(np.round((u[1:] + u[:-1]) / 2, 6)) for u in (np.unique(np.quantile(c, np.linspace(0, 1, 17))) for c in x.T)]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        leaf = lambda r: float(rate * g[r].sum() / (h[r].sum() + 1.0))
        if left == 0 or len(rows) < 20:
            return leaf(rows)
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1.0)
        best = (1e-6, None)
        for j, edges in enumerate(cuts):
            for c in edges:
                low = x[rows, j] <= c
                a, b = rows[low], rows[~low]
                if len(a) >= 5 and len(b) >= 5 and (gain := score(a) + score(b) - score(rows)) > best[0]:
                    best = (gain, (j, float(c), a, b))
        if best[1] is None:
            return leaf(rows)
        j, c, a, b = best[1]
        return j, c, grow(a, g, h, left - 1), grow(b, g, h, left - 1)

    made = []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        rows = np.arange(len(y)) if share >= 1 else np.flatnonzero(rng.random(len(y)) < share)
        tree = grow(rows, y - q, q * (1 - q), depth)
        made.append(tree)
        f += tree_values(tree, x)
    return base, made


def compile_trees(base: float, trees: list, feature: list[Column]) -> Column:
    """The boosted score as one expression."""

    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(feature[tree[0]] <= tree[1], one(tree[2])).otherwise(one(tree[3]))

    out = F.lit(base)
    for t in trees:
        out = out + one(t)
    return out
