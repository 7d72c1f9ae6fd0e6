"""Committees of model trees: rules whose conclusions are linear models.

A member is a regression tree whose leaves hold ridge regressions; a path to a leaf is a
rule.  The first member aims at the target y, the next one at 2 y - (prediction of the one
before), so that it makes up for the other's errors, and a committee predicts the mean of
its members.  A smaller committee is a prefix of a larger one.

All linear models of a member come from one pass: counts, sums and cross-products of
[bands, target] by leaf, which the leaves of a fit add up to those of its training set.
The *root* model is a ridge regression on standardised bands over the whole training set;
a leaf adds a ridge regression of what the root model leaves over in it, so a leaf of few
rows stays close to the root, and a member with one leaf is ridge regression exactly.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame

from prismlake.operators import additive
from prismlake.operators.additive import Fit, Method, Rows, Search
from prismlake.operators.gram import Moments
from prismlake.operators.histograms import BINS

# Committee sizes of the runtime search.
GRID = {"n_committees": [5, 10, 25, 50]}
DEPTH = 3                  # levels of splits, so up to 8 rules a member
MIN_LEAF = 8               # rows a rule stands for at least
ALPHA = 1.0                # ridge penalty on standardised bands


def ridge(m: Moments, scale: np.ndarray, alpha: float, start: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of least squares with penalty alpha * |(b - start) * scale|^2."""
    p = len(scale)
    if m.n < 1:
        return 0.0, np.zeros(p) if start is None else start
    a = m.cov_ss[:p, :p] / np.outer(scale, scale) + alpha * np.eye(p)
    rhs = m.cov_ss[:p, p] / scale
    if start is not None:
        rhs = rhs + alpha * start * scale
    coef = np.linalg.solve(a, rhs) / scale
    return float(m.mean[p] - m.mean[:p] @ coef), coef


class Committee(Method):
    model = "cubist"
    width = 2                                             # last member's prediction, sum of all members'
    leaf_moments = True

    def __init__(self, fits: list[Fit]):
        super().__init__(fits)
        self.min_leaf = fits[0].setting[1]
        self.models: list[np.ndarray] = []                # a member: (fits, leaves, 1 + bands)

    def start(self, rows: Rows) -> np.ndarray:
        return np.zeros((2, len(self.fits), len(rows.y)))

    def target(self, rows: Rows, state: np.ndarray, turn: int) -> np.ndarray:
        return 2 * rows.y - state[0] if turn else np.repeat(rows.y[None, :], len(self.fits), 0)

    def finish(self, sides: np.ndarray | None, moments: np.ndarray) -> None:
        fits, leaves, size = moments.shape
        q = int(np.sqrt(size - 1))                        # size = 1 + q + q * q
        out = np.zeros((fits, leaves, q))
        for i, f in enumerate(self.fits):
            whole = moments[i].sum(0)
            if whole[0] < 1:
                continue
            alpha = f.setting[0]
            root = Moments.from_packed(whole, q)
            scale = np.sqrt(np.maximum(np.diag(root.cov_ss)[:-1] / root.n, 0))
            scale[scale == 0] = 1.0
            b0, coef = ridge(root, scale, alpha)
            for k in range(leaves):
                n = moments[i, k, 0]
                a, b = ridge(Moments.from_packed(moments[i, k], q), scale, alpha, coef) if 0 < n < whole[0] else (b0, coef)
                out[i, k] = np.concatenate([[a], b])
        self.models.append(out)

    def after(self, rows: Rows, state: np.ndarray, turn: int, leaf: np.ndarray) -> np.ndarray:
        model = self.models[turn]
        value = np.empty(leaf.shape)
        for i in range(len(model)):
            every = model[i, :, 0] + rows.x @ model[i, :, 1:].T                   # (rows, leaves)
            value[i] = np.take_along_axis(every, leaf[i][:, None], 1)[:, 0]
        return np.stack([value, state[1] + value])

    def predictions(self, state: np.ndarray, rounds: int) -> np.ndarray:
        return state[1] / rounds

    def params(self, rounds: int, setting: tuple) -> str:
        return json.dumps({"n_committees": rounds, "alpha": setting[0], "min_leaf": setting[1], "max_depth": setting[2]})


def search(grid: dict[str, list], depth: int = DEPTH, min_leaf: int = MIN_LEAF, alpha: float = ALPHA, inner_k: int = 3, n_bins: int = BINS) -> Search:
    return Search(Committee, [((alpha, min_leaf, depth), depth, 1.0)], grid["n_committees"], inner_k, n_bins)


def cv_committee(prepared: DataFrame, grid: dict[str, list] | None = None, k: int = 5, inner_k: int = 3, refit: bool = False, depth: int = DEPTH,
                 min_leaf: int = MIN_LEAF, alpha: float = ALPHA, n_bins: int = BINS,
                 local_rows: int = additive.LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and importances of rule committees (``additive.cross_validate``)."""
    return additive.cross_validate(prepared, search(grid or GRID, depth, min_leaf, alpha, inner_k, n_bins), k, refit, local_rows)
