"""Gradient-boosted regression trees (squared loss) on the additive engine.

Each round grows a tree on the residuals of all rounds before; a leaf adds its mean residual
times the learning rate.  ``subsample`` draws that share of the training rows by a hash of
(row, round) instead of an exact number.  Splits are those of exact boosting on binned
bands (``histograms.BINS`` quantile bins a band).
"""

from __future__ import annotations

import itertools
import json

import numpy as np
from pyspark.sql import DataFrame

from prismlake.operators import additive
from prismlake.operators.additive import Fit, Method, Rows, Search
from prismlake.operators.histograms import BINS

# The grid of the runtime search, and the fixed-set configuration.
GRID = {"n_estimators": [200, 500], "learning_rate": [0.05, 0.1], "max_depth": [2, 3], "subsample": [0.7, 1.0]}
FIXED = {"n_estimators": [200], "learning_rate": [0.1], "max_depth": [3], "subsample": [1.0]}


class Boosting(Method):
    model = "gbr"

    def __init__(self, fits: list[Fit]):
        super().__init__(fits)
        self.base = np.zeros(len(fits))
        self.values: list[np.ndarray] = []                # a round: (fits, leaves)

    def begin(self, n: np.ndarray, s: np.ndarray) -> None:
        self.base = s / np.maximum(n, 1)

    def start(self, rows: Rows) -> np.ndarray:
        return np.repeat(self.base[None, :, None], len(rows.y), 2)

    def target(self, rows: Rows, state: np.ndarray, turn: int) -> np.ndarray:
        return rows.y - state[0]

    def finish(self, sides: np.ndarray, moments: np.ndarray | None) -> None:
        rate = np.array([f.setting[0] for f in self.fits])[:, None]
        self.values.append(rate * sides[..., 1] / np.maximum(sides[..., 0], 1))

    def after(self, rows: Rows, state: np.ndarray, turn: int, leaf: np.ndarray) -> np.ndarray:
        return state + np.take_along_axis(self.values[turn], leaf, 1)

    def predictions(self, state: np.ndarray, rounds: int) -> np.ndarray:
        return state[0]

    def params(self, rounds: int, setting: tuple) -> str:
        return json.dumps({"n_estimators": rounds, "learning_rate": setting[0], "max_depth": setting[1], "subsample": setting[2]})


def search(grid: dict[str, list], inner_k: int = 3, n_bins: int = BINS) -> Search:
    points = itertools.product(grid["learning_rate"], grid["max_depth"], grid["subsample"])
    return Search(Boosting, [(p, p[1], p[2]) for p in points], grid["n_estimators"], inner_k, n_bins)


def cv_boosting(prepared: DataFrame, grid: dict[str, list] | None = None, k: int = 5, inner_k: int = 3, refit: bool = False,
                n_bins: int = BINS, local_rows: int = additive.LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and importances of boosted trees (``additive.cross_validate``)."""
    return additive.cross_validate(prepared, search(grid or FIXED, inner_k, n_bins), k, refit, local_rows)
