"""Kernel models through landmarks.

Kernel ridge on n samples needs an n x n kernel.  Here up to ``m`` landmark rows for each
(dataset, preprocessing), drawn by hash of the id, give the features

    phi(x) = k(x, L) K_LL^(-1/2)

(the symmetric root, so they do not depend on the signs of eigenvectors), and
phi(x)'phi(y) approximates k(x, y) - exactly when every row is a landmark.  Kernel ridge
without intercept is ridge regression on phi, and its weights on the landmarks,
K_LL^(-1/2) b, are the dual coefficients of the exact model.  ``params`` says how many
landmarks there are and the rank of their kernel.

All kernels of a grid come from one pass: a row's products and distances with the landmarks
are computed once, every kernel's features are reduced to sums by (kernel, outer fold, inner
fold), and every training and validation set of the nested search is a sum or difference
of those cells.  Landmarks are drawn from all rows of a group, whatever their fold; no
target takes part in that.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions.distributed import top_k_per_group
from prismlake.sources.files import scratch_path

# The grid of the runtime search.
GRID = {"alpha": [0.1, 1.0, 10.0], "kernel": ["rbf", "polynomial", "linear"], "gamma": [None, 0.01, 0.1], "degree": [2, 3]}
DEFAULT_LANDMARKS = 100
COEF0 = 1.0
GROUP = ["dataset", "preprocessing"]


@dataclass(frozen=True)
class Kernel:
    name: str
    gamma: float | str | None = None      # None, "auto": 1 / bands; "scale": 1 / (bands * variance of the landmarks' values)
    degree: int = 3

    def matrix(self, products: np.ndarray, squares: np.ndarray, others: np.ndarray, bands: int, spread: float) -> np.ndarray:
        """Kernel of rows (their squared lengths) and others, from their inner products."""
        gamma = 1.0 / (bands * spread) if self.gamma == "scale" and spread > 0 else 1.0 / bands if self.gamma in (None, "auto", "scale") else self.gamma
        if self.name == "rbf":
            return np.exp(-gamma * np.maximum(squares[:, None] + others[None, :] - 2 * products, 0.0))
        if self.name == "polynomial":
            return (gamma * products + COEF0) ** self.degree
        return products

    def params(self) -> dict:
        more = {"rbf": {"gamma": self.gamma}, "polynomial": {"gamma": self.gamma, "degree": self.degree}, "linear": {}}[self.name]
        return {"kernel": self.name, **more}


def kernels(grid: dict[str, list]) -> list[Kernel]:
    """The different kernels of a grid: only polynomials have a degree, linear ones no gamma."""
    out = []
    for name, gamma, degree in itertools.product(grid["kernel"], grid["gamma"], grid["degree"]):
        k = Kernel(name, None if name == "linear" else gamma, degree if name == "polynomial" else 3)
        if k not in out:
            out.append(k)
    return out


class Landmarks:
    """Landmarks of one (dataset, preprocessing), and the roots of their kernels."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.squares = rows, (rows ** 2).sum(1)
        self.spread = float(rows.var())
        self.roots: dict[Kernel, tuple[np.ndarray, int]] = {}

    def kernel(self, kernel: Kernel, x: np.ndarray, products: np.ndarray | None = None) -> np.ndarray:
        products = x @ self.rows.T if products is None else products
        return kernel.matrix(products, (x ** 2).sum(1), self.squares, x.shape[1], self.spread)

    def root(self, kernel: Kernel) -> tuple[np.ndarray, int]:
        """K_LL^(-1/2) on the space where K_LL is not zero, and the dimension of that space."""
        if kernel not in self.roots:
            k = self.kernel(kernel, self.rows)
            values, vectors = np.linalg.eigh((k + k.T) / 2)
            keep = values > max(values.max(), 0.0) * 1e-12
            self.roots[kernel] = ((vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T, int(keep.sum()))
        return self.roots[kernel]

    def features(self, kernel: Kernel, x: np.ndarray, products: np.ndarray | None = None) -> np.ndarray:
        return self.kernel(kernel, x, products) @ self.root(kernel)[0]


def usable(prepared: DataFrame) -> DataFrame:
    """Rows with a target and a whole spectrum."""
    whole = F.col("spectrum").isNotNull() & ~F.exists("spectrum", lambda v: v.isNull() | F.isnan(v))
    return prepared.where(F.col("target").isNotNull() & ~F.isnan("target") & whole)


def draw_landmarks(rows: DataFrame, m: int = DEFAULT_LANDMARKS, seed: int = 42) -> dict[tuple[str, str], np.ndarray]:
    """(dataset, preprocessing) -> at most ``m`` spectra, lowest hash of the id first.  This is
    what the tasks get; it is m spectra a group, whatever the number of rows."""
    light = rows.select(*GROUP, "sample_id", F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(f"|landmark|{seed}"))).alias("_h"), "spectrum")
    marks = top_k_per_group(light, GROUP, [F.col("_h"), F.col("sample_id"), F.col("spectrum")], m, salt_col=F.pmod(F.xxhash64("sample_id"), F.lit(64)))
    out: dict[tuple[str, str], list] = {}
    for r in marks.orderBy(*GROUP, "rank").collect():
        out.setdefault((r["dataset"], r["preprocessing"]), []).append(r["spectrum"])
    return {k: np.array(v, float) for k, v in out.items()}


def by_group(pdf: pd.DataFrame) -> Iterator[tuple[tuple[str, str], pd.DataFrame, np.ndarray]]:
    for key, part in pdf.groupby(GROUP, sort=False):
        yield key, part, np.stack([np.asarray(v, float) for v in part["spectrum"]])


def sum_packed(partial: DataFrame, keys: list[str], column: str = "g") -> DataFrame:
    """Adds up packed arrays of doubles that have equal keys; one array a key and task is held."""
    fields = [partial.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + f", {column} binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, x in zip(*(b.column(k).to_pylist() for k in keys), b.column(column)):
                x = np.frombuffer(x.as_buffer(), float)
                acc[tuple(key)] = acc[tuple(key)] + x if tuple(key) in acc else x
        for key, x in acc.items():
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(keys, key)} | {column: [x.tobytes()]}, schema=_arrow(fields, column))
    return partial.select(*keys, column).repartition(*keys).mapInArrow(run, schema)


def _arrow(fields, column: str) -> pa.Schema:
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    return pa.schema([(f.name, types[f.dataType.simpleString()]) for f in fields] + [(column, pa.binary())])


def _moments(z: np.ndarray) -> np.ndarray:
    """Count and cross-products of rows [features, target], packed."""
    return np.concatenate([[len(z)], (z.T @ z).ravel()])


def _solve_cells(all_kernels: list[Kernel], alphas: list[float], folds: list[int], inner_k: int, landmarks: dict, m_of: dict):
    """Every alpha of one kernel on every training set: dual weights and inner RMSE."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        marks, kernel = Landmarks(landmarks[key[:2]]), all_kernels[int(key[2])]
        root, rank = marks.root(kernel)
        q = len(root) + 1
        cells = {(int(f), int(j)): np.frombuffer(g, float) for f, j, g in zip(pdf["fold"], pdf["inner"], pdf["g"])}
        total = lambda keep: sum((g for k, g in cells.items() if keep(*k)), np.zeros(1 + q * q))
        split = lambda g: (g[0], g[1:].reshape(q, q))
        rows = []
        for f in folds:
            n, a = split(total(lambda ff, j: ff != f))
            if n < 2:
                continue
            inner = []
            for j in range(inner_k):
                nv, v = split(total(lambda ff, jj: ff != f and jj == j))  # noqa: B023
                if nv and n - nv >= 2:
                    inner.append((nv, v, a - v))
            for i, alpha in enumerate(alphas):
                fit = lambda s: np.linalg.solve(s[:-1, :-1] + alpha * np.eye(q - 1), s[:-1, -1])  # noqa: E731, B023
                scores = []
                for nv, v, t in inner:
                    b = np.append(-fit(t), 1.0)
                    scores.append(np.sqrt(max(b @ v @ b, 0.0) / nv))
                params = json.dumps({"alpha": alpha, **kernel.params(), "landmarks": len(root), "rank": rank})
                rows.append((*key[:2], f, int(key[2]), i, params, float(np.mean(scores)) if scores else None, (root @ fit(a)).tolist()))
        return pd.DataFrame(rows, columns=["dataset", "preprocessing", "fold", "kernel", "alpha", "params", "inner_rmse", "dual"])
    return run


MODEL_SCHEMA = "dataset string, preprocessing string, fold int, kernel int, alpha int, params string, inner_rmse double, dual array<double>"


def fit_krr(rows: DataFrame, landmarks: dict, grid: dict[str, list], k: int, inner_k: int, refit: bool) -> DataFrame:
    """The chosen kernel ridge model of every outer fold (and fold -1, on all rows, with
    ``refit``): params, inner_rmse, dual weights on the landmarks."""
    all_kernels = kernels(grid)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}
        known: dict[tuple, Landmarks] = {}
        for pdf in batches:
            for key, part, x in by_group(pdf):
                marks = known.setdefault(key, Landmarks(landmarks[key]))
                products, y = x @ marks.rows.T, part["target"].to_numpy(float)
                cell = part["fold"].to_numpy() * 1000 + part["inner"].to_numpy()
                for i, kernel in enumerate(all_kernels):
                    z = np.column_stack([marks.features(kernel, x, products), y])
                    for c in np.unique(cell):
                        at = (*key, i, int(c // 1000), int(c % 1000))
                        acc[at] = acc.get(at, 0) + _moments(z[cell == c])
        if acc:
            yield pd.DataFrame([(*key, g.tobytes()) for key, g in acc.items()], columns=[*GROUP, "kernel", "fold", "inner", "g"])

    cells = rows.select(*GROUP, "fold", "inner", "spectrum", "target").mapInPandas(
        partial, "dataset string, preprocessing string, kernel int, fold int, inner int, g binary")
    folds = [*range(k), *([-1] if refit else [])]
    solve = _solve_cells(all_kernels, grid["alpha"], folds, inner_k, landmarks, {})
    models = sum_packed(cells, [*GROUP, "kernel", "fold", "inner"]).groupBy(*GROUP, "kernel").applyInPandas(solve, MODEL_SCHEMA)
    best = Window.partitionBy(*GROUP, "fold").orderBy(F.col("inner_rmse").asc_nulls_last(), "kernel", "alpha")
    return models.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def score_krr(rows: DataFrame, models: DataFrame, landmarks: dict, grid: dict[str, list]) -> DataFrame:
    """Out-of-fold predictions.  A row whose fold has no model keeps a null prediction."""
    all_kernels = kernels(grid)
    table = {(r["dataset"], r["preprocessing"], r["fold"]): (all_kernels[r["kernel"]], np.array(r["dual"]), r["params"], r["inner_rmse"])
             for r in models.where("fold >= 0").collect()}                       # m numbers a group and fold
    id_type = rows.schema["sample_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, Landmarks] = {}
        for pdf in batches:
            for key, part, x in by_group(pdf):
                marks = known.setdefault(key, Landmarks(landmarks[key]))
                products = x @ marks.rows.T
                out = part[[*GROUP, "fold", "sample_id"]].assign(model="krr", params=None, inner_rmse=None, y_true=part["target"], y_pred=None)
                for f in np.unique(part["fold"]):
                    if (*key, int(f)) in table:
                        kernel, dual, params, rmse = table[*key, int(f)]
                        at = (part["fold"] == f).to_numpy()
                        out.loc[at, ["params", "inner_rmse"]] = params, rmse
                        out.loc[at, "y_pred"] = marks.kernel(kernel, x[at], products[at]) @ dual
                yield out[[*GROUP, "model", "fold", "sample_id", "params", "inner_rmse", "y_true", "y_pred"]]

    return rows.select(*GROUP, "fold", "sample_id", "spectrum", "target").mapInPandas(
        run, f"dataset string, preprocessing string, model string, fold int, sample_id {id_type}, params string, inner_rmse double, y_true double, y_pred double")


def cv_krr(prepared: DataFrame, grid: dict[str, list] | None = None, k: int = 5, inner_k: int = 3, refit: bool = False,
           m: int = DEFAULT_LANDMARKS) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, chosen models) of kernel ridge, nested over kernel, gamma,
    degree and alpha.  ``prepared``: (dataset, preprocessing, sample_id, fold, inner, spectrum,
    target)."""
    grid = grid or GRID
    rows = usable(prepared)
    landmarks = draw_landmarks(rows, m)
    path = scratch_path(rows.sparkSession, "krr")
    fit_krr(rows, landmarks, grid, k, inner_k, refit).write.mode("overwrite").parquet(path)
    models = rows.sparkSession.read.schema(MODEL_SCHEMA).parquet(path)
    return score_krr(rows, models, landmarks, grid), models
