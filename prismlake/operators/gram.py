"""Distributed Gram (cross-product) pass.

For every key (e.g. dataset x preprocessing x fold) we need n, sum(z) and Z'Z for
z = [x_1..x_p, y].  Each Arrow batch is reduced with NumPy to one small packed
vector per key inside ``mapInPandas`` (so no p^2 rows are ever exploded), and the
packed vectors are summed with ``Summarizer.sum`` -- an aggregate with map-side
partial merge.  The result has one row per key with (p+1)^2 + p + 2 doubles,
independent of the number of samples, so collecting it to the driver is bounded
by keys x p^2.

Columns may be shifted by a per-key constant (``shift``: an early mean estimate)
to limit cancellation; the algebra below undoes the shift exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gram_pass(df: DataFrame, keys: list[str], features: str = "spectrum", target: str | None = "target",
              shift: DataFrame | None = None) -> DataFrame:
    """-> (keys..., p INT, g ARRAY<DOUBLE>) where g packs n, sum z, Z'Z (z = [x, y]).

    Rows with a null/NaN feature or target are skipped.  ``shift``: optional frame
    ``(keys..., shift ARRAY<DOUBLE>)`` subtracted from z before the products.
    """
    cols = [*keys, features] + ([target] if target else [])
    src = df.select(*cols)
    if shift is not None:
        src = src.join(shift, keys, "left")
    else:
        src = src.withColumn("shift", F.lit(None).cast("array<double>"))
    key_fields = [f for f in src.schema.fields if f.name in keys]
    out_schema = T.StructType(key_fields + [T.StructField("p", T.IntegerType()),
                                            T.StructField("g", T.ArrayType(T.DoubleType()))])
    has_y = target is not None

    def run(batches):
        acc: dict[tuple, np.ndarray] = {}
        dims: dict[tuple, int] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                rows = [np.asarray(v, dtype=float) if v is not None else None for v in part[features]]
                X = [r for r in rows]
                y = part[target].to_numpy(dtype=float) if has_y else None
                ok = np.array([r is not None and not np.isnan(r).any() for r in X])
                if has_y:
                    ok &= ~np.isnan(y)
                if not ok.any():
                    continue
                Xm = np.vstack([X[i] for i in np.flatnonzero(ok)])
                Z = np.column_stack([Xm, y[ok]]) if has_y else Xm
                sh = part["shift"].iloc[0]
                if sh is not None:
                    Z = Z - np.asarray(sh, dtype=float)[None, :]
                packed = np.concatenate([[Z.shape[0]], Z.sum(axis=0), (Z.T @ Z).ravel()])
                if key in acc:
                    acc[key] += packed
                else:
                    acc[key] = packed
                    dims[key] = Xm.shape[1]
        import pandas as pd
        if acc:
            rows = [list(k) + [dims[k], v.tolist()] for k, v in acc.items()]
            yield pd.DataFrame(rows, columns=[*keys, "p", "g"])

    partial = src.mapInPandas(run, out_schema)
    summed = partial.groupBy(*keys).agg(
        F.first("p").alias("p"),
        Summarizer.sum(array_to_vector(F.col("g"))).alias("gv"))
    return summed.select(*keys, "p", vector_to_array("gv").alias("g"))


@dataclass
class Moments:
    """Unpacked Gram of z = [x, (y)] (shift undone)."""
    n: float
    mean: np.ndarray      # (q,)
    cov_ss: np.ndarray    # (q, q) centred sums of squares and cross-products

    @staticmethod
    def from_packed(g, q: int, shift=None) -> "Moments":
        g = np.asarray(g, dtype=float)
        n = g[0]
        s = g[1:1 + q]
        zz = g[1 + q:].reshape(q, q)
        mean_shifted = s / n
        css = zz - n * np.outer(mean_shifted, mean_shifted)
        mean = mean_shifted + (np.asarray(shift, dtype=float) if shift is not None else 0.0)
        return Moments(n, mean, css)

    def __sub__(self, other: "Moments") -> "Moments":
        """Moments of the rows in self but not in other (fold subtraction)."""
        n = self.n - other.n
        tot = self.mean * self.n - other.mean * other.n
        mean = tot / n
        # raw second moments about zero, then re-centre
        raw = (self.cov_ss + self.n * np.outer(self.mean, self.mean)
               - other.cov_ss - other.n * np.outer(other.mean, other.mean))
        return Moments(n, mean, raw - n * np.outer(mean, mean))

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        mean = (self.mean * self.n + other.mean * other.n) / n
        raw = (self.cov_ss + self.n * np.outer(self.mean, self.mean)
               + other.cov_ss + other.n * np.outer(other.mean, other.mean))
        return Moments(n, mean, raw - n * np.outer(mean, mean))

    def raw(self) -> np.ndarray:
        """Uncentred sums of squares and cross-products (for no-intercept models)."""
        return self.cov_ss + self.n * np.outer(self.mean, self.mean)


def correlation(m: Moments) -> np.ndarray:
    d = np.sqrt(np.diag(m.cov_ss))
    with np.errstate(divide="ignore", invalid="ignore"):
        return m.cov_ss / np.outer(d, d)
