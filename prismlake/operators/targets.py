"""Target transforms.

Power transforms choose lambda by maximum likelihood per dataset.  Instead of a
sequential 1-D optimiser (one data pass per evaluation) every pass evaluates a
whole grid of lambdas at once: a task transforms its batches with NumPy and keeps
count, mean and squared deviations by (dataset, lambda), which are merged.  The
grid is refined around the best point; a handful of passes pin lambda to ~1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import arrays as A
from prismlake.functions.normal import norm_ppf

GRID_POINTS = 41
LAMBDA_RANGE = (-2.0, 2.0)
FINAL_STEP = 1e-4
MAX_PASSES = 60
# Fixed values of the quantile-to-normal mapping.
N_QUANTILES = 1000
BOUNDS_THRESHOLD = 1e-7


def target_log1p(df: DataFrame) -> DataFrame:
    return df.withColumn("y_log1p", F.log1p("target")).withColumn("y_back", F.expm1("y_log1p"))


def _boxcox(y, lam):
    return F.when(F.abs(lam) < 1e-12, F.log(y)).otherwise((F.pow(y, lam) - 1) / lam)


def _yeojohnson(y, lam):
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(y)).otherwise((F.pow(y + 1, lam) - 1) / lam)
    neg = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-y)).otherwise(-(F.pow(-y + 1, 2 - lam) - 1) / (2 - lam))
    return F.when(y >= 0, pos).otherwise(neg)


def _transform(method, y, lam):
    return F.when(method == "box-cox", _boxcox(y, lam)).otherwise(_yeojohnson(y, lam))


def _power_values(method: str, y: np.ndarray, lams: np.ndarray) -> Iterator[np.ndarray]:
    """The transformed values (without missing ones) for each lambda."""
    if method == "box-cox":
        for lam in lams:
            yield np.log(y[y > 0]) if abs(lam) < 1e-12 else (np.power(y, lam) - 1) / lam
        return
    up, down = y[~(y < 0)], -y[y < 0]
    for lam in lams:
        pos = np.log1p(up) if abs(lam) < 1e-12 else (np.power(up + 1, lam) - 1) / lam
        neg = -np.log1p(down) if abs(lam - 2) < 1e-12 else -(np.power(down + 1, 2 - lam) - 1) / (2 - lam)
        yield np.concatenate([pos, neg])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(3, lambdas): counts, means and squared deviations of two sets of rows together."""
    n = a[0] + b[0]
    share, d = b[0] / np.maximum(n, 1), b[1] - a[1]
    return np.stack([n, a[1] + d * share, a[2] + b[2] + d * d * a[0] * share])


def _grid_variances(base: DataFrame, settings: dict[str, tuple[str, float, float]]) -> DataFrame:
    """(dataset, k, lam, var_t): population variance of the transformed target at every grid
    point; ``settings``: dataset -> (method, center, step)."""
    half = (GRID_POINTS - 1) // 2
    grid = {name: center + np.arange(-half, half + 1) * step for name, (_, center, step) in settings.items()}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, np.ndarray] = {}
        for b in batches:
            codes, y = b.column("dataset").dictionary_encode(), b.column("target").to_numpy(zero_copy_only=False)
            at = codes.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(codes.dictionary.to_pylist()):
                got = np.zeros((3, GRID_POINTS))
                with np.errstate(all="ignore"):
                    for k, t in enumerate(_power_values(settings[name][0], y[at == code], grid[name])):
                        if len(t):
                            d = t - t[0]
                            m = d.mean()
                            got[:, k] = len(t), t[0] + m, ((d - m) ** 2).sum()
                    acc[name] = _merged(acc[name], got) if name in acc else got
        yield pa.RecordBatch.from_pydict({"dataset": pa.array(list(acc), pa.string()), "sums": pa.array([x.tobytes() for x in acc.values()], pa.binary())})

    def total(key, pdf: pd.DataFrame) -> pd.DataFrame:
        acc = np.zeros((3, GRID_POINTS))
        with np.errstate(all="ignore"):
            for x in pdf["sums"]:
                acc = _merged(acc, np.frombuffer(x, float).reshape(3, -1))
            var = acc[2] / acc[0]
        return pd.DataFrame({"dataset": key[0], "k": range(GRID_POINTS), "lam": grid[key[0]], "var_t": var})

    rows = base.where("dataset is not null").select(F.col("dataset").cast("string"), F.col("target").cast("double"))
    return rows.mapInArrow(partial, "dataset string, sums binary").groupBy("dataset").applyInPandas(total, "dataset string, k int, lam double, var_t double")


def power_lambdas(df: DataFrame, method: str = "auto") -> DataFrame:
    """(dataset, method, lambda, llf): Box-Cox when every target > 0 (or forced),
    otherwise Yeo-Johnson; lambda maximises the profile log-likelihood."""
    y = F.col("target")
    base = df.where(y.isNotNull()).select("dataset", "target")
    info = base.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.min("target").alias("ymin"), F.max("target").alias("ymax"),
        F.sum(F.log(y)).alias("sum_log"),                                   # Box-Cox Jacobian term
        F.sum(F.signum(y) * F.log1p(F.abs(y))).alias("sum_slog"))           # Yeo-Johnson Jacobian term
    if method == "auto":
        info = info.withColumn("method", F.when(F.col("ymin") > 0, "box-cox").otherwise("yeo-johnson"))
    else:
        info = info.withColumn("method", F.lit(method))
    info = info.withColumn("center", F.lit(0.0)).withColumn("step", F.lit((LAMBDA_RANGE[1] - LAMBDA_RANGE[0]) / (GRID_POINTS - 1)))
    half = (GRID_POINTS - 1) // 2
    best = None
    for _ in range(MAX_PASSES):
        info = info.checkpoint(eager=True)          # tiny: one row per dataset
        if info.where(F.col("step") > FINAL_STEP).isEmpty():
            break
        settings = {r["dataset"]: (r["method"], r["center"], r["step"]) for r in info.where("dataset is not null").collect()}
        sums = _grid_variances(base, settings).withColumnRenamed("dataset", "_set")
        same = F.col("ymin") == F.col("ymax")       # without spread: no likelihood
        llf = sums.join(info, F.col("_set") == F.col("dataset")).withColumn("llf", F.when(
            F.col("method") == "box-cox", (F.col("lam") - 1) * F.col("sum_log")).otherwise((F.col("lam") - 1) * F.col("sum_slog"))
            - F.col("n") / 2 * F.log(F.when(same, F.lit(0.0)).otherwise(F.col("var_t"))))
        best = llf.groupBy("dataset").agg(F.max_by(F.struct("lam", "k"), "llf").alias("b"))
        # a maximum at the end of the grid moves the grid on (twice as wide); one inside it narrows the grid
        at_end = F.col("b.k").isin(0, 2 * half)
        info = (info.drop("center").join(best, "dataset")
                .withColumn("center", F.coalesce(F.col("b.lam"), F.lit(1.0)))
                .withColumn("step", F.when(at_end, F.col("step") * 2).otherwise(F.col("step") / ((GRID_POINTS - 1) / 4))).drop("b"))
    return info.select("dataset", "method", F.col("center").alias("lambda"))


def power_transform(df: DataFrame, method: str = "auto", standardize: bool = True) -> DataFrame:
    """Adds ``y_power`` (standardised to mean 0, population std 1), ``lambda``, ``method``."""
    lam = power_lambdas(df, method)
    out = df.join(lam, "dataset").withColumn("y_power", _transform(F.col("method"), F.col("target"), F.col("lambda")))
    if standardize:
        st = out.groupBy("dataset").agg(F.avg("y_power").alias("_m"), F.stddev_pop("y_power").alias("_s"))
        out = out.join(st, "dataset").withColumn("y_power", F.try_divide(F.col("y_power") - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    return out


def target_quantile_normal(df: DataFrame, n_quantiles: int = N_QUANTILES) -> DataFrame:
    """Empirical CDF through min(n_quantiles, n) evenly spaced quantiles, averaged
    forward/backward interpolation (ties), then the standard normal quantile,
    clipped at the 1e-7 bounds.  Adds ``y_qnormal``."""
    from prismlake.functions.distributed import DEFAULT_MAX_BUFFER, group_quantiles
    base = df.where(F.col("target").isNotNull()).select("dataset", "target")
    n = base.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    largest = n.agg(F.max("_n")).first()[0] or 0
    refs = [k / (n_quantiles - 1) for k in range(n_quantiles)]
    # datasets with <= n_quantiles rows: the quantiles at n references are the sorted values
    small = (base.join(n.where(F.col("_n") <= n_quantiles), "dataset")
             .groupBy("dataset").agg(F.array_sort(F.collect_list("target")).alias("_quant")))
    if largest <= n_quantiles:
        q = small
    else:
        big = base.join(n.where(F.col("_n") > n_quantiles), "dataset")
        if largest <= DEFAULT_MAX_BUFFER:
            qb = big.groupBy("dataset").agg(F.percentile("target", F.array(*[F.lit(r) for r in refs])).alias("_quant"))
        else:   # bounded-memory exact selection, one column per reference
            names = {f"q{k}": r for k, r in enumerate(refs)}
            qb = group_quantiles(big, ["dataset"], "target", names).select(
                "dataset", F.array(*[F.col(c) for c in names]).alias("_quant"))
        q = small.unionByName(qb)
    y = F.col("target")
    quant = F.col("_quant")
    m = F.size(quant)
    ref = lambda k: k.cast("double") / (m - 1)
    lo_idx = F.aggregate(quant, F.lit(0), lambda acc, v: acc + F.when(v <= y, 1).otherwise(0))     # count q <= y
    hi_idx = m - F.aggregate(quant, F.lit(0), lambda acc, v: acc + F.when(v >= y, 1).otherwise(0))  # first q >= y
    def interp(i0):
        a = F.element_at(quant, i0)          # 1-based: quant[i0-1] in 0-based terms
        b = F.element_at(quant, i0 + 1)
        return F.when(b == a, ref(i0 - 1)).otherwise(ref(i0 - 1) + (y - a) / (b - a) * (ref(i0) - ref(i0 - 1)))
    f1 = A.let(F.greatest(F.least(lo_idx, m - 1), F.lit(1)), interp)      # bind: one scan of the array
    f2 = A.let(F.greatest(F.least(hi_idx, m - 1), F.lit(1)), interp)
    cdf = (f1 + f2) / 2
    cdf = F.when(y - BOUNDS_THRESHOLD < F.element_at(quant, 1), F.lit(0.0)) \
        .when(y + BOUNDS_THRESHOLD > F.element_at(quant, -1), F.lit(1.0)).otherwise(cdf)
    eps = float(np.spacing(1))
    lo, hi = BOUNDS_THRESHOLD - eps, 1 - (BOUNDS_THRESHOLD - eps)
    z = norm_ppf(F.least(F.greatest(cdf, F.lit(lo)), F.lit(hi)))
    return df.join(q.select("dataset", "_quant"), "dataset").withColumn("y_qnormal", z).drop("_quant")


def skew_before_after(df: DataFrame, transformed: str = "y_log1p") -> DataFrame:
    """Bias-corrected skewness of the target before and after a transform."""
    n = F.count("target").cast("double")
    corr = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return df.groupBy("dataset").agg((F.skewness("target") * corr).alias("skew_before"),
                                     (F.skewness(transformed) * corr).alias("skew_after"))
