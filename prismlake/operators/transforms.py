"""Spectral transforms.

Row-local transforms are single projections of higher-order functions over the
``spectrum`` array (no shuffle, fused with the scan).  Column statistics (band
median for imputation, MSC mean spectrum, scaler statistics) come from one
partial aggregation by ``(dataset, band)`` and a join of a per-dataset array.
The convex-hull continuum needs a stack algorithm, so it runs vectorised over
Arrow batches in ``mapInPandas`` (one pass, no shuffle).

Two generations of the reference share names with different formulas; both are
kept under distinct names (``prep_endpoint_baseline`` is the runtime
"Continuum Removal", ``prep_hull_removal`` the notebook one).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismlake.functions import arrays as A
from prismlake.operators import clean

# Fixed values of the reference transforms.
SG_WINDOW = 11
SG_POLYORDER = 2
SNV_STD_FLOOR = 1e-9
HULL_FLOOR = 1e-9
ENTROPY_EPS = 1e-8
RATIO_EPS = 1e-8
ROWMAX_ZERO = 1e-6


def _set(df: DataFrame, expr) -> DataFrame:
    return df.withColumn("spectrum", expr)


def prep_none(df: DataFrame) -> DataFrame:
    return df


def prep_rowmax(df: DataFrame) -> DataFrame:
    """x / max(x) per row; a zero max is replaced by 1e-6."""
    m = F.array_max("spectrum")
    m = F.when(m == 0, F.lit(ROWMAX_ZERO)).otherwise(m)
    return _set(df, A.let(m, lambda mx: F.transform("spectrum", lambda x: x / mx)))


def prep_reflectance(df: DataFrame) -> DataFrame:
    """Runtime "Reflectance": zeros -> neighbour values down each band (ffill, bfill)."""
    return clean.zero_fill_neighbors(df)


def _neg_log10(x):
    # log10 of a non-positive value is undefined: null (the reference gets NaN and
    # later replaces it by the band median)
    return F.when(x > 0, -F.log10(x)).otherwise(F.lit(None).cast("double"))


def prep_absorbance(df: DataFrame) -> DataFrame:
    """-log10(R) with 0 -> 1e-6; non-finite -> null -> band median."""
    out = _set(clean.zero_to_eps(df), F.transform("spectrum", _neg_log10))
    return clean.impute_median(clean.inf_to_null(out))


def prep_absorbance_mean_guard(df: DataFrame) -> DataFrame:
    """log10(1/R) after zeros/nulls were replaced by the band mean."""
    guarded = clean.fill_from_band_stat(df, clean.band_stat_arrays(df, "mean"), "spectrum",
                                        when=lambda x: (x == 0) | x.isNull())
    return _set(guarded, F.transform("spectrum", lambda x: F.when(x > 0, F.log10(F.lit(1.0) / x))))


def prep_endpoint_baseline(df: DataFrame) -> DataFrame:
    """x - straight line through the first and last band (over band index); then
    non-finite -> null -> band median."""
    s = F.col("spectrum")
    n = F.size(s)
    first, last = F.element_at(s, 1), F.element_at(s, -1)
    line = lambda i: first + (last - first) * i / F.greatest(n - 1, F.lit(1))
    return clean.impute_median(clean.inf_to_null(_set(df, F.transform(s, lambda x, i: x - line(i)))))


def prep_snv(df: DataFrame) -> DataFrame:
    """(x - mean) / std (ddof 0); a zero std becomes 1e-9."""
    s = F.col("spectrum")

    def with_mean(m):
        var = F.aggregate(s, A.zero(), lambda acc, x: acc + (x - m) * (x - m)) / F.size(s)
        return A.let(F.sqrt(var), lambda sd: F.transform(
            s, lambda x: (x - m) / F.when(sd == 0, F.lit(SNV_STD_FLOOR)).otherwise(sd)))

    return _set(df, A.let(A.arr_mean(s), with_mean))


@lru_cache(maxsize=None)
def savgol_weights(window: int = SG_WINDOW, polyorder: int = SG_POLYORDER, deriv: int = 0,
                   delta: float = 1.0) -> tuple[tuple[float, ...], ...]:
    """Weight rows of a least-squares polynomial filter.

    Row ``o`` gives the ``deriv``-th derivative, at window position ``o``, of the
    degree-``polyorder`` least-squares polynomial through the window.  The centre
    row is the classic Savitzky-Golay kernel; other rows are the end-window fits
    used for the first and last ``window // 2`` outputs.
    """
    if window % 2 == 0:
        window += 1
    t = np.arange(window, dtype=float)
    V = np.vander(t, polyorder + 1, increasing=True)          # window x (p+1)
    pinv = np.linalg.pinv(V)                                    # (p+1) x window: coefficients
    rows = []
    for o in range(window):
        # d^deriv/dt^deriv of sum_k c_k t^k at t=o
        basis = np.zeros(polyorder + 1)
        for k in range(deriv, polyorder + 1):
            basis[k] = np.prod(np.arange(k - deriv + 1, k + 1)) * o ** (k - deriv)
        rows.append(tuple(float(v) for v in (basis @ pinv) / delta ** deriv))
    return tuple(rows)


def prep_sg(df: DataFrame, deriv: int = 0, window: int = SG_WINDOW, polyorder: int = SG_POLYORDER) -> DataFrame:
    w = [list(r) for r in savgol_weights(window, polyorder, deriv)]
    return A.filter_windows(df, "spectrum", w)


def prep_sg_smooth(df: DataFrame, window: int = SG_WINDOW, polyorder: int = SG_POLYORDER) -> DataFrame:
    return prep_sg(df, 0, window, polyorder)


def prep_sg_deriv1(df: DataFrame) -> DataFrame:
    return prep_sg(df, 1)


def prep_sg_deriv2(df: DataFrame) -> DataFrame:
    return prep_sg(df, 2)


def mean_spectrum(df: DataFrame) -> DataFrame:
    """(dataset, stat ARRAY): the per-dataset mean spectrum (a column statistic)."""
    return clean.band_stat_arrays(df, "mean")


def prep_msc(df: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Multiplicative scatter correction against the dataset mean spectrum (or a stored one,
    (dataset, stat)): least squares x ~ a*m + b per row, output (x - b) / a."""
    joined = df.join(mean_spectrum(df) if reference is None else reference, "dataset")
    s, m = F.col("spectrum"), F.col("stat")

    def fit(mm, xm):
        sxy = F.aggregate(F.zip_with(m, s, lambda a, b: (a - mm) * (b - xm)), A.zero(), lambda acc, v: acc + v)
        sxx = F.aggregate(m, A.zero(), lambda acc, a: acc + (a - mm) * (a - mm))
        return A.let(F.try_divide(sxy, sxx), lambda slope: A.let(xm - slope * mm, lambda icept: F.transform(
            s, lambda x: F.try_divide(x - icept, slope))))

    out = A.let(A.arr_mean(m), lambda mm: A.let(A.arr_mean(s), lambda xm: fit(mm, xm)))
    return joined.withColumn("spectrum", out).drop("stat")


def prep_msc_deriv1(df: DataFrame) -> DataFrame:
    return prep_sg_deriv1(prep_msc(df))


def prep_snv_deriv1(df: DataFrame) -> DataFrame:
    return prep_sg_deriv1(prep_snv(df))


# ----------------------------------------------------------------- convex hull

def upper_hull(wavelengths: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """Upper convex hull of every row of ``Y`` over the x grid ``wavelengths``,
    evaluated at the grid.  Monotone chain, vectorised across rows."""
    m, n = Y.shape
    x = np.asarray(wavelengths, dtype=float)
    rows = np.arange(m)
    stack = np.zeros((m, n), dtype=np.int64)
    size = np.zeros(m, dtype=np.int64)
    for k in range(n):
        while True:
            can = size >= 2
            if not can.any():
                break
            r = rows[can]
            a = stack[r, size[r] - 2]
            b = stack[r, size[r] - 1]
            cross = (x[b] - x[a]) * (Y[r, k] - Y[r, a]) - (Y[r, b] - Y[r, a]) * (x[k] - x[a])
            pop = cross >= 0
            if not pop.any():
                break
            size[r[pop]] -= 1
        stack[rows, size] = k
        size += 1
    is_vertex = np.zeros((m, n), dtype=bool)
    for j in range(n):
        sel = size > j
        is_vertex[rows[sel], stack[sel, j]] = True
    idx = np.broadcast_to(np.arange(n), (m, n))
    left = np.maximum.accumulate(np.where(is_vertex, idx, -1), axis=1)
    right = np.minimum.accumulate(np.where(is_vertex, idx, n)[:, ::-1], axis=1)[:, ::-1]
    yl = np.take_along_axis(Y, left, 1)
    yr = np.take_along_axis(Y, right, 1)
    xl, xr = x[left], x[right]
    span = np.where(right > left, xr - xl, 1.0)
    return np.where(right > left, yl + (yr - yl) * (x[None, :] - xl) / span, yl)


def prep_hull_removal(df: DataFrame, wavelengths: list[float]) -> DataFrame:
    """x / upper convex hull over wavelength, hull floored at 1e-9.

    Rows with a missing band give a null spectrum.  ``wavelengths`` is the
    (ascending) band grid of the spectra.
    """
    wl = np.asarray(wavelengths, dtype=float)
    schema = df.schema
    idx = schema.fieldNames().index("spectrum")

    def run(batches):
        for pdf in batches:
            spec = pdf["spectrum"]
            out = [None] * len(pdf)
            ok = [i for i, s in enumerate(spec) if s is not None and len(s) == len(wl)
                  and not any(v is None for v in s)]
            if ok:
                Y = np.array([np.asarray(spec.iat[i], dtype=float) for i in ok])
                good = ~np.isnan(Y).any(axis=1)
                if good.any():
                    H = upper_hull(wl, Y[good])
                    H[H <= HULL_FLOOR] = HULL_FLOOR
                    R = Y[good] / H
                    for j, i in enumerate(np.asarray(ok)[good]):
                        out[i] = R[j].tolist()
            pdf["spectrum"] = out
            yield pdf

    assert isinstance(schema.fields[idx].dataType, T.ArrayType)
    return df.mapInPandas(run, schema)


# ----------------------------------------------------------------- scaling

def _band_stats_arrays(df: DataFrame, aggs: dict) -> DataFrame:
    from prismlake.sources.schema import spectrum_to_long
    long = spectrum_to_long(df.select("dataset", "sample_id", "spectrum"))
    st = long.groupBy("dataset", "band").agg(*[e.alias(n) for n, e in aggs.items()])
    def field(name):
        return lambda s: s[name]
    return st.groupBy("dataset").agg(*[
        F.transform(F.array_sort(F.collect_list(F.struct("band", n))), field(n)).alias(n) for n in aggs])


def scale_standard(df: DataFrame) -> DataFrame:
    """Band z-score with population std; a zero std leaves the centred value."""
    st = _band_stats_arrays(df, {"_mu": F.avg("value"), "_sd": F.stddev_pop("value")})
    sd = lambda i: F.element_at("_sd", i + 1)
    return (df.join(st, "dataset")
            .withColumn("spectrum", F.transform("spectrum", lambda x, i: (x - F.element_at("_mu", i + 1))
                                                / F.when(sd(i) == 0, F.lit(1.0)).otherwise(sd(i))))
            .drop("_mu", "_sd"))


def scale_robust(df: DataFrame) -> DataFrame:
    """(x - median) / IQR per band; a zero IQR leaves the centred value."""
    from prismlake.functions.distributed import group_quantiles
    from prismlake.sources.schema import spectrum_to_long
    long = spectrum_to_long(df.select("dataset", "sample_id", "spectrum"))
    q = group_quantiles(long, ["dataset", "band"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, wide=df.select("dataset"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    st = q.groupBy("dataset").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("band", "q2"))), lambda s: s["q2"]).alias("_med"),
        F.transform(F.array_sort(F.collect_list(F.struct("band", "iqr"))), lambda s: s["iqr"]).alias("_iqr"))
    iqr = lambda i: F.element_at("_iqr", i + 1)
    return (df.join(st, "dataset")
            .withColumn("spectrum", F.transform("spectrum", lambda x, i: (x - F.element_at("_med", i + 1))
                                                / F.when(iqr(i) == 0, F.lit(1.0)).otherwise(iqr(i))))
            .drop("_med", "_iqr"))


# ----------------------------------------------------------------- features

def _arr_quantile(sorted_arr, n, p: float):
    pos = (n - 1) * F.lit(p)
    lo = F.floor(pos).cast("int")
    frac = pos - lo
    a = F.element_at(sorted_arr, lo + 1)
    b = F.element_at(sorted_arr, F.least(lo + 2, n))
    return a + frac * (b - a)


def spectrum_stats_columns(spectrum: str = "spectrum", mean=None) -> dict:
    """The 10 per-spectrum features: mean, std (ddof 0), bias-corrected skewness and
    excess kurtosis, q25, q75, range, entropy, start/end ratio and slope (last two
    only for more than 10 bands)."""
    s = F.col(spectrum)
    n = F.size(s).cast("double")
    m = mean if mean is not None else A.arr_mean(s)
    m2 = A.arr_centered_power_sum(s, m, 2) / n
    m3 = A.arr_centered_power_sum(s, m, 3) / n
    m4 = A.arr_centered_power_sum(s, m, 4) / n
    g1 = F.try_divide(m3, F.pow(m2, 1.5))
    g2 = F.try_divide(m4, m2 * m2) - 3.0
    skew = F.when(n >= 3, F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2))
    kurt = F.when(n >= 4, F.try_divide(((n + 1) * g2 + 6) * (n - 1), (n - 2) * (n - 3)))
    srt = F.array_sort(s)
    first, last = F.element_at(s, 1), F.element_at(s, -1)
    return {
        "f_mean": m,
        "f_std": F.sqrt(m2),
        "f_skewness": skew,
        "f_kurtosis": kurt,
        "f_q25": _arr_quantile(srt, F.size(s), 0.25),
        "f_q75": _arr_quantile(srt, F.size(s), 0.75),
        "f_range": F.array_max(s) - F.array_min(s),
        "f_entropy": -F.aggregate(s, A.zero(), lambda acc, x: acc + x * F.log(x + F.lit(ENTROPY_EPS))),
        "f_ratio_start_end": F.when(n > 10, F.try_divide(first, last + F.lit(RATIO_EPS))),
        "f_slope": F.when(n > 10, (last - first) / n),
    }


def _feature_struct() -> F.Column:
    """All features as one struct, with the row mean bound once (see ``arrays.let``)."""
    def body(m):
        cols = spectrum_stats_columns(mean=m)
        return F.struct(*[e.alias(k) for k, e in cols.items()])
    return A.let(A.arr_mean("spectrum"), body)


def feat_spectrum_stats(df: DataFrame) -> DataFrame:
    return df.withColumn("_f", _feature_struct()).select(*df.columns, "_f.*")


def feat_append(df: DataFrame) -> DataFrame:
    """Spectrum with the engineered features appended (bands first)."""
    names = ["f_mean", "f_std", "f_skewness", "f_kurtosis", "f_q25", "f_q75", "f_range", "f_entropy"]
    staged = df.withColumn("_f", _feature_struct())
    tail = F.array(*[F.col(f"_f.{k}") for k in names])
    long_tail = F.when(F.size("spectrum") > 10, F.concat(
        tail, F.array(F.col("_f.f_ratio_start_end"), F.col("_f.f_slope")))).otherwise(tail)
    return staged.withColumn("spectrum", F.concat(F.col("spectrum"), long_tail)).drop("_f")


def feat_row_slope(df: DataFrame, wavelengths: list[float]) -> DataFrame:
    """Least-squares slope of each spectrum against wavelength; wavelength moments are
    literals, so this is one projection."""
    w = np.asarray(wavelengths, dtype=float)
    wc = (w - w.mean()).tolist()
    sww = float(((w - w.mean()) ** 2).sum())
    lit_w = F.array(*[F.lit(v) for v in wc])
    return df.withColumn("slope", A.arr_dot("spectrum", lit_w) / F.lit(sww))


# ----------------------------------------------------------------- registry

def registry(wavelengths: list[float] | None = None) -> dict:
    """name -> DataFrame transform: the extension point for new preprocessing."""
    reg = {
        # runtime generation
        "Reflectance": prep_reflectance,
        "Absorbance": prep_absorbance,
        "Continuum Removal": prep_endpoint_baseline,
        # notebook generation
        "none": prep_none,
        "rowmax": prep_rowmax,
        "absorbance_mean_guard": prep_absorbance_mean_guard,
        "snv": prep_snv,
        "sg_smooth": prep_sg_smooth,
        "sg_deriv1": prep_sg_deriv1,
        "sg_deriv2": prep_sg_deriv2,
        "msc": prep_msc,
        "msc_deriv1": prep_msc_deriv1,
        "snv_deriv1": prep_snv_deriv1,
        "standard": scale_standard,
        "robust": scale_robust,
    }
    if wavelengths is not None:
        reg["hull_removal"] = lambda d: prep_hull_removal(d, wavelengths)
    return reg


def apply_variants(df: DataFrame, names: list[str], reg: dict | None = None) -> DataFrame:
    """Union of the named transforms with a ``preprocessing`` column (lazy; each
    variant is its own projection of the same scan)."""
    reg = reg or registry()
    out = None
    for n in names:
        v = reg[n](df).withColumn("preprocessing", F.lit(n))
        out = v if out is None else out.unionByName(v)
    return out


def prep_smoothed_variants(df: DataFrame) -> DataFrame:
    """Savitzky-Golay smoothing over reflectance, absorbance, SNV and 1st derivative."""
    variants = {
        "smooth_reflectance": df,
        "smooth_absorbance": prep_absorbance(df),
        "smooth_snv": prep_snv(df),
        "smooth_deriv1": prep_sg_deriv1(df),
    }
    out = None
    for n, v in variants.items():
        s = prep_sg_smooth(v).withColumn("preprocessing", F.lit(n))
        out = s if out is None else out.unionByName(s)
    return out


def apply_stored_prep(df: DataFrame, label: str) -> DataFrame:
    """Apply the transform named in a stored label ``<Prep>_<model>`` (text before the
    last ``_``); unknown names default to runtime reflectance; then inf -> null ->
    band median."""
    prep = label.rsplit("_", 1)[0] if "_" in label else label
    fn = registry().get(prep, prep_reflectance)
    return clean.impute_median(clean.inf_to_null(fn(df)))
