"""Aggregation and profiling.

Column-wise statistics run on the long form ``(dataset, sample_id, band, value,
target)`` grouped by ``(dataset, band)``: partial aggregation on the map side, so
the shuffle carries one row per (map task, dataset, band).  Results are small
frames keyed by dataset [, band, region]; second-level statistics over bands
(CV percentiles, top-k bands) run on those small frames.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismlake.functions import arrays as A
from prismlake.functions.distributed import group_quantiles, top_k_per_group
from prismlake.functions.normal import norm_pdf
from prismlake.operators.kernel import sum_packed
from prismlake.operators.gram import Moments, correlation, gram_pass
from prismlake.sources.schema import spectrum_to_long

# Spectral regions (closed intervals, nm) of the exploratory profile
# and the soil absorption regions of the dataset analysis.
REGIONS = [("Visible (400-700nm)", 400.0, 700.0), ("NIR (700-1400nm)", 700.0, 1400.0),
           ("SWIR1 (1400-1900nm)", 1400.0, 1900.0), ("SWIR2 (1900-2500nm)", 1900.0, 2500.0)]
ABSORPTION_REGIONS = [("Iron_oxides_400-700", 400.0, 700.0), ("Water_1400-1500", 1400.0, 1500.0),
                      ("Water_1900-2000", 1900.0, 2000.0), ("Clay_minerals_2200-2250", 2200.0, 2250.0)]
# Correlation strength limits and outlook classes.
STRONG_R, MODERATE_R = 0.5, 0.3
OUTLOOK = [(0.7, "EXCELLENT (R² > 0.8 expected)"), (0.5, "VERY GOOD (R² 0.6-0.8 expected)"),
           (0.3, "MODERATE (R² 0.4-0.6 expected)")]
OUTLOOK_ELSE = "CHALLENGING (R² < 0.4, needs advanced techniques)"


def regions_frame(spark: SparkSession, regions=REGIONS) -> DataFrame:
    return spark.createDataFrame(regions, "region STRING, start DOUBLE, stop DOUBLE")


def to_long(spectra: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    return spectrum_to_long(spectra, bands)


# ----------------------------------------------------------------- per dataset

def dataset_summary(spectra: DataFrame, bands: DataFrame) -> DataFrame:
    wl = bands.agg(F.min("wavelength").alias("wl_min"), F.max("wavelength").alias("wl_max"))
    t = F.col("target")
    s = spectra.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max(F.size("spectrum")).alias("n_bands"),
        F.avg(t).alias("target_mean"), F.stddev_samp(t).alias("target_std"),
        F.min(t).alias("target_min"), F.max(t).alias("target_max"))
    return (s.crossJoin(F.broadcast(wl))
            .withColumn("target_range", F.col("target_max") - F.col("target_min"))
            .withColumn("target_cv", F.try_divide("target_std", "target_mean") * 100))


def target_shape(spectra: DataFrame) -> DataFrame:
    """Biased (moment) skewness and excess kurtosis of the target."""
    return spectra.groupBy("dataset").agg(F.skewness("target").alias("skewness"),
                                          F.kurtosis("target").alias("kurtosis"))


def target_skew_unbiased(spectra: DataFrame) -> DataFrame:
    n = F.count("target").cast("double")
    return spectra.groupBy("dataset").agg(
        F.try_divide(F.skewness("target") * F.sqrt(n * (n - 1)), n - 2).alias("skewness"))


def missing_profile(spectra: DataFrame) -> DataFrame:
    """Null count per column (bands, and the target as band -1), >0 only, most first, with the
    dataset's total beside it.  Bands are counted in place, without a row a value."""
    missing = F.transform("spectrum", lambda x: F.when(x.isNull() | F.isnan(x), 1).otherwise(0))
    marks = spectra.select("dataset", F.concat(F.array(F.when(F.col("target").isNull(), 1).otherwise(0)), missing).alias("m"))
    found = marks.select("dataset", F.posexplode("m").alias("at", "x")).where("x = 1").groupBy(
        "dataset", (F.col("at") - 1).alias("band")).agg(F.count(F.lit(1)).alias("n_missing"))
    total = found.groupBy("dataset").agg(F.sum("n_missing").alias("total_missing"))
    return found.join(total, "dataset").orderBy("dataset", F.desc("n_missing"), "band")


def duplicate_rows(spectra: DataFrame) -> DataFrame:
    """Rows identical in every data column (bands + target) beyond the first.  Rows are
    compared by a 256-bit digest of their values, so no array is a grouping key."""
    text = lambda x: F.coalesce((x + F.lit(0.0)).cast("string"), F.lit("null"))
    digest = F.sha2(F.concat_ws(",", F.array_join(F.transform("spectrum", text), ","), F.size("spectrum"), text(F.col("target"))), 256)
    g = spectra.select("dataset", digest.alias("digest")).groupBy("dataset", "digest").count()
    return g.groupBy("dataset").agg(F.sum(F.col("count") - 1).alias("duplicate_rows"))


def z_outlier_counts(spectra: DataFrame) -> DataFrame:
    st = spectra.groupBy("dataset").agg(F.avg("target").alias("_m"), F.stddev_pop("target").alias("_s"))
    z = F.abs(F.try_divide(F.col("target") - F.col("_m"), F.col("_s")))
    return (spectra.join(st, "dataset").groupBy("dataset").agg(
        F.count_if(z > 2).alias("outliers_2std"), F.count_if(z > 3).alias("outliers_3std"),
        F.count("target").alias("_n"))
        .withColumn("pct_2std", F.try_divide("outliers_2std", "_n") * 100)
        .withColumn("pct_3std", F.try_divide("outliers_3std", "_n") * 100).drop("_n"))


def box_stats(spectra: DataFrame) -> DataFrame:
    q = group_quantiles(spectra, ["dataset"], "target", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    t = F.col("target")
    agg = spectra.join(q, "dataset").groupBy("dataset", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(t >= lo, t)).alias("whisker_low"), F.max(F.when(t <= hi, t)).alias("whisker_high"),
        F.count_if((t < lo) | (t > hi)).alias("n_outliers"))
    return agg


def iqr_outliers(spectra: DataFrame) -> DataFrame:
    q = group_quantiles(spectra, ["dataset"], "target", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    t = F.col("target")
    return (spectra.join(q, "dataset").where((t < F.col("q1") - 1.5 * iqr) | (t > F.col("q3") + 1.5 * iqr))
            .select("dataset", "sample_id", "target"))


def histogram(values: DataFrame, value: str = "target", bins: int = 30, key: str = "dataset") -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed.  Empty bins included."""
    rng = values.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = (values.where(F.col(value).isNotNull()).join(rng, key)
              .withColumn("bin", F.when(width == 0, F.lit(0)).otherwise(b))
              .groupBy(key, "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select(key, "_lo", "_hi", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, [key, "bin"], "left")
            .select(key, "bin",
                    (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    F.try_divide(F.coalesce("count", F.lit(0)), F.col("_n") * (F.col("_hi") - F.col("_lo")) / bins).alias("density")))


def density_normal_overlay(spectra: DataFrame, points: int = 100) -> DataFrame:
    """Normal pdf (sample mean, sample std) at ``points`` evenly spaced target values."""
    st = spectra.groupBy("dataset").agg(F.avg("target").alias("mu"), F.stddev_samp("target").alias("sigma"),
                                        F.min("target").alias("_lo"), F.max("target").alias("_hi"))
    x = F.col("_lo") + F.col("k") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    return (st.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
            .select("dataset", "k", x.alias("x"), norm_pdf(x, F.col("mu"), F.col("sigma")).alias("pdf")))


def kde_curve(spectra: DataFrame, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE of the target with Scott's bandwidth on a grid from min-cut*bw to max+cut*bw.

    Each row contributes an array of ``gridsize`` kernel values, summed per dataset by
    ``posexplode`` + partial aggregation -- no join of rows with grid points.
    """
    st = spectra.groupBy("dataset").agg(
        F.count("target").alias("_n"), F.stddev_samp("target").alias("_sd"),
        F.min("target").alias("_lo"), F.max("target").alias("_hi"))
    st = st.withColumn("_bw", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    st = (st.withColumn("_a", F.col("_lo") - cut * F.col("_bw"))
          .withColumn("_step", (F.col("_hi") + cut * F.col("_bw") - F.col("_a")) / (gridsize - 1)))
    grid_idx = F.sequence(F.lit(0), F.lit(gridsize - 1))
    contrib = F.transform(grid_idx, lambda k: F.exp(-0.5 * F.pow(F.try_divide(F.col("_a") + k * F.col("_step") - F.col("target"), F.col("_bw")), 2)))
    rows = (spectra.where(F.col("target").isNotNull()).join(st, "dataset")
            .select("dataset", "_n", "_bw", "_a", "_step", F.posexplode(contrib).alias("k", "c")))
    return (rows.groupBy("dataset", "k").agg(F.sum("c").alias("_s"), F.first("_n").alias("_n"), F.first("_bw").alias("_bw"),
                                            F.first("_a").alias("_a"), F.first("_step").alias("_step"))
            .select("dataset", "k", (F.col("_a") + F.col("k") * F.col("_step")).alias("x"),
                    F.try_divide(F.col("_s"), F.col("_n") * F.col("_bw") * math.sqrt(2 * math.pi)).alias("density")))


# ----------------------------------------------------------------- per band

def band_stats(spectra: DataFrame) -> DataFrame:
    long = to_long(spectra.select("dataset", "sample_id", "spectrum"))
    v = F.col("value")
    return long.groupBy("dataset", "band").agg(
        F.avg(v).alias("mean"), F.var_samp(v).alias("var_samp"), F.var_pop(v).alias("var_pop"),
        F.stddev_samp(v).alias("std_samp"), F.stddev_pop(v).alias("std_pop"))


def describe_columns(spectra: DataFrame) -> DataFrame:
    long = to_long(spectra.select("dataset", "sample_id", "spectrum"))
    v = F.col("value")
    base = long.groupBy("dataset", "band").agg(F.count(v).alias("count"), F.avg(v).alias("mean"),
                                               F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = group_quantiles(long, ["dataset", "band"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, wide=spectra.select("dataset"))
    return base.join(q, ["dataset", "band"], "left")


def band_quartile_envelope(spectra: DataFrame, sample_rank: int = 1) -> DataFrame:
    """Per band quartiles plus the values of one chosen sample (the ``sample_rank``-th
    smallest sample_id of each dataset)."""
    long = to_long(spectra.select("dataset", "sample_id", "spectrum"))
    q = group_quantiles(long, ["dataset", "band"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, wide=spectra.select("dataset"))
    chosen = top_k_per_group(spectra.select("dataset", "sample_id", "spectrum"), ["dataset"], [F.col("sample_id")],
                             sample_rank).where(F.col("rank") == sample_rank)
    sample = to_long(chosen.select("dataset", "sample_id", "spectrum")).select(
        "dataset", "band", F.col("sample_id").alias("chosen_sample"), F.col("value").alias("sample_value"))
    return q.join(sample, ["dataset", "band"], "left")


def band_cv(spectra: DataFrame) -> DataFrame:
    st = band_stats(spectra)
    return st.select("dataset", "band", (F.try_divide("std_samp", "mean") * 100).alias("cv"))


def band_cv_high(spectra: DataFrame, quantile: float = 0.9) -> DataFrame:
    cv = band_cv(spectra)
    thr = cv.groupBy("dataset").agg(F.percentile("cv", F.lit(quantile)).alias("threshold"))   # groups = #bands
    return cv.join(thr, "dataset").where(F.col("cv") > F.col("threshold"))


def band_cv_top_bottom(spectra: DataFrame, k: int = 5) -> DataFrame:
    cv = band_cv(spectra)
    top = top_k_per_group(cv, ["dataset"], [F.desc("cv"), F.col("band")], k, salt_buckets=1).withColumn("side", F.lit("most"))
    bottom = top_k_per_group(cv, ["dataset"], [F.asc("cv"), F.col("band")], k, salt_buckets=1).withColumn("side", F.lit("least"))
    return top.unionByName(bottom)


def _with_regions(per_band: DataFrame, bands: DataFrame, regions: DataFrame) -> DataFrame:
    """Range join of band wavelength into closed region intervals (a band on an edge
    belongs to both regions).  The region table is a fixed handful of rows."""
    b = per_band.join(bands.select("band", "wavelength"), "band")
    return b.join(F.broadcast(regions), (F.col("wavelength") >= F.col("start")) & (F.col("wavelength") <= F.col("stop")))


def region_stats(spectra: DataFrame, bands: DataFrame) -> DataFrame:
    st = band_stats(spectra)
    r = _with_regions(st, bands, regions_frame(spectra.sparkSession))
    return r.groupBy("dataset", "region").agg(F.count(F.lit(1)).alias("n_bands"), F.avg("mean").alias("mean_reflectance"),
                                               F.stddev_samp("mean").alias("std_reflectance"))


def absorption_minima(spectra: DataFrame, bands: DataFrame) -> DataFrame:
    st = band_stats(spectra)
    r = _with_regions(st, bands, regions_frame(spectra.sparkSession, ABSORPTION_REGIONS))
    return r.groupBy("dataset", "region").agg(F.min("mean").alias("min_reflectance"))


def reflectance_extent(spectra: DataFrame) -> DataFrame:
    st = band_stats(spectra)
    ext = to_long(spectra.select("dataset", "sample_id", "spectrum")).groupBy("dataset").agg(
        F.min("value").alias("refl_min"), F.max("value").alias("refl_max"))
    means = st.groupBy("dataset").agg(F.avg("mean").alias("mean_of_means"), F.avg("std_samp").alias("mean_of_stds"))
    return (ext.join(means, "dataset")
            .withColumn("refl_range", F.col("refl_max") - F.col("refl_min"))
            .withColumn("refl_cv", F.try_divide("mean_of_stds", "mean_of_means") * 100))


def spectral_resolution(bands: DataFrame) -> DataFrame:
    w = Window.orderBy("band")      # the band table: one row per band
    return (bands.withColumn("gap", F.col("wavelength") - F.lag("wavelength").over(w))
            .agg(F.avg("gap").alias("mean_gap"), F.count(F.lit(1)).alias("n_bands"),
                 F.min("wavelength").alias("wl_min"), F.max("wavelength").alias("wl_max")))


# ----------------------------------------------------------------- correlation

def band_target_corr(spectra: DataFrame) -> DataFrame:
    """Pearson r of every band with the target; null r dropped."""
    long = to_long(spectra)
    return (long.groupBy("dataset", "band").agg(F.corr("value", "target").alias("r"))
            .where(F.col("r").isNotNull() & ~F.isnan("r"))
            .withColumn("abs_r", F.abs("r")))


def corr_strength_counts(spectra: DataFrame) -> DataFrame:
    c = band_target_corr(spectra)
    a, r = F.col("abs_r"), F.col("r")
    return c.groupBy("dataset").agg(
        F.count_if(a > STRONG_R).alias("n_strong"),
        F.count_if((a >= MODERATE_R) & (a <= STRONG_R)).alias("n_moderate"),
        F.count_if(a > MODERATE_R).alias("n_above_03"),
        F.count_if(r > MODERATE_R).alias("n_pos_03"), F.count_if(r < -MODERATE_R).alias("n_neg_03"),
        F.max(a).alias("max_abs_r"), F.avg(a).alias("mean_abs_r"), F.percentile(a, F.lit(0.5)).alias("median_abs_r"),
        F.max_by("band", "r").alias("band_max_r"), F.min_by("band", "r").alias("band_min_r"))


def top_k_corr_bands(spectra: DataFrame, k: int = 15, by_abs: bool = True) -> DataFrame:
    c = band_target_corr(spectra)
    order = [F.desc("abs_r" if by_abs else "r"), F.col("band")]
    return top_k_per_group(c, ["dataset"], order, k, salt_buckets=1)


def select_top_k_features(spectra: DataFrame, k: int = 15) -> DataFrame:
    """Spectrum reduced to the top-k |r| bands (ascending band order) + ``bands``."""
    top = top_k_corr_bands(spectra, k).groupBy("dataset").agg(F.array_sort(F.collect_list("band")).alias("bands"))
    return (spectra.join(top, "dataset")
            .withColumn("spectrum", A.gather("spectrum", "bands")))


def region_corr(spectra: DataFrame, bands: DataFrame) -> DataFrame:
    c = band_target_corr(spectra)
    r = _with_regions(c, bands, regions_frame(spectra.sparkSession))
    return r.groupBy("dataset", "region").agg(F.avg("abs_r").alias("mean_abs_r"))


def prep_corr_compare(variants: DataFrame) -> DataFrame:
    """variants: spectra with a ``preprocessing`` column."""
    long = to_long(variants.select("dataset", "preprocessing", "sample_id", "spectrum", "target"))
    c = (long.groupBy("dataset", "preprocessing", "band").agg(F.abs(F.corr("value", "target")).alias("abs_r"))
         .where(F.col("abs_r").isNotNull() & ~F.isnan("abs_r")))
    return c.groupBy("dataset", "preprocessing").agg(F.avg("abs_r").alias("mean_abs_r"), F.max("abs_r").alias("max_abs_r"))


def dataset_moments(spectra: DataFrame, with_target: bool = True) -> dict:
    """dataset -> Moments of [bands, target] from one distributed Gram pass."""
    g = gram_pass(spectra, ["dataset"], "spectrum", "target" if with_target else None).collect()
    return {r["dataset"]: Moments.from_packed(r["g"], r["p"] + (1 if with_target else 0)) for r in g}


TILE = 128                 # bands of a side of a correlation tile


def corr_matrix(spectra: DataFrame, tile: int = TILE) -> DataFrame:
    """Band x band correlation per dataset, long form (dataset, i, j, r), from tiles of sums
    and products keyed by (dataset, band block, band block): no task and not the driver
    holds a whole matrix.  Rows with a missing value are left out; r is null (not a number)
    where a band does not vary."""
    def partial(batches):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            whole = np.array([v is not None and not np.isnan(np.asarray(v, dtype=float)).any() for v in pdf["spectrum"]], bool)
            for ds, part in pdf[whole].groupby("dataset", sort=False):
                x = np.stack([np.asarray(v, dtype=float) for v in part["spectrum"]])
                blocks = [x[:, k:k + tile] for k in range(0, x.shape[1], tile)]
                for i, a in enumerate(blocks):
                    for j, b in enumerate(blocks[i:], i):
                        packed = np.concatenate([[len(x), a.shape[1], b.shape[1]], a.sum(0), b.sum(0), (a * a).sum(0), (b * b).sum(0), (a.T @ b).ravel()])
                        if (ds, i, j) in acc:
                            packed[1:3] = 0                                     # widths are no sums
                        acc[ds, i, j] = acc.get((ds, i, j), 0) + packed
        if acc:
            # the last number counts the parts that are added up, by which the widths are divided
            yield pd.DataFrame([(*key, np.append(g, 1.0).tobytes()) for key, g in acc.items()], columns=["dataset", "ib", "jb", "g"])

    def unpack(batches):
        for pdf in batches:
            for ds, ib, jb, g in zip(pdf["dataset"], pdf["ib"], pdf["jb"], pdf["g"]):
                g = np.frombuffer(g, float)
                n, parts = g[0], g[-1]
                a, b = int(round(g[1] / parts)), int(round(g[2] / parts))
                sa, sb, qa, qb = (g[3 + lo:3 + hi] for lo, hi in ((0, a), (a, a + b), (a + b, 2 * a + b), (2 * a + b, 2 * (a + b))))
                cov = g[3 + 2 * (a + b):-1].reshape(a, b) - np.outer(sa, sb) / n
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = cov / np.sqrt(np.outer(qa - sa * sa / n, qb - sb * sb / n))
                i, j = (v.ravel() for v in np.meshgrid(np.arange(a) + ib * tile, np.arange(b) + jb * tile, indexing="ij"))
                yield pd.DataFrame({"dataset": ds, "i": i, "j": j, "r": r.ravel()})
                if ib != jb:
                    yield pd.DataFrame({"dataset": ds, "i": j, "j": i, "r": r.ravel()})

    parts = spectra.select("dataset", "spectrum").mapInPandas(partial, "dataset STRING, ib INT, jb INT, g BINARY")
    tiles = sum_packed(parts, ["dataset", "ib", "jb"])
    return tiles.mapInPandas(unpack, "dataset STRING, i INT, j INT, r DOUBLE")


def corr_first(spectra: DataFrame, bands: int = 40) -> DataFrame:
    """Correlations of the first bands."""
    return corr_matrix(spectra.withColumn("spectrum", F.slice("spectrum", 1, bands)))


def corr_around_target(spectra: DataFrame, top: int = 20) -> DataFrame:
    """Correlations among the bands with the ``top`` largest and smallest correlations with the
    target, and the target itself (band -1)."""
    corr = band_target_corr(spectra)
    rank = lambda order: F.row_number().over(Window.partitionBy("dataset").orderBy(order, "band"))
    ends = corr.withColumn("_a", rank(F.desc("r"))).withColumn("_b", rank(F.asc("r"))).where((F.col("_a") <= top) | (F.col("_b") <= top))
    chosen = ends.groupBy("dataset").agg(F.sort_array(F.collect_list(F.col("band").cast("int"))).alias("bands"))     # at most 2 * top
    rows = spectra.where("target is not null").join(chosen, "dataset").select("dataset", F.concat(
        F.transform("bands", lambda b: F.get("spectrum", b)), F.array("target")).alias("spectrum"))
    name = lambda c: F.coalesce(F.get("bands", F.col(c)), F.lit(-1)).alias(c)
    return corr_matrix(rows).join(chosen, "dataset").select("dataset", name("i"), name("j"), "r")


def pca(spectra: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """PCA of standardized bands per dataset from the Gram-derived correlation matrix.

    Returns (scores (dataset, sample_id, pc1..pck), explained (dataset, component,
    explained_pct, cumulative_pct)).  Sign convention: the largest |loading| of each
    component is positive.
    """
    spark = spectra.sparkSession
    load_rows, expl_rows = [], []
    for ds, m in dataset_moments(spectra, with_target=False).items():
        r = correlation(m)
        vals, vecs = np.linalg.eigh(r)
        order = np.argsort(vals)[::-1]
        vals, vecs = vals[order], vecs[:, order]
        for c in range(vecs.shape[1]):
            if vecs[np.argmax(np.abs(vecs[:, c])), c] < 0:
                vecs[:, c] = -vecs[:, c]
        sd = np.sqrt(np.diag(m.cov_ss) / m.n)          # population std, as StandardScaler
        sd[sd == 0] = 1.0
        cum = np.cumsum(vals) / vals.sum() * 100
        for c in range(len(vals)):
            expl_rows.append((ds, c + 1, float(vals[c] / vals.sum() * 100), float(cum[c])))
        for c in range(k):
            load_rows.append((ds, c + 1, (vecs[:, c] / sd).tolist(), float(-(m.mean / sd) @ vecs[:, c])))
    loads = spark.createDataFrame(load_rows, "dataset STRING, component INT, w ARRAY<DOUBLE>, b DOUBLE")
    scores = (spectra.select("dataset", "sample_id", "spectrum").join(loads, "dataset")
              .withColumn("score", A.arr_dot("spectrum", "w") + F.col("b"))
              .groupBy("dataset", "sample_id").pivot("component", list(range(1, k + 1))).agg(F.first("score")))
    scores = scores.select("dataset", "sample_id", *[F.col(str(c)).alias(f"pc{c}") for c in range(1, k + 1)])
    return scores, spark.createDataFrame(expl_rows, "dataset STRING, component INT, explained_pct DOUBLE, cumulative_pct DOUBLE")


def linear_fit(spectra: DataFrame, points: int = 120) -> DataFrame:
    """Target on the best |r| band: slope, intercept and a ``points``-point fitted line."""
    best = top_k_corr_bands(spectra, 1).select("dataset", F.col("band").alias("best_band"))
    long = to_long(spectra).join(best, "dataset").where(F.col("band") == F.col("best_band"))
    fit = long.groupBy("dataset", "best_band").agg(
        F.regr_slope("target", "value").alias("slope"), F.regr_intercept("target", "value").alias("intercept"),
        F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    x = F.col("_lo") + F.col("k") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    return (fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
            .select("dataset", "best_band", "slope", "intercept", "k", x.alias("x"),
                    (F.col("intercept") + F.col("slope") * x).alias("y_fit")))


# ----------------------------------------------------------------- rules

def quality_warnings(spectra: DataFrame) -> DataFrame:
    st = spectra.groupBy("dataset").agg(F.avg("target").alias("_m"), F.stddev_samp("target").alias("_s"))
    mx = band_target_corr(spectra).groupBy("dataset").agg(F.max("abs_r").alias("max_abs_r"))
    return (st.join(mx, "dataset")
            .select("dataset", (F.col("_s") < 0.1 * F.col("_m")).alias("low_variance_target"),
                    (F.col("max_abs_r") < 0.2).alias("weak_relation")))


def performance_outlook(max_abs_r):
    expr = F.lit(OUTLOOK_ELSE)
    for limit, label in reversed(OUTLOOK):
        expr = F.when(max_abs_r > limit, F.lit(label)).otherwise(expr)
    return expr


# Preprocessing recommendation texts, in rule order.
REC_LOG = "Log transformation for target (high dynamic range)"
REC_NORM = "Normalization to [0,1] range"
REC_OUTLIER = "Robust outlier removal (Z-score < 2)"
REC_FEATURES = "Advanced feature engineering (derivatives, ratios)"
REC_ABSORBANCE = "Absorbance transformation (log(1/R))"
REC_CONTINUUM = "Continuum removal for mineral identification"
REC_SG = "Savitzky-Golay smoothing for noise reduction"
REC_DERIV = "First/Second derivatives for band enhancement"


def dataset_comparison(spectra: DataFrame) -> DataFrame:
    """One row per dataset: summary, shape, outliers, correlation, outlook, recommendations."""
    t = F.col("target")
    n = F.count(t).cast("double")
    base = spectra.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max(F.size("spectrum")).alias("n_features"),
        F.avg(t).alias("target_mean"), F.stddev_samp(t).alias("target_std"),
        (F.max(t) - F.min(t)).alias("target_range"), (F.try_divide(F.stddev_samp(t), F.avg(t)) * 100).alias("target_cv"),
        F.skewness(t).alias("target_skewness"), F.try_divide(F.max(t), F.min(t)).alias("_dyn"))
    ext = reflectance_extent(spectra).select("dataset", "refl_range", "refl_max", "mean_of_means")
    outl = z_outlier_counts(spectra).select("dataset", "outliers_2std", "outliers_3std")
    corr = band_target_corr(spectra).groupBy("dataset").agg(F.max("abs_r").alias("max_correlation"),
                                                             F.avg("abs_r").alias("mean_correlation"))
    df = base.join(ext, "dataset").join(outl, "dataset").join(corr, "dataset", "left")
    recs = F.array(
        F.when(F.col("_dyn") > 10, F.lit(REC_LOG)),
        F.when(F.col("refl_max") > 1.0, F.lit(REC_NORM)),
        F.when(F.col("outliers_2std") > F.col("n_samples") * 0.05, F.lit(REC_OUTLIER)),
        F.when(F.col("mean_correlation") < 0.3, F.lit(REC_FEATURES)),
        F.when(F.col("mean_of_means") < 0.1, F.lit(REC_ABSORBANCE)).otherwise(F.lit(REC_CONTINUUM)),
        F.lit(REC_SG), F.lit(REC_DERIV))
    return (df.withColumn("performance_outlook", performance_outlook(F.col("max_correlation")))
            .withColumn("recommendations", F.filter(recs, lambda x: x.isNotNull()))
            .drop("_dyn", "refl_max", "mean_of_means"))


def qq_points(spectra: DataFrame) -> DataFrame:
    """Normal probability plot: ordered targets against normal quantiles of Filliben's
    order-statistic medians, with the least-squares line and its r."""
    from prismlake.functions.distributed import with_ordinal
    from prismlake.functions.normal import norm_ppf
    t = spectra.where(F.col("target").isNotNull()).select("dataset", "sample_id", "target")
    ranked = with_ordinal(t, ["target", "sample_id"], group="dataset", name="i")
    n = ranked.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    nn = F.col("n").cast("double")
    last = F.pow(F.lit(0.5), 1 / nn)
    m = (F.when(F.col("i") == F.col("n"), last).when(F.col("i") == 1, 1 - last)
         .otherwise((F.col("i") - 0.3175) / (nn + 0.365)))
    pts = ranked.join(n, "dataset").select("dataset", "i", norm_ppf(m).alias("theoretical"), F.col("target").alias("ordered"))
    fit = pts.groupBy("dataset").agg(F.regr_slope("ordered", "theoretical").alias("slope"),
                                     F.regr_intercept("ordered", "theoretical").alias("intercept"),
                                     F.corr("ordered", "theoretical").alias("r"))
    return pts.join(fit, "dataset")
