"""Projections, filters and cleaning on array-form spectra.

Per-band statistics (median, mean, std) are aggregated by ``(dataset, band)``
with map-side partial aggregation, gathered into one small array per dataset and
joined back; AQE broadcasts that small side after measuring it.  Nothing here
uses a window over a whole dataset.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions import arrays as A
from prismlake.functions.distributed import _bucket_of, group_quantiles, top_k_per_group, with_ordinal
from prismlake.sources.schema import spectrum_to_long

# Fixed values of the reference behaviour.
ZERO_EPS = 1e-6          # replacement for zero reflectance before a log
PRED_FLOOR = 0.001       # predictions are floored here
Z_LIMIT = 2.0            # |z| limit of the target outlier rule
Z_SHARE = 0.05           # ... applied only when more than this share exceeds it
FILL_VALUES = 1 << 21    # values of a chunk of the neighbour fill


def _per_dataset_band_array(stats: DataFrame, col: str, name: str) -> DataFrame:
    """(dataset, band, col) -> (dataset, name ARRAY ordered by band). Bounded by #bands."""
    return stats.groupBy("dataset").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("band", col))), lambda s: s[col]).alias(name))


def drop_null_target(df: DataFrame) -> DataFrame:
    return df.where(F.col("target").isNotNull() & ~F.isnan("target"))


def mask_valid_rows(df: DataFrame) -> DataFrame:
    """Rows with no missing band (null or NaN) and a present target."""
    return drop_null_target(df).where(~A.arr_has_missing("spectrum"))


def inf_to_null(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """+-inf and NaN -> null, in one projection."""
    inf = float("inf")
    return df.withColumn(spectrum, F.transform(spectrum, lambda x: F.when(
        x.isNull() | F.isnan(x) | (x == F.lit(inf)) | (x == F.lit(-inf)), F.lit(None).cast("double")).otherwise(x)))


def zero_to_eps(df: DataFrame, eps: float = ZERO_EPS, spectrum: str = "spectrum") -> DataFrame:
    return df.withColumn(spectrum, F.transform(spectrum, lambda x: F.when(x == 0, F.lit(eps)).otherwise(x)))


def band_stat_arrays(df: DataFrame, how: str, spectrum: str = "spectrum") -> DataFrame:
    """(dataset, stat ARRAY) of a per-band statistic: 'median', 'mean', 'std_pop'."""
    long = spectrum_to_long(df.select("dataset", "sample_id", spectrum).withColumnRenamed(spectrum, "spectrum"))
    if how == "median":
        stats = group_quantiles(long, ["dataset", "band"], "value", {"stat": 0.5}, wide=df.select("dataset"))
    elif how == "mean":
        stats = long.groupBy("dataset", "band").agg(F.avg("value").alias("stat"))
    elif how == "std_pop":
        stats = long.groupBy("dataset", "band").agg(F.stddev_pop("value").alias("stat"))
    else:
        raise ValueError(how)
    # bands with no value at all keep a null statistic
    all_bands = long.select("dataset", "band").distinct()
    stats = all_bands.join(stats, ["dataset", "band"], "left")
    return _per_dataset_band_array(stats, "stat", "stat")


def fill_from_band_stat(df: DataFrame, stat: DataFrame, spectrum: str = "spectrum",
                        when=None) -> DataFrame:
    """Replace elements (null by default) with the dataset's per-band statistic."""
    cond = when or (lambda x: x.isNull())
    joined = df.join(stat, "dataset", "left")
    filled = F.transform(spectrum, lambda x, i: F.when(cond(x), F.element_at(F.col("stat"), i + 1)).otherwise(x))
    return joined.withColumn(spectrum, filled).drop("stat")


def impute_median(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """null (and NaN) -> band median (linear interpolation between middle values)."""
    clean = df.withColumn(spectrum, F.transform(spectrum, lambda x: F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)))
    return fill_from_band_stat(clean, band_stat_arrays(clean, "median", spectrum), spectrum)


def impute_mean(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    clean = df.withColumn(spectrum, F.transform(spectrum, lambda x: F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)))
    return fill_from_band_stat(clean, band_stat_arrays(clean, "mean", spectrum), spectrum)


def zero_to_mean(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """Zeros (and missing values) -> band mean, the mean being taken *before* zeros
    are removed."""
    return fill_from_band_stat(df, band_stat_arrays(df, "mean", spectrum), spectrum,
                               when=lambda x: (x == 0) | x.isNull())


def _fill_chunk(rows: DataFrame, chunk_span: int | None) -> Column:
    """Number of a row's ``sample_id`` chunk: ranges of ``chunk_span`` ids, or ranges between
    quantiles that hold about ``FILL_VALUES`` values."""
    if chunk_span is not None:
        return F.floor(F.col("sample_id") / chunk_span)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("spectrum"))).first()
    chunks = min(1 << 15, -(-n * (width or 0) // FILL_VALUES))
    if chunks <= 1:
        return F.lit(0)
    value = F.col("sample_id").cast("double")
    marks = rows.agg(F.percentile_approx(value, [k / chunks for k in range(1, chunks)], F.lit(10 * chunks))).first()[0]
    return _bucket_of(value, sorted(set(marks)))


def _fill_rows(rows: pa.Table, carry: pa.Table) -> pa.Table:
    """The rows of one chunk, filled; ``carry`` has a band's values from outside the chunk."""
    rows = rows.take(pc.sort_indices(rows["sample_id"])).drop_columns("_chunk").combine_chunks()
    spectra = pa.concat_arrays(rows["spectrum"].chunks)
    size, flat, n = pc.list_value_length(spectra).to_numpy(), spectra.flatten(), len(rows)
    row = np.repeat(np.arange(1, n + 1), size)
    band = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    value, known = np.zeros((n + 2, size.max())), np.zeros((n + 2, size.max()), bool)
    value[row, band] = flat.to_numpy(zero_copy_only=False)
    known[row, band] = flat.is_valid().to_numpy(zero_copy_only=False) & (value[row, band] != 0)
    for name, end in (("carry_ff", 0), ("carry_bf", n + 1)):          # as rows before and after the chunk's
        at = carry["band"].to_numpy()
        value[end, at] = carry[name].to_numpy()
        known[end, at] = carry[name].is_valid().to_numpy()
    number = np.arange(n + 2)[:, None]
    before = np.maximum.accumulate(np.where(known, number, -1), 0)
    after = np.minimum.accumulate(np.where(known, number, n + 2)[::-1], 0)[::-1]
    source = np.where(before >= 0, before, after)[row, band]
    filled = pa.array(value[np.minimum(source, n + 1), band], flat.type, mask=source > n + 1, from_pandas=False)
    offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32())
    return rows.set_column(rows.schema.get_field_index("spectrum"), "spectrum", pa.ListArray.from_arrays(offsets, filled))


def zero_fill_neighbors(df: DataFrame, chunk_span: int | None = None) -> DataFrame:
    """0 -> null, then forward-fill, then back-fill down the rows of each band
    (rows ordered by ``sample_id``), per dataset.

    To keep a hot dataset from landing in one task, samples are cut into ``sample_id``
    chunks: fills run inside a chunk, all bands at once and in time that grows with its
    rows, and a tiny table by band and chunk carries the last / first non-null value
    across chunk borders.  Rows without a spectrum, a dataset or an id drop out.
    """
    rows = df.where(F.col("dataset").isNotNull() & F.col("sample_id").isNotNull() & (F.size("spectrum") > 0))
    rows = rows.select("dataset", "sample_id", "spectrum", *[c for c in df.columns if c not in ("dataset", "sample_id", "spectrum")])
    schema = rows.schema
    rows = rows.withColumn("_chunk", _fill_chunk(rows, chunk_span))
    long = rows.select(F.col("dataset").alias("_set"), F.col("_chunk").alias("_part"), "sample_id", F.posexplode("spectrum").alias("band", "value"))
    at = F.when(F.col("value").isNotNull() & (F.col("value") != 0), F.col("sample_id"))      # a chunk without a value still gets what is carried over it
    edges = long.groupBy("_set", "band", "_part").agg(F.max_by("value", at).alias("last_v"), F.min_by("value", at).alias("first_v"))
    others = Window.partitionBy("_set", "band").rowsBetween(Window.unboundedPreceding, -1)      # frames that end at a row grow; others start anew a row
    carry = edges.select("_set", "_part", "band", F.last("last_v", ignorenulls=True).over(others.orderBy("_part")).alias("carry_ff"),
                         F.last("first_v", ignorenulls=True).over(others.orderBy(F.desc("_part"))).alias("carry_bf"))
    return rows.groupBy("dataset", "_chunk").cogroup(carry.groupBy("_set", "_part")).applyInArrow(_fill_rows, schema)


def drop_constant_bands(df: DataFrame) -> DataFrame:
    """Remove bands whose population std is 0 within the dataset.  Adds ``bands``:
    the kept original band indices, so later steps keep wavelength alignment."""
    std = spectrum_to_long(df.select("dataset", "sample_id", "spectrum")).groupBy("dataset", "band").agg(
        F.stddev_pop("value").alias("sd"))
    keep = std.where(F.col("sd") > 0).groupBy("dataset").agg(F.array_sort(F.collect_list("band")).alias("bands"))
    return (df.join(keep, "dataset")
            .withColumn("spectrum", F.transform("bands", lambda b: F.element_at("spectrum", b + 1))))


def near_constant_bands(df: DataFrame, threshold: float = 0.001) -> DataFrame:
    """(dataset, band, std_samp, near_constant): sample std below ``threshold``."""
    return (spectrum_to_long(df.select("dataset", "sample_id", "spectrum"))
            .groupBy("dataset", "band").agg(F.stddev_samp("value").alias("std_samp"))
            .withColumn("near_constant", F.col("std_samp") < threshold))


def clip_lower(df: DataFrame, col: str = "y_pred", floor: float = PRED_FLOOR) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col).isNull(), None).otherwise(F.greatest(F.col(col), F.lit(floor))))


def deterministic_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "sample_id",
                         group: str = "dataset") -> DataFrame:
    """n rows per group chosen by the md5 of (id, seed): stable across engines and runs."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return top_k_per_group(df.withColumn("_h", h), [group], [F.col("_h"), F.col(id_col)], n,
                           salt_col=F.pmod(F.xxhash64(F.col(id_col)), F.lit(64))).drop("_h", "rank")


def preview_head(df: DataFrame, n: int, id_col: str = "sample_id", group: str = "dataset") -> DataFrame:
    return top_k_per_group(df, [group], [F.col(id_col)], n,
                           salt_col=F.pmod(F.xxhash64(F.col(id_col)), F.lit(64))).drop("rank")


def filter_z_outliers(df: DataFrame, z: float = Z_LIMIT, share: float = Z_SHARE) -> DataFrame:
    """Drop rows with |z(target)| > z in datasets where more than ``share`` of rows exceed it."""
    stats = df.groupBy("dataset").agg(F.avg("target").alias("_m"), F.stddev_pop("target").alias("_s"),
                                      F.count("target").alias("_n"))
    zed = F.abs(F.try_divide(F.col("target") - F.col("_m"), F.col("_s")))
    flagged = df.join(stats, "dataset").withColumn("_out", F.coalesce(zed > z, F.lit(False)))
    share_tbl = flagged.groupBy("dataset").agg((F.sum(F.col("_out").cast("long")) / F.first("_n")).alias("_share"))
    return (flagged.join(share_tbl, "dataset")
            .where(~(F.col("_out") & (F.col("_share") > share)))
            .drop("_m", "_s", "_n", "_out", "_share"))


def concat_positions(frames: dict[str, DataFrame]) -> DataFrame:
    """Helper for positional merge: add ``_pos`` per frame by ``sample_id``."""
    return {k: with_ordinal(v, ["sample_id"]) for k, v in frames.items()}
