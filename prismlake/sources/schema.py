"""Schema handling: wide <-> array <-> long forms, target/feature resolution, alignment.

Column-label rules (wavelength parsing, target detection, prefixing) are
schema-level decisions made once on the driver from ``df.columns``; the data
movement they imply is plain ``select`` / ``posexplode`` / joins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Fixed values of the file convention: prefix of merged training columns and the
# accepted names of an "actual value" column in prediction uploads.
DATASET_PREFIX = "spectra_with_target_"
ACTUALS_ALIASES = ["actual", "actuals", "true", "y_true", "target", "measured", "observed", "reference"]


# ------------------------------------------------------------------ long/array

def spectrum_to_long(spectra: DataFrame, bands: DataFrame | None = None,
                     spectrum: str = "spectrum") -> DataFrame:
    """Array form -> (dataset, sample_id, band, [wavelength,] value, target).

    ``posexplode`` is a narrow operation; the band table is tiny and broadcast.
    """
    keep = [c for c in spectra.columns if c != spectrum]
    long = spectra.select(*keep, F.posexplode(spectrum).alias("band", "value"))
    long = long.withColumn("band", F.col("band").cast("int"))
    if bands is None:
        return long.select(*[c for c in keep if c != "target"], "band", "value",
                           *(["target"] if "target" in keep else []))
    out = long.join(bands.select("band", "wavelength"), "band")
    return out.select(*[c for c in keep if c != "target"], "band", "wavelength", "value",
                      *(["target"] if "target" in keep else []))


def long_to_spectrum(long: DataFrame, keys: tuple[str, ...] = ("dataset", "sample_id"),
                     carry: tuple[str, ...] = ("target",)) -> DataFrame:
    """Long form -> array form; one row per sample, bands in ascending order.

    The collect is per sample (bounded by the number of bands), never per dataset.
    """
    carry = tuple(c for c in carry if c in long.columns)
    agg = [F.transform(F.array_sort(F.collect_list(F.struct("band", "value"))), lambda s: s["value"]).alias("spectrum")]
    agg += [F.first(c).alias(c) for c in carry]
    return long.groupBy(*keys).agg(*agg)


def long_to_wide(long: DataFrame, bands: DataFrame | list[tuple[int, str]],
                 keys: tuple[str, ...] = ("dataset", "sample_id"), value: str = "value") -> DataFrame:
    """Long form -> one column per band, named by label; pivot values listed up front
    so Spark does not need a distinct pass to discover them."""
    pairs = bands if isinstance(bands, list) else [(r["band"], r["label"]) for r in bands.collect()]
    agg = [F.max(F.when(F.col("band") == b, F.col(value))).alias(lbl) for b, lbl in pairs]
    carry = [F.first("target").alias("target")] if "target" in long.columns else []
    return long.groupBy(*keys).agg(*agg, *carry)


def parse_wavelength(label: str) -> float | None:
    """Wavelength of a column label: last ``_`` token as a float, else digits and dots only."""
    token = label.rsplit("_", 1)[-1]
    try:
        return float(token)
    except ValueError:
        digits = re.sub(r"[^0-9.]", "", label)
        try:
            return float(digits) if digits else None
        except ValueError:
            return None


def columns_to_spectrum(wide: DataFrame, feature_cols: list[str] | None = None, target: str | None = "target",
                        keys: tuple[str, ...] = ("dataset", "sample_id")) -> tuple[DataFrame, list[tuple[int, float | None, str]]]:
    """Wide frame -> array form with bands ordered by parsed wavelength.

    Returns the spectra frame and the band table ``[(band, wavelength, label)]``.
    Labels whose wavelength does not parse keep their position after the parsed ones.
    """
    if feature_cols is None:
        feature_cols = [c for c in select_numeric_features(wide, target) if c not in keys]
    parsed = [(parse_wavelength(c), i, c) for i, c in enumerate(feature_cols)]
    ordered = sorted(parsed, key=lambda t: (t[0] is None, t[0] if t[0] is not None else 0.0, t[1]))
    spec = F.array(*[F.col(f"`{c}`").cast("double") for _, _, c in ordered]).alias("spectrum")
    cols = [F.col(k) for k in keys if k in wide.columns] + [spec]
    if target and target in wide.columns:
        cols.append(F.col(f"`{target}`").cast("double").alias("target"))
    band_table = [(i, wl, c) for i, (wl, _, c) in enumerate(ordered)]
    return wide.select(*cols), band_table


def bands_frame(spark: SparkSession, band_table: list[tuple[int, float | None, str]]) -> DataFrame:
    schema = "band INT, wavelength DOUBLE, label STRING"
    return spark.createDataFrame([(int(b), None if w is None else float(w), str(lbl)) for b, w, lbl in band_table], schema)


# ------------------------------------------------------------------ targets/features

def resolve_target(columns: list[str], given: str | None = None) -> str:
    """``target`` if present, else first ``*_target`` (case-insensitive), else ``given``."""
    if "target" in columns:
        return "target"
    for c in columns:
        if c.lower().endswith("_target"):
            return c
    if given and given in columns:
        return given
    raise ValueError(f"no target column among {columns[:10]}...")


def select_numeric_features(df: DataFrame, target: str | None) -> list[str]:
    feats = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name != target]
    if not feats:
        raise ValueError("No numeric spectral columns found (after excluding the target).")
    return feats


def scope_features_by_prefix(columns: list[str], dataset: str, target: str) -> list[str]:
    """Features of target ``Tn``: columns prefixed ``<DATASET_PREFIX>Tn_``; else all but target."""
    prefix = f"{DATASET_PREFIX}{dataset}_"
    scoped = [c for c in columns if c.startswith(prefix) and c != target and not c.lower().endswith("_target")]
    return scoped or [c for c in columns if c != target]


def prefix_columns(wide: DataFrame, stem: str, target: str = "target",
                   keys: tuple[str, ...] = ()) -> DataFrame:
    """Prefix every column with ``<stem>_``; already-prefixed columns are kept; the
    target becomes ``<stem>_target``."""
    out = []
    for c in wide.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == target:
            out.append(F.col(f"`{c}`").alias(f"{stem}_target"))
        elif c.startswith(stem + "_"):
            out.append(F.col(f"`{c}`"))
        else:
            out.append(F.col(f"`{c}`").alias(f"{stem}_{c}"))
    return wide.select(*out)


def concat_by_position(frames: dict[str, DataFrame], order_col: str = "sample_id") -> DataFrame:
    """Side-by-side merge of per-dataset frames on row position (missing side null).

    Position = ``row_number`` over ``order_col`` within each frame.  At scale the
    ordinal is computed with a range-partitioned sort; the merge is an equi-join on
    the ordinal (sort-merge, no broadcast of data-sized sides).
    """
    merged = None
    for stem, df in frames.items():
        pos = df.withColumn("_pos", F.row_number().over(Window.orderBy(order_col))).drop(order_col)
        merged = pos if merged is None else merged.join(pos, "_pos", "full_outer")
    return merged


# ------------------------------------------------------------------ alignment

def align_features(pred_long: DataFrame, trained_bands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare an upload's band labels with the trained ones.

    ``pred_long``: long form with a ``label`` column; ``trained_bands``: (band, label).
    Labels are normalised (digits-only labels and labels of another dataset map to the
    trained prefix by their wavelength token).  Returns (aligned long frame with the
    trained ``band`` index, missing bands, extra labels).
    """
    trained = trained_bands.withColumn("_wl", F.regexp_extract("label", r"([0-9.]+)$", 1))
    upload = pred_long.withColumn("_wl", F.regexp_extract("label", r"([0-9.]+)$", 1))
    labels = upload.select("label", "_wl").distinct()
    missing = trained.join(labels, "_wl", "left_anti").select("band", "label")
    extra = labels.join(trained, "_wl", "left_anti").select("label")
    aligned = upload.drop("label").join(trained.select("band", "_wl"), "_wl").drop("_wl")
    return aligned, missing, extra


def add_missing_as_zero(long: DataFrame, expected_bands: DataFrame,
                        keys: tuple[str, ...] = ("dataset", "sample_id")) -> DataFrame:
    """Every (sample, expected band) pair; absent values become 0.0."""
    samples = long.select(*keys).distinct()
    grid = samples.crossJoin(F.broadcast(expected_bands.select("band")))
    return (grid.join(long.select(*keys, "band", "value"), [*keys, "band"], "left")
            .withColumn("value", F.coalesce("value", F.lit(0.0))))


def detect_actuals_column(columns: list[str], model_key: str | None = None) -> str | None:
    """Which upload column holds actual values: ``<model_key>_target`` first, then any
    ``*_target``, then an alias, then ``<model_key>`` + alias."""
    lower = {c.lower(): c for c in columns}
    if model_key:
        for cand in (f"{model_key}_target", f"{DATASET_PREFIX}{model_key}_target"):
            if cand.lower() in lower:
                return lower[cand.lower()]
    for c in columns:
        if c.lower().endswith("_target"):
            return c
    for a in ACTUALS_ALIASES:
        if a in lower:
            return lower[a]
    if model_key:
        for a in ACTUALS_ALIASES:
            for cand in (f"{model_key}_{a}", f"{model_key}{a}"):
                if cand.lower() in lower:
                    return lower[cand.lower()]
    return None


def coerce_numeric(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Bad strings -> null (``try_cast``)."""
    return df.withColumn(out or column, F.col(column).try_cast("double"))
