"""Model bundles: a fitted linear model with all it needs to score an upload.

A bundle is a folder of Parquet tables, one ``version=N`` below it for each write:

* ``model``: (dataset, preprocessing, model, params, intercept, coef),
* ``bands``: (band, wavelength), the order of the coefficients,
* ``state``: (dataset, raw_median, mean_spectrum, median), what the preprocessing has learned
  from the training rows - medians of the raw bands, their mean spectrum, and medians of the
  transformed bands,
* ``run_log``: (dataset, line), where given.

Scoring goes the way the training rows went, with the stored state instead of statistics of
the upload: align columns by wavelength (missing ones are an error, others are left out),
missing and infinite values to raw medians, transform, missing values to medians, dot
product, floor.  So a row's prediction does not depend on the rows it is uploaded with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.operators import clean, predict
from prismlake.operators import transforms as tr

# The transforms a bundle can hold; those with a mean spectrum take the stored one.
PREPS = {
    "none": lambda df, mean: df,
    "Reflectance": lambda df, mean: df,
    "Absorbance": lambda df, mean: tr._set(clean.zero_to_eps(df), F.transform("spectrum", tr._neg_log10)),
    "snv": lambda df, mean: tr.prep_snv(df),
    "sg_smooth": lambda df, mean: tr.prep_sg_smooth(df),
    "sg_deriv1": lambda df, mean: tr.prep_sg_deriv1(df),
    "sg_deriv2": lambda df, mean: tr.prep_sg_deriv2(df),
    "snv_deriv1": lambda df, mean: tr.prep_sg_deriv1(tr.prep_snv(df)),
    "msc": lambda df, mean: tr.prep_msc(df, mean),
    "msc_deriv1": lambda df, mean: tr.prep_sg_deriv1(tr.prep_msc(df, mean)),
}
ZEROS_ARE_MISSING = ("Reflectance",)


@dataclass
class Bundle:
    version: int
    model: DataFrame
    bands: DataFrame
    state: DataFrame
    run_log: DataFrame | None


def _raw_filled(df: DataFrame, prep: str, raw_median: DataFrame) -> DataFrame:
    """Missing and infinite values (and zeros, where the transform says so) to raw medians."""
    missing = (lambda x: x.isNull() | (x == 0)) if prep in ZEROS_ARE_MISSING else (lambda x: x.isNull())
    return clean.fill_from_band_stat(clean.inf_to_null(df), raw_median, when=missing)


def _part(state: DataFrame, name: str) -> DataFrame:
    return state.select("dataset", F.col(name).alias("stat"))


def transformed(df: DataFrame, prep: str, state: DataFrame) -> DataFrame:
    """Rows as the model sees them."""
    out = PREPS[prep](_raw_filled(df, prep, _part(state, "raw_median")), _part(state, "mean_spectrum"))
    return clean.fill_from_band_stat(clean.inf_to_null(out), _part(state, "median"))


def learn_state(spectra: DataFrame, prep: str) -> DataFrame:
    """What ``transformed`` needs, from the training rows."""
    raw = clean.inf_to_null(spectra)
    known = raw.withColumn("spectrum", F.transform("spectrum", lambda x: F.when(x != 0, x))) if prep in ZEROS_ARE_MISSING else raw
    raw_median = clean.band_stat_arrays(known, "median")
    filled = _raw_filled(spectra, prep, raw_median)
    mean = clean.band_stat_arrays(filled, "mean")
    after = clean.band_stat_arrays(clean.inf_to_null(PREPS[prep](filled, mean)), "median")
    named = lambda df, name: df.withColumnRenamed("stat", name)
    return named(raw_median, "raw_median").join(named(mean, "mean_spectrum"), "dataset").join(named(after, "median"), "dataset")


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[8:]) for n in names if re.fullmatch(r"version=[0-9]+", n))


def write_model_bundle(root: str, spectra: DataFrame, bands: DataFrame, prep: str, model: str = "pls", params: str | None = None,
                       run_log: DataFrame | None = None) -> int:
    """Fit on ``spectra`` (dataset, sample_id, spectrum, target) and write the next version."""
    if prep not in PREPS:
        raise ValueError(f"a bundle cannot hold {prep}; it can hold {', '.join(PREPS)}")
    spark = spectra.sparkSession
    version = max(_versions(spark, root), default=0) + 1
    folder = f"{root}/version={version}"
    learn_state(spectra, prep).write.parquet(f"{folder}/state")
    bands.select("band", "wavelength").write.parquet(f"{folder}/bands")
    if run_log is not None:
        run_log.write.parquet(f"{folder}/run_log")
    rows = transformed(spectra, prep, spark.read.parquet(f"{folder}/state"))
    fit = predict.fit_linear(rows, model, params).withColumn("preprocessing", F.lit(prep))
    # written last: a version without a model is not complete, and is not loaded
    fit.select("dataset", "preprocessing", "model", "params", "intercept", "coef").write.parquet(f"{folder}/model")
    return version


def load_model_bundle(spark: SparkSession, root: str, version: int | None = None) -> Bundle:
    """A version of the bundle, the newest complete one if none is given."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    complete = [v for v in _versions(spark, root) if fs.exists(path(f"{root}/version={v}/model/_SUCCESS"))]
    if not complete or version is not None and version not in complete:
        raise FileNotFoundError(f"{root} holds no {'complete bundle' if version is None else f'version {version}'}")
    version = max(complete) if version is None else version
    folder = f"{root}/version={version}"
    log = spark.read.parquet(f"{folder}/run_log") if fs.exists(path(f"{folder}/run_log")) else None
    return Bundle(version, *(spark.read.parquet(f"{folder}/{t}") for t in ("model", "bands", "state")), log)


def wavelengths(bands: DataFrame) -> list[float]:
    """The wavelengths in band order (one number a band)."""
    return [r["wavelength"] for r in bands.orderBy("band").collect()]


def align_columns(wide: DataFrame, bands: DataFrame, dataset: str) -> DataFrame:
    """(dataset, sample_id, spectrum): columns whose last token is the wavelength of a band, in
    band order.  Raises where a band has no column; the first of several columns counts."""
    found: dict[float, str] = {}
    for c in wide.columns:
        token = re.search(r"(?:^|_)([0-9]+(?:\.[0-9]+)?)$", c)
        if token:
            found.setdefault(float(token[1]), c)
    wanted = wavelengths(bands)
    missing = [w for w in wanted if w not in found]
    if missing:
        raise ValueError(f"the table misses {len(missing)} of {len(wanted)} bands: {', '.join(f'{w:g}' for w in missing[:5])}"
                         + (", ..." if len(missing) > 5 else ""))
    values = F.array(*[F.col(f"`{found[w]}`").try_cast("double") for w in wanted])
    return wide.select(F.lit(dataset).alias("dataset"), "sample_id", values.alias("spectrum"))


def predict_spectra(spectra: DataFrame, bundle: Bundle, floor: float | None = clean.PRED_FLOOR) -> DataFrame:
    """Predictions of spectra (dataset, sample_id, spectrum, ...) by the bundle's models."""
    prep = bundle.model.select("preprocessing").first()["preprocessing"]
    return predict.batch_predict(transformed(spectra, prep, bundle.state), bundle.model, floor)


def predict_wide(wide: DataFrame, bundle: Bundle, dataset: str, floor: float | None = clean.PRED_FLOOR) -> DataFrame:
    """The whole path for an upload with a column for each band."""
    return predict_spectra(align_columns(wide, bundle.bands, dataset), bundle, floor)
