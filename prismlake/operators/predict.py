"""Scoring, prediction summaries, residuals and calibration.

A fitted linear model is a row (dataset, intercept, coef ARRAY); scoring is a
join on dataset (the coefficient table is tiny; AQE broadcasts it) and an array
dot product -- one narrow stage over the input spectra.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import arrays as A
from prismlake.operators import linear as L
from prismlake.operators.clean import PRED_FLOOR
from prismlake.operators.gram import Moments, gram_pass

CALIBRATION_MIN_SLOPE = 1e-9   # fixed value: below this |slope| calibration is skipped
AXIS_PAD_SHARE = 0.05
AXIS_PAD_MIN = 1e-6


def fit_linear(spectra: DataFrame, model: str = "pls", params: str | None = None) -> DataFrame:
    """Refit one linear model per dataset on all rows -> (dataset, model, params, intercept, coef)."""
    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        m = Moments.from_packed(r["g"], int(r["p"]) + 1)
        chosen, (b0, coef) = L.fit_params(model, m, params)
        return pd.DataFrame([(key[0], model, chosen, float(b0), np.asarray(coef).tolist())],
                            columns=["dataset", "model", "params", "intercept", "coef"])
    g = gram_pass(spectra, ["dataset"], "spectrum", "target")
    return g.groupBy("dataset").applyInPandas(
        solve, "dataset STRING, model STRING, params STRING, intercept DOUBLE, coef ARRAY<DOUBLE>")


def batch_predict(spectra: DataFrame, models: DataFrame, floor: float | None = PRED_FLOOR) -> DataFrame:
    """Score spectra with each dataset's model; predictions floored at ``floor``."""
    pred = F.col("intercept") + A.arr_dot("spectrum", "coef")
    if floor is not None:
        pred = F.greatest(pred, F.lit(floor))
    keep = [c for c in spectra.columns if c != "spectrum"]
    return spectra.join(models.select("dataset", "intercept", "coef"), "dataset").select(*keep, pred.alias("y_pred"))


def prediction_summary(pred: DataFrame) -> DataFrame:
    p = F.col("y_pred")
    return pred.groupBy("dataset").agg(F.avg(p).alias("mean_pred"), F.stddev_pop(p).alias("std_pred"),
                                       F.min(p).alias("min_pred"), F.max(p).alias("max_pred"), F.count(p).alias("n_pred"))


def residuals(pred: DataFrame, actual: str = "target") -> DataFrame:
    """Residual = predicted - actual, |residual|, 1-based sample ordinal per dataset
    (by sample_id), and the plot axis padding (5 % of the joint range, >= 1e-6)."""
    from prismlake.functions.distributed import with_ordinal
    rows = pred.where(F.col(actual).isNotNull() & F.col("y_pred").isNotNull())
    pad = rows.groupBy("dataset").agg(
        F.greatest((F.greatest(F.max(actual), F.max("y_pred")) - F.least(F.min(actual), F.min("y_pred"))) * AXIS_PAD_SHARE,
                   F.lit(AXIS_PAD_MIN)).alias("axis_pad"))
    out = with_ordinal(rows, ["sample_id"], group="dataset", name="sample")
    return (out.join(pad, "dataset")
            .select("dataset", "sample_id", "sample", F.col(actual).alias("actual"), "y_pred",
                    (F.col("y_pred") - F.col(actual)).alias("residual"),
                    F.abs(F.col("y_pred") - F.col(actual)).alias("abs_residual"), "axis_pad"))


def calibration_fit(pred: DataFrame, actual: str = "target") -> DataFrame:
    """Least squares predicted ~ a * actual + b per dataset."""
    return pred.groupBy("dataset").agg(F.regr_slope("y_pred", actual).alias("cal_slope"),
                                       F.regr_intercept("y_pred", actual).alias("cal_intercept"))


def _agreement(df: DataFrame, ref: str, other: str, diff) -> DataFrame:
    return df.groupBy("dataset").agg(
        F.avg(F.abs(diff)).alias("mae"), F.sqrt(F.avg(diff * diff)).alias("rmse"), F.avg(diff).alias("bias"),
        F.when(F.count(F.lit(1)) >= 2, F.pow(F.corr(ref, other), 2)).alias("r2"))


def calibrate_predictions(pred: DataFrame, actual: str = "target") -> tuple[DataFrame, DataFrame]:
    """Invert the fit: calibrated = (pred - b) / a when |a| > 1e-9.  -> (rows, metrics)."""
    fit = calibration_fit(pred, actual)
    rows = pred.where(F.col(actual).isNotNull()).join(fit, "dataset").withColumn(
        "calibrated", F.when(F.abs("cal_slope") > CALIBRATION_MIN_SLOPE,
                             (F.col("y_pred") - F.col("cal_intercept")) / F.col("cal_slope")).otherwise(F.col("y_pred")))
    return rows, _agreement(rows, actual, "calibrated", F.col("calibrated") - F.col(actual))


def map_actuals(pred: DataFrame, actual: str = "target") -> tuple[DataFrame, DataFrame]:
    """Forward map: mapped = a * actual + b; compare with predictions.  -> (rows, metrics)."""
    fit = calibration_fit(pred, actual)
    rows = pred.where(F.col(actual).isNotNull()).join(fit, "dataset").withColumn(
        "mapped_actual", F.col("cal_slope") * F.col(actual) + F.col("cal_intercept"))
    return rows, _agreement(rows, "mapped_actual", "y_pred", F.col("y_pred") - F.col("mapped_actual"))
