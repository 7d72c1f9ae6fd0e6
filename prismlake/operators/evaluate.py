"""Model selection bookkeeping and evaluation.

The input is the flat out-of-fold frame
``(dataset, preprocessing, model, fold, sample_id, y_true, y_pred)`` -- one row per
prediction, never list-valued.  Metrics are sums-based aggregates (partial
aggregation, one row per combination after the shuffle); rankings run on those
small metric frames with a total tie order.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismlake.functions.distributed import with_ordinal

COMBO = ["dataset", "preprocessing", "model"]

# RPD classes (upper limits) and accuracy bands of the reference.
RPD_CLASSES = [(1.0, "Worse than predicting average"), (1.4, "Poor"), (2.0, "Fair"), (2.5, "Good")]
RPD_TOP = "Excellent"
ACCURACY_STEPS = [(0.8, 95.0), (0.6, 85.0), (0.4, 75.0), (0.2, 65.0)]
ACCURACY_FLOOR = 30.0
ACCURACY_COLORS = [(85.0, "good"), (70.0, "medium"), (60.0, "poor")]
COVERAGE_COLORS = [(0.7, "good"), (0.5, "medium")]


# ----------------------------------------------------------------- folds

def kfold_assign(df: DataFrame, k: int = 5, seed: int = 42, inner_k: int = 3, id_col: str = "sample_id",
                 group: str = "dataset") -> DataFrame:
    """Balanced hashed folds: rows ordered by md5(id|seed) within the group, fold =
    (position-1) mod k, inner fold = ((position-1) div k) mod inner_k.

    The inner fold is balanced inside every outer training set and is the same for a
    row whatever the outer fold, so all nested-CV Grams come from one pass.
    Positions come from a range-partitioned ordinal (no single-task window).
    """
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    pos = with_ordinal(df.withColumn("_h", h), ["_h", id_col], group=group, name="_pos")
    return (pos.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int"))
            .withColumn("inner", (F.floor((F.col("_pos") - 1) / k) % inner_k).cast("int"))
            .drop("_h", "_pos"))


def train_test_split(df: DataFrame, test_share: float = 0.2, seed: int = 42, id_col: str = "sample_id",
                     group: str = "dataset") -> DataFrame:
    """First ceil(test_share * n) rows in md5 order of each group are ``test``."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    pos = with_ordinal(df.withColumn("_h", h), ["_h", id_col], group=group, name="_pos")
    n = pos.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return (pos.join(n, group)
            .withColumn("split", F.when(F.col("_pos") <= F.ceil(F.col("_n") * test_share), F.lit("test")).otherwise(F.lit("train")))
            .drop("_h", "_pos", "_n"))


def search_grid(spark: SparkSession, preps: list[str], grids: dict[str, dict[str, list]]) -> DataFrame:
    """preprocessing x model x parameter point; ``params`` is a MAP<STRING,STRING>."""
    rows = []
    for prep in preps:
        for model, grid in grids.items():
            names = sorted(grid)
            for vals in itertools.product(*[grid[n] for n in names]) if names else [()]:
                rows.append((prep, model, {n: json.dumps(v) for n, v in zip(names, vals)}))
    return spark.createDataFrame(rows, "preprocessing STRING, model STRING, params MAP<STRING,STRING>")


def random_param_sample(spark: SparkSession, n_iter: int, space: dict[str, tuple], seed: int = 42) -> DataFrame:
    """n_iter parameter draws; uniforms come from md5(seed|draw|name) so they are the
    same in every engine.  ``space``: name -> ('uniform', lo, hi) | ('int', lo, hi) |
    ('choice', [values])."""
    df = spark.range(n_iter).withColumnRenamed("id", "draw")
    for name, spec in space.items():
        u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("draw").cast("string"), F.lit(f"|{name}"))), 1, 13),
                   16, 10).cast("double") / float(16 ** 13)
        if spec[0] == "uniform":
            df = df.withColumn(name, F.lit(spec[1]) + u * (spec[2] - spec[1]))
        elif spec[0] == "int":
            df = df.withColumn(name, (F.lit(spec[1]) + F.floor(u * (spec[2] - spec[1] + 1))).cast("long"))
        else:
            choices = F.array(*[F.lit(str(v)) for v in spec[1]])
            df = df.withColumn(name, F.element_at(choices, (F.floor(u * len(spec[1])) + 1).cast("int")))
    return df


# ----------------------------------------------------------------- metrics

def mark_failed_folds(oof: DataFrame, keys=("dataset", "preprocessing", "model", "fold")) -> DataFrame:
    """Per fold: rows, null predictions, and ``failed`` when no prediction exists."""
    return oof.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_pred").isNull()).alias("n_null")) \
        .withColumn("failed", F.col("n") == F.col("n_null"))


def valid_predictions(oof: DataFrame) -> DataFrame:
    """Drop folds that failed (no prediction) and rows without a prediction."""
    ok = mark_failed_folds(oof).where(~F.col("failed")).select("dataset", "preprocessing", "model", "fold")
    return oof.join(ok, ["dataset", "preprocessing", "model", "fold"], "left_semi").where(F.col("y_pred").isNotNull())


def _metric_aggs():
    t, p = F.col("y_true"), F.col("y_pred")
    e = p - t
    return [F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"), F.sum(F.abs(e)).alias("_sae"),
            F.sum(e).alias("_se"), F.var_pop(t).alias("_vt")]


def _finish(df: DataFrame) -> DataFrame:
    mse = F.col("_sse") / F.col("n")
    rmse = F.sqrt(mse)
    sst = F.col("_vt") * F.col("n")
    return (df.withColumn("r2", F.when(sst > 0, 1 - F.col("_sse") / sst))
            .withColumn("mse", mse).withColumn("rmse", rmse)
            .withColumn("mae", F.col("_sae") / F.col("n")).withColumn("bias", F.col("_se") / F.col("n"))
            .withColumn("rpd", F.when(rmse > 0, F.sqrt(F.col("_vt")) / rmse))
            .drop("_sse", "_sae", "_se", "_vt"))


def regression_metrics(oof: DataFrame, keys=COMBO) -> DataFrame:
    """Pooled R2 (1 - SSE/SST), MSE, RMSE, MAE, bias, RPD = std(y, ddof 0)/RMSE."""
    return _finish(valid_predictions(oof).groupBy(*keys).agg(*_metric_aggs()))


def fold_metrics(oof: DataFrame) -> DataFrame:
    return regression_metrics(oof, COMBO + ["fold"])


def fold_summary(oof: DataFrame) -> DataFrame:
    """Per combination: mean and std (ddof 0) of fold RMSE, R2 and RPD."""
    fm = fold_metrics(oof)
    return fm.groupBy(*COMBO).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"),
        F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"),
        F.avg("rpd").alias("mean_rpd"), F.stddev_pop("rpd").alias("std_rpd"))


def fold_history(oof: DataFrame) -> DataFrame:
    return fold_metrics(oof).select(*COMBO, "fold", "rmse", "r2")


def _ranked(df: DataFrame, order: list, k: int | None, part=("dataset",)) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)       # metric frames: one row per combination
    out = df.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def leaderboard_r2(oof: DataFrame, k: int | None = None) -> DataFrame:
    """All combinations by pooled R2; ``k`` keeps the top k of each dataset."""
    m = regression_metrics(oof)
    return _ranked(m, [F.desc_nulls_last("r2"), "preprocessing", "model"], k)


def leaderboard_rpd(oof: DataFrame) -> DataFrame:
    s = fold_summary(oof)
    return _ranked(s, [F.desc_nulls_last("mean_rpd"), F.desc_nulls_last("mean_r2"), F.asc_nulls_last("mean_rmse"),
                       "preprocessing", "model"], None)


def best_combination(oof: DataFrame) -> DataFrame:
    """Argmax pooled R2 per dataset; ties go to the first in (preprocessing, model) order."""
    return leaderboard_r2(oof, 1).drop("rank")


def best_by_metric(oof: DataFrame) -> DataFrame:
    m = regression_metrics(oof)
    tie = [F.col("preprocessing"), F.col("model")]
    parts = []
    for metric, order in [("r2", F.desc_nulls_last("r2")), ("rpd", F.desc_nulls_last("rpd")), ("rmse", F.asc_nulls_last("rmse"))]:
        parts.append(_ranked(m, [order, *tie], 1).withColumn("best_by", F.lit(metric)).drop("rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_tuned_combinations(oof: DataFrame, k: int = 5) -> DataFrame:
    """Best fold score per (preprocessing, model), top k per dataset, with its fold."""
    fm = fold_metrics(oof)
    best = fm.groupBy(*COMBO).agg(F.max_by(F.struct("r2", "fold"), F.struct("r2", -F.col("fold"))).alias("b"))
    best = best.select(*COMBO, F.col("b.r2").alias("best_r2"), F.col("b.fold").alias("best_fold"))
    return _ranked(best, [F.desc_nulls_last("best_r2"), "preprocessing", "model"], k)


def score_heatmap(oof: DataFrame, models: list[str] | None = None) -> DataFrame:
    """preprocessing x model pivot of mean fold R2, per dataset; a column for every model
    there is, unless ``models`` names some."""
    s = fold_summary(oof)
    models = models or sorted(r["model"] for r in oof.select("model").distinct().collect())      # one row a model
    return s.groupBy("dataset", "preprocessing").pivot("model", models).agg(F.first("mean_r2"))


def family_ranking(oof: DataFrame) -> DataFrame:
    """Mean and std (ddof 1) of mean fold R2 by model family and by preprocessing."""
    s = fold_summary(oof)
    by_model = s.groupBy(F.col("model").alias("member")).agg(F.avg("mean_r2").alias("mean_r2"),
                                                            F.stddev_samp("mean_r2").alias("std_r2"),
                                                            F.count(F.lit(1)).alias("n")).withColumn("family", F.lit("model"))
    by_prep = s.groupBy(F.col("preprocessing").alias("member")).agg(F.avg("mean_r2").alias("mean_r2"),
                                                                   F.stddev_samp("mean_r2").alias("std_r2"),
                                                                   F.count(F.lit(1)).alias("n")).withColumn("family", F.lit("preprocessing"))
    return by_model.unionByName(by_prep)


def overall_stats(oof: DataFrame) -> DataFrame:
    """Over all combinations with a valid score: count, best / worst / mean of mean
    fold R2, best mean RPD, and the modal best model across datasets."""
    s = fold_summary(oof).where(F.col("mean_r2").isNotNull())
    stats = s.agg(F.count(F.lit(1)).alias("n_results"), F.max("mean_r2").alias("best_r2"),
                  F.min("mean_r2").alias("worst_r2"), F.avg("mean_r2").alias("mean_r2"), F.max("mean_rpd").alias("best_rpd"))
    best = _ranked(s, [F.desc("mean_r2"), "preprocessing", "model"], 1)
    modal = (best.groupBy("model").count()
             .agg(F.min_by("model", F.struct(-F.col("count"), F.col("model"))).alias("modal_best_model")))
    return stats.crossJoin(modal)


def rpd_class(rpd):
    expr = F.lit(RPD_TOP)
    for limit, label in reversed(RPD_CLASSES):
        expr = F.when(rpd < limit, F.lit(label)).otherwise(expr)
    return F.when(rpd.isNull(), F.lit(None)).otherwise(expr)


def accuracy_band(r2):
    acc = F.greatest(F.lit(ACCURACY_FLOOR), r2 * 100)
    for limit, value in reversed(ACCURACY_STEPS):
        acc = F.when(r2 >= limit, F.lit(value)).otherwise(acc)
    return acc


def accuracy_color(acc):
    expr = F.lit("bad")
    for limit, label in reversed(ACCURACY_COLORS):
        expr = F.when(acc >= limit, F.lit(label)).otherwise(expr)
    return expr


def coverage_color(cov):
    expr = F.lit("bad")
    for limit, label in reversed(COVERAGE_COLORS):
        expr = F.when(cov >= limit, F.lit(label)).otherwise(expr)
    return F.when(cov.isNull(), F.lit(None)).otherwise(expr)


def improvement_log(metrics: DataFrame) -> DataFrame:
    """``Prep_model: R2=%.4f, RMSE=%.4f`` line per combination."""
    return metrics.select("dataset", "preprocessing", "model", F.format_string(
        "%s_%s: R2=%.4f, RMSE=%.4f", "preprocessing", "model", "r2", "rmse").alias("line"))
