"""Queries for SURVEY §2.6-2.7: cross-validated models, LOO, prediction, calibration."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from prismlake.operators import evaluate as ev
from prismlake.operators import predict as pr
from prismlake.plans import selection as sel
from prismlake.plans.catalog import register
from prismlake.sources import files
from prismlake.sources import fixtures as fx
from prismlake.sources.fixtures import duck_with

RUNTIME_PREPS = ["Reflectance", "Absorbance", "Continuum Removal"]
BAND = 20   # the single band of the OLS checks (0-based)

_FOLDS = ("fo", f"""select dataset, sample_id, spectrum[{BAND + 1}] as x, target, cast((rn - 1) % 5 as int) as fold
    from (select *, row_number() over (partition by dataset order by md5(cast(sample_id as varchar) || '|42'), sample_id) as rn
          from spectra) q""")
_FIT_ALL = ("fit_all", "select dataset, regr_slope(target, x) as b, regr_intercept(target, x) as a, count(*) as n, "
                       "avg(x) as xm, var_pop(x) * count(*) as sxx from fo group by dataset")

# A model of all bands that SQL can state: PLS with one component on standardised bands.
ONE_COMPONENT = ("pls", '{"n_components": 1}')
_BANDS = ("st", """select dataset, band, avg(value) as mx, case when stddev_samp(value) > 0 then stddev_samp(value) else 1 end as sx,
    covar_samp(value, target) as cxy from spectra_long group by dataset, band""")
_WEIGHTS = ("wt", "select dataset, band, mx, sx, (cxy / sx) / sqrt(sum((cxy / sx) * (cxy / sx)) over (partition by dataset)) as w from st")
_SCORES = ("sc", """select l.dataset, l.sample_id, any_value(l.target) as target, sum((l.value - w.mx) / w.sx * w.w) as t
    from spectra_long l join wt w on l.dataset = w.dataset and l.band = w.band group by l.dataset, l.sample_id""")
_SLOPE = ("sl", """select s.dataset, any_value(g.ym) as ym, sum(s.t * (s.target - g.ym)) / sum(s.t * s.t) as q
    from sc s join (select dataset, avg(target) as ym from spectra group by dataset) g on s.dataset = g.dataset group by s.dataset""")
_COEF = ("co", """select w.dataset, list(w.w * q.q / w.sx order by w.band) as coef, any_value(q.ym) - sum(w.w * q.q / w.sx * w.mx) as intercept
    from wt w join sl q on w.dataset = q.dataset group by w.dataset""")
_PRED = ("pred", """select p.dataset, p.sample_id, p.target, greatest(c.intercept + list_sum(list_transform(range(1, len(c.coef) + 1),
    lambda i: c.coef[i] * p.spectrum[i])), 0.001) as y_pred from spectra p join co c on p.dataset = c.dataset""")
_PLS = [_BANDS, _WEIGHTS, _SCORES, _SLOPE, _COEF]


def _one_band(spark, sf):
    return fx.spectra(spark, sf).withColumn("spectrum", F.array(F.col("spectrum")[BAND]))


def _predictions(spark, sf, model):
    spectra = fx.spectra(spark, sf)
    return pr.batch_predict(spectra, pr.fit_linear(spectra, *model))


# ----------------------------------------------------------------- cross-validation

@register("cv_ols_single_band", duck_with("""
    select fo.dataset, 'none' as preprocessing, 'ols' as model, fo.fold, fo.sample_id, fo.target as y_true,
      t.a + t.b * fo.x as y_pred
    from fo join (select k.dataset, k.fold, regr_slope(d.target, d.x) as b, regr_intercept(d.target, d.x) as a
                  from fo d join (select distinct dataset, fold from fo) k on d.dataset = k.dataset and d.fold <> k.fold
                  group by k.dataset, k.fold) t on fo.dataset = t.dataset and fo.fold = t.fold""",
    "spectra", extra=[_FOLDS]), ["y_true", "y_pred"])
def q_cv_ols_single_band(spark, sf):
    oof, _ = sel.cross_validate(_one_band(spark, sf), ["none"], ["ols"])
    return oof.drop("params")


@register("cv_oof_predictions", None, note="nested 5x3 CV of PLS and linear KRR over the runtime preprocessings")
def q_cv_oof_predictions(spark, sf):
    oof, _ = sel.cross_validate(fx.spectra(spark, sf), RUNTIME_PREPS, ["pls", "krr"])
    return oof


@register("cv_leaderboard", None, note="flagship: nested CV -> pooled metrics -> ranked leaderboard")
def q_cv_leaderboard(spark, sf):
    oof, _ = sel.cross_validate(fx.spectra(spark, sf), RUNTIME_PREPS, ["pls", "krr"])
    return ev.leaderboard_r2(oof.drop("params"))


@register("model_pls", None)
def q_model_pls(spark, sf):
    _, coefs = sel.cross_validate(fx.spectra(spark, sf), ["Absorbance"], ["pls"])
    return coefs.select("dataset", "preprocessing", "model", "fold", "params", "inner_rmse", "intercept")


@register("refit_best", None)
def q_refit_best(spark, sf):
    oof, coefs = sel.cross_validate(fx.spectra(spark, sf), RUNTIME_PREPS, ["pls", "krr"])
    best = ev.best_combination(oof.drop("params")).select("dataset", "preprocessing", "model")
    return (coefs.where(F.col("fold") == -1).join(best, ["dataset", "preprocessing", "model"])
            .select("dataset", "preprocessing", "model", "params", "intercept", F.size("coef").alias("n_coef")))


TUNED_PREPS = ["Reflectance", "Absorbance", "snv", "sg_deriv1"]


@register("cv_tuned_vs_default", None, note="PLS and linear KRR tuned by inner R2 over the whole grid, beside the defaults")
def q_cv_tuned_vs_default(spark, sf):
    return sel.cv_tuned_vs_default(fx.spectra(spark, sf), TUNED_PREPS, ["pls", "krr"])


@register("cv_tuned_random", None, note="the same with 50 random draws")
def q_cv_tuned_random(spark, sf):
    return sel.cv_tuned_vs_default(fx.spectra(spark, sf), TUNED_PREPS, ["pls", "krr"], method="random")


@register("tuning_candidates", None, note="every tuning point of every fold with its inner R2, and the winner")
def q_tuning_candidates(spark, sf):
    points = {m: sel.tuning_points(spark, m, "random", 20) for m in ("pls", "krr")}
    return sel.tuning_candidates(sel.prepare(fx.spectra(spark, sf), TUNED_PREPS, inner_k=5), points)


FIXED_RUNS = 4             # models that are fitted at the same time


# The models of the fixed-parameter evaluation.
def _fixed_set():
    from prismlake.operators import boosting, forest, svr
    boosted = lambda depth, rate: {"n_estimators": [200], "learning_rate": [rate], "max_depth": [depth], "subsample": [1.0]}
    trees = {"n_estimators": [200], "max_depth": [10], "min_samples_split": [2], "min_samples_leaf": [1], "max_features": [1.0]}
    return {"XGBoost": lambda rows, k: boosting.cv_boosting(rows, boosted(6, 0.1), k)[0],
            "GBRT": lambda rows, k: boosting.cv_boosting(rows, boosted(5, 0.05), k)[0],
            "RF": lambda rows, k: forest.cv_forest(rows, trees, k)[0],
            "SVR_rbf": lambda rows, k: svr.cv_svr(rows, {"C": [1.0], "epsilon": [0.1], "gamma": ["scale"]}, k),
            "PLSR": lambda rows, k: sel.score_candidates(rows, sel.tuning_candidates(
                rows, {"pls": [{"n_components": 10, "scale": True}]}, k)).where("tuned")}


@register("model_fixed_set", None, note="the stated models with fixed parameters: cross-validation and hold-out metrics in one row")
def q_model_fixed_set(spark, sf):
    """A hold-out split is one fold: its test rows are fold 0, and only that fold is left out.  Runs do
    not need each other, so ``FIXED_RUNS`` go on at once, and cores that the last tasks of one leave
    free work for the next; the rows of both are written once for all of them."""
    cv = files.written(_absorbance(spark, sf), "fixed-cv")
    split = ev.train_test_split(cv.drop("fold", "inner")).select("*", F.when(F.col("split") == "test", 0).otherwise(1).alias("fold"), F.lit(0).alias("inner"))
    split = files.written(split.select(cv.columns), "fixed-holdout")
    with ThreadPoolExecutor(FIXED_RUNS) as pool:
        runs = {name: [pool.submit(run, rows, k) for rows, k in ((cv, 5), (split, 1))] for name, run in _fixed_set().items()}
    out = None
    for name, both in runs.items():
        parts = []
        for prefix, run in zip(("cv", "holdout"), both):
            oof = run.result().select("dataset", "preprocessing", F.lit(name).alias("model"), "fold", "sample_id", "y_true", "y_pred")
            parts.append(ev.regression_metrics(oof).select("dataset", "preprocessing", "model", F.col("r2").alias(f"{prefix}_r2"), F.col("rmse").alias(f"{prefix}_rmse")))
        row = parts[0].join(parts[1], ["dataset", "preprocessing", "model"])
        out = row if out is None else out.unionByName(row)
    return out


# ----------------------------------------------------------------- leave-one-out

_PRESS = ("loo", """select fo.dataset, fo.sample_id, fo.target as y_true, f.a + f.b * fo.x as y_fit,
      1.0 / f.n + (fo.x - f.xm) * (fo.x - f.xm) / f.sxx as leverage,
      fo.target - (fo.target - (f.a + f.b * fo.x)) / (1 - (1.0 / f.n + (fo.x - f.xm) * (fo.x - f.xm) / f.sxx)) as y_pred
    from fo join fit_all f on fo.dataset = f.dataset""")


@register("loo_press_single_band", duck_with("select * from loo", "spectra", extra=[_FOLDS, _FIT_ALL, _PRESS]),
          ["y_true", "y_fit", "leverage", "y_pred"])
def q_loo_press_single_band(spark, sf):
    return sel.loo_linear(_one_band(spark, sf))


# One-component PLS without each row in turn, from the sums over all rows: without row i a sum
# of products of deviations a, b is S - n / (n - 1) a_i b_i.
_LOO = [
    ("dv", """select l.dataset, l.sample_id, l.band, l.value - m.mx as dx, l.target - m.ym as dy, m.n, m.ym from spectra_long l
        join (select dataset, band, avg(value) as mx, avg(target) as ym, count(*) as n from spectra_long group by dataset, band) m
        on l.dataset = m.dataset and l.band = m.band"""),
    ("cr", """select a.dataset, a.band as j, b.band as k, sum(a.dx * b.dx) as s from dv a join dv b
        on a.dataset = b.dataset and a.sample_id = b.sample_id group by a.dataset, a.band, b.band"""),
    ("rv", """select d.dataset, d.sample_id, d.band, d.dx, d.dy, d.n, d.ym, c.cxy - d.n / (d.n - 1.0) * d.dx * d.dy as sxy,
        case when c.sxx - d.n / (d.n - 1.0) * d.dx * d.dx > 0 then sqrt((c.sxx - d.n / (d.n - 1.0) * d.dx * d.dx) / (d.n - 2)) else 1 end as sd
        from dv d join (select dataset, band, sum(dx * dy) as cxy, sum(dx * dx) as sxx from dv group by dataset, band) c
        on d.dataset = c.dataset and d.band = c.band"""),
    ("uv", """select *, (sxy / sd) / sqrt(sum((sxy / sd) * (sxy / sd)) over (partition by dataset, sample_id)) / sd as u from rv"""),
    ("qu", """select a.dataset, a.sample_id, sum(a.u * b.u * c.s) as usu from uv a join cr c on a.dataset = c.dataset and a.band = c.j
        join uv b on b.dataset = a.dataset and b.sample_id = a.sample_id and b.band = c.k group by a.dataset, a.sample_id"""),
    ("loo", """select v.dataset, v.sample_id, v.ym + v.dy as y_true,
          v.ym - v.dy / (v.n - 1) + v.uy / (q.usu - v.n / (v.n - 1.0) * v.ud * v.ud) * v.ud * v.n / (v.n - 1.0) as y_pred
        from (select dataset, sample_id, any_value(n) as n, any_value(ym) as ym, any_value(dy) as dy, sum(u * dx) as ud, sum(u * sxy) as uy
              from uv group by dataset, sample_id) v join qu q on v.dataset = q.dataset and v.sample_id = q.sample_id"""),
]


@register("loo_predictions", duck_with("select * from loo", "spectra_long", extra=_LOO), ["y_true", "y_pred"],
          note="one-component PLS on all bands, each row predicted without itself")
def q_loo_predictions(spark, sf):
    return sel.loo_pls(fx.spectra(spark, sf), 1)


_LOO_METRICS = """select dataset, n, case when vt > 0 then 1 - sse / (vt * n) end as r2, sqrt(sse / n) as rmse, sae / n as mae,
      case when sqrt(sse / n) > 0 then sqrt(vt) / sqrt(sse / n) end as rpd
    from (select dataset, count(y_pred) as n, sum((y_pred - y_true) * (y_pred - y_true)) as sse,
            sum(abs(y_pred - y_true)) as sae, var_pop(y_true) as vt from loo group by dataset) a"""


@register("loo_metrics", duck_with(_LOO_METRICS, "spectra_long", extra=_LOO), ["r2", "rmse", "mae", "rpd"])
def q_loo_metrics(spark, sf):
    return sel.loo_metrics(sel.loo_pls(fx.spectra(spark, sf), 1))


@register("loo_run_summary", duck_with("select dataset, 'pls' as model, r2, rmse, n from (" + _LOO_METRICS + ") m",
                                       "spectra_long", extra=_LOO), ["r2", "rmse"], note="appended to the runs table and read back")
def q_loo_run_summary(spark, sf):
    m = sel.loo_metrics(sel.loo_pls(fx.spectra(spark, sf), 1))
    runs = files.scratch_path(spark, "runs")
    files.append_run(m.select("dataset", F.lit("pls").alias("model"), "r2", "rmse", "n"), runs)
    return spark.read.parquet(runs).select("dataset", "model", "r2", "rmse", "n")


# ----------------------------------------------------------------- importance

@register("permutation_importance", None)
def q_permutation_importance(spark, sf):
    spectra = fx.spectra(spark, sf)
    return sel.permutation_importance(spectra, pr.fit_linear(spectra, "pls", '{"n_components": 8}'), n_repeats=15)


@register("permutation_importance_gbt", None, note="the same for boosted trees on the absorbance of all rows")
def q_permutation_importance_gbt(spark, sf):
    from prismlake.operators import additive, boosting
    prepared = _absorbance(spark, sf)
    models = additive.fit_models(prepared, boosting.search(boosting.FIXED))
    return sel.permutation_importance(prepared, n_repeats=5, predictors={dataset: m for (dataset, _), m in models.items()})


@register("native_importance", None, note="coefficients of PLS; impurity importances of forest, boosting and rules on all rows")
def q_native_importance(spark, sf):
    from prismlake.operators import boosting, committee, forest
    prepared = _absorbance(spark, sf)
    coefs = sel.native_importance(sel.fit_coefficients(prepared, ["pls"]).where(F.col("fold") == -1))
    out = coefs.select("dataset", "preprocessing", "model", "fold", "band", F.col("coef_value").alias("value"), "importance")
    for _, found in (forest.cv_forest(prepared, k=0, refit=True), boosting.cv_boosting(prepared, k=0, refit=True),
                     committee.cv_committee(prepared, {"n_committees": [10]}, k=0, refit=True)):
        out = out.unionByName(found.select("dataset", "preprocessing", "model", "fold", F.posexplode("importance").alias("band", "importance"))
                              .withColumn("value", F.col("importance")))
    return out


@register("importance_with_stats", None)
def q_importance_with_stats(spark, sf):
    from prismlake.operators import profile as pf
    spectra = fx.spectra(spark, sf)
    imp = sel.permutation_importance(spectra, pr.fit_linear(spectra, "pls", '{"n_components": 8}'), n_repeats=10)
    st = pf.band_stats(spectra).select("dataset", "band", "mean", "var_pop")
    corr = pf.band_target_corr(spectra).select("dataset", "band", "r")
    return (imp.join(st, ["dataset", "band"], "left").join(corr, ["dataset", "band"], "left")
            .dropna().orderBy("dataset", F.desc("importance_mean"), "band"))


@register("metric_melt", duck_with("""
    select b.dataset, b.band, w.wavelength, m.metric, m.value from bst b join bands w on b.band = w.band,
      lateral (select * from (values ('mean', b.mean), ('std_samp', b.std_samp), ('var_pop', b.var_pop)) v(metric, value)) m""",
    "spectra_long", extra=[("bst", "select dataset, band, avg(value) as mean, stddev_samp(value) as std_samp, "
                                   "var_pop(value) as var_pop from spectra_long group by dataset, band")]), {"value": 9})
def q_metric_melt(spark, sf):
    from prismlake.operators import profile as pf
    st = pf.band_stats(fx.spectra(spark, sf)).select("dataset", "band", "mean", "std_samp", "var_pop")
    long = st.unpivot(["dataset", "band"], ["mean", "std_samp", "var_pop"], "metric", "value")
    return long.join(fx.bands(spark), "band").select("dataset", "band", "wavelength", "metric", "value")


# ----------------------------------------------------------------- prediction

@register("batch_predict", duck_with("select dataset, sample_id, target, y_pred from pred", "spectra_long",
                                     extra=[*_PLS, _PRED]), ["target", "y_pred"])
def q_batch_predict(spark, sf, model=ONE_COMPONENT):
    return _predictions(spark, sf, model).select("dataset", "sample_id", "target", "y_pred")


@register("prediction_summary", duck_with("""select dataset, avg(y_pred) as mean_pred, stddev_pop(y_pred) as std_pred,
    min(y_pred) as min_pred, max(y_pred) as max_pred, count(y_pred) as n_pred from pred group by dataset""",
    "spectra_long", extra=[*_PLS, _PRED]), ["mean_pred", "std_pred", "min_pred", "max_pred"])
def q_prediction_summary(spark, sf, model=ONE_COMPONENT):
    return pr.prediction_summary(_predictions(spark, sf, model))


@register("residuals", duck_with("""select p.dataset, p.sample_id, row_number() over (partition by p.dataset order by p.sample_id) as sample,
    p.target as actual, p.y_pred, p.y_pred - p.target as residual, abs(p.y_pred - p.target) as abs_residual, a.axis_pad
    from pred p join (select dataset, greatest((greatest(max(target), max(y_pred)) - least(min(target), min(y_pred))) * 0.05, 1e-6)
      as axis_pad from pred group by dataset) a on p.dataset = a.dataset""",
    "spectra_long", extra=[*_PLS, _PRED]), ["actual", "y_pred", "residual", "abs_residual", "axis_pad"])
def q_residuals(spark, sf, model=ONE_COMPONENT):
    return pr.residuals(_predictions(spark, sf, model))


_CAL = ("cal", "select dataset, regr_slope(y_pred, target) as cal_slope, regr_intercept(y_pred, target) as cal_intercept "
               "from pred group by dataset")


@register("calibration_fit", duck_with("select * from cal", "spectra_long", extra=[*_PLS, _PRED, _CAL]),
          ["cal_slope", "cal_intercept"])
def q_calibration_fit(spark, sf, model=ONE_COMPONENT):
    return pr.calibration_fit(_predictions(spark, sf, model))


@register("calibrate_predictions", duck_with("""
    select dataset, avg(abs(d)) as mae, sqrt(avg(d * d)) as rmse, avg(d) as bias,
      case when count(*) >= 2 then power(corr(target, calibrated), 2) end as r2
    from (select p.*, case when abs(c.cal_slope) > 1e-9 then (p.y_pred - c.cal_intercept) / c.cal_slope else p.y_pred end as calibrated,
            (case when abs(c.cal_slope) > 1e-9 then (p.y_pred - c.cal_intercept) / c.cal_slope else p.y_pred end) - p.target as d
          from pred p join cal c on p.dataset = c.dataset) q group by dataset""",
    "spectra_long", extra=[*_PLS, _PRED, _CAL]), ["mae", "rmse", "bias", "r2"])
def q_calibrate_predictions(spark, sf, model=ONE_COMPONENT):
    return pr.calibrate_predictions(_predictions(spark, sf, model))[1]


@register("map_actuals", duck_with("""
    select dataset, avg(abs(d)) as mae, sqrt(avg(d * d)) as rmse, avg(d) as bias,
      case when count(*) >= 2 then power(corr(mapped, y_pred), 2) end as r2
    from (select p.*, c.cal_slope * p.target + c.cal_intercept as mapped, p.y_pred - (c.cal_slope * p.target + c.cal_intercept) as d
          from pred p join cal c on p.dataset = c.dataset) q group by dataset""",
    "spectra_long", extra=[*_PLS, _PRED, _CAL]), ["mae", "rmse", "bias", "r2"])
def q_map_actuals(spark, sf, model=ONE_COMPONENT):
    return pr.map_actuals(_predictions(spark, sf, model))[1]


# ----------------------------------------------------------------- model bundle

@register("write_model_bundle", duck_with("""
    select c.dataset, 'Reflectance' as preprocessing, 'pls' as model, c.intercept, l.n_log_lines, unnest(range(len(c.coef)))::int as band,
      unnest(c.coef) as coef from co c join (select dataset, count(*) as n_log_lines from run_log_lines group by dataset) l on c.dataset = l.dataset""",
    "spectra_long", "run_log_lines", extra=_PLS), ["intercept", "coef"], note="written, loaded again: a row a coefficient")
def q_write_model_bundle(spark, sf):
    from prismlake.operators import bundle as bu
    root = files.scratch_path(spark, "bundle")
    bu.write_model_bundle(root, fx.spectra(spark, sf), fx.bands(spark), "Reflectance", *ONE_COMPONENT, run_log=fx.run_log_lines(spark, sf))
    loaded = bu.load_model_bundle(spark, root)
    counts = loaded.run_log.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_log_lines"))
    model = loaded.model.select("dataset", "preprocessing", "model", "intercept", F.posexplode("coef").alias("band", "coef"))
    return model.join(counts, "dataset")


@register("bundle_predict", duck_with("""
    select p.dataset, p.sample_id, greatest(c.intercept + list_sum(list_transform(range(1, len(c.coef) + 1),
      lambda i: c.coef[i] * p.spectrum[i])), 0.001) as y_pred from spectra p join co c on p.dataset = c.dataset where p.dataset = 'T1'""",
    "spectra_long", extra=_PLS), ["y_pred"], note="wide table with shuffled and surplus columns -> load, align, transform, score, floor")
def q_bundle_predict(spark, sf):
    from prismlake.operators import bundle as bu
    from prismlake.sources import schema
    root = files.scratch_path(spark, "bundle")
    spectra, bands = fx.spectra(spark, sf), fx.bands(spark)
    bu.write_model_bundle(root, spectra, bands, "Reflectance", *ONE_COMPONENT)
    one = spectra.where("dataset = 'T1'")
    names = [f"T1_{int(w)}" for w in bu.wavelengths(bands)]
    wide = one.select("sample_id", F.lit("x").alias("note"), *[F.col("spectrum")[i].alias(n) for i, n in reversed(list(enumerate(names)))])
    return bu.predict_wide(wide, bu.load_model_bundle(spark, root), "T1").select("dataset", "sample_id", "y_pred")


@register("model_registry", duck_with(f"""
    select b.dataset, 'pls' as model, (select max(len(spectrum)) from spectra) as n_features,
      (select min(wavelength) from bands) as wl_first, (select max(wavelength) from bands) as wl_last, b.r2 as best_r2, b.rmse as best_rmse
    from (select dataset, r2, rmse, row_number() over (partition by dataset order by r2 desc, rmse asc, preprocessing desc, model desc) as rn
          from (select dataset, regexp_extract(line, '{files.RUN_LOG_PATTERN}', 1) as preprocessing,
                  regexp_extract(line, '{files.RUN_LOG_PATTERN}', 2) as model,
                  try_cast(regexp_extract(line, '{files.RUN_LOG_PATTERN}', 3) as double) as r2,
                  try_cast(regexp_extract(line, '{files.RUN_LOG_PATTERN}', 4) as double) as rmse from run_log_lines) p
          where r2 is not null and preprocessing <> '') b where rn = 1""", "spectra", "bands", "run_log_lines"),
    ["best_r2", "best_rmse"])
def q_model_registry(spark, sf):
    spectra = fx.spectra(spark, sf)
    models = pr.fit_linear(spectra, "pls", '{"n_components": 8}')
    bands = fx.bands(spark)
    wl = bands.agg(F.min("wavelength").alias("wl_first"), F.max("wavelength").alias("wl_last"))
    best = files.best_from_log(files.parse_run_log(fx.run_log_lines(spark, sf))).select(
        "dataset", F.col("r2").alias("best_r2"), F.col("rmse").alias("best_rmse"))
    return (models.select("dataset", "model", F.size("coef").alias("n_features"))
            .crossJoin(F.broadcast(wl)).join(best, "dataset"))


# ----------------------------------------------------------------- tree ensembles

def _absorbance(spark, sf):
    return sel.prepare(fx.spectra(spark, sf), ["Absorbance"])


@register("model_rf", None, note="random forests, nested 5x3 search over trees, depth, node sizes and bands a node")
def q_model_rf(spark, sf):
    from prismlake.operators import forest
    return forest.cv_forest(_absorbance(spark, sf), forest.GRID)[0]


@register("model_gbt", None, note="boosted trees, nested 5x3 search over rounds, rate, depth and share of rows")
def q_model_gbt(spark, sf):
    from prismlake.operators import boosting
    return boosting.cv_boosting(_absorbance(spark, sf), boosting.GRID)[0]


@register("model_rule_committee", None, note="committees of model trees, nested 5x3 search over the number of members")
def q_model_rule_committee(spark, sf):
    from prismlake.operators.committee import cv_committee
    return cv_committee(_absorbance(spark, sf))[0]


# ----------------------------------------------------------------- streaming

@register("stream_batch_predict", duck_with("select dataset, sample_id, target, y_pred from pred", "spectra_long",
                                            extra=[*_PLS, _PRED]), ["target", "y_pred"])
def q_stream_batch_predict(spark, sf, model=ONE_COMPONENT):
    """Scoring of spectra that arrive as a file stream of ``embeddings``, all bands."""
    from prismlake.streaming.scoring import run_available_now, stream_predict
    emb = fx.table(spark, sf, "embeddings")
    stream = spark.readStream.schema(emb.schema).parquet(f"{sf}/embeddings.parque[t]")

    def to_spectra(df):
        return df.selectExpr(
            "concat('T', cast(1 + label % 5 as string)) as dataset", "vec_id as sample_id",
            "transform(embedding, e -> 0.5D + 0.5D * cast(e as double)) as spectrum").selectExpr(
            "dataset", "sample_id", "spectrum",
            "20D + 40D*spectrum[5] - 25D*spectrum[20] + 30D*spectrum[40]*spectrum[50] + 2D*((sample_id*7919) % 101)/101D as target")
    models = pr.fit_linear(fx.spectra(spark, sf), *model)
    sink = run_available_now(spark, stream_predict(stream, models, to_spectra))
    return spark.read.parquet(sink).select("dataset", "sample_id", "target", "y_pred")


# ----------------------------------------------------------------- kernel models

def _krr(spark, sf, **fixed):
    from prismlake.operators import kernel
    return kernel.cv_krr(_absorbance(spark, sf), kernel.GRID | fixed)[0]


@register("model_krr", None, note="kernel ridge on landmarks, nested 5x3 search over kernel, gamma, degree and alpha")
def q_model_krr(spark, sf):
    return _krr(spark, sf)


@register("model_krr_rbf", None, note="the same with RBF kernels only")
def q_model_krr_rbf(spark, sf):
    return _krr(spark, sf, kernel=["rbf"])


@register("model_krr_poly", None, note="the same with polynomial kernels only")
def q_model_krr_poly(spark, sf):
    return _krr(spark, sf, kernel=["polynomial"])


@register("loo_pls", None, note="exact leave-one-out PLS (8 components) by Gram downdates")
def q_loo_pls(spark, sf):
    return sel.loo_metrics(sel.loo_pls(fx.spectra(spark, sf), 8))


@register("model_svr", None, note="epsilon-insensitive SVR, nested 5x3 search over C, epsilon and gamma; kkt: violation of optimality")
def q_model_svr(spark, sf):
    from prismlake.operators.svr import cv_svr
    return cv_svr(_absorbance(spark, sf))


# ----------------------------------------------------------------- the same with least squares

# The plain names run one-component PLS, which SQL can state; these run multi-band OLS.
for _q in (q_batch_predict, q_prediction_summary, q_residuals, q_calibration_fit, q_calibrate_predictions, q_map_actuals,
           q_stream_batch_predict):
    register(f"{_q.__name__[2:]}_all_bands", None, note="multi-band OLS on all bands")(functools.partial(_q, model=("ols",)))


@register("loo_predictions_all_bands", None, note="multi-band OLS on all bands, exact PRESS")
def q_loo_predictions_all_bands(spark, sf):
    return sel.loo_linear(fx.spectra(spark, sf))


@register("loo_metrics_all_bands", None, note="multi-band OLS on all bands, exact PRESS")
def q_loo_metrics_all_bands(spark, sf):
    return sel.loo_metrics(sel.loo_linear(fx.spectra(spark, sf)))


@register("loo_run_summary_all_bands", None, note="multi-band OLS on all bands, exact PRESS")
def q_loo_run_summary_all_bands(spark, sf):
    return q_loo_metrics_all_bands(spark, sf).select("dataset", F.lit("ols").alias("model"), "r2", "rmse", "n")


@register("write_model_bundle_all_bands", None, note="multi-band OLS on all bands, with every coefficient")
def q_write_model_bundle_all_bands(spark, sf):
    from prismlake.operators import bundle as bu
    root = files.scratch_path(spark, "bundle")
    bu.write_model_bundle(root, fx.spectra(spark, sf), fx.bands(spark), "Reflectance", "ols", run_log=fx.run_log_lines(spark, sf))
    loaded = bu.load_model_bundle(spark, root)
    counts = loaded.run_log.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_log_lines"))
    return loaded.model.select("dataset", "model", "intercept", "coef").join(counts, "dataset")
