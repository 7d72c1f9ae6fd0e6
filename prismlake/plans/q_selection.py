"""Queries for SURVEY §2.6: folds, metrics, leaderboards (over the oof fixture)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.operators import evaluate as ev
from prismlake.plans.catalog import register
from prismlake.sources import fixtures as fx
from prismlake.sources.fixtures import duck_with

MODELS = ["pls", "rf", "gbr", "svr", "krr"]          # of the fixture; SQL cannot pivot on what it finds
_M = ["r2", "mse", "rmse", "mae", "bias", "rpd"]

_VALID = ("valid", """select o.* from oof o semi join (select dataset, preprocessing, model, fold from oof
           group by all having count(y_pred) > 0) f using (dataset, preprocessing, model, fold) where o.y_pred is not null""")


def _metrics_body(keys: str) -> str:
    return f"""select {keys}, n, case when vt * n > 0 then 1 - sse / (vt * n) end as r2, sse / n as mse, sqrt(sse / n) as rmse,
      sae / n as mae, se / n as bias, case when sqrt(sse / n) > 0 then sqrt(vt) / sqrt(sse / n) end as rpd
    from (select {keys}, count(*) as n, sum((y_pred - y_true) * (y_pred - y_true)) as sse, sum(abs(y_pred - y_true)) as sae,
            sum(y_pred - y_true) as se, var_pop(y_true) as vt from valid group by {keys}) a"""


_MET = ("met", _metrics_body("dataset, preprocessing, model"))
_FMET = ("fmet", _metrics_body("dataset, preprocessing, model, fold"))
_FSUM = ("fsum", """select dataset, preprocessing, model, count(*) as n_folds, avg(rmse) as mean_rmse, stddev_pop(rmse) as std_rmse,
           avg(r2) as mean_r2, stddev_pop(r2) as std_r2, avg(rpd) as mean_rpd, stddev_pop(rpd) as std_rpd
           from fmet group by dataset, preprocessing, model""")
_SUMCOLS = ["mean_rmse", "std_rmse", "mean_r2", "std_r2", "mean_rpd", "std_rpd"]


def _sql(body: str, *extra) -> str:
    return duck_with(body, "oof", extra=[_VALID, *extra])


@register("kfold_assign", duck_with("""
    select dataset, sample_id, target, cast((rn - 1) % 5 as int) as fold, cast(floor((rn - 1) / 5) % 3 as int) as inner
    from (select *, row_number() over (partition by dataset order by md5(cast(sample_id as varchar) || '|42'), sample_id) as rn
          from spectra) q""", "spectra"), ["target"])
def q_kfold_assign(spark, sf):
    return ev.kfold_assign(fx.spectra(spark, sf).select("dataset", "sample_id", "target"))


@register("train_test_split", duck_with("""
    select dataset, sample_id, target, case when rn <= ceil(n * 0.2) then 'test' else 'train' end as split
    from (select *, row_number() over (partition by dataset order by md5(cast(sample_id as varchar) || '|42'), sample_id) as rn,
            count(*) over (partition by dataset) as n from spectra) q""", "spectra"), ["target"])
def q_train_test_split(spark, sf):
    return ev.train_test_split(fx.spectra(spark, sf).select("dataset", "sample_id", "target"))


@register("mark_failed_folds", duck_with("""
    select dataset, preprocessing, model, fold, count(*) as n, count_if(y_pred is null) as n_null,
      count(*) = count_if(y_pred is null) as failed from oof group by all""", "oof"))
def q_mark_failed_folds(spark, sf):
    return ev.mark_failed_folds(fx.oof(spark, sf))


@register("regression_metrics", _sql("select * from met", _MET), _M)
def q_regression_metrics(spark, sf):
    return ev.regression_metrics(fx.oof(spark, sf))


@register("fold_summary", _sql("select * from fsum", _FMET, _FSUM), _SUMCOLS)
def q_fold_summary(spark, sf):
    return ev.fold_summary(fx.oof(spark, sf))


@register("fold_history", _sql("select dataset, preprocessing, model, fold, rmse, r2 from fmet", _FMET), ["rmse", "r2"])
def q_fold_history(spark, sf):
    return ev.fold_history(fx.oof(spark, sf))


@register("leaderboard_r2", _sql("""select * from (select *, row_number() over (partition by dataset
    order by r2 desc nulls last, preprocessing, model) as rank from met) q where rank <= 15""", _MET), _M)
def q_leaderboard_r2(spark, sf):
    return ev.leaderboard_r2(fx.oof(spark, sf), 15)


@register("leaderboard_rpd", _sql("""select *, row_number() over (partition by dataset order by mean_rpd desc nulls last,
    mean_r2 desc nulls last, mean_rmse asc nulls last, preprocessing, model) as rank from fsum""", _FMET, _FSUM), _SUMCOLS)
def q_leaderboard_rpd(spark, sf):
    return ev.leaderboard_rpd(fx.oof(spark, sf))


@register("best_combination", _sql("""select * exclude (rank) from (select *, row_number() over (partition by dataset
    order by r2 desc nulls last, preprocessing, model) as rank from met) q where rank = 1""", _MET), _M)
def q_best_combination(spark, sf):
    return ev.best_combination(fx.oof(spark, sf))


@register("best_by_metric", _sql(" union all ".join(
    f"""select * exclude (rank), '{m}' as best_by from (select *, row_number() over (partition by dataset
        order by {o}, preprocessing, model) as rank from met) q{i} where rank = 1"""
    for i, (m, o) in enumerate([("r2", "r2 desc nulls last"), ("rpd", "rpd desc nulls last"), ("rmse", "rmse asc nulls last")])),
    _MET), _M)
def q_best_by_metric(spark, sf):
    return ev.best_by_metric(fx.oof(spark, sf))


@register("top_tuned_combinations", _sql("""select * from (select *, row_number() over (partition by dataset
    order by best_r2 desc nulls last, preprocessing, model) as rank from (
      select dataset, preprocessing, model, arg_max(r2, (r2, -fold)) as best_r2, arg_max(fold, (r2, -fold)) as best_fold
      from fmet group by all) b) q where rank <= 5""", _FMET), ["best_r2"])
def q_top_tuned(spark, sf):
    return ev.top_tuned_combinations(fx.oof(spark, sf))


@register("score_heatmap", _sql("select dataset, preprocessing, " + ", ".join(
    f"max(case when model = '{m}' then mean_r2 end) as {m}" for m in MODELS) + " from fsum group by dataset, preprocessing",
    _FMET, _FSUM), MODELS)
def q_score_heatmap(spark, sf):
    return ev.score_heatmap(fx.oof(spark, sf))


@register("family_ranking", _sql("""
    select model as member, avg(mean_r2) as mean_r2, stddev_samp(mean_r2) as std_r2, count(*) as n, 'model' as family
    from fsum group by model union all
    select preprocessing as member, avg(mean_r2), stddev_samp(mean_r2), count(*), 'preprocessing' from fsum group by preprocessing""",
    _FMET, _FSUM), ["mean_r2", "std_r2"])
def q_family_ranking(spark, sf):
    return ev.family_ranking(fx.oof(spark, sf))


@register("overall_stats", _sql("""
    select s.*, m.modal_best_model from
      (select count(*) as n_results, max(mean_r2) as best_r2, min(mean_r2) as worst_r2, avg(mean_r2) as mean_r2,
         max(mean_rpd) as best_rpd from fsum where mean_r2 is not null) s,
      (select arg_min(model, (-c, model)) as modal_best_model from (select model, count(*) as c from
         (select *, row_number() over (partition by dataset order by mean_r2 desc, preprocessing, model) as rn from fsum
          where mean_r2 is not null) b where rn = 1 group by model) g) m""", _FMET, _FSUM),
    ["best_r2", "worst_r2", "mean_r2", "best_rpd"])
def q_overall_stats(spark, sf):
    return ev.overall_stats(fx.oof(spark, sf))


def _case(col: str, steps, top: str, op: str = "<") -> str:
    return "case " + " ".join(f"when {col} {op} {lim} then '{lbl}'" for lim, lbl in steps) + f" else '{top}' end"


@register("rpd_class", _sql("select dataset, preprocessing, model, rpd, case when rpd is null then null else "
                            + _case("rpd", ev.RPD_CLASSES, ev.RPD_TOP) + " end as rpd_class from met", _MET), ["rpd"])
def q_rpd_class(spark, sf):
    m = ev.regression_metrics(fx.oof(spark, sf))
    return m.select("dataset", "preprocessing", "model", "rpd", ev.rpd_class(F.col("rpd")).alias("rpd_class"))


_ACC = ("case " + " ".join(f"when r2 >= {lim} then {val}" for lim, val in ev.ACCURACY_STEPS)
        + f" else greatest({ev.ACCURACY_FLOOR}, r2 * 100) end")


@register("accuracy_band", _sql(f"""select dataset, preprocessing, model, r2, accuracy,
    case {' '.join(f"when accuracy >= {lim} then '{lbl}'" for lim, lbl in ev.ACCURACY_COLORS)} else 'bad' end as accuracy_color
    from (select *, {_ACC} as accuracy from met) a""", _MET), ["r2", "accuracy"])
def q_accuracy_band(spark, sf):
    m = ev.regression_metrics(fx.oof(spark, sf)).withColumn("accuracy", ev.accuracy_band(F.col("r2")))
    return m.select("dataset", "preprocessing", "model", "r2", "accuracy", ev.accuracy_color(F.col("accuracy")).alias("accuracy_color"))


@register("improvement_log", _sql("select dataset, preprocessing, model, printf('%s_%s: R2=%.4f, RMSE=%.4f', preprocessing, "
                                  "model, r2, rmse) as line from met", _MET))
def q_improvement_log(spark, sf):
    return ev.improvement_log(ev.regression_metrics(fx.oof(spark, sf)))
