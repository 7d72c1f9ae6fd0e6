"""Queries for SURVEY §2.4: target transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.operators import targets as tg
from prismlake.plans.catalog import register
from prismlake.sources import fixtures as fx
from prismlake.sources.fixtures import duck_with


@register("target_log1p", duck_with(
    "select dataset, sample_id, target, ln(1 + target) as y_log1p, exp(ln(1 + target)) - 1 as y_back from spectra",
    "spectra"), ["target", "y_log1p", "y_back"])
def q_target_log1p(spark, sf):
    return tg.target_log1p(fx.spectra(spark, sf)).select("dataset", "sample_id", "target", "y_log1p", "y_back")


@register("skew_before_after", duck_with(
    "select dataset, skewness(target) as skew_before, skewness(ln(1 + target)) as skew_after from spectra group by dataset",
    "spectra"), ["skew_before", "skew_after"])
def q_skew_before_after(spark, sf):
    return tg.skew_before_after(tg.target_log1p(fx.spectra(spark, sf)))


@register("target_boxcox", None, note="lambda by grid-refined maximum likelihood; checked by invariants in tests")
def q_target_boxcox(spark, sf):
    return tg.power_transform(fx.spectra(spark, sf), "box-cox").select("dataset", "sample_id", "target", "method", "lambda", "y_power")


@register("target_yeojohnson", None)
def q_target_yeojohnson(spark, sf):
    # lineitem-derived target with non-positive values forces the Yeo-Johnson branch
    tab = fx.oof(spark, sf).select("dataset", "sample_id", (F.col("y_pred") - F.col("y_true")).alias("target"))
    return tg.power_transform(tab, "auto").select("dataset", "sample_id", "target", "method", "lambda", "y_power")


def _quantile_normal_sql() -> str:
    """Ranks on the sorted values (or on evenly spaced quantiles of them), from both sides."""
    import numpy as np

    from prismlake.plans.sqlbits import sql_norm_ppf
    n, edge = tg.N_QUANTILES, float(np.spacing(1))
    low, high = tg.BOUNDS_THRESHOLD - edge, 1 - (tg.BOUNDS_THRESHOLD - edge)
    at = f"(k * (len(v) - 1) / {n - 1}.0)"
    side = lambda i: (f"case when qs[{i} + 1] = qs[{i}] then ({i} - 1) / (m - 1.0) else ({i} - 1) / (m - 1.0) "  # noqa: E731
                      f"+ (target - qs[{i}]) / (qs[{i} + 1] - qs[{i}]) * ({i} / (m - 1.0) - ({i} - 1) / (m - 1.0)) end")
    return duck_with(f"""select dataset, sample_id, target, {sql_norm_ppf(f"least(greatest(cdf, {low!r}), {high!r})")} as y_qnormal from (
        select *, case when target - {tg.BOUNDS_THRESHOLD!r} < qs[1] then 0.0 when target + {tg.BOUNDS_THRESHOLD!r} > qs[m] then 1.0
            else (({side("a")}) + ({side("b")})) / 2 end as cdf from (
          select s.dataset, s.sample_id, s.target, q.qs, len(q.qs) as m,
            greatest(least(len(list_filter(q.qs, lambda x: x <= s.target)), len(q.qs) - 1), 1) as a,
            greatest(least(len(q.qs) - len(list_filter(q.qs, lambda x: x >= s.target)), len(q.qs) - 1), 1) as b
          from spectra s join (select dataset, case when len(v) <= {n} then v else list_transform(range({n}), lambda k: v[floor({at})::bigint + 1]
              + ({at} - floor({at})) * (v[ceil({at})::bigint + 1] - v[floor({at})::bigint + 1])) end as qs
            from (select dataset, list_sort(list(target)) as v from spectra where target is not null group by dataset) g) q on s.dataset = q.dataset) i) c""", "spectra")


@register("target_quantile_normal", _quantile_normal_sql(), ["target", "y_qnormal"])
def q_target_quantile_normal(spark, sf):
    return tg.target_quantile_normal(fx.spectra(spark, sf)).select("dataset", "sample_id", "target", "y_qnormal")
