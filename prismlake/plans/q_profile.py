"""Queries for SURVEY §2.5: aggregation and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.operators import profile as pf
from prismlake.operators import transforms as tr
from prismlake.plans.catalog import register
from prismlake.plans.sqlbits import duck_long
from prismlake.sources import fixtures as fx
from prismlake.sources.fixtures import duck_with

S = fx.spectra
_CORR = ("corr_t", "select dataset, band, r, abs(r) as abs_r from (select dataset, band, corr(value, target) as r "
                   "from spectra_long group by dataset, band) c where r is not null and not isnan(r)")
_BSTATS = ("bst", "select dataset, band, avg(value) as mean, var_samp(value) as var_samp, var_pop(value) as var_pop, "
                  "stddev_samp(value) as std_samp, stddev_pop(value) as std_pop from spectra_long group by dataset, band")
_CV = ("cv_t", "select dataset, band, std_samp / mean * 100 as cv from bst")


def _regions_sql(regs) -> tuple[str, str]:
    vals = ", ".join(f"('{n}', {a}, {b})" for n, a, b in regs)
    return ("regions", f"select * from (values {vals}) r(region, start, stop)")


@register("dataset_summary", duck_with("""
    select dataset, count(*) as n_samples, max(len(spectrum)) as n_bands, avg(target) as target_mean,
      stddev_samp(target) as target_std, min(target) as target_min, max(target) as target_max,
      (select min(wavelength) from bands) as wl_min, (select max(wavelength) from bands) as wl_max,
      max(target) - min(target) as target_range, stddev_samp(target) / avg(target) * 100 as target_cv
    from spectra group by dataset""", "spectra", "bands"),
    ["target_mean", "target_std", "target_min", "target_max", "target_range", "target_cv"])
def q_dataset_summary(spark, sf):
    return pf.dataset_summary(S(spark, sf), fx.bands(spark))


@register("describe_columns", duck_with("""
    select dataset, band, count(value) as count, avg(value) as mean, stddev_samp(value) as std, min(value) as min,
      max(value) as max, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.75) as q75
    from spectra_long group by dataset, band""", "spectra_long"), ["mean", "std", "min", "max", "q25", "q50", "q75"])
def q_describe_columns(spark, sf):
    return pf.describe_columns(S(spark, sf))


@register("target_shape", duck_with("""
    select dataset, avg(power(target - m, 3)) / power(avg(power(target - m, 2)), 1.5) as skewness,
      avg(power(target - m, 4)) / power(avg(power(target - m, 2)), 2) - 3 as kurtosis
    from (select *, avg(target) over (partition by dataset) as m from spectra) q group by dataset""", "spectra"),
    ["skewness", "kurtosis"])
def q_target_shape(spark, sf):
    return pf.target_shape(S(spark, sf))


@register("target_skew_unbiased", duck_with("select dataset, skewness(target) as skewness from spectra group by dataset",
                                            "spectra"), ["skewness"])
def q_target_skew_unbiased(spark, sf):
    return pf.target_skew_unbiased(S(spark, sf))


@register("missing_profile", duck_with("""
    select *, cast(sum(n_missing) over (partition by dataset) as bigint) as total_missing from (
      select dataset, band, count_if(value is null or isnan(value)) as n_missing from dl group by dataset, band
      union all select dataset, -1 as band, count_if(target is null) as n_missing from spectra_dirty group by dataset) m
    where n_missing > 0 order by dataset, n_missing desc, band""", "spectra_dirty", extra=[("dl", duck_long("select dataset, sample_id, spectrum from spectra_dirty"))]))
def q_missing_profile(spark, sf):
    return pf.missing_profile(fx.spectra_dirty(spark, sf))


@register("duplicate_rows", duck_with("""
    select dataset, cast(sum(c - 1) as bigint) as duplicate_rows from
      (select dataset, spectrum, target, count(*) as c from spectra_dup group by dataset, spectrum, target) g
    group by dataset""", "spectra_dup"))
def q_duplicate_rows(spark, sf):
    return pf.duplicate_rows(fx.spectra_dup(spark, sf))


@register("band_stats", duck_with("select * from bst", "spectra_long", extra=[_BSTATS]),
          ["mean", "var_samp", "var_pop", "std_samp", "std_pop"], default_digits=9)
def q_band_stats(spark, sf):
    return pf.band_stats(S(spark, sf))


@register("band_quartile_envelope", duck_with("""
    select q.*, s.sample_id as chosen_sample, s.value as sample_value
    from (select dataset, band, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50,
            quantile_cont(value, 0.75) as q75 from spectra_long group by dataset, band) q
    left join (select l.* from spectra_long l join (select dataset, min(sample_id) as sid from spectra group by dataset) f
               on l.dataset = f.dataset and l.sample_id = f.sid) s on q.dataset = s.dataset and q.band = s.band""",
    "spectra_long"), ["q25", "q50", "q75", "sample_value"])
def q_band_quartile_envelope(spark, sf):
    return pf.band_quartile_envelope(S(spark, sf)).select("dataset", "band", "q25", "q50", "q75", "chosen_sample", "sample_value")


@register("band_cv", duck_with("select * from cv_t", "spectra_long", extra=[_BSTATS, _CV]), ["cv"])
def q_band_cv(spark, sf):
    return pf.band_cv(S(spark, sf))


@register("band_cv_high", duck_with("""
    select c.dataset, c.band, c.cv, t.threshold from cv_t c join
      (select dataset, quantile_cont(cv, 0.9) as threshold from cv_t group by dataset) t
      on c.dataset = t.dataset where c.cv > t.threshold""", "spectra_long", extra=[_BSTATS, _CV]), ["cv", "threshold"])
def q_band_cv_high(spark, sf):
    return pf.band_cv_high(S(spark, sf))


@register("band_cv_top_bottom", duck_with("""
    select dataset, band, cv, rank, side from (
      select *, row_number() over (partition by dataset order by cv desc, band) as rank, 'most' as side from cv_t
      union all
      select *, row_number() over (partition by dataset order by cv asc, band) as rank, 'least' as side from cv_t) q
    where rank <= 5""", "spectra_long", extra=[_BSTATS, _CV]), ["cv"])
def q_band_cv_top_bottom(spark, sf):
    return pf.band_cv_top_bottom(S(spark, sf))


@register("region_stats", duck_with("""
    select b.dataset, r.region, count(*) as n_bands, avg(b.mean) as mean_reflectance, stddev_samp(b.mean) as std_reflectance
    from bst b join bands w on b.band = w.band join regions r on w.wavelength >= r.start and w.wavelength <= r.stop
    group by b.dataset, r.region""", "spectra_long", extra=[_BSTATS, _regions_sql(pf.REGIONS)]),
    ["mean_reflectance", "std_reflectance"])
def q_region_stats(spark, sf):
    return pf.region_stats(S(spark, sf), fx.bands(spark))


@register("absorption_minima", duck_with("""
    select b.dataset, r.region, min(b.mean) as min_reflectance
    from bst b join bands w on b.band = w.band join regions r on w.wavelength >= r.start and w.wavelength <= r.stop
    group by b.dataset, r.region""", "spectra_long", extra=[_BSTATS, _regions_sql(pf.ABSORPTION_REGIONS)]),
    ["min_reflectance"])
def q_absorption_minima(spark, sf):
    return pf.absorption_minima(S(spark, sf), fx.bands(spark))


@register("reflectance_extent", duck_with("""
    select e.dataset, e.refl_min, e.refl_max, m.mean_of_means, m.mean_of_stds, e.refl_max - e.refl_min as refl_range,
      m.mean_of_stds / m.mean_of_means * 100 as refl_cv
    from (select dataset, min(value) as refl_min, max(value) as refl_max from spectra_long group by dataset) e
    join (select dataset, avg(mean) as mean_of_means, avg(std_samp) as mean_of_stds from bst group by dataset) m
      on e.dataset = m.dataset""", "spectra_long", extra=[_BSTATS]),
    ["refl_min", "refl_max", "mean_of_means", "mean_of_stds", "refl_range", "refl_cv"])
def q_reflectance_extent(spark, sf):
    return pf.reflectance_extent(S(spark, sf))


@register("spectral_resolution", duck_with("""
    select avg(gap) as mean_gap, count(*) as n_bands, min(wavelength) as wl_min, max(wavelength) as wl_max
    from (select wavelength, wavelength - lag(wavelength) over (order by band) as gap from bands) g""", "bands"),
    ["mean_gap"])
def q_spectral_resolution(spark, sf):
    # the band grid of the spectra read from the data: one band per array position
    n = S(spark, sf).agg(F.max(F.size("spectrum"))).first()[0]
    return pf.spectral_resolution(fx.bands(spark, n))


@register("band_target_corr", duck_with("select * from corr_t", "spectra_long", extra=[_CORR]), ["r", "abs_r"])
def q_band_target_corr(spark, sf):
    return pf.band_target_corr(S(spark, sf))


@register("corr_strength_counts", duck_with("""
    select dataset, count_if(abs_r > 0.5) as n_strong, count_if(abs_r >= 0.3 and abs_r <= 0.5) as n_moderate,
      count_if(abs_r > 0.3) as n_above_03, count_if(r > 0.3) as n_pos_03, count_if(r < -0.3) as n_neg_03,
      max(abs_r) as max_abs_r, avg(abs_r) as mean_abs_r, quantile_cont(abs_r, 0.5) as median_abs_r,
      arg_max(band, r) as band_max_r, arg_min(band, r) as band_min_r
    from corr_t group by dataset""", "spectra_long", extra=[_CORR]), ["max_abs_r", "mean_abs_r", "median_abs_r"])
def q_corr_strength_counts(spark, sf):
    return pf.corr_strength_counts(S(spark, sf))


@register("top_k_corr_bands", duck_with("""
    select * from (select *, row_number() over (partition by dataset order by abs_r desc, band) as rank from corr_t) q
    where rank <= 15""", "spectra_long", extra=[_CORR]), ["r", "abs_r"])
def q_top_k_corr_bands(spark, sf):
    return pf.top_k_corr_bands(S(spark, sf), 15)


@register("top_k_corr_bands_signed", duck_with("""
    select * from (select *, row_number() over (partition by dataset order by r desc, band) as rank from corr_t) q
    where rank <= 10""", "spectra_long", extra=[_CORR]), ["r", "abs_r"])
def q_top_k_corr_bands_signed(spark, sf):
    return pf.top_k_corr_bands(S(spark, sf), 10, by_abs=False)


@register("select_top_k_features", duck_with("""
    select l.dataset, l.sample_id, l.band, l.value from spectra_long l semi join
      (select * from (select *, row_number() over (partition by dataset order by abs_r desc, band) as rank from corr_t) q
       where rank <= 15) t on l.dataset = t.dataset and l.band = t.band""", "spectra_long", extra=[_CORR]), ["value"])
def q_select_top_k_features(spark, sf):
    out = pf.select_top_k_features(S(spark, sf), 15)
    return out.select("dataset", "sample_id", F.explode(F.arrays_zip("bands", "spectrum")).alias("z")).select(
        "dataset", "sample_id", F.col("z.bands").alias("band"), F.col("z.spectrum").alias("value"))


@register("region_corr", duck_with("""
    select c.dataset, r.region, avg(c.abs_r) as mean_abs_r
    from corr_t c join bands w on c.band = w.band join regions r on w.wavelength >= r.start and w.wavelength <= r.stop
    group by c.dataset, r.region""", "spectra_long", extra=[_CORR, _regions_sql(pf.REGIONS)]), ["mean_abs_r"])
def q_region_corr(spark, sf):
    return pf.region_corr(S(spark, sf), fx.bands(spark))


def _snv_sql():
    from prismlake.plans.q_transforms import sql_snv, sql_sg
    return sql_snv, sql_sg


def _prep_corr_sql() -> str:
    from prismlake.plans.q_transforms import SPEC, sql_sg, sql_snv
    top = "(case when list_max(spectrum) = 0 then 1e-6 else list_max(spectrum) end)"
    variants = {"none": duck_long(SPEC), "rowmax": duck_long(f"select dataset, sample_id, list_transform(spectrum, lambda x: x / {top}) as spectrum from spectra"),
                "snv": duck_long(sql_snv(SPEC)), "sg_deriv1": duck_long(sql_sg(SPEC, 1)),
                "absorbance_mean_guard": f"""select l.dataset, l.sample_id, l.band, case when coalesce(l.value, 0) = 0 then (case when m.mu > 0 then log10(1 / m.mu) end)
                    when l.value > 0 then log10(1 / l.value) end as value from ({duck_long(SPEC)}) l
                    join (select dataset, band, avg(value) as mu from ({duck_long(SPEC)}) a group by dataset, band) m on l.dataset = m.dataset and l.band = m.band"""}
    rows = " union all ".join(f"select '{name}' as preprocessing, v.dataset, v.sample_id, v.band, v.value from ({sql}) v" for name, sql in variants.items())
    return duck_with(f"""select dataset, preprocessing, avg(r) as mean_abs_r, max(r) as max_abs_r from (
        select v.dataset, v.preprocessing, v.band, abs(corr(v.value, s.target)) as r from ({rows}) v
        join spectra s on v.dataset = s.dataset and v.sample_id = s.sample_id group by v.dataset, v.preprocessing, v.band) q
        where r is not null and not isnan(r) group by dataset, preprocessing""", "spectra")


@register("prep_corr_compare", _prep_corr_sql(), ["mean_abs_r", "max_abs_r"])
def q_prep_corr_compare(spark, sf):
    variants = tr.apply_variants(S(spark, sf), ["none", "rowmax", "snv", "sg_deriv1", "absorbance_mean_guard"])
    return pf.prep_corr_compare(variants)


@register("corr_matrix", duck_with("""
    select a.dataset, a.band as i, b.band as j, corr(a.value, b.value) as r
    from spectra_long a join spectra_long b on a.dataset = b.dataset and a.sample_id = b.sample_id
    group by a.dataset, a.band, b.band""", "spectra_long"), ["r"])
def q_corr_matrix(spark, sf):
    return pf.corr_matrix(S(spark, sf))


@register("corr_first_bands", duck_with("""
    select a.dataset, a.band as i, b.band as j, corr(a.value, b.value) as r
    from spectra_long a join spectra_long b on a.dataset = b.dataset and a.sample_id = b.sample_id
    where a.band < 40 and b.band < 40 group by a.dataset, a.band, b.band""", "spectra_long"), ["r"])
def q_corr_first_bands(spark, sf):
    return pf.corr_first(S(spark, sf), 40)


@register("corr_around_target", duck_with("""
    select a.dataset, a.band as i, b.band as j, corr(a.value, b.value) as r from mk a join mk b
      on a.dataset = b.dataset and a.sample_id = b.sample_id group by a.dataset, a.band, b.band""", "spectra_long", extra=[_CORR, ("ch", """
    select dataset, band from (select dataset, band, row_number() over (partition by dataset order by r desc, band) as a,
      row_number() over (partition by dataset order by r, band) as b from corr_t) q where a <= 20 or b <= 20"""), ("mk", """
    select l.dataset, l.sample_id, l.band, l.value from spectra_long l join ch on l.dataset = ch.dataset and l.band = ch.band
    union all select dataset, sample_id, -1, target from spectra""")]), ["r"])
def q_corr_around_target(spark, sf):
    return pf.corr_around_target(S(spark, sf))


@register("histogram", duck_with("""
    select g.dataset, cast(g.bin as int) as bin, g.lo + g.bin * (g.hi - g.lo) / 30 as lo, g.lo + (g.bin + 1) * (g.hi - g.lo) / 30 as hi,
      coalesce(c.cnt, 0) as count, coalesce(c.cnt, 0) / (g.n * (g.hi - g.lo) / 30) as density
    from (select dataset, min(target) as lo, max(target) as hi, count(target) as n, unnest(range(30)) as bin
          from spectra group by dataset) g
    left join (select s.dataset, least(floor((s.target - r.lo) / ((r.hi - r.lo) / 30)), 29) as bin, count(*) as cnt
               from spectra s join (select dataset, min(target) as lo, max(target) as hi from spectra group by dataset) r
                 on s.dataset = r.dataset group by all) c
      on g.dataset = c.dataset and g.bin = c.bin""", "spectra"), ["lo", "hi", "density"])
def q_histogram(spark, sf):
    return pf.histogram(S(spark, sf), "target", 30)


@register("density_normal_overlay", duck_with("""
    select dataset, cast(k as int) as k, lo + k * (hi - lo) / 99 as x,
      exp(-0.5 * power((lo + k * (hi - lo) / 99 - mu) / sigma, 2)) / (sigma * sqrt(2 * pi())) as pdf
    from (select dataset, avg(target) as mu, stddev_samp(target) as sigma, min(target) as lo, max(target) as hi,
          unnest(range(100)) as k from spectra group by dataset) q""", "spectra"), ["x", "pdf"])
def q_density_normal_overlay(spark, sf):
    return pf.density_normal_overlay(S(spark, sf))


@register("kde_curve", duck_with("""
    select g.dataset, cast(g.k as int) as k, g.a + g.k * g.step as x,
      sum(exp(-0.5 * power((g.a + g.k * g.step - s.target) / g.bw, 2))) / (g.n * g.bw * sqrt(2 * pi())) as density
    from (select dataset, n, bw, lo - 3 * bw as a, (hi + 3 * bw - (lo - 3 * bw)) / 199 as step, unnest(range(200)) as k
          from (select dataset, count(target) as n, stddev_samp(target) * power(count(target), -0.2) as bw,
                  min(target) as lo, max(target) as hi from spectra group by dataset) p) g
    join spectra s on s.dataset = g.dataset and s.target is not null
    group by g.dataset, g.k, g.a, g.step, g.n, g.bw""", "spectra"), ["x", "density"])
def q_kde_curve(spark, sf):
    return pf.kde_curve(S(spark, sf))


@register("box_stats", duck_with("""
    select s.dataset, q.q1, q.median, q.q3, q.q3 - q.q1 as iqr,
      min(case when s.target >= q.q1 - 1.5 * (q.q3 - q.q1) then s.target end) as whisker_low,
      max(case when s.target <= q.q3 + 1.5 * (q.q3 - q.q1) then s.target end) as whisker_high,
      count_if(s.target < q.q1 - 1.5 * (q.q3 - q.q1) or s.target > q.q3 + 1.5 * (q.q3 - q.q1)) as n_outliers
    from spectra s join (select dataset, quantile_cont(target, 0.25) as q1, quantile_cont(target, 0.5) as median,
      quantile_cont(target, 0.75) as q3 from spectra group by dataset) q on s.dataset = q.dataset
    group by s.dataset, q.q1, q.median, q.q3""", "spectra"), ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"])
def q_box_stats(spark, sf):
    return pf.box_stats(S(spark, sf))


@register("z_outlier_counts", duck_with("""
    select dataset, count_if(z > 2) as outliers_2std, count_if(z > 3) as outliers_3std,
      count_if(z > 2) / count(target) * 100 as pct_2std, count_if(z > 3) / count(target) * 100 as pct_3std
    from (select *, abs((target - avg(target) over (partition by dataset)) / stddev_pop(target) over (partition by dataset)) as z
          from spectra) q group by dataset""", "spectra"), ["pct_2std", "pct_3std"])
def q_z_outlier_counts(spark, sf):
    return pf.z_outlier_counts(S(spark, sf))


@register("iqr_outliers", duck_with("""
    select s.dataset, s.sample_id, s.target from spectra s join (select dataset, quantile_cont(target, 0.25) as q1,
      quantile_cont(target, 0.75) as q3 from spectra group by dataset) q on s.dataset = q.dataset
    where s.target < q.q1 - 1.5 * (q.q3 - q.q1) or s.target > q.q3 + 1.5 * (q.q3 - q.q1)""", "spectra"), ["target"])
def q_iqr_outliers(spark, sf):
    return pf.iqr_outliers(S(spark, sf))


@register("quality_warnings", duck_with("""
    select s.dataset, s.sd < 0.1 * s.m as low_variance_target, c.mx < 0.2 as weak_relation
    from (select dataset, avg(target) as m, stddev_samp(target) as sd from spectra group by dataset) s
    join (select dataset, max(abs_r) as mx from corr_t group by dataset) c on s.dataset = c.dataset""",
    "spectra_long", extra=[_CORR]))
def q_quality_warnings(spark, sf):
    return pf.quality_warnings(S(spark, sf))


def _comparison_sql() -> str:
    outlook = "case " + " ".join(f"when c.max_correlation > {lim} then '{lbl}'" for lim, lbl in pf.OUTLOOK) + \
        f" else '{pf.OUTLOOK_ELSE}' end"
    recs = ("array_to_string(list_filter([case when b.dyn > 10 then '" + pf.REC_LOG + "' end, "
            "case when e.refl_max > 1.0 then '" + pf.REC_NORM + "' end, "
            "case when o.outliers_2std > b.n_samples * 0.05 then '" + pf.REC_OUTLIER + "' end, "
            "case when c.mean_correlation < 0.3 then '" + pf.REC_FEATURES + "' end, "
            "case when e.mean_of_means < 0.1 then '" + pf.REC_ABSORBANCE + "' else '" + pf.REC_CONTINUUM + "' end, '"
            + pf.REC_SG + "', '" + pf.REC_DERIV + "'], lambda x: x is not null), '|')")
    return duck_with(f"""
    select b.dataset, b.n_samples, b.n_features, b.target_mean, b.target_std, b.target_range, b.target_cv, b.target_skewness,
      e.refl_range, o.outliers_2std, o.outliers_3std, c.max_correlation, c.mean_correlation,
      {outlook} as performance_outlook, {recs} as recommendations
    from (select dataset, count(*) as n_samples, max(len(spectrum)) as n_features, avg(target) as target_mean,
            stddev_samp(target) as target_std, max(target) - min(target) as target_range,
            stddev_samp(target) / avg(target) * 100 as target_cv, max(target) / min(target) as dyn,
            avg(power(target - m, 3)) / power(avg(power(target - m, 2)), 1.5) as target_skewness
          from (select *, avg(target) over (partition by dataset) as m from spectra) q group by dataset) b
    join (select x.dataset, x.refl_max - x.refl_min as refl_range, x.refl_max, y.mean_of_means from
            (select dataset, min(value) as refl_min, max(value) as refl_max from spectra_long group by dataset) x
            join (select dataset, avg(mean) as mean_of_means from bst group by dataset) y on x.dataset = y.dataset) e
      on b.dataset = e.dataset
    join (select dataset, count_if(z > 2) as outliers_2std, count_if(z > 3) as outliers_3std from
            (select *, abs((target - avg(target) over (partition by dataset)) / stddev_pop(target) over (partition by dataset)) as z
             from spectra) q group by dataset) o on b.dataset = o.dataset
    left join (select dataset, max(abs_r) as max_correlation, avg(abs_r) as mean_correlation from corr_t group by dataset) c
      on b.dataset = c.dataset""", "spectra_long", extra=[_BSTATS, _CORR])


_CMP_DIGITS = ["target_mean", "target_std", "target_range", "target_cv", "target_skewness", "refl_range",
               "max_correlation", "mean_correlation"]


@register("dataset_comparison", _comparison_sql(), _CMP_DIGITS)
def q_dataset_comparison(spark, sf):
    return pf.dataset_comparison(S(spark, sf)).withColumn("recommendations", F.array_join("recommendations", "|"))


@register("prep_recommendations", "select dataset, cast(k as int) as k, rec from (select dataset, "
          "generate_subscripts(string_split(recommendations, '|'), 1) as k, unnest(string_split(recommendations, '|')) as rec "
          "from (" + _comparison_sql() + ") c) r")
def q_prep_recommendations(spark, sf):
    cmp = pf.dataset_comparison(S(spark, sf))
    return cmp.select("dataset", F.posexplode("recommendations").alias("k", "rec")).withColumn("k", F.col("k") + 1)


@register("performance_outlook", "select dataset, performance_outlook from (" + _comparison_sql() + ") c")
def q_performance_outlook(spark, sf):
    return pf.dataset_comparison(S(spark, sf)).select("dataset", "performance_outlook")


def _qq_sql() -> str:
    from prismlake.plans.sqlbits import sql_norm_ppf
    m = ("case when i = n then power(0.5, 1.0 / n) when i = 1 then 1 - power(0.5, 1.0 / n) "
         "else (i - 0.3175) / (n + 0.365) end")
    return duck_with(f"""
    select p.*, f.slope, f.intercept, f.r from p join (select dataset, regr_slope(ordered, theoretical) as slope,
      regr_intercept(ordered, theoretical) as intercept, corr(ordered, theoretical) as r from p group by dataset) f
      on p.dataset = f.dataset""", "spectra", extra=[("p", f"""select dataset, i, {sql_norm_ppf(m)} as theoretical, target as ordered
      from (select dataset, target, row_number() over (partition by dataset order by target, sample_id) as i,
              count(*) over (partition by dataset) as n from spectra where target is not null) q""")])


@register("qq_points", _qq_sql(), ["theoretical", "ordered", "slope", "intercept", "r"])
def q_qq_points(spark, sf):
    return pf.qq_points(S(spark, sf))


@register("pca_scores", None)
def q_pca_scores(spark, sf):
    return pf.pca(S(spark, sf))[0]


@register("pca_explained", None)
def q_pca_explained(spark, sf):
    return pf.pca(S(spark, sf))[1]


@register("linear_fit", duck_with("""
    select f.dataset, f.best_band, f.slope, f.intercept, cast(k as int) as k, f.lo + k * (f.hi - f.lo) / 119 as x,
      f.intercept + f.slope * (f.lo + k * (f.hi - f.lo) / 119) as y_fit
    from (select l.dataset, t.band as best_band, regr_slope(l.target, l.value) as slope, regr_intercept(l.target, l.value) as intercept,
            min(l.value) as lo, max(l.value) as hi, unnest(range(120)) as k
          from spectra_long l join (select * from (select *, row_number() over (partition by dataset order by abs_r desc, band) as rn
            from corr_t) q where rn = 1) t on l.dataset = t.dataset and l.band = t.band group by l.dataset, t.band) f""",
    "spectra_long", extra=[_CORR]), ["slope", "intercept", "x", "y_fit"])
def q_linear_fit(spark, sf):
    return pf.linear_fit(S(spark, sf))


@register("isolation_outliers", None, note="isolation forest (100 trees, 256-row subsamples), contamination 0.1")
def q_isolation_outliers(spark, sf):
    from prismlake.operators.isolation import isolation_outliers
    return isolation_outliers(S(spark, sf))
