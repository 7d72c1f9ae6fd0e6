"""Queries for SURVEY §2.3: spectral transforms (outputs in long form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.operators import transforms as tr
from prismlake.plans.catalog import register
from prismlake.plans.sqlbits import duck_long, sql_list, wavelengths
from prismlake.sources import fixtures as fx
from prismlake.sources.fixtures import duck_with
from prismlake.sources.schema import spectrum_to_long

WL = wavelengths()


def _long(df, extra=()):
    return spectrum_to_long(df.select("dataset", "sample_id", *extra, "spectrum"))


def _lsql(inner: str, *fixtures: str, extra=None, keys="dataset, sample_id") -> str:
    return duck_with(duck_long(inner, keys), *fixtures, extra=extra)


# ----------------------------------------------------------------- SQL pieces

def sql_snv(src: str) -> str:
    return (f"select dataset, sample_id, list_transform(spectrum, lambda x: (x - m) / (case when sd = 0 then 1e-9 else sd end)) "
            f"as spectrum from (select *, list_avg(spectrum) as m, list_stddev_pop(spectrum) as sd from ({src}) a) b")


def sql_sg(src: str, deriv: int) -> str:
    W = tr.savgol_weights(deriv=deriv)
    w = len(W)
    h = w // 2
    lit = "[" + ", ".join(sql_list(r) for r in W) + "]"
    return (f"select dataset, sample_id, case when len(spectrum) < {w} then spectrum else list_transform(range(len(spectrum)), lambda i: "
            f"list_sum(list_transform(range({w}), lambda j: ({lit})[i - least(greatest(i - {h}, 0), len(spectrum) - {w}) + 1][j + 1] "
            f"* spectrum[least(greatest(i - {h}, 0), len(spectrum) - {w}) + j + 1]))) end as spectrum from ({src}) s")


def sql_median_fill(src: str) -> str:
    """inf/nan -> null -> band median, over a spectra-shaped source."""
    return f"""
      select l.dataset, l.sample_id, l.band, coalesce(l.value, s.med) as value
      from (select dataset, sample_id, band, case when isinf(value) or isnan(value) then null else value end as value
            from ({duck_long(src)}) z0) l
      join (select dataset, band, quantile_cont(case when isinf(value) or isnan(value) then null else value end, 0.5) as med
            from ({duck_long(src)}) z1 group by dataset, band) s
        on l.dataset = s.dataset and l.band = s.band"""


def sql_absorbance(src: str) -> str:
    inner = (f"select dataset, sample_id, list_transform(spectrum, lambda x: case when x = 0 then -log10(1e-6) "
             f"when x > 0 then -log10(x) else null end) as spectrum from ({src}) a")
    return sql_median_fill(inner)


SPEC = "select dataset, sample_id, spectrum from spectra"
DIRTY = "select dataset, sample_id, spectrum from spectra_dirty"


# ----------------------------------------------------------------- row-local

@register("prep_none", _lsql(SPEC, "spectra"), ["value"])
def q_prep_none(spark, sf):
    return _long(tr.prep_none(fx.spectra(spark, sf)))


@register("prep_rowmax", _lsql(
    "select dataset, sample_id, list_transform(spectrum, lambda x: x / (case when list_max(spectrum) = 0 then 1e-6 "
    "else list_max(spectrum) end)) as spectrum from spectra", "spectra"), ["value"])
def q_prep_rowmax(spark, sf):
    return _long(tr.prep_rowmax(fx.spectra(spark, sf)))


@register("prep_absorbance", duck_with(sql_absorbance(DIRTY), "spectra_dirty"), ["value"])
def q_prep_absorbance(spark, sf):
    return _long(tr.prep_absorbance(fx.spectra_dirty(spark, sf)))


@register("apply_stored_prep", duck_with(sql_absorbance(DIRTY), "spectra_dirty"), ["value"])
def q_apply_stored_prep(spark, sf):
    return _long(tr.apply_stored_prep(fx.spectra_dirty(spark, sf), "Absorbance_pls"))


@register("prep_absorbance_mean_guard", duck_with("""
    select l.dataset, l.sample_id, l.band,
      case when coalesce(l.value, 0) = 0 then (case when s.mu > 0 then log10(1 / s.mu) end)
           when l.value > 0 then log10(1 / l.value) end as value
    from dl l join (select dataset, band, avg(value) as mu from dl group by dataset, band) s
      on l.dataset = s.dataset and l.band = s.band""", "spectra_dirty", extra=[("dl", duck_long(DIRTY))]), ["value"])
def q_prep_absorbance_mean_guard(spark, sf):
    return _long(tr.prep_absorbance_mean_guard(fx.spectra_dirty(spark, sf)))


@register("prep_endpoint_baseline", duck_with(sql_median_fill(
    "select dataset, sample_id, list_transform(spectrum, lambda x, i: x - (spectrum[1] + (spectrum[-1] - spectrum[1]) * (i - 1) "
    "/ greatest(len(spectrum) - 1, 1))) as spectrum from spectra"), "spectra"), ["value"])
def q_prep_endpoint_baseline(spark, sf):
    return _long(tr.prep_endpoint_baseline(fx.spectra(spark, sf)))


@register("prep_snv", _lsql(sql_snv(SPEC), "spectra"), ["value"])
def q_prep_snv(spark, sf):
    return _long(tr.prep_snv(fx.spectra(spark, sf)))


@register("prep_sg_smooth", _lsql(sql_sg(SPEC, 0), "spectra"), ["value"])
def q_prep_sg_smooth(spark, sf):
    return _long(tr.prep_sg_smooth(fx.spectra(spark, sf)))


@register("prep_sg_deriv1", _lsql(sql_sg(SPEC, 1), "spectra"), ["value"])
def q_prep_sg_deriv1(spark, sf):
    return _long(tr.prep_sg_deriv1(fx.spectra(spark, sf)))


@register("prep_sg_deriv2", _lsql(sql_sg(SPEC, 2), "spectra"), ["value"])
def q_prep_sg_deriv2(spark, sf):
    return _long(tr.prep_sg_deriv2(fx.spectra(spark, sf)))


def sql_msc(src: str) -> str:
    return f"""
      select l.dataset, l.sample_id, list(((l.value - f.b) / f.a) order by l.band) as spectrum
      from ({duck_long(src)}) l
      join (select x.dataset, x.sample_id,
              sum((m.mu - m.mm) * (x.value - x.xm)) / sum((m.mu - m.mm) * (m.mu - m.mm)) as a,
              avg(x.xm) - sum((m.mu - m.mm) * (x.value - x.xm)) / sum((m.mu - m.mm) * (m.mu - m.mm)) * avg(m.mm) as b
            from (select *, avg(value) over (partition by dataset, sample_id) as xm from ({duck_long(src)}) q) x
            join (select *, avg(mu) over (partition by dataset) as mm from
                    (select dataset, band, avg(value) as mu from ({duck_long(src)}) r group by dataset, band) q2) m
              on x.dataset = m.dataset and x.band = m.band
            group by x.dataset, x.sample_id) f
        on l.dataset = f.dataset and l.sample_id = f.sample_id
      group by l.dataset, l.sample_id"""


@register("prep_msc", _lsql(sql_msc(SPEC), "spectra"), ["value"])
def q_prep_msc(spark, sf):
    return _long(tr.prep_msc(fx.spectra(spark, sf)))


@register("prep_msc_deriv1", _lsql(sql_sg(sql_msc(SPEC), 1), "spectra"), ["value"])
def q_prep_msc_deriv1(spark, sf):
    return _long(tr.prep_msc_deriv1(fx.spectra(spark, sf)))


@register("prep_snv_deriv1", _lsql(sql_sg(sql_snv(SPEC), 1), "spectra"), ["value"])
def q_prep_snv_deriv1(spark, sf):
    return _long(tr.prep_snv_deriv1(fx.spectra(spark, sf)))


def _variants_sql() -> str:
    absorb = ("select dataset, sample_id, list(value order by band) as spectrum from ("
              + sql_absorbance(SPEC) + ") ab group by dataset, sample_id")
    parts = [("smooth_reflectance", SPEC), ("smooth_absorbance", absorb),
             ("smooth_snv", sql_snv(SPEC)), ("smooth_deriv1", sql_sg(SPEC, 1))]
    return " union all ".join(
        f"select *, '{n}' as preprocessing from ({duck_long(sql_sg(src, 0))}) v{i}" for i, (n, src) in enumerate(parts))


@register("prep_smoothed_variants", duck_with(_variants_sql(), "spectra"), ["value"])
def q_prep_smoothed_variants(spark, sf):
    out = tr.prep_smoothed_variants(fx.spectra(spark, sf))
    return spectrum_to_long(out.select("dataset", "sample_id", "preprocessing", "spectrum"))


@register("prep_registry", duck_with(
    f"select *, 'none' as preprocessing from ({duck_long(SPEC)}) a union all "
    f"select *, 'snv' as preprocessing from ({duck_long(sql_snv(SPEC))}) b union all "
    f"select *, 'sg_deriv1' as preprocessing from ({duck_long(sql_sg(SPEC, 1))}) c", "spectra"), ["value"])
def q_prep_registry(spark, sf):
    out = tr.apply_variants(fx.spectra(spark, sf).drop("target"), ["none", "snv", "sg_deriv1"])
    return spectrum_to_long(out.select("dataset", "sample_id", "preprocessing", "spectrum"))


# ----------------------------------------------------------------- hull

@register("prep_hull_removal", duck_with("""
    select k.dataset, k.sample_id, k.band, k.value / greatest(max(
      case when i.band = j.band then i.value
           else i.value + (j.value - i.value) * (k.wavelength - i.wavelength) / (j.wavelength - i.wavelength) end), 1e-9) as value
    from spectra_long k
    join spectra_long i on i.dataset = k.dataset and i.sample_id = k.sample_id and i.band <= k.band
    join spectra_long j on j.dataset = k.dataset and j.sample_id = k.sample_id and j.band >= k.band
    where i.band < j.band or (i.band = k.band and j.band = k.band)
    group by k.dataset, k.sample_id, k.band, k.value""", "spectra_long"), ["value"])
def q_prep_hull_removal(spark, sf):
    return _long(tr.prep_hull_removal(fx.spectra(spark, sf), WL))


# ----------------------------------------------------------------- scaling

@register("scale_standard", duck_with("""
    select l.dataset, l.sample_id, l.band, (l.value - s.mu) / (case when s.sd = 0 then 1 else s.sd end) as value
    from spectra_long l join (select dataset, band, avg(value) as mu, stddev_pop(value) as sd from spectra_long
      group by dataset, band) s on l.dataset = s.dataset and l.band = s.band""", "spectra_long"), ["value"])
def q_scale_standard(spark, sf):
    return _long(tr.scale_standard(fx.spectra(spark, sf)))


@register("scale_robust", duck_with("""
    select l.dataset, l.sample_id, l.band, (l.value - s.q2) / (case when s.q3 - s.q1 = 0 then 1 else s.q3 - s.q1 end) as value
    from spectra_long l join (select dataset, band, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2,
      quantile_cont(value, 0.75) as q3 from spectra_long group by dataset, band) s
      on l.dataset = s.dataset and l.band = s.band""", "spectra_long"), ["value"])
def q_scale_robust(spark, sf):
    return _long(tr.scale_robust(fx.spectra(spark, sf)))


# ----------------------------------------------------------------- features

_FEATS = ["f_mean", "f_std", "f_skewness", "f_kurtosis", "f_q25", "f_q75", "f_range", "f_entropy",
          "f_ratio_start_end", "f_slope"]
_FEAT_SQL = """
    select dataset, sample_id, avg(value) as f_mean, stddev_pop(value) as f_std, skewness(value) as f_skewness,
      kurtosis(value) as f_kurtosis, quantile_cont(value, 0.25) as f_q25, quantile_cont(value, 0.75) as f_q75,
      max(value) - min(value) as f_range, -sum(value * ln(value + 1e-8)) as f_entropy,
      case when count(*) > 10 then arg_min(value, band) / (arg_max(value, band) + 1e-8) end as f_ratio_start_end,
      case when count(*) > 10 then (arg_max(value, band) - arg_min(value, band)) / count(*) end as f_slope
    from spectra_long group by dataset, sample_id"""


@register("feat_spectrum_stats", duck_with(_FEAT_SQL, "spectra_long"), _FEATS)
def q_feat_spectrum_stats(spark, sf):
    return tr.feat_spectrum_stats(fx.spectra(spark, sf)).select("dataset", "sample_id", *_FEATS)


@register("feat_append", duck_with(
    "select dataset, sample_id, band, value from spectra_long union all "
    "select dataset, sample_id, cast(64 + k as int) as band, v as value from (select dataset, sample_id, "
    "unnest(generate_series(0, 9)) as k, unnest([" + ", ".join(_FEATS) + "]) as v from feats) f",
    "spectra_long", extra=[("feats", _FEAT_SQL)]), ["value"])
def q_feat_append(spark, sf):
    return _long(tr.feat_append(fx.spectra(spark, sf)))


@register("feat_row_slope", duck_with(
    "select dataset, sample_id, regr_slope(value, wavelength) as slope from spectra_long group by dataset, sample_id",
    "spectra_long"), {"slope": 9})
def q_feat_row_slope(spark, sf):
    return tr.feat_row_slope(fx.spectra(spark, sf), WL).select("dataset", "sample_id", "slope")
