"""Queries for SURVEY §2.2: projections, filters, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.operators import clean
from prismlake.plans.catalog import register
from prismlake.plans.sqlbits import duck_long
from prismlake.sources import fixtures as fx
from prismlake.sources.fixtures import duck_with
from prismlake.sources.schema import spectrum_to_long


def _long(df):
    return spectrum_to_long(df.select("dataset", "sample_id", "spectrum"))


def _dirty_long_sql(body_spectra: str, *extra):
    return duck_with(duck_long(body_spectra), "spectra_dirty", extra=list(extra))


# a band median / mean table of the dirty spectra, DuckDB side
_DIRTY_LONG = ("dl", duck_long("select dataset, sample_id, spectrum from spectra_dirty"))


@register("drop_null_target", duck_with(
    "select dataset, sample_id, target from spectra_dirty where target is not null", "spectra_dirty"), ["target"])
def q_drop_null_target(spark, sf):
    return clean.drop_null_target(fx.spectra_dirty(spark, sf)).select("dataset", "sample_id", "target")


@register("mask_valid_rows", duck_with(
    "select dataset, sample_id, target from spectra_dirty where target is not null "
    "and not list_bool_or(list_transform(spectrum, lambda x: x is null or isnan(x)))", "spectra_dirty"), ["target"])
def q_mask_valid_rows(spark, sf):
    return clean.mask_valid_rows(fx.spectra_dirty(spark, sf)).select("dataset", "sample_id", "target")


def _spectra_inf(spark, sf):
    return fx.spectra_dirty(spark, sf).withColumn("spectrum", F.expr(
        "transform(spectrum, (x, i) -> case when x = 0 then cast('Infinity' as double) "
        "when (sample_id + i) % 101 = 0 then cast('-Infinity' as double) else x end)"))


_INF_SQL = ("spectra_inf", "select dataset, sample_id, list_transform(spectrum, lambda x, i: case when x = 0 then 'inf'::double "
                           "when (sample_id + i - 1) % 101 = 0 then '-inf'::double else x end) as spectrum, target from spectra_dirty")


@register("inf_to_null", duck_with(duck_long(
    "select dataset, sample_id, list_transform(spectrum, lambda x: case when isinf(x) or isnan(x) then null else x end) as spectrum "
    "from spectra_inf"), "spectra_dirty", extra=[_INF_SQL]), ["value"])
def q_inf_to_null(spark, sf):
    return _long(clean.inf_to_null(_spectra_inf(spark, sf)))


@register("zero_fill_neighbors", duck_with("""
    select dataset, sample_id, band, coalesce(
      last_value(v ignore nulls) over (partition by dataset, band order by sample_id rows between unbounded preceding and current row),
      first_value(v ignore nulls) over (partition by dataset, band order by sample_id rows between current row and unbounded following)) as value
    from (select dataset, sample_id, band, case when value = 0 then null else value end as v from dl) q""",
    "spectra_dirty", extra=[_DIRTY_LONG]), ["value"])
def q_zero_fill_neighbors(spark, sf):
    return _long(clean.zero_fill_neighbors(fx.spectra_dirty(spark, sf)))


@register("zero_to_eps", _dirty_long_sql(
    "select dataset, sample_id, list_transform(spectrum, lambda x: case when x = 0 then 1e-6 else x end) as spectrum from spectra_dirty"),
    ["value"], default_digits=9)
def q_zero_to_eps(spark, sf):
    return _long(clean.zero_to_eps(fx.spectra_dirty(spark, sf)))


def _fill_sql(stat: str, cond: str) -> str:
    return duck_with(f"""
        select l.dataset, l.sample_id, l.band, case when {cond} then s.stat else l.value end as value
        from dl l join (select dataset, band, {stat} as stat from dl group by dataset, band) s
          on l.dataset = s.dataset and l.band = s.band""", "spectra_dirty", extra=[_DIRTY_LONG])


@register("impute_median", _fill_sql("quantile_cont(value, 0.5)", "l.value is null"), ["value"])
def q_impute_median(spark, sf):
    return _long(clean.impute_median(fx.spectra_dirty(spark, sf)))


@register("impute_mean", _fill_sql("avg(value)", "l.value is null"), ["value"])
def q_impute_mean(spark, sf):
    return _long(clean.impute_mean(fx.spectra_dirty(spark, sf)))


@register("zero_to_mean", _fill_sql("avg(value)", "l.value is null or l.value = 0"), ["value"])
def q_zero_to_mean(spark, sf):
    return _long(clean.zero_to_mean(fx.spectra_dirty(spark, sf)))


def _spectra_const(spark, sf):
    return fx.spectra(spark, sf).withColumn("spectrum", F.expr("transform(spectrum, (x, i) -> case when i = 7 then 0.5D else x end)"))


_CONST_SQL = ("spectra_const", "select dataset, sample_id, list_transform(spectrum, lambda x, i: case when i - 1 = 7 then 0.5::double else x end) as spectrum from spectra")
_CONST_LONG = ("cl", duck_long("select dataset, sample_id, spectrum from spectra_const"))


@register("drop_constant_bands", duck_with(
    "select l.dataset, l.sample_id, l.band, l.value from cl l semi join "
    "(select dataset, band from cl group by dataset, band having stddev_pop(value) > 0) k "
    "on l.dataset = k.dataset and l.band = k.band", "spectra", extra=[_CONST_SQL, _CONST_LONG]), ["value"])
def q_drop_constant_bands(spark, sf):
    out = clean.drop_constant_bands(_spectra_const(spark, sf))
    return out.select("dataset", "sample_id", F.explode(F.arrays_zip("bands", "spectrum")).alias("z")).select(
        "dataset", "sample_id", F.col("z.bands").cast("int").alias("band"), F.col("z.spectrum").alias("value"))


@register("near_constant_bands", duck_with(
    "select dataset, band, stddev_samp(value) as std_samp, stddev_samp(value) < 0.001 as near_constant "
    "from cl group by dataset, band", "spectra", extra=[_CONST_SQL, _CONST_LONG]), ["std_samp"])
def q_near_constant_bands(spark, sf):
    return clean.near_constant_bands(_spectra_const(spark, sf))


@register("clip_lower", duck_with(
    "select dataset, preprocessing, model, fold, sample_id, y_true, "
    "case when y_pred is null then null else greatest(y_pred, 0.001) end as y_pred from oof", "oof"), ["y_true", "y_pred"])
def q_clip_lower(spark, sf):
    return clean.clip_lower(fx.oof(spark, sf))


_RAW = ("case when l_orderkey % 7 = 0 then 'n/a' when l_orderkey % 11 = 0 then '' "
        "else cast(l_quantity as {t}) end")


@register("coerce_numeric",
          "select l_orderkey*10 + l_linenumber as sample_id, " + _RAW.format(t="varchar") + " as raw, "
          "try_cast(" + _RAW.format(t="varchar") + " as double) as value from lineitem", ["value"])
def q_coerce_numeric(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    raw = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"),
                    F.expr(_RAW.format(t="string")).alias("raw"))
    from prismlake.sources.schema import coerce_numeric
    return coerce_numeric(raw, "raw", "value")


@register("deterministic_sample", duck_with(
    "select dataset, sample_id, target from (select *, row_number() over (partition by dataset "
    "order by md5(cast(sample_id as varchar) || '|42'), sample_id) as rn from spectra) q where rn <= 20", "spectra"),
    ["target"])
def q_deterministic_sample(spark, sf):
    return clean.deterministic_sample(fx.spectra(spark, sf), 20).select("dataset", "sample_id", "target")


@register("preview_head", duck_with(
    "select dataset, sample_id, target from (select *, row_number() over (partition by dataset order by sample_id) as rn "
    "from spectra) q where rn <= 5", "spectra"), ["target"])
def q_preview_head(spark, sf):
    return clean.preview_head(fx.spectra(spark, sf), 5).select("dataset", "sample_id", "target")


@register("filter_z_outliers", duck_with("""
    select f.dataset, f.sample_id, f.target from f join sh on f.dataset = sh.dataset
    where not (out and share > 0.05)""", "spectra", extra=[
    ("st", "select dataset, avg(target) as m, stddev_pop(target) as s, count(target) as n from spectra group by dataset"),
    ("f", "select x.dataset, x.sample_id, x.target, coalesce(abs((x.target - st.m) / st.s) > 2, false) as out, st.n "
          "from spectra x join st on x.dataset = st.dataset"),
    ("sh", "select dataset, sum(case when out then 1 else 0 end) / first(n) as share from f group by dataset")]),
    ["target"])
def q_filter_z_outliers(spark, sf):
    return clean.filter_z_outliers(fx.spectra(spark, sf)).select("dataset", "sample_id", "target")
