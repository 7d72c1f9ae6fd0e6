"""Queries for SURVEY §2.1: sources, schema handling, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.plans.catalog import register
from prismlake.plans.sqlbits import N, duck_long, wavelengths
from prismlake.sources import fixtures as fx
from prismlake.sources import files, schema
from prismlake.sources.fixtures import duck_with

WL = wavelengths()
LABELS = [str(int(w)) for w in WL]
DATASETS = ["T1", "T2", "T3", "T4", "T5"]          # of the fixture; SQL cannot name columns by what it finds
PFX = schema.DATASET_PREFIX


# ---------------------------------------------------------------- long / wide

@register("spectrum_to_long", duck_with("select * from spectra_long", "spectra_long"),
          ["wavelength", "value", "target"])
def q_spectrum_to_long(spark, sf):
    return fx.spectra_long(spark, sf)


def _wide(spark, sf):
    pairs = list(enumerate(LABELS))
    return schema.long_to_wide(fx.spectra_long(spark, sf), pairs)


_WIDE_SQL = ("select dataset, sample_id, "
             + ", ".join(f'max(case when band = {b} then value end) as "{lbl}"' for b, lbl in enumerate(LABELS))
             + ", first(target) as target from spectra_long group by dataset, sample_id")


@register("long_to_wide", duck_with(_WIDE_SQL, "spectra_long"), LABELS + ["target"])
def q_long_to_wide(spark, sf):
    return _wide(spark, sf)


@register("columns_to_spectrum",
          duck_with(duck_long("select dataset, sample_id, spectrum from spectra"), "spectra"), ["value"])
def q_columns_to_spectrum(spark, sf):
    wide = _wide(spark, sf)
    # present the columns in reverse order: the operator must sort them by wavelength
    wide = wide.select("dataset", "sample_id", "target", *[f"`{c}`" for c in reversed(LABELS)])
    spectra, _bands = schema.columns_to_spectrum(wide, target="target")
    return schema.spectrum_to_long(spectra.drop("target"))


# ---------------------------------------------------------------- positional merge

def _merged(spark, sf):
    wide = _wide(spark, sf)
    frames = {}
    for d in sorted(r["dataset"] for r in wide.select("dataset").distinct().collect()):          # one row a dataset
        part = wide.where(F.col("dataset") == d).drop("dataset")
        part = schema.prefix_columns(part, f"{PFX}{d}", keys=("sample_id",))
        frames[d] = part
    from prismlake.functions.distributed import with_ordinal
    merged = None
    for d, part in frames.items():
        p = with_ordinal(part, ["sample_id"], name="position").drop("sample_id")
        merged = p if merged is None else merged.join(p, "position", "full_outer")
    return merged


def _merged_sql() -> str:
    parts = []
    for d in DATASETS:
        cols = ", ".join(f'"{lbl}" as "{PFX}{d}_{lbl}"' for lbl in LABELS)
        parts.append((f"m{d}", f"select row_number() over (order by sample_id) as position, {cols}, "
                               f"target as \"{PFX}{d}_target\" from wide where dataset = '{d}'"))
    body = "select coalesce(" + ", ".join(f"m{d}.position" for d in DATASETS) + ") as position, " + \
        ", ".join(f"m{d}.* exclude (position)" for d in DATASETS) + " from mT1"
    for i, d in enumerate(DATASETS[1:], 1):
        prev = ", ".join(f"m{x}.position" for x in DATASETS[:i])
        body += f" full outer join m{d} on m{d}.position = coalesce({prev})"
    return duck_with(body, "spectra_long", extra=[("wide", _WIDE_SQL)] + parts)


_MERGED_COLS = [f"{PFX}{d}_{lbl}" for d in DATASETS for lbl in LABELS + ["target"]]


# ---------------------------------------------------------------- column rules

@register("resolve_target", duck_with("""
    select dataset, 'Clay_Target' as target_column, avg(target) as mean, count(target) as n from spectra group by dataset""", "spectra"), ["mean"])
def q_resolve_target(spark, sf):
    table = fx.spectra(spark, sf).selectExpr("dataset", "sample_id", "spectrum[0] as B_410", "target as Clay_Target")
    name = schema.resolve_target(table.columns)
    return table.groupBy("dataset").agg(F.lit(name).alias("target_column"), F.avg(name).alias("mean"), F.count(name).alias("n"))


_NUMERIC_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@register("select_numeric_features", " union all ".join(
    f"select '{c}' as feature, count({c}) as n, avg({c})::double as mean, stddev_samp({c})::double as sd from lineitem" for c in _NUMERIC_COLUMNS), ["mean", "sd"])
def q_select_numeric_features(spark, sf):
    table = fx.table(spark, sf, "lineitem")
    features = schema.select_numeric_features(table, "l_extendedprice")
    values = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("x"))
    return values.groupBy("x.feature").agg(F.count("x.value").alias("n"), F.avg("x.value").alias("mean"), F.stddev_samp("x.value").alias("sd"))


@register("detect_actuals_column", """
    select 'T2' as model_key, 'Soil_T2_target' as actuals, avg(l_quantity) as mean, count(*) as n from lineitem
    union all select 'T1', 'observed', avg(l_extendedprice), count(*) from lineitem
    union all select 'T9', 'T9_measured', avg(l_tax), count(*) from lineitem""".replace("Soil_", PFX), ["mean"])
def q_detect_actuals_column(spark, sf):
    table = fx.table(spark, sf, "lineitem")
    uploads = {"T2": {"y_pred": "l_discount", "actual": "l_tax", f"{PFX}T2_target": "l_quantity"}, "T1": {"y_pred": "l_tax", "observed": "l_extendedprice"},
               "T9": {"y_pred": "l_quantity", "T9_measured": "l_tax"}}
    out = None
    for key, columns in uploads.items():
        upload = table.select(*[F.col(c).alias(name) for name, c in columns.items()])
        name = schema.detect_actuals_column(upload.columns, key)
        one = upload.agg(F.lit(key).alias("model_key"), F.lit(name).alias("actuals"), F.avg(name).alias("mean"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@register("concat_by_position", _merged_sql(), _MERGED_COLS)
def q_concat_by_position(spark, sf):
    return _merged(spark, sf)


@register("prefix_columns", duck_with(
    "select sample_id, " + ", ".join(f'"{lbl}" as "{PFX}T3_{lbl}"' for lbl in LABELS)
    + f', target as "{PFX}T3_target", dataset from wide', "spectra_long", extra=[("wide", _WIDE_SQL)]),
    [f"{PFX}T3_{lbl}" for lbl in LABELS] + [f"{PFX}T3_target"])
def q_prefix_columns(spark, sf):
    return schema.prefix_columns(_wide(spark, sf), f"{PFX}T3", keys=("sample_id", "dataset"))


_T2 = [f"{PFX}T2_{lbl}" for lbl in LABELS]


@register("scope_features_by_prefix", None if False else (
    "select position, " + ", ".join(f'"{c}"' for c in _T2) + f', "{PFX}T2_target" from ('
    + _merged_sql() + ") mm"), _T2 + [f"{PFX}T2_target"])
def q_scope_features(spark, sf):
    merged = _merged(spark, sf)
    target = f"{PFX}T2_target"
    feats = schema.scope_features_by_prefix(merged.columns, "T2", target)
    return merged.select("position", *[f"`{c}`" for c in feats], f"`{target}`")


# ---------------------------------------------------------------- alignment

def _upload(spark, sf):
    long = fx.spectra_long(spark, sf)
    kept = long.where(~F.col("band").isin(5, 6)).select(
        "dataset", "sample_id", F.col("wavelength").cast("int").cast("string").alias("label"), "value")
    extra = long.where(F.col("band") == 0).select("dataset", "sample_id", F.lit("9999").alias("label"), "value")
    return kept.unionByName(extra)


def _trained(spark):
    return fx.bands(spark).select("band", F.concat(F.lit(f"{PFX}T1_"), F.col("wavelength").cast("int").cast("string")).alias("label"))


_UPLOAD_SQL = [("upload", "select dataset, sample_id, cast(cast(wavelength as int) as varchar) as label, value "
                          "from spectra_long where band not in (5, 6) union all "
                          "select dataset, sample_id, '9999' as label, value from spectra_long where band = 0"),
               ("trained", f"select band, '{PFX}T1_' || cast(cast(wavelength as int) as varchar) as label from bands")]


@register("align_features", duck_with(
    "select u.dataset, u.sample_id, t.band, u.value from upload u join trained t "
    "on regexp_extract(u.label, '([0-9.]+)$', 1) = regexp_extract(t.label, '([0-9.]+)$', 1)",
    "spectra_long", extra=_UPLOAD_SQL), ["value"])
def q_align_features(spark, sf):
    aligned, _missing, _extra = schema.align_features(_upload(spark, sf), _trained(spark))
    return aligned.select("dataset", "sample_id", "band", "value")


@register("align_missing", duck_with(
    "select t.band, t.label from trained t where not exists (select 1 from upload u where "
    "regexp_extract(u.label, '([0-9.]+)$', 1) = regexp_extract(t.label, '([0-9.]+)$', 1))",
    "spectra_long", extra=_UPLOAD_SQL))
def q_align_missing(spark, sf):
    return schema.align_features(_upload(spark, sf), _trained(spark))[1]


@register("align_extra", duck_with(
    "select distinct u.label from upload u where not exists (select 1 from trained t where "
    "regexp_extract(u.label, '([0-9.]+)$', 1) = regexp_extract(t.label, '([0-9.]+)$', 1))",
    "spectra_long", extra=_UPLOAD_SQL))
def q_align_extra(spark, sf):
    return schema.align_features(_upload(spark, sf), _trained(spark))[2]


@register("add_missing_as_zero", duck_with(
    "select s.dataset, s.sample_id, b.band, coalesce(l.value, 0::double) as value "
    "from (select distinct dataset, sample_id from spectra_long) s cross join bands b "
    "left join (select * from spectra_long where band not in (5, 6)) l "
    "on l.dataset = s.dataset and l.sample_id = s.sample_id and l.band = b.band",
    "spectra_long"), ["value"])
def q_add_missing_as_zero(spark, sf):
    long = fx.spectra_long(spark, sf).where(~F.col("band").isin(5, 6))
    return schema.add_missing_as_zero(long, fx.bands(spark)).select("dataset", "sample_id", "band", "value")


# ---------------------------------------------------------------- run log

_PARSE_SQL = f"""
    select dataset, regexp_extract(line, '{files.RUN_LOG_PATTERN}', 1) as preprocessing,
      regexp_extract(line, '{files.RUN_LOG_PATTERN}', 2) as model,
      try_cast(regexp_extract(line, '{files.RUN_LOG_PATTERN}', 3) as double) as r2,
      try_cast(regexp_extract(line, '{files.RUN_LOG_PATTERN}', 4) as double) as rmse
    from run_log_lines"""


@register("parse_run_log", duck_with(
    f"select * from ({_PARSE_SQL}) p where r2 is not null and preprocessing <> ''", "run_log_lines"),
    ["r2", "rmse"])
def q_parse_run_log(spark, sf):
    return files.parse_run_log(fx.run_log_lines(spark, sf))


@register("best_from_log", duck_with(
    f"""select dataset, preprocessing, model, r2, rmse from (
      select *, row_number() over (partition by dataset order by r2 desc, rmse asc, preprocessing desc, model desc) as rn
      from ({_PARSE_SQL}) p where r2 is not null and preprocessing <> '') q where rn = 1""", "run_log_lines"),
    ["r2", "rmse"])
def q_best_from_log(spark, sf):
    return files.best_from_log(files.parse_run_log(fx.run_log_lines(spark, sf)))


# ---------------------------------------------------------------- files

_TAB_FLAT = ("select dataset, sample_id, spectrum[1] as f0, spectrum[2] as f1, spectrum[3] as f2, "
             "spectrum[4] as f3, target from tabular")


@register("scan_csv", duck_with(_TAB_FLAT, "tabular"), ["f0", "f1", "f2", "f3", "target"])
def q_scan_csv(spark, sf):
    flat = fx.tabular(spark, sf).select("dataset", "sample_id", *[F.col("spectrum")[i].alias(f"f{i}") for i in range(4)], "target")
    path = files.scratch_path(spark, "csv")
    flat.write.mode("overwrite").option("header", True).csv(path)
    return files.scan_csv(spark, path, "dataset STRING, sample_id BIGINT, f0 DOUBLE, f1 DOUBLE, f2 DOUBLE, f3 DOUBLE, target DOUBLE")


@register("discover_datasets", duck_with(_TAB_FLAT, "tabular"), ["f0", "f1", "f2", "f3", "target"])
def q_discover_datasets(spark, sf):
    flat = fx.tabular(spark, sf).select("dataset", "sample_id", *[F.col("spectrum")[i].alias(f"f{i}") for i in range(4)], "target")
    root = files.scratch_path(spark, "discover")
    flat.write.mode("overwrite").partitionBy("dataset").option("header", True).csv(root)
    df = files.discover_datasets(spark, f"{root}/*/*.csv",
                                 "sample_id BIGINT, f0 DOUBLE, f1 DOUBLE, f2 DOUBLE, f3 DOUBLE, target DOUBLE",
                                 pattern=r"dataset=([^/]+)/")
    return df.select("dataset", "sample_id", "f0", "f1", "f2", "f3", "target")


@register("write_predictions", duck_with("select * from oof", "oof"), ["y_true", "y_pred"])
def q_write_predictions(spark, sf):
    path = files.scratch_path(spark, "predictions")
    files.write_predictions(fx.oof(spark, sf), path)
    return spark.read.parquet(path).select("dataset", "preprocessing", "model", "fold", "sample_id", "y_true", "y_pred")
