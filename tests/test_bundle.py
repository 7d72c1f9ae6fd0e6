"""Bundles, the prediction path and leave-one-out over all bands."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import bundle as bu
from prismlake.sources import files


def spectra(spark, n=40, p=13, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0.1, 0.9, (n, p))
    y = 30 + x @ np.arange(p) + rng.normal(size=n) * 0.1
    return spark.createDataFrame([("A", i, x[i].tolist(), float(y[i])) for i in range(n)], "dataset string, sample_id long, spectrum array<double>, target double")


def bands(spark, p=13):
    return spark.createDataFrame([(i, 400.0 + 10 * i) for i in range(p)], "band int, wavelength double")


def wide(df, order, **more):
    return df.select("sample_id", *[F.col("spectrum")[i].alias(f"A_{400 + 10 * i}") for i in order], *[F.lit(v).alias(k) for k, v in more.items()])


@pytest.mark.parametrize("prep", sorted(bu.PREPS))
def test_upload_scores_like_the_training_rows(spark, prep):
    root = files.scratch_path(spark, "bundle")
    df = spectra(spark)
    assert bu.write_model_bundle(root, df, bands(spark), prep, "pls", '{"n_components": 3}') == 1
    loaded = bu.load_model_bundle(spark, root)
    whole = {r["sample_id"]: r["y_pred"] for r in bu.predict_spectra(df, loaded).collect()}
    part = bu.predict_wide(wide(df.where("sample_id < 3"), reversed(range(13)), note="x", B_999=1.0), loaded, "A")     # three rows alone
    got = {r["sample_id"]: r["y_pred"] for r in part.collect()}
    assert sorted(got) == [0, 1, 2] and all(abs(got[i] - whole[i]) < 1e-9 for i in got)


def test_predictions_follow_from_the_written_tables(spark):
    root = files.scratch_path(spark, "bundle")
    df = spectra(spark)
    bu.write_model_bundle(root, df, bands(spark), "Absorbance", "pls", '{"n_components": 4}')
    bad = wide(df.where("sample_id < 4"), range(13)).withColumn("A_450", F.when(F.col("sample_id") == 1, None).when(
        F.col("sample_id") == 2, float("inf")).when(F.col("sample_id") == 3, 0.0).otherwise(F.col("A_450")))
    got = bu.predict_wide(bad, bu.load_model_bundle(spark, root), "A").toPandas()
    rows = bad.toPandas()
    con = duckdb.connect()
    con.register("rows", rows)
    columns = ", ".join(f'"A_{400 + 10 * i}"' for i in range(13))
    folder = f"{root}/version=1".removeprefix("file:")
    want = con.execute(f"""select sample_id, greatest(m.intercept + list_sum(list_transform(range(1, 14), lambda i: m.coef[i] * -log10(
        case when x[i] is null or not isfinite(x[i]) then s.raw_median[i] when x[i] = 0 then 1e-6 else x[i] end))), 0.001) as y_pred
        from (select sample_id, [{columns}] as x from rows) r, '{folder}/model/*.parquet' m, '{folder}/state/*.parquet' s""").df()
    assert np.abs(got.sort_values("sample_id")["y_pred"].to_numpy() - want.sort_values("sample_id")["y_pred"].to_numpy()).max() < 1e-9


def test_versions_missing_bands_and_unknown_transforms(spark):
    root = files.scratch_path(spark, "bundle")
    df = spectra(spark)
    with pytest.raises(FileNotFoundError):
        bu.load_model_bundle(spark, root)
    bu.write_model_bundle(root, df, bands(spark), "snv", "ols")
    assert bu.write_model_bundle(root, df, bands(spark), "msc", "krr", '{"alpha": 1.0, "kernel": "linear"}') == 2
    assert bu.load_model_bundle(spark, root).model.first()["preprocessing"] == "msc"
    assert bu.load_model_bundle(spark, root, 1).model.first()["model"] == "ols"
    with pytest.raises(ValueError, match="misses 2 of 13 bands: 450, 500"):
        bu.predict_wide(wide(df, [i for i in range(13) if i not in (5, 10)]), bu.load_model_bundle(spark, root), "A")
    with pytest.raises(ValueError, match="cannot hold"):
        bu.write_model_bundle(root, df, bands(spark), "hull_removal")


def test_leave_one_out_equals_refits(spark, monkeypatch):
    from prismlake.operators import linear as L
    from prismlake.operators.gram import Moments
    from prismlake.plans import selection as sel

    df = spectra(spark, n=60).unionByName(spectra(spark, n=25, seed=7).withColumn("dataset", F.lit("B"))).unionByName(
        spectra(spark, n=2, seed=8).withColumn("dataset", F.lit("C")))
    bad = df.limit(1).select("dataset", F.lit(999).cast("long").alias("sample_id"), F.array_repeat(F.lit(None).cast("double"), 13).alias("spectrum"), "target")
    for n_components, limit in ((1, 1 << 27), (4, 1), (13, 1 << 27)):
        monkeypatch.setattr(sel, "LOO_BYTES", limit)
        got = sel.loo_pls(df.unionByName(bad), n_components).toPandas()
        for name, part in got.groupby("dataset"):
            pdf = df.where(F.col("dataset") == name).toPandas()
            z = np.column_stack([np.stack(pdf["spectrum"]), pdf["target"]])
            for sample, guess in zip(part["sample_id"], part["y_pred"]):
                if name == "C" or sample == 999:
                    assert np.isnan(guess)
                    continue
                rest = z[(pdf["sample_id"] != sample).to_numpy()]
                m = Moments(len(rest), rest.mean(0), (rest - rest.mean(0)).T @ (rest - rest.mean(0)))
                b0, coef = L.pls1_path(m, n_components)[-1]
                assert abs(guess - b0 - z[(pdf["sample_id"] == sample).to_numpy()][0, :-1] @ coef) < 1e-6
