"""Ordinals at volume, ANSI edge cases, and rules that must not drop or replace data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("shuffled", [False, True])
def test_ordinals_and_folds_at_volume(spark, tmp_path, shuffled):
    from prismlake.functions.distributed import with_ordinal
    from prismlake.operators.evaluate import kfold_assign

    n = 400_000
    rows = spark.range(0, n, 1, 6).select(
        F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("dataset"), F.col("id").alias("sample_id"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")).alias("target"),
        F.array_repeat(F.col("id").cast("double"), 4).alias("spectrum"))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    if shuffled:
        rows = rows.repartition(7)
    for order in (["sample_id"], ["target", "sample_id"]):
        got = with_ordinal(rows, order, group="dataset", name="pos").groupBy("dataset").agg(
            F.count("pos"), F.countDistinct("pos"), F.min("pos"), F.max("pos")).collect()
        assert all(c == d == hi and lo == 1 for _, c, d, lo, hi in got) and sum(r[1] for r in got) == n
    folds = kfold_assign(rows).groupBy("dataset", "fold").count().groupBy("dataset").agg(
        F.min("fold"), F.max("fold"), F.max("count") - F.min("count")).collect()
    assert all((lo, hi) == (0, 4) and spread <= 1 for _, lo, hi, spread in folds)


def test_runs_with_ansi_on(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def spectra(spark, rows):
    return spark.createDataFrame([(d, i, x, y) for d, i, x, y in rows], "dataset string, sample_id long, spectrum array<double>, target double")


def test_constant_targets_and_two_samples(spark):
    from prismlake.operators import clean, profile, targets, transforms

    same = spectra(spark, [("c", i, [1.0, 2.0, 4.0, 3.0], 7.0) for i in range(6)] + [("two", i, [1.0, 2.0, 0.0, 3.0], float(i)) for i in range(2)])
    for frame in (profile.z_outlier_counts(same), profile.target_skew_unbiased(same), profile.kde_curve(same), profile.histogram(same, "target"),
                  targets.skew_before_after(targets.target_log1p(same)), clean.filter_z_outliers(same), transforms.prep_msc(same)):
        frame.collect()


def test_malformed_log_lines_are_dropped(spark):
    from prismlake.sources.files import parse_run_log

    lines = spark.createDataFrame([("a_pls: R2=0.5, RMSE=1.25",), ("a_pls: R2=0.5",), ("",), (None,), ("x: R2=, RMSE=",)], "line string")
    assert [tuple(r) for r in parse_run_log(lines).collect()] == [("a", "pls", 0.5, 1.25)]


def test_neighbour_fill_crosses_empty_chunks(spark):
    from prismlake.operators.clean import zero_fill_neighbors

    values = [0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 7.0, 0.0]
    rows = spectra(spark, [("a", i, [v], 1.0) for i, v in enumerate(values)])
    got = [r["spectrum"][0] for r in zero_fill_neighbors(rows, chunk_span=2).orderBy("sample_id").collect()]
    assert got == [5.0] * 6 + [7.0] * 2


def test_neighbour_fill_is_linear_and_keeps_every_row(spark, monkeypatch, capsys):
    from prismlake.operators import clean

    rng = np.random.default_rng(3)
    data = [(d, int(i), [None if r < 0.2 else 0.0 if r < 0.5 else float(r) for r in rng.random(3 + i % 2)], float(i))
            for d in "ab" for i in rng.permutation(60) * 1_000_003]
    want = {}
    for d in "ab":
        mine = sorted((r for r in data if r[0] == d), key=lambda r: r[1])
        for band in range(4):
            known = [(r[1], r[2][band] or None) for r in mine if len(r[2]) > band]
            for k, (i, _) in enumerate(known):
                before, after = [v for _, v in known[:k + 1] if v], [v for _, v in known[k:] if v]
                want.setdefault((d, i), []).append(before[-1] if before else after[0] if after else None)
    rows = spectra(spark, data)
    monkeypatch.setattr(clean, "FILL_VALUES", 40)
    for span in (None, 4_000_000, 1 << 40):
        filled = clean.zero_fill_neighbors(rows, span)
        assert {(r["dataset"], r["sample_id"]): r["spectrum"] for r in filled.collect()} == want
        assert [r["target"] for r in filled.orderBy("dataset", "sample_id").collect()] == [r[3] for r in sorted(data, key=lambda r: r[:2])]
    twice = clean.zero_fill_neighbors(rows.unionAll(rows.where("sample_id = 0")))
    assert twice.count() == len(data) + 2 and all(3 <= len(r["spectrum"]) <= 4 for r in twice.collect())
    # a frame from the row to the end is added up anew for each row
    filled.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_power_transform_finds_a_maximum_beyond_two(spark):
    from prismlake.operators.targets import power_lambdas

    y = (1 + np.random.default_rng(0).normal(0, 0.2, 400).clip(-0.9)) ** (1 / 5.5) * 3
    rows = spectra(spark, [("a", i, [1.0], float(v)) for i, v in enumerate(y)])
    lam = power_lambdas(rows).first()["lambda"]
    llf = lambda k: (k - 1) * np.log(y).sum() - len(y) / 2 * math.log(np.var((y ** k - 1) / k))
    assert lam > 3 and all(llf(lam) >= llf(lam + d) - 1e-6 for d in (-0.05, -0.01, 0.01, 0.05))


def test_power_grid_is_summed_in_batches(spark, capsys):
    from prismlake.operators import targets

    rng = np.random.default_rng(5)
    data = {"a": rng.normal(0, 3, 500), "b": 1e6 + rng.random(300), "c": np.full(40, 2.7), "d": np.array([-1.5])}
    base = spark.createDataFrame([(d, float(v)) for d, y in data.items() for v in y] + [(None, 1.0)], "dataset string, target double").repartition(7)
    settings = {"a": ("yeo-johnson", 0.0, 0.1), "b": ("box-cox", 0.0, 0.1), "c": ("box-cox", 1.0, 0.01), "d": ("yeo-johnson", 2.0, 0.1)}
    found = targets._grid_variances(base, settings)
    got = {(r["dataset"], r["k"]): (r["lam"], r["var_t"]) for r in found.collect()}
    assert len(got) == 4 * targets.GRID_POINTS
    for d, (method, center, step) in settings.items():
        for k in range(targets.GRID_POINTS):
            lam = center + (k - 20) * step
            values = spark.createDataFrame([(float(v),) for v in data[d]], "y double") if k in (0, 20, 33) else None
            assert got[d, k][0] == lam
            if values is not None:
                t = targets._transform(F.lit(method), F.col("y"), F.lit(lam))
                want = values.agg(F.var_pop(t)).first()[0]
                assert math.isclose(got[d, k][1], want, rel_tol=1e-6, abs_tol=1e-25)
    # rows are not multiplied by the grid's points before they are added up
    found.explain()
    assert "Generate" not in capsys.readouterr().out
    lams = {r["dataset"]: r["lambda"] for r in targets.power_lambdas(base).collect() if r["dataset"]}
    assert set(lams) == set(data) and lams["c"] == 1.0 and lams["d"] == 1.0


def test_parameters_off_the_grid_are_used(spark):
    from prismlake.operators.predict import fit_linear

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 12))
    y = x @ rng.normal(size=12)
    rows = spectra(spark, [("a", i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))])
    ten = fit_linear(rows, "pls", '{"n_components": 10}').first()
    two = fit_linear(rows, "pls", '{"n_components": 2}').first()
    error = lambda r: np.abs(r["intercept"] + x @ np.array(r["coef"]) - y).max()
    assert ten["params"] == '{"n_components": 10}' and error(ten) < error(two) / 2


def test_failed_folds_keep_their_rows(spark):
    from prismlake.plans.selection import cross_validate

    rows = spectra(spark, [("a", i, [float(i), float(i * i)], float(i)) for i in range(2)])
    oof, _ = cross_validate(rows, ["Reflectance"], ["ols"], registry={"Reflectance": lambda df: df})
    got = oof.collect()
    assert len(got) == 2 and all(r["y_pred"] is None for r in got)


def test_short_spectra_and_nulls_in_filters(spark):
    from prismlake.operators.transforms import prep_sg_smooth

    rows = spectra(spark, [("a", 1, [1.0] * 5, 1.0), ("a", 2, None, 1.0), ("a", 3, [1.0, None] + [float(i) for i in range(14)], 1.0)])
    got = {r["sample_id"]: r["spectrum"] for r in prep_sg_smooth(rows).collect()}
    assert got[1] is None and got[2] is None and got[3][:7] == [None] * 7 and None not in got[3][7:]


def test_leaderboard_lists_all_combinations(spark):
    from prismlake.operators.evaluate import leaderboard_r2

    rows = [("a", f"p{k}", "m", f, i, float(i), i + 0.1 * k) for k in range(20) for f in range(2) for i in range(f, 10, 2)]
    oof = spark.createDataFrame(rows, "dataset string, preprocessing string, model string, fold int, sample_id long, y_true double, y_pred double")
    assert leaderboard_r2(oof).count() == 20 and leaderboard_r2(oof, 15).count() == 15


def test_fixed_set_runs_its_models_side_by_side(spark, monkeypatch):
    import threading

    from prismlake.plans import q_models

    both = threading.Barrier(2, timeout=60)

    def run(rows, k):
        both.wait()                                        # breaks if the hold-out waits for the cross-validation
        return rows.where(f"fold < {k}").selectExpr("dataset", "preprocessing", "fold", "sample_id", "target as y_true", "target + 1 as y_pred")
    monkeypatch.setattr(q_models, "_fixed_set", lambda: {"shifted": run})
    got = q_models.q_model_fixed_set(spark, "/root/testdata/sf0.001").collect()
    assert got and all(abs(r["cv_rmse"] - 1) < 1e-12 and abs(r["holdout_rmse"] - 1) < 1e-12 for r in got)
