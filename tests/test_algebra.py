"""Invariants for operators checked rows-only by the driver."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def _spectra_df(spark, X, y=None, dataset="D"):
    rows = [(dataset, i, [float(v) for v in X[i]], float(y[i]) if y is not None else 0.0) for i in range(len(X))]
    return spark.createDataFrame(rows, "dataset STRING, sample_id BIGINT, spectrum ARRAY<DOUBLE>, target DOUBLE")


def test_savgol_exact_on_quadratics(spark):
    from prismlake.operators.transforms import prep_sg
    x = np.arange(30, dtype=float)
    q = 0.5 * x ** 2 - 3 * x + 7
    df = _spectra_df(spark, [q])
    for d, want in [(0, q), (1, x - 3), (2, np.ones_like(x))]:
        got = np.array(prep_sg(df, d).first()["spectrum"])
        assert np.allclose(got, want, atol=1e-8)


def test_snv_properties(spark):
    from prismlake.operators.transforms import prep_snv
    rng = np.random.default_rng(0)
    X = rng.random((5, 20))
    a = np.array(prep_snv(_spectra_df(spark, X)).orderBy("sample_id").select("spectrum").toPandas()["spectrum"].tolist())
    assert np.allclose(a.mean(axis=1), 0) and np.allclose(a.std(axis=1), 1)
    b = np.array(prep_snv(_spectra_df(spark, 3 * X + 2)).orderBy("sample_id").select("spectrum").toPandas()["spectrum"].tolist())
    assert np.allclose(a, b)
    flat = prep_snv(_spectra_df(spark, [np.full(8, 0.5)])).first()["spectrum"]   # exactly representable level
    assert all(v == 0 for v in flat)


def test_msc_of_affine_mean_returns_mean(spark):
    from prismlake.operators.transforms import prep_msc
    rng = np.random.default_rng(1)
    base = rng.random(16)
    X = np.array([2 * base + 1, 0.5 * base - 0.2, base])
    m = X.mean(axis=0)
    out = np.array(prep_msc(_spectra_df(spark, X)).orderBy("sample_id").select("spectrum").toPandas()["spectrum"].tolist())
    assert np.allclose(out, m[None, :], atol=1e-10)


def test_hull_removal_bounds(spark):
    from prismlake.operators.transforms import prep_hull_removal, upper_hull
    rng = np.random.default_rng(2)
    X = rng.random((20, 30)) + 0.1
    wl = list(np.cumsum(rng.integers(5, 30, 30)).astype(float))
    out = np.array(prep_hull_removal(_spectra_df(spark, X), wl).orderBy("sample_id").select("spectrum").toPandas()["spectrum"].tolist())
    assert (out <= 1 + 1e-12).all() and np.allclose(out[:, 0], 1) and np.allclose(out[:, -1], 1)
    # brute-force max-chord definition of the upper hull
    H = upper_hull(np.array(wl), X)
    for r in range(3):
        for k in range(30):
            best = max(X[r, i] + (X[r, j] - X[r, i]) * (wl[k] - wl[i]) / (wl[j] - wl[i]) if i != j else X[r, k]
                       for i in range(k + 1) for j in range(k, 30) if i < j or i == j == k)
            assert abs(best - H[r, k]) < 1e-12


def test_pls_full_rank_equals_ols():
    from prismlake.operators.gram import Moments
    from prismlake.operators.linear import ols, pls1_path
    rng = np.random.default_rng(3)
    X = rng.random((60, 6))
    y = X @ rng.random(6) + rng.normal(0, 0.1, 60)
    Z = np.column_stack([X, y])
    g = np.concatenate([[60], Z.sum(0), (Z.T @ Z).ravel()])
    m = Moments.from_packed(g, 7)
    b0, b = ols(m)
    c0, c = pls1_path(m, 6)[-1]
    assert np.allclose(b, c, atol=1e-8) and abs(b0 - c0) < 1e-8


def test_pls_one_component_matches_nipals():
    from prismlake.operators.gram import Moments
    from prismlake.operators.linear import pls1_path
    rng = np.random.default_rng(4)
    X = rng.random((40, 5))
    y = X[:, 0] * 3 + rng.normal(0, 0.1, 40)
    Xs = (X - X.mean(0)) / X.std(0, ddof=1)
    ys = (y - y.mean()) / y.std(ddof=1)
    w = Xs.T @ ys
    w /= np.linalg.norm(w)
    t = Xs @ w
    pred = y.mean() + y.std(ddof=1) * t * (t @ ys) / (t @ t)
    Z = np.column_stack([X, y])
    m = Moments.from_packed(np.concatenate([[40], Z.sum(0), (Z.T @ Z).ravel()]), 6)
    b0, b = pls1_path(m, 1)[0]
    assert np.allclose(b0 + X @ b, pred, atol=1e-10)


def test_fold_subtraction_equals_direct():
    from prismlake.operators.gram import Moments
    rng = np.random.default_rng(5)
    Z = rng.random((30, 4))
    pack = lambda A: Moments.from_packed(np.concatenate([[len(A)], A.sum(0), (A.T @ A).ravel()]), 4)
    d = pack(Z) - pack(Z[:10])
    e = pack(Z[10:])
    assert np.isclose(d.n, e.n) and np.allclose(d.mean, e.mean) and np.allclose(d.cov_ss, e.cov_ss)


def test_press_equals_brute_force_loo(spark):
    from prismlake.plans.selection import loo_linear
    rng = np.random.default_rng(6)
    X = rng.random((25, 3))
    y = X @ np.array([1.0, -2.0, 0.5]) + rng.normal(0, 0.1, 25)
    got = loo_linear(_spectra_df(spark, X, y)).orderBy("sample_id").toPandas()["y_pred"].to_numpy()
    want = []
    for i in range(25):
        keep = np.arange(25) != i
        A = np.column_stack([np.ones(24), X[keep]])
        beta = np.linalg.lstsq(A, y[keep], rcond=None)[0]
        want.append(beta[0] + X[i] @ beta[1:])
    assert np.allclose(got, want, atol=1e-9)


def test_loo_null_below_three_samples(spark):
    from prismlake.plans.selection import loo_linear, loo_metrics
    df = _spectra_df(spark, [[0.1, 0.2], [0.3, 0.1]], [1.0, 2.0])
    m = loo_metrics(loo_linear(df)).collect()
    assert all(r["r2"] is None and r["rmse"] is None for r in m)


def test_exact_quantiles_selection_path(spark):
    from prismlake.functions.distributed import group_quantiles
    rng = np.random.default_rng(7)
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(np.round(rng.normal(size=3000), 3))]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    probs = {"q1": 0.25, "med": 0.5, "q9": 0.9}
    sel = {r["g"]: r for r in group_quantiles(df, ["g"], "v", probs, max_buffer=50, buckets=16, force_selection=True).collect()}
    for g in ["a", "b"]:
        vals = np.array([v for k, v in rows if k == g])
        for name, p in probs.items():
            assert abs(sel[g][name] - np.quantile(vals, p)) < 1e-12


def test_ordinal_and_top_k(spark):
    from prismlake.functions.distributed import top_k_per_group, with_ordinal
    df = spark.range(0, 997).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    o = with_ordinal(df, ["v"], group="g", name="pos").toPandas()
    for g, part in o.groupby("g"):
        assert list(part.sort_values("v")["pos"]) == list(range(1, len(part) + 1))
    t = top_k_per_group(df, ["g"], [F.desc("v")], 4, salt_buckets=7).toPandas()
    for g, part in t.groupby("g"):
        want = sorted(o[o.g == g]["v"], reverse=True)[:4]
        assert sorted(part["v"], reverse=True) == want


def test_norm_ppf_matches_stdlib(spark):
    from prismlake.functions.normal import norm_ppf
    ps = [1e-12, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p DOUBLE").select(norm_ppf(F.col("p")).alias("z")).toPandas()["z"]
    nd = statistics.NormalDist()
    assert all(abs(g - nd.inv_cdf(p)) < 1e-12 for g, p in zip(got, ps))


def test_pooled_rpd_and_r2_orders_agree(spark):
    from prismlake.operators.evaluate import regression_metrics
    from prismlake.sources.fixtures import oof
    m = regression_metrics(oof(spark, SF_SMALL)).toPandas()
    assert np.allclose(m["rpd"], 1 / np.sqrt(1 - m["r2"]))


def test_permutation_importance_unused_band_is_zero(spark):
    from prismlake.plans.selection import permutation_importance
    rng = np.random.default_rng(8)
    X = rng.random((50, 3))
    y = 2 * X[:, 0] + 0.01 * rng.normal(size=50)
    df = _spectra_df(spark, X, y)
    coefs = spark.createDataFrame([("D", 0.0, [2.0, 0.0, 0.0])], "dataset STRING, intercept DOUBLE, coef ARRAY<DOUBLE>")
    imp = {r["band"]: r["importance_mean"] for r in permutation_importance(df, coefs, n_repeats=5).collect()}
    assert imp[1] == 0 and imp[2] == 0 and imp[0] > 0.5


def test_cv_constant_target_has_null_r2(spark):
    from prismlake.operators.evaluate import regression_metrics
    rows = [("D", "p", "m", i % 5, i, 3.0, 3.0 + 0.1 * (i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "dataset STRING, preprocessing STRING, model STRING, fold INT, sample_id BIGINT, y_true DOUBLE, y_pred DOUBLE")
    r = regression_metrics(df).first()
    assert r["r2"] is None and r["rpd"] is not None and r["rpd"] == 0


def test_boxcox_lambda_is_likelihood_max_and_inverts(spark):
    from prismlake.operators.targets import power_transform
    rng = np.random.default_rng(9)
    y = np.exp(rng.normal(1.0, 0.5, 400))
    df = spark.createDataFrame([("D", i, float(v)) for i, v in enumerate(y)], "dataset STRING, sample_id BIGINT, target DOUBLE")
    out = power_transform(df, "box-cox", standardize=False).toPandas()
    lam = out["lambda"].iloc[0]

    def llf(l):
        t = np.log(y) if abs(l) < 1e-12 else (y ** l - 1) / l
        return (l - 1) * np.log(y).sum() - len(y) / 2 * np.log(t.var())
    assert llf(lam) >= max(llf(lam - 1e-3), llf(lam + 1e-3))
    t = out.sort_values("sample_id")["y_power"].to_numpy()
    back = np.exp(t) if abs(lam) < 1e-12 else (t * lam + 1) ** (1 / lam)
    assert np.allclose(back, y)


def test_yeojohnson_chosen_for_non_positive(spark):
    from prismlake.operators.targets import power_transform
    df = spark.createDataFrame([("D", i, float(v)) for i, v in enumerate(np.linspace(-3, 9, 50))],
                               "dataset STRING, sample_id BIGINT, target DOUBLE")
    out = power_transform(df, "auto").toPandas()
    assert (out["method"] == "yeo-johnson").all()
    assert abs(out["y_power"].mean()) < 1e-9 and abs(out["y_power"].std(ddof=0) - 1) < 1e-9


def test_quantile_normal_is_monotone_and_centered(spark):
    from prismlake.operators.targets import target_quantile_normal
    rng = np.random.default_rng(10)
    y = rng.gamma(2.0, size=301)
    df = spark.createDataFrame([("D", i, float(v)) for i, v in enumerate(y)], "dataset STRING, sample_id BIGINT, target DOUBLE")
    out = target_quantile_normal(df).toPandas().sort_values("target")
    z = out["y_qnormal"].to_numpy()
    assert (np.diff(z) > 0).all() and abs(np.median(z)) < 1e-9


def test_isolation_share_and_planted_outliers(spark):
    from prismlake.operators.isolation import isolation_outliers
    rng = np.random.default_rng(13)
    X = rng.normal(0, 1, (300, 4))
    X[:5] += 8.0
    out = isolation_outliers(_spectra_df(spark, X, np.zeros(300)), n_trees=50).toPandas()
    share = out["is_outlier"].mean()
    assert abs(share - 0.1) <= 0.01
    assert out.sort_values("sample_id")["is_outlier"].iloc[:5].all()


def test_loo_pls_downdate_equals_refit(spark):
    from prismlake.operators.gram import Moments
    from prismlake.operators.linear import pls1_path
    from prismlake.plans.selection import loo_pls
    rng = np.random.default_rng(14)
    X = rng.random((30, 6))
    y = X @ rng.random(6) + rng.normal(0, 0.05, 30)
    got = loo_pls(_spectra_df(spark, X, y), 3).orderBy("sample_id").toPandas()["y_pred"].to_numpy()
    want = []
    for i in range(30):
        keep = np.arange(30) != i
        Z = np.column_stack([X[keep], y[keep]])
        m = Moments.from_packed(np.concatenate([[29], Z.sum(0), (Z.T @ Z).ravel()]), 7)
        b0, b = pls1_path(m, 3)[2]
        want.append(b0 + X[i] @ b)
    assert np.allclose(got, want, atol=1e-8)


def test_all_bands_queries_use_the_whole_spectrum(spark):
    """Leave-one-out = one refit per row on 64 bands; predictions = the SQL dot product of the
    coefficients in the written bundle."""
    import duckdb

    from prismlake.plans.catalog import all_queries
    from prismlake.sources import fixtures as fx

    run = lambda name: all_queries()[f"{name}_all_bands"].spark(spark, SF_SMALL).toPandas()
    spectra = fx.spectra(spark, SF_SMALL).toPandas()
    bundle, pred = run("write_model_bundle"), run("batch_predict")
    assert set(bundle["coef"].map(len)) == {fx.N_BANDS} and len(pred) == len(spectra)
    con = duckdb.connect()
    for name, frame in {"spectra": spectra, "bundle": bundle}.items():
        con.register(name, frame)
    want = con.execute("""select sample_id, greatest(intercept + list_dot_product(spectrum, coef), 0.001) as y_pred
        from spectra join bundle using (dataset) order by sample_id""").df()["y_pred"]
    assert np.allclose(pred.sort_values("sample_id")["y_pred"], want, atol=1e-6)
    assert np.allclose(run("stream_batch_predict").sort_values("sample_id")["y_pred"], want, atol=1e-6)
    loo = run("loo_predictions").set_index("sample_id")["y_pred"]
    first = spectra[spectra["dataset"] == "T1"]
    X = np.column_stack([np.ones(len(first)), np.stack(first["spectrum"].to_list())])
    y = first["target"].to_numpy()
    for i in range(5):
        beta = np.linalg.lstsq(np.delete(X, i, 0), np.delete(y, i), rcond=None)[0]
        assert abs(loo[first["sample_id"].iloc[i]] - X[i] @ beta) < 1e-4
