"""Kernel ridge and SVR against their dual problems, and task against Spark passes."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import kernel as ke
from prismlake.operators import svr as sv


def frame(spark, n=45, p=4, seed=3, datasets=("A",)):
    rng = np.random.default_rng(seed)
    rows = []
    for d in datasets:
        x = rng.uniform(size=(n, p))
        y = 2 + np.sin(4 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(size=n) * 0.05
        rows += [(d, "none", i, i * 7 % 3, i // 3 % 2, x[i].tolist(), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, preprocessing string, sample_id long, fold int, inner int, spectrum array<double>, target double")


def table(df):
    pdf = df.toPandas().sort_values("sample_id")
    return np.stack(pdf["spectrum"]), pdf["target"].to_numpy(), pdf["fold"].to_numpy(), pdf["inner"].to_numpy()


def gram(name, a, b, gamma, degree, p):
    gamma = 1 / p if gamma is None else gamma
    if name == "rbf":
        return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(2))
    return (gamma * a @ b.T + 1) ** degree if name == "polynomial" else a @ b.T


def dual(name, gamma, degree, alpha, x, y, held):
    k = gram(name, x, x, gamma, degree, x.shape[1])
    return gram(name, held, x, gamma, degree, x.shape[1]) @ np.linalg.solve(k + alpha * np.eye(len(x)), y)


def test_kernel_ridge_equals_the_dual_solution_and_choice(spark):
    df = frame(spark)
    x, y, fold, inner = table(df)
    grid = {"alpha": [0.1, 1.0], "kernel": ["rbf", "polynomial", "linear"], "gamma": [None, 0.1], "degree": [2, 3]}
    oof, models = ke.cv_krr(df, grid, k=3, inner_k=2, refit=True, m=45)
    got, chosen = oof.toPandas().sort_values("sample_id"), {r["fold"]: r for r in models.collect()}
    points = list(itertools.product(ke.kernels(grid), grid["alpha"]))
    assert len(ke.kernels(grid)) == 7 and sorted(chosen) == [-1, 0, 1, 2]
    for f in (-1, 0, 1, 2):
        scores = []
        for k, alpha in points:
            rmse = []
            for j in range(2):
                train, val = (fold != f) & (inner != j), (fold != f) & (inner == j)
                rmse.append(np.sqrt(((dual(k.name, k.gamma, k.degree, alpha, x[train], y[train], x[val]) - y[val]) ** 2).mean()))
            scores.append(np.mean(rmse))
        best = int(np.argmin(scores))
        k, alpha = points[best]
        params = json.loads(chosen[f]["params"])
        assert abs(chosen[f]["inner_rmse"] - scores[best]) < 1e-7
        assert params == {"alpha": alpha, **k.params(), "landmarks": 45, "rank": 45 if k.name != "linear" else 4} or k.name == "polynomial"
        if f >= 0:
            want = dual(k.name, k.gamma, k.degree, alpha, x[fold != f], y[fold != f], x[fold == f])
            assert np.abs(got["y_pred"].to_numpy()[fold == f].astype(float) - want).max() < 1e-6


@pytest.mark.parametrize("name, gamma, degree", [("linear", None, 3), ("rbf", 0.5, 3), ("polynomial", 0.3, 2), ("polynomial", None, 3)])
def test_each_kernel_with_all_landmarks_is_exact(spark, name, gamma, degree):
    df = frame(spark)
    x, y, fold, _ = table(df)
    oof, _ = ke.cv_krr(df, {"alpha": [0.5], "kernel": [name], "gamma": [gamma], "degree": [degree]}, k=3, m=100)
    got = oof.toPandas().sort_values("sample_id")["y_pred"].to_numpy(float)
    for f in range(3):
        assert np.abs(got[fold == f] - dual(name, gamma, degree, 0.5, x[fold != f], y[fold != f], x[fold == f])).max() < 1e-6


def test_few_landmarks_come_close_and_say_their_rank(spark):
    df = frame(spark, n=90)
    x, y, fold, _ = table(df)
    oof, models = ke.cv_krr(df, {"alpha": [0.1], "kernel": ["rbf"], "gamma": [0.5], "degree": [2]}, k=3, m=20)
    got = oof.toPandas().sort_values("sample_id")["y_pred"].to_numpy(float)
    for f in range(3):
        exact = dual("rbf", 0.5, 2, 0.1, x[fold != f], y[fold != f], x[fold == f])
        assert np.abs(got[fold == f] - exact).mean() < 0.1 * y.std()
    assert {json.loads(r["params"])["landmarks"] for r in models.collect()} == {20}


def dual_svr(k, y, C, eps, steps=200_000):
    """The dual problem by pairwise coordinate steps: multipliers in [-C, C] that sum to 0."""
    a, g = np.zeros(len(y)), -y.copy()                 # gradient of 1/2 a'Ka - y'a, without the eps term
    for _ in range(steps):
        up, down = np.where(a < C, g + np.where(a >= 0, eps, -eps), np.inf), np.where(a > -C, g + np.where(a > 0, eps, -eps), -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if down[j] - up[i] < 1e-10:
            break
        q = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        t = (down[j] - up[i]) / q
        t = min(t, C - a[i] if a[i] >= 0 else -a[i], a[j] if a[j] > 0 else C + a[j])
        a[i] += t
        a[j] -= t
        g += t * (k[:, i] - k[:, j])
    return a, (up.min() + down.max()) / -2


def test_svr_equals_the_dual_problem(spark):
    df = frame(spark)
    x, y, fold, _ = table(df)
    got = sv.cv_svr(df, {"C": [5.0], "epsilon": [0.1], "gamma": ["auto"]}, k=3, m=100).toPandas().sort_values("sample_id")
    assert got["kkt"].max() <= 1e-6
    for f in range(3):
        train = fold != f
        a, b = dual_svr(gram("rbf", x[train], x[train], None, 3, 4), y[train], 5.0, 0.1)
        want = gram("rbf", x[~train], x[train], None, 3, 4) @ a + b
        assert np.abs(got["y_pred"].to_numpy(float)[~train] - want).max() < 1e-4


def test_svr_grid_in_tasks_and_on_spark(spark):
    df = frame(spark, n=40, datasets=("A",)).repartition(3)
    grid = {"C": [1.0, 20.0], "epsilon": [0.05], "gamma": ["scale"]}
    a, b = (sv.cv_svr(df, grid, k=3, inner_k=2, m=8, local_rows=n).toPandas().sort_values("sample_id").reset_index(drop=True) for n in (1000, 10))
    assert a["params"].tolist() == b["params"].tolist() and max(a["kkt"].max(), b["kkt"].max()) <= 1e-6
    assert np.abs(a["y_pred"].astype(float) - b["y_pred"].astype(float)).max() < 1e-4
    assert np.abs(a["inner_rmse"] - b["inner_rmse"]).max() < 1e-4


def test_rows_that_cannot_be_used(spark):
    df = frame(spark, n=30)
    bad = df.limit(2).select("dataset", "preprocessing", (F.col("sample_id") + 100).alias("sample_id"), "fold", "inner",
                             F.array_repeat(F.lit(float("nan")), 4).alias("spectrum"), "target")
    one = df.where("sample_id = 0").withColumn("dataset", F.lit("B"))
    both = df.unionByName(bad).unionByName(one)
    oof, _ = ke.cv_krr(both, {"alpha": [1.0], "kernel": ["rbf"], "gamma": [None], "degree": [2]}, k=3)
    for got in (oof, sv.cv_svr(both, sv.FIXED, k=3)):
        rows = {(r["dataset"], r["sample_id"]): r["y_pred"] for r in got.collect()}
        assert len(rows) == 31 and [k for k, v in rows.items() if v is None] == [("B", 0)]


def test_svr_fits_of_a_task_share_their_rows_and_stop_at_the_length_taken():
    import tracemalloc

    from prismlake.operators import svr

    rng = np.random.default_rng(1)
    n, q = 3000, 20
    x, y, fold, inner = rng.normal(size=(n, q)), rng.normal(size=n), np.arange(n) % 5, np.arange(n) // 5 % 3
    fits = svr._fits(svr.GRID, [0], 3)
    tracemalloc.start()
    sums = svr._in_memory(fits, [x, 2 * x], y, fold, inner)
    assert tracemalloc.get_traced_memory()[1] < 6 * x.nbytes               # not a copy for each of 72 fits
    tracemalloc.stop()
    v = rng.normal(size=q + 1)
    for i in (0, 1, 40):
        f, at = fits[i], fits[i].used(fold, inner)
        u = np.column_stack([np.ones(n), (x, 2 * x)[f.kernel]])[at]
        d, slope, objective, norm = svr.direction(svr.newton_sums(u, y[at], f, v, 0.1, 0.1), v, 0.1)
        got = sums([(i, v, 0.1, 0.1)], "newton")[0]
        assert np.allclose(got[0], d, rtol=1e-8) and np.isclose(got[2], objective)
        whole = svr.step_losses(u, y[at], f, v, d, 0.1)
        short = sums([(i, v, d, 0.1, objective, slope)], "length")[0]
        assert svr.pick_length(short, v, d, objective, slope) == svr.pick_length(whole, v, d, objective, slope)
        assert np.allclose(short[np.isfinite(short)], whole[np.isfinite(short)])
        assert np.allclose(sums([(i, v, None, 0.1)], "kkt")[0], svr.violations(u, y[at], f, v, 0.1))


def test_interior_points_reach_the_optimum_where_newton_steps_do_not():
    """A strong C on thousands of rows: rounding the kink ended with a violation of 0.02 and more."""
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(6000, 6))
    y = 30 + 3 * np.sin(5 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(size=len(x))
    phi = ke.Landmarks(x[:60]).features(ke.Kernel("rbf", "scale"), x)
    u = np.column_stack([np.ones(len(x)), phi])
    for C, eps in ((1.0, 0.05), (100.0, 0.2)):
        v, off = sv.interior(u, y, C, eps)
        objective = lambda v: v[1:] @ v[1:] / 2 + C * np.maximum(np.abs(y - u @ v) - eps, 0).sum()  # noqa: B023, E731
        fit = sv.Fit(0, C, eps, 0, -1)
        newton = sv.Solver([fit], u.shape[1], sv._in_memory([fit], [phi], y, np.ones(len(y), int), np.zeros(len(y), int)), np.array([y.mean()]))
        newton.run()
        assert off <= 1e-6 and objective(v) <= objective(newton.v[0]) + 1e-6
        for _ in range(20):                                # no way down from the optimum
            assert objective(v + rng.normal(size=len(v)) * 1e-3) > objective(v)


def test_interior_points_of_few_rows():
    for n in (0, 1, 2, 5):
        u, y = np.column_stack([np.ones(n), np.eye(n, 3)]), np.arange(n) * 1.0
        v, off = sv.interior(u, y, 10.0, 0.1)
        assert off <= 1e-6 and (np.abs(u @ v - y) <= 0.11 + (n == 5)).all() and np.isfinite(v).all()


def test_svr_chooses_before_it_fits_the_whole_training_set(spark, monkeypatch):
    monkeypatch.setattr(sv, "_large", lambda *a: pytest.fail("Spark passes for each step"))
    df = spark.range(130_100).selectExpr("'A' as dataset", "'none' as preprocessing", "id as sample_id", "cast(id % 2 as int) as fold", "0 as inner",
                                         "array(cast(id % 13 as double)) as spectrum", "cast(id % 13 as double) as target")
    got = sv.cv_svr(df, {"C": [1.0], "epsilon": [0.1], "gamma": ["scale"]}, k=2, m=5)
    assert got.count() == 130_100 and got.where("kkt > 1e-6 or y_pred is null").count() == 0


def test_equal_scores_take_the_first_point():
    grid = {"C": [1.0, 10.0], "epsilon": [0.1], "gamma": ["scale"]}
    fits = sv._fits(grid, [0], 1)
    at = {(f.C, f.inner): i for i, f in enumerate(fits)}
    errors = {at[1.0, 0]: (4.0 * (1 + 1e-9), 1), at[10.0, 0]: (4.0, 1)}
    assert sv._choose(fits, grid, 1, 0, errors)[0] == at[1.0, -1]
    assert sv._choose(fits, grid, 1, 0, errors | {at[10.0, 0]: (3.9, 1)})[0] == at[10.0, -1]
