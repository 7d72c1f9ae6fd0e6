"""Tuning by R2: the solver against refits, the winner against SQL on the emitted table."""

import json

import duckdb
import numpy as np
import pytest

from prismlake.plans import selection as sel


def frame(spark, n=60, p=6, seed=9):
    rng = np.random.default_rng(seed)
    x = rng.uniform(size=(n, p))
    y = x @ np.arange(p) + rng.normal(size=n) * 0.3
    rows = [("A", "none", i, i * 7 % 3, i // 3 % 4, x[i].tolist(), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, preprocessing string, sample_id long, fold int, inner int, spectrum array<double>, target double")


def pls(x, y, n, scale):
    """PLS1 by NIPALS."""
    xm, ym = x.mean(0), y.mean()
    sx, sy = (x.std(0, ddof=1), y.std(ddof=1)) if scale else (np.ones(x.shape[1]), 1.0)
    e, f, ws, ps, qs = (x - xm) / sx, (y - ym) / sy, [], [], []
    for _ in range(n):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(w), ps.append(p), qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    b = w @ np.linalg.solve(p.T @ w, np.array(qs)) / sx * sy
    return lambda z: ym + (z - xm) @ b


def krr(x, y, alpha):
    b = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)
    return lambda z: z @ b


@pytest.mark.parametrize("method", ["grid", "random"])
def test_scores_winners_and_predictions(spark, method):
    df = frame(spark)
    points = {m: [p for p in sel.tuning_points(spark, m, method, 60) if p.get("n_components", 1) <= 6] for m in ("pls", "krr")}
    assert all(points.values()) and (method == "grid" or {p["scale"] for p in points["pls"]} == {True, False})
    table = sel.tuning_candidates(df, points, k=3, inner_k=4)
    pdf = df.toPandas().sort_values("sample_id")
    x, y, fold, inner = np.stack(pdf["spectrum"]), pdf["target"].to_numpy(), pdf["fold"].to_numpy(), pdf["inner"].to_numpy()
    oof = sel.score_candidates(df, table).toPandas()
    got = table.toPandas()
    fit = lambda model, p, a, b: pls(a, b, p["n_components"], p.get("scale", True)) if model == "pls" else krr(a, b, p["alpha"])
    for r in got[got["tuned"]].itertuples():
        p, scores = json.loads(r.params), []
        for j in range(4):
            t, v = (fold != r.fold) & (inner != j), (fold != r.fold) & (inner == j)
            scores.append(1 - ((fit(r.model, p, x[t], y[t])(x[v]) - y[v]) ** 2).sum() / ((y[v] - y[v].mean()) ** 2).sum())
        assert abs(r.cv_r2 - np.mean(scores)) < 1e-7
    for (model, f, tuned), part in oof.groupby(["model", "fold", "tuned"]):
        p = json.loads(part["params"].iloc[0])
        want = fit(model, p, x[fold != f], y[fold != f])(x[part["sample_id"]])
        assert np.abs(part["y_pred"] - want).max() < 1e-7
    con = duckdb.connect()
    con.register("candidates", got.drop(columns="coef"))
    wrong = con.execute("""select count(*) from (select *, row_number() over (partition by dataset, preprocessing, model, fold
        order by round(cv_r2, 12) desc, point) = 1 as best from candidates where tuned) where best <> chosen""").fetchone()[0]
    assert wrong == 0 and (got[got["chosen"]].groupby(["model", "fold", "tuned"]).size() == 1).all()


def test_random_points_are_the_same_in_sql(spark):
    points = sel.tuning_points(spark, "pls", "random", 30, seed=5)
    con = duckdb.connect()
    u = lambda name: f"(('0x' || substr(md5('5|' || i || '|{name}'), 1, 13))::bigint / 16::double ** 13)"
    want = con.execute(f"select 2 + floor({u('n_components')} * 23)::int, floor({u('scale')} * 2)::int = 0 from range(30) t(i) order by i").fetchall()
    assert [(p["n_components"], p["scale"]) for p in points] == want and max(p["n_components"] for p in points) <= 24


def test_registered_tuning(spark):
    from prismlake.plans.catalog import all_queries

    rows = all_queries()["cv_tuned_vs_default"].spark(spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) == 5 * 4 * 2 * 2 and rows.groupby("tuned")["r2"].mean()[True] > rows.groupby("tuned")["r2"].mean()[False]
    assert rows[rows["tuned"]]["mean_cv_r2"].notna().all() and rows["params_fold0"].notna().all()
