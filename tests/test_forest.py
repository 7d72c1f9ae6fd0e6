"""Random forests against plain recursion, and task against Spark passes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismlake.operators import forest as fo


def naive_tree(bins, y, w, path, spec, limit, depth=0):
    """Predictions of all rows and gains by band of one tree, node by node."""
    out, gains = np.full(len(y), 0.0), np.zeros(bins.shape[1])
    n = w.sum()
    if n:
        out[:] = (w * y).sum() / n
    rest = (w * y * y).sum() - (w * y).sum() ** 2 / max(n, 1)
    if depth == limit or n < max(spec.min_split, 2 * spec.min_leaf) or rest <= 1e-12 * (w * y * y).sum():
        return out, gains
    best = (1e-12 * (w * y).sum() ** 2 / n, None)
    for band in fo.node_bands(np.array([path], np.uint64), spec.width(bins.shape[1]), bins.shape[1])[0]:
        for cut in np.unique(bins[w > 0, band])[:-1]:
            left = bins[:, band] <= cut
            nl = w[left].sum()
            nr = n - nl
            if min(nl, nr) < spec.min_leaf:
                continue
            gain = nl * nr / n * ((w * y)[left].sum() / nl - (w * y)[~left].sum() / nr) ** 2
            if gain > best[0] * (1 + 1e-10):
                best = (gain, band, cut)
    if best[1] is None:
        return out, gains
    gain, band, cut = best
    gains[band] += gain
    left = bins[:, band] <= cut
    for side, at in zip(fo.child_paths(np.array([path], np.uint64)), (left, ~left)):
        out[at], more = naive_tree(bins[at], y[at], w[at], side, spec, limit, depth + 1)
        gains += more
    return out, gains


@pytest.mark.parametrize("spec", [fo.Spec(2, 1, "sqrt"), fo.Spec(5, 2, 0.5), fo.Spec(2, 3, 1.0)])
def test_forest_equals_recursion(spec):
    rng = np.random.default_rng(2)
    n, limits, sizes = 70, (fo.DEEPEST, 2, 0), [3, 8]
    bins, y, rid = rng.integers(0, 12, (n, 9)).astype(np.uint8), np.round(rng.normal(size=n), 1), rng.integers(0, 1 << 60, n)
    trained = np.arange(n) % 4 > 0
    guess, bag, importance = fo.forest_rows(bins, y, rid, trained, spec, limits, sizes)
    w = fo.weights(rid, np.arange(8)) * trained
    for i, limit in enumerate(limits):
        trees = [naive_tree(bins, y, w[t], fo.root_paths(np.array([t]))[0], spec, limit) for t in range(8)]
        for k, size in enumerate(sizes):
            values = np.array([v for v, _ in trees[:size]])
            assert np.abs(guess[i, k] - values.mean(0)).max() < 1e-9
            outside = w[:size] == 0
            known = outside.any(0)
            assert np.abs(bag[i, k][known] - (values * outside).sum(0)[known] / outside.sum(0)[known]).max() < 1e-9
            assert np.isnan(bag[i, k][~known]).all()
            shares = np.mean([g / g.sum() if g.sum() else g for _, g in trees[:size]], 0)
            assert np.abs(importance[i, k] - shares).max() < 1e-9


def test_drawn_weights_are_poisson():
    w = fo.weights(np.arange(20_000), np.arange(3))
    assert np.abs(w.mean(1) - 1).max() < 0.03 and np.abs(w.var(1) - 1).max() < 0.05
    assert abs(np.corrcoef(w)[0, 1]) < 0.03


def test_steps_of_any_size_give_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    bins, y, rid = rng.integers(0, 9, (60, 6)).astype(np.uint8), rng.normal(size=60), np.arange(60)
    args = (bins, y, rid, np.ones(60, bool), fo.Spec(2, 1, "sqrt"), (fo.DEEPEST,), [7])
    whole = fo.forest_rows(*args)
    monkeypatch.setattr(fo, "ENTRIES", 50)
    for a, b in zip(whole, fo.forest_rows(*args)):
        assert np.allclose(a, b, equal_nan=True, atol=1e-12)


def frame(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(size=(n, 5)), 2)
    y = 4 * (x[:, 0] > 0.4) + x[:, 1] + rng.normal(size=n) * 0.1
    rows = [("A", "none", i, i * 7 % 3, i // 3 % 2, x[i].tolist(), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, preprocessing string, sample_id long, fold int, inner int, spectrum array<double>, target double")


def test_task_and_spark_passes_agree(spark):
    df = frame(spark, 80).repartition(3)
    grid = {"n_estimators": [2, 4], "max_depth": [None, 1, 3], "min_samples_split": [2], "min_samples_leaf": [1, 4], "max_features": [0.5]}
    run = lambda rows: fo.cv_forest(df, grid, k=3, inner_k=2, refit=True, local_rows=rows)
    (a, ia), (b, ib) = run(1000), run(15)
    a, b = (x.toPandas().sort_values("sample_id").reset_index(drop=True) for x in (a, b))
    assert a["sample_id"].tolist() == list(range(80)) and a["params"].tolist() == b["params"].tolist()
    assert np.abs(a["y_pred"] - b["y_pred"]).max() < 1e-9 and np.abs(a["inner_rmse"] - b["inner_rmse"]).max() < 1e-9
    ia, ib = (x.toPandas().sort_values("fold").reset_index(drop=True) for x in (ia, ib))
    assert ia["fold"].tolist() == [-1, 0, 1, 2] and ia["params"].tolist() == ib["params"].tolist()
    assert np.abs(ia["oob_r2"] - ib["oob_r2"]).max() < 1e-9
    assert np.abs(np.stack(ia["importance"]) - np.stack(ib["importance"])).max() < 1e-9
    assert all(row[0] == max(row) for row in ia["importance"])             # the band with the step


def test_layout_ids_and_failed_folds(spark):
    df = frame(spark, 60).withColumn("sample_id", F.col("sample_id") + (1 << 60))
    one = fo.cv_forest(df.repartition(1), k=3)[0].orderBy("sample_id").collect()
    many = fo.cv_forest(df.repartition(9), k=3)[0].orderBy("sample_id").collect()
    assert one == many and one[0]["sample_id"] == 1 << 60                    # large ids stay exact
    lone = fo.cv_forest(df.where(f"sample_id = {1 << 60}"), k=3)[0].collect()
    assert [(r["sample_id"], r["y_pred"]) for r in lone] == [(1 << 60, None)]


def test_importance_of_any_model_by_permuting_blocks(spark, monkeypatch):
    from prismlake.operators import additive, boosting, committee
    from prismlake.plans import selection as sel

    df = frame(spark, 120)
    fits = {"gbr": boosting.search({"n_estimators": [20], "learning_rate": [0.2], "max_depth": [2], "subsample": [1.0]}),
            "cubist": committee.search({"n_committees": [2]})}
    x = np.stack(df.orderBy("sample_id").toPandas()["spectrum"])
    for search in fits.values():
        small, large = (additive.fit_models(df, search, local_rows=n)["A", "none"] for n in (1000, 10))
        assert np.abs(small.predict(x) - large.predict(x)).max() < 1e-8
        got = {r["band"]: r["importance_mean"] for r in sel.permutation_importance(df, n_repeats=3, predictors={"A": small}).collect()}
        assert max(got, key=got.get) == 0 and len(got) == 5 and got[0] > 0.3
    monkeypatch.setattr(sel, "PERMUTE_ROWS", 30)                            # several blocks
    coefs = spark.createDataFrame([("A", 0.0, [2.0, 1.0, 0.0, 0.0, 0.0])], "dataset string, intercept double, coef array<double>")
    one, many = ({r["band"]: (r["importance_mean"], r["importance_std"]) for r in sel.permutation_importance(df.repartition(n), coefs, n_repeats=4).collect()}
                 for n in (1, 7))
    assert all(np.allclose(one[k], many[k], atol=1e-12) for k in range(5))
    assert one[2] == one[3] == one[4] == (0.0, 0.0) and one[0][0] > one[1][0]


def test_isolation_forest_does_not_depend_on_the_layout(spark):
    from prismlake.operators.isolation import isolation_outliers

    df = frame(spark, 300)
    one, many = (isolation_outliers(df.repartition(n), n_trees=10, max_samples=32).orderBy("sample_id").collect() for n in (1, 9))
    assert one == many and abs(np.mean([r["is_outlier"] for r in one]) - 0.1) <= 0.01


def test_correlation_tiles(spark):
    from prismlake.operators.profile import corr_matrix

    df = frame(spark, 50).repartition(4)
    x = np.stack(df.toPandas()["spectrum"])
    want = np.corrcoef(x.T)
    for tile in (2, 3, 128):
        got = corr_matrix(df, tile).toPandas()
        assert len(got) == 25 and np.abs(got["r"] - want[got["i"], got["j"]]).max() < 1e-9


def test_one_growth_gives_every_least_node_size():
    rng = np.random.default_rng(6)
    n, limits, sizes, least = 90, (fo.DEEPEST, 3), [2, 5], (2, 5, 12)
    bins, y, rid = rng.integers(0, 32, (n, 7)).astype(np.uint8), 1e4 + rng.normal(size=n), np.arange(n)
    trained, wanted = np.arange(n) % 3 > 0, np.arange(n) % 3 == 0
    got = fo.forest_rows(bins, y, rid, trained, fo.Spec(2, 1, "sqrt"), limits, sizes, min_splits=least)
    few = fo.forest_rows(bins, y, rid, trained, fo.Spec(2, 1, "sqrt"), limits, sizes, min_splits=least, wanted=wanted)
    for v, m in enumerate(least):
        alone = fo.forest_rows(bins, y, rid, trained, fo.Spec(m, 1, "sqrt"), limits, sizes)
        for a, b in zip(got, alone):
            assert np.allclose(a[2 * v:2 * v + 2], b, atol=1e-9, equal_nan=True)
    assert np.allclose(few[0][..., wanted], got[0][..., wanted], atol=1e-9) and np.allclose(few[2], got[2])
    grid = fo.Search(fo.GRID, 5, 3, 32)
    assert sorted(i for f in grid.forests for i in f) == list(range(8)) and len(grid.forests) == 4


def test_equal_gains_stay_equal_among_many_nodes():
    """Splits of a node must not change with what else is added up beside it."""
    rng = np.random.default_rng(8)
    n = 400
    bins, y, rid = rng.integers(0, 32, (n, 12)).astype(np.uint8), 1e5 + rng.normal(size=n), np.arange(n)
    args = (bins, y, rid, np.ones(n, bool), fo.Spec(2, 1, 0.5), (fo.DEEPEST,), [60])
    whole = fo.forest_rows(*args)[0]
    trees = fo.ENTRIES
    try:
        fo.ENTRIES = 200
        assert np.abs(whole - fo.forest_rows(*args)[0]).max() < 1e-6
    finally:
        fo.ENTRIES = trees


def test_tens_of_thousands_of_rows_grow_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(fo, "_large", lambda *a: pytest.fail("Spark passes for each level"))
    df = spark.range(20_600).selectExpr("'A' as dataset", "'none' as preprocessing", "id as sample_id", "cast(id % 2 as int) as fold", "0 as inner",
                                        "array(cast(id % 13 as double)) as spectrum", "cast(id % 13 as double) as target")
    grid = {"n_estimators": [2], "max_depth": [2], "min_samples_split": [2], "min_samples_leaf": [1], "max_features": [1.0]}
    assert fo.cv_forest(df, grid, k=2)[0].count() == 20_600


def test_java_growth_equals_numpy(spark):
    """Variants that grow together until they split differently, and parts of the chosen forest."""
    rng = np.random.default_rng(11)
    n, p, limits, sizes = 150, 9, (fo.DEEPEST, 3), [4, 7]
    fold, inner, rid = np.arange(n) % 3, np.arange(n) // 3 % 2, rng.integers(-(1 << 62), 1 << 62, n)
    for n_bins, features in ((12, "sqrt"), (32, 1.0), (200, 0.5)):
        bins, y = rng.integers(0, n_bins, (n, p)).astype(np.uint8), 1e3 + np.round(rng.normal(size=n), 1)
        rows = pd.DataFrame({"rid": rid, "y": y, "fold": fold, "inner": inner, "bins": [b.tobytes() for b in bins]})
        tables = spark.createDataFrame([(None, "none", fo.pack_rows(rows))], "dataset string, preprocessing string, rows binary")
        specs = [fo.Spec(2, 1, features), fo.Spec(5, 1, features), fo.Spec(2, 2, features), fo.Spec(9, 4, features)]
        jobs = [(None, "none", 1, 0, 0, 0, fo.pack_job(1, 0, (0, 7), specs, limits, sizes, p, n_bins)),
                *((None, "none", 1, -1, 0, a, fo.pack_job(1, -1, (a, b), specs[2:3], limits[:1], [], p, n_bins)) for a, b in ((0, 4), (4, 7)))]
        got = {(r["cj"], r["first"]): r["part"] for r in fo._grown(tables, jobs).collect()}
        held, *sse = np.frombuffer(got[0, 0], "<f8")
        at = (fold != 1) & (inner == 0)
        assert held == at.sum()
        want = [((fo.forest_rows(bins, y, rid, (fold != 1) & (inner != 0), s, limits, sizes, n_bins)[0][..., at] - y[at]) ** 2).sum(2) for s in specs]
        assert np.allclose(np.reshape(sse, (4, 2, 2)), want, rtol=1e-9)
        _, bag, importance = fo.forest_rows(bins, y, rid, fold != 1, specs[2], limits[:1], [7], n_bins)
        total, count, shares = (sum(np.frombuffer(got[-1, a], t, m, start) for a in (0, 4)) for t, m, start in (("<f8", n, 0), ("<i4", n, 8 * n), ("<f8", p, 12 * n)))
        known = count > 0
        assert np.allclose(total[known] / count[known], bag[0, 0][known], rtol=1e-9) and np.isnan(bag[0, 0][~known]).all()
        assert np.allclose(shares / 7, importance[0, 0], atol=1e-9)


def test_growths_share_leaf_sizes():
    search = fo.Search(fo.GRID, 5, 3, 32)
    assert sorted(i for g in search.growths for i in g) == list(range(8)) and len(search.growths) == 2
    assert all([search.specs[i].min_leaf for i in g] == sorted(search.specs[i].min_leaf for i in g) for g in search.growths)
