"""Boosted trees and rule committees against plain NumPy, and task against Spark passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def frame(spark, n=150, p=4, seed=5, target=None, datasets=("A",)):
    rng = np.random.default_rng(seed)
    rows = []
    for d in datasets:
        x = np.round(rng.uniform(size=(n, p)), 2)                          # ties within bands
        y = target(x) if target else 3 * x[:, 0] - 2 * (x[:, 1] > 0.5) + rng.normal(size=n) * 0.1
        rows += [(d, "none", i, i * 7 % 5, i // 5 % 3, x[i].tolist(), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, preprocessing string, sample_id long, fold int, inner int, spectrum array<double>, target double")


def naive_tree(x, t, depth, min_leaf=1):
    """Exact regression tree: a function from rows to leaf numbers, and the gains by band."""
    gains = np.zeros(x.shape[1])

    def split(at, depth):
        best = (1e-9, None)
        if depth:
            for band in range(x.shape[1]):
                for v in np.unique(x[at, band])[:-1]:
                    left = at & (x[:, band] <= v)
                    right = at & ~left
                    if min(left.sum(), right.sum()) < min_leaf:
                        continue
                    nl, nr = left.sum(), right.sum()
                    gain = nl * nr / (nl + nr) * (t[left].mean() - t[right].mean()) ** 2
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (band, v, left, right))
        if best[1] is None:
            return [([], at)]
        band, v, left, right = best[1]
        gains[band] += best[0]
        low = [([(band, v, True), *c], a) for c, a in split(left, depth - 1)]
        return low + [([(band, v, False), *c], a) for c, a in split(right, depth - 1)]

    leaves = split(np.ones(len(t), bool), depth)

    def leaf_of(rows):
        out = np.zeros(len(rows), int)
        for k, (conditions, _) in enumerate(leaves):
            inside = np.ones(len(rows), bool)
            for band, v, low in conditions:
                inside &= (rows[:, band] <= v) == low
            out[inside] = k
        return out
    return leaf_of, leaves, gains


def table(df):
    pdf = df.toPandas().sort_values("sample_id")
    return np.stack(pdf["spectrum"]), pdf["target"].to_numpy(), pdf["fold"].to_numpy(), pdf["inner"].to_numpy()


def test_boosting_equals_plain_numpy(spark):
    from prismlake.operators.boosting import cv_boosting

    df = frame(spark)
    x, y, fold, _ = table(df)
    grid = {"n_estimators": [7], "learning_rate": [0.3], "max_depth": [2], "subsample": [1.0]}
    got, imp = cv_boosting(df, grid, n_bins=256)                           # a bin for each value
    got = got.toPandas().sort_values("sample_id")
    shares = {r["fold"]: np.array(r["importance"]) for r in imp.collect()}
    for f in range(5):
        train, held = fold != f, fold == f
        current, mine, gains = np.full(train.sum(), y[train].mean()), np.full(held.sum(), y[train].mean()), 0
        for _ in range(7):
            r = y[train] - current
            leaf_of, leaves, g = naive_tree(x[train], r, 2)
            values = np.array([r[at].mean() for _, at in leaves]) * 0.3
            current, mine, gains = current + values[leaf_of(x[train])], mine + values[leaf_of(x[held])], gains + g
        assert np.abs(got["y_pred"].to_numpy()[held] - mine).max() < 1e-9
        assert np.abs(shares[f] - gains / gains.sum()).max() < 1e-9


def ridge(x, y, scale, alpha=1.0, start=None):
    z, start = (x - x.mean(0)) / scale, 0 if start is None else start * scale
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()) + alpha * start) / scale
    return y.mean() - x.mean(0) @ b, b


def test_committee_equals_plain_numpy(spark):
    from prismlake.operators.committee import cv_committee

    df = frame(spark)
    x, y, fold, _ = table(df)
    got, _ = cv_committee(df, {"n_committees": [3]}, depth=2, min_leaf=10, n_bins=256)
    got = got.toPandas().sort_values("sample_id")["y_pred"].to_numpy()
    for f in range(5):
        train, held = fold != f, fold == f
        xt, last, total = x[train], 0, np.zeros(held.sum())
        for m in range(3):
            t = 2 * y[train] - last if m else y[train]
            leaf_of, leaves, _ = naive_tree(xt, t, 2, 10)
            root = ridge(xt, t, xt.std(0))
            models = [ridge(xt[at], t[at], xt.std(0), 1.0, root[1]) if len(leaves) > 1 else root for _, at in leaves]
            say = lambda rows: np.array([models[k][0] + r @ models[k][1] for k, r in zip(leaf_of(rows), rows)])  # noqa: E731, B023
            last, total = say(xt), total + say(x[held])
        assert np.abs(got[held] - total / 3).max() < 1e-7


def test_one_rule_is_ridge_regression(spark):
    from prismlake.operators.committee import cv_committee

    df = frame(spark)
    x, y, fold, _ = table(df)
    got, _ = cv_committee(df, {"n_committees": [1]}, depth=1, min_leaf=1000)          # no split leaves enough rows
    got = got.toPandas().sort_values("sample_id")["y_pred"].to_numpy()
    for f in range(5):
        train = fold != f
        b0, b = ridge(x[train], y[train], x[train].std(0))
        assert np.abs(got[~train] - (b0 + x[~train] @ b)).max() < 1e-9


def test_committee_beats_a_linear_model_on_pieces(spark):
    from prismlake.operators.committee import cv_committee

    pieces = lambda x: np.where(x[:, 0] > 0.5, 5 * x[:, 1], 4 - 5 * x[:, 1])
    df = frame(spark, n=300, target=pieces)
    x, y, fold, _ = table(df)
    got, _ = cv_committee(df)
    got = got.toPandas().sort_values("sample_id")
    linear = np.empty(len(y))
    for f in range(5):
        train = fold != f
        b0, b = ridge(x[train], y[train], x[train].std(0))
        linear[~train] = b0 + x[~train] @ b
    sse = lambda p: ((p - y) ** 2).sum()
    assert sse(got["y_pred"].to_numpy()) < 0.2 * sse(linear)
    assert got["params"].str.contains("n_committees").all()


@pytest.mark.parametrize("model", ["boosting", "committee"])
def test_task_and_spark_passes_agree(spark, monkeypatch, model):
    from prismlake.operators import additive, boosting, committee

    monkeypatch.setattr(additive, "REFRESH", 2)
    df = frame(spark, datasets=("A", "B"), n=90).repartition(5)
    if model == "boosting":
        run = lambda rows: boosting.cv_boosting(df, {"n_estimators": [2, 5], "learning_rate": [0.1, 0.3], "max_depth": [1, 2], "subsample": [0.7, 1.0]},
                                                refit=True, local_rows=rows)
    else:
        run = lambda rows: committee.cv_committee(df, {"n_committees": [1, 3]}, refit=True, local_rows=rows)
    (a, ia), (b, ib) = run(1000), run(10)
    keys = ["dataset", "fold", "sample_id"]
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert len(a) == 180 and a["params"].tolist() == b["params"].tolist()
    assert np.abs(a["y_pred"] - b["y_pred"]).max() < 1e-9 and np.abs(a["inner_rmse"] - b["inner_rmse"]).max() < 1e-9
    ia, ib = (x.toPandas().sort_values(keys[:2]) for x in (ia, ib))
    assert len(ia) == 12 and np.abs(np.stack(ia["importance"]) - np.stack(ib["importance"])).max() < 1e-9


def test_layout_and_bad_rows_do_not_matter(spark):
    from prismlake.operators.boosting import cv_boosting

    grid = {"n_estimators": [4], "learning_rate": [0.1], "max_depth": [3], "subsample": [0.5]}
    df = frame(spark)
    bad = df.limit(3).select("dataset", "preprocessing", (F.col("sample_id") + 1000).alias("sample_id"), "fold", "inner",
                             F.array_repeat(F.lit(None).cast("double"), 4).alias("spectrum"), "target")
    one = cv_boosting(df.repartition(1), grid)[0].orderBy("sample_id").collect()
    many = cv_boosting(df.unionByName(bad).repartition(13), grid)[0].orderBy("sample_id").collect()
    assert one == many
    lone = cv_boosting(df.where("sample_id < 1"), grid)[0].collect()                # its fold cannot be trained
    assert [(r["sample_id"], r["y_pred"]) for r in lone] == [(0, None)]


def test_inner_choice_is_the_smallest_error(spark):
    from prismlake.operators.additive import choose

    assert choose({(5, 0): [(4.0, 1), (0.0, 1)], (5, 1): [(1.0, 1), (1.0, 1)]}, [(5, 0), (5, 1)]) == ((5, 0), 1.0)
    assert choose({(5, 0): [(4.0, 1), (1.0, 1)], (5, 1): [(1.0, 1), (1.0, 1)]}, [(5, 0), (5, 1)]) == ((5, 1), 1.0)


def test_sums_of_smaller_children_are_those_of_all_nodes():
    from prismlake.operators import additive
    from prismlake.operators.histograms import node_sums

    rng = np.random.default_rng(3)
    n, p, bins = 400, 5, 8
    rows = additive.Rows(rng.integers(0, bins, (n, p)).astype(np.uint8), np.empty((n, 0)), rng.normal(size=n), np.arange(n) % 3, np.arange(n) % 2, np.arange(n))
    fits = [additive.Fit((), 2, share, 0, inner) for inner in (-1, 0) for share in (0.5, 1.0) for _ in range(2)]
    target, columns = rng.normal(size=(len(fits), n)), np.ascontiguousarray(rows.bins.T)
    sums = additive.Sums(fits, columns, bins)
    for turn in range(2):                                                  # the second round knows the counts of some roots
        used, node = additive.drawn(fits, rows, turn), np.zeros((len(fits), n), int)
        fit, row = np.nonzero(used)
        got = sums.roots(used, target)
        assert np.abs(got - node_sums(rows.bins, fit, row, target[fit, row], len(fits), bins)).max() < 1e-10
        for level in range(2):
            band, cut = rng.integers(-1, p, (len(fits), 1 << level)), rng.integers(0, bins, (len(fits), 1 << level))
            before, node = node, additive.step_columns(columns, node, band, cut)
            assert (node == additive.step(rows.bins, before, band, cut)).all()
            at = (fit << level + 1) + node[fit, row]
            want = node_sums(rows.bins, at, row, target[fit, row], len(fits) << level + 1, bins)
            sides = want[:, :, 0].sum(2).reshape(2, -1, 2).transpose(1, 2, 0).reshape(len(fits), -1, 4)
            assert np.abs(sums.children(used, target, node, sides) - want).max() < 1e-10


def test_sums_of_many_rows_take_two_bands_together(monkeypatch):
    from prismlake.operators import additive
    from prismlake.operators.histograms import node_sums

    rng = np.random.default_rng(4)
    n, p, bins, added, plain = 12_000, 5, 32, [], np.bincount
    rows = additive.Rows(rng.integers(0, bins, (n, p)).astype(np.uint8), np.empty((n, 0)), rng.normal(size=n), np.ones(n, int), np.ones(n, int), np.arange(n))
    fits = [additive.Fit((), 2, share, 0, 0) for share in (0.5, 1.0)]
    target, columns = rng.normal(size=(2, n)), np.ascontiguousarray(rows.bins.T)
    used, node = additive.drawn(fits, rows, 0), np.zeros((2, n), int)
    fit, row = np.nonzero(used)
    sums = additive.Sums(fits, columns, bins)
    with monkeypatch.context() as m:
        m.setattr(np, "bincount", lambda at, *a, **k: added.append(len(at)) or plain(at, *a, **k))
        got = sums.roots(used, target)
    assert np.abs(got - node_sums(rows.bins, fit, row, target[fit, row], 2, bins)).max() < 1e-9
    assert sum(added) == 2 * used.sum() * (p + 1) // 2                     # counts and sums of three tables, not of five bands
    for level in range(2):
        band, cut = rng.integers(0, p, (2, 1 << level)), np.full((2, 1 << level), bins // 2)
        node = additive.step_columns(columns, node, band, cut)
        want = node_sums(rows.bins, (fit << level + 1) + node[fit, row], row, target[fit, row], 2 << level + 1, bins)
        sides = want[:, :, 0].sum(2).reshape(2, -1, 2).transpose(1, 2, 0).reshape(2, -1, 4)
        assert np.abs(sums.children(used, target, node, sides) - want).max() < 1e-9


def test_a_task_has_the_fits_of_one_inner_fold(monkeypatch):
    """The choice of an outer fold comes from tasks of one inner fold each; only the chosen point is
    fitted on the whole training set."""
    import pandas as pd

    from prismlake.operators import additive, boosting

    rng = np.random.default_rng(6)
    n, search = 60, boosting.search({"n_estimators": [2, 4], "learning_rate": [0.3, 0.6], "max_depth": [1, 2], "subsample": [1.0]}, n_bins=8)
    pdf = pd.DataFrame({"dataset": "A", "preprocessing": "none", "cv": 0, "sample_id": range(n), "fold": np.arange(n) % 3, "inner": np.arange(n) // 3 % 3,
                        "rid": range(n), "bins": [r.tobytes() for r in rng.integers(0, 8, (n, 3)).astype(np.uint8)], "y": rng.normal(size=n)})
    taken, plain = [], additive.fit_rows
    monkeypatch.setattr(additive, "fit_rows", lambda method, rounds, *a: taken.append([(f.inner, rounds) for f in method.fits]) or plain(method, rounds, *a))
    errors: dict = {}
    for j in range(3):
        part = additive._error_task(search)(("A", "none", 0, j), pdf[pdf["fold"] != 0].assign(cj=j))
        for r in part.itertuples():
            errors.setdefault((r.rounds, r.setting), []).append((r.sse, r.n))
    assert taken == [[(j, 4)] * 4 for j in range(3)] and {len(v) for v in errors.values()} == {3}
    point, rmse = additive.choose(errors, search.points)
    out = additive._fold_task(search, {("A", "none", 0): (point, rmse)})(("A", "none", 0), pdf)
    assert taken[3:] == [[(-1, point[0])]] and set(out["inner_rmse"]) == {rmse} and out["y_pred"].notna().sum() == 20


def test_tens_of_thousands_of_rows_need_no_spark_pass_a_level(spark, monkeypatch):
    from prismlake.operators import additive, boosting

    monkeypatch.setattr(additive, "fit_on_spark", lambda *a: pytest.fail("a Spark job for each level of each round"))
    df = spark.range(20_600).selectExpr("'A' as dataset", "'none' as preprocessing", "id as sample_id", "cast(id % 2 as int) as fold", "0 as inner",
                                        "array(cast(id % 13 as double)) as spectrum", "cast(id % 13 as double) as target")
    grid = {"n_estimators": [2], "learning_rate": [0.5], "max_depth": [1], "subsample": [1.0]}
    assert boosting.cv_boosting(df, grid, k=2)[0].count() == 20_600


def test_permuted_predictions_touch_only_trees_of_the_band(spark, monkeypatch):
    from prismlake.operators import additive, boosting

    df = frame(spark, n=120)
    x = table(df)[0]
    model = additive.fit_models(df, boosting.search({"n_estimators": [12], "learning_rate": [0.2], "max_depth": [3], "subsample": [1.0]}))["A", "none"]
    partner = np.random.default_rng(0).permutation(len(x))
    want = []
    for band in range(x.shape[1]):
        moved = x.copy()
        moved[:, band] = x[partner, band]
        want.append(model.predict(moved))
    calls, predict = [], additive.Fitted.predict
    monkeypatch.setattr(additive.Fitted, "predict", lambda self, rows: calls.append(len(rows)) or predict(self, rows))
    assert np.abs(model.predict_permuted(x, partner) - np.array(want)).max() < 1e-12
    assert calls == [len(x)]                                               # not once more for each band
