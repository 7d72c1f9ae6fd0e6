"""Distributed nested cross-validation for Gram-solvable models (PLS, linear KRR, OLS).

Plan (all Spark jobs, no per-model passes over the data):

1. ``kfold_assign`` tags rows with an outer fold and an inner fold (balanced within
   every outer training set, identical for a row across outer folds).
2. Preprocessing variants are a lazy union with a ``preprocessing`` column.
3. ONE Gram pass keyed by (dataset, preprocessing, fold, inner) -> 15 cells per key.
4. ``applyInPandas`` per (dataset, preprocessing): every train / validation set of
   the nested search is a sum or difference of cells; every grid point is solved
   from moments, inner RMSE comes from validation moments (no data pass), and the
   winning parameters are refit on the outer training set -- plus one final refit on
   all rows (fold = -1, inner 3-fold selection over all data).
5. ONE scoring pass joins the coefficient table (small; AQE broadcasts it after
   measuring) to the variants and emits the flat out-of-fold frame.
"""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import arrays as A
from prismlake.operators import clean, evaluate
from prismlake.operators import linear as L
from prismlake.operators.gram import Moments, gram_pass
from prismlake.sources.files import scratch_path

COEF_SCHEMA = ("dataset STRING, preprocessing STRING, model STRING, fold INT, params STRING, "
               "inner_rmse DOUBLE, intercept DOUBLE, coef ARRAY<DOUBLE>")
DEFAULT_PARAMS = {"pls": '{"n_components": 2}', "krr": '{"alpha": 1.0, "kernel": "linear"}', "ols": "{}"}


def prepare(spectra: DataFrame, preps: list[str], registry: dict | None = None, k: int = 5,
            inner_k: int = 3, seed: int = 42, persist: bool = True) -> DataFrame:
    """Folds + preprocessing variants + the reference's validity mask.

    The folded spectra and the variants are persisted (memory, spilling to disk):
    the variants feed both the Gram pass and the scoring pass, and some transforms
    (neighbour fill, band medians) contain shuffles that should run once per
    selection run.  Lost executors recompute their partitions from lineage.
    """
    from prismlake.operators.transforms import registry as default_registry
    reg = registry or default_registry()
    folded = evaluate.kfold_assign(spectra, k=k, inner_k=inner_k, seed=seed)
    if persist:
        folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    out = None
    for name in preps:
        v = reg[name](folded).withColumn("preprocessing", F.lit(name))
        v = clean.mask_valid_rows(v).select("dataset", "preprocessing", "sample_id", "fold", "inner", "spectrum", "target")
        out = v if out is None else out.unionByName(v)
    return out.persist(StorageLevel.MEMORY_AND_DISK) if persist else out


def _solver(models: list[str], k: int, inner_k: int, tuned: bool):
    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ds, prep = key
        q = int(pdf["p"].iloc[0]) + 1
        cells = {(int(r.fold), int(r.inner)): Moments.from_packed(r.g, q) for r in pdf.itertuples()}
        zero = Moments(0.0, np.zeros(q), np.zeros((q, q)))

        def total(pred) -> Moments:
            acc = zero
            for key_, m in cells.items():
                if pred(*key_):
                    acc = acc + m if acc.n else m
            return acc

        everything = total(lambda f, j: True)
        rows = []
        for model in models:
            for f in list(range(k)) + [-1]:
                train = everything - total(lambda ff, j: ff == f) if f >= 0 else everything
                if train.n < 2:                   # the fold fails: its rows keep a null prediction
                    rows.append((ds, prep, model, f, None, None, None, None))
                    continue
                scores: dict[str, list[float]] = {}
                if tuned:
                    for j in range(inner_k):
                        val = total(lambda ff, jj: ff != f and jj == j)
                        if val.n < 1 or train.n - val.n < 2:
                            continue
                        for params, (b0, coef) in L.fit_grid(model, train - val).items():
                            scores.setdefault(params, []).append(np.sqrt(L.sse(val, b0, coef) / val.n))
                fits = L.fit_grid(model, train)
                if scores:
                    best = min(scores, key=lambda s: (np.mean(scores[s]), list(fits).index(s)))
                    inner = float(np.mean(scores[best]))
                else:
                    best = DEFAULT_PARAMS[model] if DEFAULT_PARAMS[model] in fits else next(iter(fits))
                    inner = float("nan")
                b0, coef = fits[best]
                rows.append((ds, prep, model, f, best, inner, float(b0), coef.tolist()))
        return pd.DataFrame(rows, columns=["dataset", "preprocessing", "model", "fold", "params", "inner_rmse",
                                           "intercept", "coef"])
    return solve


def fit_coefficients(prepared: DataFrame, models: list[str], k: int = 5, inner_k: int = 3,
                     tuned: bool = True) -> DataFrame:
    cells = gram_pass(prepared, ["dataset", "preprocessing", "fold", "inner"], "spectrum", "target")
    return cells.groupBy("dataset", "preprocessing").applyInPandas(_solver(models, k, inner_k, tuned), COEF_SCHEMA)


def score(prepared: DataFrame, coefs: DataFrame) -> DataFrame:
    """Out-of-fold predictions: each row scored by the models trained without its fold."""
    c = coefs.where(F.col("fold") >= 0).select("dataset", "preprocessing", "fold", "model", "params", "intercept", "coef")
    return (prepared.join(c, ["dataset", "preprocessing", "fold"])
            .select("dataset", "preprocessing", "model", "fold", "sample_id", "params",
                    F.col("target").alias("y_true"),
                    (F.col("intercept") + A.arr_dot("spectrum", "coef")).alias("y_pred")))


def cross_validate(spectra: DataFrame, preps: list[str], models: list[str], k: int = 5, inner_k: int = 3,
                   seed: int = 42, tuned: bool = True, registry: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """-> (oof predictions, coefficient table incl. the all-rows refit at fold -1)."""
    prepared = prepare(spectra, preps, registry, k, inner_k, seed)
    coefs = fit_coefficients(prepared, models, k, inner_k, tuned)
    return score(prepared, coefs), coefs


# ----------------------------------------------------------------- tuning by R2

# Grids and ranges of the tuning run (whole numbers: both ends included).
TUNING_GRIDS = {"pls": {"n_components": [2, 3, 5, 7, 10, 15, 20], "scale": [True, False]},
                "krr": {"alpha": [0.1, 0.5, 1.0, 2.0, 5.0, 10.0]}}
TUNING_SPACES = {"pls": {"n_components": ("int", 2, 24), "scale": ("choice", [True, False])},
                 "krr": {"alpha": ("uniform", 0.1, 10.1)}}
CANDIDATE_SCHEMA = ("dataset STRING, preprocessing STRING, model STRING, fold INT, tuned BOOLEAN, point INT, params STRING, cv_r2 DOUBLE, "
                    "chosen BOOLEAN, intercept DOUBLE, coef ARRAY<DOUBLE>")


def tuning_points(spark, model: str, method: str = "grid", n_iter: int = 50, seed: int = 42) -> list[dict]:
    """The parameter points of a search: the whole grid, or ``n_iter`` draws by md5 (the same
    in every engine, ``evaluate.random_param_sample``)."""
    if method == "grid":
        grid = TUNING_GRIDS[model]
        return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    space = TUNING_SPACES[model]
    drawn = evaluate.random_param_sample(spark, n_iter, space, seed).orderBy("draw").collect()
    read = lambda name, value: value == "True" if space[name][0] == "choice" else value
    return [{name: read(name, r[name]) for name in space} for r in drawn]


def _fit_points(model: str, m: Moments, points: list[dict]) -> list[tuple[float, np.ndarray]]:
    """Every point fitted from one moment matrix; all component counts of PLS from one run."""
    if model == "pls":
        most = {scale: max((p["n_components"] for p in points if p["scale"] == scale), default=0) for scale in (True, False)}
        paths = {scale: L.pls1_path(m, n, scale) for scale, n in most.items() if n}
        return [paths[p["scale"]][p["n_components"] - 1] for p in points]
    return [L.ridge_no_intercept(m, p["alpha"]) for p in points]


def _tuner(points: dict[str, list[dict]], k: int, inner_k: int):
    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        q = int(pdf["p"].iloc[0]) + 1
        cells = {(int(r.fold), int(r.inner)): Moments.from_packed(r.g, q) for r in pdf.itertuples()}

        def total(keep) -> Moments | None:
            found = [m for at, m in cells.items() if keep(*at)]
            return functools.reduce(lambda a, b: a + b, found) if found else None

        rows = []
        for f in range(k):
            train = total(lambda ff, j: ff != f)  # noqa: B023
            if train is None or train.n < 2:
                continue
            inner = []
            for j in range(inner_k):
                val = total(lambda ff, jj: ff != f and jj == j)  # noqa: B023
                if val is not None and val.n >= 2 and train.n - val.n >= 2 and val.cov_ss[-1, -1] > 0:
                    inner.append((train - val, val))
            for model, candidates in points.items():
                scores = [[1 - L.sse(val, b0, coef) / val.cov_ss[-1, -1] for b0, coef in _fit_points(model, rest, candidates)] for rest, val in inner]
                mean = np.mean(scores, 0) if scores else np.full(len(candidates), np.nan)
                best = int(np.nanargmax(mean)) if scores else 0
                b0, coef = _fit_points(model, train, [candidates[best]])[0]
                for i, point in enumerate(candidates):
                    fit = (float(b0), coef.tolist()) if i == best else (None, None)
                    rows.append((*key, model, f, True, i, json.dumps(point), float(mean[i]) if scores else None, i == best, *fit))
                params, (b0, coef) = L.fit_params(model, train, DEFAULT_PARAMS[model])
                rows.append((*key, model, f, False, 0, params, None, True, float(b0), coef.tolist()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATE_SCHEMA.split(", ")])
    return solve


def tuning_candidates(prepared: DataFrame, points: dict[str, list[dict]], k: int = 5, inner_k: int = 5) -> DataFrame:
    """Every point of every outer fold with its mean inner R2 (``cv_r2``, from validation
    moments), the winner (``chosen``: largest, first of equal ones) refitted on the fold's
    training set, and the default parameters beside it (``tuned`` false)."""
    cells = gram_pass(prepared, ["dataset", "preprocessing", "fold", "inner"], "spectrum", "target")
    return cells.groupBy("dataset", "preprocessing").applyInPandas(_tuner(points, k, inner_k), CANDIDATE_SCHEMA)


def score_candidates(prepared: DataFrame, candidates: DataFrame) -> DataFrame:
    """Out-of-fold predictions of the chosen and the default models (``tuned``)."""
    chosen = candidates.where("chosen").select("dataset", "preprocessing", "fold", "model", "tuned", "params", "cv_r2", "intercept", "coef")
    return prepared.join(chosen, ["dataset", "preprocessing", "fold"]).select(
        "dataset", "preprocessing", "model", "tuned", "fold", "sample_id", "params", "cv_r2", F.col("target").alias("y_true"),
        (F.col("intercept") + A.arr_dot("spectrum", "coef")).alias("y_pred"))


def cv_tuned_vs_default(spectra: DataFrame, preps: list[str], models: list[str], method: str = "grid", n_iter: int = 50, seed: int = 42,
                        k: int = 5, inner_k: int = 5) -> DataFrame:
    """Pooled metrics of tuned and default models side by side, with the mean inner R2 and the
    parameters of fold 0.  Tuning maximises R2 over the inner folds (``grid`` or ``random``)."""
    prepared = prepare(spectra, preps, inner_k=inner_k)
    points = {m: tuning_points(spectra.sparkSession, m, method, n_iter, seed) for m in models}
    path = scratch_path(spectra.sparkSession, "tuning")
    tuning_candidates(prepared, points, k, inner_k).write.mode("overwrite").parquet(path)
    candidates = spectra.sparkSession.read.parquet(path)
    oof = score_candidates(prepared, candidates)
    keys = ["dataset", "preprocessing", "model", "tuned"]
    metrics = evaluate._finish(oof.groupBy(*keys).agg(*evaluate._metric_aggs()))
    chosen = candidates.where("chosen").groupBy(*keys).agg(F.avg("cv_r2").alias("mean_cv_r2"), F.min_by("params", "fold").alias("params_fold0"))
    return metrics.join(chosen, keys)


# ----------------------------------------------------------------- leave-one-out

def loo_linear(spectra: DataFrame, ridge_alpha: float = 0.0) -> DataFrame:
    """Exact leave-one-out residuals of OLS / ridge (with intercept) by PRESS:
    e_loo = e / (1 - h), h = u' (U'U + alpha J)^-1 u with u = [1, x].

    One Gram pass per dataset, a small inverse per dataset, then one scoring pass
    (the quadratic form is an array expression).  Datasets with < 3 rows get nulls.
    """
    spark = spectra.sparkSession
    g = gram_pass(spectra, ["dataset"], "spectrum", "target").collect()
    rows = []
    for r in g:
        q = r["p"] + 1
        m = Moments.from_packed(r["g"], q)
        p = q - 1
        if m.n < 3:
            continue
        U = np.empty((q, q))
        s = m.mean[:p] * m.n
        U[0, 0] = m.n
        U[0, 1:] = s
        U[1:, 0] = s
        U[1:, 1:] = m.raw()[:p, :p]
        J = np.eye(q)
        J[0, 0] = 0.0
        Minv = np.linalg.pinv(U + ridge_alpha * J)
        xy = np.concatenate([[m.mean[p] * m.n], m.raw()[:p, p]])
        beta = Minv @ xy
        rows.append((r["dataset"], float(beta[0]), beta[1:].tolist(), [row.tolist() for row in Minv]))
    fit = spark.createDataFrame(rows, "dataset STRING, b0 DOUBLE, coef ARRAY<DOUBLE>, minv ARRAY<ARRAY<DOUBLE>>")
    u = F.concat(F.array(F.lit(1.0)), F.col("spectrum"))
    h = A.let(u, lambda uu: F.aggregate(
        F.zip_with(uu, F.col("minv"), lambda ui, row: ui * A.arr_dot(row, uu)), A.zero(), lambda acc, v: acc + v))
    pred = F.col("b0") + A.arr_dot("spectrum", "coef")
    return (spectra.join(fit, "dataset", "left")
            .select("dataset", "sample_id", F.col("target").alias("y_true"), pred.alias("y_fit"), h.alias("leverage"))
            .withColumn("y_pred", F.col("y_true") - (F.col("y_true") - F.col("y_fit")) / F.nullif(1 - F.col("leverage"), F.lit(0.0))))


def loo_metrics(loo: DataFrame) -> DataFrame:
    """R2, RMSE, MAE, RPD of leave-one-out predictions; null when < 3 samples."""
    e = F.col("y_pred") - F.col("y_true")
    agg = loo.groupBy("dataset").agg(F.count("y_pred").alias("n"), F.sum(e * e).alias("_sse"),
                                     F.sum(F.abs(e)).alias("_sae"), F.var_pop("y_true").alias("_vt"))
    rmse = F.sqrt(F.try_divide("_sse", "n"))
    ok = F.col("n") >= 3
    return agg.select("dataset", "n",
                      F.when(ok & (F.col("_vt") > 0), 1 - F.try_divide(F.col("_sse"), F.col("_vt") * F.col("n"))).alias("r2"),
                      F.when(ok, rmse).alias("rmse"), F.when(ok, F.try_divide("_sae", "n")).alias("mae"),
                      F.when(ok & (rmse > 0), F.try_divide(F.sqrt("_vt"), rmse)).alias("rpd"))


# ----------------------------------------------------------------- importance

PERMUTE_ROWS = 4096        # rows that are permuted among themselves


def permutation_importance(spectra: DataFrame, coefs: DataFrame | None = None, n_repeats: int = 15, seed: int = 42,
                           predictors: dict | None = None) -> DataFrame:
    """Drop in R2 when one band is permuted: mean and population standard deviation over the
    repeats, by (dataset, band).

    Models are linear (``coefs``: dataset, intercept, coef) or any (``predictors``: dataset ->
    object with ``predict(matrix)``, and ``predict_permuted(matrix, partner)`` where it knows a
    shorter way).  Rows are dealt into blocks of about ``PERMUTE_ROWS`` by a
    hash of the id, and a repeat permutes the rows of each block among themselves, which is a
    permutation of the whole column: so one shuffle brings rows together, once for all
    repeats and bands, and no row is copied or sorted a second time.  A linear model's new
    prediction is the old one plus coef * (value of the partner - own value); other models
    predict again.  Sums of squared errors by (repeat, band) are what leaves a block."""
    rows = spectra.select("dataset", "sample_id", "spectrum", "target").where("target is not null and spectrum is not null")
    linear = {r["dataset"]: (r["intercept"], np.array(r["coef"])) for r in coefs.collect()} if coefs is not None else {}
    sizes = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.var_pop("target").alias("vt"))
    blocks = sizes.select("dataset", F.ceil(F.col("n") / PERMUTE_ROWS).alias("blocks"))
    dealt = rows.join(blocks, "dataset").withColumn("block", F.pmod(F.xxhash64("sample_id", F.lit(seed)), F.col("blocks")).cast("int")).drop("blocks")

    def drops(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pd.util.hash_array(pdf["sample_id"].to_numpy())
        order = np.lexsort((pdf["target"].to_numpy(), ids))
        x = np.stack([np.asarray(v, dtype=float) for v in pdf["spectrum"]])[order]
        y, ids = pdf["target"].to_numpy(dtype=float)[order], ids[order]
        n, p = x.shape
        model = (predictors or linear).get(key[0])
        if model is None:
            return pd.DataFrame([], columns=["dataset", "repeat", "band", "sse", "sse0"])
        base = model.predict(x) if predictors else model[0] + x @ model[1]
        e0, out = base - y, []
        for repeat in range(n_repeats):
            partner = np.random.default_rng([seed, repeat, int(ids[0] % (1 << 32))]).permutation(n)
            if predictors and hasattr(model, "predict_permuted"):
                sse = ((model.predict_permuted(x, partner) - y) ** 2).sum(1)
            elif predictors:
                sse = np.empty(p)
                for start in range(0, p, 8):
                    bands = np.arange(start, min(start + 8, p))
                    many = np.repeat(x[None], len(bands), 0)
                    many[np.arange(len(bands)), :, bands] = x[partner][:, bands].T
                    guess = model.predict(many.reshape(-1, p)).reshape(len(bands), n)
                    sse[bands] = ((guess - y) ** 2).sum(1)
            else:
                d = (x[partner] - x) * model[1]
                sse = (e0 @ e0) + 2 * e0 @ d + (d * d).sum(0)
            out += [(key[0], repeat, band, v, float(e0 @ e0)) for band, v in enumerate(sse.tolist())]
        return pd.DataFrame(out, columns=["dataset", "repeat", "band", "sse", "sse0"])

    sums = dealt.groupBy("dataset", "block").applyInPandas(drops, "dataset STRING, repeat INT, band INT, sse DOUBLE, sse0 DOUBLE")
    per = sums.groupBy("dataset", "repeat", "band").agg(F.sum(F.col("sse") - F.col("sse0")).alias("more")).join(sizes, "dataset")
    per = per.withColumn("drop", F.try_divide(F.col("more"), F.col("vt") * F.col("n")))
    return per.groupBy("dataset", "band").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))


def native_importance(coefs: DataFrame) -> DataFrame:
    """Coefficient magnitudes per band of each fitted model (fold -1 = final refit)."""
    return coefs.select("dataset", "preprocessing", "model", "fold", F.posexplode("coef").alias("band", "coef_value")) \
        .withColumn("importance", F.abs("coef_value")).withColumn("band", F.col("band").cast("int"))


LOO_BYTES = 1 << 27        # moments that tasks get at once; more datasets go in several passes


def _pls_without_row(m: Moments, x: np.ndarray, y: np.ndarray, n_components: int) -> np.ndarray:
    """Predictions of rows by the PLS models of all rows but each row itself.

    Without row i, sums of products of deviations are S - n / (n - 1) d_i d_i': so a product
    with the matrix without row i is one with S, for all rows of the batch together, and a
    rank-one term.  Columns are standardised (ddof 1) with the deviations without row i."""
    n, p = m.n, len(m.mean) - 1
    f = n / (n - 1)
    dx, dy = x - m.mean[:p], y - m.mean[p]
    sxx = np.maximum(np.diag(m.cov_ss)[:p] - f * dx * dx, 0.0)
    syy = np.maximum(m.cov_ss[p, p] - f * dy * dy, 0.0)
    sx, sy = np.sqrt(sxx / (n - 2)), np.sqrt(syy / (n - 2))
    sx[sx == 0] = 1.0
    sy[sy == 0] = 1.0
    xty = (m.cov_ss[:p, p] - f * dx * dy[:, None]) / sx / sy[:, None]
    spread = m.cov_ss[:p, :p]

    def product(v: np.ndarray) -> np.ndarray:
        u = v / sx
        return (u @ spread - f * dx * (u * dx).sum(1, keepdims=True)) / sx

    coef, rs, ps = np.zeros_like(x), [], []
    going = np.ones(len(x), bool)
    for _ in range(min(n_components, p)):
        norm = np.linalg.norm(xty, axis=1)
        going &= norm > 1e-300
        w = xty / np.where(going, norm, 1.0)[:, None]
        r = w.copy()
        for rj, pj in zip(rs, ps):
            r -= (pj * w).sum(1, keepdims=True) * rj
        xr = product(r)
        tt = (r * xr).sum(1)
        going &= tt > 1e-300
        safe = np.where(going, tt, 1.0)
        pa, qa = xr / safe[:, None], np.where(going, (r * xty).sum(1) / safe, 0.0)
        xty = xty - pa * (qa * safe)[:, None]
        rs.append(r)
        ps.append(pa)
        coef += np.where(going[:, None], r * qa[:, None], 0.0)
    coef = coef / sx * sy[:, None]
    # the row's deviation from the means without it is f times its deviation
    return m.mean[p] - dy / (n - 1) + f * (coef * dx).sum(1)


def loo_pls(spectra: DataFrame, n_components: int = 8) -> DataFrame:
    """Exact leave-one-out PLS: each row is predicted by the model of its dataset's moments
    without the row's own contribution, so no refit touches the data.  One Gram pass per
    dataset, then one pass over the rows; a batch takes one matrix product a component.
    Datasets with fewer than three usable rows and rows that cannot be used get nulls."""
    moments = gram_pass(spectra, ["dataset"], "spectrum", "target").collect()
    packed = sorted((r["dataset"], r["p"], np.asarray(r["g"], dtype=float)) for r in moments)
    size = max([8 * len(g) for _, _, g in packed], default=1)
    step = max(1, LOO_BYTES // size)
    parts = [packed[i:i + step] for i in range(0, len(packed), step)] or [[]]
    rows, out = spectra.select("dataset", "sample_id", "spectrum", "target"), None
    for number, part in enumerate(parts):
        tables = {ds: Moments.from_packed(g, p + 1) for ds, p, g in part}

        def run(batches, tables=tables):
            for pdf in batches:
                guess = np.full(len(pdf), np.nan)
                y = pdf["target"].to_numpy(dtype=float)
                whole = np.array([v is not None and not np.isnan(np.asarray(v, dtype=float)).any() for v in pdf["spectrum"]], bool) & ~np.isnan(y)
                for ds, m in tables.items():
                    at = np.flatnonzero(whole & (pdf["dataset"] == ds).to_numpy())
                    if len(at) and m.n >= 3:
                        x = np.stack([np.asarray(v, dtype=float) for v in pdf["spectrum"].iloc[at]])
                        guess[at] = _pls_without_row(m, x, y[at], n_components)
                yield pd.DataFrame({"dataset": pdf["dataset"], "sample_id": pdf["sample_id"], "y_true": pdf["target"], "y_pred": guess})

        mine = rows if len(parts) == 1 else rows.where(F.col("dataset").isin([ds for ds, *_ in part]))
        got = mine.mapInPandas(run, "dataset STRING, sample_id BIGINT, y_true DOUBLE, y_pred DOUBLE")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("y_pred", F.nanvl("y_pred", F.lit(None).cast("double")))
