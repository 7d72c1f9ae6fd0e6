"""Isolation-forest outlier scores.

Each tree is grown on a subsample of at most 256 rows (inherent to the method), those of
lowest hash of (id, tree) -- bounded, whatever the data size.  One pass over the rows
lets only those below a small hash threshold leave a task (if ever too few do, the
threshold is doubled).  A tree is grown per (dataset, tree) group, and trees are shipped as a broadcast of flat node arrays (size bounded by
datasets x T x 2 x 256 nodes and checked), and every row is scored in
``mapInPandas`` -- vectorised over an Arrow batch, one level of all trees at a
time.  The outlier cut is the (1 - contamination) quantile of the scores per
dataset (exact, bounded-memory quantile).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismlake.functions.distributed import group_quantiles
from prismlake.operators.histograms import uniform
from prismlake.sources.files import scratch_path

N_TREES = 100
MAX_SAMPLES = 256
CONTAMINATION = 0.1
MAX_BROADCAST_NODES = 50_000_000


def _c(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2.0 * (n - 1) / np.maximum(n, 1), 0.0)
    return np.where(n == 2, 1.0, out)


def _grow(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        me = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return me
        lo, hi = X[idx].min(0), X[idx].max(0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return me
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[me], thr[me] = f, t
        l = node(idx[X[idx, f] < t], depth + 1)
        r = node(idx[X[idx, f] >= t], depth + 1)
        left[me], right[me] = l, r
        return me

    node(np.arange(len(X)), 0)
    return feat, thr, left, right, size


def _drawn(base: DataFrame, share: dict[str, float], n_trees: int, seed: int) -> DataFrame:
    """(dataset, tree, u, sample_id, spectrum): for each tree the rows whose hash of (id, tree)
    is below the dataset's share.  Rows are read once; few of them come out."""
    def run(batches):
        for pdf in batches:
            ids = pd.util.hash_array(pdf["sample_id"].to_numpy()).view(np.int64)
            limit = pdf["dataset"].map(share).to_numpy(dtype=float)
            for tree in range(n_trees):
                u = uniform(ids, seed, tree)
                at = np.flatnonzero(u < limit)
                if len(at):
                    yield pdf.iloc[at].assign(tree=tree, u=u[at])[["dataset", "tree", "u", "sample_id", "spectrum"]]
    return base.mapInPandas(run, "dataset STRING, tree INT, u DOUBLE, sample_id BIGINT, spectrum ARRAY<DOUBLE>")


def _grower(max_samples: int, seed: int):
    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.sort_values(["u", "sample_id"]).head(max_samples)
        X = np.vstack([np.asarray(v, dtype=float) for v in part["spectrum"]])
        rng = np.random.default_rng([seed, int(key[1]), zlib.crc32(key[0].encode())])   # stable across processes
        f, th, l, r, s = _grow(X, rng, int(math.ceil(math.log2(max(len(X), 2)))))
        return pd.DataFrame([(key[0], int(key[1]), len(X), f, th, l, r, s)], columns=["dataset", "tree", "psi", "feat", "thr", "left", "right", "size"])
    return grow


def isolation_scores(spectra: DataFrame, n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES,
                     seed: int = 42) -> DataFrame:
    """(dataset, sample_id, score) with score = 2^(-E[h(x)] / c(psi)); higher = more isolated."""
    spark = spectra.sparkSession
    base = spectra.select("dataset", "sample_id", "spectrum")
    sizes = {r["dataset"]: r["n"] for r in base.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a tree takes the rows of lowest hash; only rows below a share that surely holds enough of them leave a task
    margin = 1.0
    while True:
        share = {ds: min(1.0, margin * (max_samples + 8 * math.sqrt(max_samples) + 16) / n) for ds, n in sizes.items()}
        forest = _drawn(base, share, n_trees, seed).groupBy("dataset", "tree").applyInPandas(
            _grower(max_samples, seed), "dataset STRING, tree INT, psi INT, feat ARRAY<INT>, thr ARRAY<DOUBLE>, left ARRAY<INT>, "
            "right ARRAY<INT>, size ARRAY<INT>").collect()
        if len(forest) == n_trees * len(sizes) and all(r["psi"] == min(max_samples, sizes[r["dataset"]]) for r in forest):
            break
        margin *= 2
    forest.sort(key=lambda r: (r["dataset"], r["tree"]))
    nodes = sum(len(r["feat"]) for r in forest)
    if nodes > MAX_BROADCAST_NODES:
        raise ValueError(f"forest of {nodes} nodes exceeds the broadcast bound")
    model: dict[str, list] = {}
    for r in forest:
        model.setdefault(r["dataset"], []).append(
            (np.array(r["feat"]), np.array(r["thr"]), np.array(r["left"]), np.array(r["right"]), np.array(r["size"]), r["psi"]))
    bc = spark.sparkContext.broadcast(model)

    def score(batches):
        trees_by_ds = bc.value
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            for ds, idx in pdf.groupby("dataset").indices.items():
                trees = trees_by_ds.get(ds)
                if not trees:
                    continue
                X = np.vstack([np.asarray(v, dtype=float) for v in pdf["spectrum"].iloc[idx]])
                total = np.zeros(len(idx))
                for feat, thr, left, right, size, psi in trees:
                    node = np.zeros(len(idx), dtype=np.int64)
                    depth = np.zeros(len(idx))
                    active = feat[node] >= 0
                    while active.any():
                        a = np.flatnonzero(active)
                        go_left = X[a, feat[node[a]]] < thr[node[a]]
                        node[a] = np.where(go_left, left[node[a]], right[node[a]])
                        depth[a] += 1
                        active = feat[node] >= 0
                    total += depth + _c(size[node])
                psi = trees[0][5]
                out[idx] = 2.0 ** (-(total / len(trees)) / float(_c(psi)))
            yield pd.DataFrame({"dataset": pdf["dataset"], "sample_id": pdf["sample_id"], "score": out})

    return base.mapInPandas(score, "dataset STRING, sample_id BIGINT, score DOUBLE")


def isolation_outliers(spectra: DataFrame, contamination: float = CONTAMINATION, **kw) -> DataFrame:
    path = scratch_path(spectra.sparkSession, "isolation")
    isolation_scores(spectra, **kw).write.mode("overwrite").parquet(path)          # scored once: the cut and the flags read it
    s = spectra.sparkSession.read.parquet(path)
    cut = group_quantiles(s, ["dataset"], "score", {"threshold": 1 - contamination})
    return s.join(cut, "dataset").withColumn("is_outlier", F.col("score") > F.col("threshold"))
