"""Random forests on binned bands: every tree, fold and grid point from one growing step.

A tree sees each row as often as a Poisson(1) number says that is drawn from a hash of the
row's id and the tree, and a node looks at bands that are drawn from a hash of the node's
path; so no forest depends on layout, order or the number of tasks.  Splits are the
best ones by squared error on binned bands.  Fewer trees are a prefix of more, and a
smaller ``max_depth`` cuts the same trees, so only ``min_samples_*`` and ``max_features``
need forests of their own.

``grow`` takes all trees of a task level by level: entries (tree, row) are sorted by (node,
band, bin), sums of equal keys give the counts and target sums from which every split of
every node is read.  A group of rows that fits into a task (``LOCAL_ROWS``) is grown there.
More rows first go through Spark passes, one aggregation a level for many trees together,
until every node is small enough; then the rows of a node meet in one task, which grows the
rest.  Both ways give the same trees.

Importances are decreases of squared error by band, as shares within a tree, averaged over
trees.  Out-of-bag scores (R2) come from the rows a tree has not drawn.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.operators.histograms import BINS, band_cuts, binned_rows, matrix, row_hash, uniform
from prismlake.jvm import with_call
from prismlake.sources.files import scratch_path

# The grid of the runtime search, and the fixed-set configuration.
GRID = {"n_estimators": [200, 500], "max_depth": [None, 10, 20], "min_samples_split": [2, 5], "min_samples_leaf": [1, 2],
        "max_features": ["sqrt", 0.5]}
FIXED = {"n_estimators": [200], "max_depth": [None], "min_samples_split": [2], "min_samples_leaf": [1], "max_features": ["sqrt"]}

LOCAL_ROWS = 200_000
TREES = 100                # trees of the chosen forest that grow in one task
ENTRIES = 1_000_000        # entries times bands that a growing step sorts at once
SUM_BYTES = 1 << 26        # node sums that a task of a Spark pass holds
DEEPEST = 64               # depth without a limit; the bins of a node run out long before
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 16)]))


@dataclass(frozen=True)
class Spec:
    """What makes a forest of its own."""
    min_split: int
    min_leaf: int
    features: str | float

    def width(self, p: int) -> int:
        return max(1, int(np.sqrt(p)) if self.features == "sqrt" else int(self.features * p))


def weights(rid: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """(trees, rows): how often each tree draws each row."""
    return np.stack([np.searchsorted(POISSON, uniform(rid, 1, int(t)), "right") for t in trees]).astype(float)


def root_paths(trees: np.ndarray) -> np.ndarray:
    return row_hash(trees.astype(np.int64) + (1 << 40))


def child_paths(path: np.ndarray) -> np.ndarray:
    """Paths of left and right children, one after the other."""
    return np.stack([row_hash(path ^ np.uint64(1)), row_hash(path ^ np.uint64(2))], 1).ravel()


def node_bands(path: np.ndarray, width: int, p: int) -> np.ndarray:
    """(nodes, width): the bands a node looks at, ascending."""
    if width >= p:
        return np.tile(np.arange(p), (len(path), 1))
    drawn = row_hash((path[:, None] ^ row_hash(np.arange(p))[None, :]).view(np.int64))
    return np.sort(np.argpartition(drawn, width - 1, axis=1)[:, :width], 1)


def _cells(node: np.ndarray, binned: np.ndarray, w: np.ndarray, wy: np.ndarray, n_bins: int, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (node, slot, bin) of entries with their counts and sums."""
    width = binned.shape[1]
    size = nodes * width * n_bins
    if size <= 2 * binned.size:                              # nodes of many rows: a place for each key
        n, s = np.empty((nodes, width, n_bins)), np.empty((nodes, width, n_bins))
        first = node * n_bins
        for slot, column in enumerate(np.ascontiguousarray(binned.T)):       # a slot's bins side by side
            at = first + column
            n[:, slot] = np.bincount(at, w, nodes * n_bins).reshape(nodes, n_bins)
            s[:, slot] = np.bincount(at, wy, nodes * n_bins).reshape(nodes, n_bins)
        key = np.flatnonzero(n)
        return key, n.ravel()[key], s.ravel()[key]
    # the entry's number goes into the key, so that plain values are sorted
    bits = int(len(node)).bit_length()
    packed = (((node[:, None] * width + np.arange(width)) * n_bins + binned << bits) | np.arange(len(node))[:, None]).ravel()
    packed.sort()
    key, entry = packed >> bits, packed & ((1 << bits) - 1)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(w[entry], first), np.add.reduceat(wy[entry], first)


def split_cells(key: np.ndarray, n: np.ndarray, s: np.ndarray, nodes: int, width: int, n_bins: int,
                min_leaf: int, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the slot (-1: no split), the bin up to which values go left, and the
    gain.  ``s`` are sums of differences from the node's mean, so that running sums do not grow
    from node to node and equal gains stay equal; ``scale``: the node's squared sum by its
    count.  Gains that agree to ten digits are ties, which the first band and bin win."""
    part = key // n_bins                                     # (node, slot)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    size = np.diff(np.append(starts, len(key)))
    cum_n, cum_s = np.cumsum(n), np.cumsum(s)
    before_n, before_s = (np.repeat(np.append(0.0, c)[starts], size) for c in (cum_n, cum_s))
    total_n = np.repeat(np.add.reduceat(n, starts), size)
    nl, sl = cum_n - before_n, cum_s - before_s
    nr = total_n - nl
    fine = (nl >= min_leaf) & (nr >= min_leaf) & (nr > 0)
    gain = np.divide(sl * sl * total_n, nl * nr, out=np.full(len(key), -1.0), where=fine)
    owner = part // width
    best = np.full(nodes, -1.0)
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    best[owner[edge]] = np.maximum.reduceat(gain, edge)
    good = best > 1e-12 * np.maximum(scale, 1e-300)
    near = np.flatnonzero(good[owner] & (gain >= (best - 1e-10 * np.abs(best))[owner]))
    first_owner = owner[near]                                # ascending, as the keys are
    first = np.flatnonzero(np.append(True, first_owner[1:] != first_owner[:-1])[:len(near)])
    first_owner, at = first_owner[first], near[first]
    slot, cut = np.full(nodes, -1), np.zeros(nodes, int)
    slot[first_owner], cut[first_owner] = part[at] % width, key[at] % n_bins
    return slot, cut, np.where(good, best, 0.0)


def grow(bins: np.ndarray, y: np.ndarray, node: np.ndarray, row: np.ndarray, w: np.ndarray, path: np.ndarray, spec: Spec,
         limits: tuple[int, ...], depth: int = 0, n_bins: int = BINS, min_splits: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Grow trees from their nodes at ``depth``.  Entries stand for a ``row`` in a ``node`` that
    a tree has drawn ``w`` times (0: only to be predicted).  Gives (limits, entries) the
    predictions with at most so many levels, for limits of at least ``depth``, and (limits,
    nodes, bands) the gains below the nodes.

    ``min_splits`` takes the place of ``spec.min_split``: a node splits in the same way whatever
    the least number of rows is, so a larger one only stops earlier, and one growth gives
    (min_splits * limits, ...) results."""
    p, width = bins.shape[1], spec.width(bins.shape[1])
    least = np.maximum(min_splits or (spec.min_split,), 2 * spec.min_leaf)
    stops = [(v, limit) for v in range(len(least)) for limit in limits]
    out, gains = np.zeros((len(stops), len(row))), np.zeros((len(stops), len(path), p))
    now, alive, root = np.zeros((len(least), len(row))), np.arange(len(row)), np.arange(len(path))
    open_ = np.ones((len(least), len(path)), bool)           # nodes that the tree of a least number has
    while True:
        wa, ya = w[alive], y[row[alive]]
        n, s, ss = (np.bincount(node, v, len(path)) for v in (wa, wa * ya, wa * ya * ya))
        mean = s / np.maximum(n, 1)
        for v, mine in enumerate(open_):
            here = slice(None) if mine.all() else mine[node]
            now[v, alive[here]] = mean[node[here]]
        for i, (v, limit) in enumerate(stops):
            if limit == depth:
                out[i] = now[v]
        open_ = open_ & (n >= least[:, None]) & (ss - s * mean > 1e-12 * np.maximum(ss, 1e-300))
        active = open_.any(0)
        if depth >= max(limits) or not active.any():
            break
        number = np.cumsum(active) - 1
        keep = active[node]
        alive, node = alive[keep], number[node[keep]]
        path, root, open_ = path[active], root[active], open_[:, active]
        bands = node_bands(path, width, p)
        mean, scale = mean[active], (s * mean)[active]
        slot, cut, gain = np.full(len(path), -1), np.zeros(len(path), int), np.zeros(len(path))
        used = np.flatnonzero(w[alive] > 0)
        used = used[np.argsort(node[used], kind="stable")]
        # nodes in runs that are sorted together
        edges = np.searchsorted(node[used], np.arange(len(path) + 1))
        start = 0
        while start < len(path):
            end = max(start + 1, int(np.searchsorted(edges, edges[start] + ENTRIES // width, "right")) - 1)
            e = used[edges[start]:edges[end]]
            ew, local = w[alive[e]], node[e] - start
            er = row[alive[e]]
            binned = bins[er[:, None], bands[node[e]]] if width < p else bins[er]
            cells = _cells(local, binned, ew, ew * (y[er] - mean[node[e]]), n_bins, end - start)
            slot[start:end], cut[start:end], gain[start:end] = split_cells(*cells, end - start, width, n_bins, spec.min_leaf,
                                                                                        scale[start:end])
            start = end
        split = slot >= 0
        band = bands[np.arange(len(path)), np.maximum(slot, 0)]
        for v, mine in enumerate(open_):
            at = np.flatnonzero(split & mine)
            found = np.bincount(root[at] * p + band[at], gain[at], gains[0].size).reshape(gains[0].shape)
            for i, (u, limit) in enumerate(stops):
                if u == v and limit > depth:
                    gains[i] += found
        number = np.cumsum(split) - 1
        keep = split[node]
        alive, node = alive[keep], node[keep]
        right = bins[row[alive], band[node]] > cut[node]
        node = 2 * number[node] + right
        path, root, open_ = child_paths(path[split]), np.repeat(root[split], 2), np.repeat(open_[:, split], 2, 1)
        depth += 1
    for i, (v, limit) in enumerate(stops):
        if limit >= depth:
            out[i] = now[v]
    return out, gains


@dataclass(frozen=True)
class Search:
    grid: dict[str, list]
    k: int
    inner_k: int
    n_bins: int

    @property
    def specs(self) -> list[Spec]:
        return [Spec(*v) for v in itertools.product(self.grid["min_samples_split"], self.grid["min_samples_leaf"], self.grid["max_features"])]

    @property
    def forests(self) -> list[list[int]]:
        """Numbers of the specifications that only differ in ``min_samples_split``: one growth."""
        alike: dict[tuple, list[int]] = {}
        for i, spec in enumerate(self.specs):
            alike.setdefault((spec.min_leaf, spec.features), []).append(i)
        return list(alike.values())

    @property
    def growths(self) -> list[list[int]]:
        """The forests that also differ in ``min_samples_leaf`` only, the smallest first: they grow
        together until they split differently."""
        alike: dict[str | float, list[int]] = {}
        for numbers in sorted(self.forests, key=lambda v: self.specs[v[0]].min_leaf):
            alike.setdefault(self.specs[numbers[0]].features, []).extend(numbers)
        return list(alike.values())

    @property
    def limits(self) -> tuple[int, ...]:
        return tuple(DEEPEST if d is None else d for d in self.grid["max_depth"])

    @property
    def sizes(self) -> list[int]:
        return sorted(self.grid["n_estimators"])

    @property
    def points(self) -> list[tuple[int, int]]:
        """(index of the depth limit, index of the number of trees)."""
        return [(d, t) for d in range(len(self.limits)) for t in range(len(self.sizes))]

    @property
    def inners(self) -> list[int]:
        return [-1, *range(self.inner_k)] if len(self.points) * len(self.specs) > 1 else [-1]

    def params(self, spec: int, point: int) -> str:
        s, (d, t) = self.specs[spec], self.points[point]
        return json.dumps({"n_estimators": self.sizes[t], "max_depth": self.grid["max_depth"][d], "min_samples_split": s.min_split,
                           "min_samples_leaf": s.min_leaf, "max_features": s.features})


def _shares(gains: np.ndarray) -> np.ndarray:
    """(limits, trees, bands) gains as shares within a tree."""
    total = gains.sum(2, keepdims=True)
    return np.divide(gains, total, out=np.zeros_like(gains), where=total > 0)


def forest_rows(bins: np.ndarray, y: np.ndarray, rid: np.ndarray, trained: np.ndarray, spec: Spec, limits: tuple[int, ...], sizes: list[int],
                n_bins: int = BINS, min_splits: tuple[int, ...] = (), wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest on rows at hand: (limits, sizes, rows) predictions, the same of the trees that
    have not drawn a row (not a number where all have), and (limits, sizes, bands) importances;
    with ``min_splits`` (min_splits * limits, ...), as in ``grow``.  Rows that are not ``wanted``
    get no predictions."""
    n, stops = len(y), len(limits) * max(1, len(min_splits))
    total, bag, count = np.zeros((stops, n)), np.zeros((stops, n)), np.zeros(n)
    shares = np.zeros((stops, bins.shape[1]))
    out = np.zeros((3, stops, len(sizes), n))
    importance = np.zeros((stops, len(sizes), bins.shape[1]))
    step = max(1, ENTRIES // (4 * n))
    cuts = sorted({*range(0, sizes[-1], step), *sizes})
    for a, b in zip(cuts, cuts[1:]):
        trees = np.arange(a, b)
        w = weights(rid, trees) * trained
        tree, row = np.nonzero(np.ones(w.shape, bool) if wanted is None else (w > 0) | wanted)
        found, gains = grow(bins, y, tree, row, w[tree, row], root_paths(trees), spec, limits, 0, n_bins, min_splits)
        value = np.zeros((stops, b - a, n))
        value[:, tree, row] = found
        outside = w == 0
        total += value.sum(1)
        bag += (value * outside).sum(1)
        count += outside.sum(0)
        shares += _shares(gains).sum(1)
        if b in sizes:
            k = sizes.index(b)
            out[0, :, k] = total / b
            out[1, :, k] = np.divide(bag, count, out=np.full_like(bag, np.nan), where=count > 0)
            importance[:, k] = shares / b
    return out[0], out[1], importance


SCHEMA = ("dataset string, preprocessing string, model string, fold int, sample_id {id}, params string, inner_rmse double, y_true double, "
          "y_pred double, oob_r2 double, importance array<double>")
NAMES = ["dataset", "preprocessing", "model", "fold", "sample_id", "params", "inner_rmse", "y_true", "y_pred", "oob_r2", "importance"]
ROW_SCHEMA = ("dataset string, preprocessing string, cv int, spec int, sample_id {id}, y double, values array<double>, sse array<double>, "
              "n long, folds int, oob array<double>, importance array<array<double>>")


def _r2(y: np.ndarray, guess: np.ndarray) -> float | None:
    known = ~np.isnan(guess)
    spread = ((y[known] - y[known].mean()) ** 2).sum() if known.any() else 0.0
    return float(1 - ((y[known] - guess[known]) ** 2).sum() / spread) if spread > 0 else None


def pack_rows(pdf: pd.DataFrame) -> bytes:
    """Rows, ordered, as ``ForestGrower`` reads them."""
    bins = matrix(pdf["bins"])
    parts = [np.array(bins.shape, "<i4"), *(pdf[c].to_numpy().astype(t) for c, t in (("rid", "<i8"), ("y", "<f8"), ("fold", "<i4"), ("inner", "<i4")))]
    return b"".join(x.tobytes() for x in (*parts, bins))


def pack_job(cv: int, inner: int, trees: tuple[int, int], specs: list[Spec], limits: tuple[int, ...], sizes: list[int], p: int, n_bins: int) -> bytes:
    """``specs`` differ in the sizes of nodes and leaves only, which ascend."""
    lists = [v for part in ([s.min_split for s in specs], [s.min_leaf for s in specs], limits, sizes, POISSON) for v in (len(part), *part)]
    return np.array([cv, inner, *trees, n_bins, specs[0].width(p), *lists], "<f8").tobytes()


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["rid", "sample_id"]).reset_index(drop=True)


def _table_task(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _ordered(pdf)
    return pd.DataFrame([(*key, pack_rows(pdf), len(matrix(pdf["bins"].iloc[:1])[0]))], columns=["dataset", "preprocessing", "rows", "bands"])


def _grown(tables: DataFrame, jobs: list[tuple]) -> DataFrame:
    """``ForestGrower`` on each job (dataset, preprocessing, cv, cj, forest, first tree, packed job) and
    its table, each job on its own; small rows with its result as ``part``."""
    spark, by = tables.sparkSession, ["cv", "cj", "forest", "first"]
    listed = spark.createDataFrame(jobs, "d string, s string, cv int, cj int, forest int, first int, job binary")
    work = tables.join(F.broadcast(listed), F.col("dataset").eqNullSafe(F.col("d")) & F.col("preprocessing").eqNullSafe(F.col("s")))
    work = work.select("dataset", "preprocessing", *by, "rows", "job").repartition(max(1, len(jobs)), "dataset", "preprocessing", *by)
    return with_call(work, "part", "ForestGrower", ["rows", "job"]).drop("rows", "job")


def _chosen(tables: DataFrame, bands: dict[tuple, int], search: Search, folds: list[int]) -> dict[tuple, tuple[int, int, float | None]]:
    """(dataset, preprocessing, outer fold) -> specification, point and mean inner RMSE.  A task
    grows the forests that go together (``Search.growths``) without one outer and one inner fold;
    their errors, a few numbers, come to the driver."""
    errors: dict[tuple, dict[tuple[int, int], list[float]]] = {(*key, f): {} for key in bands for f in folds}
    inners = search.inners[1:]
    if inners:
        jobs = [(*key, f, j, i, 0, pack_job(f, j, (0, search.sizes[-1]), [search.specs[v] for v in numbers], search.limits, search.sizes, p, search.n_bins))
                for key, p in bands.items() for f in folds for j in inners for i, numbers in enumerate(search.growths)]
        for r in sorted(_grown(tables, jobs).collect(), key=lambda r: r["cj"]):
            n, *sse = np.frombuffer(r["part"], "<f8")
            numbers = search.growths[r["forest"]]
            for v, of_spec in zip(numbers, np.reshape(sse, (len(numbers), -1))):
                for point, e in enumerate(of_spec if n else []):
                    errors[r["dataset"], r["preprocessing"], r["cv"]].setdefault((v, point), []).append(float(np.sqrt(e / n)))
    out = {}
    for key, found in errors.items():
        rmse, spec, point = min(((float(np.mean(e)), *at) for at, e in found.items()), default=(None, 0, 0))
        out[key] = (spec, point, rmse)
    return out


def _fold_task(search: Search, chosen: dict[tuple, tuple[int, int, float | None]]):
    """Rows of one (dataset, preprocessing) and the parts of its forest without an outer fold, in
    order of the trees: predictions of the held-out rows, and a row without a sample for the forest."""
    def run(key, pdf: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        pdf, cv = _ordered(pdf), int(key[2])
        spec, point, rmse = chosen[key[0], key[1], cv]
        y, train, n = pdf["y"].to_numpy(), pdf["fold"].to_numpy() != cv, len(pdf)
        head = (*key[:2], "rf", cv)
        if train.sum() < 2:                               # the fold fails: its rows keep a null prediction
            return pd.DataFrame([(*head, i, None, None, t, None, None, None) for i, t in zip(pdf["sample_id"][~train], y[~train])],
                                columns=NAMES, dtype=object)
        size = search.sizes[search.points[point][1]]
        total, count, shares = np.zeros(n), np.zeros(n), 0.0
        for part in parts.sort_values("first")["part"]:
            total += np.frombuffer(part, "<f8", n)
            count += np.frombuffer(part, "<i4", n, 8 * n)
            shares = shares + np.frombuffer(part, "<f8", -1, 12 * n)
        params, mean = search.params(spec, point), np.divide(total, count, out=np.full(n, np.nan), where=count > 0)
        rows = [(*head, i, params, rmse, t, v, None, None) for i, t, v in zip(pdf["sample_id"][~train], y[~train], mean[~train])]
        rows.append((*head, None, params, rmse, None, None, _r2(y[train], mean[train]), (shares / size).tolist()))
        return pd.DataFrame(rows, columns=NAMES, dtype=object)
    return run


def _small(rows: DataFrame, search: Search, folds: list[int]) -> DataFrame:
    """Forests of the groups that fit into a task."""
    spark, keys, id_type = rows.sparkSession, ["dataset", "preprocessing"], rows.schema["sample_id"].dataType.simpleString()
    path = scratch_path(spark, "forest-rows")
    rows.groupBy(*keys).applyInPandas(_table_task, "dataset string, preprocessing string, rows binary, bands int").write.mode("overwrite").parquet(path)
    tables = spark.read.parquet(path)
    bands = {(r["dataset"], r["preprocessing"]): r["bands"] for r in tables.select(*keys, "bands").collect()}
    tables, chosen, jobs = tables.select(*keys, "rows"), _chosen(tables.select(*keys, "rows"), bands, search, folds), []
    for (dataset, prep, f), (spec, point, _) in chosen.items():
        s, (d, t) = search.specs[spec], search.points[point]
        for first in range(0, search.sizes[t], TREES):
            trees = (first, min(first + TREES, search.sizes[t]))
            jobs.append((dataset, prep, f, -1, 0, first, pack_job(f, -1, trees, [s], search.limits[d:d + 1], [], bands[dataset, prep], search.n_bins)))
    done = scratch_path(spark, "forest-parts")
    _grown(tables, jobs).select(*keys, "cv", "first", "part").write.mode("overwrite").parquet(done)
    light = rows.select(*keys, "sample_id", "fold", "rid", "y", F.explode(F.array(*map(F.lit, folds))).alias("cv"))
    by = [*keys, "cv"]
    return light.groupBy(*by).cogroup(spark.read.parquet(done).groupBy(*by)).applyInPandas(_fold_task(search, chosen), SCHEMA.format(id=id_type))


# -- more rows than a task should hold ----------------------------------------------

@dataclass
class Top:
    """The first levels of many trees.  ``level[d]``: path of a split node -> (band, cut)."""
    splits: list[dict[tuple[int, int], tuple[int, int]]]
    means: list[dict[tuple[int, int], float]]
    gains: dict[int, np.ndarray]                          # tree number -> (levels, bands)


def _route(bins: np.ndarray, splits: list[dict], tree: int, path: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Path and depth of the last top node of each row."""
    at, depth = np.full(len(bins), path, np.uint64), np.zeros(len(bins), int)
    for d, table in enumerate(splits):
        for node in np.unique(at[depth == d]):
            found = table.get((tree, int(node)))
            if found:
                here = np.flatnonzero((at == node) & (depth == d))
                low, high = child_paths(np.array([node], np.uint64))
                at[here] = np.where(bins[here, found[0]] > found[1], high, low)
                depth[here] = d + 1
    return at, depth


def _large(rows: DataFrame, key: tuple[str, str], search: Search, folds: list[int], local_rows: int) -> DataFrame:
    """The rows of ``_fold_task`` for all folds and specifications of a (dataset, preprocessing)
    that no task should hold."""
    spark, p = rows.sparkSession, len(rows.select("bins").first()["bins"])
    limits, sizes, n_bins = search.limits, search.sizes, search.n_bins
    id_type = rows.schema["sample_id"].dataType.simpleString()
    light = rows.select("sample_id", "fold", "inner", "rid", "bins", "y")
    fits = [(f, j) for f in folds for j in search.inners]
    out = None
    for number, spec in enumerate(search.specs):
        width = spec.width(p)
        step = max(1, SUM_BYTES // (len(fits) * width * n_bins * 16))
        sums = None
        for first in range(0, sizes[-1], step):
            trees = list(range(first, min(first + step, sizes[-1])))
            top = _grow_top(light, fits, trees, spec, width, p, max(limits), local_rows, n_bins)
            part = _finish(light, fits, trees, spec, top, search, id_type)
            sums = part if sums is None else sums.unionByName(part)
        path = scratch_path(spark, "forest")
        sums.write.mode("overwrite").parquet(path)
        got = _scores(spark.read.parquet(path), light, fits, key, number, search, id_type)
        out = got if out is None else out.unionByName(got)
    return out


def _batch(b: pa.RecordBatch):
    return (matrix(b.column("bins")), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold", "inner", "rid")))


def _grow_top(light: DataFrame, fits: list[tuple[int, int]], trees: list[int], spec: Spec, width: int, p: int, deepest: int, local_rows: int,
              n_bins: int) -> Top:
    """Levels until every node has at most ``local_rows`` rows.  Tree numbers count (fit, tree)."""
    numbers = [(i, t) for i in range(len(fits)) for t in trees]
    roots = root_paths(np.array([t for _, t in numbers]))
    top = Top([], [], {})
    while len(top.splits) < deepest:
        depth, splits = len(top.splits), list(top.splits)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                bins, y, fold, inner, rid = _batch(b)
                drawn = dict(zip(trees, weights(rid, np.array(trees))))
                for number, (i, t) in enumerate(numbers):
                    f, j = fits[i]
                    w = drawn[t] * ((fold != f) & (inner != j))
                    at, deep = _route(bins, splits, number, roots[number])
                    for node in np.unique(at[(deep == depth)]):
                        here = np.flatnonzero((at == node) & (deep == depth) & (w > 0))
                        bands = node_bands(np.array([node], np.uint64), width, p)[0]
                        cell = (np.arange(width) * n_bins + bins[here][:, bands]).ravel()
                        x = np.zeros((3, width * n_bins))
                        x[0] = np.bincount(cell, np.repeat(w[here], width), width * n_bins)
                        x[1] = np.bincount(cell, np.repeat(w[here] * y[here], width), width * n_bins)
                        x[2, 0] = ((at == node) & (deep == depth)).sum()
                        x[2, 1] = (w[here] * y[here] ** 2).sum()
                        acc[number, int(node)] = acc[number, int(node)] + x if (number, int(node)) in acc else x
            yield pa.RecordBatch.from_pydict({"tree": pa.array([a for a, _ in acc], pa.int32()), "node": pa.array([str(b) for _, b in acc], pa.string()),
                                              "x": pa.array([v.tobytes() for v in acc.values()], pa.binary())})

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[tuple[int, str], np.ndarray] = {}
            for b in batches:
                for tree, node, x in zip(b.column("tree").to_pylist(), b.column("node").to_pylist(), b.column("x")):
                    x = np.frombuffer(x.as_buffer(), float)
                    acc[tree, node] = acc[tree, node] + x if (tree, node) in acc else x
            found = []
            for (tree, node), x in acc.items():
                x = x.reshape(3, -1)
                n, s = x[0, :n_bins].sum(), x[1, :n_bins].sum()
                rows_, ss = x[2, 0], x[2, 1]
                band = cut = -1
                gain = 0.0
                if rows_ > local_rows and n >= max(spec.min_split, 2 * spec.min_leaf) and ss - s * s / max(n, 1) > 1e-12 * max(ss, 1e-300):
                    cells = np.flatnonzero(x[0] > 0)
                    slot, at, best = split_cells(cells, x[0, cells], x[1, cells] - x[0, cells] * (s / n), 1, width, n_bins, spec.min_leaf, np.array([s * s / n]))
                    if slot[0] >= 0:
                        band, cut = int(node_bands(np.array([int(node)], np.uint64), width, p)[0][slot[0]]), int(at[0])
                        gain = float(best[0])
                found.append((tree, node, float(s / max(n, 1)), band, cut, gain))
            columns = list(zip(*found)) if found else [()] * 6
            types = [pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["tree", "node", "mean", "band", "cut", "gain"])

        found = (light.mapInArrow(partial, "tree int, node string, x binary").repartition("tree", "node")
                 .mapInArrow(choose, "tree int, node string, mean double, band int, cut int, gain double").collect())
        top.means.append({(r["tree"], int(r["node"])): r["mean"] for r in found})
        table = {(r["tree"], int(r["node"])): (r["band"], r["cut"]) for r in found if r["band"] >= 0}
        if not table:
            return top
        top.splits.append(table)
        for r in found:
            if r["band"] >= 0:
                top.gains.setdefault(r["tree"], np.zeros((deepest, p)))[depth, r["band"]] += r["gain"]
    return top


def _finish(light: DataFrame, fits: list[tuple[int, int]], trees: list[int], spec: Spec, top: Top, search: Search, id_type: str) -> DataFrame:
    """Rows of a node meet in a task that grows the rest of it: (fit, tree, sample_id, y, fold,
    inner, w, values by limit), and rows without a sample: gains by limit."""
    numbers = [(i, t) for i in range(len(fits)) for t in trees]
    roots = root_paths(np.array([t for _, t in numbers]))
    limits, n_bins, splits, means = search.limits, search.n_bins, top.splits, top.means

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bins, y, fold, inner, rid = _batch(b)
            drawn = dict(zip(trees, weights(rid, np.array(trees))))
            for number, (i, t) in enumerate(numbers):
                f, j = fits[i]
                at, deep = _route(bins, splits, number, roots[number])
                names = ["number", "node", "depth", "w", *b.schema.names]
                w = drawn[t] * ((fold != f) & (inner != j))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), number, np.int32)), pa.array([str(a) for a in at], pa.string()),
                                                  pa.array(deep.astype(np.int32)), pa.array(w), *b.columns], names=names)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        number, node, depth = int(pdf["number"].iloc[0]), int(pdf["node"].iloc[0]), int(pdf["depth"].iloc[0])
        pdf = pdf.sort_values(["rid", "sample_id"])
        bins, y = matrix(pdf["bins"]), pdf["y"].to_numpy()
        value, gains = grow(bins, y, np.zeros(len(y), int), np.arange(len(y)), pdf["w"].to_numpy(), np.array([node], np.uint64), spec, limits, depth, n_bins)
        for i, limit in enumerate(limits):
            if limit < depth:                              # cut above this node
                path = roots[number:number + 1]
                for d in range(limit):
                    band, cut = splits[d][number, int(path[0])]
                    path = child_paths(path)[int(bins[0, band] > cut):][:1]
                value[i], gains[i] = means[limit][number, int(path[0])], 0.0
        i, t = numbers[number]
        out = [(i, t, *r, None) for r in zip(*(pdf[c] for c in ("sample_id", "rid", "y", "fold", "inner", "w")), value.T.tolist())]
        out.append((i, t, *[None] * 7, gains[:, 0].ravel().tolist()))
        return pd.DataFrame(out, columns=["fit", "tree", "sample_id", "rid", "y", "fold", "inner", "w", "values", "gains"], dtype=object)

    schema = f"number int, node string, depth int, w double, sample_id {id_type}, fold int, inner int, rid long, bins binary, y double"
    done = light.mapInArrow(entries, schema).groupBy("number", "node", "depth").applyInPandas(
        finish, f"fit int, tree int, sample_id {id_type}, rid long, y double, fold int, inner int, w double, values array<double>, gains array<double>")
    extra = []
    for number, by_level in top.gains.items():
        i, t = numbers[number]
        extra.append((i, t, np.stack([by_level[:limit].sum(0) for limit in limits]).ravel().tolist()))
    if not extra:
        return done
    more = light.sparkSession.createDataFrame(extra, "fit int, tree int, gains array<double>")
    return done.unionByName(more, allowMissingColumns=True)


def _scores(sums: DataFrame, light: DataFrame, fits: list[tuple[int, int]], key: tuple[str, str], number: int, search: Search, id_type: str) -> DataFrame:
    """From the trees' values of a specification to the rows of ``_fold_task``."""
    spark, limits, sizes = sums.sparkSession, search.limits, search.sizes
    points = [(d, t) for d in range(len(limits)) for t in sizes]
    folds, inners = [f for f, j in fits if j == -1], search.inners
    held = F.create_map(*[F.lit(v) for i, (f, j) in enumerate(fits) for v in (i, f)])
    inner = F.create_map(*[F.lit(v) for i, (f, j) in enumerate(fits) for v in (i, j)])
    rows = sums.where("gains is null").withColumn("cv", held[F.col("fit")]).withColumn("cj", inner[F.col("fit")])
    use = rows.where(((F.col("cj") == -1)) | ((F.col("fold") != F.col("cv")) & (F.col("inner") == F.col("cj"))))
    mean = [F.avg(F.when(F.col("tree") < t, F.get("values", F.lit(d)))).alias(f"v{k}") for k, (d, t) in enumerate(points)]
    bag = [F.avg(F.when((F.col("tree") < t) & (F.col("w") == 0), F.get("values", F.lit(d)))).alias(f"b{k}") for k, (d, t) in enumerate(points)]
    by_row = use.groupBy("cv", "cj", "sample_id", "rid", "y", "fold").agg(*mean, *bag)
    values = F.array(*[f"v{k}" for k in range(len(points))])
    head = [F.lit(key[0]).alias("dataset"), F.lit(key[1]).alias("preprocessing"), "cv", F.lit(number).alias("spec")]
    none = {"sse": "array<double>", "n": "long", "folds": "int", "oob": "array<double>", "importance": "array<array<double>>"}
    predicted = by_row.where("cj = -1 and fold = cv").select(*head, "sample_id", "y", values.alias("values"),
                                                             *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    errors = by_row.where("cj >= 0").groupBy("cv", "cj").agg(*[F.sqrt(F.avg(F.pow(F.col(f"v{k}") - F.col("y"), 2))).alias(f"e{k}") for k in range(len(points))])
    errors = {r["cv"]: r for r in errors.groupBy("cv").agg(F.count(F.lit(1)).alias("folds"), *[F.avg(f"e{k}").alias(f"e{k}") for k in range(len(points))]).collect()}
    scored = by_row.where("cj = -1 and fold <> cv").groupBy("cv").agg(F.count(F.lit(1)).alias("n"), *[
        (1 - F.sum(F.pow(F.col("y") - F.col(f"b{k}"), 2)) / F.nullif(F.var_pop(F.when(F.col(f"b{k}").isNotNull(), F.col("y"))) * F.count(f"b{k}"), F.lit(0.0))
         ).alias(f"o{k}") for k in range(len(points))])
    scored = {r["cv"]: r for r in scored.collect()}
    gains = sums.where("gains is not null").select("fit", "tree", F.posexplode("gains").alias("at", "g")).groupBy("fit", "tree", "at").agg(F.sum("g").alias("g"))
    p = len(light.select("bins").first()["bins"])
    by_tree = gains.withColumn("d", F.floor(F.col("at") / p)).withColumn("band", F.col("at") % p)
    share = by_tree.withColumn("share", F.coalesce(F.try_divide(F.col("g"), F.sum("g").over(Window.partitionBy("fit", "tree", "d"))), F.lit(0.0)))
    imp = share.groupBy("fit", "d", "band").agg(*[F.sum(F.when(F.col("tree") < t, F.col("share"))).alias(f"t{t}") for t in sizes]).collect()
    importance = np.zeros((len(fits), len(limits), len(sizes), p))
    for r in imp:
        for k, t in enumerate(sizes):
            importance[r["fit"], r["d"], k, r["band"]] = (r[f"t{t}"] or 0.0) / t
    summary = []
    for f in folds:
        e, s = errors.get(f), scored.get(f)
        i = fits.index((f, -1))
        summary.append((*key, f, number, None, None, None, [e[f"e{k}"] for k in range(len(points))] if e else None, s["n"] if s else 0,
                        e["folds"] if e else 0, [s[f"o{k}"] for k in range(len(points))] if s else None,
                        importance[i].reshape(len(points), -1).tolist()))
    return predicted.unionByName(spark.createDataFrame(summary, ROW_SCHEMA.format(id=id_type)))


def _best(out: DataFrame, search: Search) -> DataFrame:
    """From the rows of ``_large`` to those of ``_fold_task``."""
    keys = ["dataset", "preprocessing", "cv", "spec"]
    names = F.array(*[F.array(*[F.lit(search.params(s, q)) for q in range(len(search.points))]) for s in range(len(search.specs))])
    summary = out.where("n is not null").select(*keys, "oob", "importance", F.posexplode(F.coalesce("sse", F.array_repeat(F.lit(None).cast("double"), len(search.points)))).alias("point", "inner_rmse"))
    rank = F.row_number().over(Window.partitionBy("dataset", "preprocessing", "cv").orderBy(F.col("inner_rmse").asc_nulls_last(), "spec", "point"))
    chosen = summary.withColumn("_rank", rank).where("_rank = 1").select(
        *keys, "point", "inner_rmse", F.get("oob", F.col("point")).alias("oob_r2"), F.get("importance", F.col("point")).alias("importance"),
        F.get(F.get(names, F.col("spec")), F.col("point")).alias("params"))
    held = out.where("n is null and cv >= 0").select(*keys, "sample_id", "y", "values")
    found = held.join(chosen.drop("oob_r2", "importance"), keys).withColumn("y_pred", F.get("values", F.col("point"))).withColumnRenamed("y", "y_true")
    both = found.drop("values").unionByName(chosen, allowMissingColumns=True)
    return both.select("dataset", "preprocessing", F.lit("rf").alias("model"), F.col("cv").alias("fold"), *NAMES[4:])


# -- cross-validation ------------------------------------------------------------------

def cv_forest(prepared: DataFrame, grid: dict[str, list] | None = None, k: int = 5, inner_k: int = 3, refit: bool = False, n_bins: int = BINS,
              local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, forests).  Predictions: dataset, preprocessing, model, fold,
    sample_id, params, inner_rmse, y_true, y_pred.  Forests, one row for each outer fold (and
    fold -1, trained on all rows, with ``refit``): params, inner_rmse, oob_r2, importance.  With
    more than one grid point each outer fold takes the one of smallest inner RMSE, the first
    of equal ones.  A fold with fewer than two training rows keeps null predictions."""
    spark, search = prepared.sparkSession, Search(grid or FIXED, k, inner_k, n_bins)
    path = scratch_path(spark, "binned")
    binned_rows(prepared, band_cuts(prepared, n_bins)).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    counts = {(r["dataset"], r["preprocessing"]): r["n"] for r in rows.groupBy("dataset", "preprocessing").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = sorted(key for key, n in counts.items() if n > local_rows)
    is_large = F.lit(False)
    for dataset, prep in large:
        is_large = is_large | ((F.col("dataset") == dataset) & (F.col("preprocessing") == prep))
    folds = [*range(k), *([-1] if refit else [])]
    out = None
    if len(counts) > len(large) or not counts:
        out = _small(rows.where(~is_large), search, folds)
    for key in large:
        part = rows.where((F.col("dataset") == key[0]) & (F.col("preprocessing") == key[1]))
        part = _best(_large(part, key, search, folds, local_rows), search)
        out = part if out is None else out.unionByName(part)
    done = scratch_path(spark, "forests")
    out.write.mode("overwrite").parquet(done)
    out = spark.read.parquet(done)
    forests = out.where("importance is not null").drop("sample_id", "y_true", "y_pred")
    return out.where("importance is null").drop("oob_r2", "importance"), forests
