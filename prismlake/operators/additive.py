"""Models that add up trees round by round, for all folds and settings together.

A *fit* is one training set (outer fold, inner fold) with one setting.  In every round each
fit grows a tree on its current targets, level by level: rows give counts and target sums by
(node, band, bin), the sums are added up, and the best splits are read off.  Fewer rounds
are a prefix of more, so a grid over their number costs nothing.  The rows a round draws
follow from a hash of the row's id and the round, so nothing depends on layout or order.

Where the additions happen follows from the size of a (dataset, preprocessing) alone, and
both ways give the same trees:

* up to ``LOCAL_ROWS`` rows (a byte and four more a band, and eight bytes a fit for each number
  kept), which fit into one task: one task for each outer and inner fold, whose errors choose the
  point, then one for each outer fold,
* more: one Spark aggregation a level over all rows and fits.  Tasks reduce their rows to
  sums, sums of one fit meet in one task, and the splits (a few numbers a node) come to the
  driver.  Rows carry their state, written anew every ``REFRESH`` rounds.

A model is a ``Method``: what the trees aim at, what a round adds to a row's state, and
(where leaves hold linear models) how leaf moments become leaf models.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.operators.histograms import (BINS, PAIR_ROWS, band_cuts, band_pairs, best_splits, binned_rows, column_sums, descend, matrix, node_sums,
                                            pair_sums, to_bins, uniform)
from prismlake.sources.files import delete_path, scratch_path

LOCAL_ROWS = 200_000
TASKS_A_KEY = 16           # partitions for each key of long tasks, so that few keys share one
REFRESH = 10
FEW_NODES = 4              # nodes that are stepped down one by one
OUT_SCHEMA = ("dataset string, preprocessing string, model string, fold int, sample_id {id}, params string, inner_rmse double, "
              "y_true double, y_pred double, importance array<double>")
NAMES = ["dataset", "preprocessing", "model", "fold", "sample_id", "params", "inner_rmse", "y_true", "y_pred", "importance"]


@dataclass(frozen=True)
class Fit:
    setting: tuple         # of the model
    depth: int             # levels of splits
    share: float           # rows drawn a round
    fold: int              # rows of this outer fold are left out (-1: none)
    inner: int             # rows of this inner fold are left out (-1: none)


@dataclass
class Rows:
    bins: np.ndarray
    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    inner: np.ndarray
    rid: np.ndarray

    @staticmethod
    def of(table) -> "Rows":
        """From an Arrow batch or a pandas frame of binned rows."""
        column = table.column if isinstance(table, pa.RecordBatch) else table.__getitem__
        plain = lambda c: column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[c].to_numpy()
        bins = matrix(column("bins"))
        x = matrix(column("x")).view(float) if "x" in (table.schema.names if isinstance(table, pa.RecordBatch) else table.columns) else np.empty((len(bins), 0))
        return Rows(bins, x, *(plain(c) for c in ("y", "fold", "inner", "rid")))


class Method:
    """One additive model; the base class holds the trees of all rounds."""

    model = ""
    width = 1                                             # numbers of state that a row has for each fit
    min_leaf = 1
    leaf_moments = False                                  # whether leaves need the moments of their rows

    def __init__(self, fits: list[Fit]):
        self.fits, self.depth = fits, max(f.depth for f in fits)
        self.bands: list[np.ndarray] = []                 # a round: (fits, nodes of all levels)
        self.cuts: list[np.ndarray] = []
        self.gains: list[np.ndarray] = []

    def begin(self, n: np.ndarray, s: np.ndarray) -> None:
        """Training rows and target sums of each fit."""

    def start(self, rows: Rows) -> np.ndarray:
        """(width, fits, rows): state before the first round."""
        raise NotImplementedError

    def target(self, rows: Rows, state: np.ndarray, turn: int) -> np.ndarray:
        raise NotImplementedError

    def finish(self, sides: np.ndarray, moments: np.ndarray | None) -> None:
        """End of a round: (fits, leaves, 2) counts and sums, or moments of the leaves."""
        raise NotImplementedError

    def after(self, rows: Rows, state: np.ndarray, turn: int, leaf: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def predictions(self, state: np.ndarray, rounds: int) -> np.ndarray:
        raise NotImplementedError

    def params(self, rounds: int, setting: tuple) -> str:
        raise NotImplementedError

    def leaf(self, turn: int, bins: np.ndarray) -> np.ndarray:
        """(fits, rows): leaf of each row in the tree of a round."""
        node = np.zeros((len(self.fits), len(bins)), np.int64)
        for level in range(self.depth):
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            node = step(bins, node, self.bands[turn][:, nodes], self.cuts[turn][:, nodes])
        return node

    def advance(self, rows: Rows, state: np.ndarray, start: int, end: int) -> np.ndarray:
        for turn in range(start, end):
            state = self.after(rows, state, turn, self.leaf(turn, rows.bins))
        return state

    def importance(self, fit: int, rounds: int, p: int) -> list[float]:
        """Decrease of squared error by band, as shares of one."""
        out = np.zeros(p)
        for band, gain in zip(self.bands[:rounds], self.gains[:rounds]):
            np.add.at(out, np.maximum(band[fit], 0), np.where(band[fit] >= 0, gain[fit], 0.0))
        return (out / out.sum() if out.sum() else out).tolist()


def trained(fits: list[Fit], rows: Rows) -> np.ndarray:
    """(fits, rows): rows a fit is trained on."""
    out = np.array([f.fold for f in fits])[:, None] != rows.fold
    return out & (np.array([f.inner for f in fits])[:, None] != rows.inner)


def drawn(fits: list[Fit], rows: Rows, turn: int) -> np.ndarray:
    share = np.array([f.share for f in fits])
    out = trained(fits, rows)
    return out if (share >= 1).all() else out & (uniform(rows.rid, turn)[None, :] < share[:, None])


def step(bins: np.ndarray, node: np.ndarray, band: np.ndarray, cut: np.ndarray) -> np.ndarray:
    fit, row = np.arange(len(node))[:, None], np.arange(node.shape[1])[None, :]
    return descend(bins, node, row, band[fit, node], cut[fit, node])


class Round:
    """The trees of one round as far as they have grown."""

    def __init__(self, method: Method):
        self.fits, self.min_leaf = method.fits, method.min_leaf
        self.band: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.gain: list[np.ndarray] = []
        self.sides: np.ndarray | None = None

    def place(self, bins: np.ndarray) -> np.ndarray:
        """(fits, rows): node of each row at the level reached."""
        node = np.zeros((len(self.fits), len(bins)), np.int64)
        for band, cut in zip(self.band, self.cut):
            node = step(bins, node, band, cut)
        return node

    def sums(self, rows: Rows, node: np.ndarray, used: np.ndarray, target: np.ndarray, n_bins: int) -> np.ndarray:
        fit, row = np.nonzero(used)
        level = len(self.band)
        return node_sums(rows.bins, (fit << level) + node[fit, row], row, target[fit, row], len(self.fits) << level, n_bins)

    def grow(self, splits: dict[str, np.ndarray]) -> None:
        """Take the splits of the level, given as (fits * nodes) arrays."""
        shape = (len(self.fits), -1)
        deep = np.array([f.depth > len(self.band) for f in self.fits])[:, None]
        sides = splits["sides"].reshape(*shape, 4).copy()
        whole = sides[..., :2] + sides[..., 2:]
        sides[~deep[:, 0]] = np.concatenate([whole, np.zeros_like(whole)], -1)[~deep[:, 0]]
        self.band.append(np.where(deep, splits["band"].reshape(shape), -1))
        self.cut.append(splits["bin"].reshape(shape))
        self.gain.append(np.where(deep, splits["gain"].reshape(shape), 0.0))
        self.sides = sides

    def close(self, method: Method, moments: np.ndarray | None) -> None:
        for kept, grown in ((method.bands, self.band), (method.cuts, self.cut), (method.gains, self.gain)):
            kept.append(np.concatenate(grown, 1) if grown else np.empty((len(self.fits), 0)))
        sides = None if self.sides is None else self.sides.reshape(len(self.fits), -1, 2)      # children in order
        method.finish(sides, moments)


def leaf_moments(rows: Rows, leaf: np.ndarray, used: np.ndarray, target: np.ndarray, leaves: int) -> np.ndarray:
    """(fits, leaves, 1 + q + q * q): count, sums and cross-products of z = [x, target]."""
    q = rows.x.shape[1] + 1
    out = np.zeros((len(leaf), leaves, 1 + q + q * q))
    for fit in range(len(leaf)):
        for k in np.unique(leaf[fit][used[fit]]):
            at = used[fit] & (leaf[fit] == k)
            z = np.column_stack([rows.x[at], target[fit][at]])
            out[fit, k] = np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    return out


class Sums:
    """Counts and target sums of the nodes of all fits on rows at hand, level by level.  Fits
    that draw the same rows share the counts of their roots, and below the root only the smaller
    child of a node is added up: its sibling has the rest.  Where a node has many rows, two bands
    are added up together."""

    def __init__(self, fits: list[Fit], columns: np.ndarray, n_bins: int):
        self.fits, self.columns, self.n_bins = fits, columns, n_bins
        self.pairs = band_pairs(columns, n_bins) if columns.shape[1] >= PAIR_ROWS else None
        self.alike: dict[tuple, list[int]] = {}           # fits that draw the same rows
        for i, f in enumerate(fits):
            self.alike.setdefault((f.fold, f.inner, f.share), []).append(i)
        self.steady: dict[tuple, np.ndarray] = {}         # counts of roots that draw every row
        self.level = np.empty(0)

    def roots(self, used: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty((2, len(self.fits), len(self.columns), self.n_bins))
        for key, same in self.alike.items():
            row = np.flatnonzero(used[same[0]])
            values = target[same][:, row]
            counts = self.steady.get(key)
            known = counts is not None
            if self.pairs is not None and len(row) >= PAIR_ROWS:
                found = pair_sums(self.pairs, len(self.columns), None, row, [*values] if known else [None, *values], 1, self.n_bins)[:, 0]
                counts = counts if known else found[0]
                out[1, same] = found[0 if known else 1:]
            else:
                counts = counts if known else np.empty(out.shape[2:])
                for band, column in enumerate(self.columns):
                    at = column[row].astype(np.intp)
                    if not known:
                        counts[band] = np.bincount(at, minlength=self.n_bins)
                    for i, value in zip(same, values):
                        out[1, i, band] = np.bincount(at, value, self.n_bins)
            out[0, same] = counts
            if key[2] >= 1:
                self.steady[key] = counts
        self.level = out
        return out

    def children(self, used: np.ndarray, target: np.ndarray, node: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """``sides``: (fits, parents, 4) counts and sums left and right; ``node``: (fits, rows)."""
        nf, parents = sides.shape[:2]
        right = sides[..., 2] < sides[..., 0]                        # the smaller child
        whole = self.level.reshape(2, nf, parents, len(self.columns), self.n_bins)
        out = np.empty((2, nf, parents, 2, *whole.shape[3:]))
        number = np.arange(parents)
        for i in range(nf):
            smaller = np.zeros(2 * parents, bool)
            smaller[2 * number + right[i]] = True
            row = np.flatnonzero(used[i] & smaller[node[i]])
            slot, value, side = node[i, row] >> 1, target[i, row], right[i].astype(int)
            if self.pairs is not None and len(row) >= PAIR_ROWS * parents:
                part = pair_sums(self.pairs, len(self.columns), slot, row, [None, value], parents, self.n_bins)
            else:
                part = column_sums(self.columns, slot, row, value, parents, self.n_bins)
            out[:, i, number, side] = part
            out[:, i, number, 1 - side] = whole[:, i] - part
        self.level = out.reshape(2, nf * parents * 2, *whole.shape[3:])
        return self.level


def step_columns(columns: np.ndarray, node: np.ndarray, band: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """``step`` on bins that are kept by band."""
    flat, row = columns.ravel(), np.arange(columns.shape[1])
    out = 2 * node
    for i in range(len(node)):
        if band.shape[1] <= FEW_NODES:
            for k in np.flatnonzero(band[i] >= 0):
                right = columns[band[i, k]] > cut[i, k]
                out[i] += right if band.shape[1] == 1 else right & (node[i] == k)
        elif (band[i] >= 0).any():
            at = np.where(band[i] >= 0, cut[i], 255)[node[i]]
            out[i] += flat[np.maximum(band[i], 0)[node[i]] * len(row) + row] > at
    return out


def fit_rows(method: Method, rounds: int, rows: Rows, keep: tuple[int, ...], n_bins: int = BINS) -> dict[int, np.ndarray]:
    """All fits on rows at hand; the predictions (fits, rows) after the rounds in ``keep``."""
    train = trained(method.fits, rows)
    method.begin(train.sum(1), (train * rows.y).sum(1))
    state = method.start(rows)
    share = np.array([f.share for f in method.fits])[:, None]
    columns = np.ascontiguousarray(rows.bins.T)
    sums = Sums(method.fits, columns, n_bins)
    kept = {}
    for turn in range(rounds):
        used = train if (share >= 1).all() else train & (uniform(rows.rid, turn) < share)
        target = method.target(rows, state, turn)
        round_ = Round(method)
        node = np.zeros(used.shape, np.int64)
        for level in range(method.depth):
            found = sums.children(used, target, node, round_.sides) if level else sums.roots(used, target)
            round_.grow(best_splits(found, method.min_leaf))
            node = step_columns(columns, node, round_.band[-1], round_.cut[-1])
        round_.close(method, leaf_moments(rows, node, used, target, 1 << method.depth) if method.leaf_moments else None)
        state = method.after(rows, state, turn, node)
        if turn + 1 in keep:
            kept[turn + 1] = method.predictions(state, turn + 1)
    return kept


def choose(errors: dict[tuple[int, int], list[tuple[float, int]]], points: list[tuple[int, int]]) -> tuple[tuple[int, int], float]:
    """The (rounds, setting) of smallest mean inner RMSE, the first one among equals."""
    def mean(point):
        found = [np.sqrt(sse / n) for sse, n in errors.get(point, []) if n]
        return float(np.mean(found)) if found else float("inf")
    best = min(points, key=mean)
    return best, mean(best) if errors.get(best) else float("nan")


@dataclass(frozen=True)
class Search:
    """A model with its settings and numbers of rounds."""
    method: type
    settings: list[tuple]                                 # (setting, depth, share)
    rounds: list[int]
    inner_k: int
    n_bins: int

    @property
    def points(self) -> list[tuple[int, int]]:
        return [(r, s) for r in self.rounds for s in range(len(self.settings))]

    @property
    def inners(self) -> list[int]:
        return [-1, *range(self.inner_k)] if len(self.points) > 1 else [-1]

    def fits(self, folds: list[int]) -> list[Fit]:
        return [Fit(setting, depth, share, f, j) for f in folds for setting, depth, share in self.settings for j in self.inners]

    def fit_number(self, fold_number: int, setting: int, inner: int) -> int:
        return (fold_number * len(self.settings) + setting) * len(self.inners) + self.inners.index(inner)

    @property
    def keep(self) -> tuple[int, ...]:
        return tuple(sorted(self.rounds))


ERROR_SCHEMA = "dataset string, preprocessing string, cv int, cj int, rounds int, setting int, sse double, n long"


def _error_task(search: Search):
    """The fits of all settings without one outer and one inner fold, on the rows of one (dataset,
    preprocessing) outside that outer fold: errors on the inner fold by point."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rid", "sample_id"])
        (out_fold, j), rows = (int(pdf[c].iloc[0]) for c in ("cv", "cj")), Rows.of(pdf)
        at, found = rows.inner == j, []
        if at.any():
            method = search.method([Fit(setting, depth, share, out_fold, j) for setting, depth, share in search.settings])
            kept = fit_rows(method, search.keep[-1], rows, search.keep, search.n_bins)
            found = [(*key[:2], out_fold, j, r, s, float(((kept[r][s] - rows.y)[at] ** 2).sum()), int(at.sum())) for r, s in search.points]
        return pd.DataFrame(found, columns=["dataset", "preprocessing", "cv", "cj", "rounds", "setting", "sse", "n"])
    return run


def _fold_task(search: Search, chosen: dict[tuple, tuple[tuple[int, int], float]]):
    """The fit of one outer fold at its point of ``chosen``, on the rows of one (dataset, preprocessing)."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rid", "sample_id"]).reset_index(drop=True)
        out_fold, name = int(pdf["cv"].iloc[0]), search.method.model
        rows = Rows.of(pdf)
        train = rows.fold != out_fold
        held = pdf[~train]
        if train.sum() < 2:                               # the fold fails: its rows keep a null prediction
            return pd.DataFrame([(*key[:2], name, out_fold, i, None, None, t, None, None) for i, t in zip(held["sample_id"], held["y"])], columns=NAMES, dtype=object)
        (r, s), rmse = chosen.get((*key[:2], out_fold)) or choose({}, search.points)
        setting, depth, share = search.settings[s]
        method = search.method([Fit(setting, depth, share, out_fold, -1)])
        value = fit_rows(method, r, rows, (r,), search.n_bins)[r][0]
        params = method.params(r, setting)
        out = [(*key[:2], name, out_fold, i, params, rmse, t, v, None) for i, t, v in zip(held["sample_id"], held["y"], value[~train])]
        out.append((*key[:2], name, out_fold, None, params, rmse, None, None, method.importance(0, r, rows.bins.shape[1])))
        return pd.DataFrame(out, columns=NAMES, dtype=object)      # ids stay exact beside the missing one
    return run


def _chosen(rows: DataFrame, search: Search, folds: list[int], keys: int) -> dict[tuple, tuple[tuple[int, int], float]]:
    """(dataset, preprocessing, outer fold) -> its point and mean inner RMSE; the errors, a few
    numbers a task, come to the driver."""
    inners = search.inners[1:]
    if not inners:
        return {}
    by = ["dataset", "preprocessing", "cv", "cj"]
    each = [F.explode(F.array(*map(F.lit, values))).alias(name) for name, values in (("cv", folds), ("cj", inners))]
    work = rows.select("*", each[0]).where("fold <> cv").select("*", each[1])
    errors: dict[tuple, dict[tuple[int, int], list]] = {}
    got = work.repartition(max(1, TASKS_A_KEY * keys * len(folds)), *by).groupBy(*by).applyInPandas(_error_task(search), ERROR_SCHEMA).collect()
    for r in sorted(got, key=lambda r: r["cj"]):             # sorted here: Spark would run the tasks twice for it
        mine = errors.setdefault((r["dataset"], r["preprocessing"], r["cv"]), {})
        mine.setdefault((r["rounds"], r["setting"]), []).append((r["sse"], r["n"]))
    return {key: choose(found, search.points) for key, found in errors.items()}


# -- more rows than a task should hold ----------------------------------------------

def fit_on_spark(table: DataFrame, method: Method, rounds: int, keep: tuple[int, ...], n_bins: int) -> DataFrame:
    """The same as ``fit_rows`` by one aggregation a level.  ``table``: binned rows of one
    (dataset, preprocessing); they come back with ``kept``, the predictions of all fits after
    each of the rounds in ``keep`` as packed doubles."""
    spark, nf, width = table.sparkSession, len(method.fits), method.width
    fits, names = method.fits, table.columns
    folder = scratch_path(spark, "additive")
    state_schema = table.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ") + ", state binary, kept binary"

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, nf))
        for b in batches:
            rows = Rows.of(b)
            if len(rows.y):
                t = trained(fits, rows)
                acc += np.stack([t.sum(1), (t * rows.y).sum(1)])
        yield pa.RecordBatch.from_pydict({"fit": pa.array(range(nf), pa.int32()), "n": pa.array(acc[0]), "s": pa.array(acc[1])})

    n, s = np.zeros(nf), np.zeros(nf)
    for r in table.mapInArrow(totals, "fit int, n double, s double").groupBy("fit").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        n[r["fit"]], s[r["fit"]] = r["n"], r["s"]
    method.begin(n, s)

    def state_of(b: pa.RecordBatch) -> np.ndarray:
        flat = np.frombuffer(b"".join(b.column("state").to_pylist()), float)
        return np.ascontiguousarray(flat.reshape(b.num_rows, width, nf).transpose(1, 2, 0))

    def advance(current: DataFrame, start: int, end: int) -> DataFrame:
        """Rows with their state after ``end`` rounds, from that after ``start``."""
        first = end == 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                rows = Rows.of(b)
                state = method.start(rows) if first else state_of(b)
                aside = [b""] * b.num_rows if first else b.column("kept").to_pylist()
                for turn in range(start, end):
                    state = method.advance(rows, state, turn, turn + 1)
                    if turn + 1 in keep:
                        aside = [a + p.tobytes() for a, p in zip(aside, np.ascontiguousarray(method.predictions(state, turn + 1).T))]
                packed = [p.tobytes() for p in np.ascontiguousarray(state.transpose(2, 0, 1))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(packed, pa.binary()), pa.array(aside, pa.binary())],
                                                 names=[*names, "state", "kept"])
        out = current.mapInArrow(run, state_schema)
        out.write.mode("overwrite").parquet(f"{folder}/{end}")
        if end:
            delete_path(spark, f"{folder}/{start}")
        return spark.read.schema(out.schema).parquet(f"{folder}/{end}")

    def add_up(current: DataFrame, since: int, turn: int, reduce, finish, out_schema: str) -> list:
        """``reduce`` gives an array (fits, ...) for the rows of a batch; arrays of one fit
        are added up in one task and go through ``finish`` to a row."""
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = None
            for b in batches:
                if b.num_rows:
                    rows = Rows.of(b)
                    state = method.advance(rows, state_of(b), since, turn)
                    got = reduce(rows, drawn(fits, rows, turn), method.target(rows, state, turn))
                    acc = got if acc is None else acc + got
            if acc is not None:
                yield pa.RecordBatch.from_pydict({"fit": pa.array(range(nf), pa.int32()), "sums": pa.array([a.tobytes() for a in acc], pa.binary())})

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[int, np.ndarray] = {}
            for b in batches:
                for fit, x in zip(b.column("fit").to_pylist(), b.column("sums")):
                    x = np.frombuffer(x.as_buffer(), float)
                    acc[fit] = acc[fit] + x if fit in acc else x
            for fit, x in acc.items():
                yield pa.RecordBatch.from_pydict({"fit": pa.array([fit], pa.int32())} | {k: pa.array([v]) for k, v in finish(x).items()})

        used = [c for c in (*names, "state") if c not in ("dataset", "preprocessing", "sample_id")]
        return current.select(*used).mapInArrow(partial, "fit int, sums binary").repartition("fit").mapInArrow(total, out_schema).collect()

    def level(current: DataFrame, since: int, turn: int, round_: Round) -> dict[str, np.ndarray]:
        nodes, min_leaf = 1 << len(round_.band), method.min_leaf

        def reduce(rows: Rows, used: np.ndarray, target: np.ndarray) -> np.ndarray:
            sums = round_.sums(rows, round_.place(rows.bins), used, target, n_bins)
            return np.ascontiguousarray(sums.reshape(2, nf, -1).swapaxes(0, 1))

        def finish(x: np.ndarray) -> dict[str, list]:
            return {k: v.ravel().tolist() for k, v in best_splits(x.reshape(2, nodes, -1, n_bins), min_leaf).items()}

        out = {"band": np.full((nf, nodes), -1), "bin": np.zeros((nf, nodes), int), "gain": np.zeros((nf, nodes)), "sides": np.zeros((nf, nodes, 4))}
        for r in add_up(current, since, turn, reduce, finish, "fit int, band array<long>, bin array<long>, gain array<double>, sides array<double>"):
            for name, value in out.items():
                value[r["fit"]] = np.reshape(r[name], value.shape[1:])
        return {k: v.reshape(nf * nodes, *v.shape[2:]) for k, v in out.items()}

    def moments(current: DataFrame, since: int, turn: int, round_: Round) -> np.ndarray:
        leaves = 1 << method.depth
        reduce = lambda rows, used, target: leaf_moments(rows, round_.place(rows.bins), used, target, leaves)
        found = {r["fit"]: np.frombuffer(r["m"], float) for r in add_up(current, since, turn, reduce, lambda x: {"m": x.tobytes()}, "fit int, m binary")}
        size = len(next(iter(found.values())))
        return np.stack([found.get(i, np.zeros(size)) for i in range(nf)]).reshape(nf, leaves, -1)

    current, since = advance(table, 0, 0), 0
    for turn in range(rounds):
        round_ = Round(method)
        for _ in range(method.depth):
            round_.grow(level(current, since, turn, round_))
        round_.close(method, moments(current, since, turn, round_) if method.leaf_moments else None)
        if turn + 1 - since == REFRESH or turn + 1 == rounds:
            current, since = advance(current, since, turn + 1), turn + 1
    return current


def _cv_on_spark(rows: DataFrame, key: tuple[str, str], search: Search, k: int, refit: bool) -> DataFrame:
    spark, name = rows.sparkSession, search.method.model
    folds, keep = [*range(k), *([-1] if refit else [])], search.keep
    method = search.method(search.fits(folds))
    fits = method.fits
    nf = len(fits)
    table = fit_on_spark(rows, method, keep[-1], keep, search.n_bins)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple[int, int], list[float]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            y, fold, inner = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold", "inner"))
            kept = np.frombuffer(b"".join(b.column("kept").to_pylist()), float).reshape(b.num_rows, len(keep), nf)
            for i, f in enumerate(fits):
                at = (fold != f.fold) & (inner == f.inner)
                for m in range(len(keep) if f.inner >= 0 else 0):
                    e = acc.setdefault((m, i), [0.0, 0.0])
                    e[0] += float(((kept[:, m, i] - y)[at] ** 2).sum())
                    e[1] += int(at.sum())
        if acc:
            yield pa.RecordBatch.from_pydict({"m": pa.array([a for a, _ in acc], pa.int32()), "fit": pa.array([b for _, b in acc], pa.int32()),
                                              "sse": pa.array([v[0] for v in acc.values()]), "n": pa.array([v[1] for v in acc.values()], pa.float64())})

    by_fit = {(r["m"], r["fit"]): (r["sse"], r["n"]) for r in table.mapInArrow(errors, "m int, fit int, sse double, n double")
              .groupBy("m", "fit").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()}
    chosen, importances = {}, []
    p = len(rows.select("bins").first()["bins"])
    for i, f in enumerate(folds):
        found = {(r, s): [by_fit[at] for j in search.inners[1:] if (at := (keep.index(r), search.fit_number(i, s, j))) in by_fit] for r, s in search.points}
        (r, s), rmse = choose({q: v for q, v in found.items() if v}, search.points)
        fit, params = search.fit_number(i, s, -1), method.params(r, search.settings[s][0])
        chosen[f] = (keep.index(r), fit, params, rmse)
        importances.append((*key, name, f, None, params, rmse, None, None, method.importance(fit, r, p)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            kept = np.frombuffer(b"".join(b.column("kept").to_pylist()), float).reshape(b.num_rows, len(keep), nf)
            picks = [chosen[f] for f in b.column("fold").to_pylist()]
            value = [float(kept[i, m, fit]) for i, (m, fit, _, _) in enumerate(picks)]
            yield pa.RecordBatch.from_arrays(
                [b.column("dataset"), b.column("preprocessing"), pa.array([name] * b.num_rows), b.column("fold"), b.column("sample_id"),
                 pa.array([x[2] for x in picks], pa.string()), pa.array([x[3] for x in picks], pa.float64()), b.column("y"), pa.array(value, pa.float64())],
                names=NAMES[:-1])

    schema = OUT_SCHEMA.format(id=rows.schema["sample_id"].dataType.simpleString())
    out = table.mapInArrow(predict, schema.rsplit(",", 1)[0]).withColumn("importance", F.lit(None).cast("array<double>"))
    return out.unionByName(spark.createDataFrame(importances, schema))


def cross_validate(prepared: DataFrame, search: Search, k: int = 5, refit: bool = False, local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, importances).  ``prepared``: (dataset, preprocessing,
    sample_id, fold, inner, spectrum, target).  With more than one grid point each outer fold
    takes the one of smallest inner RMSE (``params``, ``inner_rmse``).  With ``refit``,
    importances have a row of fold -1, trained on all rows.  A fold with fewer than two
    training rows keeps its rows with null predictions."""
    spark = prepared.sparkSession
    path = scratch_path(spark, "binned")
    binned_rows(prepared, band_cuts(prepared, search.n_bins), keep_values=search.method.leaf_moments).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    sizes = {(r["dataset"], r["preprocessing"]): r["n"] for r in rows.groupBy("dataset", "preprocessing").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = sorted(key for key, n in sizes.items() if n > local_rows)
    is_large = F.lit(False)
    for dataset, prep in large:
        is_large = is_large | ((F.col("dataset") == dataset) & (F.col("preprocessing") == prep))
    folds = F.explode(F.array(*[F.lit(f) for f in [*range(k), *([-1] if refit else [])]])).alias("cv")
    tasks = max(1, TASKS_A_KEY * (len(sizes) - len(large)) * (k + refit))          # a stated number: few bytes, but much work in each
    keys = ["dataset", "preprocessing", "cv"]
    schema = OUT_SCHEMA.format(id=rows.schema["sample_id"].dataType.simpleString())
    small = rows.where(~is_large)
    chosen = _chosen(small, search, [*range(k), *([-1] if refit else [])], len(sizes) - len(large))
    out = small.select("*", folds).repartition(tasks, *keys).groupBy(*keys).applyInPandas(_fold_task(search, chosen), schema)
    for key in large:
        part = rows.where((F.col("dataset") == key[0]) & (F.col("preprocessing") == key[1]))
        out = out.unionByName(_cv_on_spark(part, key, search, k, refit))
    done = scratch_path(spark, "additive-out")
    out.write.mode("overwrite").parquet(done)
    out = spark.read.parquet(done)
    return out.where("importance is null").drop("importance"), out.where("importance is not null").select(
        "dataset", "preprocessing", "model", "fold", "params", "importance")


# -- models to keep --------------------------------------------------------------------

@dataclass
class Fitted:
    """One model fitted on all rows of a (dataset, preprocessing)."""
    method: Method
    cuts: np.ndarray
    rounds: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        nothing = np.zeros(len(x), np.int64)
        rows = Rows(to_bins(x, self.cuts), x, np.zeros(len(x)), nothing, nothing, nothing)
        return self.method.predictions(self.method.advance(rows, self.method.start(rows), 0, self.rounds), self.rounds)[0]


class FittedTrees(Fitted):
    """A model whose trees hold a number in each leaf."""

    def predict_permuted(self, x: np.ndarray, partner: np.ndarray) -> np.ndarray:
        """(bands, rows): predictions with one band at a time taken from the rows ``partner``.
        Only trees that split on a band answer anew."""
        own = np.ascontiguousarray(to_bins(x, self.cuts).T)
        other, row = own[:, partner], np.arange(len(x))
        out = np.repeat(self.predict(x)[None], len(own), 0)
        for turn in range(self.rounds):
            band, cut, value = self.method.bands[turn][0], self.method.cuts[turn][0], self.method.values[turn][0]
            split = band >= 0
            stay, move = ((side[np.maximum(band, 0)] > cut[:, None]) & split[:, None] for side in (own, other))

            def answer(right: np.ndarray) -> np.ndarray:
                node = np.zeros(len(row), np.int64)
                for level in range(self.method.depth):
                    node = 2 * node + right[(1 << level) - 1 + node, row]
                return value[node]  # noqa: B023
            before = answer(stay)
            for b in np.unique(band[split]):
                out[b] += answer(np.where((band == b)[:, None], move, stay)) - before
        return out


def fit_models(prepared: DataFrame, search: Search, local_rows: int = LOCAL_ROWS) -> dict[tuple[str, str], Fitted]:
    """(dataset, preprocessing) -> the model of the search's one grid point, fitted on all rows."""
    if len(search.points) != 1:
        raise ValueError("a model to keep has one grid point")
    spark, rounds = prepared.sparkSession, search.keep[-1]
    cuts = band_cuts(prepared, search.n_bins)
    path = scratch_path(spark, "binned")
    binned_rows(prepared, cuts, keep_values=search.method.leaf_moments).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    keys = ["dataset", "preprocessing"]
    kind = Fitted if search.method.leaf_moments else FittedTrees

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        method = search.method(search.fits([-1]))
        pdf = pdf.sort_values(["rid", "sample_id"])
        fit_rows(method, rounds, Rows.of(pdf), (), search.n_bins)
        return pd.DataFrame([(*key, pickle.dumps(method))], columns=[*keys, "method"])

    sizes = {tuple(r[:2]): r["n"] for r in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}
    small = [key for key, n in sizes.items() if n <= local_rows]
    out = {}
    if small:
        mine = rows.join(spark.createDataFrame(small, "dataset string, preprocessing string"), keys)
        for r in mine.repartition(TASKS_A_KEY * len(small), *keys).groupBy(*keys).applyInPandas(fit, "dataset string, preprocessing string, method binary").collect():
            out[r["dataset"], r["preprocessing"]] = kind(pickle.loads(r["method"]), cuts[r["dataset"], r["preprocessing"]], rounds)
    for key in sorted(set(sizes) - set(small)):
        method = search.method(search.fits([-1]))
        fit_on_spark(rows.where((F.col("dataset") == key[0]) & (F.col("preprocessing") == key[1])), method, rounds, (), search.n_bins)
        out[key] = kind(method, cuts[key], rounds)
    return out
