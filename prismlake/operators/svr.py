"""Support-vector regression (epsilon-insensitive absolute loss) on landmark features.

For every training set (outer fold, inner fold) and every point of C x epsilon x gamma

    min over w, b   1/2 |w|^2 + C * sum_i max(0, |y_i - b - w'phi_i| - epsilon)

is solved on the features of ``operators.kernel`` (exact kernel SVR when every row is a
landmark).  ``kkt`` says how far the multipliers a_i (between -C and C, w = sum a_i phi_i,
sum a_i = 0) are from the optimality conditions: the largest of |w - sum a_i phi_i| / (1 + C)
by component, |sum a_i| / (1 + C), and the violation of complementarity by any row.

* Up to ``LOCAL_ROWS`` rows of a (dataset, preprocessing) are solved in tasks by an interior-point
  method (``interior``): some twenty steps whatever the number of rows, each a few passes over the
  features and one small system.  One task for each outer and inner fold, whose errors choose the
  point, then one for each outer fold with the chosen point only.
* More rows go through Spark passes, two a step (sums and direction; objective at the step
  lengths), for all fits together (``Solver``).  The kink of the loss is rounded over a width mu that
  goes down in steps to ``WIDTHS[-1]``; for each width Newton steps with a halving line search run
  until the gradient is at rest.  The multipliers of the rounded loss then fulfil the conditions up
  to mu.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.operators.kernel import DEFAULT_LANDMARKS, GROUP, Kernel, Landmarks, draw_landmarks, sum_packed, usable
from prismlake.sources.files import scratch_path

# The grid of the runtime search, and the defaults.
GRID = {"C": [1.0, 10.0, 100.0], "epsilon": [0.05, 0.1, 0.2], "gamma": ["scale", "auto"]}
FIXED = {"C": [1.0], "epsilon": [0.1], "gamma": ["scale"]}

LOCAL_ROWS = 200_000       # about 0.8 GB of features a million rows and kernel
BLOCK = 1024               # rows whose products are added up at once
TASKS_A_KEY = 16           # partitions for each key of long tasks, so that few keys share one
WIDTHS = (10.0, 3.0, 1.0, 0.3, 0.1, 0.03, 1e-2, 3e-3, 1e-3, 1e-4, 1e-5, 1e-6)
MAX_STEPS = 50             # Newton steps for each width
TOLERANCE = (1e-5, 3e-7)   # of the gradient, as a share of 1 + C: on the way, and at the last width
LENGTHS = 0.5 ** np.arange(20)
INTERIOR_STEPS = 100
INTERIOR_TOLERANCE = 1e-6    # of the optimality conditions
WARM = 0.1                 # products of a start from a similar problem, as a share of C
ERROR_SCHEMA = "dataset string, preprocessing string, cv int, cj int, point int, sse double, n long"
OUT_SCHEMA = ("dataset string, preprocessing string, model string, fold int, sample_id {id}, params string, inner_rmse double, kkt double, "
              "y_true double, y_pred double")
NAMES = ["dataset", "preprocessing", "model", "fold", "sample_id", "params", "inner_rmse", "kkt", "y_true", "y_pred"]


@dataclass(frozen=True)
class Fit:
    kernel: int
    C: float
    eps: float
    fold: int
    inner: int

    def used(self, fold: np.ndarray, inner: np.ndarray) -> np.ndarray:
        return (fold != self.fold) & (inner != self.inner)


def points(grid: dict[str, list]) -> list[tuple[float, float, int]]:
    return list(itertools.product(grid["C"], grid["epsilon"], range(len(grid["gamma"]))))


def _loss(r: np.ndarray, C: float, eps: float, mu: float) -> np.ndarray:
    t = np.maximum(np.abs(r) - eps, 0.0)
    bent = np.minimum(t, mu)                                 # t * t / (2 * mu) up to mu, t - mu / 2 beyond
    return C * (bent * (t - bent / 2) / mu)


def newton_sums(u: np.ndarray, y: np.ndarray, fit: Fit, v: np.ndarray, mu: float, bend: float) -> np.ndarray:
    """Loss, its gradient and second derivatives by v = [b, w], for rows u = [1, phi]; packed.
    Rows up to ``bend`` beyond epsilon count as bent.  With the width before (``bend`` > mu) the
    Newton step keeps their multipliers while the width shrinks."""
    r = y - u @ v
    t = np.abs(r) - fit.eps
    at = (t > 0) & (t < bend)
    a = fit.C * np.where(at, t / mu, t > 0) * np.sign(r)
    bent = u[at]
    return np.concatenate([[_loss(r, fit.C, fit.eps, mu).sum()], -u.T @ a, (fit.C / mu * (bent.T @ bent)).ravel()])


def direction(sums: np.ndarray, v: np.ndarray, mu: float) -> tuple[np.ndarray, float, float, float]:
    """Newton direction, slope along it, objective and largest gradient component.  Without a
    row in the bend, b has no curvature; what is added to it keeps its step within ten widths
    and goes with the gradient, so it does not slow the last steps."""
    q = len(v)
    w = np.append(0.0, v[1:])
    gradient = sums[1:1 + q] + w
    ridge = np.ones(q)
    ridge[0] = 1e-9 + abs(gradient[0]) / (10 * mu)
    d = -np.linalg.solve(sums[1 + q:].reshape(q, q) + np.diag(ridge), gradient)
    return d, float(gradient @ d), float(sums[0] + w @ w / 2), float(np.abs(gradient).max())


def step_losses(u: np.ndarray, y: np.ndarray, fit: Fit, v: np.ndarray, d: np.ndarray, mu: float) -> np.ndarray:
    r, along = y - u @ v, u @ d
    return _loss(r[:, None] - along[:, None] * LENGTHS[None, :], fit.C, fit.eps, mu).sum(0)


def pick_length(losses: np.ndarray, v: np.ndarray, d: np.ndarray, objective: float, slope: float) -> float:
    w = v[1:, None] + d[1:, None] * LENGTHS[None, :]
    fine = losses + (w * w).sum(0) / 2 <= objective + 1e-4 * LENGTHS * slope
    return float(LENGTHS[fine.argmax()]) if fine.any() else 0.0


def violations(u: np.ndarray, y: np.ndarray, fit: Fit, v: np.ndarray, mu: float) -> np.ndarray:
    """[largest violation of complementarity, sum of u_i a_i] of rows."""
    r = y - u @ v
    t = np.abs(r) - fit.eps
    a = fit.C * np.clip(t / mu, 0, 1) * np.sign(r)
    off = np.where(t <= 0, 0.0, np.where(t < mu, t, 0.0))
    return np.concatenate([[off.max(initial=0.0)], u.T @ a])


def kkt(found: np.ndarray, v: np.ndarray, C: float) -> float:
    off = found[1:].copy()
    off[1:] -= v[1:]
    return float(max(found[0], np.abs(off).max() / (1 + C)))


class Solver:
    """All fits at once.  ``sums(work, kind)`` adds up over rows, for each (fit, v, d, mu, ...) of
    ``work`` (d: the bend for "newton"; "length" adds the objective and the slope), what ``newton_sums`` + ``direction`` ("newton"), ``step_losses`` ("length") or
    ``violations`` ("kkt") say."""

    def __init__(self, fits: list[Fit], q: int, sums: Callable, means: np.ndarray):
        self.fits, self.sums = fits, sums
        self.v = np.zeros((len(fits), q))
        self.v[:, 0] = means                              # of the targets

    def run(self) -> np.ndarray:
        """The largest violation of the optimality conditions of each fit."""
        for last, mu in zip((None, *WIDTHS), WIDTHS):
            if last:
                for i, (d, *_) in enumerate(self.sums([(i, v, last, mu) for i, v in enumerate(self.v)], "newton")):
                    self.v[i] = self.v[i] + d
            tolerance = TOLERANCE[mu == WIDTHS[-1]]
            open_ = list(range(len(self.fits)))
            before: dict[int, tuple[float, np.ndarray]] = {}      # fits that took a whole step without a lower objective
            for _ in range(MAX_STEPS):
                left = []
                for i, f in zip(open_, self.sums([(i, self.v[i], mu, mu) for i in open_], "newton")):
                    if i in before and f[3] >= before[i][0]:          # nor a smaller gradient: rounding is all that is left
                        self.v[i] = before[i][1]
                    elif f[3] > tolerance * (1 + self.fits[i].C):
                        left.append((i, *f))
                if not left:
                    break
                losses = self.sums([(i, self.v[i], d, mu, objective, slope) for i, d, slope, objective, _ in left], "length")
                open_, before = [i for i, *_ in left], {}
                for (i, d, slope, objective, norm), loss in zip(left, losses):
                    length = pick_length(loss, self.v[i], d, objective, slope)
                    if not length:
                        before[i] = (norm, self.v[i].copy())
                    self.v[i] = self.v[i] + (length or 1.0) * d
            for i, (_, v) in before.items():
                self.v[i] = v
        found = self.sums([(i, v, None, WIDTHS[-1]) for i, v in enumerate(self.v)], "kkt")
        return np.array([kkt(x, v, f.C) for x, v, f in zip(found, self.v, self.fits)])


# -- interior points ------------------------------------------------------------------

SIGN = np.array([[1.0], [-1.0]])                              # of the multipliers of both sides of the tube


def _weighted(u: np.ndarray, h: np.ndarray) -> np.ndarray:
    out, root, room = np.zeros((u.shape[1], u.shape[1])), np.sqrt(h)[:, None], np.empty((BLOCK, u.shape[1]))
    for a in range(0, len(u), BLOCK):
        part = np.multiply(u[a:a + BLOCK], root[a:a + BLOCK], out=room[:len(u) - a])
        out += part.T @ part
    return out


def _reach(*pairs: tuple[np.ndarray, np.ndarray]) -> float:
    """The longest step at which no value falls below 0."""
    return min(float(np.min(-x[d < 0] / d[d < 0], initial=np.inf)) for x, d in pairs)


def _central(slope: np.ndarray, C: float, mu: float) -> tuple[np.ndarray, ...]:
    """Multipliers of rows, their distances to C, and the multipliers of both bounds, with all products ``mu``."""
    steep = np.abs(slope)
    near = 2 * mu * C / (steep * C + 2 * mu + np.hypot(steep * C, 2 * mu))         # distance to the nearer bound
    a, left = np.where(slope > 0, (near, C - near), (C - near, near))
    return a, left, mu / a, mu / left


def _balanced(u: np.ndarray, a: np.ndarray, C: float, v: np.ndarray) -> np.ndarray:
    """``a`` with the least change of the multipliers between their bounds, whose rounding is the
    largest, that makes up what is missing in w = sum a_i phi_i and sum a_i = 0."""
    least = np.minimum(a, C - a)
    side, row = np.nonzero(least > 1e-3 * C)
    if not len(row):
        return a
    sums = -(u.T @ (a[0] - a[1]))
    sums[1:] += v[1:]
    out = a.copy()
    out[side, row] += SIGN[side, 0] * np.linalg.lstsq(u[row].T, sums, rcond=1e-10)[0]
    return np.clip(out, 0, C)


def _violation(u: np.ndarray, a: np.ndarray, slope: np.ndarray, C: float, v: np.ndarray) -> float:
    sums = u.T @ (a[0] - a[1])
    sums[1:] -= v[1:]
    return float(max(np.abs(a - np.clip(a - slope, 0, C)).max(), np.abs(sums).max() / (1 + C)))


def interior(u: np.ndarray, y: np.ndarray, C: float, eps: float, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """v = [b, w] for rows u = [1, phi], and the violation of the optimality conditions.  The dual
    problem has two multipliers a row, both between 0 and C, for rows above and below the tube;
    ``low`` and ``high`` are the multipliers of these bounds, and predictor-corrector steps take all
    products (multiplier times distance to its bound) to 0.  ``start``: the solution of a similar problem."""
    n, q = u.shape
    if not n:
        return np.zeros(q), 0.0
    penalised = np.append(0.0, np.ones(q - 1))
    middle = np.append(np.median(y), np.zeros(q - 1))     # taken off, so that sums round less
    y, v = y - middle[0], np.zeros(q) if start is None else start - middle
    f = u @ v
    slope = eps - SIGN * (y - f)                          # of the dual objective by a
    if start is None:
        a, left, room = np.full((2, n), C / 2), np.full((2, n), C / 2), np.abs(slope).mean() + 1e-3
        low, high = np.maximum(slope, 0) + room, np.maximum(-slope, 0) + room
    else:
        a, left, low, high = _central(slope, C, WARM * C)
    best = (np.inf, v)
    for _ in range(INTERIOR_STEPS):
        slope = eps - SIGN * (y - f)
        if np.abs(a - np.clip(a - slope, 0, C)).max() <= INTERIOR_TOLERANCE:
            f = u @ v                                     # without what rounding has added up
            slope = eps - SIGN * (y - f)
            off = _violation(u, _balanced(u, a, C, v), slope, C, v)
            best = min(best, (off, v), key=lambda b: b[0])
            if best[0] <= INTERIOR_TOLERANCE:
                break
        gap = float((a * low + left * high).sum()) / (4 * n)
        if not (gap > 0 and a.min() > 0 and left.min() > 0):      # rounding is all that is left
            break
        missing, to_low, to_high = low - high - slope, low / a, high / left
        bend = to_low + to_high
        system = _weighted(u, (1 / bend).sum(0)) + np.diag(penalised)

        def step(for_low: np.ndarray, for_high: np.ndarray) -> tuple[np.ndarray, ...]:
            want = for_low - for_high + missing               # noqa: B023
            dv = np.linalg.solve(system, u.T @ (a[0] - a[1] + (SIGN * want / bend).sum(0)) - penalised * v)  # noqa: B023
            df = u @ dv
            da = (want - SIGN * df) / bend                    # noqa: B023
            return dv, df, da, for_low - to_low * da, for_high + to_high * da  # noqa: B023

        _, _, da, dl, dh = step(-low, -high)
        t = min(1.0, _reach((a, da), (left, -da), (low, dl), (high, dh)))
        after = float(((a + t * da) * (low + t * dl) + (left - t * da) * (high + t * dh)).sum()) / (4 * n)
        mu = gap * (after / gap) ** 3
        dv, df, da, dl, dh = step((mu - da * dl) / a - low, (mu + da * dh) / left - high)
        t = min(1.0, 0.995 * _reach((a, da), (left, -da), (low, dl), (high, dh)))
        v, f, a, left, low, high = v + t * dv, f + t * df, a + t * da, left - t * da, low + t * dl, high + t * dh
    if best[0] == np.inf:
        best = (_violation(u, a, eps - SIGN * (y - u @ v), C, v), v)
    return best[1] + middle, best[0]


def _in_memory(fits: list[Fit], features: list[np.ndarray], y: np.ndarray, fold: np.ndarray, inner: np.ndarray) -> Callable:
    """What ``Solver`` asks for, from rows at hand: the plain counterpart of ``_on_spark``.  Rows are put in order
    of (held out or not, inner), so that the rows of a fit are a few slices of one matrix a kernel, which all fits share."""
    order = np.lexsort((inner, fold == fits[0].fold))
    u, y, fold, inner = [np.column_stack([np.ones(len(y)), f])[order] for f in features], y[order], fold[order], inner[order]
    data = []
    for f in fits:
        at = f.used(fold, inner)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], at.astype(int), [0]]))).reshape(-1, 2)
        data.append([(u[f.kernel][a:b], y[a:b]) for a, b in edges] or [(u[f.kernel][:0], y[:0])])

    def lengths(i: int, v: np.ndarray, d: np.ndarray, mu: float, objective: float, slope: float) -> np.ndarray:
        """Losses up to the length that ``pick_length`` takes."""
        lines, out = [(y - u @ v, u @ d) for u, y in data[i]], np.full(len(LENGTHS), np.inf)
        for k, length in enumerate(LENGTHS):
            out[k] = sum(_loss(r - along * length, fits[i].C, fits[i].eps, mu).sum() for r, along in lines)
            if pick_length(out, v, d, objective, slope):
                break
        return out

    def sums(work: list, kind: str) -> list:
        if kind == "newton":
            return [direction(sum(newton_sums(*part, fits[i], v, mu, bend) for part in data[i]), v, mu) for i, v, bend, mu in work]
        if kind == "length":
            return [lengths(i, *rest) for i, *rest in work]
        found = [[violations(*part, fits[i], v, mu) for part in data[i]] for i, v, _, mu in work]
        return [np.append(max(g[0] for g in parts), sum(g[1:] for g in parts)) for parts in found]
    return sums


def _choose(fits: list[Fit], grid: dict[str, list], inner_k: int, out_fold: int, errors: dict[int, tuple[float, int]]) -> tuple[int, float | None]:
    """The fit on the whole training set of ``out_fold`` with the smallest mean inner RMSE.  Scores
    that agree to six digits, as far as fits are solved, are ties, which the first point wins."""
    at = {(f.C, f.eps, f.kernel, f.fold, f.inner): i for i, f in enumerate(fits)}
    scored = []
    for C, eps, kernel in points(grid):
        scores = [np.sqrt(s / n) for j in range(inner_k) for s, n in [errors.get(at.get((C, eps, kernel, out_fold, j)), (0.0, 0))] if n]
        score = float(np.mean(scores)) if scores else np.inf
        scored.append((score, at[C, eps, kernel, out_fold, -1]))
    least = min(score for score, _ in scored)
    best = next((score, i) for score, i in scored if score <= least * (1 + 1e-6))
    return best[1], best[0] if np.isfinite(best[0]) else None


def _params(f: Fit, grid: dict[str, list], marks: Landmarks) -> str:
    gamma = grid["gamma"][f.kernel]
    return json.dumps({"C": f.C, "epsilon": f.eps, "gamma": gamma, "kernel": "rbf", "landmarks": len(marks.rows), "rank": marks.root(Kernel("rbf", gamma))[1]})


def _fits(grid: dict[str, list], folds: list[int], inner_k: int) -> list[Fit]:
    inners = [-1, *range(inner_k)] if len(points(grid)) > 1 else [-1]
    return [Fit(g, C, eps, f, j) for f in folds for C, eps, g in points(grid) for j in inners]


def _features(marks: Landmarks, gamma: float | str, x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), marks.features(Kernel("rbf", gamma), x)])


def _error_task(grid: dict[str, list], landmarks: dict):
    """The fits of all points without one outer and one inner fold, on the rows of one (dataset,
    preprocessing) outside that outer fold: errors on the inner fold by point."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        marks, held, found = Landmarks(landmarks[key[:2]]), pdf["inner"].to_numpy() == key[3], []
        x, y = np.stack([np.asarray(v, float) for v in pdf["spectrum"]]), pdf["target"].to_numpy()
        for kernel, gamma in enumerate(grid["gamma"] if held.any() else []):
            train, test = (_features(marks, gamma, x[at]) for at in (~held, held))
            before, v = None, None
            for number, (C, eps, k) in enumerate(points(grid)):
                if k == kernel:
                    v, _ = interior(train, y[~held], C, eps, v if C == before else None)
                    before = C
                    found.append((*key, number, float(((test @ v - y[held]) ** 2).sum()), int(held.sum())))
        return pd.DataFrame(found, columns=["dataset", "preprocessing", "cv", "cj", "point", "sse", "n"])
    return run


def _fold_task(grid: dict[str, list], landmarks: dict, chosen: dict[tuple, tuple[Fit, float | None]]):
    """The fit of one outer fold at its point of ``chosen``, on the rows of one (dataset, preprocessing)."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        marks, out_fold = Landmarks(landmarks[key[:2]]), int(key[2])
        held, y = pdf["fold"].to_numpy() == out_fold, pdf["target"].to_numpy()
        ids = pdf["sample_id"][held]
        if (~held).sum() < 2:
            return pd.DataFrame([(*key[:2], "svr", out_fold, i, None, None, None, t, None) for i, t in zip(ids, y[held])], columns=NAMES, dtype=object)
        fit, rmse = chosen[key]
        u = _features(marks, grid["gamma"][fit.kernel], np.stack([np.asarray(v, float) for v in pdf["spectrum"]]))
        v, off = interior(u[~held], y[~held], fit.C, fit.eps)
        params = _params(fit, grid, marks)
        return pd.DataFrame([(*key[:2], "svr", out_fold, i, params, rmse, off, t, guess) for i, t, guess in zip(ids, y[held], u[held] @ v)],
                            columns=NAMES, dtype=object)
    return run


def _small(rows: DataFrame, keys: list[tuple[str, str]], grid: dict[str, list], k: int, inner_k: int, landmarks: dict) -> DataFrame:
    """The groups that fit into a task.  Errors by point, a few numbers a task, come to the driver."""
    fits, tasks, by = _fits(grid, list(range(k)), inner_k), max(1, TASKS_A_KEY * len(keys) * k), [*GROUP, "cv", "cj"]
    errors: dict[tuple, dict[int, tuple[float, int]]] = {key: {} for key in keys}
    if len(points(grid)) > 1:
        each = [F.explode(F.array(*map(F.lit, range(n)))).alias(name) for name, n in (("cv", k), ("cj", inner_k))]
        work = rows.select("*", each[0]).where("fold <> cv").select("*", each[1])
        at = {(f.C, f.eps, f.kernel, f.fold, f.inner): i for i, f in enumerate(fits)}
        for r in work.repartition(tasks, *by).groupBy(*by).applyInPandas(_error_task(grid, landmarks), ERROR_SCHEMA).collect():
            errors[r["dataset"], r["preprocessing"]][at[(*points(grid)[r["point"]], r["cv"], r["cj"])]] = (r["sse"], r["n"])
    chosen = {}
    for key, found in errors.items():
        for f in range(k):
            best, rmse = _choose(fits, grid, inner_k, f, found)
            chosen[(*key, f)] = fits[best], rmse
    work = rows.withColumn("cv", F.explode(F.array(*map(F.lit, range(k))))).repartition(tasks, *by[:3])
    return work.groupBy(*by[:3]).applyInPandas(_fold_task(grid, landmarks, chosen), OUT_SCHEMA.format(id=rows.schema["sample_id"].dataType.simpleString()))


# -- more rows than a task should hold ----------------------------------------------

def _on_spark(rows: DataFrame, fits: list[Fit], grid: dict[str, list], key: tuple[str, str], landmarks: dict) -> Callable:
    own = {key: landmarks[key]}
    gammas = [Kernel("rbf", g) for g in grid["gamma"]]
    light = rows.select("spectrum", "target", "fold", "inner")

    def sums(work: list, kind: str) -> list:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc: dict[int, np.ndarray] = {}
            marks = Landmarks(own[key])
            for pdf in batches:
                if pdf.empty:
                    continue
                x = np.stack([np.asarray(v, float) for v in pdf["spectrum"]])
                y, fold, inner = (pdf[c].to_numpy() for c in ("target", "fold", "inner"))
                u = [np.column_stack([np.ones(len(y)), marks.features(g, x)]) for g in gammas]
                for i, v, d, mu, *_ in work:
                    at = fits[i].used(fold, inner)
                    args = (u[fits[i].kernel][at], y[at], fits[i], v)
                    got = newton_sums(*args, mu, d) if kind == "newton" else step_losses(*args, d, mu) if kind == "length" else violations(*args, mu)
                    if i not in acc:
                        acc[i] = got
                    elif kind == "kkt":
                        acc[i] = np.append(max(acc[i][0], got[0]), acc[i][1:] + got[1:])
                    else:
                        acc[i] = acc[i] + got
            if acc:
                yield pd.DataFrame({"fit": list(acc), "g": [a.tobytes() for a in acc.values()]})

        parts = light.mapInPandas(partial, "fit int, g binary")
        start = {i: (v, mu) for i, v, _, mu, *_ in work}
        if kind == "kkt":                                  # a largest value and sums: one row a task and fit
            found: dict[int, np.ndarray] = {}
            for r in parts.collect():
                g = np.frombuffer(r["g"], float)
                found[r["fit"]] = np.append(max(found[r["fit"]][0], g[0]), found[r["fit"]][1:] + g[1:]) if r["fit"] in found else g
            return [found[i] for i, *_ in work]
        total = sum_packed(parts, ["fit"])
        if kind == "length":
            got = {r["fit"]: np.frombuffer(r["g"], float) for r in total.collect()}
            return [got[i] for i, *_ in work]

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(i, *direction(np.frombuffer(g, float), *start[i])) for i, g in zip(b.column("fit").to_pylist(), b.column("g").to_pylist())]
                columns = list(zip(*((i, d.tolist(), s, o, n) for i, d, s, o, n in out))) if out else [()] * 5
                types = [pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["fit", "d", "slope", "objective", "norm"])
        got = {r["fit"]: (np.array(r["d"]), r["slope"], r["objective"], r["norm"])
               for r in total.mapInArrow(solve, "fit int, d array<double>, slope double, objective double, norm double").collect()}
        return [got[i] for i, *_ in work]
    return sums


def _large(rows: DataFrame, key: tuple[str, str], grid: dict[str, list], k: int, inner_k: int, landmarks: dict) -> DataFrame:
    fits, marks = _fits(grid, list(range(k)), inner_k), Landmarks(landmarks[key])
    by_cell = rows.groupBy("fold", "inner").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("s")).collect()
    cells = [(np.array([r["fold"]]), np.array([r["inner"]]), r["n"], r["s"]) for r in by_cell]
    means = np.array([sum(s for a, b, _, s in cells if f.used(a, b)[0]) / max(1, sum(n for a, b, n, _ in cells if f.used(a, b)[0])) for f in fits])
    solver = Solver(fits, len(marks.rows) + 1, _on_spark(rows, fits, grid, key, landmarks), means)
    off = solver.run()
    gammas, weights, own = [Kernel("rbf", g) for g in grid["gamma"]], solver.v, {key: landmarks[key]}

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([np.asarray(v, float) for v in pdf["spectrum"]])
            y, fold, inner = (pdf[c].to_numpy() for c in ("target", "fold", "inner"))
            phi, out = [Landmarks(own[key]).features(g, x) for g in gammas], []
            for i, f in enumerate(fits):
                at = (fold != f.fold) & (inner == f.inner)
                if f.inner >= 0 and at.any():
                    e = (weights[i][0] + phi[f.kernel][at] @ weights[i][1:] - y[at])
                    out.append((i, float((e * e).sum()), int(at.sum())))
            yield pd.DataFrame(out, columns=["fit", "sse", "n"])

    by_fit = {r["fit"]: (r["sse"], r["n"]) for r in rows.mapInPandas(errors, "fit int, sse double, n long").groupBy("fit").agg(
        F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()}
    chosen = {}
    for f in range(k):
        best, rmse = _choose(fits, grid, inner_k, f, by_fit)
        chosen[f] = (_params(fits[best], grid, marks), rmse, float(off[best]), fits[best].kernel, weights[best])

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([np.asarray(v, float) for v in pdf["spectrum"]])
            phi, out = [Landmarks(own[key]).features(g, x) for g in gammas], []
            for i, (sample, f, y) in enumerate(zip(pdf["sample_id"], pdf["fold"], pdf["target"])):
                params, rmse, off_, kernel, v = chosen[f]
                out.append((*key, "svr", f, sample, params, rmse, off_, y, float(v[0] + phi[kernel][i] @ v[1:])))
            yield pd.DataFrame(out, columns=NAMES)

    return rows.mapInPandas(predict, OUT_SCHEMA.format(id=rows.schema["sample_id"].dataType.simpleString()))


def cv_svr(prepared: DataFrame, grid: dict[str, list] | None = None, k: int = 5, inner_k: int = 3, m: int = DEFAULT_LANDMARKS,
           local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Out-of-fold predictions of SVR, nested over C, epsilon and gamma, with ``kkt``, the
    largest violation of the optimality conditions by the model of the fold."""
    grid = grid or GRID
    spark = prepared.sparkSession
    path = scratch_path(spark, "svr-rows")
    usable(prepared).select(*GROUP, "sample_id", "fold", "inner", "spectrum", "target").write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    landmarks = draw_landmarks(rows, m)
    sizes = {(r["dataset"], r["preprocessing"]): r["n"] for r in rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).collect()}
    large = sorted(key for key, n in sizes.items() if n > local_rows)
    is_large = F.lit(False)
    for dataset, prep in large:
        is_large = is_large | ((F.col("dataset") == dataset) & (F.col("preprocessing") == prep))
    out = _small(rows.where(~is_large), [key for key in sizes if key not in large], grid, k, inner_k, landmarks)
    for key in large:
        out = out.unionByName(_large(rows.where((F.col("dataset") == key[0]) & (F.col("preprocessing") == key[1])), key, grid, k, inner_k, landmarks))
    path = scratch_path(spark, "svr")
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
