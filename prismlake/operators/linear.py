"""Linear estimators solved from Gram moments (PLS1, linear kernel ridge, OLS).

Everything here works on (p+1)x(p+1) moment matrices -- the output of the
distributed Gram pass -- so the cost is independent of the number of samples.
These functions run inside ``applyInPandas`` tasks (one task per dataset x
preprocessing), never on whole data.
"""

from __future__ import annotations

import json

import numpy as np

from prismlake.operators.gram import Moments

# Parameter grids of the reference runtime search.
PLS_COMPONENTS = [2, 4, 6, 8]
KRR_ALPHAS = [0.1, 1.0, 10.0]


def _split(m: Moments):
    p = len(m.mean) - 1
    return p, m.mean[:p], m.mean[p], m.cov_ss[:p, :p], m.cov_ss[:p, p], m.cov_ss[p, p]


def pls1_path(m: Moments, max_components: int, scale: bool = True) -> list[tuple[float, np.ndarray]]:
    """PLS1 (single response) for 1..max_components from centred moments.

    Kernel algorithm on X'X and X'y (equivalent to NIPALS for one response).  With
    ``scale`` the columns are standardised with ddof 1 first, as the usual PLS
    regression does; zero-variance columns keep scale 1.  Returns a list of
    (intercept, coef) on the original scale, one per component count.
    """
    p, xm, ym, Sxx, sxy, syy = _split(m)
    dof = max(m.n - 1.0, 1.0)
    if scale:
        sx = np.sqrt(np.maximum(np.diag(Sxx), 0.0) / dof)
        sx[sx == 0] = 1.0
        sy = np.sqrt(max(syy, 0.0) / dof) or 1.0
    else:
        sx, sy = np.ones(p), 1.0
    XtX = Sxx / np.outer(sx, sx)
    Xty = sxy / sx / sy
    R, P, Q = [], [], []
    out = []
    B = np.zeros(p)
    for _ in range(min(max_components, p)):
        nrm = np.linalg.norm(Xty)
        if nrm <= 1e-300:
            break
        w = Xty / nrm
        r = w.copy()
        for rj, pj in zip(R, P):
            r -= (pj @ w) * rj
        tt = r @ XtX @ r
        if tt <= 1e-300:
            break
        pa = XtX @ r / tt
        qa = (r @ Xty) / tt
        Xty = Xty - pa * qa * tt
        R.append(r); P.append(pa); Q.append(qa)
        B = B + r * qa
        coef = B / sx * sy
        out.append((float(ym - xm @ coef), coef.copy()))
    while len(out) < max_components:          # more components than the rank allows
        out.append(out[-1] if out else (float(ym), np.zeros(p)))
    return out


def ridge_no_intercept(m: Moments, alpha: float) -> tuple[float, np.ndarray]:
    """Linear kernel ridge: no intercept, beta = (X'X + alpha I)^-1 X'y on raw sums."""
    raw = m.raw()
    p = raw.shape[0] - 1
    A = raw[:p, :p] + alpha * np.eye(p)
    try:
        beta = np.linalg.solve(A, raw[:p, p])
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(A, raw[:p, p], rcond=None)[0]
    return 0.0, beta


def ols(m: Moments) -> tuple[float, np.ndarray]:
    p, xm, ym, Sxx, sxy, _ = _split(m)
    beta = np.linalg.lstsq(Sxx, sxy, rcond=None)[0]
    return float(ym - xm @ beta), beta


def sse(m: Moments, intercept: float, coef: np.ndarray) -> float:
    """Sum of squared residuals of y - intercept - x'coef over the rows of ``m``."""
    p = len(coef)
    c = np.concatenate([[-intercept], -coef, [1.0]])
    U = np.empty((p + 2, p + 2))
    raw = m.raw()
    s = m.mean * m.n
    U[0, 0] = m.n
    U[0, 1:] = s
    U[1:, 0] = s
    U[1:, 1:] = raw
    return float(max(c @ U @ c, 0.0))


def fit_grid(model: str, m: Moments, max_pls: int = max(PLS_COMPONENTS)) -> dict[str, tuple[float, np.ndarray]]:
    """All grid points of ``model`` fitted from one moment matrix: params -> (b0, coef)."""
    if model == "pls":
        path = pls1_path(m, max_pls)
        return {f'{{"n_components": {a}}}': path[a - 1] for a in PLS_COMPONENTS if a <= len(path)}
    if model == "krr":
        return {f'{{"alpha": {a}, "kernel": "linear"}}': ridge_no_intercept(m, a) for a in KRR_ALPHAS}
    if model == "ols":
        return {"{}": ols(m)}
    raise ValueError(model)


def fit_params(model: str, m: Moments, params: str | None = None) -> tuple[str, tuple[float, np.ndarray]]:
    """One fit with the given JSON parameters, on the grid or not; without parameters the
    first grid point."""
    if params is None:
        fits = fit_grid(model, m)
        chosen = next(iter(fits))
        return chosen, fits[chosen]
    given = json.loads(params)
    if model == "pls":
        n = int(given["n_components"])
        return params, pls1_path(m, n, scale=given.get("scale", True))[n - 1]
    if model == "krr" and given.get("kernel", "linear") == "linear":
        return params, ridge_no_intercept(m, float(given["alpha"]))
    if model == "ols" and not given:
        return params, ols(m)
    raise ValueError(f"{model} cannot be fitted with {params}")
