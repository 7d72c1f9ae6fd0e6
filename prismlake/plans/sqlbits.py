"""Small DuckDB SQL fragments shared by the oracle statements."""

N = 64  # bands of the spectra fixture


def duck_long(inner: str, keys: str = "dataset, sample_id", col: str = "spectrum") -> str:
    """Explode a list column into (keys, band, value) with 0-based int bands."""
    return (f"select {keys}, cast(generate_subscripts({col}, 1) - 1 as int) as band, unnest({col}) as value "
            f"from ({inner}) z")


def wavelengths(n: int = N) -> list[float]:
    return [float(round(410 + i * 2080 / (n - 1))) for i in range(n)]


def sql_list(vals) -> str:
    return "[" + ", ".join(repr(float(v)) for v in vals) + "]"


def sql_poly(coefs, r: str) -> str:
    acc = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = f"({acc}) * ({r}) + {c!r}"
    return acc


def sql_norm_ppf(p: str) -> str:
    """AS 241 inverse normal CDF as a DuckDB expression (same algorithm as functions.normal)."""
    from prismlake.functions import normal as N
    q = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    central = f"{q} * ({sql_poly(N.A, rc)}) / ({sql_poly(N.B, rc)})"
    r = f"sqrt(-ln(case when {q} < 0 then ({p}) else 1 - ({p}) end))"
    mid = f"({sql_poly(N.C, r + ' - 1.6')}) / ({sql_poly(N.D, r + ' - 1.6')})"
    far = f"({sql_poly(N.E, r + ' - 5.0')}) / ({sql_poly(N.G, r + ' - 5.0')})"
    tail = f"(case when {r} <= 5 then {mid} else {far} end)"
    return (f"(case when ({p}) <= 0 or ({p}) >= 1 then null when abs({q}) <= 0.425 then {central} "
            f"when {q} < 0 then -{tail} else {tail} end)")
