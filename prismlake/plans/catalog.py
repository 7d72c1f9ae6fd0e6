"""Registry of named queries: a Spark builder plus (optionally) DuckDB oracle SQL.

Doubles are rounded to a fixed number of decimals in *both* engines (and
``+ 0.0`` turns a negative zero into zero) so that floating-point summation order
cannot change the value hash.  The rounding spec is declared once per query and
applied to both sides from the same declaration.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)
    note: str = ""

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_columns(self.build(spark, sf_dir), self.digits)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.digits:
            return self.sql
        repl = ", ".join(_duck_round(c, d) for c, d in self.digits.items())
        return f"select * replace ({repl}) from (\n{self.sql}\n) q"


def _duck_round(c: str, d: int) -> str:
    if c.startswith("[]"):
        name = c[2:]
        return f'list_transform("{name}", lambda v: round(v * {10.0 ** d!r}) / {10.0 ** d!r} + 0.0) as "{name}"'
    return f'round("{c}" * {10.0 ** d!r}) / {10.0 ** d!r} + 0.0 as "{c}"'


def round_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    if not digits:
        return df
    out = []
    for f in df.schema.fields:
        d = digits.get(f.name, digits.get("[]" + f.name))
        if d is None:
            out.append(F.col(f"`{f.name}`"))
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.transform(F.col(f"`{f.name}`"), _rounder(d)).alias(f.name))
        else:
            out.append(_round(F.col(f"`{f.name}`").cast("double"), d).alias(f.name))
    return df.select(*out)


def _rounder(d: int):
    return lambda v: _round(v, d)


def _round(c, d: int):
    """Half away from zero at ``d`` decimals, computed as round(c * 10^d) / 10^d so
    that Spark and DuckDB perform the identical IEEE operations."""
    scale = F.lit(10.0 ** d)
    return F.round(c * scale, 0) / scale + F.lit(0.0)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, digits: dict[str, int] | list[str] | None = None,
             default_digits: int = 6, note: str = ""):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    if isinstance(digits, list):
        digits = {c: default_digits for c in digits}

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, dict(digits or {}), note)
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    # importing the modules registers their queries
    from prismlake.plans import q_sources, q_clean, q_transforms, q_targets, q_profile, q_selection, q_models  # noqa: F401
    return REGISTRY
