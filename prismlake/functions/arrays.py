"""Column expressions over ``ARRAY<DOUBLE>`` spectra.

All helpers build Catalyst higher-order-function expressions (``transform``,
``aggregate``, ``zip_with``), so row-local spectral maths stays in the JVM and is
planned together with the surrounding projection -- no Python per row.  The one
exception is ``filter_windows``, a matrix product per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zero() -> Column:
    return F.lit(0.0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def arr_sum(c: str | Column) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda acc, x: acc + x)


def arr_mean(c: str | Column) -> Column:
    return arr_sum(c) / F.size(col(c))


def arr_centered_power_sum(c: str | Column, center: Column, power: int) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda acc, x: acc + F.pow(x - center, F.lit(float(power))))


def arr_var_pop_about(c: str | Column, mean: Column) -> Column:
    """Population variance about an already computed mean *column*.

    Catalyst does not hoist expressions out of a lambda, so a per-row scalar such as
    the mean must be a column of its own before it is used inside ``aggregate`` /
    ``transform`` -- otherwise it is recomputed for every element.
    """
    return F.aggregate(col(c), F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.size(col(c))


def with_row_moments(df, spectrum: str = "spectrum", mean: str = "_m", std: str = "_sd"):
    """Add per-row mean and population std columns (two projections, each O(n))."""
    return (df.withColumn(mean, arr_mean(spectrum))
            .withColumn(std, F.sqrt(arr_var_pop_about(spectrum, F.col(mean)))))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Catalyst's CollapseProject inlines projected columns into higher-order-function
    lambdas, where they are then re-evaluated for every array element.  Binding the
    value through ``aggregate``'s finish function keeps it a single evaluation.
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, body)


def arr_dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def arr_max(c: str | Column) -> Column:
    return F.array_max(col(c))


def arr_has_missing(c: str | Column) -> Column:
    """True when any element is null or NaN (pandas treats both as missing)."""
    return F.exists(col(c), lambda x: x.isNull() | F.isnan(x))


def map_values(c: str | Column, fn) -> Column:
    return F.transform(col(c), fn)


def gather(c: str | Column, idx: str | Column) -> Column:
    """``out[k] = c[idx[k]]`` (0-based indices); a null index gives null."""
    arr = col(c)
    return F.transform(col(idx), lambda i: F.when(i.isNull(), F.lit(None).cast("double"))
                       .otherwise(F.element_at(arr, i + 1)))


def filter_windows(df: DataFrame, name: str, weights: list[list[float]]) -> DataFrame:
    """``df`` with the array column ``name`` passed through a linear filter with
    position-dependent weights (Savitzky-Golay incl. edges).

    ``weights[o]`` is the weight row used for an output whose window starts
    ``o`` bands before it.  Window start is clamped to the array so the first and
    last outputs use the end-window fits.  Arrays shorter than the window give
    null; a null in a window gives a null output.

    One matrix product per Arrow batch and array length: nested higher-order
    functions would be inlined into each other and evaluated again for every band.
    """
    table = np.array(weights)
    w, h = len(table), len(table) // 2

    def rows(x: np.ndarray) -> np.ndarray:
        inner = np.lib.stride_tricks.sliding_window_view(x, w, axis=1) @ table[h]
        return np.concatenate([x[:, :w] @ table[:h].T, inner, x[:, -w:] @ table[h + 1:].T], axis=1)

    def filtered(arrays: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(arrays), 0))
        values = pc.cast(arrays.flatten(), pa.float64())
        starts = np.cumsum(sizes) - sizes
        plain = np.array(pc.fill_null(values, 0.0))            # a null adds nothing; its windows are masked below
        missing = np.array(pc.is_null(values)).astype(float)
        ones = np.ones_like(table)
        out, gone = np.zeros(len(plain)), np.zeros(len(plain), bool)
        for n in np.unique(sizes[sizes >= w]):
            at = starts[sizes == n][:, None] + np.arange(n)
            out[at] = rows(plain[at])
            if missing.any():
                hit = missing[at]
                inner = np.lib.stride_tricks.sliding_window_view(hit, w, axis=1).any(axis=2)
                gone[at] = np.concatenate([hit[:, :w] @ ones[:h].T > 0, inner, hit[:, -w:] @ ones[h + 1:].T > 0], axis=1)
        kept = np.where(sizes >= w, sizes, 0)
        ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        use = np.repeat(sizes >= w, sizes)
        flat = pa.array(out[use], pa.float64(), mask=gone[use])
        return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(sizes < w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([filtered(c) if n == name else c for n, c in zip(names, batch.columns)], names=names)

    fields = [T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == name else f for f in df.schema.fields]
    return df.mapInArrow(run, T.StructType(fields))
