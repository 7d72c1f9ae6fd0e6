"""Binned spectra and the split search that all tree models share.

Each band of a (dataset, preprocessing) is cut at quantiles (at its own values where it has
few), once for all models and folds; the held-out rows' bands take part in
that, their targets never.  A row then carries one byte a band.  A tree model needs, for
every node, only counts and target sums by (band, bin): sums that batches, tasks and
machines add up, and from which every split can be read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32                  # bins of a band, at most 256
CELLS = 8192               # entries times bands that are added up at once
PAIR_CELLS = 1024          # cells of two bands that are added up together
PAIR_ROWS = 1024           # entries a node from which that pays
SKETCH = 100_000           # accuracy of the quantiles (exact up to about so many distinct values)


def band_cuts(prepared: DataFrame, bins: int = BINS) -> dict[tuple[str, str], np.ndarray]:
    """(dataset, preprocessing) -> (band, bins - 1) ascending cuts, filled up with infinity.
    A value goes to the bin of the number of cuts below it.  One row a band comes to the
    driver."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    long = prepared.select("dataset", "preprocessing", F.posexplode("spectrum").alias("band", "x")).where("x is not null and not isnan(x)")
    found = (long.groupBy("dataset", "preprocessing", "band")
             .agg(F.percentile_approx("x", shares, F.lit(SKETCH)).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
    cuts: dict[tuple[str, str], dict[int, np.ndarray]] = {}
    for r in found:
        at = np.unique(np.array([v for v in r["q"] if v < r["hi"]], float))
        cuts.setdefault((r["dataset"], r["preprocessing"]), {})[r["band"]] = at
    out = {}
    for key, by_band in cuts.items():
        table = np.full((max(by_band) + 1, bins - 1), np.inf)
        for band, at in by_band.items():
            table[band, :len(at)] = at
        out[key] = table
    return out


def to_bins(spectra: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    out = np.empty(spectra.shape, np.uint8)
    for band in range(spectra.shape[1]):
        out[:, band] = np.searchsorted(cuts[band], spectra[:, band], "left")
    return out


def row_hash(ids: np.ndarray) -> np.ndarray:
    """A well-mixed unsigned 64-bit number of each integer."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(ids: np.ndarray, *salts: int) -> np.ndarray:
    """A number in [0, 1) for each row, by the row's id and the salts alone."""
    x = row_hash(ids)
    for s in salts:
        x = row_hash(x ^ row_hash(np.array([s], np.int64)))
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def binned_rows(prepared: DataFrame, cuts: dict[tuple[str, str], np.ndarray], keep_values: bool = False) -> DataFrame:
    """(dataset, preprocessing, sample_id, fold, inner, rid, bins, y[, x]): rows with a target
    and a whole spectrum.  ``rid`` numbers a row by its id, for sampling by hash;
    ``keep_values`` keeps the spectrum as packed doubles."""
    rows = prepared.where(F.col("target").isNotNull() & F.col("spectrum").isNotNull()).select(
        "dataset", "preprocessing", "sample_id", "fold", "inner", F.xxhash64("sample_id").alias("rid"), "spectrum", F.col("target").alias("y"))
    id_type = prepared.schema["sample_id"].dataType.simpleString()
    schema = (f"dataset string, preprocessing string, sample_id {id_type}, fold int, inner int, rid long, bins binary, y double"
              + ", x binary" * keep_values)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed, values = [None] * len(pdf), [None] * len(pdf)
            for key, part in pdf.reset_index(drop=True).groupby(["dataset", "preprocessing"], sort=False):
                x = np.stack([np.asarray(v, float) for v in part["spectrum"]])
                for i, binned, row in zip(part.index, to_bins(x, cuts[key]), x):
                    if not np.isnan(row).any():
                        packed[i], values[i] = binned.tobytes(), row.tobytes()
            out = pdf.drop(columns="spectrum").assign(bins=packed, x=values)
            yield out[out["bins"].notna()][names]

    return rows.mapInPandas(run, schema)


def matrix(packed: pa.Array | pd.Series) -> np.ndarray:
    """Rows of packed bins as a matrix."""
    values = list(packed) if isinstance(packed, pd.Series) else packed.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1) if values else np.empty((0, 0), np.uint8)


def node_sums(bins: np.ndarray, slot: np.ndarray, row: np.ndarray, value: np.ndarray, slots: int, n_bins: int) -> np.ndarray:
    """(2, slots, bands, bins): count and sum of ``value`` of entries that lie in ``slot`` (a
    node of a fit) and stand for a ``row`` of ``bins``."""
    return column_sums(np.ascontiguousarray(bins.T), slot, row, value, slots, n_bins)


def column_sums(columns: np.ndarray, slot: np.ndarray, row: np.ndarray, value: np.ndarray, slots: int, n_bins: int) -> np.ndarray:
    """``node_sums`` of bins that are kept by band.  Few bands at a time, so that their sums stay
    in the cache."""
    out, first, size = np.empty((2, slots, len(columns), n_bins)), slot * n_bins, slots * n_bins
    step = max(1, CELLS // max(1, len(row)))
    for start in range(0, len(columns), step):
        part = columns[start:start + step]
        at = ((np.arange(len(part)) * size)[:, None] + (part[:, row] + first)).ravel()
        for k, weight in enumerate((None, np.tile(value, len(part)))):
            out[k, :, start:start + step] = np.bincount(at, weight, len(part) * size).reshape(-1, slots, n_bins).swapaxes(0, 1)
    return out


def band_pairs(columns: np.ndarray, n_bins: int) -> np.ndarray | None:
    """(pairs of bands, rows): the cell of each row in the table of two neighbouring bands; none
    where a band has too many bins for that."""
    if n_bins * n_bins > PAIR_CELLS:
        return None
    first, second = columns[::2].astype(np.intp), np.zeros(((len(columns) + 1) // 2, columns.shape[1]), np.intp)
    second[:len(columns) // 2] = columns[1::2]
    return first * n_bins + second


def pair_sums(pairs: np.ndarray, bands: int, slot: np.ndarray | None, row: np.ndarray, values: list[np.ndarray | None], slots: int, n_bins: int) -> np.ndarray:
    """(values, slots, bands, bins): sums of each of ``values`` (none: counts) as ``column_sums``
    has them, added up for two bands together, whose table then gives both."""
    cells = n_bins * n_bins
    out = np.empty((len(values), slots, 2 * len(pairs), n_bins))
    first = None if slots == 1 else slot * cells
    table = np.empty((len(values), len(pairs), slots, cells))
    for i, pair in enumerate(pairs):
        at = pair.take(row, mode="clip")
        if first is not None:
            at += first
        for k, value in enumerate(values):
            table[k, i] = np.bincount(at, value, slots * cells).reshape(slots, cells)
    table, ones = table.reshape(len(values), len(pairs), slots, n_bins, n_bins), np.ones(n_bins)
    out[:, :, ::2], out[:, :, 1::2] = (table @ ones).swapaxes(1, 2), (ones @ table).swapaxes(1, 2)          # faster than sums along an axis
    return out[:, :, :bands]


def best_splits(sums: np.ndarray, min_leaf: int = 1) -> dict[str, np.ndarray]:
    """For each node the split of largest decrease in squared error: band (-1: none), bin
    (values up to it go left), gain, and counts and sums of both sides.  Gains that agree to
    ten digits are ties, which the first band and bin win, so that the order of additions
    does not matter."""
    n, s = sums[:, :, 0].sum(2)                                                 # any band adds up to the node
    nl, sl = sums[0].cumsum(2)[:, :, :-1], sums[1].cumsum(2)[:, :, :-1]
    gain = sl * n[:, None, None]
    gain -= nl * s[:, None, None]
    gain *= gain
    nr = n[:, None, None] - nl
    over = nl * nr
    over *= n[:, None, None]
    fine = (nl >= min_leaf) & (nr >= min_leaf)
    gain = np.divide(gain, over, out=np.full(gain.shape, -1.0), where=fine & (over > 0)).reshape(len(n), -1)
    most = gain.max(1, initial=-1.0)
    at = (gain >= (most - 1e-10 * np.maximum(most, 0))[:, None]).argmax(1)
    scale = np.divide(s * s, n, out=np.zeros_like(s), where=n > 0)
    good = most > 1e-12 * np.maximum(scale, 1e-300)
    cuts = sums.shape[3] - 1
    band, cut = np.where(good, at // cuts, -1), at % cuts
    pick = np.arange(len(n)), np.maximum(band, 0), cut
    left = np.stack([nl[pick], sl[pick]], 1)
    total = np.stack([n, s], 1)
    sides = np.concatenate([left, total - left], 1)
    sides[~good] = np.concatenate([total, np.zeros_like(total)], 1)[~good]      # all rows stay left
    return {"band": band, "bin": np.where(good, cut, 0), "gain": np.where(good, most, 0.0), "sides": sides}


def descend(bins: np.ndarray, node: np.ndarray, row: np.ndarray, band: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Child numbers (2 * node, or + 1 on the right) of entries at ``node``, whose splits are
    given for each entry; without a split an entry goes left."""
    right = (band >= 0) & (bins[row, np.maximum(band, 0)] > cut)
    return 2 * node + right
