"""Removal of repeated word windows by level-wise doubling.

A window of ``WINDOW`` (35) words whose word sequence also starts anywhere else is
repeated, and the words it covers are removed.  Short windows are tested first, and
only what is repeated at one length is extended to twice that length:

* 8 words: each window is represented by its *anchor*, the 8-word window inside it
  whose hash is smallest (leftmost if equal).  Equal windows have equal anchors at
  equal offsets, so only anchors are counted - about one for 14 positions.  Windows
  whose anchor occurs once are done.
* Neighbouring windows with the same anchor form a run of at most 28.  Runs that are
  equal over all their words are counted as one *context*: all windows of a context
  that occurs twice are repeated, so copies of documents and long shared passages end
  here, however many there are.
* What is left are contexts that share their anchor with a different context, the
  borders of shared passages.  Their windows go on one by one: the 16 words around
  the anchor must occur in another context, then 32 words, then all 35.

Hashes of 35 words and of contexts have 128 bits.  Counts are aggregated before they
are shuffled, joins are on hashes, and each step is a written table.

Edge cases: a null text has no words; shorter texts than a window lose nothing;
repeated rows are repeated text; ties cannot occur; an empty table gives no rows; only
the id and text columns are read.  A single document of any length is hashed in blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import discard, materialize, text_or_empty, text_slices

WINDOW = 35
ANCHOR = 8
SPAN = WINDOW - ANCHOR + 1         # anchors inside a window, and most windows of a run
BLOCK = 1 << 18                    # window starts that are hashed at once
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)     # odd multipliers of the two polynomial hashes


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@functools.cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Rolling:
    """Two 64-bit hashes of any word range of a block."""

    def __init__(self, words: np.ndarray):
        n = BLOCK + 2 * WINDOW
        self.sums, self.down = [], []
        for base in _BASES:
            up, down = _powers(base, n if len(words) < n else len(words) + 1)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)])]))
            self.down.append(down)

    def range(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[k][end] - self.sums[k][start]) * self.down[k][start])


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def find_runs(words: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> Iterator[dict[str, np.ndarray]]:
    """Runs of the windows of many documents, one after the other in ``words``; ``doc``
    is the number of each word's document.  Window starts are places in ``words``."""
    span = window - ANCHOR + 1
    for begin in range(0, len(words) - window + 1, BLOCK):
        part, owner = words[begin:begin + BLOCK + window - 1], doc[begin:begin + BLOCK + window - 1]
        n = len(part) - window + 1
        if n <= 0:
            return
        rolling = Rolling(part)
        starts = np.arange(len(part) - ANCHOR + 1)
        short = rolling.range(0, starts, starts + ANCHOR)
        anchor = sliding_window_view(short, span).argmin(1) + np.arange(n)
        valid = owner[:n] == owner[window - 1:]
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (owner[1:n] != owner[:n - 1])) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change, [n]])
        first, last = first[valid[first]], last[valid[first]]
        offset = anchor[first] - first
        shape = (offset * 64 + (last - first)).astype(np.uint64)
        yield {"start": begin + first, "shape": shape.astype(np.int32), "anchor": short[anchor[first]],
               "c1": _mix(rolling.range(0, first, last + window - 1) + shape),
               "c2": _mix(rolling.range(1, first, last + window - 1) + shape)}


_RUNS = "key binary, start int, shape int, anchor long, c1 long, c2 long"


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        hashes = [word_hashes(t) for t in part.column("text").to_pylist()]
        sizes = np.array([len(h) for h in hashes], np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        base = np.cumsum(sizes) - sizes
        for runs in find_runs(np.concatenate(hashes), doc):
            row = doc[runs["start"]]
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(row)), pa.array((runs["start"] - base[row]).astype(np.int32)), pa.array(runs["shape"]),
                 *(pa.array(runs[c].view(np.int64)) for c in ("anchor", "c1", "c2"))], names=["key", "start", "shape", "anchor", "c1", "c2"])


_WINDOWS = "c1 long, c2 long, at int, h16 long, h32 long, ha long, hb long"


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the named runs of each text: their hashes at 16, 32 and all words."""
    for part in text_slices(batches):
        for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist()):
            words = word_hashes(text)
            out: list[list[np.ndarray]] = []
            for run in runs:
                offset, n = run["shape"] // 64, run["shape"] % 64
                rolling = Rolling(words[run["start"]:run["start"] + n + WINDOW - 1])
                at = np.arange(n)
                half = at + np.clip(offset - at - 4, 0, WINDOW - 16)       # each holds the anchor, wherever in the window it is
                most = at + np.clip(offset - at - 12, 0, WINDOW - 32)
                out.append([np.full(n, run["c1"]), np.full(n, run["c2"]), at.astype(np.int32),
                            rolling.range(0, half, half + 16), rolling.range(0, most, most + 32),
                            rolling.range(0, at, at + WINDOW), rolling.range(1, at, at + WINDOW)])
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols],
                                             names=["c1", "c2", "at", "h16", "h32", "ha", "hb"])


def _kept(text: str, runs: list[dict] | None, as_is: bool) -> tuple[int, int, str]:
    words = text.encode().split()
    if not runs:
        return len(words), 0, text if as_is else b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int32)
    for run in runs:
        mask, start = run["mask"], run["start"]
        while mask:
            skip = (mask & -mask).bit_length() - 1
            mask >>= skip
            ones = (~mask & (mask + 1)).bit_length() - 1
            mask >>= ones
            edge[start + skip] += 1
            edge[start + skip + ones - 1 + WINDOW] -= 1
            start += skip + ones
    keep = np.cumsum(edge[:-1]) == 0
    return len(words), int(len(words) - keep.sum()), b" ".join([w for w, k in zip(words, keep.tolist()) if k]).decode()


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(key, text) -> (key, runs): for each text with repeated windows, the runs they
    are in, as first window start and a bit mask of repeated windows (a written table)."""
    every = materialize(texts.mapInArrow(_run_batches, _RUNS))
    # the counts are written tables, so that a frequent anchor's rows can be split in the joins
    again = materialize(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("anchor"))
    runs = materialize(every.join(again, "anchor", "left_semi")
                       # without the anchor as a key the sum needs its own exchange, so the join before it can split a hot anchor
                       .groupBy("key", "start", "shape", "c1", "c2").agg(F.min("anchor").alias("anchor"), F.count(F.lit(1)).alias("n")))
    discard(every, again)
    contexts = materialize(runs.groupBy("c1", "c2", "shape", "anchor")
                           .agg(F.sum("n").alias("n"), F.min(F.struct("key", "start")).alias("place")))
    several = materialize(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("anchor"))
    asked = (contexts.join(several, "anchor", "left_semi").groupBy(F.col("place.key").alias("key"))
             .agg(F.collect_list(F.struct(F.col("place.start").alias("start"), "shape", "c1", "c2")).alias("runs")))
    windows = materialize(texts.join(asked, "key").mapInArrow(_window_batches, _WINDOWS).distinct())
    discard(several)
    for columns in (["h16"], ["h32"], ["ha", "hb"]):
        found = materialize(windows.groupBy(*columns).agg(F.min("c1").alias("low"), F.max("c1").alias("high"))
                            .where("low <> high").select(*columns))
        longer = materialize(windows.join(found, columns, "left_semi"))
        discard(windows, found)
        windows = longer
    one = F.lit(1).cast("long")
    masks = (contexts.where("n >= 2").select("c1", "c2", (F.call_function("shiftleft", one, F.col("shape") % 64) - 1).alias("mask"))
             .unionByName(windows.select("c1", "c2", F.call_function("shiftleft", one, F.col("at")).alias("mask")))
             .groupBy("c1", "c2").agg(F.bit_or("mask").alias("mask")))
    result = materialize(runs.select("key", "start", "c1", "c2").join(materialize(masks), ["c1", "c2"]).groupBy("key").agg(
        F.collect_list(F.struct("start", "mask")).alias("runs")))
    discard(runs, contexts, windows)
    return result


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), as_is: bool = False) -> DataFrame:
    """One row per input row: id, the columns in ``carry``, ``n_words``, ``n_removed`` and
    ``kept``: the words that stay, joined by one space.  ``as_is``: a text that loses
    nothing is kept as it is, and a null text stays null."""
    key = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    base = docs.select(F.struct(id_col, *carry).alias("row"), F.col(text_col).isNull().alias("absent"),
                       text_or_empty(text_col).alias("text")).withColumn("key", key)
    marked = base.join(repeated_runs(base.select("key", "text")), "key", "left").select("row", "absent", "text", "runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = [_kept(t, r, as_is) for t, r in zip(part.column("text").to_pylist(), part.column("runs").to_pylist())]
            n, gone, kept = ([r[k] for r in rows] for k in range(3))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("absent"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(kept, pa.string())], names=["row", "absent", "n_words", "n_removed", "kept"])

    row_type = base.schema["row"].dataType.simpleString()
    out = marked.mapInArrow(keep, f"row {row_type}, absent boolean, n_words long, n_removed long, kept string")
    kept = F.when(F.col("absent"), F.lit(None)).otherwise(F.col("kept")) if as_is else F.col("kept")
    return out.select("row.*", "n_words", "n_removed", kept.alias("kept"))
