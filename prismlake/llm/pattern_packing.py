"""Packing documents into few windows by patterns fitted with non-negative least squares.

A document is one piece where it fits into a window; a longer one is cut into full windows
and a first piece with what is left over.  Full pieces are windows of their own.  All
others are counted by length (at most ``window`` numbers), and the plan is made on these
counts alone:

* *patterns*: every multiset of at most three lengths that occur and that fill a window
  exactly,
* *fit*: repeat counts x >= 0 that minimise the weighted squares of (pieces used - pieces
  there are) by length.  Coordinates are minimised exactly, many at a time: in each round
  the patterns of steepest descent that share no length,
* *round*: down to whole numbers and to the pieces there are, the most used first, and
* *residuals*: best fit, longest first, on the counts (bins of equal room go together).

The plan has a few thousand patterns however many documents there are.  Pieces get the
rank they have among the pieces of their length, and the rank's place in the plan; a
length that many pieces have is ranked in as many tasks as it needs.

Edge cases: a null or empty text has only the end id; an empty table gives no rows;
repeated rows (equal in every column) each get a place; very long texts are pieces like
others; ties in length are broken by the row number of the written pieces; only the named
columns are read, so others cannot clash.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.bpe import encode_documents
from prismlake.llm.common import materialize

WINDOW = 2048
END_ID = 0
BUCKET_ROWS = 1_000        # pieces of one length that are ranked in one task
ROUNDS = 300               # at most so many rounds of the fit
SHORT_WEIGHT = 0.3         # weight of lengths up to an eighth of a window, which fill gaps well

Plan = list[tuple[dict[int, int], int]]


def cut_documents(encoded: DataFrame, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id") -> DataFrame:
    """Pieces of each document: id, piece, start, length, ids (binary).  All pieces but
    the first have the length of a window."""
    end = F.lit(bytearray(end_id.to_bytes(4, "little")))
    whole = (encoded.select(id_col, F.concat(F.coalesce("ids", F.lit(bytearray())), end).alias("all_ids"))
             .withColumn("n", F.floor(F.length("all_ids") / 4).cast("long"))
             .withColumn("first", F.pmod(F.col("n") - 1, F.lit(window)).cast("long") + 1))
    starts = F.sequence(F.col("first") - window, F.col("n") - window, F.lit(window).cast("long"))
    return (whole.select("*", F.posexplode(starts).alias("piece", "at"))
            .withColumn("start", F.greatest("at", F.lit(0).cast("long")))
            .withColumn("length", F.when(F.col("piece") == 0, F.col("first")).otherwise(F.lit(window).cast("long")))
            .select(id_col, "piece", "start", "length",
                    F.substring("all_ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")).alias("ids")))


def length_patterns(counts: np.ndarray, window: int) -> np.ndarray:
    """Patterns (a >= b >= c, 0: none) of two or three lengths with pieces that sum to
    ``window``; a length is in a pattern at most as often as it has pieces."""
    present = counts > 0
    found = []
    for a in np.flatnonzero(present)[::-1].tolist():
        rest = window - a
        if rest > 2 * a:                                   # then neither b nor c could be at most a
            break
        b = np.arange(-(-rest // 2), min(a, rest) + 1)
        c = rest - b
        good = present[b] & ((c == 0) | present[c])
        need_a = 1 + (b == a) + (c == a)
        need_b = 1 + (b == c)
        good &= (need_a <= counts[a]) & ((c == 0) | (need_b <= counts[b]))
        found.append(np.stack([np.full(good.sum(), a), b[good], c[good]], 1))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, window: int, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 of the weighted least-squares fit of patterns to ``counts``."""
    weight = np.where(np.arange(len(counts)) <= window // 8, SHORT_WEIGHT, 1.0)
    weight[0] = 0.0
    left = counts.astype(float)                            # pieces there are - pieces used
    x = np.zeros(len(patterns))
    a, b, c = patterns.T
    same_ab, same_bc = (a == b), (b == c) & (c > 0)
    # squared norm of a pattern's column: a length that occurs m times counts m * m
    norm = weight[a] + weight[b] + weight[c] + 2 * weight[a] * same_ab + 2 * weight[b] * same_bc + 2 * weight[a] * (same_ab & same_bc)
    for _ in range(rounds):
        step = (weight[a] * left[a] + weight[b] * left[b] + weight[c] * left[c]) / norm
        step = np.maximum(step, -x)
        gain = step * step * norm
        order = np.argsort(-gain, kind="stable")[:8 * len(counts)]
        order = order[gain[order] > 1e-3]
        if not len(order):
            break
        taken = np.zeros(len(counts), bool)
        chosen = []
        for i, p, q, r in zip(order.tolist(), a[order].tolist(), b[order].tolist(), c[order].tolist()):
            if not (taken[p] or taken[q] or r and taken[r]):
                taken[p] = taken[q] = taken[r] = True
                taken[0] = False
                chosen.append(i)
        chosen = np.array(chosen)
        x[chosen] += step[chosen]
        for part in (a, b, c):
            np.subtract.at(left, part[chosen], step[chosen])
    return x


def round_repeats(patterns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[Plan, np.ndarray]:
    """Whole repeat counts that the pieces allow, the most used patterns first; and the
    counts of what is left."""
    left = counts.copy()
    plan: Plan = []
    for i in np.argsort(-x, kind="stable")[:np.count_nonzero(x >= 0.5)].tolist():
        pattern: dict[int, int] = {}
        for length in patterns[i].tolist():
            if length:
                pattern[length] = pattern.get(length, 0) + 1
        times = min(int(x[i] + 0.5), *(int(left[length]) // n for length, n in pattern.items()))
        if times:
            plan.append((pattern, times))
            for length, n in pattern.items():
                left[length] -= n * times
    return plan, left


def best_fit(counts: np.ndarray, window: int) -> Plan:
    """Best fit, longest first.  Bins of equal content are one entry; equal pieces fill
    the tightest bin as far as it goes before the next one."""
    rooms: list[int] = []                                  # rooms with bins, ascending
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(pattern: dict[int, int], room: int, times: int) -> None:
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append((pattern, times))

    for length in np.flatnonzero(counts)[::-1].tolist():
        pieces = int(counts[length])
        while pieces:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, pattern, times = window, {}, pieces
            n = min(room // length, pieces)
            full = min(times, pieces // n)
            put(pattern | {length: n}, room - n * length, full)
            pieces -= full * n
            if full < times and pattern:
                put(pattern, room, times - full)
    return [entry for entries in bins.values() for entry in entries]


def plan_windows(counts: np.ndarray, window: int) -> Plan:
    """Patterns and how often each is used, until no piece is left."""
    patterns = length_patterns(counts, window)
    plan, left = round_repeats(patterns, fit_repeats(patterns, counts, window), counts) if len(patterns) else ([], counts)
    return plan + best_fit(left, window)


def _places(plan: Plan) -> tuple[dict[str, np.ndarray], int]:
    """For each pattern and length the ranks it takes: first rank, pieces a window, first
    window and offset in it, sorted by length and first rank; and the number of windows."""
    rows, taken, window = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length, n in pattern.items():
            rows.append((length, taken.get(length, 0), n, window, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        window += times
    table = np.array(sorted(rows) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "n", "window", "offset"), table.T)), window


def place_pieces(pieces: DataFrame, window: int = WINDOW, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  Any other columns are carried."""
    columns = [F.col(c) for c in pieces.columns]
    rows = materialize(pieces.select(F.struct(*columns).alias("_piece"), F.col(length_col).cast("long").alias("_length"),
                                     F.monotonically_increasing_id().alias("_row")))
    counts = np.zeros(window, np.int64)
    for length, n in rows.where(F.col("_length") < window).groupBy("_length").count().collect():      # fewer than ``window`` rows
        counts[length] = n
    places, windows = _places(plan_windows(counts, window))
    carried = [F.col("_piece")[c].alias(c) for c in pieces.columns]
    full = rows.where(F.col("_length") >= window).select(*carried, (F.col("_row") + windows).alias("sequence_id"),
                                                         F.lit(0).cast("long").alias("offset"))
    buckets = max(1, -(-int(counts.max()) // BUCKET_ROWS))
    short = rows.where(F.col("_length") < window).withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (short.groupBy("_length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select("_length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    inside = Window.partitionBy("_length", "_bucket").orderBy("_row")
    ranked = short.withColumn("_rank", F.row_number().over(inside) - 1).join(firsts, ["_length", "_bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        # one sortable key for (length, rank); ranks are below 2**48
        at = np.searchsorted(places["length"] << 48 | places["rank"], length.to_numpy() << 48 | rank.to_numpy(), "right") - 1
        inside = rank.to_numpy() - places["rank"][at]
        return pd.DataFrame({"sequence_id": places["window"][at] + inside // places["n"][at],
                             "offset": places["offset"][at] + inside % places["n"][at] * length.to_numpy()})

    placed = ranked.withColumn("_place", place(F.col("_length"), F.col("_rank") + F.col("_first")))
    return placed.select(*carried, "_place.sequence_id", "_place.offset").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack: one row per piece with its ids and its place."""
    return place_pieces(cut_documents(encode_documents(docs, tokenizer, id_col, text_col), window, id_col=id_col), window)
