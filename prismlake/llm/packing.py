"""Packing documents into fixed windows by minimum bin slack.

A document's ids (with an end id) are cut into full windows and one remainder.  The
remainders of all documents are counted by length - at most ``window`` numbers - and
the plan is made on these counts alone: each window takes the longest length left and
fills the rest with the multiset of lengths whose sum comes closest to the capacity,
found by subset sums in a bitset (bit s: sum s can be reached) and read back as a
count for each length.  A multiset is used as often as the counts allow, so the plan
has a few thousand patterns however many documents there are.  Pieces then get the
rank they have among the pieces of their length, and the rank's place in the plan.

Edge cases: a null text has only the end id; an empty table gives no rows; repeated
rows (equal in every column) each get a place; ties in length are broken by the row
number of the written pieces; only named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.bpe import encode_documents
from prismlake.llm.common import materialize

WINDOW = 2048
END_ID = 1
BUCKET_ROWS = 1_000        # pieces of one length that are ranked in one task


def cut_documents(encoded: DataFrame, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id") -> DataFrame:
    """Pieces of each document: id, start, length, ids (binary), doc_tokens."""
    end = F.lit(bytearray(end_id.to_bytes(4, "little")))
    whole = encoded.select(id_col, F.concat(F.coalesce("ids", F.lit(bytearray())), end).alias("all_ids"))
    whole = whole.withColumn("doc_tokens", F.floor(F.length("all_ids") / 4).cast("long"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(window).cast("long")))
    return (whole.withColumn("start", starts)
            .withColumn("length", F.least(F.col("doc_tokens") - F.col("start"), F.lit(window).cast("long")))
            .select(id_col, "start", "length",
                    F.substring("all_ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")).alias("ids"),
                    "doc_tokens"))


def fill_window(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset {length: count} for one window: the longest length left, and the
    lengths that fill the rest of ``capacity`` best.  ``counts`` is by length."""
    lengths = np.flatnonzero(counts)[::-1].tolist()
    longest = lengths[0]
    room = capacity - longest
    limit = (1 << (room + 1)) - 1
    layers: list[tuple[int, int, int]] = []            # length, count allowed, sums reached before it
    reach = 1
    for length in lengths:
        if length > room:
            continue
        most = min(int(counts[length]) - (length == longest), room // length)
        if most <= 0:
            continue
        layers.append((length, most, reach))
        step = reach
        for _ in range(most):
            step = (step << length) & limit
            if not step & ~reach:
                break
            reach |= step
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    chosen = {longest: 1}
    for length, most, before in reversed(layers):
        used = next(c for c in range(most + 1) if best >= c * length and before >> (best - c * length) & 1)
        if used:
            chosen[length] = chosen.get(length, 0) + used
            best -= used * length
    return chosen


def plan_windows(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, until no piece is left."""
    left = counts.copy()
    plan = []
    while left.any():
        pattern = fill_window(left, capacity)
        times = min(int(left[length]) // n for length, n in pattern.items())
        for length, n in pattern.items():
            left[length] -= n * times
        plan.append((pattern, times))
    return plan


def _slots(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each pattern and length, the ranks it takes: first rank, pieces a window,
    first window, offset in the window.  Sorted by length and first rank."""
    rows, taken, window = [], [0] * (capacity + 1), 0
    for pattern, times in plan:
        offset = 0
        for length, n in pattern.items():
            rows.append((length, taken[length], n, window, offset))
            taken[length] += n * times
            offset += n * length
        window += times
    table = np.array(sorted(rows) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "n", "window", "offset"), table.T))


def assign_sequences(pieces: DataFrame, window: int = WINDOW, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  Any other columns are carried."""
    rows = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))
    lengths = rows.select("_row", F.col(length_col).alias("_length"))          # all that is planned on; the pieces stay where they are
    counts = np.zeros(window + 1, np.int64)
    for length, n in lengths.groupBy("_length").count().collect():             # at most ``window`` rows
        counts[length] = n
    slots = _slots(plan_windows(counts, window), window)
    buckets = max(1, -(-int(counts.max()) // BUCKET_ROWS))
    lengths = lengths.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (lengths.groupBy("_length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select("_length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    inside = Window.partitionBy("_length", "_bucket").orderBy("_row")
    ranked = lengths.withColumn("_rank", F.row_number().over(inside) - 1).join(firsts, ["_length", "_bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        # one sortable key for (length, rank); ranks are below 2**48
        at = np.searchsorted(slots["length"] << 48 | slots["rank"], length.to_numpy() << 48 | rank.to_numpy(), "right") - 1
        inside = rank.to_numpy() - slots["rank"][at]
        return pd.DataFrame({"sequence_id": slots["window"][at] + inside // slots["n"][at],
                             "offset": slots["offset"][at] + inside % slots["n"][at] * length.to_numpy()})

    placed = (ranked.withColumn("_place", place(F.col("_length").cast("long"), F.col("_rank") + F.col("_first")))
              .select("_row", "_place.sequence_id", "_place.offset"))
    # the small side is hashed, so that pieces with their ids are neither sorted nor spilled
    return rows.join(placed.hint("shuffle_hash"), "_row").drop("_row")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack: one row per piece with its ids and its place."""
    return assign_sequences(cut_documents(encode_documents(docs, tokenizer, id_col, text_col), window, id_col=id_col), window)
