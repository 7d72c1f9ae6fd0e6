"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are the nodes' paths of a binary trie.  The join starts with the pair
(root, root) and goes down both nodes of a pair together; a pair carries how many
bits of its two paths differ and is dropped when that exceeds the budget.  Upper
levels are DataFrame joins of node pairs, ``STEP_BITS`` at a time, and a pair is
expanded only while its two subtries hold more than ``UNIT_ROWS`` fingerprints, so a
dense corner of the trie is split further and no task gets an unbounded group.  The
subtries of a remaining pair go to one task, which walks on bit by bit.

Equal fingerprints are one node, so copies never become pairs, and within two bits a
fingerprint has at most 2,080 others.

Edge cases: null, empty and wordless texts have fingerprint zero and are linked like
any other; with fewer words than a shingle the whole word sequence is hashed; null
ids take part but are never the smallest id (a component of null ids has a null
``component_id``); very long texts are hashed in slices; a bit set in exactly half the
shingles is not set, and no other tie can occur; repeated rows each give a row; an empty
table gives no rows; only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismlake.llm.common import materialize, text_or_empty, text_slices
from prismlake.llm.graph import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
STEP_BITS = 4
UNIT_ROWS = 1 << 15        # fingerprints of a node pair that one task walks
LEAF_PAIRS = 32            # fingerprint pairs of a node pair that are compared directly
FRONTIER = 1 << 18         # node pairs a task holds at once

_BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BIT = np.array([8 * (j // 8) + 7 - j % 8 for j in range(64)], np.uint64)   # bit number by place in np.unpackbits


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, about a megabyte at a time."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        if end < len(data):
            space = _SPACE.search(data, end)
            end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over the XXH64 of all word shingles of a text, repeats included."""
    total, ones, carry = 0, np.zeros(64, np.int64), []
    for block in word_blocks(text.encode().lower()):
        words = carry + block
        n = len(words) - shingle + 1
        if n > 0:
            grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
            for k in range(0, n, _BLOCK >> 4):
                ones += np.unpackbits(hashes[k:k + (_BLOCK >> 4)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
            total += n
        carry = words[-(shingle - 1):] if shingle > 1 else []
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.bitwise_or.reduce(np.where(2 * ones > total, np.uint64(1) << _BIT, np.uint64(0))))


def add_fingerprint(docs: DataFrame, text_col: str, name: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the fingerprint of ``text_col`` as a signed 64-bit column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col):
            prints = [fingerprint(t or "", shingle) for t in part.column(text_col).to_pylist()]
            column = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, name])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


# -- trie self-join ------------------------------------------------------------

def walk_pairs(a: np.ndarray, b: np.ndarray, same: bool, depth: int, diff: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between two subtries (sorted unsigned fingerprints that share their first
    ``depth`` bits each), both walked down together; ``same``: one subtrie with itself."""
    if not len(a) or not len(b):
        return
    stack = [(depth, np.array([[0, len(a), 0, len(b), diff]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        leaf = (size <= LEAF_PAIRS) if depth < 64 else np.ones(len(pairs), bool)
        if leaf.any():
            yield from _compare(a, b, pairs[leaf], size[leaf], same, budget)
            pairs = pairs[~leaf]
        if not len(pairs):
            continue
        if len(pairs) > FRONTIER:
            stack += [(depth, part) for part in np.array_split(pairs, -(-len(pairs) // FRONTIER))]
            continue
        bit = np.uint64(1 << (63 - depth))
        above = np.uint64((1 << 64) - (1 << (64 - depth)))
        lo_a, hi_a, lo_b, hi_b, d = pairs.T
        mid_a = np.searchsorted(a, (a[lo_a] & above) | bit)
        mid_b = np.searchsorted(b, (b[lo_b] & above) | bit)
        twin = (lo_a == lo_b) if same else np.zeros(len(pairs), bool)
        children = [np.stack([lo_a, mid_a, lo_b, mid_b, d], 1), np.stack([mid_a, hi_a, mid_b, hi_b, d], 1),
                    np.stack([lo_a, mid_a, mid_b, hi_b, d + 1], 1), np.stack([mid_a, hi_a, lo_b, mid_b, d + 1], 1)[~twin]]
        nxt = np.concatenate(children)
        nxt = nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= budget)]
        stack.append((depth + 1, nxt))


def _compare(a, b, pairs, size, same, budget):
    for k in range(0, len(pairs), FRONTIER // LEAF_PAIRS):
        part, n = pairs[k:k + FRONTIER // LEAF_PAIRS], size[k:k + FRONTIER // LEAF_PAIRS]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(part[:, 3] - part[:, 2], n)
        i, j = np.repeat(part[:, 0], n) + inside // wide, np.repeat(part[:, 2], n) + inside % wide
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= (i < j) | (np.repeat(part[:, 0] != part[:, 2], n) & (i != j))
        if near.any():
            yield a[i[near]], b[j[near]]


def _forest(links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the smallest node of its component: as connected, fewer."""
    a, b = (np.concatenate([x[k] for x in links]) for k in (0, 1))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def node_pairs(prints: DataFrame, budget: int = MAX_BITS, unit_rows: int = UNIT_ROWS) -> tuple[DataFrame, list[int]]:
    """Pairs of trie nodes (depth, p, q, diff) whose subtries one task can walk, and
    the depths that occur.  ``prints``: distinct ``fp``."""
    spark = prints.sparkSession
    level = prints.agg(F.count(F.lit(1)).alias("n_p")).select(
        F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("diff"), "n_p", F.col("n_p").alias("n_q"))
    units, depths, depth = None, [], 0
    while True:
        level = materialize(level)
        small = level.where((F.col("n_p") + F.col("n_q") <= unit_rows) | F.lit(depth >= 64))
        part = small.select(F.lit(depth).alias("depth"), "p", "q", "diff")
        units = part if units is None else units.unionByName(part)
        depths.append(depth)
        large = level.where(F.col("n_p") + F.col("n_q") > unit_rows)
        if depth >= 64 or large.isEmpty():
            return units, depths
        heavy = large.select("p").unionByName(large.select(F.col("q").alias("p"))).distinct()
        child = (prints.groupBy(_prefix(depth + STEP_BITS).alias("child")).agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("p", F.shiftrightunsigned("child", STEP_BITS)).join(heavy, "p", "left_semi"))
        left = child.select("p", F.col("child").alias("cp"), F.col("n").alias("np"))
        right = child.select(F.col("p").alias("q"), F.col("child").alias("cq"), F.col("n").alias("nq"))
        grown = F.col("diff") + F.bit_count(F.col("cp").bitwiseXOR(F.col("cq")).bitwiseAND(F.lit((1 << STEP_BITS) - 1)))
        level = (large.select("p", "q", "diff").join(left, "p").join(right, "q")
                 .where((F.col("p") != F.col("q")) | (F.col("cp") <= F.col("cq")))
                 .select(F.col("cp").alias("p"), F.col("cq").alias("q"), grown.cast("int").alias("diff"),
                         F.col("np").alias("n_p"), F.col("nq").alias("n_q"))
                 .where(F.col("diff") <= budget))
        depth += STEP_BITS


def trie_links(prints: DataFrame, budget: int = MAX_BITS, unit_rows: int = UNIT_ROWS, forest: bool = False) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` at ``budget`` bits or fewer.
    ``forest``: within a task only as many as connect the same fingerprints."""
    units, depths = node_pairs(prints, budget, unit_rows)
    sides = []
    for depth in depths:
        at = prints.select("fp", _prefix(depth).alias("at"))
        here = units.where(F.col("depth") == depth)
        sides.append(at.join(here, at["at"] == here["p"]).select("depth", "p", "q", "diff", F.lit(0).alias("side"), "fp"))
        here = here.where("p <> q")
        sides.append(at.join(here, at["at"] == here["q"]).select("depth", "p", "q", "diff", F.lit(1).alias("side"), "fp"))
    rows = sides[0]
    for more in sides[1:]:
        rows = rows.unionByName(more)

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        depth, p, q, diff = (int(k) for k in key)
        prints = np.sort(pdf["fp"].to_numpy(np.int64)[pdf["side"].to_numpy() == 0].view(np.uint64))
        other = np.sort(pdf["fp"].to_numpy(np.int64)[pdf["side"].to_numpy() == 1].view(np.uint64)) if p != q else prints
        links = list(walk_pairs(prints, other, p == q, depth, diff, budget))
        if not links:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        a, b = _forest(links) if forest else (np.concatenate([x[k] for x in links]) for k in (0, 1))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy("depth", "p", "q", "diff").applyInPandas(walk, "a long, b long")


def fingerprint_groups(prints: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """``prints`` (id, fp; any number of rows a fingerprint) -> one row per fingerprint:
    fp, root (a fingerprint that names the component) and component_id."""
    groups = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    found = connected_components(trie_links(groups.select("fp"), budget, forest=True))
    rooted = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE_WORDS, budget: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the
    smallest id that links reach from the row, its own included)."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    prints = materialize(add_fingerprint(base, "text", "fp", shingle).select("id", "fp"))
    groups = fingerprint_groups(prints, budget)
    return prints.join(groups, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                            "component_id")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           shingle: int = SHINGLE_WORDS, budget: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs``, all columns, one for each component: the one with the smallest
    id; among rows that share it, the one whose columns hash lowest."""
    columns = docs.columns
    numbered = docs.select(F.struct(*columns).alias("row"), text_or_empty(text_col).alias("text"), F.col(id_col).alias("id"))
    marked = materialize(add_fingerprint(numbered, "text", "fp", shingle).select("row", "id", "fp"))
    groups = fingerprint_groups(marked.select("id", "fp"), budget)
    first = marked.join(groups, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    return first.groupBy("root").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
