"""Document scores by masked pseudo-likelihood.

A small network predicts every token from ``CONTEXT`` tokens on both sides of it, the
token itself masked; a document's score is the sum of the tokens' conditional
log-probabilities.

* Tokens are words (A-Z in lower case).  Of a corpus of n words, those that occur at least
  n ** ``RARITY`` times over all documents (``LEAST`` times at least) are tokens of their own, so
  the vocabulary grows with the corpus and has at most n ** (1 - RARITY) words; all others
  share hash tokens, a third as many.
* The network has token embeddings, one hidden layer and a three-step softmax: a token's
  class, its group within the class, and its place within the group, about as many of each.
* Texts become tokens once; training and scoring read the written tokens.
* Training goes over all documents in ``ROUNDS`` passes.  Documents are dealt into shards by a
  hash of id and text and lie in order of that hash.  A shard has ``SHARD_WORDS`` words, or
  ``WORDS_A_WEIGHT`` for each weight if that is more, so that what the shards return grows in
  proportion to the corpus.  In a pass every shard starts from the common weights and trains on its own
  texts (every ``ROUNDS``-th token of each text, from another start in each pass, so that the
  passes together train on every token once); the shards' weights are averaged, weighted
  by their positions, in a shuffled sum that returns each weight once.  So the weights
  do not depend on how the input is laid out.
* Scoring is one pass with fixed weights, whole texts, in blocks of positions.

Edge cases: a null or wordless text has no tokens, sum 0 and a null mean; an empty
corpus leaves the initial weights; very long texts are trained on and scored in blocks;
equally frequent words are ordered by their hash; repeated rows each give a row; only the id
and text columns are read, so others cannot clash.  Sums of weights are floating-point, so
scores of two runs agree to about six digits, not bit by bit.
"""

from __future__ import annotations

import ctypes
import functools
import glob
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import discard, materialize, text_or_empty, text_slices

RARITY = 0.4
LEAST = 4
CONTEXT = 2
EMBEDDING = 12
HIDDEN = 24
ROUNDS = 2
SHARD_WORDS = 2_000_000
WORDS_A_WEIGHT = 16
BATCH = 1024               # positions of a training step
BLOCK = 1 << 13            # positions scored at once
RATE = 0.07
LARGEST = 60.0              # logits are held within it
CHUNK = 1 << 9             # weights that are summed as one row
SEED = 3
COUNTED_WORDS = 4_000_000  # counts that a task holds before it adds them up
PAD = 0                    # token 0 stands for the ends of a text and is never predicted


@functools.cache
def one_thread() -> None:
    """Products of small matrices gain nothing from a second thread, which would spin."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        found = getattr(ctypes.CDLL(path), "scipy_openblas_set_num_threads64_", None)
        if found:
            found(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts (A-Z in lower case), one text after the other,
    and the number of words of each.  A word's bytes are mixed in eight at a time; different
    words of up to eight bytes and equal length never share a hash."""
    raw = [t.encode().lower() for t in texts]
    data = b" ".join(raw) + b" "
    padded = np.frombuffer(data + b"\0" * 40, np.uint8)
    b = padded[:len(data)]
    solid = (b != 32) & ((b < 9) | (b > 13))
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    lanes = np.ndarray((len(data) + 32,), "<u8", padded, 0, (1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h = sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(4):
        at = np.flatnonzero(sizes > 8 * k) if k else slice(None)
        v = (h[at] ^ (lanes[starts[at] + 8 * k] & masks[np.minimum(sizes[at] - 8 * k, 8)])) * np.uint64(0x9E3779B97F4A7C15)
        h[at] = v ^ (v >> np.uint64(32))
    for i in np.flatnonzero(sizes > 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]])
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    return h, np.diff(np.searchsorted(starts, text_ends), prepend=0)


class Vocabulary:
    """Numbers from 1: first the frequent words (given by their hashes, most frequent first),
    then the shared hash tokens."""

    def __init__(self, hashes: np.ndarray):
        hashes = np.asarray(hashes, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.words = len(hashes)
        self.shared = max(64, self.words // 3)

    @property
    def size(self) -> int:
        return self.words + self.shared

    def tokens(self, texts: list[str]) -> list[np.ndarray]:
        """The tokens of each text."""
        h, counts = word_hashes(texts)
        out = (1 + self.words + h % np.uint64(self.shared)).astype(np.int32)
        if self.words:
            at = np.minimum(np.searchsorted(self.hashes, h), self.words - 1)
            known = self.hashes[at] == h
            out[known] = 1 + self.order[at[known]]
        return np.split(out, np.cumsum(counts)[:-1]) if len(counts) else []


def _sums(numbers: np.ndarray, values: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers (ascending) and the sums of their rows of values."""
    order = np.argsort(numbers.astype(np.uint16) if largest < 1 << 16 else numbers, kind="stable")
    numbers = numbers[order]
    first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
    return numbers[first], np.add.reduceat(values[order], first, axis=0)


class Network:
    """Weights, conditional log-probabilities, and training steps by Adagrad.

    Token t has the digits a, b, c of t - 1 to the base ``m``.  One matrix gives the logits of
    all three steps; the biases of a step depend on the digits before it."""

    def __init__(self, size: int, flat: np.ndarray | None = None):
        self.size = size
        self.m = m = max(2, math.ceil(round(size ** (1 / 3), 6)))
        self.tops = tops = -(-size // (m * m))
        self.cuts = (0, tops, tops + m, tops + 2 * m)
        self.shapes = {"embed": (size + 1, EMBEDDING), "w1": (2 * CONTEXT * EMBEDDING, HIDDEN), "b1": (HIDDEN,),
                       "out": (HIDDEN, tops + 2 * m), "c0": (1, tops), "c1": (tops, m), "c2": (tops * m, m)}
        rng = np.random.default_rng(SEED)
        self.w = {k: (rng.standard_normal(s) * (0.1 if k == "embed" else 1 / np.sqrt(s[0]) if k in ("w1", "out") else 0)).astype(np.float32)
                  for k, s in self.shapes.items()}
        # places that stand for no token
        self.w["c2"].ravel()[size:] = -LARGEST
        self.w["c1"].ravel()[-(-size // m):] = -LARGEST
        if flat is not None:
            at = 0
            for k, s in self.shapes.items():
                self.w[k] = flat[at:at + int(np.prod(s))].reshape(s).astype(np.float32)
                at += int(np.prod(s))
        self.seen = {k: np.full(s, 1e-4, np.float32) for k, s in self.shapes.items()}

    @property
    def weights(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.shapes])

    def _forward(self, context: np.ndarray, token: np.ndarray):
        w, m, cuts = self.w, self.m, self.cuts
        x = w["embed"][context].reshape(len(token), -1)
        h = np.tanh(x @ w["w1"] + w["b1"])
        number = token - 1
        before = (np.zeros_like(number), number // (m * m), number // m)           # what the biases of a step depend on
        places = (before[1], before[2] % m + cuts[1], number % m + cuts[2])
        z = h @ w["out"]
        for k in range(3):
            z[:, cuts[k]:cuts[k + 1]] += w["c0"] if k == 0 else w[f"c{k}"][before[k]]
        np.clip(z, -LARGEST, LARGEST, out=z)
        return x, h, before, places, z

    def _odds(self, z: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """exp(z), in place, and its sums for each step."""
        e = np.exp(z, out=z)
        return e, [e[:, a:b].sum(1, keepdims=True) for a, b in zip(self.cuts, self.cuts[1:])]

    def log_probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        *_, places, z = self._forward(context, token)
        at = np.arange(len(token))
        chosen = sum(z[at, p].astype(np.float64) for p in places)
        return chosen - sum(np.log(t[:, 0].astype(np.float64)) for t in self._odds(z)[1])

    def gradients(self, context: np.ndarray, token: np.ndarray) -> dict[str, tuple]:
        """Mean gradients of the negative log-probability: for each weight matrix the rows that
        the batch touches and their gradients."""
        w, n, cuts = self.w, len(token), self.cuts
        x, h, before, places, z = self._forward(context, token)
        d, totals = self._odds(z)
        at = np.arange(n)
        for k in range(3):
            d[:, cuts[k]:cuts[k + 1]] *= 1 / (n * totals[k])
            d[at, places[k]] -= 1 / n
        d_hidden = (d @ w["out"].T) * (1 - h * h)
        d_x = (d_hidden @ w["w1"].T).reshape(-1, EMBEDDING)
        every = slice(None)
        return {"embed": _sums(context.ravel(), d_x, self.size), "w1": (every, x.T @ d_hidden), "b1": (every, d_hidden.sum(0)),
                "out": (every, h.T @ d), "c0": (every, d[:, :cuts[1]].sum(0, keepdims=True)),
                "c1": _sums(before[1], d[:, cuts[1]:cuts[2]], self.size), "c2": _sums(before[2], d[:, cuts[2]:], self.size)}

    def step(self, context: np.ndarray, token: np.ndarray) -> None:
        for k, (rows, g) in self.gradients(context, token).items():
            seen = self.seen[k][rows] + g * g
            self.seen[k][rows] = seen
            self.w[k][rows] -= RATE * g / np.sqrt(seen)


def positions(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of some texts in a row with padding between them, and the places of
    the tokens in that row."""
    pad = np.full(CONTEXT, PAD, np.int32)
    row = np.concatenate([pad, *(x for t in tokens for x in (t, pad))])
    return row, np.flatnonzero(row != PAD)


def targets(at: np.ndarray, sizes: list[int], turn: int, rounds: int) -> np.ndarray:
    """The places a pass trains on: every ``rounds``-th token of each text, counted in the
    text itself, so that they do not depend on how texts are put in a row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    inside = np.arange(len(at)) - np.repeat(ends - sizes, sizes)
    return at[inside % rounds == turn]


def contexts(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    offsets = [k for k in range(-CONTEXT, CONTEXT + 1) if k]
    return row[at[:, None] + np.array(offsets)]


def score_tokens(network: Network, tokens: list[np.ndarray]) -> list[float]:
    """Summed conditional log-probability of each text."""
    row, at = positions(tokens)
    logs = np.concatenate([np.zeros(0), *(network.log_probability(contexts(row, at[k:k + BLOCK]), row[at[k:k + BLOCK]])
                                          for k in range(0, len(at), BLOCK))])
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    return np.bincount(owner, logs, len(tokens)).tolist()


def _add_up(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, counts, held = [], [], 0

    def flush() -> pa.RecordBatch:
        h, n = _add_up(hashes, counts) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        hashes.clear(), counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    for part in text_slices(batches):
        h, n = np.unique(word_hashes(part.column("text").to_pylist())[0], return_counts=True)
        hashes.append(h)
        counts.append(n)
        held += len(h)
        if held > COUNTED_WORDS:
            yield flush()
            held = 0
    yield flush()


def frequent_words(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of the words of all texts that are frequent enough, most frequent first (equally
    frequent ones by hash), and the number of words.  At most n ** (1 - RARITY) come to the
    driver."""
    counts = materialize(texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, math.ceil(total ** RARITY))
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").select("word").toArrow().column("word").to_numpy()
    discard(counts)
    return found.view(np.uint64), total


def to_tokens(base: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, key, tokens): the tokens of each text as little-endian 32-bit integers; ``key`` is
    a hash of id and text."""
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            tokens = [t.tobytes() for t in vocabulary.tokens(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(tokens, pa.binary())], names=["id", "key", "tokens"])
    return materialize(base.withColumn("key", F.xxhash64("id", "text")).mapInArrow(run, f"id {id_type}, key long, tokens binary"))


def _unpacked(part: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i4") for x in part.column("tokens").to_pylist()]


def train(tokens: DataFrame, size: int, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` passes, averaged over the shards.  ``tokens``: (key, tokens)."""
    first = Network(size)
    flat = first.flat()
    shards = max(1, -(-words // max(SHARD_WORDS, WORDS_A_WEIGHT * first.weights)))
    for turn in range(rounds):
        start = flat

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            one_thread()
            network, n = Network(size, start), 0
            for part in text_slices(batches, "tokens"):
                found = _unpacked(part)
                row, at = positions(found)
                at = np.random.default_rng(len(at)).permutation(targets(at, [len(t) for t in found], turn, rounds))
                for k in range(0, len(at), BATCH):
                    network.step(contexts(row, at[k:k + BATCH]), row[at[k:k + BATCH]])
                n += len(at)
            if n:
                values = network.flat().astype(np.float64) * n
                chunks = [values[k:k + CHUNK].tobytes() for k in range(0, len(values), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary()),
                                                  pa.array(np.full(len(chunks), float(n)))], names=["chunk", "total", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[int, list] = {}
            for b in batches:
                for chunk, total, n in zip(b.column("chunk").to_pylist(), b.column("total").to_pylist(), b.column("n").to_pylist()):
                    entry = acc.setdefault(chunk, [0.0, 0.0])
                    entry[0] = entry[0] + np.frombuffer(total, np.float64)
                    entry[1] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([(t / n).tobytes() for t, n in acc.values()], pa.binary())],
                                             names=["chunk", "mean"])

        dealt = tokens.select("key", "tokens").repartition(shards, "key").sortWithinPartitions("key", "tokens")
        learned = dealt.select("tokens").mapInArrow(learn, "chunk int, total binary, n double")
        found = learned.repartition("chunk").mapInArrow(add, "chunk int, mean binary").collect()                 # each weight once
        if found:
            flat = np.concatenate([np.frombuffer(r["mean"], np.float64) for r in sorted(found, key=lambda r: r["chunk"])])
    return flat


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``log_likelihood`` (the sum) and
    ``mean_log_likelihood``."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found, words = frequent_words(base.select("text"))
    vocabulary = Vocabulary(found)
    tokens, size = to_tokens(base, vocabulary), vocabulary.size
    flat = train(tokens, size, words, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        network = Network(size, flat)
        for part in text_slices(batches, "tokens"):
            mine = _unpacked(part)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t) for t in mine], pa.int64()), pa.array(score_tokens(network, mine), pa.float64())],
                                             names=["id", "n_tokens", "log_likelihood"])

    id_type = base.schema["id"].dataType.simpleString()
    out = tokens.select("id", "tokens").mapInArrow(score, f"id {id_type}, n_tokens long, log_likelihood double")
    mean = F.try_divide(F.col("log_likelihood"), F.col("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))
