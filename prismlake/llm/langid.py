"""Language identification, words first, with backoff to character n-grams.

A known word adds the log frequency it has in each language.  A word that training did
not see is scored by its longest known character n-grams: those of ``MAX_GRAM``
characters if any is known, else the next shorter ones, down to single characters.  The
sums over all words of a document give the language and its posterior probability.

The classifier is fitted on a bounded sample of labelled rows: about
``SAMPLE_PER_LANGUAGE`` documents of each language, drawn by a hash of the row (all, if
there are fewer); it keeps every language, and every word and n-gram
of the sample, as 64-bit hashes with the log frequencies in the languages that have it.
Every document is scored whole.

Edge cases: a null or empty text, or one without a letter, is ``und`` with score 0; so is every
text if nothing could be learned; a text of which nothing is known gets the most
frequent language with an even score; ties go to the language that comes first by
frequency, then name; rows with a null language or id are not learned from; repeated rows
each give a row; only the named columns are read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismlake.llm.common import text_slices

SAMPLE_PER_LANGUAGE = 4000
MAX_GRAM = 4
SMOOTHING = 0.5
CACHE_WORDS = 50_000
NEW_WORDS = 4096           # words that are looked up at once
HASH_SEED = 42             # of Spark's xxhash64
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked (single characters: without)."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def hashes_of(items: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x.encode(), HASH_SEED) for x in items), np.uint64, len(items)).view(np.int64)


@dataclass
class Index:
    """Rows of items in the table, found by the items' hashes (sorted)."""

    keys: np.ndarray
    first: int                                 # row of the first key

    def find(self, items: list[str]) -> np.ndarray:
        """The row of each item, -1 if it is not known."""
        hashes = hashes_of(items)
        if not len(self.keys):
            return np.full(len(items), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at + self.first, -1)

    def __len__(self) -> int:
        return len(self.keys)

    def __contains__(self, item: str) -> bool:
        return self.find([item])[0] >= 0

    def __getitem__(self, item: str) -> int:
        row = int(self.find([item])[0])
        if row < 0:
            raise KeyError(item)
        return row


@dataclass
class Table:
    """Log frequency by item and language.  Languages that do not have an item share the
    value ``base`` of its kind (words, or n-grams of a length); only the others are kept."""

    base: np.ndarray                           # by kind and language
    kind: np.ndarray                           # of each row
    edges: np.ndarray                          # the entries of row r are edges[r] to edges[r + 1]
    langs: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.kind)

    def __getitem__(self, rows) -> np.ndarray:
        rows = np.asarray(rows, np.int64)
        out = self.base[self.kind[rows]]
        sizes = self.edges[rows + 1] - self.edges[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.edges[rows][owner]
        out[owner, self.langs[at]] = self.values[at]
        return out


@dataclass
class Model:
    languages: list[str]
    words: Index
    grams: Index
    table: Table
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def rows(self, words: list[str]) -> np.ndarray:
        """Log frequencies by word and language; of a word not seen, by its n-grams."""
        at = self.words.find(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        out[at >= 0] = self.table[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(MAX_GRAM, 0, -1):
            lists = [grams_of(words[i], n) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(x) for x in lists])
            found = self.grams.find([g for x in lists for g in x])
            owner, found = owner[found >= 0], found[found >= 0]
            if len(found):
                some, starts, counts = np.unique(owner, return_index=True, return_counts=True)
                out[left[some]] = np.add.reduceat(self.table[found], starts) / counts[:, None].astype(np.float32)
                left = np.delete(left, some)
        return out

    def unseen(self, word: str) -> np.ndarray:
        for n in range(MAX_GRAM, 0, -1):
            found = self.grams.find(grams_of(word, n))
            if (found >= 0).any():
                return self.table[found[found >= 0]].mean(0)
        return np.zeros(len(self.languages), np.float32)


class Scorer:
    """Scores texts; keeps the rows of words it has met (a bounded number)."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.places: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = self.model
        if not model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if len(self.places) > CACHE_WORDS:
            self._reset()
        lists = [words_of(t) if t else [] for t in texts]
        new = list(set().union(*lists) - self.places.keys())
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        self.table = np.concatenate([self.table, *(model.rows(new[k:k + NEW_WORDS]) for k in range(0, len(new), NEW_WORDS))])
        langs, scores = [], []
        for text, words in zip(texts, lists):
            if not text or not any(map(str.isalpha, text)):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = np.zeros(len(model.languages))
            for k in range(0, len(words), 1 << 16):
                total += self.table[list(map(self.places.__getitem__, words[k:k + (1 << 16)]))].sum(0, dtype=np.float64)
            best = int(total.argmax())
            langs.append(model.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores


_scorers: dict[str, Scorer] = {}


def _scorer(name: str, model) -> Scorer:
    """The worker's scorer of a broadcast model, built once per Python worker."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model.value)
    return _scorers[name]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        counts: Counter[tuple[int, str]] = Counter()
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            for word, n in Counter(words_of(text)).items():
                counts[lang, word] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], names=["lang", "item", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        counts: Counter[tuple[int, str]] = Counter()
        for lang, word, n in zip(*(part.column(c).to_pylist() for c in ("lang", "item", "n"))):
            for size in range(1, MAX_GRAM + 1):
                for gram in grams_of(word, size):
                    counts[lang, gram] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], names=["lang", "item", "n"])


def _counts(counts: DataFrame, size) -> tuple[np.ndarray, ...]:
    """Kind, hash, language and count of all items of the sample, ordered by hash."""
    columns = counts.select(size.cast("tinyint").alias("kind"), F.xxhash64("item").alias("key"), F.col("lang").cast("short").alias("lang"), "n").toArrow()
    kind, key, lang, n = (columns.column(c).to_numpy() for c in ("kind", "key", "lang", "n"))
    order = np.lexsort((lang, key))
    return kind[order], key[order], lang[order], n[order]


def _table(groups: list[tuple[np.ndarray, ...]], n_langs: int) -> tuple[list[Index], Table]:
    """An index for each group of items, and their table."""
    kind, lang, n = (np.concatenate([g[k] for g in groups]) for k in (0, 2, 3))
    starts = [np.flatnonzero(np.append(True, g[1][1:] != g[1][:-1])[:len(g[1])]) for g in groups]
    first = np.cumsum([0, *map(len, starts)])
    shift = np.cumsum([0, *(len(g[1]) for g in groups)])
    edges = np.append(np.concatenate([s + k for s, k in zip(starts, shift)]), len(n)).astype(np.int64)
    row_kind = kind[edges[:-1]]
    items = np.maximum(1, np.bincount(row_kind, minlength=MAX_GRAM + 1))
    totals = np.bincount(kind.astype(np.int64) * n_langs + lang, n, (MAX_GRAM + 1) * n_langs).reshape(MAX_GRAM + 1, n_langs)
    whole = totals + SMOOTHING * items[:, None]
    values = np.log((n + SMOOTHING) / whole[kind, lang]).astype(np.float32)
    indexes = [Index(g[1][s], int(k)) for g, s, k in zip(groups, starts, first)]
    return indexes, Table(np.log(SMOOTHING / whole).astype(np.float32), row_kind, edges, lang, values)


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on rows (text, lang) with a language; other columns are not read."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()        # one row per language
    languages = [r["lang"] for r in sizes]
    if len(languages) > 32_767:
        raise ValueError(f"{len(languages)} languages; the table numbers up to 32767")
    if not languages:
        nothing = np.zeros(0, np.int64)
        (words, grams), table = _table([(nothing,) * 4] * 2, 0)
        return Model([], words, grams, table)
    number = F.create_map(*(x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))))
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))))
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    sample = drawn.select("text", F.try_element_at(number, F.col("lang")).alias("lang"))
    counts = "lang int, item string, n long"
    words = sample.mapInArrow(_count_words, counts).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(_count_grams, counts).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    (known, parts), table = _table([_counts(words, F.lit(0)), _counts(grams, F.length("item"))], len(languages))
    return Model(languages, known, parts, table)


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = model.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared)
        for part in text_slices(batches, text_col):
            langs, scores = scorer.score(part.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*part.schema.names, *names])
    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def held_out(id_col: str = "doc_id"):
    """True for the rows that training must not see (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> Model:
    return train(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
