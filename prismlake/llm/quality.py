"""Quality rules: counts of a text, and the likelihood ratio of its hashed n-grams.

The rules count words, symbols, repeated lines and repeated word windows.  The method
compares two multinomials over ``BUCKETS`` hashed n-grams (single tokens and pairs; a
token is a run of letters and digits, or a run of other characters): one fitted to
trusted documents, one to the whole corpus.  A document's score is the mean log
likelihood ratio of its n-grams, and every document at or above ``THRESHOLD`` is kept.

Everything is a DataFrame expression.  Texts are read once: the counts and the buckets of a
document's n-grams (two bytes each) are written, and weights and scores come from them.
Bucket counts of all documents are summed before they are shuffled and are bounded by
``BUCKETS``, so the weights become a literal array of the scoring expression; scoring
shuffles nothing.

The trusted side is fitted on a bounded sample, ``TRUSTED_ROWS`` of the labelled rows of
good quality that are not toxic, drawn by a hash of the id.  The corpus side counts all
documents.

Edge cases: a null text has no words, so the base rules fail it; without trusted rows
all ratios are zero; a document without n-grams scores zero; rows with a null id are
counted and scored like any other; very long texts cost in proportion to their length (and
a sort of their windows where some repeat); a ratio equal to the threshold is kept, and no
other tie can occur; repeated rows each give a row; an empty table gives no rows; only the
named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.functions.arrays import let
from prismlake.llm.common import WORD_SPACE, materialize, text_or_empty

BUCKETS = 8192
TRUSTED_ROWS = 4000
SMOOTHING = 1.0
THRESHOLD = -0.4
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30

_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{WORD_SPACE}]+"), "")


def _bucket(*x: Column) -> Column:
    return F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("smallint")


def _shifted(arr: Column, by: int) -> Column:
    return F.slice(arr, F.lit(by + 1), F.greatest(F.size(arr) - by, F.lit(0)))


def with_grams(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the buckets of the tokens and token pairs of a text, each token hashed once."""
    hashed = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    df = df.withColumn("_hashed", hashed)
    pairs = F.zip_with(F.slice("_hashed", F.lit(1), F.greatest(F.size("_hashed") - 1, F.lit(0))), _shifted(F.col("_hashed"), 1), lambda a, b: _bucket(a, b))
    return df.withColumn(name, F.concat(F.transform("_hashed", lambda h: _bucket(h)), pairs)).drop("_hashed")


def with_repeated_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the number of words covered by word windows that occur twice or more (by 64-bit
    hash).  Windows of 2, 4 and 8 words are hashed from those of half their length."""
    df = df.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w)))
    for n in (1, 2, 4):                      # what is beyond the last whole window is cut off below
        df = df.withColumn(f"_h{2 * n}", F.zip_with(f"_h{n}", _shifted(F.col(f"_h{n}"), n), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_windows", F.slice(f"_h{WINDOW}", F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(0))))

    def covered(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(ordered, lambda x, i: (same(x, i - 1) & (i > 0)) | same(x, i + 1)), lambda x: x["i"]))
        return F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, s: F.struct(
            s.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n")))["n"]

    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    count = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), let(F.array_sort(placed), covered)).otherwise(F.lit(0).cast("long"))
    return df.withColumn(name, count).drop("_h1", "_h2", "_h4", "_h8", "_windows")


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts of the base rules and ``_grams``, the buckets of the n-grams."""
    df = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_words", words_of(F.col("_text")))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    df = with_grams(with_repeated_words(df.withColumn("_lines", lines), "_words", "_repeated"), "_text", "_grams")
    return df.select(
        F.col("_id").alias(id_col), "_grams", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_repeated").alias("n_repeat_words"))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``rows`` ids of good, non-toxic labelled documents, lowest hash first."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def gram_weights(counted: DataFrame, trusted: DataFrame, id_col: str = "doc_id") -> list[float]:
    """Log ratio of each bucket's frequency in trusted and in all documents."""
    marks = F.broadcast(trusted.select(F.col("doc_id").alias("_trusted")))       # at most TRUSTED_ROWS ids
    grams = (counted.select(id_col, "_grams").join(marks, F.col(id_col) == F.col("_trusted"), "left")
             .select(F.col("_trusted").isNotNull().alias("good"), F.explode("_grams").alias("bucket")))
    rows = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good")).collect()   # BUCKETS rows at most
    corpus, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        corpus[r["bucket"]], target[r["bucket"]] = r["n"], r["good"]
    if not sum(target):
        return [0.0] * BUCKETS
    whole, good = sum(corpus) + SMOOTHING * BUCKETS, sum(target) + SMOOTHING * BUCKETS
    return [math.log((t + SMOOTHING) / good) - math.log((c + SMOOTHING) / whole) for t, c in zip(target, corpus)]


def ratio_score(grams: str, weights: list[float]) -> Column:
    """Mean weight of the n-grams of a text (0 if it has none)."""
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(table, b.cast("int")))
    return F.coalesce(F.try_divide(total, F.size(grams)), F.lit(0.0))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, the counts, ``base_failed``, ``ratio`` and ``kept``."""
    counted = materialize(text_counts(docs, id_col, text_col))
    weights = gram_weights(counted, trusted_ids(labels), id_col)
    df = counted.withColumn("ratio", ratio_score("_grams", weights)).drop("_grams")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
