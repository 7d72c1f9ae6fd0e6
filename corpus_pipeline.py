"""The corpus pipeline: language ID, near-duplicates, repeated passages, personal data, packing.

``run`` applies the stages to ``documents``; each stage's result is a written table that
the next one reads.  All stages but the last return the columns of ``documents``.

* language: documents without a recognised language go (null or letterless text, or a
  best language below ``MIN_LANGUAGE_SCORE``).
* near_duplicates: one document of each SimHash component stays, that of smallest id.
* passages: words in 35-word windows that occur elsewhere are removed.  A text that loses
  nothing stays as it is; a document that loses all its words stays with an empty text.
* personal_data: spans are replaced by their kind in brackets.
* packing: token sequences of at most 2048 ids, one row per piece, with the ids.

A null text is rejected by the first stage.  Repeated rows are near-duplicates of each
other.  Columns beyond those of ``documents`` pass through.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm.common import discard, materialize, read
from prismlake.llm.langid import UNKNOWN, identify, train_on_documents
from prismlake.llm.packing import pack_documents
from prismlake.llm.pii import redact
from prismlake.llm.queries import tokenizer_path
from prismlake.llm.simhash import keep_one_per_component
from prismlake.llm.substrings import remove_repeats

MIN_LANGUAGE_SCORE = 0.4

ORACLE_SQL = None          # SimHash, BPE and the language model are beyond SQL


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text where a stage has changed it."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return docs.select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify(docs, train_on_documents(docs), names=("_lang_pred", "_lang_score"))
    return found.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_component(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeats(docs, carry=others, as_is=True).withColumnRenamed("kept", "text")
    return _with_length(out, docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), ()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        discard(*before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
