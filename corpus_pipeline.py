"""From raw documents to token ids: language, exact copies, near copies, mix of sources, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and gets what its predecessor kept, read back from Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query, table
from glyphray.llm import bpe, exact_dedup, langid, mixing, ngram_join
from glyphray.llm.store import stored

# Below this probability, the words of a text speak for other languages than the one that labels most of them.
MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: rejects texts without letters and those whose words fit no one language."""
    others = [c for c in docs.columns if c != "text"]
    labelled = langid.predict(docs.select(F.struct(*others).alias("row"), "text"), langid.train(docs))
    fits = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return labelled.filter(fits).select(*[F.col("text" if c == "text" else f"row.{c}") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return ngram_join.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document may come up to three times."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with hashes of them and of the text they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("mixing", mix),
    ("byte_bpe", encode),
]

# A trained classifier and a tokenizer can't be written in SQL: a test runs all stages against plain versions.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
