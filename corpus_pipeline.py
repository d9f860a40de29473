"""Corpus pipeline: filter, deduplicate and pack ``documents``.

``STAGES`` lists (name, function) in order; each function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs.  All but the last return the columns of ``documents``.
The classifiers learn from the stage's own documents: toxicity from
``labels``, language from their ``lang`` column.  A null or empty text passes the toxicity
stage on its score and is dropped by the language stage as a text without a letter.

``ORACLE_SQL`` is None, as SQL can express neither the classifiers nor the
tokenizer; the tests compare the stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import language_id, minhash, packing, superkmer, toxicity
from panelcast.llm.common import table, written

ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.keep(docs, toxicity.fit(docs, labels, "toxic", F.lit(True)))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject."""
    return language_id.keep(docs, language_id.fit(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of every group of near duplicates."""
    return minhash.keep(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeated 35-word windows cover."""
    return (superkmer.deduplicate(docs).drop("n_words", "n_removed")
            .withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 2048 ids."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False,
                                       ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
