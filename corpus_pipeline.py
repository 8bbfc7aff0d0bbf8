"""Corpus pipeline: five stages from ``documents`` to piece ids.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which ``run`` writes as Parquet under
``spark.checkpoint.dir`` and reads again as the next stage's ``docs``.  All but
the last return the columns of ``docs``.

1. quality: the factorisation machine scores every document; those below its
   threshold go.
2. exact dedup: of equal texts the row with the smallest identifier stays.
3. near dedup: n-gram Jaccard join on five-word shingles at 0.8; one document
   of each component stays, the one with the smallest identifier.
4. mixing: Poisson replication to damped source weights, globally shuffled.
5. encoding: ids of every text, and whether they decode to it.

Nulls in any column, empty and very long texts, repeated rows and empty tables
pass through every stage as the operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.llm import exact_dedup, jaccard_join, mixing, pieces, quality
from popweave.llm.common import stash, table

NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the whole ``documents`` table and scores ``docs``."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality.score_rows(docs, model, score_col="_score_")
    return scored.where(F.col("_score_") >= quality.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, copy_col=None, key_col=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids, round_trip``, one row for each copy."""
    return pieces.encoded_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: A trained classifier and piece ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
