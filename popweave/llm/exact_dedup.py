"""Exact dedup by content sort (DataFrame functions only).

Sampled splitters range-partition the normalised texts (Spark's range
exchange, on a 64-character prefix and a hash of the rest, so that the sample
that the driver sees stays small however long the texts are); the external
sort inside a partition puts equal texts side by side, where a window compares
neighbours on their full bytes and retains the smallest identifier.

A text that a bounded row sample shows to be frequent is dealt over several
sub-groups by a salt.  Its total comes from one map-side combined aggregation
of those rows alone, so no task holds a large group of copies; the result does
not depend on what the sample finds.

Edge cases: null and empty texts are equal to each other; a null identifier
sorts after all others; of repeated rows (same identifier and text) exactly one
is kept; an empty table gives an empty result; other columns of the input,
whatever their names, are carried through untouched by ``dedup_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popweave.llm.common import normal_space, stash, table, whole_row

SAMPLE_ROWS = 20_000
HOT_SHARE = 0.001
PREFIX_CHARS = 64


def _keys(text: Column) -> list[Column]:
    norm = normal_space(text)
    return [F.substring(norm, 1, PREFIX_CHARS).alias("_p"), F.xxhash64(norm).alias("_h")]


def hot_texts(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, hot_share: float = HOT_SHARE) -> DataFrame:
    """Hashes of texts that hold ``hot_share`` of a row sample, with the number of sub-groups to deal them into.

    At most ``1 / hot_share`` rows.
    """
    n = rows.count()
    sample = rows.sample(min(1.0, sample_rows / max(n, 1)), seed=11) if n > sample_rows else rows
    least = max(8.0, hot_share * min(n, sample_rows))
    return (
        sample.groupBy(F.xxhash64(normal_space(F.col("_text"))).alias("_h")).count()
        .where(F.col("count") >= least)
        .select("_h", F.ceil(F.col("count") / F.lit(least)).cast("int").alias("_parts"))
    )


def _decide(rows: DataFrame) -> DataFrame:
    """rows: ``_id``, ``_text`` and any payload; adds ``_norm``, ``_keep``, ``_size``, ``_kept``."""
    hot = stash(hot_texts(rows.select("_text")), "hot-texts")
    keyed = rows.select("*", *_keys(F.col("_text"))).join(F.broadcast(hot), "_h", "left")
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(F.col("_id"), F.lit(3)), F.col("_parts"))).otherwise(0)
    dealt = (
        keyed.withColumn("_salt", salt.cast("int"))
        .repartitionByRange("_p", "_h", "_salt")
        .withColumn("_norm", normal_space(F.col("_text")))
    )
    group = Window.partitionBy("_p", "_h", "_salt", "_norm")
    order = group.orderBy(F.col("_id").asc_nulls_last())
    near = dealt.select(
        "*",
        F.first("_id").over(order).alias("_near_keep"),
        F.row_number().over(order).alias("_near_rank"),
        F.count(F.lit(1)).over(group).alias("_near_size"),
    )
    # Totals of the dealt groups; a text is told apart by its SHA-256 here, as in the output.
    totals = (
        rows.select("_id", normal_space(F.col("_text")).alias("_norm"))
        .withColumn("_h", F.xxhash64("_norm"))
        .join(F.broadcast(hot), "_h")
        .groupBy(F.sha2("_norm", 256).alias("_sha"))
        .agg(F.min("_id").alias("_all_keep"), F.count(F.lit(1)).alias("_all_size"),
             F.min(F.when(F.col("_id").isNull(), 1).otherwise(0)).alias("_no_id"))
    )
    out = near.withColumn("_sha", F.sha2("_norm", 256)).join(F.broadcast(totals), "_sha", "left")
    dealt_group = F.col("_all_size").isNotNull()
    first = F.col("_near_rank") == 1
    return out.select(
        *rows.columns, "_sha",
        F.when(dealt_group, F.col("_all_keep")).otherwise(F.col("_near_keep")).alias("_keep"),
        F.when(dealt_group, F.col("_all_size")).otherwise(F.col("_near_size")).alias("_size"),
        # One identifier always gets the same salt, so rank 1 is unique among its repeated rows.
        F.when(dealt_group, first & F.col("_id").eqNullSafe(F.col("_all_keep"))).otherwise(first).alias("_kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return _decide(rows).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    others = docs.drop(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"),
                       whole_row(others).alias("_row"))
    kept = _decide(rows).where("_kept")
    return kept.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c)
                         for c in docs.columns])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {"op4_exact_dedup": ORACLE}
