"""Structured Streaming validation of generated text.

Parsing, fuzzy repair and the structural-zero rules are row-local, so the
batch ``validate_generated`` projection runs unchanged on a stream: texts
arrive as files (or any source), accepted records go to a Parquet sink and
rejection counts to a second, aggregated sink.  Checkpoints live in the
shared checkpoint folder, so a restarted query resumes exactly once.
The accept-until-n cut and raking are batch steps on the collected pool.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from popweave.operators.validate import validate_generated

TEXT_SCHEMA = "batch BIGINT, pos INT, text STRING"


def read_generated(spark: SparkSession, src_dir: str, fmt: str = "parquet", schema: str = TEXT_SCHEMA,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(src_dir)


def validated_stream(texts: DataFrame, *, attrs: Sequence[str] | None = None,
                     domain: Mapping[str, Sequence[str]] | None = None, keep: Sequence[str] = ("batch", "pos")) -> DataFrame:
    """The batch validation projection applied to a streaming DataFrame."""
    return validate_generated(texts, keep=list(keep), attrs=attrs, domain=domain)


def start_accepted_sink(validated: DataFrame, out_dir: str, checkpoint_dir: str,
                        trigger_once: bool = True) -> StreamingQuery:
    """Append accepted records to Parquet (exactly-once via the checkpoint)."""
    acc = validated.where(F.col("reject_reason").isNull()).drop("reject_reason")
    w = acc.writeStream.format("parquet").option("path", out_dir) \
        .option("checkpointLocation", checkpoint_dir).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def start_reason_counts(validated: DataFrame, query_name: str, checkpoint_dir: str) -> StreamingQuery:
    """Running ``(reason, n)`` counts (complete mode; state is one row per reason)."""
    counts = validated.groupBy(F.coalesce(F.col("reject_reason"), F.lit("accepted")).alias("reason")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return (counts.writeStream.format("memory").queryName(query_name).outputMode("complete")
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
