"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.session import discard, stash

__all__ = ["WHITE", "discard", "normal_space", "stash", "table", "unpack", "whole_row"]

#: ASCII white space: tab, line feed, vertical tab, form feed, return, space.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_space(text: Column) -> Column:
    """Null becomes empty, each run of ASCII white space one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that working columns never clash with its own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpack(df: DataFrame, row: str, like: DataFrame) -> DataFrame:
    """The inverse of ``whole_row``."""
    return df.select(*[F.col(row).getField(c).alias(c) for c in like.columns])
