"""Scans, the train/target split and sinks.

Reads are plain ``spark.read.parquet`` so filters on ``year`` and column
selections reach the scan (``PushedFilters`` / ``ReadSchema``); with a
``year``-partitioned layout the split prunes whole directories.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.domain import ALL_YEARS, TARGET_YEAR, TRAIN_YEARS


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark reads it from."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(sc._jsc.hadoopConfiguration()).exists(folder)


def read_combined(spark: SparkSession, path: str, year_col: str = "year") -> DataFrame:
    """One all-years table; ``year`` typed as INT."""
    df = spark.read.parquet(path)
    if year_col in df.columns:
        df = df.withColumn(year_col, F.col(year_col).cast("int"))
    return df


def read_per_year(spark: SparkSession, path_for_year, years: Sequence[int] = ALL_YEARS,
                  year_col: str = "year") -> DataFrame:
    """Per-year files; ``year`` is set to the file's year (overwrites).

    ``path_for_year(y)`` gives the path of one year.  Only a missing path is
    skipped: one that exists but cannot be read raises.  None found raises
    ``FileNotFoundError``.  Each existing path is one scan; the union adds no
    shuffle.
    """
    parts = []
    for y in years:
        if not path_exists(spark, path_for_year(y)):
            continue
        df = spark.read.parquet(path_for_year(y))
        parts.append(df.withColumn(year_col, F.lit(int(y)).cast("int")))
    if not parts:
        raise FileNotFoundError("no per-year files found")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def split_train_target(df: DataFrame, train_years: Sequence[int] = TRAIN_YEARS,
                       target_year: int = TARGET_YEAR, year_col: str = "year") -> tuple[DataFrame, DataFrame]:
    """Train = year in ``train_years``; target = ``target_year``; others in neither."""
    y = F.col(year_col).cast("int")
    return df.where(y.isin(list(train_years))), df.where(y == int(target_year))


def split_labeled(df: DataFrame, train_years: Sequence[int] = TRAIN_YEARS,
                  target_year: int = TARGET_YEAR, year_col: str = "year") -> DataFrame:
    """Both splits in one pass with a ``split`` label column."""
    y = F.col(year_col).cast("int")
    label = F.when(y.isin(list(train_years)), F.lit("train")).when(y == int(target_year), F.lit("target"))
    return df.select(label.alias("split"), "*").where(F.col("split").isNotNull())


def split_counts(df: DataFrame, train_years: Sequence[int] = TRAIN_YEARS,
                 target_year: int = TARGET_YEAR, year_col: str = "year") -> DataFrame:
    """``(split, n)`` for both splits in one aggregation."""
    return split_labeled(df.select(year_col), train_years, target_year, year_col) \
        .groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Parquet sink; ``partition_by`` e.g. ``['year']`` for pruned reads later."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
