"""Records -> cell table, and every roll-up of it.

``cell_counts`` is the only operator that touches records: one ``groupBy``
with partial (map-side) aggregation, so a hot cell costs one row per task
before the shuffle.  Out-of-domain values become NULL first; the three
denominators of the reference are then applied per roll-up:

* marginals over all rows (``compute_marginals``),
* marginals over in-domain rows of the attribute (``_get_distribution``),
* joints over rows in-domain on every listed attribute (listwise).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popweave.domain import Domain, domain_df, domain_grid, in_domain, null_out_of_domain


def cell_counts(df: DataFrame, attrs: Sequence[str], domain: Domain | None = None, *,
                by: Sequence[str] = (), weight_col: str | None = None, name: str = "n") -> DataFrame:
    """``(by..., attrs..., n BIGINT)``; with ``domain``, out-of-domain -> NULL."""
    cols = [null_out_of_domain(a, domain[a]) if domain is not None and a in domain else F.col(a)
            for a in attrs]
    extra = [F.col(weight_col)] if weight_col else []
    agg = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    return df.select(*by, *cols, *extra).groupBy(*by, *attrs).agg(agg.alias(name))


def latest_wave(df: DataFrame, year_col: str = "year") -> DataFrame:
    """Rows of the most recent year; all rows when there is no year column.

    The max is a scalar subquery (one tiny aggregate), not a window.
    """
    if year_col not in df.columns:
        return df
    top = df.agg(F.max(year_col)).scalar()
    return df.where(F.col(year_col) == top)


def domain_filter(df: DataFrame, attrs: Sequence[str], domain: Domain) -> DataFrame:
    """Keep rows whose every attribute (as a string) is in its closed domain."""
    cond = F.lit(True)
    for a in attrs:
        cond = cond & in_domain(F.col(a).cast("string"), domain[a])
    return df.where(cond)


def attribute_projection(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Attributes that exist, in ``attrs`` order (year and extras dropped)."""
    return df.select(*[a for a in attrs if a in df.columns])


def stringify(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols else df.columns
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols])


# ---------------------------------------------------------------- marginals

def _unpivot(cells: DataFrame, attrs: Sequence[str], by: Sequence[str], n: str) -> DataFrame:
    kv = F.explode(F.array(*[
        F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("cat"), F.col(n).alias("n"))
        for a in attrs]))
    return cells.select(*by, kv.alias("kv")).select(*by, "kv.attr", "kv.cat", "kv.n")


def _domain_literal(attrs: Sequence[str], domain: Domain) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("attr"), F.lit(i).alias("ord"), F.lit(c).alias("cat"))
                     for a in attrs for i, c in enumerate(domain[a])])


def _join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Left join on group columns, which may be NULL (a NULL group is a group), and on ``keys``."""
    names = [*by, *keys]
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    for c in keys:
        cond = cond & (F.col(c) == F.col(f"_r_{c}"))
    return left.join(other, cond, "left").drop(*[f"_r_{c}" for c in names])


def marginals(cells: DataFrame, attrs: Sequence[str], domain: Domain, *, by: Sequence[str] = (),
              denominator: str = "all_rows", n: str = "n") -> DataFrame:
    """Dense marginals ``(by..., attr, ord, cat, n, prop)``.

    ``denominator='all_rows'``: every row of the group (null and
    out-of-domain lower the shares; null share when the group is empty).
    ``'in_domain'``: rows in-domain for that attribute (zeros when none).
    """
    long = _unpivot(cells, attrs, by, n).groupBy(*by, "attr", "cat").agg(F.sum("n").alias("n"))
    if by:
        groups = cells.select(*by).distinct()
        dense = groups.select(*by, F.explode(_domain_literal(attrs, domain)).alias("d")) \
                      .select(*by, "d.attr", "d.ord", "d.cat")
    else:
        dense = F.broadcast(domain_df(cells.sparkSession, attrs, domain))
    out = _join_groups(dense, long, by, ["attr", "cat"]) \
        .select(*by, "attr", "ord", "cat", F.coalesce(F.col("n"), F.lit(0)).alias("n"))
    if denominator == "in_domain":
        total = F.sum("n").over(Window.partitionBy(*by, "attr"))
        prop = F.coalesce(F.try_divide(F.col("n").cast("double"), total.cast("double")), F.lit(0.0))
        return out.withColumn("prop", prop)
    if denominator != "all_rows":
        raise ValueError(f"unknown denominator {denominator!r}")
    if by:
        out = _join_groups(out, cells.groupBy(*by).agg(F.sum(n).alias("_total")), by, [])
        total = F.col("_total")
    else:
        total = cells.agg(F.sum(n)).scalar()
    return out.withColumn("prop", F.try_divide(F.col("n").cast("double"), total.cast("double"))) \
              .drop("_total")


# ------------------------------------------------------------------- joints

def joint(cells: DataFrame, attrs: Sequence[str], domain: Domain | None = None, *,
          dense: bool = False, n: str = "n") -> DataFrame:
    """k-way joint ``(attrs..., n, p)`` over rows in-domain on all ``attrs``.

    Sparse by default (absent cell = 0); ``dense`` fills the product grid.
    """
    present = F.lit(True)
    for a in attrs:
        present = present & F.col(a).isNotNull()
    sub = cells.where(present).groupBy(*attrs).agg(F.sum(n).alias("n"))
    if dense:
        if domain is None:
            raise ValueError("dense joint needs a domain")
        grid = domain_grid(cells.sparkSession, attrs, domain, index_col=None)
        sub = grid.join(sub, list(attrs), "left").select(
            *attrs, F.coalesce(F.col("n"), F.lit(0)).alias("n"))
    total = cells.where(present).agg(F.sum(n)).scalar()
    p = F.coalesce(F.try_divide(F.col("n").cast("double"), total.cast("double")), F.lit(0.0))
    return sub.withColumn("p", p)


def attribute_pairs(attrs: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(attrs, 2))


def pair_sums(cells: DataFrame, attrs: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """All two-way tables in one aggregation with grouping sets: ``(a1, a2, v1, v2, sums...)``.

    Rows with a null value in a pair take no part in it; which attributes a
    row was grouped by is read from its grouping id, so such nulls are told
    from the attributes that are not in the set.
    """
    named = [f"_v{i}" for i in range(len(attrs))]
    text = cells.select(*[F.col(a).cast("string").alias(v) for a, v in zip(attrs, named)], *sums)
    sets = list(combinations(range(len(attrs)), 2))
    grouped = text.groupingSets([[F.col(named[i]) for i in pair] for pair in sets], *named).agg(
        F.grouping_id().alias("_set"), *[F.sum(s).alias(s) for s in sums])
    #: The grouping id has a bit for each column that is not in the set, the first column's the highest.
    ids = {sum(1 << (len(attrs) - 1 - k) for k in range(len(attrs)) if k not in pair): pair for pair in sets}
    which = lambda pick: F.coalesce(*[F.when(F.col("_set") == i, pick(pair)) for i, pair in ids.items()])
    return grouped.select(
        which(lambda p: F.lit(attrs[p[0]])).alias("a1"), which(lambda p: F.lit(attrs[p[1]])).alias("a2"),
        which(lambda p: F.col(named[p[0]])).alias("v1"), which(lambda p: F.col(named[p[1]])).alias("v2"), *sums,
    ).where(F.col("v1").isNotNull() & F.col("v2").isNotNull())


def pairwise_counts(cells: DataFrame, attrs: Sequence[str], n: str = "n") -> DataFrame:
    """All two-way tables in one pass: ``(a1, a2, v1, v2, n)``."""
    return pair_sums(cells, attrs, [n]).withColumnRenamed(n, "n")


def attribute_pair_df(spark, attrs: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(attribute_pairs(attrs), "a1 string, a2 string")


def pairwise_joint(cells: DataFrame, attrs: Sequence[str], domain: Domain, n: str = "n") -> DataFrame:
    """Dense two-way joints ``(a1, a2, v1, v2, n, p)`` for every attribute pair."""
    spark = cells.sparkSession
    counts = pairwise_counts(cells, attrs, n)
    cats = domain_df(spark, attrs, domain)
    side = lambda a, v: F.broadcast(cats.select(F.col("attr").alias(a), F.col("cat").alias(v)))
    dense = attribute_pair_df(spark, attrs).join(side("a1", "v1"), "a1").join(side("a2", "v2"), "a2")
    out = dense.join(counts, ["a1", "a2", "v1", "v2"], "left") \
        .select("a1", "a2", "v1", "v2", F.coalesce(F.col("n"), F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("a1", "a2"))
    p = F.coalesce(F.try_divide(F.col("n").cast("double"), total.cast("double")), F.lit(0.0))
    return out.withColumn("p", p)
