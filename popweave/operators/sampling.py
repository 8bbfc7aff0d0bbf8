"""Seeded sampling on cell tables, distributed end to end.

* ``intervals``: cumulative mass per row as ``[cum_lo, cum_hi)``, in key
  order at every size.  A small table (measured) uses one ordered window; a
  larger one range-partitioned blocks of bounded size, in the same order, each
  with its own window and an offset from a prefix sum over the blocks.  A
  row's lower edge *is* the upper edge of the row before it, so floating-point
  masses leave neither gaps nor overlaps.
* ``range_join``: points -> the interval containing them, as a bucketed
  equi-join plus a range filter.  There are as many buckets as intervals;
  intervals are exploded only to the buckets they overlap (<= rows + buckets),
  so a heavy interval spreads over many buckets instead of one task.
* Draws come from ``spark.range(m)`` with ``u = hash_uniform(seed, i)``:
  evenly partitioned, reproducible, independent of partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popweave.functions.hashing import hash_uniform
from popweave.session import stash

SMALL_TABLE_ROWS = 1_000_000     # single ordered window allowed up to this
BLOCK_ROWS = 500_000             # rows of a block of the prefix sum
BROADCAST_BYTES = 64 << 20       # measured size up to which intervals are broadcast
ROW_BYTES = 48                   # besides the key's text: two edges, a bucket, row overhead
TOPK_LIMIT = 1_000_000           # exact subsample via TakeOrdered below this
ROWS_PER_RANGE_PARTITION = 4_000_000
EDGE_BUCKETS = 1 << 16


def index_range(spark, m: int) -> DataFrame:
    """``spark.range(m)`` with a partition count that grows with m."""
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(m / ROWS_PER_RANGE_PARTITION))
    return spark.range(0, m, 1, parts)


def measured(df: DataFrame, cols: Sequence[str]) -> tuple[int, int]:
    """Rows, and bytes of their ``cols`` as text plus the fixed part of a row."""
    rows, text = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*cols))))).first()
    return rows, (text or 0) + rows * ROW_BYTES


def row_key(cols: Sequence[str]) -> Column:
    """A narrow key of a whole row: the MD5 of its JSON."""
    return F.md5(F.to_json(F.struct(*cols)))


def intervals(df: DataFrame, mass_col: str, order_cols: Sequence[str], *, rows: int | None = None,
              normalize: bool = True) -> DataFrame:
    """Add ``cum_lo, cum_hi`` (and ``lo, hi`` in [0,1] when ``normalize``).

    ``order_cols`` identify a row and order the intervals; ``rows`` is the
    row count where the caller has measured it.  Zero-mass rows get empty
    intervals and are never hit.
    """
    rows = df.count() if rows is None else rows
    if rows <= SMALL_TABLE_ROWS:
        order = Window.orderBy(*order_cols)
        run = df.withColumn("cum_hi", F.sum(mass_col).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        out = run.withColumn("cum_lo", F.coalesce(F.lag("cum_hi").over(order), F.lit(0)))
    else:
        n = math.ceil(rows / BLOCK_ROWS)
        # Written with its block numbers: a later re-run of the range exchange could cut elsewhere.
        b = stash(df.repartitionByRange(n, *order_cols).withColumn("_blk", F.spark_partition_id()), "prefix-blocks")
        over_blocks = Window.orderBy("_blk")  # one row a block
        totals = b.groupBy("_blk").agg(F.sum(mass_col).alias("_t"))
        offs = (totals.withColumn("_next", F.sum("_t").over(over_blocks.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("_off", F.coalesce(F.lag("_next").over(over_blocks), F.lit(0))).drop("_t"))
        order = Window.partitionBy("_blk").orderBy(*order_cols)
        run = b.join(F.broadcast(offs), "_blk").withColumn(
            "_run", F.col("_off") + F.sum(mass_col).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        last = F.lead(F.lit(1)).over(order).isNull()
        out = (run.withColumn("cum_hi", F.when(last, F.col("_next")).otherwise(F.least("_run", "_next")))
               .withColumn("cum_lo", F.coalesce(F.lag("cum_hi").over(order), F.col("_off")))
               .drop("_off", "_next", "_run", "_blk"))
    if normalize:
        total = out.agg(F.max("cum_hi")).scalar()
        out = out.withColumn("lo", F.col("cum_lo") / total).withColumn("hi", F.col("cum_hi") / total)
    return out


def range_join(points: DataFrame, point: Column, ivals: DataFrame, lo: str, hi: str, *,
               span: float, n_buckets: int, broadcast: bool) -> DataFrame:
    """Join each point p in [0, span) to the interval with ``lo <= p < hi``."""
    bucket = lambda x: F.least(F.floor(x.cast("double") / F.lit(span) * F.lit(float(n_buckets))).cast("long"),
                               F.lit(n_buckets - 1))
    b_lo, b_hi = bucket(F.col(lo)), bucket(F.col(hi))
    iv = (ivals.where(F.col(hi) > F.col(lo))
          .withColumn("_bucket", F.explode(F.sequence(b_lo, F.greatest(b_lo, b_hi)))))
    pts = points.withColumn("_p", point).withColumn("_bucket", bucket(F.col("_p")))
    side = F.broadcast(iv) if broadcast else iv
    cond = (pts["_bucket"] == side["_bucket"]) & (pts["_p"] >= side[lo]) & (pts["_p"] < side[hi])
    return pts.join(side, cond).drop("_bucket", "_p")


def draws(spark, m: int, seed: int) -> DataFrame:
    """``(draw BIGINT, u DOUBLE)`` for draws ``0..m-1``."""
    return index_range(spark, m).select(F.col("id").alias("draw"), hash_uniform(seed, F.col("id")).alias("u"))


def weighted_draws(cells: DataFrame, mass_col: str, m: int, seed: int, key_col: str, *,
                   order_cols: Sequence[str] | None = None) -> DataFrame:
    """``(draw, key_col)``: ``m`` independent draws of a row with p ∝ mass; ``order_cols`` (default: the key) order the intervals."""
    order = list(order_cols or [key_col])
    base = cells.select(*dict.fromkeys([key_col, *order, mass_col]))
    rows, size = measured(base, [key_col])
    if not rows or m <= 0:
        return base.select(F.lit(0).cast("long").alias("draw"), key_col).limit(0)
    iv = intervals(base, mass_col, order, rows=rows)
    return range_join(draws(cells.sparkSession, m, seed), F.col("u"), iv.select(key_col, "lo", "hi"), "lo", "hi", span=1.0,
                      n_buckets=rows, broadcast=size <= BROADCAST_BYTES).select("draw", key_col)


def weighted_hits(cells: DataFrame, mass_col: str, m: int, seed: int, key_cols: Sequence[str], *,
                  order_cols: Sequence[str] | None = None) -> DataFrame:
    """Multinomial: m draws with p ∝ mass -> ``(key_cols..., hits)`` (hit cells only).

    ``order_cols`` (default: the keys) order the intervals.  Draws carry a
    narrow key: the only key column, or the MD5 of all of them.
    """
    order = list(order_cols or key_cols)
    narrow = len(key_cols) == 1
    base = cells.select(*dict.fromkeys([*key_cols, *order, mass_col]))
    if not narrow:
        base = base.withColumn("_rid", row_key(key_cols))
    rid = key_cols[0] if narrow else "_rid"
    hits = weighted_draws(base, mass_col, m, seed, rid, order_cols=order).groupBy(rid).agg(F.count(F.lit(1)).alias("hits"))
    return hits if narrow else base.join(hits, "_rid").select(*key_cols, "hits")


def numbered_members(rows: DataFrame, cell_col: str) -> DataFrame:
    """``rows``, written, with ``_member``: 0, 1, ... within each cell, in stored order.

    Counted by stored part, with the cell's rows in earlier parts added: a
    cell that holds a third of all rows is numbered by as many tasks as the
    table has parts.  The counts by cell and part can be nearly as many as the
    rows, so they are merged, however small the written table looks.
    """
    kept = stash(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "members")
    here = Window.partitionBy(cell_col, "_part").orderBy("_at")
    before = Window.partitionBy(cell_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy(cell_col, "_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        cell_col, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return kept.withColumn("_here", F.row_number().over(here)).join(offsets.hint("merge"), [cell_col, "_part"]).withColumn(
        "_member", F.col("_before") + F.col("_here") - 1).drop("_part", "_at", "_here", "_before")


def expand(cells: DataFrame, count_col: str, key_cols: Sequence[str], *,
           order_cols: Sequence[str] | None = None) -> DataFrame:
    """Repeat each cell ``count`` times (count <= 0 dropped) as record rows.

    Records are ``spark.range(Σcount)`` joined to integer intervals
    ``[cum_lo, cum_hi)``: the output is evenly partitioned however the counts
    are skewed.  Adds ``record`` (0-based global index, in key order).
    """
    order = list(order_cols or key_cols)
    c = cells.select(*dict.fromkeys([*key_cols, *order]), F.greatest(F.col(count_col).cast("long"), F.lit(0)).alias("_cnt"))
    spark = cells.sparkSession
    rows, size = measured(c, list(dict.fromkeys([*key_cols, *order])))
    total = int(c.agg(F.sum("_cnt")).first()[0] or 0) if rows else 0
    if total == 0:
        return spark.createDataFrame([], cells.select(*key_cols).schema).withColumn("record", F.lit(0).cast("long"))
    iv = intervals(c, "_cnt", order, rows=rows, normalize=False)
    pts = index_range(spark, total).select(F.col("id").alias("record"))
    j = range_join(pts, F.col("record").cast("double"), iv, "cum_lo", "cum_hi", span=float(total),
                   n_buckets=min(rows, total), broadcast=size <= BROADCAST_BYTES)
    return j.select(*key_cols, "record")


def subsample_exact(df: DataFrame, n: int, seed: int, key_cols: Sequence[str]) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, seeded by row key.

    Rows are ranked by ``u = hash_uniform(seed, key)`` (ties by key).  Up to
    TOPK_LIMIT a TakeOrdered plan (per-partition partial top-n).  Beyond it,
    two levels of u-buckets are counted (small aggregates): every row below
    the cut is taken whole, and only the rows of the cut sub-bucket
    (~rows / 2^32) are ranked — no task sorts more than that.
    """
    u = hash_uniform(seed, *key_cols)
    ranked = df.withColumn("_u", u)
    order = [F.col("_u")] + [F.col(k) for k in key_cols]
    if n <= TOPK_LIMIT:
        return ranked.orderBy(*order).limit(n).drop("_u")
    nb = EDGE_BUCKETS
    b1 = ranked.withColumn("_b1", F.floor(F.col("_u") * nb).cast("long")) \
               .withColumn("_b2", (F.floor(F.col("_u") * float(nb) * nb) % nb).cast("long"))

    def cut(counts: DataFrame, key: str, need):
        w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = counts.withColumn("_cum", F.sum("_c").over(w)).withColumn("_before", F.col("_cum") - F.col("_c"))
        at = cum.where(F.col("_cum") >= need).agg(F.min(key)).scalar()
        before = cum.where(F.col(key) == at).select("_before").scalar()
        return at, before

    c1 = b1.groupBy("_b1").agg(F.count(F.lit(1)).alias("_c"))
    cut1, before1 = cut(c1, "_b1", F.lit(n))
    edge = b1.where(F.col("_b1") == cut1)
    c2 = edge.groupBy("_b2").agg(F.count(F.lit(1)).alias("_c"))
    need2 = F.lit(n) - before1
    cut2, before2 = cut(c2, "_b2", need2)
    whole = b1.where(F.col("_b1") < F.coalesce(cut1, F.lit(nb)))
    whole2 = edge.where(F.col("_b2") < cut2)
    last = edge.where(F.col("_b2") == cut2)
    we = Window.partitionBy("_b2").orderBy(*order)
    last = last.withColumn("_r", F.row_number().over(we)).where(F.col("_r") <= need2 - before2).drop("_r")
    return whole.unionByName(whole2).unionByName(last).drop("_u", "_b1", "_b2")
