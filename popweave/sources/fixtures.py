"""Proxy inputs derived from the test tables (see FIXTURES.md).

POP: five categorical TPC-H columns plus the order year (450 cells).
CEN: census-shaped records computed from ``orders``.
GEN: generated-text proxy: CEN serialized and mutated in twelve ways.

All builders are lazy DataFrames over the given tables, so their work grows
with the tables.  ``pop_weighted`` pre-aggregates ``lineitem`` per order
(fixed-width counts per status × flag) before the join: the big join input
shrinks to one row per order, any hot order key collapses to one row, and
the aggregation's shuffle is the join's partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.domain import CENSUS_DOMAIN, DEFAULT_REGION, DISPLAY_NAMES, POP_DOMAIN, cats_array
from popweave.functions.text import era_narrative_expr

# POP_SKEW keep-thresholds by return flag: keep (l_partkey + 3*l_suppkey) % 10 < k
SKEW_KEEP = {"A": 9, "N": 5, "R": 2}
OOD_MOD = 97
#: lineitem rows of a task of the record join: what it sorts, for the join and a partitioned write, stays so many rows.
JOIN_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")
    return li.where(_skew_kept(F.col("l_returnflag"))) if variant == "skew" else li


def year_range(col: str, years) -> Column:
    """``year(col) in years`` as timestamp ranges (one per run of consecutive
    years), which Parquet can push down and prune row groups with."""
    ys = sorted(set(int(y) for y in years))
    runs: list[list[int]] = []
    for y in ys:
        if runs and y == runs[-1][1] + 1:
            runs[-1][1] = y
        else:
            runs.append([y, y])
    cond = F.lit(False)
    for a, b in runs:
        lo = F.lit(f"{a:04d}-01-01 00:00:00").cast("timestamp_ntz")
        hi = F.lit(f"{b + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
        cond = cond | ((F.col(col) >= lo) & (F.col(col) < hi))
    return cond


def _orders_customers(spark: SparkSession, sf_dir: str, variant: str, years=None) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    if years is not None:
        o = o.where(year_range("o_orderdate", years))
    o = o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.year("o_orderdate").cast("int").alias("year"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    oc = o.join(c, o["o_custkey"] == c["c_custkey"])
    seg = F.col("c_mktsegment")
    if variant == "ood":
        seg = F.when(F.col("o_orderkey") % OOD_MOD != 0, seg)
    return oc.select("o_orderkey", "year", "o_orderstatus", "o_orderpriority", seg.alias("c_mktsegment"))


POP_COLUMNS = ["year", "l_linestatus", "l_returnflag", "o_orderstatus", "o_orderpriority", "c_mktsegment"]


def pop_records(spark: SparkSession, sf_dir: str, variant: str = "base", with_rid: bool = False,
                years=None) -> DataFrame:
    """Row-level POP (one row per lineitem).  ``variant``: base|skew|ood.

    ``rid`` is the unique row identity ``orderkey:linenumber:partkey:suppkey``
    used to key seeded hash uniforms.  ``years`` restricts the order dates at
    the scan (pushed down; lineitem is then reduced by the join).  Tasks of the
    join are as many as the rows ask for (counted from the files' footers):
    the columns take few bytes in a shuffle, by which Spark would put millions
    of rows into a task.
    """
    li = _lineitem(spark, sf_dir, variant)
    oc = _orders_customers(spark, sf_dir, variant, years)
    tasks = math.ceil(table(spark, sf_dir, "lineitem").count() / JOIN_ROWS)
    if tasks > spark.sparkContext.defaultParallelism:
        oc, li = oc.repartition(tasks, "o_orderkey"), li.repartition(tasks, "l_orderkey").hint("merge")
    j = oc.join(li, oc["o_orderkey"] == li["l_orderkey"])
    cols = [F.col(c) for c in POP_COLUMNS]
    if with_rid:
        rid = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid")
        cols = [rid] + cols
    return j.select(*cols)


def _skew_kept(flag: Column) -> Column:
    keep = F.lit(0)
    for value, k in SKEW_KEEP.items():
        keep = F.when(flag == value, F.lit(k)).otherwise(keep)
    return ((F.col("l_partkey") + 3 * F.col("l_suppkey")) % 10) < keep


def pop_weighted(spark: SparkSession, sf_dir: str, variant: str = "base", years=None) -> DataFrame:
    """POP with multiplicity ``n``, for cell-level work.

    lineitem is aggregated per order into one count per (status, flag)
    combination — a fixed-width row, so a hot order collapses to one row —
    and that aggregation's shuffle on ``l_orderkey`` is the partitioning the
    join needs: the largest table is shuffled once.  The combinations are
    unpivoted after the join.  Values outside the POP domain arrive as NULL
    (the cell table's out-of-domain rule).  ``variant='both'`` counts the base
    rows in ``n`` and the skewed ones in ``n_skew`` in the same pass.
    """
    ls_dom, rf_dom = POP_DOMAIN["l_linestatus"], POP_DOMAIN["l_returnflag"]
    combos = [(x, y) for x in ls_dom + [None] for y in rf_dom + [None]]
    both = variant == "both"
    li = _lineitem(spark, sf_dir, variant)
    ls = F.when(F.col("l_linestatus").isin(ls_dom), F.col("l_linestatus"))
    rf = F.when(F.col("l_returnflag").isin(rf_dom), F.col("l_returnflag"))
    li = li.select("l_orderkey", ls.alias("ls"), rf.alias("rf"), *([_skew_kept(rf).alias("kept")] if both else []))
    here = [F.col("ls").eqNullSafe(F.lit(x)) & F.col("rf").eqNullSafe(F.lit(y)) for x, y in combos]
    per_order = li.groupBy("l_orderkey").agg(
        *[F.count(F.when(h, 1)).alias(f"_c{i}") for i, h in enumerate(here)],
        *([F.count(F.when(h & F.col("kept"), 1)).alias(f"_s{i}") for i, h in enumerate(here)] if both else []))
    oc = _orders_customers(spark, sf_dir, variant, years)
    j = oc.join(per_order, oc["o_orderkey"] == per_order["l_orderkey"])
    kv = F.explode(F.array(*[
        F.struct(F.lit(x).cast("string").alias("l_linestatus"), F.lit(y).cast("string").alias("l_returnflag"),
                 F.col(f"_c{i}").alias("n"), *([F.col(f"_s{i}").alias("n_skew")] if both else []))
        for i, (x, y) in enumerate(combos)]))
    out = j.select("year", "o_orderstatus", "o_orderpriority", "c_mktsegment", kv.alias("kv")) \
        .select("year", "o_orderstatus", "o_orderpriority", "c_mktsegment", "kv.*").where(F.col("n") > 0)
    return out.select(*POP_COLUMNS, "n", *(["n_skew"] if both else []))


#: Thirteen attributes of the same records; the product of their domains has 4.5e12 cells.
WIDE_DOMAIN = {
    **POP_DOMAIN,
    "c_nationkey": [str(i) for i in range(25)],
    "l_quantity": [str(i) for i in range(1, 51)],
    "l_discount": [str(i) for i in range(11)],
    "l_tax": [str(i) for i in range(9)],
    "l_linenumber": [str(i) for i in range(1, 8)],
    "o_month": [str(i) for i in range(1, 13)],
    "o_day": [str(i) for i in range(1, 32)],
    "l_shipday": [str(i) for i in range(1, 32)],
}


def wide_records(spark: SparkSession, sf_dir: str, years) -> DataFrame:
    """``year`` and the attributes of ``WIDE_DOMAIN`` as strings (amounts as whole numbers, rates in hundredths)."""
    o = table(spark, sf_dir, "orders").where(year_range("o_orderdate", years))
    li, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(li, o["o_orderkey"] == li["l_orderkey"])
    values = {
        **{a: F.col(a) for a in (*POP_DOMAIN, "c_nationkey", "l_linenumber")},
        "l_quantity": F.col("l_quantity").cast("int"),
        **{a: F.round(F.col(a) * 100).cast("int") for a in ("l_discount", "l_tax")},
        "o_month": F.month("o_orderdate"), "o_day": F.dayofmonth("o_orderdate"), "l_shipday": F.dayofmonth("l_shipdate"),
    }
    return j.select(F.year("o_orderdate").cast("int").alias("year"), *[values[a].cast("string").alias(a) for a in WIDE_DOMAIN])


# ---------------------------------------------------------------- CEN / GEN

def _pick(cats: list[str], idx: Column) -> Column:
    return F.element_at(cats_array(cats), (idx + 1).cast("int"))


def cen_records(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Census-shaped records from ``orders`` (FIXTURES.md §3).

    ``spread``: deal the two scanned columns over all cores where the file's
    row groups are fewer, for heavy work per record.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cores = spark.sparkContext.defaultParallelism
    if spread and o.rdd.getNumPartitions() < cores:
        o = o.repartition(2 * cores)
    k = F.col("o_orderkey")
    d = CENSUS_DOMAIN
    return o.select(
        k.alias("id"),
        (F.lit(1990) + 5 * (k % 12)).cast("int").alias("year"),
        _pick(d["sex"], k % 2).alias("sex"),
        _pick(d["age_group"], F.col("o_custkey") % 18).alias("age_group"),
        F.when(k % OOD_MOD != 0, _pick(d["edu"], F.floor(k / 2) % 7)).alias("edu"),
        _pick(d["occupation"], F.floor(k / 14) % 8).alias("occupation"),
        _pick(d["marital_status"], F.floor(k / 112) % 4).alias("marital_status"),
        F.col("o_custkey"),
    )


GEN_SECOND_RECORD = f", In 2020, a resident of {DEFAULT_REGION} was recorded: Sex is Male"
GEN_TRAILER = ". . "
GEN_CONFLICT = ", Sex is Other"


def gen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated-text proxy ``(id, year, gen_case, batch, pos, text)``.

    Orders of case 11 keep their plain text.  Beside them stands every row of
    ``documents`` with its whole text (case 11 too): identifier ``-1 - doc_id``,
    eight to a batch after the batch's other texts.
    """
    cen = cen_records(spark, sf_dir, spread=True)
    case = ((F.col("id") + F.col("o_custkey")) % 12).cast("int")
    cen = cen.withColumn("gen_case", case)

    attrs = ["sex", "age_group", "edu", "occupation", "marital_status"]
    vals = {}
    for a in attrs:
        v = F.col(a)
        v = F.when(F.col("gen_case") == 1, F.lower(v)).otherwise(v)
        if a == "edu":
            v = F.when(F.col("gen_case") == 2, F.concat(v, F.lit(" dropout"))) \
                 .when(F.col("gen_case") == 8, F.lit(None).cast("string")).otherwise(v)
        if a == "marital_status":
            v = F.when(F.col("gen_case") == 3, F.substring(v, 1, 4)) \
                 .when(F.col("gen_case") == 4, F.substring(v, 1, 2)).otherwise(v)
        vals[a] = v
    body = F.concat_ws(", ", *[F.when(vals[a].isNotNull(), F.concat(F.lit(DISPLAY_NAMES[a] + " is "), vals[a]))
                               for a in attrs])
    prefix = F.concat(F.lit("In "), F.col("year").cast("string"),
                      F.lit(f", a resident of {DEFAULT_REGION} was recorded: "))
    narrative = era_narrative_expr(F.col("year"))
    text = F.concat(
        F.when((F.col("gen_case") == 6) & narrative.isNotNull(),
               F.concat(F.lit("[Context: "), narrative, F.lit("] "))).otherwise(F.lit("")),
        F.when(F.col("gen_case") != 9, prefix).otherwise(F.lit("")),
        body,
        F.when(F.col("gen_case") == 5, F.lit(GEN_SECOND_RECORD))
         .when(F.col("gen_case") == 7, F.lit(GEN_TRAILER))
         .when(F.col("gen_case") == 10, F.lit(GEN_CONFLICT)).otherwise(F.lit("")),
    )
    plain = cen.select("id", "year", "gen_case", text.alias("text"))

    docs = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    junk = docs.select(
        (F.lit(-1) - doc).cast("long").alias("id"), (F.lit(1990) + 5 * (doc % 12)).cast("int").alias("year"),
        F.lit(11).alias("gen_case"), F.floor(doc / 8).cast("long").alias("batch"),
        (F.lit(64) + doc % 8).cast("int").alias("pos"), "text")
    return plain.select("id", "year", "gen_case", F.floor(F.col("id") / 64).cast("long").alias("batch"),
                        (F.col("id") % 64).cast("int").alias("pos"), "text").unionByName(junk)
