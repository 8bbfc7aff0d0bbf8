"""Attribute lists, ordered closed domains and domain tables.

Every operator takes ``attrs`` and ``domain`` as arguments; the census
values below are defaults only.  A domain is an ordered ``dict`` of
attribute -> ordered category list; the order fixes ordinals, grid order,
fuzzy-match ties and the age index of the structural-zero rules.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: census schema (must equal the reference's) -------------
CENSUS_ATTRS = ["sex", "age_group", "edu", "occupation", "marital_status"]

CENSUS_DOMAIN: dict[str, list[str]] = {
    "sex": ["Male", "Female"],
    "age_group": [
        "0-4", "5-9", "10-14", "15-19", "20-24", "25-29", "30-34",
        "35-39", "40-44", "45-49", "50-54", "55-59", "60-64", "65-69",
        "70-74", "75-79", "80-84", "85+",
    ],
    "edu": [
        "No schooling", "Elementary school", "Middle school",
        "High school", "2-year college", "4-year university",
        "Graduate school",
    ],
    "occupation": [
        "Not economically active", "Managers", "Professionals", "Clerks",
        "Service workers", "Agriculture/Forestry/Fishery", "Blue collar",
        "Armed forces",
    ],
    "marital_status": ["Never married", "Married", "Widowed", "Divorced"],
}

# display names used in serialized text (internal -> display)
DISPLAY_NAMES: dict[str, str] = {
    "sex": "Sex",
    "age_group": "Age Group",
    "edu": "Education",
    "occupation": "Occupation",
    "marital_status": "Marital Status",
}

TRAIN_YEARS = [1990, 1995, 2000, 2005, 2010]
TARGET_YEAR = 2015
ALL_YEARS = [1990, 1995, 2000, 2005, 2010, 2015, 2020]
DEFAULT_REGION = "Daejeon"
DEFAULT_SEED = 42
# --- end fixed values ------------------------------------------------------

# POP proxy (FIXTURES.md §2): five TPC-H categorical columns, 450 cells.
POP_ATTRS = ["l_linestatus", "l_returnflag", "o_orderstatus", "o_orderpriority", "c_mktsegment"]
POP_DOMAIN: dict[str, list[str]] = {
    "l_linestatus": ["F", "O"],
    "l_returnflag": ["A", "N", "R"],
    "o_orderstatus": ["F", "O", "P"],
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}
POP_TRAIN_YEARS = [1995, 1996, 1997, 1998, 1999]
POP_TARGET_YEAR = 2000

Domain = Mapping[str, Sequence[str]]


def resolve(attrs: Sequence[str] | None, domain: Domain | None) -> tuple[list[str], dict[str, list[str]]]:
    """Defaults as in the reference: an empty list/dict also falls back."""
    attrs = list(attrs) if attrs else list(CENSUS_ATTRS)
    domain = {k: list(v) for k, v in domain.items()} if domain else dict(CENSUS_DOMAIN)
    return attrs, domain


def grid_size(attrs: Sequence[str], domain: Domain) -> int:
    """Number of cells of the full product of the attributes' domains."""
    return prod(len(domain[a]) for a in attrs)


def cats_array(cats: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in cats])


def ordinal(col: Column | str, cats: Sequence[str]) -> Column:
    """0-based position of the value in the ordered domain; -1 if absent/null."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.coalesce(F.array_position(cats_array(cats), c), F.lit(0)) - 1).cast("int")


def in_domain(col: Column | str, cats: Sequence[str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if not cats:
        return F.lit(False)
    return c.isNotNull() & c.isin(list(cats))


def null_out_of_domain(col: str, cats: Sequence[str]) -> Column:
    """Value if in the closed domain, else NULL (null = out of domain)."""
    return F.when(in_domain(col, cats), F.col(col)).alias(col)


def domain_df(spark: SparkSession, attrs: Sequence[str], domain: Domain) -> DataFrame:
    """Long domain table ``(attr STRING, ord INT, cat STRING)``; tiny, literal."""
    rows = [(a, i, c) for a in attrs for i, c in enumerate(domain[a])]
    schema = T.StructType([
        T.StructField("attr", T.StringType(), False),
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("cat", T.StringType(), False),
    ])
    return spark.createDataFrame(rows, schema)


def domain_grid(spark: SparkSession, attrs: Sequence[str], domain: Domain,
                index_col: str | None = "cell") -> DataFrame:
    """Full product of the domains, in lexicographic ordinal order.

    Built from ``spark.range`` by mixed-radix decoding of the cell index, so
    it is partitioned like any range and involves no join at all.
    """
    sizes = [len(domain[a]) for a in attrs]
    total = prod(sizes)
    strides = []
    s = 1
    for size in reversed(sizes):
        strides.append(s)
        s *= size
    strides = list(reversed(strides))
    cols = []
    for a, size, stride in zip(attrs, sizes, strides):
        idx = (F.floor(F.col("id") / F.lit(stride)) % F.lit(size)).cast("int")
        cols.append(F.element_at(cats_array(domain[a]), idx + 1).alias(a))
    out = spark.range(total).select(*( [F.col("id").alias(index_col)] if index_col else []), *cols)
    return out


def cell_index(attrs: Sequence[str], domain: Domain) -> Column:
    """Mixed-radix grid index of a cell (null if any attribute is out of domain)."""
    expr = F.lit(0).cast("long")
    for a in attrs:
        o = ordinal(a, domain[a])
        expr = expr * F.lit(len(domain[a])) + F.when(o >= 0, o.cast("long"))
    return expr


def infer_domain(left: DataFrame, right: DataFrame | None, attrs: Sequence[str]) -> DataFrame:
    """Fallback domain: sorted union of both sides' distinct non-null values.

    Output ``(attr, ord, cat)``.  One unpivot + distinct per side; ordinals
    come from a range-partitioned sort: each partition counts its values per
    attribute, offsets are a running sum over partitions (one row per
    partition and attribute), and values are ranked only within their own
    partition — no task holds all values of an attribute.
    """
    from pyspark.sql.window import Window

    from popweave.session import materialize

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("cat")) for a in attrs
        ])).alias("kv")).select("kv.attr", "kv.cat").where(F.col("cat").isNotNull()).distinct()

    vals = long(left)
    if right is not None:
        vals = vals.unionByName(long(right)).distinct()
    ranged = materialize(vals.repartitionByRange("attr", "cat").withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid", "attr").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("attr").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", "attr", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_pid", "attr").orderBy("cat"))
    return ranged.withColumn("_r", local).join(offs, ["_pid", "attr"]) \
        .select("attr", (F.col("_off") + F.col("_r") - 1).cast("int").alias("ord"), "cat")
