"""Closest categories by an index of prefixes, for domains of any size.

The rules of ``functions.text.match_category``, as one equi-join instead of a
chain of comparisons in the plan.  A category is entered under itself, under
its lower-case form, and under every prefix of three and more characters of
that; a value asks for itself, for its normalised form, and for its prefixes of
the lengths that categories have.  The first rule wins, then domain order:

0. the value is a category;
1. its normalised form equals a category's lower-case form;
2. a category's lower-case form begins it;
3. it has three characters and more and begins a category's lower-case form.

Values are matched once each, however often they occur; of equal entries the
first category in domain order is kept by partial aggregation, so a prefix that
all categories share costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.functions.text import normalized
from popweave.operators.sampling import BROADCAST_BYTES, measured
from popweave.session import stash

#: Characters that a value needs to begin a category.
LEAST_PREFIX = 3


def category_index(domain: DataFrame) -> DataFrame:
    """``attr, rule, key, ord, cat`` from a domain table ``attr, ord, cat``: the first category of every key."""
    low, size = F.lower("cat"), F.char_length(F.lower("cat"))
    keys = F.concat(
        F.array(F.struct(F.lit(0).alias("rule"), F.col("cat").alias("key")), F.struct(F.lit(1).alias("rule"), low.alias("key")),
                F.struct(F.lit(2).alias("rule"), low.alias("key"))),
        F.when(size >= LEAST_PREFIX, F.transform(F.sequence(F.lit(LEAST_PREFIX), size), lambda n: F.struct(
            F.lit(3).alias("rule"), F.substring(low, F.lit(1), n).alias("key")))).otherwise(
                F.array().cast("array<struct<rule:int,key:string>>")))
    entries = domain.select("attr", "ord", "cat", F.explode(keys).alias("k"))
    return entries.groupBy("attr", "k.rule", "k.key").agg(F.min(F.struct("ord", "cat")).alias("first")).select(
        "attr", "rule", "key", "first.ord", "first.cat")


def match_values(values: DataFrame, domain: DataFrame) -> DataFrame:
    """``attr, value, matched`` for each distinct non-null ``attr, value``; null where nothing matches."""
    index = stash(category_index(domain), "category-index")
    lengths = (domain.groupBy("attr").agg(F.sort_array(F.collect_set(F.char_length(F.lower("cat")))).alias("_lengths"))
               .withColumnRenamed("attr", "_attr"))  # as many as the longest category has characters
    distinct = values.where(F.col("value").isNotNull()).select("attr", "value").distinct()
    plain = stash(distinct.withColumn("_plain", normalized(F.col("value"))), "distinct-values")
    v, size = F.col("_plain"), F.char_length("_plain")
    asked = F.concat(
        F.array(F.struct(F.lit(0).alias("rule"), F.col("value").alias("key")), F.struct(F.lit(1).alias("rule"), v.alias("key"))),
        F.transform(F.filter("_lengths", lambda n: n <= size), lambda n: F.struct(
            F.lit(2).alias("rule"), F.substring(v, F.lit(1), n).alias("key"))),
        F.when(size >= LEAST_PREFIX, F.array(F.struct(F.lit(3).alias("rule"), v.alias("key")))).otherwise(
            F.array().cast("array<struct<rule:int,key:string>>")))
    probes = plain.join(lengths, F.col("attr") == F.col("_attr")).select("attr", "value", F.explode(asked).alias("k")).select(
        "attr", "value", "k.rule", "k.key")
    best = probes.join(index, ["attr", "rule", "key"]).groupBy("attr", "value").agg(
        F.min(F.struct("rule", "ord", "cat")).alias("best"))
    return plain.select("attr", "value").join(best, ["attr", "value"], "left").select(
        "attr", "value", F.col("best.cat").alias("matched"))


def match_columns(records: DataFrame, attrs: Sequence[str], domain: DataFrame) -> DataFrame:
    """``records`` with every attribute replaced by its closest category (null if there is none)."""
    one = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs]))
    matched = stash(match_values(records.select(one.alias("x")).select("x.*"), domain), "matched-values")
    small = measured(matched, matched.columns)[1] <= BROADCAST_BYTES
    out = records
    for a in attrs:
        side = matched.where(F.col("attr") == a).select(F.col("value").alias("_value"), F.col("matched").alias("_matched"))
        out = out.join(F.broadcast(side) if small else side, F.col(a).cast("string") == F.col("_value"), "left").withColumn(
            a, F.col("_matched")).drop("_value", "_matched")
    return out


__all__ = ["category_index", "match_columns", "match_values"]
