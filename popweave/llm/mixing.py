"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source's mean repetition rate is ``total * weight / rows``.  A document's
number of copies inverts the Poisson distribution of that mean at a uniform
that is a hash of the seed and the identifier; the document is exploded by that
number and all copies are put in one global pseudo-random order.

Source sizes come from one map-side combined aggregation.  The table of rates
and cumulative probabilities is broadcast only after its size was measured
(``BROADCAST_ROWS`` rows of cumulative probabilities); a larger one is joined
by shuffle with the sources' documents dealt over ``SALTS`` sub-keys, so a
source that holds a third of all rows does not land in one task.

Edge cases: a null source is a source of its own; a null identifier hashes as
the empty string; repeated rows get the same number of copies; a source that
``weights`` does not list has weight 0, and weights of absent sources have no
effect; all weights 0, or an empty table, gives an empty result.  The columns
of the input come back untouched, the copy number and the shuffle key under
names that the caller gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popweave.functions.hashing import hash_key, hash_uniform
from popweave.llm.common import stash, table, whole_row

#: Default target weights: (rows of the source) ** ALPHA, so large sources are damped.
ALPHA = 0.5
SEED = 20
BROADCAST_ROWS = 1_000_000
SALTS = 64


def source_rates(rows: DataFrame, weights: dict | None = None, total: int | None = None,
                 alpha: float = ALPHA) -> DataFrame:
    """``_source, _rows, _rate`` for each source; ``rows`` has ``_source``."""
    sizes = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows"))
    if weights is None:
        weighed = sizes.withColumn("_weight", F.pow(F.col("_rows").cast("double"), F.lit(float(alpha))))
    else:
        case = F.lit(0.0)
        for name, w in weights.items():
            case = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(case)
        weighed = sizes.withColumn("_weight", case)
    weighed = stash(weighed, "source-sizes")
    all_weights, all_rows = weighed.agg(F.sum("_weight"), F.sum("_rows")).first()  # two numbers
    want = float(total if total is not None else all_rows or 0)
    return weighed.select(
        "_source", "_rows",
        (F.lit(want) * F.col("_weight") / F.lit(all_weights or 1.0) / F.col("_rows")).alias("_rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``_source, _rate, _cdf``: cumulative Poisson probabilities of 0, 1, ... up to 12 deviations past the mean."""
    last = F.ceil(F.col("_rate") + 12 * F.sqrt("_rate") + 24).cast("int")
    steps = rates.where("_rate > 0").select("_source", "_rate", F.explode(F.sequence(F.lit(0), last)).alias("_k"))
    up = Window.partitionBy("_source").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    log_fact = F.sum(F.when(F.col("_k") > 0, F.log(F.greatest(F.col("_k"), F.lit(1)).cast("double")))
                     .otherwise(0.0)).over(up)
    pmf = F.exp(-F.col("_rate") + F.col("_k") * F.log("_rate") - F.col("_log_fact"))
    cum = (steps.withColumn("_log_fact", log_fact).withColumn("_p", pmf)
           .withColumn("_c", F.sum("_p").over(up)))
    return cum.groupBy("_source", "_rate").agg(F.array_sort(F.collect_list("_c")).alias("_cdf"))


def mix_sources(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict | None = None,
                total: int | None = None, alpha: float = ALPHA, seed: int = SEED,
                copy_col: str | None = "copy", key_col: str | None = "shuffle_key") -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in one global pseudo-random order."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{source_col}`").alias("_source"), ident.alias("_id"), whole_row(docs).alias("_row"))
    rates = stash(source_rates(rows.select("_source"), weights, total, alpha), "mix-rates")
    steps = poisson_steps(rates)
    entries = rates.agg(F.sum(F.ceil(F.col("_rate") + 12 * F.sqrt("_rate") + 25))).first()[0] or 0
    same = F.col("d._source").eqNullSafe(F.col("s._source"))
    if entries <= BROADCAST_ROWS:
        joined = rows.alias("d").join(F.broadcast(steps).alias("s"), same)
    else:
        spread = steps.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("s")
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).alias("d")
        joined = dealt.join(spread, same & (F.col("d._salt") == F.col("s._salt")))
    counted = joined.select("_id", "_row", hash_uniform(seed, F.col("_id")).alias("_u"), "_cdf").select(
        "_id", "_row", F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))).alias("_n"))
    copies = counted.where("_n > 0").select("_id", "_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    shuffled = copies.withColumn("_key", F.md5(hash_key(f"order{seed}", F.col("_id"), F.col("_copy"))))
    extra = [F.col(c).alias(name) for c, name in (("_copy", copy_col), ("_key", key_col)) if name]
    return shuffled.orderBy("_key").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], *extra)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mixture of ``documents``: every copy with its text."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", F.col("copy").cast("int").alias("copy"), "shuffle_key")


def oracle_ctes(docs: str, seed: int = SEED, alpha: float = ALPHA) -> str:
    """CTE list that ends in ``mixed``: the columns of ``docs`` with ``copy`` and ``shuffle_key``."""
    return f"""
  sizes AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
  rates AS (SELECT source, (SELECT sum(n) FROM sizes)::DOUBLE * pow(n::DOUBLE, {alpha})
                   / (SELECT sum(pow(n::DOUBLE, {alpha})) FROM sizes) / n AS rate FROM sizes),
  steps AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 24)::INT)) AS k FROM rates),
  facts AS (SELECT *, sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY source ORDER BY k) AS log_fact FROM steps),
  cdfs AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - log_fact)) OVER (PARTITION BY source ORDER BY k) AS c
           FROM facts),
  draws AS (SELECT d.*, ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT
                   / 4503599627370496.0::DOUBLE AS u FROM {docs} d),
  counted AS (SELECT d.*, (SELECT count(*) FROM cdfs c
                           WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS copies FROM draws d),
  mixed AS (SELECT * EXCLUDE (u, copies, copy),
                   copy::INT AS copy, md5('order{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
            FROM (SELECT *, unnest(generate_series(1, copies)) AS copy FROM counted WHERE copies > 0))"""


ORACLE = f"WITH {oracle_ctes('documents')} SELECT doc_id, source, text, copy, shuffle_key FROM mixed"

QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLES = {"op3_mix_sources": ORACLE}
