"""Validation of generated text and the accept-until-n rule, as table ops.

``validate_generated`` is one projection: parse, completeness, exact-or-fuzzy
per attribute, structural zeros, and a ``reject_reason`` (null = accepted).
It is row-local, so the same function serves batch and streaming inputs.

``take_accepted`` reproduces the sequential loop without a global sort:
accepted counts per batch (one aggregate), the batch that holds the n-th
record (found level by level from bounded sums), earlier batches whole, and
only the cut batch ranked by position.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.domain import CENSUS_ATTRS, CENSUS_DOMAIN
from popweave.functions.rules import STRUCTURAL_ZERO_RULES, ZeroRule, feasible, violations
from popweave.functions.text import match_category, normalized, parse_records, stage
from popweave.session import materialize

FAN = 1_024  # parts of a level of batches
REASONS = ("incomplete", "unmatched", "infeasible")  # reject_reason values, in check order


def validate_generated(df: DataFrame, text_col: str = "text", *, attrs: Sequence[str] | None = None,
                       domain: Mapping[str, Sequence[str]] | None = None,
                       rules: Sequence[ZeroRule] = STRUCTURAL_ZERO_RULES,
                       keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., attrs..., reject_reason)``; attrs hold the matched categories."""
    attrs = list(attrs) if attrs else list(CENSUS_ATTRS)
    domain = dict(domain) if domain else dict(CENSUS_DOMAIN)
    parsed = parse_records(df, text_col, attrs, keep=keep)
    complete = F.lit(True)
    for a in attrs:
        complete = complete & F.col(a).isNotNull()
    norm = stage(parsed, *keep, *attrs, complete.alias("_complete"),
                 *[normalized(F.col(a)).alias(f"_n_{a}") for a in attrs])
    matched = stage(norm, *keep, "_complete",
                    *[match_category(F.col(a), domain[a], prenormalized=F.col(f"_n_{a}")).alias(a) for a in attrs])
    all_matched = F.lit(True)
    for a in attrs:
        all_matched = all_matched & F.col(a).isNotNull()
    ages = domain.get("age_group", CENSUS_DOMAIN["age_group"])
    reason = (F.when(~F.col("_complete"), F.lit("incomplete"))
              .when(~all_matched, F.lit("unmatched"))
              .when(~feasible("age_group", rules, ages), F.lit("infeasible")))
    return matched.select(*keep, *attrs, reason.alias("reject_reason"))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNull()).drop("reject_reason")


def max_batches(n: int, batch_size: int) -> int:
    """At most 3x the batches needed, and at least 10."""
    return max(int(math.ceil(n / batch_size)) * 3, 10)


def first_batches(texts: DataFrame, n: int, batch_size: int = 64, batch_col: str = "batch") -> DataFrame:
    """The batches that may be read for n records; to be taken before texts are parsed."""
    return texts.where(F.col(batch_col) < max_batches(n, batch_size))


def _per_batch(validated: DataFrame, n: int, batch_size: int, batch_col: str) -> DataFrame:
    """``(batch, acc, fail)`` of the batches that may be read."""
    return (first_batches(validated, n, batch_size, batch_col).groupBy(batch_col)
            .agg(F.count(F.when(F.col("reject_reason").isNull(), 1)).alias("acc"),
                 F.count(F.when(F.col("reject_reason").isNotNull(), 1)).alias("fail")))


def _cut(per: DataFrame, n: int, batch_col: str) -> tuple[int, int]:
    """The last batch read, and the records accepted before it (all batches if n is not reached).

    Levels of batches: a level's sums (``FAN`` rows at most) give the one
    that holds the n-th record, whose parts are the next level.
    """
    lo, hi = (per.agg(F.min(batch_col), F.max(batch_col)).first())
    if lo is None:
        return -1, 0
    hi, before = hi + 1, 0
    while hi - lo > 1:
        step = -(-(hi - lo) // FAN)
        part = F.floor((F.col(batch_col) - F.lit(lo)) / F.lit(step))
        sums = dict(per.where((F.col(batch_col) >= lo) & (F.col(batch_col) < hi))
                    .groupBy(part.cast("long")).agg(F.sum("acc")).collect())
        for k in sorted(sums):
            if before + sums[k] >= n:
                break
            if k == max(sums):
                return lo + (k + 1) * step, before  # n is not reached
            before += sums[k]
        lo, hi = lo + k * step, min(hi, lo + (k + 1) * step)
    return lo, before


def take_accepted(validated: DataFrame, n: int, *, batch_size: int = 64, batch_col: str = "batch",
                  pos_col: str = "pos") -> DataFrame:
    """First n accepted records in (batch, pos) order among batches < max_batches.

    Batches before the cut batch are taken whole; the cut batch alone is
    ranked by position.  Only the cut (two numbers) is broadcast, in the plan.
    """
    if n <= 0:
        return accepted(validated).limit(0)
    cut, before = _cut(materialize(_per_batch(validated, n, batch_size, batch_col)), n, batch_col)
    acc = accepted(first_batches(validated, n, batch_size, batch_col))
    whole = acc.where(F.col(batch_col) < cut)
    edge = acc.where(F.col(batch_col) == cut).orderBy(pos_col).limit(n - before)
    return whole.unionByName(edge)


def generation_stats(validated: DataFrame, n: int, *, batch_size: int = 64, batch_col: str = "batch") -> DataFrame:
    """One row: requested, accepted (after truncation to n), failed, batches,
    fill_rate = accepted / requested, parse_rate = accepted / (accepted + failed)."""
    per = materialize(_per_batch(validated, n, batch_size, batch_col))
    cut, _ = _cut(per, n, batch_col)
    agg = per.where(F.col(batch_col) <= cut).agg(F.coalesce(F.sum("acc"), F.lit(0)).alias("acc_all"),
                    F.coalesce(F.sum("fail"), F.lit(0)).alias("failed"),
                    F.count(F.lit(1)).alias("batches"))
    acc = F.least(F.col("acc_all"), F.lit(n)).cast("long")
    return agg.select(
        F.lit(n).cast("long").alias("requested"), acc.alias("accepted"),
        F.col("failed").cast("long").alias("failed"), F.col("batches").cast("long").alias("batches"),
        (acc / F.lit(max(n, 1))).alias("fill_rate"),
        (acc / F.greatest(acc + F.col("failed"), F.lit(1))).alias("parse_rate"))


def violation_table(df: DataFrame, keep: Sequence[str] = ("id",), rules: Sequence[ZeroRule] = STRUCTURAL_ZERO_RULES,
                    age_domain: Sequence[str] | None = None) -> DataFrame:
    """``(keep..., violations STRING)`` for rows with at least one violation (ids joined by ',')."""
    v = violations("age_group", rules, age_domain)
    return df.select(*keep, v.alias("_v")).where(F.size("_v") > 0) \
             .select(*keep, F.array_join("_v", ",").alias("violations"))


def violation_counts(df: DataFrame, rules: Sequence[ZeroRule] = STRUCTURAL_ZERO_RULES,
                     age_domain: Sequence[str] | None = None) -> DataFrame:
    """``(rule_id, n)`` over all rows (partial aggregation; one row per rule)."""
    v = violations("age_group", rules, age_domain)
    return df.select(F.explode(v).alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
