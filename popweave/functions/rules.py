"""Structural-zero rules as literal predicates.

The rules are the ones the reference's checker hard-codes (its declared
config table is never read).  A rule fires when the age index lies in
``[idx_lo, idx_hi]`` and the attribute holds a non-empty value outside
``allowed``.  Unknown or null age never violates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from popweave.domain import CENSUS_DOMAIN, ordinal


@dataclass(frozen=True)
class ZeroRule:
    rule_id: str
    idx_lo: int
    idx_hi: int
    attr: str
    allowed: tuple[str, ...]


# --- fixed values: structural-zero rules, in output order ------------------
STRUCTURAL_ZERO_RULES: tuple[ZeroRule, ...] = (
    ZeroRule("Z1", 0, 0, "edu", ("No schooling",)),
    ZeroRule("Z2", 1, 1, "edu", ("No schooling", "Elementary school")),
    ZeroRule("Z3", 2, 2, "edu", ("No schooling", "Elementary school", "Middle school")),
    ZeroRule("Z4", 0, 2, "marital_status", ("Never married",)),
    ZeroRule("Z5", 0, 2, "occupation", ("Not economically active",)),
)
# --- end fixed values ------------------------------------------------------


def violations(age_col: str = "age_group", rules: Sequence[ZeroRule] = STRUCTURAL_ZERO_RULES,
               age_domain: Sequence[str] | None = None) -> Column:
    """ARRAY<STRING> of violated rule ids, in rule order (empty = feasible)."""
    ages = list(age_domain) if age_domain else list(CENSUS_DOMAIN["age_group"])
    idx = ordinal(age_col, ages)
    flags = []
    for r in rules:
        v = F.col(r.attr)
        hit = (idx >= r.idx_lo) & (idx <= r.idx_hi) & v.isNotNull() & (v != "") & ~v.isin(list(r.allowed))
        flags.append(F.when(hit, F.lit(r.rule_id)))
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def feasible(age_col: str = "age_group", rules: Sequence[ZeroRule] = STRUCTURAL_ZERO_RULES,
             age_domain: Sequence[str] | None = None) -> Column:
    """True when no rule fires (a plain boolean predicate, no array built)."""
    ages = list(age_domain) if age_domain else list(CENSUS_DOMAIN["age_group"])
    idx = ordinal(age_col, ages)
    ok = F.lit(True)
    for r in rules:
        v = F.col(r.attr)
        hit = (idx >= r.idx_lo) & (idx <= r.idx_hi) & v.isNotNull() & (v != "") & ~v.isin(list(r.allowed))
        ok = ok & ~F.coalesce(hit, F.lit(False))
    return ok
