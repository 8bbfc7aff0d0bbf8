"""Year-conditioned empirical sampler (the GAN sampler's contract, re-aimed).

``fit`` = cell counts per year (one aggregation); ``sample(n, year)`` = n
seeded multinomial draws from that year's cells, or from the pooled cells
when the year was never seen (the reference falls back to unconditional
sampling when conditioning fails).  Output has the attributes only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.domain import DEFAULT_SEED
from popweave.operators.cells import cell_counts
from popweave.operators.sampling import expand, weighted_hits
from popweave.session import materialize


@dataclass
class EmpiricalSampler:
    cells: DataFrame          # (year, attrs..., n), checkpointed
    attrs: list[str]
    year_col: str = "year"

    @classmethod
    def fit(cls, train: DataFrame, attrs: Sequence[str], *, year_col: str = "year",
            weight_col: str | None = None) -> "EmpiricalSampler":
        """Per-year cell counts (one aggregation, checkpointed)."""
        by = [year_col] if year_col in train.columns else []
        cells = cell_counts(train.select(*by, *attrs, *([weight_col] if weight_col else [])),
                            list(attrs), None, by=by, weight_col=weight_col)
        if not by:
            cells = cells.withColumn(year_col, F.lit(None).cast("int"))
        return cls(materialize(cells), list(attrs), year_col)

    def condition_cells(self, year: int | None) -> DataFrame:
        """That year's cells if any exist, else all years pooled."""
        c = self.cells
        if year is None:
            sel = c
        else:
            y = F.col(self.year_col) == F.lit(int(year))
            seen = c.where(y).agg(F.count(F.lit(1))).scalar() > 0
            sel = c.where(y | ~seen)
        return sel.groupBy(*self.attrs).agg(F.sum("n").alias("n"))

    def sample_counts(self, n: int, year: int | None = None, seed: int = DEFAULT_SEED) -> DataFrame:
        """``(attrs..., hits)`` for n draws (cells never drawn are absent)."""
        cells = self.condition_cells(year)
        return weighted_hits(cells, "n", int(n), seed, self.attrs)

    def sample(self, n: int, year: int | None = None, seed: int = DEFAULT_SEED) -> DataFrame:
        """n records (attributes only; the year is dropped)."""
        hits = self.sample_counts(n, year, seed)
        return expand(hits, "hits", self.attrs).select(*self.attrs)
