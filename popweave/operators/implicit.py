"""IPF, integerization and sampling over a grid that is never enumerated.

The smoothed seed of a cell is ``smoothing + its records``, and fitting only
multiplies whole categories.  So a fitted cell is

    scale * (smoothing + records) * product of its categories' factors

and the fit is held by the cells that occur in the data and one factor for
each category, whatever the size of the product of the domains:

* the fitted mass of category c of attribute a is ``scale * (smoothing * f_a[c]
  * product over the other attributes of the sum of their factors + the sum
  over the seen cells)``: one small aggregation of the seen cells a step;
* a draw takes a seen cell by the records' part of the mass, or else each
  attribute's category for itself by the factors: the product part is a table
  of independent attributes;
* truncate-replicate-sample needs the cells of 1 and more (seen ones, and
  others found attribute by attribute, dropping beginnings that cannot reach 1
  any more, at most one for each record to come) and draws the rest from the
  residuals, where the product part's draws that fall on a listed cell are
  drawn again.

Values are the same as those of ``fitting.ipf`` on the enumerated grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.domain import Domain, domain_grid, grid_size, ordinal
from popweave.functions.hashing import hash_uniform
from popweave.functions.text import stage
from popweave.operators.cells import domain_filter
from popweave.operators.factors import FactorLoop, scaled_counts
from popweave.operators.fitting import MAX_TASK_CELLS, _as_targets, trs_integerize
from popweave.operators.sampling import BROADCAST_BYTES, index_range, intervals, measured, range_join
from popweave.session import materialize, stash


def fit_product(c: np.ndarray, codes: Sequence[np.ndarray], goals: Sequence[np.ndarray], n: float, *, smoothing: float,
                others: float, tol: float, max_iter: int, rate_tol: float) -> tuple[list[np.ndarray], int, float]:
    """Factors of the constrained attributes for seen cells ``c`` (with codes) and the product around them."""
    factors = [np.ones(len(g)) for g in goals]
    scale = n / (c.sum() + smoothing * others * prod(float(len(g)) for g in goals))

    def mass(a: int) -> np.ndarray:
        w = c.copy()
        for code, f in zip(codes, factors, strict=True):
            w *= f[code]
        rest = others * prod(float(f.sum()) for b, f in enumerate(factors) if b != a)
        return scale * (np.bincount(codes[a], weights=w, minlength=len(goals[a])) + smoothing * rest * factors[a])

    off, before, sweeps = np.inf, -np.inf, 0
    while sweeps < max_iter and off > tol and abs(off - before) > rate_tol:
        before, off = off, 0.0
        for a, goal in enumerate(goals):
            factors[a] = factors[a] * scaled_counts(mass(a), goal)
        for a, goal in enumerate(goals):
            cur, known = mass(a), goal > 0
            if known.any():
                off = max(off, float(np.max(np.abs(cur[known] / goal[known] - 1.0))))
            if np.any(cur[~known] > 0):
                off = np.inf
        sweeps += 1
    return factors, sweeps, float(off)


@dataclass
class ImplicitFit:
    """A fitted product: seen cells (``attrs..., _c``), factors by attribute and category, and what multiplies all."""

    attrs: list[str]
    domain: dict[str, list[str]]
    seen: DataFrame
    factors: dict[str, np.ndarray]
    n: float
    scale: float
    smoothing: float
    iterations: int
    conv: float

    # ------------------------------------------------------------ values

    def weight(self) -> Column:
        """The product of a row's factors; null where a value is out of domain."""
        w = F.lit(1.0)
        for a in self.attrs:
            at = ordinal(a, self.domain[a])
            w = w * F.when(at >= 0, F.element_at(F.lit(self.factors[a]), at + 1))
        return w

    def value(self, cells: DataFrame) -> DataFrame:
        """``cells`` (with the attributes) and their ``fitted`` mass."""
        c = self.seen.select(*[F.col(a).alias(f"_s_{a}") for a in self.attrs], "_c")
        same = F.lit(True)
        for a in self.attrs:
            same = same & (F.col(a) == F.col(f"_s_{a}"))
        joined = cells.join(c, same, "left").drop(*[f"_s_{a}" for a in self.attrs])
        mass = (F.coalesce("_c", F.lit(0.0)) + self.smoothing) * F.lit(self.scale) * self.weight()
        return joined.withColumn("fitted", mass).drop("_c")

    def _product(self, but: str | None = None) -> float:
        return self.scale * self.smoothing * prod(float(self.factors[a].sum()) for a in self.attrs if a != but)

    def marginals(self) -> DataFrame:
        """``attr, ord, cat, fitted``: fitted mass of every category, from one pass over the seen cells."""
        # Ordinals are evaluated once, before the factors are looked up: together they are too long for the JVM to compile.
        at = [f"_o_{i}" for i in range(len(self.attrs))]
        coded = stage(self.seen, "_c", *[ordinal(a, self.domain[a]).alias(o) for a, o in zip(self.attrs, at, strict=True)])
        mass = F.col("_c") * F.lit(self.scale)
        for a, o in zip(self.attrs, at, strict=True):
            mass = mass * F.when(F.col(o) >= 0, F.element_at(F.lit(self.factors[a]), F.col(o) + 1))
        weighed = stage(coded, mass.alias("m"), *at)
        one = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(o).alias("ord")) for a, o in zip(self.attrs, at, strict=True)]))
        seen = weighed.select("m", one.alias("x")).groupBy("x.attr", "x.ord").agg(F.sum("m").alias("m"))
        rows = [(a, i, cat, float(self._product(a) * f)) for a in self.attrs
                for i, (cat, f) in enumerate(zip(self.domain[a], self.factors[a], strict=True))]
        base = self.seen.sparkSession.createDataFrame(rows, "attr string, ord int, cat string, p double")
        return base.join(seen, ["attr", "ord"], "left").select("attr", "ord", "cat", (F.col("p") + F.coalesce("m", F.lit(0.0))).alias("fitted"))

    def factor_table(self) -> DataFrame:
        """``attr, cat, factor`` (see ``factors``); a value out of domain has factor 0."""
        rows = [(a, cat, float(f)) for a in self.attrs for cat, f in
                zip([*self.domain[a], None], [*self.factors[a], 0.0], strict=True)]
        return self.seen.sparkSession.createDataFrame(rows, "attr string, cat string, factor double")

    # ------------------------------------------------------------ draws

    def _category(self, a: str, u: Column) -> Column:
        """The category of attribute ``a`` at a uniform: the first whose running sum of factors exceeds it."""
        run = np.cumsum(self.factors[a])
        below = F.size(F.filter(F.lit(run), lambda x: x <= u * F.lit(float(run[-1]))))
        last = int(np.flatnonzero(self.factors[a] > 0)[-1])  # a uniform near 1 may round up to the whole sum
        return F.element_at(F.lit(np.array(self.domain[a], dtype=str)), F.least(below, F.lit(last)) + 1)

    def _independent(self, draws: DataFrame, seed: int, *keys: Column | str) -> DataFrame:
        """A category of each attribute for itself, by uniforms of the seed, the draw and ``keys``."""
        return draws.select(*draws.columns, *[
            self._category(a, hash_uniform(seed, F.col("draw"), *keys, F.lit(a))).alias(a) for a in self.attrs])

    def _by_mass(self, draws: DataFrame, cells: DataFrame, mass: str, point: Column, rows: int) -> DataFrame:
        """The cell of ``cells`` at each draw's point on their running mass."""
        size = measured(cells, self.attrs)[1]
        order = [ordinal(a, self.domain[a]) for a in self.attrs]
        keyed = cells.select(*self.attrs, mass, *[o.alias(f"_o_{a}") for o, a in zip(order, self.attrs, strict=True)])
        iv = materialize(intervals(keyed, mass, [f"_o_{a}" for a in self.attrs], rows=rows, normalize=False))
        span = iv.agg(F.max("cum_hi")).first()[0]
        # The sum in order, up to rounding the mass that the points were scaled to.
        return range_join(draws, F.least(point, F.lit(float(np.nextafter(span, 0.0)))), iv.select(*self.attrs, "cum_lo", "cum_hi"),
                          "cum_lo", "cum_hi", span=float(span), n_buckets=rows, broadcast=size <= BROADCAST_BYTES
                          ).select("draw", *self.attrs)

    def sample(self, n: int, seed: int) -> DataFrame:
        """``draw, attrs...``: ``n`` independent draws with p proportional to the fitted mass."""
        seen = stash(self.seen.where("_c > 0").select(*self.attrs, (F.col("_c") * F.lit(self.scale) * self.weight()).alias("_m"))
                     .where("_m > 0"), "seen-mass")
        rows, records = seen.agg(F.count(F.lit(1)), F.sum("_m")).first()
        records, product = float(records or 0.0), self._product()
        u = hash_uniform(seed, F.col("id"))
        draws = index_range(self.seen.sparkSession, n).select(F.col("id").alias("draw"), (u * F.lit(records + product)).alias("_p"))
        free = self._independent(draws.where(F.col("_p") >= F.lit(records)).select("draw"), seed)
        if not rows:
            return free
        return self._by_mass(draws.where(F.col("_p") < F.lit(records)), seen, "_m", F.col("_p"), rows).unionByName(free)

    def heavy_cells(self, least: float = 1.0) -> DataFrame:
        """Cells whose product part alone is ``least`` or more: ``attrs..., _q``.

        Attribute by attribute, a beginning stays while the largest factors of
        the attributes after it can bring it there: every beginning kept leads
        to such a cell, so a level has at most as many rows as the result.
        """
        top = [float(self.factors[a].max()) for a in self.attrs]
        spark = self.seen.sparkSession
        out = spark.range(1).select(F.lit(self.scale * self.smoothing).alias("_q"))
        for k, a in enumerate(self.attrs):
            rest = prod(top[k + 1:])
            options = F.arrays_zip(F.lit(np.array(self.domain[a], dtype=str)).alias("v"), F.lit(self.factors[a]).alias("f"))
            out = out.select("*", F.explode(options).alias("_x")).select(
                *self.attrs[:k], F.col("_x.v").alias(a), (F.col("_q") * F.col("_x.f")).alias("_q"))
            out = out.where(F.col("_q") * F.lit(rest) >= F.lit(least)).repartition(*self.attrs[:k + 1])
        return out

    def integerize(self, n: int, seed: int) -> DataFrame:
        """``attrs..., count``: truncate-replicate-sample of the whole product, cells of count 0 left out.

        Grids of up to ``MAX_TASK_CELLS`` cells, and those with most cells seen,
        are enumerated instead (``fitting.trs_integerize``).
        """
        cells = grid_size(self.attrs, self.domain)
        spark = self.seen.sparkSession
        if cells <= max(MAX_TASK_CELLS, 2 * self.seen.count()):
            grid = self.value(domain_grid(spark, self.attrs, self.domain))
            return trs_integerize(grid, n, seed, ["cell", *self.attrs]).where("count > 0").select(*self.attrs, "count")
        q = F.lit(self.scale * self.smoothing) * self.weight()
        listed = self.seen.select(*self.attrs).unionByName(self.heavy_cells().select(*self.attrs)).distinct()
        listed = self.value(listed).withColumn("_q", q)
        listed = stash(listed.select(*self.attrs, F.floor("fitted").cast("long").alias("_floor"),
                                     (F.col("fitted") - F.floor("fitted")).alias("_rest"), "_q"), "listed-cells")
        floors, rests, covered, rows = listed.agg(F.sum("_floor"), F.sum("_rest"), F.sum("_q"),
                                                  F.count(F.when(F.col("_rest") > 0, 1))).first()
        lists = listed.where("_floor > 0").select(*self.attrs, F.col("_floor").alias("count"))
        deficit = int(n) - int(floors)
        if deficit <= 0:
            return lists
        free = max(self._product() - float(covered), 0.0)
        draws = index_range(spark, deficit).select(
            F.col("id").alias("draw"), (hash_uniform(seed, F.col("id")) * F.lit(float(rests) + free)).alias("_p"))
        parts = []
        if rows:
            parts.append(self._by_mass(draws.where(F.col("_p") < F.lit(float(rests))), listed.where("_rest > 0"), "_rest",
                                       F.col("_p"), rows))
        left = draws.where(F.col("_p") >= F.lit(float(rests))).select("draw")
        for attempt in range(1 << 20):
            tried = stash(self._independent(left, seed, F.lit(attempt)), "free-draws")
            parts.append(tried.join(listed, self.attrs, "left_anti"))
            left = stash(tried.join(listed, self.attrs, "left_semi").select("draw"), "drawn-again")
            if not left.limit(1).count():
                break
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        return lists.unionByName(hits.groupBy(*self.attrs).agg(F.count(F.lit(1)).alias("count"))).groupBy(*self.attrs).agg(
            F.sum("count").alias("count"))


def ipf_implicit(cells: DataFrame, targets, n: float, attrs: Sequence[str], domain: Domain, *, count_col: str = "n",
                 smoothing: float = 0.5, tol: float = 1e-6, max_iter: int = 500, rate_tol: float = 1e-8) -> ImplicitFit:
    """Fit cells (``attrs..., count_col``; counted if there is no such column) smoothed over the whole product.

    ``targets`` as in ``fitting.ipf``; attributes without targets are
    unconstrained, rows with a value out of domain are skipped.
    """
    if smoothing <= 0:
        raise ValueError("without smoothing the seen cells are the whole table: use fitting.ipf")
    spark = cells.sparkSession
    attrs = list(attrs)
    dom = {a: [str(c) for c in domain[a]] for a in attrs}
    count = F.sum(F.col(count_col).cast("double")) if count_col in cells.columns else F.count(F.lit(1)).cast("double")
    text = [F.col(a).cast("string").alias(a) for a in attrs]
    extra = [count_col] if count_col in cells.columns else []
    inside = domain_filter(cells.select(*text, *extra), attrs, dom)
    # A cell without records keeps the table from being empty.
    first = spark.range(1).select(*[F.lit(dom[a][0]).alias(a) for a in attrs], F.lit(0.0).alias("_c"))
    seen = stash(inside.groupBy(*attrs).agg(count.alias("_c")).unionByName(first).groupBy(*attrs).agg(F.sum("_c").alias("_c")), "seen-cells")
    tdf = _as_targets(spark, targets)
    shares: dict[str, dict[str, float]] = {}
    for r in tdf.select("attr", "cat", "prop").collect():  # as many rows as the targets have
        shares.setdefault(r["attr"], {})[str(r["cat"])] = float(r["prop"])
    fixed = [a for a in attrs if a in shares]
    others = prod(float(len(dom[a])) for a in attrs if a not in shares)
    rows, records = seen.agg(F.count(F.lit(1)), F.sum("_c")).first()
    size = prod(float(len(dom[a])) for a in fixed)
    scale = float(n) / (float(records) + smoothing * others * size)
    goals = [np.array([shares[a].get(c, 0.0) for c in dom[a]]) * float(n) for a in fixed]
    if rows <= MAX_TASK_CELLS:
        coded = seen.select(F.lit(0).alias("_g"), "_c", *[ordinal(a, dom[a]).alias(f"_o_{i}") for i, a in enumerate(fixed)])

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            found, sweeps, off = fit_product(
                frame["_c"].to_numpy(float), [frame[f"_o_{i}"].to_numpy(int) for i in range(len(fixed))], goals, float(n),
                smoothing=smoothing, others=others, tol=tol, max_iter=max_iter, rate_tol=rate_tol)
            return pd.DataFrame([(a, i, float(x), sweeps, off) for a, f in zip(fixed, found, strict=True) for i, x in enumerate(f)],
                                columns=["attr", "ord", "factor", "sweeps", "off"])

        got = coded.groupBy("_g").applyInPandas(fit, "attr string, ord int, factor double, sweeps int, off double").collect()
        found = {a: np.array([r["factor"] for r in sorted((r for r in got if r["attr"] == a), key=lambda r: r["ord"])]) for a in fixed}
        sweeps, off = (got[0]["sweeps"], got[0]["off"]) if got else (0, 0.0)
    else:
        loop = FactorLoop(seen.withColumn("_grp", F.lit(0)), tdf.where(F.col("attr").isin(fixed)).withColumn("_grp", F.lit(0)), ["_grp"],
                          "_c", {a: dom[a] for a in fixed}, "ipf", n=n, smoothing=smoothing, others=others)
        state = loop.run(tol=tol, max_iter=max_iter, rate_tol=rate_tol).state.first()
        found = {a: np.array(state[f"_f_{i}"][1:]) for i, a in enumerate(fixed)}
        sweeps, off = state["_it"], state["_change"]
    factors = {a: found.get(a, np.ones(len(dom[a]))) for a in attrs}
    return ImplicitFit(attrs, dom, seen, factors, float(n), scale, float(smoothing), int(sweeps), float(off))


__all__ = ["ImplicitFit", "fit_product", "ipf_implicit"]
