"""Fitting on the cell table: seed, IPF, raking, integerization, expansion.

Both fits only rescale whole categories, so a record's weight is a function
of its cell: fitting the cell table is exact.  Each group's cells (bounded
by the domain product) are fitted inside one task by
``cogroup(cells, targets).applyInPandas`` — one job for any number of
groups, lineage flat.  When groups' grids are larger than
``MAX_TASK_CELLS`` (measured) the same recurrences run for all of these groups
together, one aggregation over integer category codes for an attribute step
(``factors.FactorLoop``; only per-category sums and factors travel).
``rake_factors`` gives the fitted factors themselves, to be stored and applied
to other records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.domain import Domain, cell_index, domain_grid
from popweave.operators.cells import latest_wave
from popweave.operators.factors import FactorLoop, null_safe, scaled_counts
from popweave.operators.sampling import expand, weighted_hits
from popweave.session import materialize, stash

MAX_TASK_CELLS = 1_000_000
GROUP_KEY = "_grp"

Targets = Mapping[str, Mapping[str, float]]


# ------------------------------------------------------------------ targets

def targets_df(spark: SparkSession, targets: Targets) -> DataFrame:
    """Ordered target dict -> ``(attr, attr_pos, cat, cat_pos, prop)``."""
    rows = [(a, i, str(c), j, float(p)) for i, (a, t) in enumerate(targets.items())
            for j, (c, p) in enumerate(t.items())]
    schema = "attr string, attr_pos int, cat string, cat_pos int, prop double"
    return spark.createDataFrame(rows, schema)


def targets_from_marginals(marg: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Marginal table ``(by..., attr, ord, cat, prop)`` -> ordered targets."""
    pos = F.array_position(F.array(*[F.lit(a) for a in attrs]), F.col("attr")).cast("int") - 1
    keep = [c for c in marg.columns if c not in ("attr", "ord", "cat", "n", "prop")]
    return marg.select(*keep, "attr", pos.alias("attr_pos"), "cat", F.col("ord").alias("cat_pos"),
                       F.coalesce(F.col("prop"), F.lit(0.0)).alias("prop"))


def _as_targets(spark: SparkSession, targets) -> DataFrame:
    return targets if isinstance(targets, DataFrame) else targets_df(spark, targets)


# --------------------------------------------------------------- seed table

def seed_table(train: DataFrame, attrs: Sequence[str], domain: Domain, *, smoothing: float = 0.5,
               year_col: str = "year", weight_col: str | None = None) -> DataFrame:
    """Latest wave -> in-domain cell counts -> full grid + ``smoothing``.

    ``(cell BIGINT, attrs..., seed DOUBLE)``.  Rows with any attribute out of
    domain are skipped; every grid cell (structural zeros included) gets the
    smoothing mass, as in the reference.  Records are aggregated once into
    per-year grid cells (checkpointed, bounded by years × grid); the latest
    year is then picked on that small table, so the record plan runs once.
    """
    spark = train.sparkSession
    train = train.select(*[F.col(c).cast("string").alias(c) if c in attrs else F.col(c) for c in train.columns])
    domain = {a: [str(c) for c in domain[a]] for a in attrs}
    idx = cell_index(attrs, domain)
    cnt = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    by = [year_col] if year_col in train.columns else []
    per_year = materialize(
        train.select(*by, idx.alias("cell"), *([weight_col] if weight_col else []))
        .where(F.col("cell").isNotNull()).groupBy(*by, "cell").agg(cnt.cast("double").alias("c")))
    counts = latest_wave(per_year, year_col).select("cell", "c") if by else per_year
    grid = domain_grid(spark, attrs, domain, index_col="cell")
    return grid.join(counts, "cell", "left").select(
        "cell", *attrs, (F.coalesce(F.col("c"), F.lit(0.0)) + F.lit(float(smoothing))).alias("seed"))


def seed_from_year_cells(year_cells: DataFrame, attrs: Sequence[str], domain: Domain, train_years: Sequence[int],
                         *, smoothing: float = 0.5, year_col: str = "year", n: str = "n") -> DataFrame:
    """Seed table from per-year cells (out-of-domain already NULL): the
    latest training year present, in-domain cells only, full grid + smoothing."""
    spark = year_cells.sparkSession
    cond = F.col(year_col).isin(list(train_years))
    for a in attrs:
        cond = cond & F.col(a).isNotNull()
    wave = latest_wave(year_cells.where(cond), year_col)
    counts = wave.select(cell_index(attrs, domain).alias("cell"), F.col(n).cast("double").alias("c")) \
        .groupBy("cell").agg(F.sum("c").alias("c"))
    grid = domain_grid(spark, attrs, domain, index_col="cell")
    return grid.join(counts, "cell", "left").select(
        "cell", *attrs, (F.coalesce(F.col("c"), F.lit(0.0)) + F.lit(float(smoothing))).alias("seed"))


def seed_scaled(seed: DataFrame, n: int, col: str = "seed", out: str = "fitted") -> DataFrame:
    """``seed · n / Σseed`` (no targets)."""
    total = seed.agg(F.sum(col)).scalar()
    return seed.withColumn(out, F.col(col) * F.lit(float(n)) / total)


# -------------------------------------------------------- in-task recurrences

def _codes(values: np.ndarray, cats: Sequence[str]) -> np.ndarray:
    return pd.Categorical(pd.Series(values, dtype="object"), categories=list(cats)).codes.astype(np.int64)


def rake_weights(n: np.ndarray, codes: Sequence[np.ndarray], props: Sequence[np.ndarray], *,
                 mode: str = "sequential", max_iter: int = 100, tol: float = 1e-6,
                 factors: list[np.ndarray] | None = None) -> tuple[np.ndarray, int, float]:
    """Per-cell weights for cell counts ``n`` (record weights are per cell).

    ``factors``, if given, is filled with an array a target attribute: what
    each of its categories' weight was multiplied by.

    ``sequential`` (reference-compatible): categories in target order, the
    total re-read after every category, zero targets skipped, stop when the
    largest absolute per-record weight change < tol.  ``classic``: targets
    normalised, total fixed, unlisted values and zero targets get weight 0.
    """
    n = np.asarray(n, dtype=np.float64)
    w = np.ones_like(n)
    product = [] if factors is None else factors
    product[:] = [np.ones(len(t)) for t in props]
    if len(n) == 0:
        return w, 0, 0.0
    change = 0.0
    it = 0
    if mode == "classic":
        total = float(n.sum())
        norm = []
        for code, t in zip(codes, props):
            s = float(np.sum(t))
            norm.append(np.asarray(t) / s if s > 0 else np.zeros_like(t))
            w[code < 0] = 0.0
        for it in range(1, max_iter + 1):
            for a, (code, t) in enumerate(zip(codes, norm)):
                m = len(t)
                sel = code >= 0
                cur = np.bincount(code[sel], weights=(n * w)[sel], minlength=m)
                f = scaled_counts(cur, t * total)
                product[a] *= f
                w = np.where(sel, w * f[np.where(sel, code, 0)], w)
            change = 0.0
            for code, t in zip(codes, norm):
                sel = code >= 0
                cur = np.bincount(code[sel], weights=(n * w)[sel], minlength=len(t))
                pos = t > 0
                if pos.any():
                    change = max(change, float(np.max(np.abs(cur[pos] / (t[pos] * total) - 1.0))))
            if change <= tol:
                break
        return w, it, change
    if mode != "sequential":
        raise ValueError(f"unknown mode {mode!r}")
    for it in range(1, max_iter + 1):
        change = 0.0
        for a, (code, t) in enumerate(zip(codes, props)):
            m = len(t)
            mass = n * w
            W = float(mass.sum())
            sel = code >= 0
            cur = np.bincount(code[sel], weights=mass[sel], minlength=m)
            mx = np.zeros(m)
            np.maximum.at(mx, code[sel], w[sel])
            f = np.ones(m)
            for j in range(m):
                if t[j] <= 0 or cur[j] <= 0:
                    continue
                adj = t[j] * W / cur[j]
                f[j] = adj
                W += (adj - 1.0) * cur[j]
                change = max(change, abs(adj - 1.0) * mx[j])
            product[a] *= f
            w = np.where(sel, w * f[np.where(sel, code, 0)], w)
        if change < tol:
            break
    return w, it, change


def ipf_fit(m: np.ndarray, codes: Sequence[np.ndarray], counts: Sequence[np.ndarray], *,
            tol: float = 1e-6, max_iter: int = 500, rate_tol: float = 1e-8) -> tuple[np.ndarray, int, float]:
    """Classic one-way IPF on a cell vector.

    Each sweep scales every category of every constrained attribute to its
    target count (a category with zero current mass is left as is).  Stops
    when max |marginal/target − 1| (targets > 0; a positive marginal on a
    zero target counts as infinite) <= tol, when it stops moving by more than
    ``rate_tol``, or after ``max_iter`` sweeps.
    """
    m = np.asarray(m, dtype=np.float64).copy()
    conv, old = np.inf, -np.inf
    it = 0
    while it < max_iter and conv > tol and abs(conv - old) > rate_tol:
        old = conv
        for code, t in zip(codes, counts):
            cur = np.bincount(code, weights=m, minlength=len(t))
            m = m * scaled_counts(cur, t)[code]
        conv = 0.0
        for code, t in zip(codes, counts):
            cur = np.bincount(code, weights=m, minlength=len(t))
            pos = t > 0
            if pos.any():
                conv = max(conv, float(np.max(np.abs(cur[pos] / t[pos] - 1.0))))
            if np.any(cur[~pos] > 0):
                conv = np.inf
        it += 1
    return m, it, float(conv)


# ------------------------------------------------------------ grouped fits

def _with_group(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, list(by)
    return df.withColumn(GROUP_KEY, F.lit(0)), [GROUP_KEY]


def _by_size(cells: DataFrame, tdf: DataFrame, keys: Sequence[str], small, large) -> DataFrame:
    """``small`` over all groups that fit a task, ``large`` over all others, each once."""
    side = [f"_b_{k}" for k in keys]
    over = stash(cells.groupBy(*[F.col(k).alias(s) for k, s in zip(keys, side)]).agg(F.count(F.lit(1)).alias("_cells"))
                 .where(F.col("_cells") > MAX_TASK_CELLS).select(*side), "large-groups")
    if not over.limit(1).count():
        return small(cells, tdf)
    pick = lambda df, how: df.join(over, null_safe(keys, side), how)
    return large(pick(cells, "left_semi"), pick(tdf, "left_semi")).unionByName(
        small(pick(cells, "left_anti"), pick(tdf, "left_anti")))


def _target_categories(tdf: DataFrame) -> dict[str, list[str]]:
    """Categories of each attribute over all groups, in target order (as many values as the targets have)."""
    rows = tdf.groupBy("attr", "cat").agg(F.min("attr_pos").alias("a"), F.min("cat_pos").alias("c")).orderBy("a", "attr", "c", "cat").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["attr"], []).append(str(r["cat"]))
    return out


def _group_targets(tpdf: pd.DataFrame) -> list[tuple[str, list[str], np.ndarray]]:
    """Attribute, categories and shares of one group, in target order."""
    tpdf = tpdf.sort_values(["attr_pos", "cat_pos"])
    out = []
    for a in tpdf["attr"].drop_duplicates():
        t = tpdf[tpdf["attr"] == a]
        out.append((a, t["cat"].tolist(), t["prop"].to_numpy(dtype=np.float64)))
    return out


def rake(cells: DataFrame, targets, *, by: Sequence[str] = (), n_col: str = "n", mode: str = "sequential",
         max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """Rake cell weights to one-way targets; adds ``w, iterations, max_change``.

    ``targets``: ordered dict ``{attr: {cat: prop}}`` (same for every group)
    or a DataFrame ``(by..., attr, attr_pos, cat, cat_pos, prop)``.
    An empty group yields no rows (the reference returns an empty copy).
    """
    if mode not in ("sequential", "classic"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = cells.sparkSession
    tdf = _as_targets(spark, targets)
    c, keys = _with_group(materialize(cells), by)
    if not by:
        tdf = tdf.withColumn(GROUP_KEY, F.lit(0))
    schema = T.StructType(c.schema.fields + [
        T.StructField("w", T.DoubleType()), T.StructField("iterations", T.IntegerType()),
        T.StructField("max_change", T.DoubleType())])
    cols = c.columns

    def fit(key, cpdf: pd.DataFrame, tpdf: pd.DataFrame) -> pd.DataFrame:
        if cpdf.empty:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        goals = _group_targets(tpdf)
        codes = [_codes(cpdf[a].to_numpy(), cats) for a, cats, _ in goals]
        w, it, ch = rake_weights(cpdf[n_col].to_numpy(), codes, [p for *_, p in goals], mode=mode, max_iter=max_iter, tol=tol)
        out = cpdf[cols].copy()
        out["w"] = w
        out["iterations"] = np.int32(it)
        out["max_change"] = float(ch)
        return out

    res = _by_size(
        c, tdf, keys,
        lambda x, t: x.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(fit, schema),
        lambda x, t: FactorLoop(x, t, keys, n_col, _target_categories(t), mode).run(tol=tol, max_iter=max_iter)
        .weighted_cells().select(*cols, F.col("_w").alias("w"), F.col("_it").alias("iterations"),
                                 F.col("_change").alias("max_change")))
    return res.drop(GROUP_KEY) if not by else res


def rake_factors(cells: DataFrame, targets, *, by: Sequence[str] = (), n_col: str = "n", mode: str = "sequential",
                 max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """The factors of ``rake``: ``(by..., attr, cat, factor)``; a record's weight is the product of its categories'.

    The null category stands for the values that the targets do not list
    (factor 1, or 0 in ``classic`` mode).  Store them with
    ``factors.save_factors``; ``factors.apply_factors`` weighs other records.
    """
    if mode not in ("sequential", "classic"):
        raise ValueError(f"unknown mode {mode!r}")
    tdf = _as_targets(cells.sparkSession, targets)
    c, keys = _with_group(materialize(cells), by)
    if not by:
        tdf = tdf.withColumn(GROUP_KEY, F.lit(0))
    schema = T.StructType([*[c.schema[k] for k in keys], T.StructField("attr", T.StringType()),
                           T.StructField("cat", T.StringType()), T.StructField("factor", T.DoubleType())])

    def fit(key, cpdf: pd.DataFrame, tpdf: pd.DataFrame) -> pd.DataFrame:
        if cpdf.empty:
            return pd.DataFrame(columns=schema.names)
        goals, found = _group_targets(tpdf), []
        codes = [_codes(cpdf[a].to_numpy(), cats) for a, cats, _ in goals]
        rake_weights(cpdf[n_col].to_numpy(), codes, [p for *_, p in goals], mode=mode, max_iter=max_iter, tol=tol, factors=found)
        rows = [(*key, a, cat, float(x)) for (a, cats, _), f in zip(goals, found, strict=True)
                for cat, x in zip([*cats, None], [*f, 0.0 if mode == "classic" else 1.0], strict=True)]
        return pd.DataFrame(rows, columns=schema.names)

    res = _by_size(
        c, tdf, keys,
        lambda x, t: x.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(fit, schema),
        lambda x, t: FactorLoop(x, t, keys, n_col, _target_categories(t), mode).run(tol=tol, max_iter=max_iter).factor_table())
    return res.drop(GROUP_KEY) if not by else res


def ipf(seed: DataFrame, targets, n: int, attrs: Sequence[str], domain: Domain, *, by: Sequence[str] = (),
        seed_col: str = "seed", tol: float = 1e-6, max_iter: int = 500, rate_tol: float = 1e-8) -> DataFrame:
    """Fit ``seed · n/Σseed`` to one-way target shares × n; adds ``fitted``.

    Attributes without targets are unconstrained; a domain category missing
    from a target gets count 0.  Output keeps the seed columns plus
    ``fitted, iterations, conv``.
    """
    spark = seed.sparkSession
    tdf = _as_targets(spark, targets)
    c, keys = _with_group(materialize(seed), by)
    if not by:
        tdf = tdf.withColumn(GROUP_KEY, F.lit(0))
    schema = T.StructType(c.schema.fields + [
        T.StructField("fitted", T.DoubleType()), T.StructField("iterations", T.IntegerType()),
        T.StructField("conv", T.DoubleType())])
    cols = c.columns
    dom = {a: list(domain[a]) for a in attrs}
    order = list(attrs)

    def fit(key, cpdf: pd.DataFrame, tpdf: pd.DataFrame) -> pd.DataFrame:
        if cpdf.empty:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        s = cpdf[seed_col].to_numpy(dtype=np.float64)
        m0 = s * (float(n) / s.sum())
        present = set(tpdf["attr"])
        codes, counts = [], []
        for a in order:
            if a not in present:
                continue
            t = tpdf[tpdf["attr"] == a]
            tmap = dict(zip(t["cat"], t["prop"]))
            counts.append(np.array([float(tmap.get(cat, 0.0)) for cat in dom[a]]) * float(n))
            codes.append(_codes(cpdf[a].to_numpy(), dom[a]))
        m, it, conv = ipf_fit(m0, codes, counts, tol=tol, max_iter=max_iter, rate_tol=rate_tol)
        out = cpdf[cols].copy()
        out["fitted"] = m
        out["iterations"] = np.int32(it)
        out["conv"] = conv
        return out

    res = _by_size(
        c, tdf, keys,
        lambda x, t: x.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(fit, schema),
        lambda x, t: _ipf_large(x, t, keys, n, attrs, dom, seed_col).run(tol=tol, max_iter=max_iter, rate_tol=rate_tol)
        .weighted_cells().select(*cols, (F.col("_mass") * F.col("_w") * float(n) / F.col("_total")).alias("fitted"),
                                 F.col("_it").alias("iterations"), F.col("_change").alias("conv")))
    return res.drop(GROUP_KEY) if not by else res


def _ipf_large(cells: DataFrame, tdf: DataFrame, keys: Sequence[str], n: float, attrs: Sequence[str], domain: Domain,
               mass: str) -> FactorLoop:
    present = {r["attr"] for r in tdf.select("attr").distinct().collect()}
    return FactorLoop(cells, tdf, keys, mass, {a: domain[a] for a in attrs if a in present}, "ipf", n=n)


# ----------------------------------------------------- integerize / expand

def trs_integerize(fitted: DataFrame, n: int, seed: int, key_cols: Sequence[str], *, value_col: str = "fitted",
                   order_col: str = "cell") -> DataFrame:
    """Truncate-replicate-sample: ``count = floor(v) + hits``.

    deficit = n − Σfloor; when positive, ``deficit`` draws with replacement,
    p ∝ residual (uniform when every residual is 0); when <= 0 nothing is
    removed.  The deficit has no bound but n (the fitted cells sum to less
    than n where the last fitted target's shares sum to less than 1), so the
    draws are a distributed range.
    """
    keys = [k for k in key_cols if k != order_col]
    v = F.col(value_col)
    fl = materialize(fitted.select(order_col, *keys, F.floor(v).cast("long").alias("floor"), (v - F.floor(v)).alias("resid")))
    floors, resids = fl.agg(F.sum("floor"), F.sum("resid")).first()
    deficit = int(n) - int(floors or 0)
    if deficit <= 0:
        return fl.select(order_col, *keys, F.col("floor").alias("count"))
    mass = fl.select(order_col, (F.col("resid") if resids > 0 else F.lit(1.0)).alias("mass"))
    hits = weighted_hits(mass, "mass", deficit, seed, [order_col])
    return fl.join(hits, order_col, "left").select(
        order_col, *keys, (F.col("floor") + F.coalesce(F.col("hits"), F.lit(0))).cast("long").alias("count"))


def expand_cells(counts: DataFrame, key_cols: Sequence[str], *, count_col: str = "count",
                 order_col: str = "cell") -> DataFrame:
    """Integer cell table -> Σcount records (``key_cols...``), count <= 0 dropped."""
    keys = [k for k in key_cols if k != order_col]
    return expand(counts, count_col, keys, order_cols=[order_col]).select(*keys, "record")


def save_fitted(fitted: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Persist a fitted cell table (cells + weights/factors) as Parquet."""
    w = fitted.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def load_fitted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


__all__ = ["seed_table", "seed_scaled", "rake", "rake_factors", "ipf", "rake_weights", "ipf_fit", "trs_integerize",
           "expand_cells", "save_fitted", "load_fitted", "targets_df", "targets_from_marginals"]
