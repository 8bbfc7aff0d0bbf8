"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query runs one operator (or a composition) over the whole test tables
through the proxies of FIXTURES.md.  Doubles are rounded to 6 places at the
very end so the DuckDB oracle can compare values; nothing else is trimmed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.domain import (
    CENSUS_ATTRS,
    CENSUS_DOMAIN,
    POP_ATTRS,
    POP_DOMAIN,
    POP_TARGET_YEAR,
    POP_TRAIN_YEARS,
    TARGET_YEAR,
    TRAIN_YEARS,
    cell_index,
    domain_grid,
    infer_domain,
)
from popweave.functions import text as TX
from popweave.operators import cells as C
from popweave.operators import factors as FC
from popweave.operators import fitting as FT
from popweave.operators import implicit as IM
from popweave.operators import matching as MT
from popweave.operators import metrics as M
from popweave.operators import sampling as SM
from popweave.operators import validate as V
from popweave.operators.conditional import EmpiricalSampler
from popweave.plans import methods as PM
from popweave.sources import fixtures as fx
from popweave.sources import scans as S
from popweave.session import materialize, scratch_path, stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

POP_OOD_DOMAIN = {**POP_DOMAIN, "l_returnflag": ["A", "R"]}
SYN_YEAR = 1999  # latest training wave plays the synthetic side in metric queries
PAIR3 = ["l_returnflag", "o_orderstatus", "c_mktsegment"]


def query(fn=None, *, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        return f
    return register(fn) if fn is not None else register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def pop_cells(spark, d, variant="base", year=None, domain=POP_DOMAIN):
    w = fx.pop_weighted(spark, d, variant, years=None if year is None else [year])
    return C.cell_counts(w, POP_ATTRS, domain, weight_col="n")


# ------------------------------------------------------------ A: scans/sinks

@query
def scan_combined(spark, d):
    path = scratch_path(spark, "combined")
    S.write_table(fx.pop_records(spark, d), path)
    return S.read_combined(spark, path)


@query
def scan_per_year(spark, d):
    path = scratch_path(spark, "per_year")
    S.write_table(fx.pop_records(spark, d), path, partition_by=["year"])
    years = list(range(1994, 2003))  # 1994 and 2002 have no files: skipped
    df = S.read_per_year(spark, lambda y: f"{path}/year={y}", years)
    return df.select(*fx.POP_COLUMNS)


@query
def sink_roundtrip(spark, d):
    path = scratch_path(spark, "cells_by_year")
    cells = C.cell_counts(fx.pop_weighted(spark, d), POP_ATTRS, POP_DOMAIN, by=["year"], weight_col="n")
    S.write_table(cells, path, partition_by=["year"])
    back = spark.read.parquet(path)
    return back.select(F.col("year").cast("int").alias("year"), *POP_ATTRS, "n")


@query
def split_train_target(spark, d):
    return S.split_labeled(fx.pop_records(spark, d), POP_TRAIN_YEARS, POP_TARGET_YEAR)


@query
def split_counts(spark, d):
    return S.split_counts(fx.pop_records(spark, d), POP_TRAIN_YEARS, POP_TARGET_YEAR)


# ----------------------------------------------------- B: projections/filters

@query
def latest_wave(spark, d):
    train, _ = S.split_train_target(fx.pop_records(spark, d), POP_TRAIN_YEARS, POP_TARGET_YEAR)
    return C.latest_wave(train)


@query
def domain_filter(spark, d):
    return C.domain_filter(fx.pop_records(spark, d, "ood"), POP_ATTRS, POP_OOD_DOMAIN)


@query
def attribute_projection(spark, d):
    return C.attribute_projection(fx.pop_records(spark, d), POP_ATTRS)


@query
def stringify(spark, d):
    return C.stringify(fx.pop_records(spark, d))


# ------------------------------------------------------------ C/D: cells

@query(name="domain_grid")
def domain_grid_q(spark, d):
    """The full product grid, dense over all counts (zeros kept)."""
    grid = domain_grid(spark, POP_ATTRS, POP_DOMAIN, index_col="cell")
    counts = pop_cells(spark, d)
    return grid.join(counts, POP_ATTRS, "left").select(
        "cell", *POP_ATTRS, F.coalesce(F.col("n"), F.lit(0)).alias("n"))


@query
def cell_counts(spark, d):
    return C.cell_counts(fx.pop_weighted(spark, d), POP_ATTRS, POP_DOMAIN, by=["year"], weight_col="n")


@query
def marginal_dense(spark, d):
    zero = fx.pop_weighted(spark, d).where(F.col("o_orderpriority") != "5-LOW")
    cells = C.cell_counts(zero, POP_ATTRS, POP_DOMAIN, weight_col="n")
    return C.marginals(cells, POP_ATTRS, POP_DOMAIN).select("attr", "ord", "cat", "n")


@query
def marginals_all_rows(spark, d):
    cells = pop_cells(spark, d, "ood", POP_TARGET_YEAR, POP_OOD_DOMAIN)
    return rounded(C.marginals(cells, POP_ATTRS, POP_OOD_DOMAIN, denominator="all_rows")
                   .select("attr", "ord", "cat", "prop"))


@query
def marginals_in_domain(spark, d):
    cells = pop_cells(spark, d, "ood", None, POP_OOD_DOMAIN)
    return rounded(C.marginals(cells, POP_ATTRS, POP_OOD_DOMAIN, denominator="in_domain")
                   .select("attr", "ord", "cat", "prop"))


@query
def joint_k(spark, d):
    cells = pop_cells(spark, d, "ood", None, POP_OOD_DOMAIN)
    return rounded(C.joint(cells, PAIR3, POP_OOD_DOMAIN, dense=True))


@query
def pairwise_joint(spark, d):
    cells = pop_cells(spark, d)
    return rounded(C.pairwise_joint(cells, POP_ATTRS, POP_DOMAIN))


@query
def inferred_domain(spark, d):
    records = fx.pop_records(spark, d, "ood")
    return infer_domain(records.where(F.col("year") < POP_TARGET_YEAR), records.where(F.col("year") >= POP_TARGET_YEAR),
                        POP_ATTRS)


# ---------------------------------------------------------------- F: metrics

def _both_cells(spark, d, years):
    """``(year, attrs..., n, n_skew)``: base and skewed counts of the given years from one pass over lineitem."""
    w = fx.pop_weighted(spark, d, "both", years=years)
    return materialize(w.groupBy("year", *POP_ATTRS).agg(F.sum("n").alias("n"), F.sum("n_skew").alias("n_skew")))


def _side(cells, year, count="n"):
    out = cells.where(F.col("year") == year).select(*POP_ATTRS, F.col(count).alias("n"))
    return materialize(out.where(F.col("n") > 0))


def _syn_real(spark, d):
    cells = _both_cells(spark, d, [SYN_YEAR, POP_TARGET_YEAR])
    return _side(cells, SYN_YEAR, "n_skew"), _side(cells, POP_TARGET_YEAR)


def _targets_of(real):
    return materialize(FT.targets_from_marginals(C.marginals(real, POP_ATTRS, POP_DOMAIN), POP_ATTRS))


@query
def srmse_one(spark, d):
    syn, real = _syn_real(spark, d)
    return rounded(M.srmse(syn, real, ["l_returnflag"], POP_DOMAIN))


@query
def srmse_all(spark, d):
    syn, real = _syn_real(spark, d)
    return rounded(M.srmse(syn, real, POP_ATTRS, POP_DOMAIN))


@query
def jsd_one(spark, d):
    syn = pop_cells(spark, d, "base", SYN_YEAR)
    real_w = fx.pop_weighted(spark, d, years=[POP_TARGET_YEAR]).where(F.col("o_orderpriority") != "5-LOW")
    real = C.cell_counts(real_w, POP_ATTRS, POP_DOMAIN, weight_col="n")
    a = ["o_orderpriority"]
    return rounded(M.jsd(M._listwise(syn, a), M._listwise(real, a), a, len(POP_DOMAIN[a[0]])))


@query
def jsd_pairwise(spark, d):
    syn, real = _syn_real(spark, d)
    return rounded(M.jsd_pairwise(syn, real, POP_ATTRS, POP_DOMAIN))


@query
def jsd_full_joint(spark, d):
    syn, real = _syn_real(spark, d)
    return rounded(M.jsd_full_joint(syn, real, POP_ATTRS, POP_DOMAIN))


@query
def evaluate_suite(spark, d):
    syn, real = _syn_real(spark, d)
    return rounded(M.evaluate_suite(syn, real, POP_ATTRS, POP_DOMAIN))


# ------------------------------------------------------- sampling / fitting


POP_GRID = 450
SEED = 42
IPF_N = 10007
TRS_N = 100_003
TIGHT = 1e-12  # fits that SQL follows pass by pass are run to their fixed point


def pop_cells_idx(spark, d, variant="base", year=None, by=()):
    """POP cells keyed by grid index ``cell`` (all POP rows are in domain)."""
    w = fx.pop_weighted(spark, d, variant, years=None if year is None else [year])
    cells = C.cell_counts(w, POP_ATTRS, POP_DOMAIN, by=by, weight_col="n")
    return cells.withColumn("cell", cell_index(POP_ATTRS, POP_DOMAIN))


def pop_targets(spark, d, variant="base", year=POP_TARGET_YEAR):
    cells = pop_cells(spark, d, variant, year)
    marg = C.marginals(cells, POP_ATTRS, POP_DOMAIN, denominator="all_rows")
    return materialize(FT.targets_from_marginals(marg, POP_ATTRS))


def _pop_seed(spark, d, variant="base"):
    train = fx.pop_weighted(spark, d, variant, years=POP_TRAIN_YEARS)
    return materialize(FT.seed_table(train, POP_ATTRS, POP_DOMAIN, weight_col="n"))


def _seed_and_targets(spark, d):
    """Seed of the latest training wave and skewed targets from one pass over lineitem."""
    both = _both_cells(spark, d, [*POP_TRAIN_YEARS, POP_TARGET_YEAR])
    seed = FT.seed_from_year_cells(both, POP_ATTRS, POP_DOMAIN, POP_TRAIN_YEARS)
    return materialize(seed), _targets_of(_side(both, POP_TARGET_YEAR, "n_skew"))


def _fitted_shares(fitted, value_col, targets, by=()):
    """Fitted share of each category beside its target."""
    cells = fitted.select(*by, *POP_ATTRS, F.col(value_col).alias("n"))
    marg = C.marginals(cells, POP_ATTRS, POP_DOMAIN, by=by, denominator="all_rows")
    t = targets.select("attr", "cat", F.col("prop").alias("target"))
    return rounded(marg.join(t, ["attr", "cat"]).select(*by, "attr", "ord", "cat", "target", F.col("prop").alias("fitted")), 5)


@query
def seed_table(spark, d):
    train = fx.pop_weighted(spark, d, "ood", years=POP_TRAIN_YEARS)
    return FT.seed_table(train, POP_ATTRS, POP_OOD_DOMAIN, weight_col="n")


@query
def seed_scaled(spark, d):
    return rounded(FT.seed_scaled(_pop_seed(spark, d), IPF_N))


@query
def ipf_two_pass(spark, d):
    seed, targets = _seed_and_targets(spark, d)
    fit = FT.ipf(seed, targets, IPF_N, POP_ATTRS, POP_DOMAIN, tol=0.0, max_iter=2, rate_tol=0.0)
    return rounded(fit.select("cell", *POP_ATTRS, "fitted"))


@query
def ipf_fitted_marginals(spark, d):
    seed, targets = _seed_and_targets(spark, d)
    fit = FT.ipf(seed, targets, IPF_N, POP_ATTRS, POP_DOMAIN, tol=TIGHT, rate_tol=0.0)
    return _fitted_shares(fit, "fitted", targets)


@query
def trs_integerize(spark, d):
    fitted = FT.seed_scaled(_pop_seed(spark, d), IPF_N)
    return FT.trs_integerize(fitted, IPF_N, SEED, ["cell", *POP_ATTRS])


def _scaled_targets_counts(spark, d, factor):
    """Two IPF sweeps to all-row marginals (NULLs and out-of-domain rows lower them) times ``factor``;
    integer counts, and the records that expand from them."""
    cells = pop_cells(spark, d, "ood", POP_TARGET_YEAR, POP_OOD_DOMAIN)
    targets = FT.targets_from_marginals(C.marginals(cells, POP_ATTRS, POP_OOD_DOMAIN), POP_ATTRS)
    targets = materialize(targets.withColumn("prop", F.col("prop") * F.lit(float(factor))))
    seed = materialize(seed_table(spark, d))
    fit = FT.ipf(seed, targets, TRS_N, POP_ATTRS, POP_OOD_DOMAIN, tol=0.0, max_iter=2, rate_tol=0.0)
    counts = materialize(FT.trs_integerize(fit, TRS_N, SEED, ["cell", *POP_ATTRS]))
    records = FT.expand_cells(counts, ["cell", *POP_ATTRS])
    per_cell = records.groupBy(*POP_ATTRS).agg(F.count(F.lit(1)).alias("records"))
    return counts.join(per_cell, POP_ATTRS, "left").select(
        "cell", *POP_ATTRS, "count", F.coalesce("records", F.lit(0)).alias("records"))


@query
def trs_short_targets(spark, d):
    """Shares that sum to less than 1: many more draws than cells."""
    return _scaled_targets_counts(spark, d, 1.0)


@query
def trs_long_targets(spark, d):
    """Shares that sum to more than 1: nothing is drawn, every count is kept."""
    return _scaled_targets_counts(spark, d, 1.2)


@query
def expand_cells(spark, d):
    counts = trs_integerize(spark, d)
    return FT.expand_cells(counts, ["cell", *POP_ATTRS])


@query
def fitted_roundtrip(spark, d):
    seed, targets = _seed_and_targets(spark, d)
    fit = FT.ipf(seed, targets, IPF_N, POP_ATTRS, POP_DOMAIN, tol=0.0, max_iter=2, rate_tol=0.0)
    path = scratch_path(spark, "fitted")
    FT.save_fitted(fit, path)
    return rounded(FT.load_fitted(spark, path).select("cell", *POP_ATTRS, "fitted"))


@query
def rake_weights_two_pass(spark, d):
    cells, real = _syn_real(spark, d)
    fit = FT.rake(cells, _targets_of(real), max_iter=2, tol=0.0)
    return rounded(fit.select(*POP_ATTRS, "n", "w"))


@query
def rake_shares(spark, d):
    cells, real = _syn_real(spark, d)
    targets = _targets_of(real)
    fit = FT.rake(cells, targets, tol=TIGHT)
    return _fitted_shares(fit.withColumn("mass", F.col("n") * F.col("w")), "mass", targets)


@query
def rake_classic_shares(spark, d):
    """Weights of classic raking (normalised targets, fixed total)."""
    cells, real = _syn_real(spark, d)
    fit = FT.rake(cells, _targets_of(real), mode="classic", tol=TIGHT)
    return rounded(fit.select(*POP_ATTRS, "n", "w"), 5)


@query
def rake_grouped(spark, d):
    both = _both_cells(spark, d, [*POP_TRAIN_YEARS, POP_TARGET_YEAR])
    targets = _targets_of(_side(both, POP_TARGET_YEAR))
    cells = materialize(both.where(F.col("year").isin(POP_TRAIN_YEARS) & (F.col("n_skew") > 0)).select(
        "year", *POP_ATTRS, F.col("n_skew").alias("n")))
    # the same targets for every wave: one literal target row set per year
    tg = targets.select(F.explode(F.array(*[F.lit(y) for y in POP_TRAIN_YEARS])).alias("year"), "*")
    fit = FT.rake(cells, tg, by=["year"], tol=TIGHT)
    return rounded(fit.select("year", *POP_ATTRS, "n", "w"), 5)


@query
def weighted_draw(spark, d):
    cells = materialize(pop_cells_idx(spark, d))
    hits = SM.weighted_hits(cells.withColumn("mass", F.col("n")), "mass", 5000, SEED, ["cell"])
    return cells.join(hits, "cell").select("cell", *POP_ATTRS, "hits")


@query
def resample_multinomial(spark, d):
    cells = materialize(pop_cells_idx(spark, d, "skew"))
    w = F.array_position(F.array(*[F.lit(c) for c in POP_DOMAIN["l_returnflag"]]), F.col("l_returnflag"))
    cells = cells.withColumn("mass", F.col("n") * w)
    total = cells.agg(F.sum("n")).first()[0]
    hits = SM.weighted_hits(cells, "mass", int(total), SEED, ["cell"])
    return cells.join(hits, "cell").select("cell", *POP_ATTRS, "hits")


@query
def subsample_exact(spark, d):
    train = fx.pop_records(spark, d, with_rid=True, years=POP_TRAIN_YEARS)
    return SM.subsample_exact(train, 20000, SEED, ["rid"])


# --------------------------------------------------- G: text and validation


def gen_n(spark, d) -> int:
    """Records asked of the generated texts: half the texts, so the cut falls inside the table at any scale."""
    return max(1, fx.table(spark, d, "orders").count() // 2)


def _cen(spark, d):
    return fx.cen_records(spark, d).select("id", "year", *CENSUS_ATTRS)


@query
def serialize_plain(spark, d):
    cen = _cen(spark, d)
    return cen.select("id", TX.serialize(cen, CENSUS_ATTRS, key_col="id").alias("text"))


@query
def serialize_permuted(spark, d):
    cen = _cen(spark, d)
    return cen.select("id", TX.serialize(cen, CENSUS_ATTRS, key_col="id", permute=True, seed=SEED).alias("text"))


@query
def serialize_era(spark, d):
    cen = _cen(spark, d)
    return cen.select("id", TX.serialize(cen, CENSUS_ATTRS, key_col="id", use_era_context=True).alias("text"))


@query
def era_prefix(spark, d):
    years = _cen(spark, d).select("year").distinct()
    return years.select("year", TX.era_prefix(F.col("year")).alias("prefix"))


@query
def era_join(spark, d):
    cen = _cen(spark, d).select("id", "year")
    return cen.join(F.broadcast(TX.era_df(spark)), "year", "left").select("id", "year", "narrative")


@query
def corpus_train(spark, d):
    cen = _cen(spark, d).where(F.col("year").isin(TRAIN_YEARS))
    return cen.select("id", TX.serialize(cen, key_col="id", permute=True, seed=SEED).alias("text"))


@query
def corpus_val(spark, d):
    cen = _cen(spark, d).where(F.col("year") == TARGET_YEAR)
    return cen.select("id", TX.serialize(cen, key_col="id").alias("text"))


@query
def prompt_table(spark, d):
    cen = _cen(spark, d)
    conds = [("sex", F.col("sex")), ("age_group", F.col("age_group"))]
    return cen.select("id", TX.generation_prefix(F.col("year"), conditions=conds).alias("prompt"))


@query
def text_corpus(spark, d):
    """Half of the training records, drawn exactly, as training texts with their era."""
    train = _cen(spark, d).where(F.col("year").isin(TRAIN_YEARS))
    return PM.text_corpus(train, gen_n(spark, d) // 2, "id", CENSUS_ATTRS, seed=SEED, use_era_context=True)


@query
def prompt_batch(spark, d):
    """Prompts for as many texts of each year, sex and age group as there are records."""
    specs = PM.prompt_specs(_cen(spark, d), ["sex", "age_group"])
    return PM.prompt_batch(specs, use_era_context=True)


def _gen(spark, d):
    return fx.gen_texts(spark, d)


@query
def parse_records(spark, d):
    return TX.parse_records(_gen(spark, d), "text", CENSUS_ATTRS, keep=["id"])


@query
def fuzzy_match(spark, d):
    parsed = TX.parse_records(_gen(spark, d), "text", CENSUS_ATTRS)
    kv = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in CENSUS_ATTRS]))
    vals = parsed.select(kv.alias("kv")).select("kv.*").where(F.col("value").isNotNull()).distinct()
    m = F.lit(None).cast("string")
    for a in CENSUS_ATTRS:
        m = F.when(F.col("attr") == a, TX.fuzzy_match(F.col("value"), CENSUS_DOMAIN[a])).otherwise(m)
    exact = F.lit(False)
    for a in CENSUS_ATTRS:
        exact = exact | ((F.col("attr") == a) & F.col("value").isin(CENSUS_DOMAIN[a]))
    return vals.where(~exact).select("attr", "value", m.alias("matched"))


@query
def structural_zero_violations(spark, d):
    return V.violation_table(_cen(spark, d), keep=["id"])


@query
def violation_counts(spark, d):
    return V.violation_counts(_cen(spark, d))


def _validated(spark, d):
    return V.validate_generated(_gen(spark, d), keep=["id", "batch", "pos"])


@query
def validate_generated(spark, d):
    return V.accepted(_validated(spark, d)).select("id", *CENSUS_ATTRS)


@query
def reject_reasons(spark, d):
    v = _validated(spark, d)
    return v.groupBy(F.coalesce(F.col("reject_reason"), F.lit("accepted")).alias("reason")) \
            .agg(F.count(F.lit(1)).alias("n"))


def _validated_once(spark, d, n):
    """Only the batches that may be read, parsed once."""
    texts = V.first_batches(_gen(spark, d), n)
    return stash(V.validate_generated(texts, keep=["id", "batch", "pos"]), "validated")


@query
def take_accepted(spark, d):
    n = gen_n(spark, d)
    return V.take_accepted(_validated_once(spark, d, n), n).select("batch", "pos", "id", *CENSUS_ATTRS)


@query
def generation_stats(spark, d):
    n = gen_n(spark, d)
    return rounded(V.generation_stats(_validated_once(spark, d, n), n))


# ----------------------------------------- E6/E8, resampling, method runs


POP_N = 5000


def _pop_train(spark, d, variant="base"):
    return fx.pop_weighted(spark, d, variant, years=POP_TRAIN_YEARS)


def _pop_target(spark, d, variant="base"):
    return fx.pop_weighted(spark, d, variant, years=[POP_TARGET_YEAR])


@query
def conditional_sample(spark, d):
    s = EmpiricalSampler.fit(_pop_train(spark, d), POP_ATTRS, weight_col="n")
    return s.sample_counts(POP_N, 1998, SEED)


@query
def conditional_sample_pooled(spark, d):
    s = EmpiricalSampler.fit(_pop_train(spark, d), POP_ATTRS, weight_col="n")
    return s.sample_counts(POP_N, POP_TARGET_YEAR, SEED)


@query
def rake_resample(spark, d):
    records = fx.pop_records(spark, d, "skew", years=[SYN_YEAR]).select(*POP_ATTRS)
    return PM.rake_resample(records, pop_targets(spark, d), POP_ATTRS, seed=SEED, tol=TIGHT)


@query
def oversample_rake(spark, d):
    s = EmpiricalSampler.fit(_pop_train(spark, d), POP_ATTRS, weight_col="n")
    pool = stash(s.sample(POP_N * 4, POP_TARGET_YEAR, SEED), "pool")
    return PM.rake_resample(pool, pop_targets(spark, d), POP_ATTRS, seed=SEED, tol=TIGHT)


def _no_time(res):
    return rounded(res.drop("time_sec"))


@query
def method_ipf(spark, d):
    _, res = PM.run_ipf_population(fx.pop_weighted(spark, d), POP_TRAIN_YEARS, POP_TARGET_YEAR, POP_N,
                                   POP_ATTRS, POP_DOMAIN, seed=SEED, weight_col="n", tol=TIGHT)
    return _no_time(res)


@query
def method_conditional(spark, d):
    _, res = PM.run_conditional(_pop_train(spark, d, "skew"), _pop_target(spark, d), POP_TARGET_YEAR, POP_N,
                                POP_ATTRS, POP_DOMAIN, seed=SEED, weight_col="n", tol=TIGHT)
    return _no_time(res)


@query
def method_text(spark, d):
    target = _cen(spark, d).where(F.col("year") == TARGET_YEAR)
    _, res = PM.run_text(_gen(spark, d), target, gen_n(spark, d), CENSUS_ATTRS, CENSUS_DOMAIN, seed=SEED, tol=TIGHT)
    return _no_time(res)


@query
def comparison_table(spark, d):
    rows = [method_ipf(spark, d), method_conditional(spark, d), method_text(spark, d)]
    return rounded(PM.comparison_table(rows, with_time=False))


@query
def ipf_grouped(spark, d):
    """IPF for every training wave at once: per-year seeds, one cogrouped job."""
    both = _both_cells(spark, d, [*POP_TRAIN_YEARS, POP_TARGET_YEAR])
    targets = _targets_of(_side(both, POP_TARGET_YEAR, "n_skew"))
    yc = materialize(both.where(F.col("year").isin(POP_TRAIN_YEARS)).select("year", *POP_ATTRS, "n"))
    grid = domain_grid(spark, POP_ATTRS, POP_DOMAIN, index_col="cell")
    years = yc.select("year").distinct()
    dense = years.select("year", F.explode(F.array(*[F.lit(i) for i in range(POP_GRID)])).alias("cell")) \
        .join(F.broadcast(grid), "cell")
    seeds = dense.join(yc, ["year", *POP_ATTRS], "left").select(
        "year", "cell", *POP_ATTRS, (F.coalesce(F.col("n"), F.lit(0)).cast("double") + 0.5).alias("seed"))
    tg = targets.select(F.explode(F.array(*[F.lit(y) for y in POP_TRAIN_YEARS])).alias("year"), "*")
    fit = FT.ipf(seeds, tg, IPF_N, POP_ATTRS, POP_DOMAIN, by=["year"], tol=TIGHT, rate_tol=0.0)
    return rounded(fit.select("year", "cell", *POP_ATTRS, "fitted"), 4)


# ------------------------------------------- fits without a grid, stored factors

def _implicit(spark, d, **options):
    """POP's latest training wave fitted to skewed targets; the grid is not enumerated."""
    both = _both_cells(spark, d, [*POP_TRAIN_YEARS, POP_TARGET_YEAR])
    train = C.latest_wave(both.where(F.col("year").isin(POP_TRAIN_YEARS)))
    targets = _targets_of(_side(both, POP_TARGET_YEAR, "n_skew"))
    return IM.ipf_implicit(train.select(*POP_ATTRS, "n"), targets, IPF_N, POP_ATTRS, POP_DOMAIN, rate_tol=0.0, **options)


@query
def ipf_implicit(spark, d):
    """Two sweeps over seen cells and factors, valued on every cell of the grid."""
    fit = _implicit(spark, d, tol=0.0, max_iter=2)
    grid = fit.value(domain_grid(spark, POP_ATTRS, POP_DOMAIN, index_col="cell"))
    return rounded(grid.select("cell", *POP_ATTRS, "fitted"))


@query
def ipf_implicit_sample(spark, d):
    """Independent draws from that fit: seen cells by their records, others attribute by attribute."""
    drawn = _implicit(spark, d, tol=0.0, max_iter=2).sample(IPF_N, SEED)
    return drawn.groupBy(*POP_ATTRS).agg(F.count(F.lit(1)).alias("hits"))


@query
def ipf_implicit_wide(spark, d):
    """The latest training wave fitted over a product of 4.5e12 cells: its marginals beside the targets."""
    records = fx.wide_records(spark, d, [*POP_TRAIN_YEARS, POP_TARGET_YEAR])
    attrs, domain = list(fx.WIDE_DOMAIN), fx.WIDE_DOMAIN
    cells = materialize(C.cell_counts(records, attrs, domain, by=["year"]))
    train = C.latest_wave(cells.where(F.col("year").isin(POP_TRAIN_YEARS)))
    targets = materialize(FT.targets_from_marginals(C.marginals(
        cells.where(F.col("year") == POP_TARGET_YEAR), attrs, domain), attrs))
    fitted = IM.ipf_implicit(train.select(*attrs, "n"), targets, IPF_N, attrs, domain, tol=1e-9, rate_tol=0.0).marginals()
    goal = targets.select("attr", "cat", F.col("prop").alias("target"))
    return rounded(fitted.join(goal, ["attr", "cat"]).select(
        "attr", "ord", "cat", "target", (F.col("fitted") / IPF_N).alias("fitted")), 5)


@query
def factors_apply(spark, d):
    """Factors raked on one wave, stored, loaded and applied to the records of another."""
    cells, real = _syn_real(spark, d)
    path = FC.save_factors(FT.rake_factors(cells, _targets_of(real), tol=TIGHT), scratch_path(spark, "factors"))
    records = fx.pop_records(spark, d, years=[SYN_YEAR - 1])
    weighed = FC.apply_factors(records, FC.load_factors(spark, path))
    out = weighed.groupBy(*POP_ATTRS).agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"))
    return rounded(out, 5)


def _misspelt(spark, d):
    """Customer names as orders might give them: as they are, in capitals, with a suffix, cut off, cut off too short."""
    o, c = fx.table(spark, d, "orders"), fx.table(spark, d, "customer")
    name, case = F.col("c_name"), F.col("o_orderkey") % 5
    value = (F.when(case == 1, F.upper(name)).when(case == 2, F.concat(name, F.lit(" jr"))).when(case == 3, F.substring(name, 1, 15))
             .when(case == 4, F.substring(name, 1, 2)).otherwise(name))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("c_name").alias("attr"), value.alias("value"))


@query
def fuzzy_inferred(spark, d):
    """Closest categories by the prefix index, in a domain as large as the customer table."""
    domain = infer_domain(fx.table(spark, d, "customer"), None, ["c_name"])
    return MT.match_values(_misspelt(spark, d), domain)
