"""Method compositions and the comparison table (the reference's run_* flow).

Every method returns ``(records, result)``: the synthetic records (lazy,
attributes only) and a one-row result DataFrame.  Evaluation always goes
records -> cell table (one aggregation, checkpointed) -> metrics.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.domain import DEFAULT_REGION, DEFAULT_SEED, Domain
from popweave.functions.hashing import hash_uniform
from popweave.functions.text import generation_prompt, serialize
from popweave.operators.cells import cell_counts, marginals
from popweave.operators.conditional import EmpiricalSampler
from popweave.operators.fitting import (expand_cells, ipf, rake, seed_from_year_cells, seed_table, targets_df,
                                        targets_from_marginals, trs_integerize)
from popweave.operators.metrics import evaluate_suite
from popweave.operators.sampling import expand, numbered_members, subsample_exact, weighted_draws
from popweave.operators.validate import first_batches, generation_stats, take_accepted, validate_generated
from popweave.session import materialize, stash

RESULT_COLS = ["method", "time_sec", "srmse_avg", "jsd_full_joint", "srmse_avg_ipf", "jsd_full_joint_ipf"]


def target_marginals(target_cells: DataFrame, attrs: Sequence[str], domain: Domain) -> DataFrame:
    """Targets as the reference builds them: shares over all target rows."""
    cells = materialize(target_cells)
    return materialize(targets_from_marginals(marginals(cells, attrs, domain, denominator="all_rows"), attrs))


def evaluate_records(syn: DataFrame, real_cells: DataFrame, attrs: Sequence[str], domain: Domain) -> DataFrame:
    syn_cells = materialize(cell_counts(syn, attrs, domain))
    return evaluate_suite(syn_cells, real_cells, attrs, domain)


def rake_resample(records: DataFrame, targets, attrs: Sequence[str] | None = None, *, seed: int = DEFAULT_SEED,
                  mode: str = "sequential", max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """Rake the records to the targets, then draw as many records as there
    are inputs with p ∝ weight (with replacement).  Empty in -> empty out.

    Every attribute of the targets is raked (those in ``attrs``, if given, and
    in the records); with none left, records are drawn uniformly.  The fit
    runs on cells keyed by the raked attributes only, with values outside the
    targets folded to NULL (they are never adjusted), so the fitted table is
    bounded by the target sizes whatever else the records hold.  Two stages: a
    draw picks a cell by its weight, then a second uniform picks one of the
    cell's records by its number in the cell.  Records keep all their columns
    and are never grouped as a whole; which of a cell's records are drawn goes
    by the order in which these are stored.  Draws and records are both of
    record scale and are merged: sorted by cell, records take so little room on
    disk that Spark would take them for a table to broadcast.
    """
    spark = records.sparkSession
    tdf = targets if isinstance(targets, DataFrame) else targets_df(spark, targets)
    # target categories per attribute: Σ target sizes values, the only driver-side data
    tcats: dict[str, list[str]] = {}
    for r in tdf.select("attr", "attr_pos", "cat").orderBy("attr_pos").collect():
        tcats.setdefault(r["attr"], []).append(r["cat"])
    cols = list(records.columns)
    keys = [a for a in tcats if a in cols and (attrs is None or a in attrs)]
    value = {a: F.col(f"`{a}`").cast("string") for a in keys}
    folded = [F.when(value[a].isin(tcats[a]), value[a]).alias(a) for a in keys]
    cell = F.md5(F.to_json(F.struct(*folded))) if keys else F.lit("")
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), cell.alias("_rid"),
                          *[f.alias(f"_v_{a}") for f, a in zip(folded, keys, strict=True)])
    members = stash(numbered_members(rows, "_rid"), "numbered-members")
    cells = materialize(members.groupBy("_rid", *[F.col(f"_v_{a}").alias(a) for a in keys]).agg(F.count(F.lit(1)).alias("n")))
    total = int(cells.agg(F.sum("n")).first()[0] or 0)
    if total == 0:
        return records.limit(0)
    fit = rake(cells, tdf.where(F.col("attr").isin(keys)), mode=mode, max_iter=max_iter, tol=tol) if keys else \
        cells.withColumn("w", F.lit(1.0))
    fit = materialize(fit.select("_rid", "n", (F.col("n") * F.col("w")).alias("_mass")))
    drawn = weighted_draws(fit, "_mass", total, seed, "_rid").join(fit.select("_rid", "n"), "_rid")
    picked = F.least(F.floor(hash_uniform(seed, F.lit("member"), "draw") * F.col("n")).cast("long"), F.col("n") - 1)
    out = drawn.select("_rid", picked.alias("_member")).join(
        members.select("_rid", "_member", "_row").hint("merge"), ["_rid", "_member"])
    return out.select(*[F.col("_row").getField(c).alias(c) for c in cols])


def _row(spark, method: str, elapsed: float, raw: DataFrame, raked: DataFrame | None) -> DataFrame:
    r = raw.select(F.lit(method).alias("method"), F.lit(float(elapsed)).alias("time_sec"),
                   "srmse_avg", "jsd_full_joint", "jsd_pairwise_avg")
    if raked is None:
        return r.select(*RESULT_COLS[:4], F.lit(None).cast("double").alias("srmse_avg_ipf"),
                        F.lit(None).cast("double").alias("jsd_full_joint_ipf"), "jsd_pairwise_avg")
    k = raked.select(F.col("srmse_avg").alias("srmse_avg_ipf"), F.col("jsd_full_joint").alias("jsd_full_joint_ipf"))
    return r.unionByName(k, allowMissingColumns=True).agg(
        F.first("method", ignorenulls=True).alias("method"), F.first("time_sec", ignorenulls=True).alias("time_sec"),
        F.first("srmse_avg", ignorenulls=True).alias("srmse_avg"),
        F.first("jsd_full_joint", ignorenulls=True).alias("jsd_full_joint"),
        F.first("srmse_avg_ipf", ignorenulls=True).alias("srmse_avg_ipf"),
        F.first("jsd_full_joint_ipf", ignorenulls=True).alias("jsd_full_joint_ipf"),
        F.first("jsd_pairwise_avg", ignorenulls=True).alias("jsd_pairwise_avg"))


def run_ipf(train: DataFrame, target: DataFrame, n: int, attrs: Sequence[str], domain: Domain, *,
            seed: int = DEFAULT_SEED, weight_col: str | None = None, year_col: str = "year"):
    """Seed (latest wave, +0.5) -> IPF to target shares -> TRS -> records -> evaluate."""
    t0 = time.time()
    real = materialize(cell_counts(target, attrs, domain, weight_col=weight_col))
    targets = target_marginals(real, attrs, domain)
    s = seed_table(train, attrs, domain, weight_col=weight_col, year_col=year_col)
    fitted = ipf(s, targets, n, attrs, domain)
    counts = materialize(trs_integerize(fitted, n, seed, ["cell", *attrs]))
    syn_cells = counts.select(*attrs, F.col("count").alias("n"))
    syn = expand_cells(counts, ["cell", *attrs]).select(*attrs)
    elapsed = time.time() - t0
    res = evaluate_suite(syn_cells, real, attrs, domain)
    return syn, _row(train.sparkSession, "IPF", elapsed, res, None)


def year_cells(population: DataFrame, attrs: Sequence[str], domain: Domain, *, year_col: str = "year",
               weight_col: str | None = None) -> DataFrame:
    """One aggregation of the whole population by (year, cell), checkpointed.

    Training seed, target marginals, evaluation cells and the per-year
    sampler are all roll-ups of this table, so records are read once.
    """
    return materialize(cell_counts(population, attrs, domain, by=[year_col], weight_col=weight_col))


def run_ipf_population(population: DataFrame, train_years: Sequence[int], target_year: int, n: int,
                       attrs: Sequence[str], domain: Domain, *, seed: int = DEFAULT_SEED,
                       weight_col: str | None = None, year_col: str = "year", tol: float = 1e-6):
    """``run_ipf`` on one population table: a single pass over the records."""
    t0 = time.time()
    yc = year_cells(population, attrs, domain, year_col=year_col, weight_col=weight_col)
    real = materialize(yc.where(F.col(year_col) == int(target_year)).drop(year_col))
    targets = target_marginals(real, attrs, domain)
    s = seed_from_year_cells(yc, attrs, domain, train_years, year_col=year_col)
    fitted = ipf(s, targets, n, attrs, domain, tol=tol)
    counts = materialize(trs_integerize(fitted, n, seed, ["cell", *attrs]))
    syn_cells = counts.select(*attrs, F.col("count").alias("n"))
    syn = expand_cells(counts, ["cell", *attrs]).select(*attrs)
    elapsed = time.time() - t0
    return syn, _row(population.sparkSession, "IPF", elapsed, evaluate_suite(syn_cells, real, attrs, domain), None)


def run_conditional(train: DataFrame, target: DataFrame, target_year: int, n: int, attrs: Sequence[str],
                    domain: Domain, *, seed: int = DEFAULT_SEED, weight_col: str | None = None, tol: float = 1e-6):
    """Empirical year-conditioned sampler; raw and raked evaluation."""
    t0 = time.time()
    sampler = EmpiricalSampler.fit(train, attrs, weight_col=weight_col)
    syn = stash(sampler.sample(n, target_year, seed), "sampled")
    elapsed = time.time() - t0
    real = materialize(cell_counts(target, attrs, domain, weight_col=weight_col))
    targets = target_marginals(real, attrs, domain)
    raked = rake_resample(syn, targets, attrs, seed=seed, tol=tol)
    res = _row(train.sparkSession, "Conditional", elapsed, evaluate_records(syn, real, attrs, domain),
               evaluate_records(raked, real, attrs, domain))
    return syn, res


def text_corpus(train: DataFrame, n: int, key_col: str, attrs: Sequence[str], *, seed: int = DEFAULT_SEED,
                use_era_context: bool = False) -> DataFrame:
    """Training texts of the text method: an exact seeded subsample, serialized with permuted attributes."""
    sample = subsample_exact(train, n, seed, [key_col])
    return sample.select(key_col, serialize(sample, attrs, key_col=key_col, permute=True, seed=seed,
                                            use_era_context=use_era_context).alias("text"))


def prompt_specs(records: DataFrame, conditions: Sequence[str], *, year_col: str = "year",
                 region: str = DEFAULT_REGION) -> DataFrame:
    """``(year, region, conditions MAP, repeats)``: each year and set of values that the records have, with their number.

    A null value is no condition.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in conditions])
    held = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    counted = records.groupBy(year_col, *conditions).agg(F.count(F.lit(1)).alias("repeats"))
    return counted.select(F.col(year_col).cast("int").alias("year"), F.lit(region).alias("region"), held.alias("conditions"), "repeats")


def prompt_batch(specs: DataFrame, *, batch_size: int = 64, use_era_context: bool = False) -> DataFrame:
    """``(batch, pos, prompt)``: the prompt of each row of ``prompt_specs``, as often as it says, in order of year and prompt."""
    prompts = specs.select("year", generation_prompt(F.col("year"), F.col("region"), F.col("conditions"),
                                                     use_era_context=use_era_context).alias("prompt"), "repeats")
    rows = expand(materialize(prompts), "repeats", ["prompt"], order_cols=["year", "prompt"])
    return rows.select(F.floor(F.col("record") / batch_size).cast("long").alias("batch"),
                       (F.col("record") % batch_size).cast("int").alias("pos"), "prompt")


def run_text(texts: DataFrame, target: DataFrame, n: int, attrs: Sequence[str], domain: Domain, *,
             oversample_factor: int = 1, seed: int = DEFAULT_SEED, batch_size: int = 64,
             label: str = "Text", tol: float = 1e-6):
    """Validate generated texts, keep the first n·factor accepted, rake the pool."""
    t0 = time.time()
    gen_count = n * oversample_factor
    # Only the batches that may be read are parsed, once.
    validated = stash(validate_generated(first_batches(texts, gen_count, batch_size), keep=["batch", "pos"], attrs=attrs,
                                         domain=domain), "validated")
    pool = stash(take_accepted(validated, gen_count, batch_size=batch_size).select(*attrs), "accepted")
    elapsed = time.time() - t0
    stats = generation_stats(validated, gen_count, batch_size=batch_size)
    real = materialize(cell_counts(target, attrs, domain))
    targets = target_marginals(real, attrs, domain)
    raked = rake_resample(pool, targets, attrs, seed=seed, tol=tol)
    res = _row(texts.sparkSession, label, elapsed, evaluate_records(pool, real, attrs, domain),
               evaluate_records(raked, real, attrs, domain))
    res = res.unionByName(stats.select(F.col("accepted").alias("n_generated"),
                                       F.col("fill_rate").alias("parse_rate")), allowMissingColumns=True) \
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in RESULT_COLS + ["jsd_pairwise_avg", "n_generated",
                                                                          "parse_rate"]])
    return pool, res


def comparison_table(results: Sequence[DataFrame], *, with_time: bool = True) -> DataFrame:
    """One row per method in run order; ``+IPF`` columns fall back to raw."""
    out = None
    for i, r in enumerate(results):
        r = r.withColumn("_order", F.lit(i))
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    cols = [F.col("method"),
            *([F.col("time_sec")] if with_time else []),
            F.col("srmse_avg"), F.col("jsd_full_joint"),
            F.coalesce("srmse_avg_ipf", "srmse_avg").alias("srmse_avg_ipf"),
            F.coalesce("jsd_full_joint_ipf", "jsd_full_joint").alias("jsd_full_joint_ipf")]
    return out.orderBy("_order").select(*cols)


__all__ = ["run_ipf", "run_ipf_population", "year_cells", "run_conditional", "run_text", "comparison_table", "rake_resample", "target_marginals",
           "evaluate_records"]
