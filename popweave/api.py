"""Entry points shaped like the reference's, over the DataFrame operators.

Same names and arguments where they make sense on Spark; every call takes
and returns DataFrames (marginals are ``(attr, ord, cat, prop)`` tables
instead of dicts of Series; results are one-row DataFrames instead of
dicts).  Nothing here holds data on the driver beyond per-category numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.domain import ALL_YEARS, DEFAULT_REGION, DEFAULT_SEED, TARGET_YEAR, TRAIN_YEARS, resolve
from popweave.functions import text as TX
from popweave.functions.hashing import hash_uniform
from popweave.functions.rules import feasible
from popweave.operators import cells as C
from popweave.operators import fitting as FT
from popweave.operators import metrics as M
from popweave.operators.conditional import EmpiricalSampler
from popweave.operators.validate import first_batches, take_accepted, validate_generated
from popweave.plans import methods as PM
from popweave.session import materialize, stash
from popweave.sources import scans as S

# --- fixed values: input file names -----------------------------------------
COMBINED_FILE = "census_harmonized_all.parquet"
YEAR_FILE = "census_harmonized_{year}.parquet"
# --- end fixed values --------------------------------------------------------


def load_data(spark: SparkSession, data_dir: str = "data", train_years: Sequence[int] = TRAIN_YEARS,
              target_year: int = TARGET_YEAR) -> tuple[DataFrame, DataFrame, int]:
    """Combined file if present, else the per-year files; then the split."""
    combined = f"{data_dir}/{COMBINED_FILE}"
    if S.path_exists(spark, combined):
        df = S.read_combined(spark, combined)
    else:
        df = S.read_per_year(spark, lambda y: f"{data_dir}/{YEAR_FILE.format(year=y)}", ALL_YEARS)
    train, target = S.split_train_target(df, train_years, target_year)
    return train, target, target_year


def compute_marginals(df: DataFrame, attributes: Sequence[str] | None = None,
                      category_map: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Shares over all rows: ``(attr, ord, cat, prop)`` (targets for IPF/raking)."""
    attrs, dom = resolve(attributes, category_map)
    cells = materialize(C.cell_counts(df, attrs, dom))
    return materialize(FT.targets_from_marginals(C.marginals(cells, attrs, dom), attrs)
                       .select("attr", "attr_pos", "cat", "cat_pos", "prop"))


class IPFSynthesizer:
    """Seed from the latest wave (+0.5 smoothing), IPF to one-way targets,
    truncate-replicate-sample integerization, expansion to records."""

    def __init__(self, attributes: Sequence[str] | None = None,
                 category_map: Mapping[str, Sequence[str]] | None = None, seed: int = DEFAULT_SEED):
        self.attributes, self.category_map = resolve(attributes, category_map)
        self.seed = seed
        self._seed_table: DataFrame | None = None

    def fit(self, train_df: DataFrame) -> "IPFSynthesizer":
        self._seed_table = materialize(FT.seed_table(train_df, self.attributes, self.category_map))
        return self

    def generate(self, n_samples: int, target_marginals=None, shuffle: bool = False) -> DataFrame:
        """n records; ``shuffle`` orders them by a seeded hash of the record
        index (a distributed range-partitioned sort; order carries no data)."""
        if self._seed_table is None:
            raise RuntimeError("Must call fit() first.")
        if target_marginals is not None:
            fitted = FT.ipf(self._seed_table, target_marginals, n_samples, self.attributes, self.category_map)
        else:
            fitted = FT.seed_scaled(self._seed_table, n_samples)
        counts = FT.trs_integerize(fitted, n_samples, self.seed, ["cell", *self.attributes])
        recs = FT.expand_cells(counts, ["cell", *self.attributes])
        if shuffle:
            recs = recs.orderBy(hash_uniform(self.seed, "record"), "record")
        return recs.select(*self.attributes)

    compute_marginals = staticmethod(compute_marginals)


class ConditionalSampler:
    """Year-conditioned generator contract (fit, then generate n rows for a
    year; unseen year -> pooled).  The year is dropped from the output."""

    def __init__(self, attributes: Sequence[str] | None = None, seed: int = DEFAULT_SEED):
        self.attributes, _ = resolve(attributes, None)
        self.seed = seed
        self._sampler: EmpiricalSampler | None = None

    def fit(self, train_df: DataFrame) -> "ConditionalSampler":
        attrs = [a for a in self.attributes if a in train_df.columns]
        self._sampler = EmpiricalSampler.fit(train_df, attrs)
        return self

    def generate(self, n_samples: int, target_year: int | None = None) -> DataFrame:
        if self._sampler is None:
            raise RuntimeError("Must call fit() first.")
        return self._sampler.sample(n_samples, target_year, self.seed)


def _cells_pair(syn_df, real_df, attributes, category_map):
    attrs, dom = resolve(attributes, category_map)
    return (materialize(C.cell_counts(syn_df, attrs, dom)), materialize(C.cell_counts(real_df, attrs, dom)),
            attrs, dom)


def compute_all_srmse(syn_df, real_df, attributes=None, category_map=None) -> DataFrame:
    s, r, attrs, dom = _cells_pair(syn_df, real_df, attributes, category_map)
    return M.srmse(s, r, attrs, dom)


def compute_pairwise_jsd(syn_df, real_df, attributes=None, category_map=None) -> DataFrame:
    s, r, attrs, dom = _cells_pair(syn_df, real_df, attributes, category_map)
    return M.jsd_pairwise(s, r, attrs, dom)


def compute_full_joint_jsd(syn_df, real_df, attributes=None, category_map=None) -> DataFrame:
    s, r, attrs, dom = _cells_pair(syn_df, real_df, attributes, category_map)
    return M.jsd_full_joint(s, r, attrs, dom)


def compute_srmse(syn_df: DataFrame, real_df: DataFrame, attribute: str, categories: Sequence[str]) -> DataFrame:
    """SRMSE of one attribute: ``(attr, srmse)``."""
    dom = {attribute: [str(c) for c in categories]}
    s, r, attrs, dom = _cells_pair(syn_df, real_df, [attribute], dom)
    return M.srmse(s, r, attrs, dom)


def compute_jsd(p_counts: DataFrame, q_counts: DataFrame, keys: Sequence[str], grid: int, n: str = "n") -> DataFrame:
    """Jensen-Shannon divergence ``(jsd)`` of two count tables over a grid of ``grid`` cells."""
    return M.jsd(p_counts, q_counts, keys, grid, n=n)


def evaluate(syn_df: DataFrame, real_df: DataFrame, attributes=None, category_map=None) -> DataFrame:
    """One row: ``srmse_avg, jsd_pairwise_avg, jsd_full_joint, srmse_per_attr`` (a map)."""
    s, r, attrs, dom = _cells_pair(syn_df, real_df, attributes, category_map)
    return M.evaluate_suite(s, r, attrs, dom, per_attr=True)


def ipf_reweight(syn_df: DataFrame, target_marginals, max_iter: int = 100, tol: float = 1e-6,
                 seed: int = DEFAULT_SEED, attributes=None) -> DataFrame:
    """Rake (sequential rule) every attribute of the targets that the records
    have, then resample as many rows as the input (uniformly without targets)."""
    return PM.rake_resample(syn_df, target_marginals, attributes or None, seed=seed, max_iter=max_iter, tol=tol)


def serialize_dataframe(df: DataFrame, year_col: str = "year", region: str = DEFAULT_REGION, permute: bool = True,
                        seed: int = DEFAULT_SEED, use_era_context: bool = False,
                        key_col: str | None = None) -> DataFrame:
    """``(text)`` per row (plus ``key_col`` when given; it is not serialized)."""
    cols = [c for c in df.columns if c not in (year_col, key_col)]
    keyed = df
    if permute and key_col is None:
        # No key: each row's order hashes its place, which depends on how the input is partitioned.
        keyed = df.withColumn("_row_id", F.monotonically_increasing_id())
    text = TX.serialize(keyed, cols, year_col=year_col, region=region, permute=permute, seed=seed,
                        key_col=key_col or "_row_id", use_era_context=use_era_context)
    return keyed.select(*([key_col] if key_col else []), text.alias("text"))


def check_record_feasibility(df: DataFrame, out: str = "feasible") -> DataFrame:
    """``df`` with whether each record breaks no structural-zero rule."""
    return df.withColumn(out, feasible())


def build_generation_prefix(year: Column, region: str = DEFAULT_REGION, conditions=()) -> Column:
    return TX.generation_prefix(year, region, conditions)


def build_era_prefix(year: Column, region: str = DEFAULT_REGION) -> Column:
    return TX.era_prefix(year, region)


def parse_records(df: DataFrame, text_col: str = "text", attributes=None, keep: Sequence[str] = ()) -> DataFrame:
    attrs, _ = resolve(attributes, None)
    return TX.parse_records(df, text_col, attrs, keep=keep)


def accept_generated(texts: DataFrame, n_samples: int, *, batch_size: int = 64, attributes=None,
                     category_map=None) -> DataFrame:
    """Validated records, first n in (batch, pos) order (texts need batch/pos)."""
    attrs, dom = resolve(attributes, category_map)
    read = first_batches(texts, n_samples, batch_size)
    v = stash(validate_generated(read, keep=["batch", "pos"], attrs=attrs, domain=dom), "validated")
    return take_accepted(v, n_samples, batch_size=batch_size).select(*attrs)


def run_all(spark: SparkSession, data_dir: str = "data", methods: Sequence[str] = ("ipf", "conditional"),
            n_samples: int = 5000, generated_texts: DataFrame | None = None, oversample: int = 1) -> DataFrame:
    """The comparison table over the chosen methods, in run order."""
    train, target, year = load_data(spark, data_dir)
    attrs, dom = resolve(None, None)
    rows = []
    if "ipf" in methods:
        rows.append(PM.run_ipf(train, target, n_samples, attrs, dom)[1])
    if "conditional" in methods:
        rows.append(PM.run_conditional(train, target, year, n_samples, attrs, dom)[1])
    if "text" in methods and generated_texts is not None:
        rows.append(PM.run_text(generated_texts, target, n_samples, attrs, dom, oversample_factor=oversample)[1])
    return PM.comparison_table(rows)


__all__ = ["load_data", "compute_marginals", "IPFSynthesizer", "ConditionalSampler", "evaluate",
           "compute_all_srmse", "compute_pairwise_jsd", "compute_full_joint_jsd", "ipf_reweight",
           "compute_srmse", "compute_jsd", "serialize_dataframe", "check_record_feasibility", "build_generation_prefix",
           "build_era_prefix", "parse_records", "accept_generated", "run_all"]
