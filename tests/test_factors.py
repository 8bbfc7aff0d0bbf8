"""Fits without a grid, batched large groups and stored factors."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from popweave.domain import domain_grid
from popweave.operators import factors as FC
from popweave.operators import fitting as FT
from popweave.operators import implicit as IM
from popweave.session import scratch_path

DOM = {"A": ["a0", "a1", "a2"], "B": ["b0", "b1"], "C": ["c0", "c1", "c2", "c3"]}
ATTRS = list(DOM)
TARGETS = {"A": {"a0": 0.5, "a1": 0.3, "a2": 0.2}, "B": {"b1": 0.65, "b0": 0.35}, "C": {"c0": 0.4, "c1": 0.4, "c2": 0.2}}


def records(spark, years=(1,), rows=900):
    out = []
    for y in years:
        k = y or 0
        rng = np.random.default_rng(k)
        for _ in range(rows):
            out.append((y, *[None if rng.random() < 0.02 else d[min(len(d) - 1, int(rng.gamma(1 + k % 3)))] for d in DOM.values()]))
    return spark.createDataFrame(out, "year int, A string, B string, C string")


def seed(spark, cells):
    c = cells.groupBy(*ATTRS).agg(F.count(F.lit(1)).alias("_k"))
    return domain_grid(spark, ATTRS, DOM).join(c, ATTRS, "left").select("cell", *ATTRS, (F.coalesce("_k", F.lit(0)) + 0.5).alias("seed"))


@pytest.mark.parametrize("targets,limit", [(TARGETS, 10**6), ({"B": TARGETS["B"]}, 10**6), ({k: TARGETS[k] for k in "CA"}, 1)])
def test_implicit_fit_equals_the_enumerated_one(spark, monkeypatch, targets, limit):
    cells = records(spark)
    want = {tuple(r[a] for a in ATTRS): r["fitted"] for r in FT.ipf(
        seed(spark, cells), targets, 5000, ATTRS, DOM, max_iter=3).collect()}
    monkeypatch.setattr(IM, "MAX_TASK_CELLS", limit)
    fit = IM.ipf_implicit(cells, targets, 5000, ATTRS, DOM, max_iter=3)
    got = {tuple(r[a] for a in ATTRS): r["fitted"] for r in fit.value(domain_grid(spark, ATTRS, DOM)).collect()}
    assert len(want) == 24 and got == pytest.approx(want, rel=1e-9, abs=1e-12)
    marginals = {(r["attr"], r["cat"]): r["fitted"] for r in fit.marginals().collect()}
    for k, a in enumerate(ATTRS):
        for c in DOM[a]:
            assert marginals[a, c] == pytest.approx(sum(v for cell, v in want.items() if cell[k] == c), rel=1e-9, abs=1e-9)


def test_implicit_sample_has_the_fitted_distribution(spark):
    fit = IM.ipf_implicit(records(spark, rows=30), TARGETS, 1, ATTRS, DOM)
    want = {tuple(r[a] for a in ATTRS): r["fitted"] for r in fit.value(domain_grid(spark, ATTRS, DOM)).collect()}
    n = 60_000
    drawn = fit.sample(n, 7).collect()
    assert sorted(r["draw"] for r in drawn) == list(range(n))
    got = Counter(tuple(r[a] for a in ATTRS) for r in drawn)
    chi = sum((got[c] - n * p) ** 2 / (n * p) for c, p in want.items() if p > 0)
    assert chi < 60 and not any(got[c] for c, p in want.items() if p == 0)  # 18 cells have mass: 17 degrees of freedom
    assert Counter(tuple(r) for r in fit.sample(n, 7).collect()) == Counter(tuple(r) for r in drawn)


def test_implicit_integerization(spark, monkeypatch):
    """Floors are those of the whole grid, the rest is drawn from its residuals; cells found without listing the grid."""
    few = records(spark, rows=5)
    fit = IM.ipf_implicit(few, TARGETS, 40, ATTRS, DOM)
    monkeypatch.setattr(IM, "MAX_TASK_CELLS", 1)  # no enumeration from here on
    grid = {tuple(r[a] for a in ATTRS): r["fitted"] for r in fit.value(domain_grid(spark, ATTRS, DOM)).collect()}
    heavy = {tuple(r[a] for a in ATTRS): r["_q"] for r in fit.heavy_cells().collect()}
    seen = {tuple(r[a] for a in ATTRS) for r in fit.seen.collect()}
    parts = {c: v for c, v in grid.items() if c not in seen}
    assert {c for c, q in heavy.items() if c not in seen} == {c for c, v in parts.items() if v >= 1} and any(v >= 1 for v in parts.values())
    sums = Counter()
    for s in range(6):
        counts = {tuple(r[a] for a in ATTRS): r["count"] for r in fit.integerize(40, s).collect()}
        assert sum(counts.values()) == 40 and all(counts.get(c, 0) >= math.floor(v) for c, v in grid.items())
        sums.update(counts)
    rest = sum(v - math.floor(v) for v in grid.values())
    off = sum(abs(sums[c] / 6 - v) for c, v in grid.items())
    assert off < 0.8 * rest  # many draws of the residuals come near them


def test_implicit_fit_of_a_trillion_cells(spark):
    attrs = [f"x{i}" for i in range(12)]
    dom = {a: [f"v{j}" for j in range(10)] for a in attrs}
    rng = np.random.default_rng(3)
    rows = [tuple(f"v{min(9, int(x))}" for x in rng.gamma(2.0, size=12)) for _ in range(2000)]
    cells = spark.createDataFrame(rows, ", ".join(f"{a} string" for a in attrs))
    targets = {a: {f"v{j}": (j + 1) / 55 for j in range(10)} for a in attrs[:9]}
    fit = IM.ipf_implicit(cells, targets, 10_000, attrs, dom)
    fitted = {(r["attr"], r["cat"]): r["fitted"] for r in fit.marginals().collect()}
    assert all(fitted[a, c] == pytest.approx(10_000 * p, rel=1e-5) for a, t in targets.items() for c, p in t.items())
    sample = fit.sample(10_000, 1)
    assert sample.count() == 10_000
    share = sample.where("x0 = 'v9'").count() / 10_000
    assert abs(share - 10 / 55) < 0.02
    assert fit.integerize(3000, 2).agg(F.sum("count")).first()[0] == 3000


def test_implicit_fit_without_records_and_with_values_out_of_domain(spark):
    none = records(spark).limit(0)
    fit = IM.ipf_implicit(none, TARGETS, 100, ATTRS, DOM)
    got = {(r["attr"], r["cat"]): r["fitted"] for r in fit.marginals().collect()}
    assert got["A", "a0"] == pytest.approx(50) and got["C", "c3"] == 0 and fit.sample(50, 1).count() == 50
    odd = spark.createDataFrame([("a0", "elsewhere", "c0"), (None, "b0", "c0")], "A string, B string, C string")
    same = IM.ipf_implicit(odd, TARGETS, 100, ATTRS, DOM)
    assert {(r["attr"], r["cat"]): r["fitted"] for r in same.marginals().collect()} == pytest.approx(got)


def grouped(spark, years):
    cells = records(spark, years).groupBy("year", *ATTRS).agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for y in years:  # targets of their own, listed in another order, and one attribute less
        t = {a: dict(sorted(c.items(), reverse=y in (1, 5))) for a, c in TARGETS.items() if not (y == 3 and a == "B")}
        parts.append(FT.targets_df(spark, t).select(F.lit(y).cast("int").alias("year"), "*"))
    targets = parts[0]
    for p in parts[1:]:
        targets = targets.unionByName(p)
    return cells, targets


def rows_of(df, keys):
    return {tuple(r[k] for k in keys): [float(r[c]) for c in df.columns if c not in keys] for r in df.collect()}


@pytest.mark.parametrize("mode", ["sequential", "classic"])
def test_large_groups_in_one_loop_equal_one_task_each(spark, monkeypatch, mode):
    cells, targets = grouped(spark, [1, 2, 3, None] if mode == "sequential" else [1, 2, 3])
    keys = ["year", *ATTRS]
    small = rows_of(FT.rake(cells, targets, by=["year"], mode=mode, max_iter=4), keys)
    factors = rows_of(FT.rake_factors(cells, targets, by=["year"], mode=mode, max_iter=4), ["year", "attr", "cat"])
    monkeypatch.setattr(FT, "MAX_TASK_CELLS", 1)
    large = rows_of(FT.rake(cells, targets, by=["year"], mode=mode, max_iter=4), keys)
    assert set(large) == set(small) and all(large[k] == pytest.approx(small[k], rel=1e-9, abs=1e-9) for k in small)
    loop = rows_of(FT.rake_factors(cells, targets, by=["year"], mode=mode, max_iter=4), ["year", "attr", "cat"])
    assert all(loop[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in factors.items())


def test_jobs_do_not_grow_with_the_groups(spark, monkeypatch):
    monkeypatch.setattr(FT, "MAX_TASK_CELLS", 1)
    steps = []
    advance = FC.FactorLoop._advance
    monkeypatch.setattr(FC.FactorLoop, "_advance", lambda self, *a: steps.append(1) or advance(self, *a))
    jobs = []
    for years in ([1, 2], [1, 2, 4, 5, 7, 8]):
        steps.clear()
        cells, targets = grouped(spark, years)
        FT.rake(cells, targets, by=["year"], max_iter=1, tol=0.0).collect()
        jobs.append(len(steps))
    assert jobs == [3, 3]  # one sweep of three attributes, whatever the number of groups


def test_stored_factors_weigh_other_records(spark):
    cells, targets = grouped(spark, [1, 2])
    path = FC.save_factors(FT.rake_factors(cells, targets, by=["year"]), scratch_path(spark, "factors"))
    stored = FC.load_factors(spark, path)
    fresh = rows_of(FT.rake(cells, targets, by=["year"]).select("year", *ATTRS, "w"), ["year", *ATTRS])
    others = records(spark, [1, 2, 9], 300).withColumn("id", F.monotonically_increasing_id())
    got = FC.apply_factors(others, stored, by=["year"]).collect()
    assert len(got) == 900 and all(r["w"] is None for r in got if r["year"] == 9)
    met = [r for r in got if tuple(r[c] for c in ["year", *ATTRS]) in fresh]
    assert len(met) > 500 and all(r["w"] == pytest.approx(fresh[tuple(r[c] for c in ["year", *ATTRS])][0], rel=1e-12) for r in met)
    # Without groups, an attribute that the records lack, and values that no target lists.
    one = FT.rake_factors(cells.where("year = 1").drop("year"), TARGETS, mode="classic")
    odd = spark.createDataFrame([("a0", "c0"), ("a0", "c3"), ("zz", "c0"), (None, "c0")], "A string, C string")
    table = {(r["attr"], r["cat"]): r["factor"] for r in one.collect()}
    got = [r["w"] for r in FC.apply_factors(odd, one).collect()]
    assert got == pytest.approx([table["A", "a0"] * table["C", "c0"], 0.0, 0.0, 0.0])


def test_a_sweep_reads_the_cells_once_for_a_block_of_attributes(spark, monkeypatch):
    """Blocks of attributes give the factors that single attributes give, in as many passes as there are blocks."""
    attrs, fits, passes = [f"a{i}" for i in range(5)], [], []
    domain = {a: ["x", "y", "z"] for a in attrs}
    rows = [tuple("xyz"[(i * (k + 3) + i // (k + 2)) % 3] for k in range(5)) for i in range(300)]
    cells = spark.createDataFrame(rows, attrs)
    targets = {a: {"x": 0.2 + 0.05 * k, "y": 0.5, "z": 0.3 - 0.05 * k} for k, a in enumerate(attrs)}
    monkeypatch.setattr(IM, "MAX_TASK_CELLS", 0)
    read = FC.FactorLoop._weighed
    for codes in (1, 16, 1 << 16):
        monkeypatch.setattr(FC, "BLOCK_CODES", codes)
        seen = []
        monkeypatch.setattr(FC.FactorLoop, "_weighed", lambda self: seen.append(1) or read(self))  # noqa: B023
        fits.append(IM.ipf_implicit(cells, targets, 100, attrs, domain, tol=0.0, max_iter=2))
        passes.append(len(seen))
    assert passes == [11, 7, 3]
    for other in fits[1:]:
        for a in attrs:
            assert np.allclose(fits[0].factors[a], other.factors[a], rtol=1e-10)
