"""Edge cases called out in the survey: empty sides, zero targets, deficits, short pools."""

import pytest

from popweave.operators import cells as C
from popweave.operators import fitting as FT
from popweave.operators import metrics as M
from popweave.operators import validate as V
from popweave.plans.methods import rake_resample

DOM = {"x": ["0", "1", "2"], "y": ["a", "b"]}


def _cells(spark, rows):
    return spark.createDataFrame(rows, "x string, y string, n long")


def test_empty_inputs(spark):
    empty = _cells(spark, [])
    assert FT.rake(empty, {"x": {"0": 1.0}}).count() == 0
    recs = spark.createDataFrame([], "x string, y string")
    assert rake_resample(recs, {"x": {"0": 1.0}}, ["x", "y"]).count() == 0
    real = _cells(spark, [("0", "a", 5), ("1", "b", 3)])
    row = M.evaluate_suite(empty, real, ["x", "y"], DOM).first()
    assert 0.0 < row.jsd_full_joint <= 1.0
    marg = C.marginals(empty, ["x", "y"], DOM).collect()
    assert all(r.prop is None for r in marg) and len(marg) == 5
    ind = C.marginals(empty, ["x", "y"], DOM, denominator="in_domain").collect()
    assert all(r.prop == 0.0 for r in ind)


def test_ipf_zero_target_zeroes_cells(spark):
    seed = spark.createDataFrame([(i, x, y, 1.5) for i, (x, y) in enumerate(
        [(x, y) for x in DOM["x"] for y in DOM["y"]])], "cell long, x string, y string, seed double")
    fit = FT.ipf(seed, {"x": {"0": 0.5, "1": 0.0, "2": 0.5}}, 100, ["x", "y"], DOM).collect()
    assert all(r.fitted == 0.0 for r in fit if r.x == "1")
    assert sum(r.fitted for r in fit) == pytest.approx(100.0)


def test_rake_zero_target_keeps_category(spark):
    cells = _cells(spark, [("0", "a", 10), ("1", "a", 10), ("2", "b", 10)])
    fit = {r.x: r.w for r in FT.rake(cells, {"x": {"0": 0.5, "1": 0.0, "2": 0.5}}).collect()}
    assert fit["1"] == 1.0  # skipped, never zeroed (sequential rule)
    classic = {r.x: r.w for r in FT.rake(cells, {"x": {"0": 0.5, "1": 0.0, "2": 0.5}}, mode="classic").collect()}
    assert classic["1"] == 0.0


def test_trs_without_deficit(spark):
    df = spark.createDataFrame([(0, "k0", 3.0), (1, "k1", 4.0)], "cell long, k string, fitted double")
    got = {r.k: r["count"] for r in FT.trs_integerize(df, 5, 1, ["cell", "k"]).collect()}
    assert got == {"k0": 3, "k1": 4}  # deficit <= 0: nothing removed


def test_short_pool_and_reasons(spark):
    texts = [(0, 0, "Sex is Male, Age Group is 30-34, Education is High school, Occupation is Clerks, "
                    "Marital Status is Married"),
             (0, 1, "Sex is , Age Group is 30-34, Education is High school, Occupation is Clerks, "
                    "Marital Status is Married"),
             (0, 2, "Sex is Male, Age Group is 0-4, Education is High school, Occupation is Clerks, "
                    "Marital Status is Married"),
             (1, 0, "Sex is Male")]
    df = spark.createDataFrame(texts, "batch long, pos int, text string")
    v = V.validate_generated(df, keep=["batch", "pos"])
    reasons = {(r.batch, r.pos): r.reject_reason for r in v.collect()}
    assert reasons == {(0, 0): None, (0, 1): "unmatched", (0, 2): "infeasible", (1, 0): "incomplete"}
    assert V.take_accepted(v, 10).count() == 1
    st = V.generation_stats(v, 10).first()
    assert (st.accepted, st.failed, st.batches) == (1, 3, 2)
    assert st.fill_rate == pytest.approx(0.1) and st.parse_rate == pytest.approx(0.25)


def test_take_accepted_cuts_inside_a_batch_on_many_levels(spark, monkeypatch):
    monkeypatch.setattr(V, "FAN", 3)
    rows = [(b, p, None if (b * 7 + p) % 3 else "unmatched") for b in range(40) for p in range(10)]
    v = spark.createDataFrame(rows, "batch long, pos int, reject_reason string").repartition(4)
    good = sorted((b, p) for b, p, r in rows if r is None)
    for n in (1, 6, 7, 100, len(good), len(good) + 5):
        got = sorted((r.batch, r.pos) for r in V.take_accepted(v, n, batch_size=1).collect())
        read = [g for g in good if g[0] < V.max_batches(n, 1)][:n]
        assert got == read
        stats = V.generation_stats(v, n, batch_size=1).first()
        last = read[-1][0] if len(read) == n else min(V.max_batches(n, 1), 40) - 1
        assert (stats.accepted, stats.batches) == (len(read), last + 1)


def test_null_groups_are_groups(spark):
    cells = spark.createDataFrame([(None, "0", "a", 3), (None, "1", "b", 2), (1, "0", "b", 4)], "g int, x string, y string, n long")
    got = {(r.g, r.attr, r.cat): (r.n, r.prop) for r in C.marginals(cells, ["x", "y"], DOM, by=["g"]).collect()}
    assert got[None, "x", "0"] == (3, 0.6) and got[None, "x", "2"] == (0, 0.0) and got[1, "y", "b"] == (4, 1.0)


def test_seed_table_reads_numbers_as_their_text(spark):
    df = spark.createDataFrame([(2000, 1, "a"), (2000, 2, "b"), (1999, 1, "b")], "year int, x int, y string")
    got = {(r.x, r.y): r.seed for r in FT.seed_table(df, ["x", "y"], {"x": [1, 2], "y": ["a", "b"]}).collect()}
    assert got == {("1", "a"): 1.5, ("1", "b"): 0.5, ("2", "a"): 0.5, ("2", "b"): 1.5}
