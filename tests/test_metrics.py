"""Sparse JSD / SRMSE against dense plain-Python versions, and metric properties."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from popweave.operators import metrics as M

DOM = {"a": ["x", "y", "z"], "b": ["p", "q"], "c": ["u", "v", "w", "t"]}
ATTRS = list(DOM)


def _cells(spark, counts):
    rows = [(*k, n) for k, n in counts.items() if n > 0]
    return spark.createDataFrame(rows, "a string, b string, c string, n long")


def _dense(counts):
    grid = list(product(*DOM.values()))
    tot = sum(counts.get(g, 0) for g in grid)
    return [counts.get(g, 0) / tot if tot else 0.0 for g in grid]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_full_joint_matches_dense(spark, seed):
    rnd = random.Random(seed)
    grid = list(product(*DOM.values()))
    p = {g: rnd.choice([0, 0, 1, 5, 20]) for g in grid}
    q = {g: rnd.choice([0, 3, 7]) for g in grid}
    got = M.jsd_full_joint(_cells(spark, p), _cells(spark, q), ATTRS, DOM).first()[0]
    assert got == pytest.approx(M.jsd_vectors(_dense(p), _dense(q)), abs=1e-12)


def test_jsd_properties(spark):
    grid = list(product(*DOM.values()))
    p = {g: (i % 5) for i, g in enumerate(grid)}
    q = {g: (i % 3) for i, g in enumerate(grid)}
    cp, cq = _cells(spark, p), _cells(spark, q)
    assert M.jsd_full_joint(cp, cp, ATTRS, DOM).first()[0] == pytest.approx(0.0, abs=1e-15)
    a = M.jsd_full_joint(cp, cq, ATTRS, DOM).first()[0]
    b = M.jsd_full_joint(cq, cp, ATTRS, DOM).first()[0]
    assert a == pytest.approx(b, abs=1e-15) and 0.0 <= a <= 1.0
    empty = cp.where(F.lit(False))
    assert M.jsd_full_joint(empty, empty, ATTRS, DOM).first()[0] == pytest.approx(0.0, abs=1e-15)
    # an empty side is uniform after clamping
    e = M.jsd_full_joint(empty, cq, ATTRS, DOM).first()[0]
    uni = [1.0 / len(grid)] * len(grid)
    assert e == pytest.approx(M.jsd_vectors(uni, _dense(q)), abs=1e-12)


def test_pairwise_and_srmse_match_dense(spark):
    rnd = random.Random(7)
    grid = list(product(*DOM.values()))
    p = {g: rnd.randint(0, 9) for g in grid}
    q = {g: rnd.randint(0, 4) for g in grid}
    cp, cq = _cells(spark, p), _cells(spark, q)
    pw = {(r.a1, r.a2): r.jsd for r in M.jsd_pairwise(cp, cq, ATTRS, DOM).collect()}
    for i, a1 in enumerate(ATTRS):
        for a2 in ATTRS[i + 1:]:
            def marg(c):
                m = {}
                for g, n in c.items():
                    k = (g[ATTRS.index(a1)], g[ATTRS.index(a2)])
                    m[k] = m.get(k, 0) + n
                tot = sum(m.values())
                return [m.get(k, 0) / tot for k in product(DOM[a1], DOM[a2])]
            assert pw[(a1, a2)] == pytest.approx(M.jsd_vectors(marg(p), marg(q)), abs=1e-12)
    sr = {r.attr: r.srmse for r in M.srmse(cp, cq, ATTRS, DOM).collect()}
    for j, a in enumerate(ATTRS):
        def one(c):
            m = {v: 0 for v in DOM[a]}
            for g, n in c.items():
                m[g[j]] += n
            tot = sum(m.values())
            return [m[v] / tot for v in DOM[a]]
        assert sr[a] == pytest.approx(M.srmse_vectors(one(p), one(q)), abs=1e-12)
    assert all(v == pytest.approx(0.0, abs=1e-15) for v in
               [r.srmse for r in M.srmse(cp, cp, ATTRS, DOM).collect()])


def test_large_grid_path_matches(spark, monkeypatch):
    grid = list(product(*DOM.values()))
    p = {g: (i % 4) for i, g in enumerate(grid)}
    q = {g: (i % 6) for i, g in enumerate(grid)}
    cp, cq = _cells(spark, p), _cells(spark, q)
    small = M.jsd_full_joint(cp, cq, ATTRS, DOM).first()[0]
    monkeypatch.setattr(M, "SMALL_SUPPORT", 1)
    big = M.jsd_full_joint(cp, cq, ATTRS, DOM).first()[0]
    assert big == pytest.approx(small, abs=1e-14)


def test_large_pairs_match_and_need_no_window(spark, monkeypatch):
    import io
    from contextlib import redirect_stdout

    rnd = random.Random(5)
    grid = list(product(*DOM.values()))
    # The last attribute is null on one side: its pairs have rows on the other side only.
    cp = _cells(spark, {g: rnd.choice([0, 3, 8]) for g in grid if rnd.random() < 0.6})
    cq = _cells(spark, {g: rnd.choice([1, 5]) for g in grid}).withColumn(ATTRS[-1], F.lit(None).cast("string"))
    nothing = cp.where(F.lit(False))
    pairs = lambda p, q: {(r.a1, r.a2): r.jsd for r in M.jsd_pairwise(p, q, ATTRS, DOM).collect()}
    small = [pairs(cp, cq), pairs(cp, nothing), pairs(nothing, nothing)]
    monkeypatch.setattr(M, "SMALL_SUPPORT", 1)
    for a, b in zip(small, [pairs(cp, cq), pairs(cp, nothing), pairs(nothing, nothing)], strict=True):
        assert a == pytest.approx(b, abs=1e-14) and len(a) == len(ATTRS) * (len(ATTRS) - 1) // 2
    assert set(small[2].values()) == {0.0} and all(v > 0 for v in small[1].values())
    buf = io.StringIO()
    with redirect_stdout(buf):
        M.jsd_pairwise(cp, cq, ATTRS, DOM).explain()
    assert "Window" not in buf.getvalue()


def test_pairs_are_grouping_sets(spark):
    import io
    from contextlib import redirect_stdout

    from popweave.operators import cells as C

    cells = _cells(spark, {g: i % 5 for i, g in enumerate(product(*DOM.values()))})
    buf = io.StringIO()
    with redirect_stdout(buf):
        C.pairwise_joint(cells, ATTRS, DOM).explain()
    assert "Expand" in buf.getvalue() and "Generate" not in buf.getvalue()
    got = {(r.a1, r.a2, r.v1, r.v2): r.n for r in C.pairwise_joint(cells, ATTRS, DOM).collect()}
    assert len(got) == sum(len(DOM[a]) * len(DOM[b]) for i, a in enumerate(ATTRS) for b in ATTRS[i + 1:])
    # A null is no value of its attribute, and never the mark of an attribute that is not in the pair.
    some = spark.createDataFrame([(None, "x", "p", 2), ("u", None, "p", 3), ("u", "x", None, 5)], "a string, b string, c string, n long")
    counts = {(r.a1, r.a2, r.v1, r.v2): r.n for r in C.pairwise_counts(some, ["a", "b", "c"]).collect()}
    assert counts == {("a", "b", "u", "x"): 5, ("a", "c", "u", "p"): 3, ("b", "c", "x", "p"): 2}


def test_inferred_domain_ordinals(spark):
    from popweave.domain import infer_domain

    rows = [("v%05d" % ((i * 7919) % 5000), "x" if i % 2 else None) for i in range(5000)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(6)
    got = {(r.attr, r.ord): r.cat for r in infer_domain(df, df.limit(10), ["a", "b"]).collect()}
    want = {("a", i): v for i, v in enumerate(sorted({r[0] for r in rows}))}
    want[("b", 0)] = "x"
    assert got == want


def test_fused_suite_matches_parts(spark, monkeypatch):
    rnd = random.Random(11)
    grid = list(product(*DOM.values()))
    p = {g: rnd.choice([0, 2, 9]) for g in grid}
    q = {g: rnd.choice([0, 1, 4]) for g in grid}
    cp, cq = _cells(spark, p), _cells(spark, q)
    fused = M.evaluate_suite(cp, cq, ATTRS, DOM).first()
    parts = M._evaluate_suite_parts(cp, cq, ATTRS, DOM).first()
    for c in ("srmse_avg", "jsd_pairwise_avg", "jsd_full_joint"):
        assert fused[c] == pytest.approx(parts[c], abs=1e-13)
    empty = cp.where(F.lit(False))
    e = M.evaluate_suite(empty, empty, ATTRS, DOM).first()
    assert (e.srmse_avg, e.jsd_pairwise_avg, e.jsd_full_joint) == (0.0, 0.0, 0.0)
