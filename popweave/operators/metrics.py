"""Distribution distances on cell tables: SRMSE and Jensen–Shannon.

JSD is computed sparsely: with K = grid size and S = support of either side,
``Z = Σ_S max(p, ε) + (K-|S|)·ε`` per side and
``JSD = Σ_S g(p', q') + (K-|S|)·g(ε/Zp, ε/Zq)`` where
``g(a, b) = ½(a·log2(2a/(a+b)) + b·log2(2b/(a+b)))`` — exactly the dense
clamp-renormalise-divergence value without building the grid.  An empty side
becomes uniform, as clamping does in the dense form.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log2, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popweave.domain import Domain
from popweave.session import materialize
from popweave.domain import domain_df
from popweave.operators.cells import attribute_pairs, pair_sums

EPS = 1e-12
SMALL_SUPPORT = 2_000_000  # whole-support window allowed up to this grid size


def g_expr(a: Column, b: Column) -> Column:
    s = a + b
    return F.lit(0.5) * (a * F.log2(F.lit(2.0) * a / s) + b * F.log2(F.lit(2.0) * b / s))


def _g_py(a: float, b: float) -> float:
    s = a + b
    return 0.5 * (a * log2(2 * a / s) + b * log2(2 * b / s))


def _tagged(syn_cells: DataFrame, real_cells: DataFrame, cols: Sequence[str], n: str) -> DataFrame:
    """Both sides in one table: ``(cols..., np, nq)`` (a union, no join)."""
    s = syn_cells.select(*cols, F.col(n).cast("double").alias("np"), F.lit(0.0).alias("nq"))
    r = real_cells.select(*cols, F.lit(0.0).alias("np"), F.col(n).cast("double").alias("nq"))
    return s.unionByName(r)


def srmse(syn_cells: DataFrame, real_cells: DataFrame, attrs: Sequence[str], domain: Domain,
          n: str = "n") -> DataFrame:
    """Per-attribute SRMSE ``(attr, srmse)`` = C·sqrt(mean((ps−pr)²)), C = |domain|.

    One unpivot of the tagged sides, one aggregation with a sum per side,
    dense over the literal domain; shares over in-domain rows per attribute.
    """
    spark = syn_cells.sparkSession
    t = _tagged(syn_cells, real_cells, attrs, n)
    kv = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("cat"),
                                      F.col("np"), F.col("nq")) for a in attrs]))
    long = (t.select(kv.alias("kv")).select("kv.*").where(F.col("cat").isNotNull())
            .groupBy("attr", "cat").agg(F.sum("np").alias("np"), F.sum("nq").alias("nq")))
    dense = F.broadcast(domain_df(spark, attrs, domain)).join(long, ["attr", "cat"], "left") \
        .select("attr", "cat", F.coalesce("np", F.lit(0.0)).alias("np"), F.coalesce("nq", F.lit(0.0)).alias("nq"))
    w = Window.partitionBy("attr")
    ps = F.coalesce(F.try_divide(F.col("np"), F.sum("np").over(w)), F.lit(0.0))
    pr = F.coalesce(F.try_divide(F.col("nq"), F.sum("nq").over(w)), F.lit(0.0))
    return dense.select("attr", (ps - pr).alias("d")).groupBy("attr").agg(
        (F.sqrt(F.avg(F.col("d") * F.col("d"))) * F.count(F.lit(1))).alias("srmse"))


def srmse_vectors(p: Sequence[float], q: Sequence[float]) -> float:
    """Plain-Python SRMSE of two aligned vectors (tests and tiny inputs)."""
    c = len(q)
    if c == 0:
        return 0.0
    return (sum((a - b) ** 2 for a, b in zip(p, q)) / c) ** 0.5 * c


def _jsd_core(t: DataFrame, keys: Sequence[str], K: Column, by: Sequence[str], eps: float) -> DataFrame:
    """``(by..., jsd)`` from a tagged count table ``(by..., keys..., np, nq)``.

    Counts of both sides come from one aggregation (no outer join).  Totals
    and clamp sums are window sums partitioned by ``by``: a window partition
    holds the support of one group, at most K grid cells (for ``by=()`` the
    whole support, bounded by the domain product, not by the data).
    """
    on = [*by, *keys]
    e = F.lit(eps)
    w = Window.partitionBy(*by)
    j = t.groupBy(*on).agg(F.sum("np").alias("np"), F.sum("nq").alias("nq")).withColumn("kk", K)
    j = j.select("*", F.sum("np").over(w).alias("tp"), F.sum("nq").over(w).alias("tq"),
                 F.count(F.lit(1)).over(w).cast("double").alias("s"))
    pp = F.coalesce(F.try_divide(F.col("np"), F.col("tp")), F.lit(0.0))
    qq = F.coalesce(F.try_divide(F.col("nq"), F.col("tq")), F.lit(0.0))
    j = j.select(*by, "kk", "s", F.greatest(pp, e).alias("cp"), F.greatest(qq, e).alias("cq"))
    pad = (F.col("kk") - F.col("s")) * e
    j = j.select("*", (F.sum("cp").over(w) + pad).alias("zp"), (F.sum("cq").over(w) + pad).alias("zq"))
    agg = j.groupBy(*by).agg(
        F.sum(g_expr(F.col("cp") / F.col("zp"), F.col("cq") / F.col("zq"))).alias("gs"),
        F.first("zp").alias("zp"), F.first("zq").alias("zq"),
        F.first("kk").alias("kk"), F.first("s").alias("s"))
    rest = F.when(F.col("kk") > F.col("s"),
                  (F.col("kk") - F.col("s")) * g_expr(e / F.col("zp"), e / F.col("zq"))).otherwise(F.lit(0.0))
    return agg.select(*by, F.greatest(F.lit(0.0), F.coalesce(F.col("gs") + rest, F.lit(0.0))).alias("jsd"))


def _jsd_large(t: DataFrame, keys: Sequence[str], grid: int, eps: float) -> DataFrame:
    """Same value for a support too large for one window partition: the
    support is checkpointed once, then totals and clamp sums are scalar
    aggregates over it (each a distributed aggregation)."""
    e, K = F.lit(eps), F.lit(float(grid))
    j = materialize(t.groupBy(*keys).agg(F.sum("np").alias("np"), F.sum("nq").alias("nq")))
    tp, tq = j.agg(F.sum("np")).scalar(), j.agg(F.sum("nq")).scalar()
    s = j.agg(F.count(F.lit(1)).cast("double")).scalar()
    c = j.select(F.greatest(F.coalesce(F.try_divide(F.col("np"), tp), F.lit(0.0)), e).alias("cp"),
                 F.greatest(F.coalesce(F.try_divide(F.col("nq"), tq), F.lit(0.0)), e).alias("cq"))
    zp = F.coalesce(c.agg(F.sum("cp")).scalar(), F.lit(0.0)) + (K - s) * e
    zq = F.coalesce(c.agg(F.sum("cq")).scalar(), F.lit(0.0)) + (K - s) * e
    gs = F.coalesce(c.agg(F.sum(g_expr(F.col("cp") / zp, F.col("cq") / zq))).scalar(), F.lit(0.0))
    rest = F.when(K > s, (K - s) * g_expr(e / zp, e / zq)).otherwise(F.lit(0.0))
    return t.sparkSession.range(1).select(F.greatest(F.lit(0.0), gs + rest).alias("jsd"))


def jsd(p_cells: DataFrame, q_cells: DataFrame, keys: Sequence[str], grid: int, *,
        n: str = "n", eps: float = EPS) -> DataFrame:
    """One-row ``(jsd)`` between two sparse count tables over a K-cell grid.

    The global aggregate always yields one row; both-empty inputs give 0.
    Grids above ``SMALL_SUPPORT`` cells take the checkpointed scalar path.
    """
    t = _tagged(p_cells, q_cells, keys, n)
    if grid > SMALL_SUPPORT:
        return _jsd_large(t, keys, grid, eps)
    return _jsd_core(t, keys, F.lit(float(grid)), (), eps)


def _listwise(cells: DataFrame, attrs: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for a in attrs:
        cond = cond & F.col(a).isNotNull()
    return cells.where(cond)


def jsd_full_joint(syn_cells: DataFrame, real_cells: DataFrame, attrs: Sequence[str], domain: Domain,
                   n: str = "n") -> DataFrame:
    """Full k-way JSD as one row ``(jsd_full_joint)``."""
    K = prod(len(domain[a]) for a in attrs)
    r = jsd(_listwise(syn_cells, attrs), _listwise(real_cells, attrs), attrs, K, n=n)
    return r.select(F.col("jsd").alias("jsd_full_joint"))


def jsd_pairwise(syn_cells: DataFrame, real_cells: DataFrame, attrs: Sequence[str], domain: Domain,
                 n: str = "n") -> DataFrame:
    """``(a1, a2, jsd)`` for every attribute pair, from one aggregation with grouping sets over both sides.

    Pairs of up to ``SMALL_SUPPORT`` cells take their totals from windows; with
    larger ones these are two small aggregations joined back, so that no task
    holds a pair.  Pairs with no rows on either side have JSD 0 (both uniform).
    """
    spark = syn_cells.sparkSession
    t = pair_sums(_tagged(syn_cells, real_cells, attrs, n), attrs, ["np", "nq"])
    grids = [(a, b, float(len(domain[a]) * len(domain[b]))) for a, b in attribute_pairs(attrs)]
    sizes = spark.createDataFrame(grids, "a1 string, a2 string, k double")
    fan = t.join(F.broadcast(sizes), ["a1", "a2"])
    if max(k for *_, k in grids) <= SMALL_SUPPORT:
        res = _jsd_core(fan, ["v1", "v2"], F.col("k"), ["a1", "a2", "k"], EPS)
    else:
        res = _jsd_two_pass(fan, ["v1", "v2"], ["a1", "a2", "k"], EPS)
    return sizes.select("a1", "a2").join(res, ["a1", "a2"], "left") \
        .select("a1", "a2", F.coalesce(F.col("jsd"), F.lit(0.0)).alias("jsd"))


def _jsd_two_pass(t: DataFrame, keys: Sequence[str], by: Sequence[str], eps: float) -> DataFrame:
    """``_jsd_core`` for supports of any size: totals and clamp sums of a group (``k`` cells, in ``by``) by aggregation."""
    e, k = F.lit(eps), F.col("k")
    j = materialize(t.groupBy(*by, *keys).agg(F.sum("np").alias("np"), F.sum("nq").alias("nq")))
    totals = j.groupBy(*by).agg(F.sum("np").alias("tp"), F.sum("nq").alias("tq"), F.count(F.lit(1)).cast("double").alias("s"))
    share = lambda n, total: F.greatest(F.coalesce(F.try_divide(F.col(n), F.col(total)), F.lit(0.0)), e)
    c = j.join(F.broadcast(totals), list(by)).select(*by, "s", share("np", "tp").alias("cp"), share("nq", "tq").alias("cq"))
    clamped = c.groupBy(*by).agg(F.sum("cp").alias("zp"), F.sum("cq").alias("zq"), F.first("s").alias("s")).select(
        *by, "s", (F.col("zp") + (k - F.col("s")) * e).alias("zp"), (F.col("zq") + (k - F.col("s")) * e).alias("zq"))
    gs = c.drop("s").join(F.broadcast(clamped), list(by)).groupBy(*by, "s", "zp", "zq").agg(
        F.sum(g_expr(F.col("cp") / F.col("zp"), F.col("cq") / F.col("zq"))).alias("gs"))
    rest = F.when(k > F.col("s"), (k - F.col("s")) * g_expr(e / F.col("zp"), e / F.col("zq"))).otherwise(F.lit(0.0))
    return gs.select(*by, F.greatest(F.lit(0.0), F.col("gs") + rest).alias("jsd"))


def evaluate_suite(syn_cells: DataFrame, real_cells: DataFrame, attrs: Sequence[str], domain: Domain,
                   n: str = "n", per_attr: bool = False) -> DataFrame:
    """One row ``(srmse_avg, jsd_pairwise_avg, jsd_full_joint)``, with ``per_attr`` also the map ``srmse_per_attr``.

    All roll-ups in one pass, grouping-sets style: every tagged cell fans out
    to its single-attribute, pair and full-joint groups, one aggregation sums
    both sides per group value, and windows partitioned by group give the
    totals.  SRMSE is sparse too: ``C·sqrt(Σ_support (ps−pr)² / C)``.  Groups
    absent on both sides contribute 0 (zero vectors / two uniforms), so the
    averages divide by the known group counts.
    """
    syn_cells, real_cells = materialize(syn_cells), materialize(real_cells)
    pairs = attribute_pairs(attrs)
    K = prod(len(domain[a]) for a in attrs)
    if K > SMALL_SUPPORT:
        return _evaluate_suite_parts(syn_cells, real_cells, attrs, domain, n, per_attr)
    sets = ([("srmse", (a,), len(domain[a])) for a in attrs]
            + [("pair", (a, b), len(domain[a]) * len(domain[b])) for a, b in pairs]
            + [("joint", tuple(attrs), K)])
    t = _tagged(syn_cells, real_cells, attrs, n)
    fan = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("sid"), F.lit(float(k)).alias("kk"),
                 F.array(*[F.col(c).cast("string") for c in cols]).alias("vals"), F.col("np"), F.col("nq"))
        for i, (kind, cols, k) in enumerate(sets)]))
    f = t.select(fan.alias("x")).select("x.*").where(~F.exists("vals", lambda v: v.isNull()))
    g = f.groupBy("kind", "sid", "kk", "vals").agg(F.sum("np").alias("np"), F.sum("nq").alias("nq"))
    w = Window.partitionBy("sid")
    e = F.lit(EPS)
    g = g.select("*", F.sum("np").over(w).alias("tp"), F.sum("nq").over(w).alias("tq"),
                 F.count(F.lit(1)).over(w).cast("double").alias("s"))
    pp = F.coalesce(F.try_divide(F.col("np"), F.col("tp")), F.lit(0.0))
    qq = F.coalesce(F.try_divide(F.col("nq"), F.col("tq")), F.lit(0.0))
    g = g.select("kind", "sid", "kk", "s", (pp - qq).alias("d"),
                 F.greatest(pp, e).alias("cp"), F.greatest(qq, e).alias("cq"))
    pad = (F.col("kk") - F.col("s")) * e
    g = g.select("*", (F.sum("cp").over(w) + pad).alias("zp"), (F.sum("cq").over(w) + pad).alias("zq"))
    per = g.groupBy("kind", "sid").agg(
        F.sum(F.col("d") * F.col("d")).alias("d2"),
        F.sum(g_expr(F.col("cp") / F.col("zp"), F.col("cq") / F.col("zq"))).alias("gs"),
        F.first("zp").alias("zp"), F.first("zq").alias("zq"),
        F.first("kk").alias("kk"), F.first("s").alias("s"))
    rest = F.when(F.col("kk") > F.col("s"),
                  (F.col("kk") - F.col("s")) * g_expr(e / F.col("zp"), e / F.col("zq"))).otherwise(F.lit(0.0))
    jsd_v = F.greatest(F.lit(0.0), F.col("gs") + rest)
    srmse_v = F.when(F.col("kk") > 0, F.sqrt(F.col("d2") / F.col("kk")) * F.col("kk")).otherwise(F.lit(0.0))
    per = per.select("kind", "sid", F.when(F.col("kind") == "srmse", srmse_v).otherwise(jsd_v).alias("v"))
    n_attrs, n_pairs = max(len(attrs), 1), max(len(pairs), 1)
    return per.agg(
        (F.coalesce(F.sum(F.when(F.col("kind") == "srmse", F.col("v"))), F.lit(0.0)) / n_attrs).alias("srmse_avg"),
        (F.coalesce(F.sum(F.when(F.col("kind") == "pair", F.col("v"))), F.lit(0.0)) / n_pairs)
        .alias("jsd_pairwise_avg"),
        F.coalesce(F.max(F.when(F.col("kind") == "joint", F.col("v"))), F.lit(0.0)).alias("jsd_full_joint"),
        *([F.create_map(*[x for i, a in enumerate(attrs) for x in (
            F.lit(a), F.coalesce(F.max(F.when((F.col("kind") == "srmse") & (F.col("sid") == i), F.col("v"))), F.lit(0.0)))])
           .alias("srmse_per_attr")] if per_attr else []))


def _evaluate_suite_parts(syn_cells: DataFrame, real_cells: DataFrame, attrs: Sequence[str], domain: Domain,
                          n: str = "n", per_attr: bool = False) -> DataFrame:
    """Grids too large for one window partition: the three parts separately."""
    each = srmse(syn_cells, real_cells, attrs, domain, n)
    s = each.agg(F.avg("srmse").alias("value")).select(F.lit("srmse_avg").alias("metric"), "value")
    if per_attr:
        s = s.unionByName(each.select(F.concat(F.lit("attr:"), "attr").alias("metric"), F.col("srmse").alias("value")))
    pw = jsd_pairwise(syn_cells, real_cells, attrs, domain, n).agg(F.avg("jsd").alias("value")) \
        .select(F.lit("jsd_pairwise_avg").alias("metric"), "value")
    fj = jsd_full_joint(syn_cells, real_cells, attrs, domain, n) \
        .select(F.lit("jsd_full_joint").alias("metric"), F.col("jsd_full_joint").alias("value"))
    u = s.unionByName(pw).unionByName(fj)
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    return u.agg(*[of(m).alias(m) for m in ("srmse_avg", "jsd_pairwise_avg", "jsd_full_joint")],
                 *([F.create_map(*[x for a in attrs for x in (F.lit(a), F.coalesce(of(f"attr:{a}"), F.lit(0.0)))])
                    .alias("srmse_per_attr")] if per_attr else []))


def jsd_vectors(p: Sequence[float], q: Sequence[float], eps: float = EPS) -> float:
    """Dense plain-Python JSD (tests): clamp, renormalise, base-2 divergence."""
    p = [max(x, eps) for x in p]
    q = [max(x, eps) for x in q]
    sp, sq = sum(p), sum(q)
    return max(0.0, sum(_g_py(a / sp, b / sq) for a, b in zip(p, q)))
