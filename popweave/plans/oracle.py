"""DuckDB oracle SQL for the registered queries.

dense grids where the Spark side is sparse, plain CASE chains where Spark
uses higher-order functions.  Fixture CTEs are shared text.
"""

from __future__ import annotations

from itertools import combinations

from popweave.domain import (
    CENSUS_DOMAIN,
    DEFAULT_REGION,
    DISPLAY_NAMES,
    POP_ATTRS,
    POP_DOMAIN,
    POP_TARGET_YEAR,
)
from popweave.functions.text import ERA_NARRATIVES

ORACLE: dict[str, str] = {}
POP_OOD_DOMAIN = {**POP_DOMAIN, "l_returnflag": ["A", "R"]}
SYN_YEAR = 1999
TARGET = POP_TARGET_YEAR
PAIR3 = ["l_returnflag", "o_orderstatus", "c_mktsegment"]
ATTR_LIST = ", ".join(POP_ATTRS)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(vals) -> str:
    return "[" + ", ".join(q(v) for v in vals) + "]"


def dom_values(attrs, domain) -> str:
    rows = ", ".join(f"({q(a)}, {i}, {q(c)})" for a in attrs for i, c in enumerate(domain[a]))
    return f"(VALUES {rows}) AS dom(attr, ord, cat)"


def grid_sql(attrs, domain) -> str:
    parts = []
    for a in attrs:
        rows = ", ".join(f"({q(c)})" for c in domain[a])
        parts.append(f"(VALUES {rows}) AS g_{a}({a})")
    return " CROSS JOIN ".join(parts)


def in_dom(a, domain) -> str:
    return f"{a} IN ({', '.join(q(c) for c in domain[a])})"


def ood_null(a, domain) -> str:
    return f"CASE WHEN {in_dom(a, domain)} THEN {a} END AS {a}"


POP_CTES = """
pop_base AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, l.l_linestatus, l.l_returnflag, o.o_orderstatus,
         o.o_orderpriority, c.c_mktsegment, o.o_orderkey, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey),
pop AS (SELECT year, l_linestatus, l_returnflag, o_orderstatus, o_orderpriority, c_mktsegment FROM pop_base),
pop_skew AS (
  SELECT year, l_linestatus, l_returnflag, o_orderstatus, o_orderpriority, c_mktsegment FROM pop_base
  WHERE (l_partkey + 3 * l_suppkey) % 10 <
        CASE l_returnflag WHEN 'A' THEN 9 WHEN 'N' THEN 5 WHEN 'R' THEN 2 ELSE 0 END),
pop_ood AS (
  SELECT year, l_linestatus, l_returnflag, o_orderstatus, o_orderpriority,
         CASE WHEN o_orderkey % 97 <> 0 THEN c_mktsegment END AS c_mktsegment FROM pop_base)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in (POP_CTES,) + ctes) + "\n"


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ------------------------------------------------------------------ A / B
register("scan_combined", with_() + "SELECT * FROM pop")
register("scan_per_year", with_() + "SELECT * FROM pop")
register("sink_roundtrip", with_() + f"SELECT year, {ATTR_LIST}, count(*) AS n FROM pop GROUP BY ALL")
register("split_train_target", with_() + """
SELECT CASE WHEN year BETWEEN 1995 AND 1999 THEN 'train' ELSE 'target' END AS split, *
FROM pop WHERE year BETWEEN 1995 AND 2000""")
register("split_counts", with_() + """
SELECT CASE WHEN year BETWEEN 1995 AND 1999 THEN 'train' ELSE 'target' END AS split, count(*) AS n
FROM pop WHERE year BETWEEN 1995 AND 2000 GROUP BY 1""")
register("latest_wave", with_() + """
SELECT * FROM pop WHERE year = (SELECT max(year) FROM pop WHERE year BETWEEN 1995 AND 1999)""")
register("domain_filter", with_() + "SELECT * FROM pop_ood WHERE "
         + " AND ".join(in_dom(a, POP_OOD_DOMAIN) for a in POP_ATTRS))
register("attribute_projection", with_() + f"SELECT {ATTR_LIST} FROM pop")
register("stringify", with_() + "SELECT CAST(year AS VARCHAR) AS year, " + ATTR_LIST + " FROM pop")

# ----------------------------------------------------------------- C / D
register("domain_grid", with_(f"""
grid AS (SELECT CAST(row_number() OVER (ORDER BY {', '.join(f'o_{a}' for a in POP_ATTRS)}) - 1 AS BIGINT) AS cell,
       {ATTR_LIST}
FROM {' CROSS JOIN '.join(f"(SELECT unnest({sql_list(POP_DOMAIN[a])}) AS {a}, "
                          f"generate_subscripts({sql_list(POP_DOMAIN[a])}, 1) AS o_{a})" for a in POP_ATTRS)})""",
                              f"cnt AS (SELECT {ATTR_LIST}, count(*) AS n FROM pop GROUP BY ALL)")
         + f"SELECT grid.cell, {', '.join('grid.' + a for a in POP_ATTRS)}, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n "
           f"FROM grid LEFT JOIN cnt USING ({ATTR_LIST})")
register("cell_counts", with_() + f"SELECT year, {ATTR_LIST}, count(*) AS n FROM pop GROUP BY ALL")
register("marginal_dense", with_(f"""
real AS (SELECT * FROM pop WHERE o_orderpriority <> '5-LOW')""",
                                 f"""
longf AS ({' UNION ALL '.join(f"SELECT {q(a)} AS attr, {a} AS cat FROM real" for a in POP_ATTRS)})""") + f"""
SELECT dom.attr, CAST(dom.ord AS INTEGER) AS ord, dom.cat, CAST(count(longf.cat) AS BIGINT) AS n
FROM {dom_values(POP_ATTRS, POP_DOMAIN)} LEFT JOIN longf ON longf.attr = dom.attr AND longf.cat = dom.cat
GROUP BY ALL""")


def _marg_sql(denominator: str) -> str:
    longf = " UNION ALL ".join(f"SELECT {q(a)} AS attr, {a} AS cat FROM real" for a in POP_ATTRS)
    if denominator == "all_rows":
        prop = "c / (SELECT count(*) FROM real)"
    else:
        prop = "COALESCE(c / NULLIF(sum(c) OVER (PARTITION BY attr), 0), 0.0)"
    where = f" WHERE year = {TARGET}" if denominator == "all_rows" else ""
    return with_(f"real AS (SELECT * FROM pop_ood{where})", f"longf AS ({longf})",
                 f"""cnt AS (SELECT dom.attr, dom.ord, dom.cat, count(longf.cat) AS c
                 FROM {dom_values(POP_ATTRS, POP_OOD_DOMAIN)}
                 LEFT JOIN longf ON longf.attr = dom.attr AND longf.cat = dom.cat
                 GROUP BY dom.attr, dom.ord, dom.cat)""") + f"""
SELECT attr, CAST(ord AS INTEGER) AS ord, cat, round(CAST({prop} AS DOUBLE), 6) AS prop FROM cnt"""


register("marginals_all_rows", _marg_sql("all_rows"))
register("marginals_in_domain", _marg_sql("in_domain"))
register("joint_k", with_(f"""
real AS (SELECT * FROM pop_ood WHERE {' AND '.join(in_dom(a, POP_OOD_DOMAIN) for a in PAIR3)})""",
                          f"cnt AS (SELECT {', '.join(PAIR3)}, count(*) AS n FROM real GROUP BY ALL)") + f"""
SELECT {', '.join('g.' + a for a in PAIR3)}, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n,
       round(COALESCE(cnt.n, 0) / (SELECT count(*) FROM real), 6) AS p
FROM (SELECT * FROM {grid_sql(PAIR3, POP_OOD_DOMAIN)}) AS g LEFT JOIN cnt USING ({', '.join(PAIR3)})""")


def _pairs_sql(src: str) -> str:
    parts = []
    for a, b in combinations(POP_ATTRS, 2):
        parts.append(f"SELECT {q(a)} AS a1, {q(b)} AS a2, {a} AS v1, {b} AS v2 FROM {src} "
                     f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return " UNION ALL ".join(parts)


def _pair_dense() -> str:
    rows = ", ".join(f"({q(a)}, {q(b)}, {q(x)}, {q(y)})" for a, b in combinations(POP_ATTRS, 2)
                     for x in POP_DOMAIN[a] for y in POP_DOMAIN[b])
    return f"(VALUES {rows}) AS d(a1, a2, v1, v2)"


register("pairwise_joint", with_("real AS (SELECT * FROM pop)",
                                 f"pr AS ({_pairs_sql('real')})",
                                 "pc AS (SELECT a1, a2, v1, v2, count(*) AS n FROM pr GROUP BY ALL)") + f"""
SELECT d.a1, d.a2, d.v1, d.v2, CAST(COALESCE(pc.n, 0) AS BIGINT) AS n,
       round(COALESCE(COALESCE(pc.n, 0) / NULLIF(sum(COALESCE(pc.n, 0)) OVER (PARTITION BY d.a1, d.a2), 0), 0.0), 6) AS p
FROM {_pair_dense()} LEFT JOIN pc USING (a1, a2, v1, v2)""")
register("inferred_domain", with_("vals AS (" + " UNION ".join(
                                      f"SELECT {q(a)} AS attr, CAST({a} AS VARCHAR) AS cat FROM pop_ood "
                                      f"WHERE {a} IS NOT NULL" for a in POP_ATTRS) + ")") + """
SELECT attr, CAST(row_number() OVER (PARTITION BY attr ORDER BY cat) - 1 AS INTEGER) AS ord, cat FROM vals""")


# ------------------------------------------------------------------ metrics

def _side(name: str, src: str, year: int, extra: str = "") -> str:
    return f"{name} AS (SELECT * FROM {src} WHERE year = {year}{extra})"


def _srmse_sql(attrs) -> str:
    def long(side):
        return " UNION ALL ".join(f"SELECT {q(a)} AS attr, {a} AS cat FROM {side}" for a in attrs)
    return with_(_side("syn", "pop_skew", SYN_YEAR), _side("real", "pop", TARGET),
                 f"ls AS ({long('syn')})", f"lr AS ({long('real')})",
                 f"""ds AS (SELECT dom.attr, dom.ord, count(ls.cat) AS c FROM {dom_values(attrs, POP_DOMAIN)}
                    LEFT JOIN ls ON ls.attr = dom.attr AND ls.cat = dom.cat GROUP BY ALL)""",
                 f"""dr AS (SELECT dom.attr, dom.ord, count(lr.cat) AS c FROM {dom_values(attrs, POP_DOMAIN)}
                    LEFT JOIN lr ON lr.attr = dom.attr AND lr.cat = dom.cat GROUP BY ALL)""",
                 """ps AS (SELECT attr, ord, COALESCE(c / NULLIF(sum(c) OVER (PARTITION BY attr), 0), 0.0) AS p FROM ds)""",
                 """pr AS (SELECT attr, ord, COALESCE(c / NULLIF(sum(c) OVER (PARTITION BY attr), 0), 0.0) AS p FROM dr)""") + """
SELECT ps.attr, round(sqrt(avg((ps.p - pr.p) * (ps.p - pr.p))) * count(*), 6) AS srmse
FROM ps JOIN pr USING (attr, ord) GROUP BY ps.attr"""


register("srmse_one", _srmse_sql(["l_returnflag"]))
register("srmse_all", _srmse_sql(POP_ATTRS))


def _dense_jsd(keys, domain, syn, real, alias="jsd") -> str:
    """Dense JSD over the full grid of ``keys`` (clamp, renormalise, base 2)."""
    on = ", ".join(keys)
    notnull = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""
(SELECT greatest(0.0, sum(0.5 * (a * log2(2 * a / (a + b)) + b * log2(2 * b / (a + b))))) AS {alias}
 FROM (SELECT cp / sum(cp) OVER () AS a, cq / sum(cq) OVER () AS b FROM (
   SELECT greatest(COALESCE(s.n / NULLIF((SELECT count(*) FROM {syn} WHERE {notnull}), 0), 0.0), 1e-12) AS cp,
          greatest(COALESCE(r.n / NULLIF((SELECT count(*) FROM {real} WHERE {notnull}), 0), 0.0), 1e-12) AS cq
   FROM (SELECT * FROM {grid_sql(keys, domain)}) AS g
   LEFT JOIN (SELECT {on}, count(*) AS n FROM {syn} WHERE {notnull} GROUP BY ALL) s USING ({on})
   LEFT JOIN (SELECT {on}, count(*) AS n FROM {real} WHERE {notnull} GROUP BY ALL) r USING ({on}))))"""


register("jsd_one", with_(_side("syn", "pop", SYN_YEAR), _side("real", "pop", TARGET, " AND o_orderpriority <> '5-LOW'"))
         + "SELECT round(jsd, 6) AS jsd FROM " + _dense_jsd(["o_orderpriority"], POP_DOMAIN, "syn", "real") + " t")
register("jsd_full_joint", with_(_side("syn", "pop_skew", SYN_YEAR), _side("real", "pop", TARGET))
         + "SELECT round(jsd_full_joint, 6) AS jsd_full_joint FROM "
         + _dense_jsd(POP_ATTRS, POP_DOMAIN, "syn", "real", "jsd_full_joint") + " t")


def _pair_jsd_union() -> str:
    parts = []
    for a, b in combinations(POP_ATTRS, 2):
        parts.append(f"SELECT {q(a)} AS a1, {q(b)} AS a2, jsd FROM {_dense_jsd([a, b], POP_DOMAIN, 'syn', 'real')} t_{a}_{b}")
    return " UNION ALL ".join(parts)


register("jsd_pairwise", with_(_side("syn", "pop_skew", SYN_YEAR), _side("real", "pop", TARGET))
         + f"SELECT a1, a2, round(jsd, 6) AS jsd FROM ({_pair_jsd_union()}) u")

_srm = _srmse_sql(POP_ATTRS)
_srm_body = _srm[_srm.index("WITH ") + 5: _srm.index("\nSELECT ps.attr")]
register("evaluate_suite", "WITH " + _srm_body + f""",
srm AS (SELECT ps.attr, sqrt(avg((ps.p - pr.p) * (ps.p - pr.p))) * count(*) AS srmse
        FROM ps JOIN pr USING (attr, ord) GROUP BY ps.attr),
pw AS ({_pair_jsd_union()})
SELECT round((SELECT avg(srmse) FROM srm), 6) AS srmse_avg,
       round((SELECT avg(jsd) FROM pw), 6) AS jsd_pairwise_avg,
       round((SELECT jsd_full_joint FROM {_dense_jsd(POP_ATTRS, POP_DOMAIN, 'syn', 'real', 'jsd_full_joint')} t), 6)
         AS jsd_full_joint""")

__all__ = ["ORACLE", "CENSUS_DOMAIN", "DISPLAY_NAMES", "DEFAULT_REGION", "ERA_NARRATIVES"]


# ------------------------------------------------------ sampling / fitting
IPF_N = 10007
POP_TRAIN = "year BETWEEN 1995 AND 1999"


def idx_sql(attrs, domain, prefix="") -> str:
    expr = "0"
    for a in attrs:
        expr = f"(({expr}) * {len(domain[a])} + (list_position({sql_list(domain[a])}, {prefix}{a}) - 1))"
    return expr


def uniform_sql(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0)"


def _grid_idx(domain) -> str:
    return f"(SELECT CAST({idx_sql(POP_ATTRS, domain)} AS BIGINT) AS cell, * FROM {grid_sql(POP_ATTRS, domain)})"


def _seed_ctes(src="pop", domain=POP_DOMAIN):
    return [f"""w_seed AS (SELECT * FROM {src} WHERE year = (SELECT max(year) FROM {src} WHERE {POP_TRAIN})
               AND {' AND '.join(in_dom(a, domain) for a in POP_ATTRS)})""",
            f"cnt_seed AS (SELECT {ATTR_LIST}, count(*) AS c FROM w_seed GROUP BY ALL)",
            f"""seed AS (SELECT g.cell, {', '.join('g.' + a for a in POP_ATTRS)}, CAST(COALESCE(cnt_seed.c, 0) + 0.5 AS DOUBLE) AS seed
               FROM {_grid_idx(domain)} g LEFT JOIN cnt_seed USING ({ATTR_LIST}))"""]


def _targets_ctes(src: str, name="tgt", domain=POP_DOMAIN):
    longf = " UNION ALL ".join(f"SELECT {q(a)} AS attr, {a} AS cat FROM t_src" for a in POP_ATTRS)
    return [f"t_src AS (SELECT * FROM {src} WHERE year = {TARGET})",
            f"t_long AS ({longf})",
            f"""{name} AS (SELECT dom.attr, dom.ord, dom.cat, count(t_long.cat) / (SELECT count(*) FROM t_src) AS prop
               FROM {dom_values(POP_ATTRS, domain)} LEFT JOIN t_long ON t_long.attr = dom.attr AND t_long.cat = dom.cat
               GROUP BY dom.attr, dom.ord, dom.cat)"""]


register("seed_table", with_(*_seed_ctes("pop_ood", POP_OOD_DOMAIN)) + "SELECT * FROM seed")
register("seed_scaled", with_(*_seed_ctes()) + f"""
SELECT cell, {ATTR_LIST}, seed, round(seed * {IPF_N} / (SELECT sum(seed) FROM seed), 6) AS fitted FROM seed""")


IPF_PASSES = 10  # sweeps after which the test tables' fits no longer move


def _ipf_ctes(passes: int, n: int, start: str = "seed", by: str = "", factor: float = 1.0) -> tuple[list[str], str]:
    """CTEs of ``passes`` sweeps from ``start`` to ``tgt``, and the name of the last (column m)."""
    g = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    ctes = [f"m0 AS (SELECT {g}cell, {ATTR_LIST}, seed, seed * {float(n)} / sum(seed) {over} AS m FROM {start})"]
    k = 0
    for _ in range(passes):
        for a in POP_ATTRS:
            ctes.append(f"""m{k + 1} AS (
              SELECT {f"x.{by}, " if by else ""}x.cell, {', '.join('x.' + b for b in POP_ATTRS)}, x.seed,
                     CASE WHEN x.cur > 0 THEN x.m * (COALESCE(t.prop * {factor}, 0.0) * {float(n)} / x.cur) ELSE x.m END AS m
              FROM (SELECT *, sum(m) OVER (PARTITION BY {g}{a}) AS cur FROM m{k}) x
              LEFT JOIN tgt t ON t.attr = {q(a)} AND t.cat = x.{a})""")
            k += 1
    return ctes, f"m{k}"


def _ipf_two_pass_sql() -> str:
    ctes, last = _ipf_ctes(2, IPF_N)
    return with_(*_seed_ctes(), *_targets_ctes("pop_skew"), *ctes) + f"SELECT cell, {ATTR_LIST}, round(m, 6) AS fitted FROM {last}"


def _shares_sql(table: str, value: str) -> str:
    """Fitted share of each category beside its target."""
    long = " UNION ALL ".join(f"SELECT {q(a)} AS attr, {a} AS cat, {value} AS v FROM {table}" for a in POP_ATTRS)
    return f"""
SELECT t.attr, CAST(t.ord AS INTEGER) AS ord, t.cat, round(t.prop, 5) AS target,
       round(COALESCE(s.v, 0.0) / (SELECT sum({value}) FROM {table}), 5) AS fitted
FROM tgt t LEFT JOIN (SELECT attr, cat, sum(v) AS v FROM ({long}) GROUP BY ALL) s USING (attr, cat)"""


register("ipf_two_pass", _ipf_two_pass_sql())
register("fitted_roundtrip", _ipf_two_pass_sql())
_fit, _last = _ipf_ctes(IPF_PASSES, IPF_N)
register("ipf_fitted_marginals", with_(*_seed_ctes(), *_targets_ctes("pop_skew"), *_fit) + _shares_sql(_last, "m"))
_fit, _last = _ipf_ctes(IPF_PASSES, IPF_N, "seeds", "year")
register("ipf_grouped", with_(*_targets_ctes("pop_skew"), f"""
seeds AS (SELECT y.year, g.cell, {', '.join('g.' + a for a in POP_ATTRS)}, CAST(COALESCE(c.n, 0) + 0.5 AS DOUBLE) AS seed
          FROM (SELECT DISTINCT year FROM pop WHERE {POP_TRAIN}) y CROSS JOIN {_grid_idx(POP_DOMAIN)} g
          LEFT JOIN (SELECT year, {ATTR_LIST}, count(*) AS n FROM pop GROUP BY ALL) c USING (year, {ATTR_LIST}))""", *_fit)
         + f"SELECT year, cell, {ATTR_LIST}, round(m, 4) AS fitted FROM {_last}")


def _trs_ctes(values: str, n: int, value: str = "v") -> list[str]:
    """Truncate, replicate, sample: ``trs`` has the counts of the cells of ``values``."""
    return [
        f"fl AS (SELECT cell, {ATTR_LIST}, floor({value}) AS fl, {value} - floor({value}) AS resid FROM {values})",
        "mass AS (SELECT *, CASE WHEN (SELECT sum(resid) FROM fl) > 0 THEN resid ELSE 1.0 END AS mass FROM fl)",
        "iv0 AS (SELECT *, sum(mass) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_hi FROM mass)",
        """iv AS (SELECT *, COALESCE(lag(cum_hi) OVER (ORDER BY cell), 0.0) / (SELECT max(cum_hi) FROM iv0) AS lo,
           cum_hi / (SELECT max(cum_hi) FROM iv0) AS hi FROM iv0)""",
        f"""dr AS (SELECT i, {uniform_sql('i')} AS u
            FROM (SELECT unnest(range(CAST((SELECT greatest({n} - sum(fl), 0) FROM fl) AS BIGINT))) AS i))""",
        "hits AS (SELECT cell, count(*) AS h FROM dr JOIN iv ON dr.u >= iv.lo AND dr.u < iv.hi AND iv.hi > iv.lo GROUP BY cell)",
        f"trs AS (SELECT cell, {ATTR_LIST}, CAST(fl + COALESCE(h, 0) AS BIGINT) AS count FROM fl LEFT JOIN hits USING (cell))"]


SCALED = f"scaled AS (SELECT cell, {ATTR_LIST}, seed * {IPF_N} / (SELECT sum(seed) FROM seed) AS v FROM seed)"
TRS_N = 100_003
for _name, _factor in (("trs_short_targets", 1.0), ("trs_long_targets", 1.2)):
    _fit, _last = _ipf_ctes(2, TRS_N, factor=_factor)
    register(_name, with_(*_seed_ctes("pop_ood", POP_OOD_DOMAIN), *_targets_ctes("pop_ood", domain=POP_OOD_DOMAIN), *_fit,
                          *_trs_ctes(_last, TRS_N, "m")) + f"SELECT cell, {ATTR_LIST}, count, count AS records FROM trs")


register("trs_integerize", with_(*_seed_ctes(), SCALED, *_trs_ctes("scaled", IPF_N)) + "SELECT * FROM trs")
register("expand_cells", with_(*_seed_ctes(), SCALED, *_trs_ctes("scaled", IPF_N), """ex AS (SELECT *, sum(count) OVER (ORDER BY cell ROWS BETWEEN
         UNBOUNDED PRECEDING AND CURRENT ROW) AS chi FROM trs)""") + f"""
SELECT {ATTR_LIST}, r.range AS record FROM ex JOIN range(0, {IPF_N}) r ON r.range >= ex.chi - ex.count AND r.range < ex.chi""")


RAKE_PASSES = 24  # passes of the sequential rule after which the test tables' weights no longer move


def _rake_ctes(start: str, passes: int, attrs=POP_ATTRS, domain=POP_DOMAIN, tgt: str = "tgt", by: str = "", n: str = "n",
               mode: str = "sequential", name: str = "w") -> tuple[list[str], str]:
    """CTEs of ``passes`` raking passes over ``start`` (cells with ``n``), and the name of the last (column w).

    One row of factors for each attribute step: the masses of its categories,
    and the running total that the sequential rule reads after each category.
    """
    cols, g = ", ".join(attrs), f"{by}, " if by else ""
    shares = ", ".join(f"(SELECT prop FROM {tgt} WHERE attr = {q(a)} AND cat = {q(c)}) AS t_{i}_{j}"
                       for i, a in enumerate(attrs) for j, c in enumerate(domain[a]))
    ctes = [f"{name}_t AS MATERIALIZED (SELECT {shares})"]
    listed = " * ".join(f"CASE WHEN {in_dom(a, domain)} THEN 1.0 ELSE 0.0 END" for a in attrs) if mode == "classic" else "1.0"
    ctes.append(f"{name}0 AS MATERIALIZED (SELECT {g}{cols}, {n} AS n, {listed} AS w FROM {start})")
    k = 0
    for _ in range(passes):
        for i, a in enumerate(attrs):
            cats = list(enumerate(domain[a]))
            masses = ", ".join(f"COALESCE(sum(n * w) FILTER (WHERE {a} = {q(c)}), 0.0) AS u{j}" for j, c in cats)
            if mode == "classic":
                all_t = " + ".join(f"t_{i}_{j}" for j, _ in cats)
                steps = ", ".join(f"CASE WHEN u{j} > 0 THEN t_{i}_{j} / ({all_t}) * total / u{j} ELSE 1.0 END AS a{j}" for j, _ in cats)
            else:
                steps, total = [], "total"
                for j, _ in cats:
                    adj = f"CASE WHEN t_{i}_{j} > 0 AND u{j} > 0 THEN t_{i}_{j} * {total} / u{j} ELSE 1.0 END"
                    steps += [f"{adj} AS a{j}", f"{total} + (a{j} - 1.0) * u{j} AS s{j}"]
                    total = f"s{j}"
                steps = ", ".join(steps)
            whole = "sum(n)" if mode == "classic" else "sum(n * w)"
            ctes.append(f"""{name}_f{k} AS MATERIALIZED (SELECT {g}{steps} FROM (
              SELECT {g}{masses}, {whole} AS total FROM {name}{k} {f"GROUP BY {by}" if by else ""}) CROSS JOIN {name}_t)""")
            case = " ".join(f"WHEN {q(c)} THEN f.a{j}" for j, c in cats)
            join = f"JOIN {name}_f{k} f USING ({by})" if by else f"CROSS JOIN {name}_f{k} f"
            ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {g}{cols}, n, w * CASE {a} {case} ELSE 1.0 END AS w FROM {name}{k} {join})")
            k += 1
    return ctes, f"{name}{k}"


SKEW_CELLS = f"skew_cells AS (SELECT {ATTR_LIST}, count(*) AS n FROM pop_skew WHERE year = {SYN_YEAR} GROUP BY ALL)"
_fit, _last = _rake_ctes("skew_cells", 2)
register("rake_weights_two_pass", with_(*_targets_ctes("pop"), SKEW_CELLS, *_fit) + f"SELECT {ATTR_LIST}, n, round(w, 6) AS w FROM {_last}")
RAKED_SKEW = _rake_ctes("skew_cells", RAKE_PASSES)
register("rake_shares", with_(*_targets_ctes("pop"), SKEW_CELLS, *RAKED_SKEW[0]) + _shares_sql(RAKED_SKEW[1], "n * w"))
_fit, _last = _rake_ctes("skew_cells", 10, mode="classic")
register("rake_classic_shares", with_(*_targets_ctes("pop"), SKEW_CELLS, *_fit)
         + f"SELECT {ATTR_LIST}, n, round(w, 5) AS w FROM {_last}")
_fit, _last = _rake_ctes("year_cells", RAKE_PASSES, by="year")
register("rake_grouped", with_(*_targets_ctes("pop"), f"""
year_cells AS (SELECT year, {ATTR_LIST}, count(*) AS n FROM pop_skew WHERE {POP_TRAIN} GROUP BY ALL)""", *_fit)
         + f"SELECT year, {ATTR_LIST}, n, round(w, 5) AS w FROM {_last}")


def _draw_sql(src: str, mass: str, m: str) -> str:
    return with_(
        f"""cells AS (SELECT CAST({idx_sql(POP_ATTRS, POP_DOMAIN)} AS BIGINT) AS cell, {ATTR_LIST}, count(*) AS n
            FROM {src} GROUP BY ALL)""",
        f"cm AS (SELECT *, {mass} AS mass FROM cells)",
        "iv0 AS (SELECT *, sum(mass) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_hi FROM cm)",
        "iv AS (SELECT *, (cum_hi - mass) / (SELECT max(cum_hi) FROM iv0) AS lo, cum_hi / (SELECT max(cum_hi) FROM iv0) AS hi FROM iv0)",
        f"dr AS (SELECT range AS i, {uniform_sql('range')} AS u FROM range(0, {m}))") + f"""
SELECT cell, {ATTR_LIST}, count(*) AS hits FROM dr JOIN iv ON dr.u >= iv.lo AND dr.u < iv.hi GROUP BY ALL"""


register("weighted_draw", _draw_sql("pop", "n", "5000"))
register("resample_multinomial", _draw_sql(
    "pop_skew", f"n * list_position({sql_list(POP_DOMAIN['l_returnflag'])}, l_returnflag)",
    "(SELECT count(*) FROM pop_skew)"))
register("subsample_exact", with_(f"""
rid AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid, year, {ATTR_LIST}
        FROM pop_base WHERE {POP_TRAIN})""") + f"""
SELECT rid, year, {ATTR_LIST} FROM rid ORDER BY {uniform_sql('rid')}, rid LIMIT 20000""")


# --------------------------------------------------- text and validation
from popweave.domain import TARGET_YEAR as CEN_TARGET, TRAIN_YEARS as CEN_TRAIN  # noqa: E402

CA = ["sex", "age_group", "edu", "occupation", "marital_status"]
CD = CENSUS_DOMAIN
REGION = DEFAULT_REGION
WS_CHARS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
            r"\x{205F}\x{3000}")
WS = f"[{WS_CHARS}]"
STRIP = f"^{WS}+|{WS}+$"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP)}, '', 'g')"


ERA_CTE = "era(year, narrative) AS (VALUES " + ", ".join(
    f"({y}, {q(n)})" for y, n in sorted(ERA_NARRATIVES.items())) + ")"
CEN_CTE = f"""cen AS (SELECT o_orderkey AS id, CAST(1990 + 5 * (o_orderkey % 12) AS INTEGER) AS year,
  {sql_list(CD['sex'])}[o_orderkey % 2 + 1] AS sex,
  {sql_list(CD['age_group'])}[o_custkey % 18 + 1] AS age_group,
  CASE WHEN o_orderkey % 97 <> 0 THEN {sql_list(CD['edu'])}[(o_orderkey // 2) % 7 + 1] END AS edu,
  {sql_list(CD['occupation'])}[(o_orderkey // 14) % 8 + 1] AS occupation,
  {sql_list(CD['marital_status'])}[(o_orderkey // 112) % 4 + 1] AS marital_status,
  o_custkey FROM orders)"""


def body_sql(vals: dict[str, str]) -> str:
    return "concat_ws(', ', " + ", ".join(
        f"CASE WHEN {vals[a]} IS NOT NULL THEN {q(DISPLAY_NAMES[a] + ' is ')} || {vals[a]} END" for a in CA) + ")"


def prefix_sql(year: str) -> str:
    return f"'In ' || {year} || {q(', a resident of ' + REGION + ' was recorded: ')}"


GEN_CTE = f"""g0 AS (SELECT *, CAST((id + o_custkey) % 12 AS INTEGER) AS gen_case FROM cen),
g1 AS (SELECT id, year, gen_case,
  CASE WHEN gen_case = 1 THEN lower(sex) ELSE sex END AS v_sex,
  CASE WHEN gen_case = 1 THEN lower(age_group) ELSE age_group END AS v_age_group,
  CASE WHEN gen_case = 2 THEN edu || ' dropout' WHEN gen_case = 8 THEN NULL
       WHEN gen_case = 1 THEN lower(edu) ELSE edu END AS v_edu,
  CASE WHEN gen_case = 1 THEN lower(occupation) ELSE occupation END AS v_occupation,
  CASE WHEN gen_case = 3 THEN substr(marital_status, 1, 4) WHEN gen_case = 4 THEN substr(marital_status, 1, 2)
       WHEN gen_case = 1 THEN lower(marital_status) ELSE marital_status END AS v_marital_status
  FROM g0),
g2 AS (SELECT g1.id, g1.year, g1.gen_case,
  CASE WHEN g1.gen_case = 6 AND era.narrative IS NOT NULL THEN '[Context: ' || era.narrative || '] ' ELSE '' END
  || CASE WHEN g1.gen_case <> 9 THEN {prefix_sql('g1.year')} ELSE '' END
  || {body_sql({a: 'g1.v_' + a for a in CA})}
  || CASE g1.gen_case WHEN 5 THEN {q(', In 2020, a resident of ' + REGION + ' was recorded: Sex is Male')}
                      WHEN 7 THEN '. . ' WHEN 10 THEN ', Sex is Other' ELSE '' END AS text
  FROM g1 LEFT JOIN era ON era.year = g1.year),
gen AS (
  SELECT id, year, gen_case, id // 64 AS batch, CAST(id % 64 AS INTEGER) AS pos, text FROM g2
  UNION ALL
  SELECT -1 - doc_id, CAST(1990 + 5 * (doc_id % 12) AS INTEGER), 11, doc_id // 8, CAST(64 + doc_id % 8 AS INTEGER), text
  FROM documents)"""


def parse_ctes(src: str = "gen") -> list[str]:
    ctx = f"^\\[Context:.*?\\]{WS}*"
    second = f"(?s)(?:,{WS}*)?In \\p{{Nd}}{{4}}[,{WS_CHARS}].*"
    names = " ".join(f"WHEN {q(v)} THEN {q(k)}" for k, v in DISPLAY_NAMES.items())
    return [
        f"p0 AS (SELECT id, batch, pos, regexp_replace(text, {q(ctx)}, '') AS t FROM {src})",
        f"""p1 AS (SELECT id, batch, pos,
          CASE WHEN starts_with(t, 'In ') THEN CAST(TRY_CAST({strip_sql("replace(split_part(t, ',', 1), 'In ', '')")}
               AS BIGINT) AS VARCHAR) END AS pyear,
          CASE WHEN starts_with(t, 'In ') AND strpos(t, 'was recorded: ') > 0 THEN substr(t, strpos(t, 'was recorded: ') + 14)
               WHEN starts_with(t, 'In ') AND strpos(t, ': ') > 0 THEN substr(t, strpos(t, ': ') + 2)
               ELSE t END AS body FROM p0)""",
        f"p2 AS (SELECT id, batch, pos, pyear, rtrim(regexp_replace(body, {q(second)}, ''), '. ' || chr(9) || chr(10)) AS body FROM p1)",
        f"""p3 AS (SELECT id, batch, pos, pyear, list_transform(
              list_filter(string_split(body, ', '), lambda x: contains(x, ' is ')),
              lambda x: {{'name': {strip_sql("substr(x, 1, strpos(x, ' is ') - 1)")},
                          'value': rtrim({strip_sql("substr(x, strpos(x, ' is ') + 4)")}, '.')}}) AS kv0 FROM p2)""",
        f"""p4 AS (SELECT id, batch, pos, pyear, list_transform(kv0, lambda x: {{'k': CASE x.name {names}
              ELSE replace(lower(x.name), ' ', '_') END, 'v': x.value}}) AS kv FROM p3)""",
        "parsed AS (SELECT id, batch, pos, COALESCE(pyear, list_filter(kv, lambda x: x.k = 'year')[1].v) AS year, "
        + ", ".join(f"list_filter(kv, lambda x: x.k = {q(a)})[1].v AS {a}" for a in CA) + " FROM p4)"]


def fuzzy_sql(v: str, cats) -> str:
    vv = strip_sql(f"lower({v})")
    parts = [f"WHEN {vv} = {q(c.lower())} THEN {q(c)}" for c in cats]
    parts += [f"WHEN starts_with({vv}, {q(c.lower())}) THEN {q(c)}" for c in cats]
    parts += [f"WHEN length({vv}) >= 3 AND starts_with({q(c.lower())}, {vv}) THEN {q(c)}" for c in cats]
    return "CASE " + " ".join(parts) + " END"


def match_sql(v: str, cats) -> str:
    return f"CASE WHEN {v} IN ({', '.join(q(c) for c in cats)}) THEN {v} ELSE {fuzzy_sql(v, cats)} END"


def zero_conds(src_prefix: str = "") -> list[tuple[str, str]]:
    idx = f"(list_position({sql_list(CD['age_group'])}, {src_prefix}age_group) - 1)"

    def bad(attr, allowed):
        v = f"{src_prefix}{attr}"
        return f"{v} IS NOT NULL AND {v} <> '' AND {v} NOT IN ({', '.join(q(x) for x in allowed)})"
    return [("Z1", f"{idx} = 0 AND {bad('edu', ['No schooling'])}"),
            ("Z2", f"{idx} = 1 AND {bad('edu', ['No schooling', 'Elementary school'])}"),
            ("Z3", f"{idx} = 2 AND {bad('edu', ['No schooling', 'Elementary school', 'Middle school'])}"),
            ("Z4", f"{idx} BETWEEN 0 AND 2 AND {bad('marital_status', ['Never married'])}"),
            ("Z5", f"{idx} BETWEEN 0 AND 2 AND {bad('occupation', ['Not economically active'])}")]


def cwith(*ctes: str) -> str:
    return "WITH " + ",\n".join((ERA_CTE, CEN_CTE) + ctes) + "\n"


CEN_BODY = body_sql({a: a for a in CA})
register("serialize_plain", cwith() + f"SELECT id, {prefix_sql('year')} || {CEN_BODY} AS text FROM cen")


def _permuted_sql(where: str) -> str:
    pieces = " UNION ALL ".join(
        f"SELECT id, year, md5('42:' || id || ':' || {q(a)}) AS k, {q(DISPLAY_NAMES[a] + ' is ')} || {a} AS p "
        f"FROM cen WHERE {a} IS NOT NULL AND {where}" for a in CA)
    return cwith(f"pc AS ({pieces})") + f"""
SELECT id, {prefix_sql('year')} || string_agg(p, ', ' ORDER BY k, p) AS text FROM pc GROUP BY id, year"""


register("serialize_permuted", _permuted_sql("true"))
register("corpus_train", _permuted_sql(f"year IN ({', '.join(str(y) for y in CEN_TRAIN)})"))
register("corpus_val", cwith() + f"SELECT id, {prefix_sql('year')} || {CEN_BODY} AS text FROM cen WHERE year = {CEN_TARGET}")
register("serialize_era", cwith() + f"""
SELECT id, CASE WHEN era.narrative IS NOT NULL AND era.narrative <> ''
  THEN '[Context: ' || era.narrative || '] ' ELSE '' END || {prefix_sql('cen.year')} || {CEN_BODY} AS text
FROM cen LEFT JOIN era ON era.year = cen.year""")
register("era_prefix", cwith() + f"""
SELECT y.year, CASE WHEN era.narrative IS NOT NULL AND era.narrative <> ''
  THEN '[Context: ' || era.narrative || '] ' ELSE '' END || {prefix_sql('y.year')} AS prefix
FROM (SELECT DISTINCT year FROM cen) y LEFT JOIN era ON era.year = y.year""")
register("era_join", cwith() + "SELECT id, cen.year AS year, narrative FROM cen LEFT JOIN era ON era.year = cen.year")
register("prompt_table", cwith() + f"""
SELECT id, {prefix_sql('year')} || 'Sex is ' || sex || ', Age Group is ' || age_group || ', ' AS prompt FROM cen""")
register("parse_records", cwith(GEN_CTE, *parse_ctes()) + f"SELECT id, year, {', '.join(CA)} FROM parsed")
register("fuzzy_match", cwith(GEN_CTE, *parse_ctes(), "vals AS (" + " UNION ".join(
    f"SELECT {q(a)} AS attr, {a} AS value FROM parsed WHERE {a} IS NOT NULL AND {a} NOT IN "
    f"({', '.join(q(c) for c in CD[a])})" for a in CA) + ")") + "SELECT attr, value, CASE attr " + " ".join(
    f"WHEN {q(a)} THEN {fuzzy_sql('value', CD[a])}" for a in CA) + " END AS matched FROM vals")
register("structural_zero_violations", cwith() + "SELECT id, viol AS violations FROM (SELECT id, concat_ws(',', "
         + ", ".join(f"CASE WHEN {c} THEN {q(r)} END" for r, c in zero_conds()) + ") AS viol FROM cen) WHERE viol <> ''")
register("violation_counts", cwith() + "SELECT rule_id, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT {q(r)} AS rule_id FROM cen WHERE {c}" for r, c in zero_conds()) + ") GROUP BY rule_id")

VALIDATED = [f"""m AS (SELECT id, batch, pos, ({' AND '.join(f'{a} IS NOT NULL' for a in CA)}) AS complete,
    {', '.join(f'{match_sql(a, CD[a])} AS {a}' for a in CA)} FROM parsed)""",
             f"""v AS (SELECT *, CASE WHEN NOT complete THEN 'incomplete'
                 WHEN NOT ({' AND '.join(f'{a} IS NOT NULL' for a in CA)}) THEN 'unmatched'
                 WHEN {' OR '.join(f'COALESCE({c}, false)' for _, c in zero_conds())} THEN 'infeasible' END AS reason
             FROM m)"""]
register("validate_generated", cwith(GEN_CTE, *parse_ctes(), *VALIDATED)
         + f"SELECT id, {', '.join(CA)} FROM v WHERE reason IS NULL")
register("reject_reasons", cwith(GEN_CTE, *parse_ctes(), *VALIDATED)
         + "SELECT COALESCE(reason, 'accepted') AS reason, count(*) AS n FROM v GROUP BY 1")
GEN_N = "(SELECT greatest(count(*) // 2, 1) FROM orders)"
GEN_MAXB = f"greatest(CAST(ceil({GEN_N} / 64.0) AS BIGINT) * 3, 10)"
BATCHES = [f"""bs AS (SELECT batch, count(*) FILTER (WHERE reason IS NULL) AS acc, count(*) FILTER (WHERE reason IS NOT NULL) AS fail
              FROM v WHERE batch < {GEN_MAXB} GROUP BY batch)""",
           """bc AS (SELECT *, COALESCE(sum(acc) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS acc_before FROM bs)""",
           f"proc AS (SELECT * FROM bc WHERE acc_before < {GEN_N})",
           f"""pool AS (SELECT batch, pos, id, {', '.join(CA)} FROM (
              SELECT v.*, row_number() OVER (ORDER BY v.batch, v.pos) AS r FROM v JOIN proc USING (batch) WHERE v.reason IS NULL)
              WHERE r <= {GEN_N})"""]
STATS = f"""
SELECT CAST({GEN_N} AS BIGINT) AS requested, CAST(least(sum(acc), {GEN_N}) AS BIGINT) AS accepted,
       CAST(sum(fail) AS BIGINT) AS failed, count(*) AS batches,
       least(sum(acc), {GEN_N}) / {GEN_N} AS fill_rate,
       least(sum(acc), {GEN_N}) / greatest(least(sum(acc), {GEN_N}) + sum(fail), 1) AS parse_rate
FROM proc"""
register("take_accepted", cwith(GEN_CTE, *parse_ctes(), *VALIDATED, *BATCHES) + "SELECT * FROM pool")
register("generation_stats", cwith(GEN_CTE, *parse_ctes(), *VALIDATED, *BATCHES)
         + f"SELECT * REPLACE (round(fill_rate, 6) AS fill_rate, round(parse_rate, 6) AS parse_rate) FROM ({STATS})")


# -------------------------------------------------------- conditional sampler
POP_N = 5000


def _sample_ctes(src: str, where: str, n: int, name: str = "drawn") -> list[str]:
    """``n`` draws from the cells of ``src``: ``(attrs, hits)``."""
    return [
        f"s_cells AS (SELECT {ATTR_LIST}, count(*) AS n FROM {src} WHERE {where} GROUP BY ALL)",
        f"s_iv0 AS (SELECT *, sum(n) OVER (ORDER BY {ATTR_LIST} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chi FROM s_cells)",
        "s_iv AS (SELECT *, (chi - n) / (SELECT max(chi) FROM s_iv0) AS lo, chi / (SELECT max(chi) FROM s_iv0) AS hi FROM s_iv0)",
        f"s_dr AS (SELECT range AS i, {uniform_sql('range')} AS u FROM range(0, {n}))",
        f"{name} AS (SELECT {ATTR_LIST}, count(*) AS hits FROM s_dr JOIN s_iv ON u >= lo AND u < hi GROUP BY ALL)"]


for _name, _where in (("conditional_sample", "year = 1998"), ("conditional_sample_pooled", POP_TRAIN)):
    register(_name, with_(*_sample_ctes("pop", _where, POP_N)) + f"SELECT {ATTR_LIST}, hits FROM drawn")


def _rake_recursive(cells: str, passes: int, attrs, domain, tgt: str, name: str) -> tuple[list[str], str]:
    """``_rake_ctes`` of the sequential rule as a recursion over attribute steps, for long passes over many categories.

    Its state is the list of all factors; a step folds the categories of one
    attribute in order, with the running total beside the adjustments.
    """
    cols, starts, at = ", ".join(attrs), [], 0
    for a in attrs:
        starts.append(at)
        at += len(domain[a])
    codes = ", ".join(f"{s} + list_position({sql_list(domain[a])}, {a})" for a, s in zip(attrs, starts))
    goals = ", ".join(f"({i}, {s + j + 1}, {q(a)}, {q(c)})" for i, (a, s) in enumerate(zip(attrs, starts)) for j, c in enumerate(domain[a]))
    step = f"k % {len(attrs)}"
    zero = "'s': 0.0::DOUBLE, 'a': CAST([] AS DOUBLE[])"
    moves = "x.t > 0 AND x.u > 0"
    return [
        f"{name}_c AS MATERIALIZED (SELECT {cols}, n, [{codes}] AS code FROM {cells})",
        f"""{name}_g AS MATERIALIZED (SELECT g.i, g.j, CAST(t.prop AS DOUBLE) AS t FROM (VALUES {goals}) AS g(i, j, attr, cat)
            JOIN {tgt} t ON t.attr = g.attr AND t.cat = g.cat)""",
        f"""{name}_st(k, f) AS (
          SELECT 0, list_transform(range({at}), lambda x: 1.0::DOUBLE)
          UNION ALL
          SELECT k + 1, list_transform(f, lambda x, i: CASE WHEN i >= lo AND i < lo + len(adj) THEN x * adj[i - lo + 1] ELSE x END) FROM (
            SELECT any_value(k) AS k, any_value(f) AS f, min(j) AS lo,
                   list_reduce(list_prepend({{'s': any_value(total), 'a': CAST([] AS DOUBLE[]), 't': 0.0::DOUBLE, 'u': 0.0::DOUBLE}},
                     list({{{zero}, 't': t, 'u': u}} ORDER BY j)),
                     lambda p, x: {{'s': CASE WHEN {moves} THEN p.s + (x.t * p.s / x.u - 1.0) * x.u ELSE p.s END,
                       'a': list_append(p.a, CASE WHEN {moves} THEN x.t * p.s / x.u ELSE 1.0 END), 't': x.t, 'u': x.u}}).a AS adj
            FROM (SELECT m.k, m.f, m.total, g.j, g.t, COALESCE(map_extract(m.u, CAST(g.j AS BIGINT))[1], 0.0) AS u
                  FROM (SELECT k, any_value(f) AS f, sum(mass) AS total, map_from_entries(list({{'k': c, 'v': mass}})) AS u FROM (
                          SELECT k, any_value(f) AS f, CAST(code[{step} + 1] AS BIGINT) AS c,
                                 sum(n * list_product(list_transform(code, lambda x: f[x]))) AS mass
                          FROM {name}_st CROSS JOIN {name}_c WHERE k < {passes * len(attrs)} GROUP BY k, code[{step} + 1]) GROUP BY k) m
                  JOIN {name}_g g ON g.i = m.{step}) GROUP BY k))""",
        f"""{name}_last AS MATERIALIZED (SELECT {cols}, n, list_product(list_transform(code, lambda x: f[x])) AS w
            FROM {name}_c CROSS JOIN (SELECT f FROM {name}_st WHERE k = {passes * len(attrs)}))"""], f"{name}_last"


def _resample_ctes(cells: str, passes: int, attrs=POP_ATTRS, domain=POP_DOMAIN, tgt: str = "tgt", name: str = "raked",
                   rake=None) -> list[str]:
    """Rake the cells (``n`` records each), then draw as many records: ``(attrs, hits)``, in the order of the rows' MD5."""
    cols = ", ".join(attrs)
    ctes, last = (rake or _rake_ctes)(cells, passes, attrs, domain, tgt, name=f"{name}_w")
    key = "md5('{' || " + " || ',' || ".join(f"'\"{a}\":\"' || {a} || '\"'" for a in attrs) + " || '}')"
    return ctes + [
        f"{name}_m AS (SELECT {cols}, {key} AS rid, n * w AS mass FROM {last})",
        f"{name}_i0 AS (SELECT *, sum(mass) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chi FROM {name}_m)",
        f"""{name}_iv AS (SELECT *, COALESCE(lag(chi) OVER (ORDER BY rid), 0.0) / (SELECT max(chi) FROM {name}_i0) AS lo,
            chi / (SELECT max(chi) FROM {name}_i0) AS hi FROM {name}_i0)""",
        f"""{name}_dr AS (SELECT i, {uniform_sql('i')} AS u
            FROM (SELECT unnest(range(CAST((SELECT sum(n) FROM {cells}) AS BIGINT))) AS i))""",
        f"{name} AS (SELECT {cols}, count(*) AS hits FROM {name}_dr JOIN {name}_iv ON u >= lo AND u < hi GROUP BY ALL)"]


def _records(cells: str, count: str, attrs=POP_ATTRS) -> str:
    cols = ", ".join(attrs)
    return f"(SELECT {cols} FROM (SELECT {cols}, unnest(range({count})) AS i FROM {cells}))"


def _srmse_avg(syn: str, real: str, attrs, domain) -> str:
    def shares(side):
        long = " UNION ALL ".join(f"SELECT {q(a)} AS attr, {a} AS cat FROM {side}" for a in attrs)
        return f"""(SELECT attr, ord, COALESCE(c / NULLIF(sum(c) OVER (PARTITION BY attr), 0), 0.0) AS p FROM (
          SELECT dom.attr, dom.ord, count(l.cat) AS c FROM {dom_values(attrs, domain)}
          LEFT JOIN ({long}) l ON l.attr = dom.attr AND l.cat = dom.cat GROUP BY ALL))"""
    return f"""(SELECT avg(e) FROM (SELECT s.attr, sqrt(avg((s.p - r.p) * (s.p - r.p))) * count(*) AS e
      FROM {shares(syn)} s JOIN {shares(real)} r USING (attr, ord) GROUP BY s.attr))"""


def _pair_avg(syn: str, real: str, attrs, domain) -> str:
    parts = " UNION ALL ".join(f"SELECT jsd FROM {_dense_jsd([a, b], domain, syn, real)} t_{i}"
                               for i, (a, b) in enumerate(combinations(attrs, 2)))
    return f"(SELECT avg(jsd) FROM ({parts}))"


def _joint(syn: str, real: str, attrs, domain) -> str:
    return f"(SELECT jsd FROM {_dense_jsd(attrs, domain, syn, real)} t)"


def _method(label: str, ctes: list[str], raked: bool, attrs=POP_ATTRS, domain=POP_DOMAIN) -> tuple[list[str], str]:
    """CTEs up to ``syn`` and ``real`` (and ``syn_raked``), and the result row over them."""
    r6 = lambda x: f"round({x}, 6)"
    of = (lambda f: r6(f("syn_raked", "real", attrs, domain))) if raked else (lambda f: "CAST(NULL AS DOUBLE)")
    return ctes, f"""SELECT {q(label)} AS method, {r6(_srmse_avg("syn", "real", attrs, domain))} AS srmse_avg,
      {r6(_joint("syn", "real", attrs, domain))} AS jsd_full_joint, {of(_srmse_avg)} AS srmse_avg_ipf,
      {of(_joint)} AS jsd_full_joint_ipf, {r6(_pair_avg("syn", "real", attrs, domain))} AS jsd_pairwise_avg"""


def _materialized(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED {body}"


register("rake_resample", with_(*_targets_ctes("pop"), SKEW_CELLS, *_resample_ctes("skew_cells", RAKE_PASSES))
         + f"SELECT * FROM {_records('raked', 'hits')}")
register("oversample_rake", with_(*_targets_ctes("pop"), *_sample_ctes("pop", POP_TRAIN, 4 * POP_N),
                                  f"pool_cells AS (SELECT {ATTR_LIST}, hits AS n FROM drawn)",
                                  *_resample_ctes("pool_cells", RAKE_PASSES)) + f"SELECT * FROM {_records('raked', 'hits')}")

REAL = _materialized("real", f"(SELECT {ATTR_LIST} FROM pop WHERE year = {TARGET})")
_fit, _last = _ipf_ctes(IPF_PASSES, POP_N)
METHOD_IPF = _method("IPF", [*_seed_ctes(), *_targets_ctes("pop"), *_fit, *_trs_ctes(_last, POP_N, "m"), REAL,
                             _materialized("syn", _records("trs", "count"))], False)
METHOD_CONDITIONAL = _method("Conditional", [
    *_targets_ctes("pop"), *_sample_ctes("pop_skew", POP_TRAIN, POP_N), f"pool_cells AS (SELECT {ATTR_LIST}, hits AS n FROM drawn)",
    *_resample_ctes("pool_cells", RAKE_PASSES), REAL, _materialized("syn", _records("drawn", "hits")),
    _materialized("syn_raked", _records("raked", "hits"))], True)
register("method_ipf", with_(*METHOD_IPF[0]) + METHOD_IPF[1])
register("method_conditional", with_(*METHOD_CONDITIONAL[0]) + METHOD_CONDITIONAL[1])


# ------------------------------------------------ the text method's inputs
_pieces = " UNION ALL ".join(
    f"SELECT id, year, md5('42:' || id || ':' || {q(a)}) AS k, {q(DISPLAY_NAMES[a] + ' is ')} || {a} AS p FROM sub WHERE {a} IS NOT NULL"
    for a in CA)
_context = "CASE WHEN era.narrative IS NOT NULL THEN '[Context: ' || era.narrative || '] ' ELSE '' END"
register("text_corpus", cwith(f"""
sub AS (SELECT * FROM cen WHERE year IN ({', '.join(str(y) for y in CEN_TRAIN)})
        ORDER BY {uniform_sql('id')}, id LIMIT (SELECT {GEN_N} // 2))""", f"pc AS ({_pieces})") + f"""
SELECT id, {_context} || {prefix_sql('x.year')} || body AS text
FROM (SELECT id, year, string_agg(p, ', ' ORDER BY k, p) AS body FROM pc GROUP BY id, year) x LEFT JOIN era ON era.year = x.year""")
register("prompt_batch", cwith(f"""
spec AS (SELECT cen.year, {_context} || {prefix_sql('cen.year')} || 'Sex is ' || sex || ', Age Group is ' || age_group || ', ' AS prompt
         FROM cen LEFT JOIN era ON era.year = cen.year)""") + """
SELECT i // 64 AS batch, CAST(i % 64 AS INTEGER) AS pos, prompt
FROM (SELECT prompt, row_number() OVER (ORDER BY year, prompt) - 1 AS i FROM spec)""")


# ------------------------------------------- fits without a grid, stored factors
register("ipf_implicit", _ipf_two_pass_sql())
_fit, _last = _ipf_ctes(2, IPF_N)
_first = {a: POP_DOMAIN[a][0] for a in POP_ATTRS}
_line = {a: " AND ".join(f"{b} = {q(_first[b])}" for b in POP_ATTRS if b != a) for a in POP_ATTRS}
# A category's factor, up to a common one: the weight of the cell that has it and first categories else.
_run = " UNION ALL ".join(f"""SELECT {q(a)} AS attr, {a} AS cat, w,
  sum(w) OVER (ORDER BY list_position({sql_list(POP_DOMAIN[a])}, {a}) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chi
  FROM wgt WHERE {_line[a]}""" for a in POP_ATTRS)
register("ipf_implicit_sample", with_(
    *_seed_ctes(), *_targets_ctes("pop_skew"), *_fit,
    f"wgt AS (SELECT cell, {ATTR_LIST}, seed - 0.5 AS c, m / seed AS w FROM {_last})",
    "parts AS (SELECT sum(c * w) AS a, sum(0.5 * w) AS b FROM wgt)",
    "iv0 AS (SELECT *, sum(c * w) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chi FROM wgt WHERE c * w > 0)",
    "iv AS (SELECT *, COALESCE(lag(chi) OVER (ORDER BY cell), 0.0) AS clo FROM iv0)",
    f"dr AS (SELECT range AS i, {uniform_sql('range')} * (SELECT a + b FROM parts) AS p FROM range(0, {IPF_N}))",
    f"run AS ({_run})", "top AS (SELECT attr, max(chi) AS s FROM run GROUP BY attr)",
    *[f"""free_{a} AS (SELECT d.i, min_by(r.cat, r.chi) AS {a} FROM dr d JOIN run r ON r.attr = {q(a)}
        AND r.chi > {uniform_sql(f"d.i || ':{a}'")} * (SELECT s FROM top WHERE attr = {q(a)})
        WHERE d.p >= (SELECT a FROM parts) GROUP BY d.i)""" for a in POP_ATTRS],
    f"""drawn AS (SELECT {ATTR_LIST} FROM dr JOIN iv ON p >= clo AND p < chi WHERE p < (SELECT a FROM parts)
        UNION ALL SELECT {ATTR_LIST} FROM free_{POP_ATTRS[0]} {' '.join(f'JOIN free_{a} USING (i)' for a in POP_ATTRS[1:])})""")
    + f"SELECT {ATTR_LIST}, count(*) AS hits FROM drawn GROUP BY ALL")

# Consistent targets, all of them of one table: the fitted shares are the targets.
WIDE = {**POP_DOMAIN, "c_nationkey": range(25), "l_quantity": range(1, 51), "l_discount": range(11), "l_tax": range(9),
        "l_linenumber": range(1, 8), "o_month": range(1, 13), "o_day": range(1, 32), "l_shipday": range(1, 32)}
_wide_of = {a: a for a in WIDE} | {"l_quantity": "CAST(l_quantity AS INTEGER)", "l_discount": "CAST(round(l_discount * 100) AS INTEGER)",
                                   "l_tax": "CAST(round(l_tax * 100) AS INTEGER)", "o_month": "month(o_orderdate)",
                                   "o_day": "day(o_orderdate)", "l_shipday": "day(l_shipdate)"}
_wide_long = " UNION ALL ".join(f"SELECT {q(a)} AS attr, CAST({x} AS VARCHAR) AS cat FROM wide" for a, x in _wide_of.items())
_wide_dom = {a: [str(c) for c in cs] for a, cs in WIDE.items()}
register("ipf_implicit_wide", f"""
WITH wide AS (SELECT * FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
              WHERE year(o_orderdate) = {TARGET}),
long AS ({_wide_long})
SELECT dom.attr, CAST(dom.ord AS INTEGER) AS ord, dom.cat, round(count(long.cat) / (SELECT count(*) FROM wide), 5) AS target,
       round(count(long.cat) / (SELECT count(*) FROM wide), 5) AS fitted
FROM {dom_values(list(WIDE), _wide_dom)} LEFT JOIN long ON long.attr = dom.attr AND long.cat = dom.cat
GROUP BY dom.attr, dom.ord, dom.cat""")

# Weights of every cell of the grid, also of those that the raked wave lacks.
_fit, _last = _rake_ctes("grid_cells", RAKE_PASSES)
register("factors_apply", with_(*_targets_ctes("pop"), SKEW_CELLS, f"""
grid_cells AS (SELECT {', '.join('g.' + a for a in POP_ATTRS)}, COALESCE(s.n, 0) AS n FROM {_grid_idx(POP_DOMAIN)} g
               LEFT JOIN skew_cells s USING ({ATTR_LIST}))""", *_fit) + f"""
SELECT {ATTR_LIST}, r.n, round(w.w, 5) AS w
FROM (SELECT {ATTR_LIST}, count(*) AS n FROM pop WHERE year = {SYN_YEAR - 1} GROUP BY ALL) r JOIN {_last} w USING ({ATTR_LIST})""")

register("fuzzy_inferred", f"""
WITH dom AS (SELECT c_name AS cat, lower(c_name) AS low, row_number() OVER (ORDER BY c_name) AS ord FROM (SELECT DISTINCT c_name FROM customer)),
vals AS (SELECT DISTINCT CASE o_orderkey % 5 WHEN 1 THEN upper(c_name) WHEN 2 THEN c_name || ' jr' WHEN 3 THEN substr(c_name, 1, 15)
           WHEN 4 THEN substr(c_name, 1, 2) ELSE c_name END AS value FROM orders JOIN customer ON o_custkey = c_custkey),
plain AS (SELECT value, {strip_sql("lower(value)")} AS v FROM vals),
hits AS (SELECT value, cat, ord, CASE WHEN value = cat THEN 0 WHEN v = low THEN 1 WHEN starts_with(v, low) THEN 2 ELSE 3 END AS rule
         FROM plain JOIN dom ON value = cat OR v = low OR starts_with(v, low) OR (length(v) >= 3 AND starts_with(low, v)))
SELECT 'c_name' AS attr, value, (SELECT cat FROM hits h WHERE h.value = plain.value ORDER BY rule, ord LIMIT 1) AS matched FROM plain""")


# ------------------------------------------------ the text method and the table of methods
TEXT_PASSES = 100  # as many as the operator makes at most
_cen_long = " UNION ALL ".join(f"SELECT {q(a)} AS attr, {a} AS cat FROM real" for a in CA)
_text_ctes = [
    *parse_ctes(), VALIDATED[0], VALIDATED[1].replace("v AS (", "v AS MATERIALIZED (", 1),
    *[c.replace("pool AS (", "pool AS MATERIALIZED (", 1).replace("proc AS (", "proc AS MATERIALIZED (", 1) for c in BATCHES],
    _materialized("real", f"(SELECT {', '.join(CA)} FROM cen WHERE year = {CEN_TARGET})"),
    f"t_long AS ({_cen_long})",
    _materialized("tgt", f"""(SELECT dom.attr, dom.ord, dom.cat, count(t_long.cat) / (SELECT count(*) FROM real) AS prop
      FROM {dom_values(CA, CD)} LEFT JOIN t_long ON t_long.attr = dom.attr AND t_long.cat = dom.cat GROUP BY dom.attr, dom.ord, dom.cat)"""),
    _materialized("syn", f"(SELECT {', '.join(CA)} FROM pool)"),
    _materialized("pool_cells", f"(SELECT {', '.join(CA)}, count(*) AS n FROM syn GROUP BY ALL)"),
    *_resample_ctes("pool_cells", TEXT_PASSES, CA, CD, rake=_rake_recursive), _materialized("syn_raked", _records("raked", "hits", CA))]
METHOD_TEXT = _method("Text", _text_ctes, True, CA, CD)
_text_row = METHOD_TEXT[1] + f""", (SELECT accepted FROM ({STATS})) AS n_generated, round((SELECT fill_rate FROM ({STATS})), 6) AS parse_rate"""
register("method_text", cwith(GEN_CTE, *METHOD_TEXT[0]).replace("WITH", "WITH RECURSIVE", 1) + _text_row)


def _named_apart(ctes: list[str], body: str, suffix: str, names: list[str]) -> tuple[list[str], str]:
    """The same CTEs under other names, so that several methods fit one statement."""
    import re

    def renamed(text: str) -> str:
        return re.sub(r"\b(" + "|".join(map(re.escape, names)) + r")\b", lambda m: m[1] + suffix, text)

    return [renamed(c) for c in ctes], renamed(body)


def _cte_names(ctes: list[str]) -> list[str]:
    return [c.strip().split()[0].split("(")[0] for c in ctes]


_parts, _rows = [], []
for _k, (_ctes, _body) in enumerate((METHOD_IPF, METHOD_CONDITIONAL, METHOD_TEXT)):
    _c, _b = _named_apart(_ctes, _body, f"_{_k}", _cte_names(_ctes))
    _parts += _c
    _rows.append(f"row{_k} AS MATERIALIZED ({_b})")
register("comparison_table", "WITH RECURSIVE " + ",\n".join(c.strip() for c in (POP_CTES, ERA_CTE, CEN_CTE, GEN_CTE, *_parts, *_rows)) + "\n"
         + " UNION ALL ".join(f"""SELECT method, srmse_avg, jsd_full_joint, COALESCE(srmse_avg_ipf, srmse_avg) AS srmse_avg_ipf,
           COALESCE(jsd_full_joint_ipf, jsd_full_joint) AS jsd_full_joint_ipf FROM row{k}""" for k in range(3)))
