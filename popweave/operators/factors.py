"""Fitted factors: one number for each (group, attribute, category).

Every fit of this library multiplies whole categories, so a cell's weight is
the product of its categories' factors.  This module keeps the factors
themselves:

* ``FactorLoop`` fits all large groups at once: one aggregation over their
  cells for a block of attributes, whatever the number of groups; groups that have
  converged no longer read their cells.  The state is a table with a row for
  each group (arrays of factors), checkpointed at each step; the driver sees
  whether any group is left.
* ``factor_table`` is that state as rows ``(by..., attr, cat, factor)``, with
  ``cat`` null for the values that no target lists; it is stored with
  ``save_factors`` and weighs new records by one map look-up an attribute
  (``apply_factors``).

A grid need not exist for this: with ``smoothing`` the loop adds, in closed
form, the mass of every cell of the product of the domains (see ``implicit``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.domain import ordinal
from popweave.operators.sampling import BROADCAST_BYTES
from popweave.session import materialize, stash

#: Name of a category's key in the look-up map; no attribute name holds the separator.
_SEP = "\x1f"

#: Combinations of categories that one aggregation of a step may have, by group.
BLOCK_CODES = 1 << 16


def null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of group columns; a NULL group is a group."""
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def scaled_counts(cur: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Factors that bring the masses to the goals; a category without mass stays as it is."""
    return np.where(cur > 0, goal / np.where(cur > 0, cur, 1.0), 1.0)


def _blocks(sizes: Sequence[int]) -> list[list[int]]:
    """Attributes in order, as many in a block as ``BLOCK_CODES`` allows, one at least."""
    blocks, codes = [], 0
    for i, size in enumerate(sizes):
        if blocks and codes * (size + 1) <= BLOCK_CODES:
            blocks[-1].append(i)
            codes *= size + 1
        else:
            blocks.append([i])
            codes = size + 1
    return blocks


class FactorLoop:
    """Fits of many large groups, each step for all of them.

    A step sums the cells by the categories of a block of attributes together;
    in that small table the block's attributes are scaled one after the other,
    as exactly as over the cells: a scaled category moves all its cells alike.

    ``cells``: ``keys..., attributes, mass``; ``targets``: ``keys..., attr,
    attr_pos, cat, cat_pos, prop`` (attributes in one order for all groups);
    ``cats``: the categories that have a code, by attribute in that order.
    ``kind``: ``sequential`` and ``classic`` raking, or ``ipf`` (``n`` records;
    a coded category without target has goal 0).  ``smoothing`` is mass that
    every cell of the product of ``cats`` has besides, times ``others``, the
    number of cells of the attributes without targets.
    """

    def __init__(self, cells: DataFrame, targets: DataFrame, keys: Sequence[str], mass: str,
                 cats: Mapping[str, Sequence[str]], kind: str, *, n: float = 0.0, smoothing: float = 0.0,
                 others: float = 1.0):
        self.keys, self.attrs, self.kind = list(keys), list(cats), kind
        self.cats = {a: [str(c) for c in cs] for a, cs in cats.items()}
        self.sizes = [len(c) for c in self.cats.values()]
        self.blocks = _blocks(self.sizes)
        self.columns, self.n, self.smoothing, self.others = cells.columns, float(n), float(smoothing), float(others)
        renamed = [F.col(k).alias(f"_g_{k}") for k in self.keys]
        self.groups = stash(cells.groupBy(*renamed).agg(F.sum(F.col(mass).cast("double")).alias("_total"))
                            .withColumn("_gid", F.monotonically_increasing_id()), "groups")
        # A group's state: a few numbers, and one for each category; its keys count as a hundred bytes each.
        row = 100 * len(self.keys) + 64 + 8 * sum(len(c) + 2 for c in self.cats.values())
        self.few = self.groups.count() * row <= BROADCAST_BYTES
        ids = self._small(self.groups.drop("_total"))
        side = [f"_g_{k}" for k in self.keys]
        coded = [ordinal(F.col(a).cast("string"), c).alias(f"_o_{i}") for i, (a, c) in enumerate(self.cats.items())]
        self.base = stash(cells.join(ids, null_safe(self.keys, side)).select(
            *self.columns, "_gid", F.col(mass).cast("double").alias("_mass"), *coded), "coded-cells")
        self.state = materialize(self._start(targets))

    def _small(self, df: DataFrame) -> DataFrame:
        """Rows of groups, broadcast if their measured number allows."""
        return F.broadcast(df) if self.few else df

    def _start(self, targets: DataFrame) -> DataFrame:
        """``_gid, _total``, for each attribute its targets in order and its factors, and the progress of the group."""
        side = [f"_t_{k}" for k in self.keys]
        t = targets.select(*[F.col(k).alias(s) for k, s in zip(self.keys, side, strict=True)], "attr", "cat", "cat_pos", "prop")
        entry = F.struct("cat_pos", "_code", F.col("prop").cast("double").alias("prop"))
        wide = []
        for i, a in enumerate(self.cats):
            wide.append(F.array_sort(F.collect_list(F.when(F.col("attr") == a, entry))).alias(f"_t_{i}"))
        code = F.lit(-1)
        for a, c in self.cats.items():
            code = F.when(F.col("attr") == a, ordinal(F.col("cat").cast("string"), c)).otherwise(code)
        goals = t.withColumn("_code", code).groupBy(*side).agg(*wide)
        joined = self.groups.join(goals, null_safe([f"_g_{k}" for k in self.keys], side), "left")
        per = []
        for i, c in enumerate(self.cats.values()):
            per += [F.col(f"_t_{i}").getField("_code").alias(f"_c_{i}"),
                    F.col(f"_t_{i}").getField("prop").alias(f"_p_{i}"),
                    F.array_repeat(F.lit(1.0), len(c) + 1).alias(f"_f_{i}")]
        start = joined.select("_gid", "_total", *per, F.lit(0).alias("_it"), F.lit(0.0).alias("_change"), F.lit(True).alias("_on"))
        if self.kind != "classic":
            return start
        return start.mapInPandas(_drop_unlisted(len(self.attrs)), start.schema)

    # ------------------------------------------------------------ one step

    def _weight(self) -> Column:
        return _product([F.element_at(F.col(f"_f_{i}"), F.col(f"_o_{i}") + 2) for i in range(len(self.attrs))])

    def _weighed(self) -> DataFrame:
        """Cells of the groups that still move, with their weights."""
        factors = self._small(self.state.where("_on").select("_gid", *[f"_f_{i}" for i in range(len(self.attrs))]))
        return self.base.join(factors, "_gid").withColumn("_w", self._weight())

    def _sums(self, blocks: Sequence[int]) -> DataFrame:
        """Masses and largest weights by the categories of a block's attributes together, of some blocks in one pass."""
        codes = []
        for b in blocks:
            code = F.lit(0)
            for i in self.blocks[b]:
                code = code * (self.sizes[i] + 1) + F.col(f"_o_{i}") + 1
            codes.append(F.struct(F.lit(b).alias("a"), code.cast("int").alias("o")))
        one = (F.explode(F.array(*codes)) if len(codes) > 1 else codes[0]).alias("_x")
        rows = self._weighed().select("_gid", (F.col("_mass") * F.col("_w")).alias("m"), "_w", one).select("_gid", "m", "_w", "_x.a", "_x.o")
        by_code = rows.groupBy("_gid", "a", "o").agg(F.sum("m").alias("m"), F.max("_w").alias("w"))
        packed = by_code.groupBy("_gid").agg(F.array_sort(F.collect_list(F.struct("a", "o", "m", "w"))).alias("_s"))
        return packed.select(F.col("_gid"), *[F.col("_s").getField(k).alias(f"_s_{k}") for k in "aomw"])

    def _advance(self, sums: DataFrame, step: Callable) -> None:
        self.state = materialize(self.state.join(sums, "_gid", "left").mapInPandas(step, self.state.schema))

    def run(self, *, tol: float, max_iter: int, rate_tol: float = 0.0) -> FactorLoop:
        last, ahead = len(self.blocks) - 1, None
        for _ in range(max_iter if self.attrs else 0):
            for b in range(len(self.blocks)):
                sums = self._sums([b]) if b or ahead is None else ahead
                self._advance(sums, _step(self, b, first=b == 0, last=b == last, tol=tol))
            if self.kind != "sequential":
                # These sums also serve the first step of the next sweep.
                ahead = materialize(self._sums(range(len(self.blocks))))
                self._advance(ahead, _converged(self, tol, rate_tol))
            if not self.state.where("_on").limit(1).count():
                break
        return self

    # ------------------------------------------------------------ results

    def weighted_cells(self) -> DataFrame:
        """The cells with ``_w``, ``_it`` and ``_change`` of their group and ``_total``, its mass."""
        facts = self._small(self.state.select("_gid", "_total", "_it", "_change", *[f"_f_{i}" for i in range(len(self.attrs))]))
        return self.base.join(facts, "_gid").withColumn("_w", self._weight()).select(
            *self.columns, "_mass", "_w", "_it", "_change", "_total")

    def factor_table(self) -> DataFrame:
        """``keys..., attr, cat, factor``; ``cat`` is null for the values without a code."""
        entries = []
        for i, (a, cs) in enumerate(self.cats.items()):
            names = F.array(F.lit(None).cast("string"), *map(F.lit, cs))
            entries.append(F.arrays_zip(F.array_repeat(F.lit(a), len(cs) + 1).alias("attr"), names.alias("cat"),
                                        F.col(f"_f_{i}").alias("factor")))
        rows = self.state.select("_gid", F.explode(F.concat(*entries)).alias("_x")).join(self._small(self.groups), "_gid")
        return rows.select(*[F.col(f"_g_{k}").alias(k) for k in self.keys], "_x.attr", "_x.cat", "_x.factor")


def _drop_unlisted(n_attrs: int) -> Callable:
    """Classic raking gives no weight to values that the group's targets do not list."""
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(n_attrs):
                f[f"_f_{i}"] = [_listed(c, x) for c, x in zip(f[f"_c_{i}"], f[f"_f_{i}"], strict=True)]
            yield f
    return task


def _listed(codes, factors) -> np.ndarray:
    out = np.asarray(factors, float)
    if codes is None or not len(codes):
        return out  # an attribute without targets in this group
    out = np.zeros_like(out)
    out[np.asarray(codes, int) + 1] = 1.0
    return out


def _table(row, block: int, attributes: Sequence[int], sizes: Sequence[int]) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """A block's sums in a group: codes by attribute (-1: none), masses and largest weights."""
    if row["_s_a"] is None:
        return {i: np.zeros(0, int) for i in attributes}, np.zeros(0), np.zeros(0)
    mine = np.asarray(row["_s_a"]) == block
    o = np.asarray(row["_s_o"], int)[mine]
    codes = {}
    for i in reversed(attributes):
        o, code = np.divmod(o, sizes[i] + 1)
        codes[i] = code - 1
    return codes, np.asarray(row["_s_m"], float)[mine], np.asarray(row["_s_w"], float)[mine]


def _coded_sums(code: np.ndarray, m: np.ndarray, size: int) -> np.ndarray:
    """Mass of each coded category."""
    return np.bincount(code[code >= 0], weights=m[code >= 0], minlength=size)


def _goals(loop_kind: str, n: float, row, attribute: int, size: int) -> np.ndarray | None:
    """Masses that an attribute's categories shall have, if the group has targets for it."""
    codes = row[f"_c_{attribute}"]
    if codes is None or not len(codes):
        return None
    codes, props = np.asarray(codes, int), np.asarray(row[f"_p_{attribute}"], float)
    goal = np.zeros(size)
    goal[codes[codes >= 0]] = props[codes >= 0]
    if loop_kind == "ipf":
        return goal * n
    total = goal.sum()
    return goal / total * row["_total"] if total > 0 else goal


def _product_mass(smoothing: float, others: float, factors: Sequence[np.ndarray], attribute: int) -> np.ndarray:
    """Mass that the cells of the whole product have besides their own, by category of an attribute."""
    rest = others
    for b, f in enumerate(factors):
        if b != attribute:
            rest *= f[1:].sum()
    return smoothing * rest * factors[attribute][1:]


def _scale(loop: FactorLoop) -> Callable:
    """What an ``ipf`` group's mass is multiplied by at the start, so that it is ``n``."""
    kind, n = loop.kind, loop.n
    product = loop.smoothing * loop.others * float(np.prod([float(len(c)) for c in loop.cats.values()]))
    return (lambda total: n / (total + product)) if kind == "ipf" else (lambda total: 1.0)


def _step(loop: FactorLoop, block: int, *, first: bool, last: bool, tol: float) -> Callable:
    """Factors of a block's attributes in turn from its sums, for each group that is still moving."""
    kind, n, smoothing, others = loop.kind, loop.n, loop.smoothing, loop.others
    attributes, sizes, scale_of, columns = loop.blocks[block], loop.sizes, _scale(loop), loop.state.columns

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            for row in rows:
                if not row["_on"]:
                    continue
                coded, m, w = _table(row, block, attributes, sizes)
                change = 0.0 if first else row["_change"]
                for i in attributes:
                    code, size = coded[i], sizes[i]
                    cur, moved = _coded_sums(code, m, size), np.ones(size + 1)
                    if kind == "sequential":
                        top, mass = np.zeros(size), float(m.sum())
                        np.maximum.at(top, code[code >= 0], w[code >= 0])
                        codes, props = row[f"_c_{i}"], row[f"_p_{i}"]
                        for c, p in zip(codes if codes is not None else (), props if props is not None else (), strict=True):
                            if p <= 0 or cur[c] <= 0:
                                continue
                            adjust = p * mass / cur[c]
                            moved[c + 1] *= adjust
                            mass += (adjust - 1.0) * cur[c]
                            change = max(change, abs(adjust - 1.0) * top[c])
                    else:
                        goal = _goals(kind, n, row, i, size)
                        if goal is None:
                            continue
                        if smoothing:
                            factors = [np.asarray(row[f"_f_{b}"], float) for b in range(len(sizes))]
                            cur = cur + _product_mass(smoothing, others, factors, i)
                        moved[1:] = scaled_counts(cur * scale_of(row["_total"]), goal)
                    row[f"_f_{i}"] = np.array(row[f"_f_{i}"], float) * moved
                    m, w = m * moved[code + 1], w * moved[code + 1]
                if kind == "sequential":
                    if last:
                        row["_it"] += 1
                        row["_on"] = bool(change >= tol)
                    row["_change"] = change
            yield pd.DataFrame(rows, columns=columns)
    return task


def _converged(loop: FactorLoop, tol: float, rate_tol: float) -> Callable:
    """How far the marginals are from the targets after a sweep, and whether the group goes on."""
    kind, n, smoothing, others = loop.kind, loop.n, loop.smoothing, loop.others
    blocks, sizes, scale_of, columns = loop.blocks, loop.sizes, _scale(loop), loop.state.columns

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            for row in rows:
                if not row["_on"]:
                    continue
                factors = [np.asarray(row[f"_f_{b}"], float) for b in range(len(sizes))]
                off, scale = 0.0, scale_of(row["_total"])
                for block, attributes in enumerate(blocks):
                    coded, m, _ = _table(row, block, attributes, sizes)
                    for b in attributes:
                        goal = _goals(kind, n, row, b, sizes[b])
                        if goal is None:
                            continue
                        cur = _coded_sums(coded[b], m, sizes[b])
                        if smoothing:
                            cur = cur + _product_mass(smoothing, others, factors, b)
                        cur, known = cur * scale, goal > 0
                        if known.any():
                            off = max(off, float(np.max(np.abs(cur[known] / goal[known] - 1.0))))
                        if kind == "ipf" and np.any(cur[~known] > 0):
                            off = np.inf
                stalled = kind == "ipf" and row["_it"] > 0 and not abs(off - row["_change"]) > rate_tol
                row["_on"] = bool(off > tol and not stalled)
                row["_it"] += 1
                row["_change"] = off
            yield pd.DataFrame(rows, columns=columns)
    return task


# ------------------------------------------------------------------ the stored table

def save_factors(factors: DataFrame, path: str) -> str:
    factors.write.mode("overwrite").parquet(path)
    return path


def load_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def apply_factors(records: DataFrame, factors: DataFrame, *, by: Sequence[str] = (), out: str = "w") -> DataFrame:
    """``records`` with the weight that stored factors ``(by..., attr, cat, factor)`` give them.

    A value that the table does not list has the factor of the null category
    (1 if there is none); a group without factors weighs null.  Attributes that
    the records lack are left out.
    """
    attrs = sorted({r["attr"] for r in factors.select("attr").distinct().collect()} & set(records.columns))
    entry = F.struct(F.concat("attr", F.lit(_SEP), F.coalesce(F.concat(F.lit("="), F.col("cat")), F.lit(""))).alias("k"), "factor")
    known = factors.where(F.col("attr").isin(attrs))
    weigh = lambda m: _product([F.coalesce(
        F.try_element_at(m, F.concat(F.lit(a + _SEP + "="), F.col(f"`{a}`").cast("string"))),
        F.try_element_at(m, F.lit(a + _SEP)), F.lit(1.0)) for a in attrs])
    if not by:
        table = known.agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
        return records.withColumn("_factors", table.scalar()).withColumn(out, weigh(F.col("_factors"))).drop("_factors")
    side = [f"_g_{k}" for k in by]
    table = known.groupBy(*[F.col(k).alias(s) for k, s in zip(by, side, strict=True)]).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_factors"))
    joined = records.join(table, null_safe(by, side), "left")
    return joined.withColumn(out, F.when(F.col("_factors").isNotNull(), weigh(F.col("_factors")))).drop("_factors", *side)


def _product(columns: Sequence[Column]) -> Column:
    w = F.lit(1.0)
    for c in columns:
        w = w * c
    return w


__all__ = ["FactorLoop", "apply_factors", "load_factors", "save_factors", "scaled_counts"]
