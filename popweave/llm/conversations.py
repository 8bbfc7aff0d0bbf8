"""Conversation structure repair by iterative-deepening A*.

The rows of a conversation, in order of turn, become symbols: a row that must
go (blank, or a copy of an earlier row), or the initial of its role, in upper
case where its text is cut off.  Edits are Delete, Insert (an empty user or
assistant row), Keep and Rerole; the roles that remain must read
``(s?(ua)+)?``.  Which role an insert or rerole gives follows from the state,
so the edits' initials, the audit, fix the repaired conversation.

``search`` finds the cheapest audit, ties to the ASCII-least: depth first,
edits in ASCII order, under cost bounds that rise to the least cost beyond the
last one.  A state that failed is kept with the budget it failed with, over all
bounds.  The first accepting path is the answer.  The estimate of the rest is
the exact cost of a relaxed grammar, in which a system row may stand wherever a
user may: never too high.

Longer conversations are searched in segments: of each segment the cheapest
audit from every state before to every state after it; costs and the order of
the audits combine associatively, and the states on the best path go back to
the segments.  An insert belongs to the row after it, so no audit of a segment
is the beginning of another and the whole is ASCII-least as its parts are.

Conversations of up to ``LIMIT`` rows are gathered whole into a task.  Longer
ones are sorted by ranges, their faults found by aggregation, their segments
searched all over the cluster; only small matrices meet in a task.  A SHA-256
of a whole conversation is one chain by its definition, so there the sorted
rows stream through one task, which holds the audit and never the rows.

Edge cases: a null role or text is one space, a null conversation or turn is
one space in the damage key; null conversations are one; rows of one turn go by
role and text, null turns first; a role without characters, or with another
initial than s, u and a, cannot be kept, only reroled or deleted; repeated rows
are duplicates; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.llm.common import stash, table

#: Rows of a conversation that a task gathers, rows of a segment, and segments that one group combines.
LIMIT = 1024
SEGMENT = 64
FAN = 1024
#: Long conversations whose identifiers may be broadcast.
BROADCAST_IDS = 100_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT, END = range(5)
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Inserts that end a conversation, by state.
_TAIL = ("", "II", "I", "")
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_LEGAL = ("su", "ua", "au")


def _other(state: int) -> int:
    """The state after an inserted or reroled row."""
    return ASSISTANT if state == USER else USER


# ------------------------------------------------------------------ the search

def _estimates(symbols: str, target: int) -> list[tuple[float, ...]]:
    """Costs that the rest takes at least, by position and state."""
    n = len(symbols)
    if target in (START, SYSTEM):  # at most one system row stays
        out = []
        for i in range(n + 1):
            gone = DELETE * (n - i)
            one = gone - DELETE if "s" in symbols[i:].lower() else inf
            out.append((gone, inf, inf, inf) if target == START else (one, gone, inf, inf))
        return out
    user, assistant = {END: (0, INSERT), USER: (inf, 0), ASSISTANT: (0, inf)}[target]  # by what may come next
    out = [(user, user, assistant, user)]
    for symbol in reversed(symbols):
        kind, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        u, a = user + DELETE, assistant + DELETE
        if kind != "x":
            u, a = min(u, assistant + REROLE + more), min(a, user + REROLE + more)
            if kind == "u":
                u = min(u, assistant + more)
            elif kind == "a":
                a = min(a, user + more)
            elif kind == "s":
                u = min(u, user + more)
        user, assistant = min(u, a + INSERT), min(a, u + INSERT)
        out.append((user, user, assistant, user))
    return out[::-1]


def search(symbols: str, entry: int = START, target: int = END) -> tuple[int, str] | None:
    """The cheapest audit of ``symbols`` between two states, ties to the ASCII-least; None if there is none.

    ``END`` stands for a legal end, with inserts after the last row if need be;
    to any other target the last edit is that of the last row.
    """
    n, least = len(symbols), _estimates(symbols, target)
    failed: dict[tuple[int, int], float] = {}
    bound = least[0][entry]
    beyond = inf

    def visit(i: int, state: int, left: float) -> str | None:
        nonlocal beyond
        if least[i][state] > left:
            beyond = min(beyond, bound - left + least[i][state])
            return None
        if i == n:
            if state == target or (target == END and state in (START, ASSISTANT)):
                return ""
            moves = [("I", INSERT, n, _other(state))] if target == END else []
        else:
            kind, more = symbols[i].lower(), TRUNCATED if symbols[i].isupper() else 0
            moves = [("D", DELETE, i + 1, state), ("I", INSERT, i, _other(state))]
            if kind != "x":
                after = _KEPT.get(kind, {}).get(state)
                if after is not None:
                    moves.append(("K", KEEP + more, i + 1, after))
                moves.append(("R", REROLE + more, i + 1, _other(state)))
        at = (i, state)
        known = failed.get(at, -1)
        if known >= left:
            beyond = min(beyond, bound - left + known + 1)
            return None
        for letter, cost, j, after in moves:
            rest = visit(j, after, left - cost)
            if rest is not None:
                return letter + rest
        failed[at] = left
        return None

    while bound < inf:
        beyond = inf
        audit = visit(0, entry, bound)
        if audit is not None:
            return int(bound), audit
        bound = beyond
    return None


# ------------------------------------------------------- segments and their algebra

class Matrix:
    """Costs from states before to states after a run of rows, and the order of the audits by the state after."""

    def __init__(self, cost: Sequence[Sequence[float]], rank: Sequence[Sequence[int]]):
        self.cost, self.rank = cost, rank

    def flat(self) -> tuple[list[int], list[int]]:
        return [-1 if c == inf else int(c) for row in self.cost for c in row], [r for row in self.rank for r in row]

    @staticmethod
    def of(cost: Sequence[int], rank: Sequence[int]) -> Matrix:
        c = [inf if x < 0 else int(x) for x in cost]
        return Matrix([c[k:k + 4] for k in range(0, 16, 4)], [[int(x) for x in rank[k:k + 4]] for k in range(0, 16, 4)])

    def then(self, after: Matrix) -> Matrix:
        cost, rank = [[inf] * 4 for _ in range(4)], [[0] * 4 for _ in range(4)]
        for e in range(4):
            best = {}
            for x in range(4):
                ways = [(self.cost[e][m] + after.cost[m][x], self.rank[e][m], after.rank[m][x])
                        for m in range(4) if self.cost[e][m] + after.cost[m][x] < inf]
                if ways:
                    best[x] = min(ways)
            for k, x in enumerate(sorted(best, key=lambda x: best[x][1:])):
                cost[e][x], rank[e][x] = best[x][0], k
        return Matrix(cost, rank)


@lru_cache(maxsize=4096)
def _paths(symbols: str) -> dict[tuple[int, int], tuple[int, str]]:
    found = {(e, x): search(symbols, e, x) for e in range(4) for x in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def matrix(symbols: str) -> Matrix:
    paths = _paths(symbols)
    cost, rank = [[inf] * 4 for _ in range(4)], [[0] * 4 for _ in range(4)]
    for e in range(4):
        for k, x in enumerate(sorted((x for x in range(4) if (e, x) in paths), key=lambda x: paths[e, x][1])):
            cost[e][x], rank[e][x] = paths[e, x][0], k
    return Matrix(cost, rank)


def walk(run: Sequence[Matrix], entry: int, rest: Sequence[float]) -> tuple[float, list[tuple[int, int]]]:
    """Cheapest cost of a run, given that of each state after it, and the states before and after each matrix."""
    ahead = [list(rest)]
    for m in reversed(run):
        ahead.append([min(m.cost[e][x] + ahead[-1][x] for x in range(4)) for e in range(4)])
    ahead.reverse()
    total, states = ahead[0][entry], []
    for k, m in enumerate(run):
        ways = [x for x in range(4) if m.cost[entry][x] < inf and m.cost[entry][x] + ahead[k + 1][x] == ahead[k][entry]]
        after = min(ways, key=lambda x: m.rank[entry][x])
        states.append((entry, after))
        entry = after
    return total, states


_REST = [INSERT * len(t) for t in _TAIL]


@lru_cache(maxsize=65536)
def _solve_short(symbols: str) -> tuple[int, str]:
    return search(symbols)  # a legal end is always within reach


def solve(symbols: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if len(symbols) <= SEGMENT:
        return _solve_short(symbols)
    parts = [symbols[k:k + SEGMENT] for k in range(0, len(symbols), SEGMENT)]
    total, states = walk([matrix(p) for p in parts], START, _REST)
    return int(total), "".join(_paths(p)[s][1] for p, s in zip(parts, states, strict=True)) + _TAIL[states[-1][1]]


class Applied:
    """An audit that meets its rows one after another."""

    def __init__(self, audit: Iterator[str]):
        self.audit, self.state = audit, START

    def _inserted(self) -> tuple[str, str]:
        self.state = _other(self.state)
        return _NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The repaired rows up to and with this one."""
        for letter in self.audit:
            if letter == "I":
                yield self._inserted()
                continue
            if letter == "K":
                self.state = _KEPT[role[0]][self.state]
                yield role, text
            elif letter == "R":
                yield self._inserted()[0], text
            return

    def end(self) -> Iterator[tuple[str, str]]:
        for _ in self.audit:
            yield self._inserted()


class Digest:
    """SHA-256 of ``role:text`` lines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, rows: Iterable[tuple[str, str]]) -> None:
        for role, text in rows:
            if self.any:
                self.sha.update(b"\n")
            self.sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.any = True


# ------------------------------------------------------------------ Spark side

def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: damaged rows, ``n`` copies of each; 0 for a dropped one."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"))


_REPORT = T.StructType([T.StructField(c, T.LongType()) for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def _report(rows: Sequence[dict]) -> tuple:
    """The report of one conversation from its rows in order."""
    turns = {r["turn"] for r in rows} - {None}
    seen: set[tuple[str, str]] = set()
    symbols, initials, faults = [], [], {"blank": 0, "duplicate": 0, "truncated": 0}
    whole = []
    for r in rows:
        for _ in range(r["n"]):
            role, text = r["role"], r["text"]
            solid = _SOLID.findall(text[-64:]) or _SOLID.findall(text)
            first = role[:1] if role[:1] in _KEPT else "o"
            if not solid:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            else:
                fault = "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            symbols.append("x" if fault in ("blank", "duplicate") else first.upper() if fault else first)
            initials.append(role[:1])
            whole.append((role, text))
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = solve("".join(symbols))
    applied, digest = Applied(iter(audit)), Digest()
    for role, text in whole:
        digest.add(applied.row(role, text))
    digest.add(applied.end())
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults.values(), illegal, cost, audit,
            digest.sha.hexdigest())


def _report_task(schema: T.StructType) -> Callable:
    types = [pa.string() if f.dataType == T.StringType() else pa.int64() for f in _REPORT]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                got = [_report(rows) for rows in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *[pa.array(x, t) for x, t in zip(zip(*got, strict=True), types, strict=True)]],
                    names=schema.names)
    return task


def _name(column: str = "conv_id"):
    """A conversation's key that null has too."""
    return F.coalesce(F.concat(F.lit("c"), F.col(column).cast("string")), F.lit("n"))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows of long conversations in their order, which ``_at`` numbers, written once."""
    keyed = rows.select(_name().alias("_key"), "*", F.monotonically_increasing_id().alias("_row"))
    order = ["_key", "turn", "role", "text", "_row"]
    solid = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    return stash(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "_key", "conv_id", "turn", "role", "text", "n", F.monotonically_increasing_id().alias("_at"),
            F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("_same"),
            (solid == "").alias("_blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("_cut")),
        "conversation-rows")


_MATRIX = T.StructType([
    T.StructField("_key", T.StringType()), T.StructField("_part", T.LongType()),
    T.StructField("_cost", T.ArrayType(T.IntegerType())), T.StructField("_rank", T.ArrayType(T.IntegerType())),
    T.StructField("_first", T.StringType()), T.StructField("_last", T.StringType()), T.StructField("_illegal", T.LongType())])
_PATH = T.StructType([
    T.StructField("_key", T.StringType()), T.StructField("_part", T.LongType()), T.StructField("_in", T.IntegerType()),
    T.StructField("_out", T.IntegerType()), T.StructField("_illegal", T.LongType()), T.StructField("_total", T.LongType())])


def _matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        flat = [matrix(s).flat() for s in f["_symbols"]]
        initials = [list(x) for x in f["_initials"]]
        yield pd.DataFrame({
            "_key": f["_key"], "_part": f["_part"], "_cost": [c for c, _ in flat], "_rank": [r for _, r in flat],
            "_first": [x[0] for x in initials], "_last": [x[-1] for x in initials],
            "_illegal": [sum(a + b not in _LEGAL for a, b in zip(x, x[1:], strict=False)) for x in initials]})


def _read(f: pd.DataFrame) -> list[Matrix]:
    return [Matrix.of(c, r) for c, r in zip(f["_cost"], f["_rank"], strict=True)]


def _illegal(f: pd.DataFrame) -> int:
    firsts, lasts = f["_first"].tolist(), f["_last"].tolist()
    return int(f["_illegal"].sum()) + sum(a + b not in _LEGAL for a, b in zip(lasts, firsts[1:], strict=False))


def _combine(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("_part")
    run = _read(f)
    whole = run[0]
    for m in run[1:]:
        whole = whole.then(m)
    cost, rank = whole.flat()
    return pd.DataFrame({"_key": f["_key"].iloc[:1].tolist(), "_part": [int(f["_part"].iloc[0]) // FAN], "_cost": [cost],
                         "_rank": [rank], "_first": [f["_first"].iloc[0]], "_last": [f["_last"].iloc[-1]],
                         "_illegal": [_illegal(f)]})


def _whole_walk(f: pd.DataFrame) -> pd.DataFrame:
    """States around each combined run of one conversation; its totals stand in the first row."""
    f = f.sort_values("_part")
    total, states = walk(_read(f), START, _REST)
    blank = [0] * (len(f) - 1)
    return pd.DataFrame({"_key": f["_key"], "_part": f["_part"], "_in": [e for e, _ in states],
                         "_out": [x for _, x in states], "_illegal": [_illegal(f), *blank], "_total": [int(total), *blank]})


def _part_walk(run: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
    if run.empty or around.empty:
        return pd.DataFrame({f.name: [] for f in _PATH})
    run = run.sort_values("_part")
    goal = int(around["_out"].iloc[0])
    _, states = walk(_read(run), int(around["_in"].iloc[0]), [0 if x == goal else inf for x in range(4)])
    return pd.DataFrame({"_key": run["_key"], "_part": run["_part"], "_in": [e for e, _ in states],
                         "_out": [x for _, x in states], "_illegal": 0, "_total": 0})


def _traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"_key": f["_key"], "_part": f["_part"], "_audit": [
            _paths(s)[int(e), int(x)][1] for s, e, x in zip(f["_symbols"], f["_in"], f["_out"], strict=True)]})


def _long_audits(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits by segment, and counts of each conversation."""
    first = (ordered.where(~F.col("_blank")).groupBy("_key", "_same").agg(F.min("_at").alias("_at"))
             .select("_at", F.lit(True).alias("_new")))
    new = F.coalesce("_new", F.lit(False)) & ~F.col("_blank")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin(*_KEPT), initial).otherwise("o")
    rows = ordered.select("_key", "conv_id", "turn", "role", "n", "_at", "_blank", "_cut").join(first, "_at", "left").select(
        "_key", "conv_id", "turn", "n", "_at", "_blank", "_cut", new.alias("_new"), initial.alias("_initial"),
        F.concat(F.when(~new, "x").when(F.col("_cut"), F.upper(known)).otherwise(known),
                 F.expr("repeat('x', n - 1)")).alias("_symbol"))
    rows = stash(rows, "conversation-symbols")
    # A segment is a run of numbers: one conversation has at most SEGMENT rows in it, copies apart.
    parts = stash(
        rows.groupBy("_key", F.expr(f"_at div {SEGMENT}").alias("_part"))
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_symbol", "_initial", "n"))).alias("_rows"))
        .select("_key", "_part", F.array_join(F.transform("_rows", lambda r: r["_symbol"]), "").alias("_symbols"),
                F.flatten(F.transform("_rows", lambda r: F.array_repeat(r["_initial"], r["n"]))).alias("_initials")),
        "conversation-segments")
    found = stash(parts.mapInPandas(_matrices, _MATRIX), "conversation-matrices")
    group = F.expr(f"_part div {FAN}")
    whole = stash(found.groupBy("_key", group.alias("_group")).applyInPandas(_combine, _MATRIX)
                  .groupBy("_key").applyInPandas(_whole_walk, _PATH), "conversation-walks")
    paths = found.groupBy("_key", group.alias("_group")).cogroup(
        whole.groupBy("_key", F.col("_part").alias("_group"))).applyInPandas(_part_walk, _PATH)
    audits = parts.select("_key", "_part", "_symbols").join(
        paths.select("_key", "_part", "_in", "_out"), ["_key", "_part"]).mapInPandas(
            _traced, "_key string, _part long, _audit string")
    ends = whole.groupBy("_key").agg(F.max_by("_out", "_part").alias("_state"), F.sum("_illegal").alias("illegal"),
                                     F.sum("_total").alias("cost"))
    blank, copies = F.when(F.col("_blank"), F.col("n")).otherwise(0), F.col("n") - F.col("_new").cast("int")
    counts = (
        rows.groupBy("_key", "turn").agg(
            F.first("conv_id").alias("conv_id"), F.sum(blank).alias("blank"),
            F.sum(F.when(F.col("_blank"), 0).otherwise(copies)).alias("duplicate"),
            F.sum((F.col("_new") & F.col("_cut")).cast("long")).alias("truncated"))
        .groupBy("_key").agg(
            F.first("conv_id").alias("conv_id"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        .join(ends, "_key"))
    return stash(audits, "conversation-audits"), counts


_STREAM = "_key string, _at long, _kind int, role string, text string, n int, _audit string"


def _stream(frames: Iterator[pa.RecordBatch], emit_rows: bool) -> Iterator[pa.RecordBatch]:
    """Meets audits, each before its rows, with the sorted rows of one conversation after another."""
    def records():
        for batch in frames:
            for lo in range(0, batch.num_rows, 256):
                yield from batch.slice(lo, 256).to_pylist()

    names = ["_key", "position", "role", "text"] if emit_rows else ["_key", "audit", "repaired_sha256"]
    for key, run in groupby(records(), key=lambda r: r["_key"]):
        pieces: list[str] = []
        letters = iter(())
        applied, digest, position, out = Applied(letters), Digest(), 0, []

        def take(rows):
            nonlocal position, out
            if not emit_rows:
                digest.add(rows)
                return
            for role, text in rows:
                out.append((key, position, role, text))
                position += 1

        for r in run:
            if r["_audit"] is not None:
                if not emit_rows:
                    pieces.append(r["_audit"])
                applied.audit = iter(r["_audit"])
                if r["_kind"] == 2:
                    take(applied.end())
            else:
                for _ in range(r["n"]):
                    take(applied.row(r["role"], r["text"]))
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
                out = []
        if not emit_rows:
            out = [(key, "".join(pieces), digest.sha.hexdigest())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)


def _streamed(ordered: DataFrame, audits: DataFrame, ends: DataFrame, emit_rows: bool) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = ordered.select("_key", "_at", F.lit(1).alias("_kind"), "role", "text", "n", none.alias("_audit"))
    before = audits.select("_key", (F.col("_part") * SEGMENT).alias("_at"), F.lit(0).alias("_kind"), none.alias("role"),
                           none.alias("text"), F.lit(0).alias("n"), "_audit")
    tail = F.element_at(F.array(*map(F.lit, _TAIL)), F.col("_state") + 1)
    after = ends.select("_key", F.lit((1 << 63) - 1).alias("_at"), F.lit(2).alias("_kind"), none.alias("role"),
                        none.alias("text"), F.lit(0).alias("n"), tail.alias("_audit"))
    stream = rows.unionByName(before).unionByName(after).repartition("_key").sortWithinPartitions("_key", "_at", "_kind")
    return stream.mapInArrow(
        lambda batches: _stream(batches, emit_rows),
        "_key string, position long, role string, text string" if emit_rows
        else "_key string, audit string, repaired_sha256 string")


def _long_rows(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations of up to ``limit`` rows, and those of longer ones if there are any."""
    long = stash(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
                 .select(F.col("conv_id").alias("_long")), "long-conversations")
    many = long.count()
    if not many:
        return rows, None
    side = F.broadcast(long) if many <= BROADCAST_IDS else long
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    return rows.join(side, same, "left_anti"), rows.join(side, same, "left_semi")


def repair(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One report for each ``conv_id`` of ``rows`` (columns of ``damaged``): faults, cost, audit, digest of the result."""
    short, long = _long_rows(rows, limit)
    row = F.when(F.col("n") > 0, F.struct("turn", "role", "text", "n"))
    schema = T.StructType([rows.schema["conv_id"], *_REPORT.fields])
    # sort_array puts null fields first, as the order of turns asks.
    gathered = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    reports = gathered.mapInArrow(_report_task(schema), schema)
    if long is None:
        return reports
    ordered = _sorted(long.where("n > 0"))
    audits, counts = _long_audits(ordered)
    counts = stash(counts, "conversation-counts")
    told = counts.join(_streamed(ordered, audits, counts, False), "_key").select(*schema.names)
    # Conversations that lost every row.
    empty = long.groupBy("conv_id").agg(F.max("n").alias("_n")).where("_n = 0").select(
        "conv_id", *[F.lit(0).cast("long").alias(f.name) for f in _REPORT.fields[:6]], F.lit("").alias("audit"),
        F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return reports.unionByName(told).unionByName(empty)


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, position, role, text``: the rows of the repaired conversations."""
    ordered = _sorted(rows.where("n > 0"))
    audits, counts = _long_audits(ordered)
    counts = stash(counts, "conversation-counts")
    return counts.select("_key", "conv_id").join(_streamed(ordered, audits, counts, True), "_key").drop("_key")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES: dict[str, str] = {}
