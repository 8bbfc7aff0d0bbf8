"""Conversation repair against exhaustive search, on whole tables, segments, long conversations and edge rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from popweave.llm import conversations as C
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string, audit string, _key string"
LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {k: sorted(v, key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode())) for k, v in out.items()}


def cheapest(rows):
    """Cost and audit by trying everything; rows are (role, fault)."""
    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, inserts):
        other = "a" if state == "u" else "u"
        ways = []
        if inserts < 3:
            c, a = best(i, other, inserts + 1)
            ways.append((c + 5, "I" + a))
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, ""))
            return min(ways, default=(float("inf"), ""))
        role, fault = rows[i]
        c, a = best(i + 1, state, 0)
        ways.append((c + 2, "D" + a))
        if fault in ("", "truncated"):
            more = 5 if fault else 0
            c, a = best(i + 1, other, 0)
            ways.append((c + 1 + more, "R" + a))
            to = after(state, role[:1])
            if to:
                c, a = best(i + 1, to, 0)
                ways.append((c + more, "K" + a))
        return min(ways)

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def expected(rows):
    out = {}
    for conv, after in damage(rows).items():
        seen, faults = set(), []
        for _, _, role, text in after:
            last = LAST.search(text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else
                          "truncated" if last[1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for known, t, _, _ in after if known}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(after, after[1:], strict=False)]
        cost, audit = cheapest([(r[2], f) for r, f in zip(after, faults, strict=True)])
        lines, state, left = [], "", list(zip(after, faults, strict=True))
        for letter in audit:
            other = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[other]
            if letter == "I":
                lines.append((name, ""))
            else:
                (_, _, role, text), _ = left.pop(0)
                if letter == "D":
                    continue
                lines.append((role, text) if letter == "K" else (name, text))
            state = lines[-1][0][:1]
        assert not left and GRAMMAR.match("".join(r[:1] for r, _ in lines))
        whole = "\n".join(f"{r}:{t}" for r, t in lines)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in (
            "blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256(whole.encode()).hexdigest(), lines)
    return out


def reports(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def table_rows(spark, where):
    return [tuple(r) for r in spark.read.parquet(f"{where}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def test_query_equals_exhaustive_search(spark):
    want = expected(table_rows(spark, SF_SMALL))
    df = C.op12_conversation_repair(spark, SF_SMALL)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert reports(df) == {k: v[:-1] for k, v in want.items()}
    assert {letter for v in want.values() for letter in v[6]} >= set("DKR")


def edge_rows():
    pick = random.Random(5)
    texts = ["Fine.", "cut off", "", " \n\t", None, "Ask?", "x" * 3000 + "!", "ends in spaces.  \n", "é漢😀."]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "a"]
    rows = [(c, pick.choice([None, *range(9)]), pick.choice(roles), pick.choice(texts)) for c in (None, 1, 2, 3) for _ in range(40)]
    rows += [(4, None, "user", "Hi.")] * 30 + [(5, None, None, None)]
    # A long one of many shapes, one of copies only, and one that the damage drops whole.
    rows += [(6, t, pick.choice(["user", "assistant", "assistant", "system"]), f"Turn {t // 3}{pick.choice(['.', '', '!'])}")
             for t in range(700)]
    rows += [(7, t, "user", "Again.") for t in range(300)]
    dropped = next((c, t) for c in range(8, 99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    return [*rows, (*dropped, "user", "Gone."), (*dropped, "assistant", "Gone too.")], dropped[0]


@pytest.mark.parametrize("limit", [C.LIMIT, 100, 1])
def test_edge_rows_and_long_conversations(spark, limit):
    rows, dropped = edge_rows()
    want = expected(rows)
    want.setdefault(dropped, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), []))
    df = spark.createDataFrame([(*r, "X", "Y") for r in rows], SCHEMA).repartition(5)
    got = reports(C.repair(C.damaged(df), limit))
    assert got == {k: v[:-1] for k, v in want.items()}
    if limit == 1:
        lines = defaultdict(list)
        for r in sorted(C.repaired(C.damaged(df)).collect(), key=lambda r: r["position"]):
            lines[r["conv_id"]].append((r["role"], r["text"]))
        assert lines == {k: v[-1] for k, v in want.items() if v[-1]}


def test_small_groups_of_segments(spark, monkeypatch):
    """Many combined runs: a fan of two segments."""
    rows = [r for r in edge_rows()[0] if r[0] in (2, 6, 7)]
    monkeypatch.setattr(C, "FAN", 2)
    df = spark.createDataFrame([(*r, "X", "Y") for r in rows], SCHEMA)
    want = expected(rows)
    got = reports(C.repair(C.damaged(df), 1))
    assert got == {k: v[:-1] for k, v in want.items()}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damaged(empty)).collect() == [] and C.repaired(C.damaged(empty)).collect() == []


def test_search_on_random_symbols():
    pick = random.Random(11)
    for _ in range(400):
        symbols = "".join(pick.choice("xsuaoSUAO") for _ in range(pick.randrange(14)))
        rows = [({"x": "user", "o": ""}.get(c.lower(), c.lower()), "blank" if c == "x" else "truncated" if c.isupper() else "")
                for c in symbols]
        assert C.search(symbols) == cheapest(rows), symbols


def test_search_inserts_between_states():
    assert C.search("xx", C.START, C.USER) == (9, "DID") and C.search("", C.USER) == (5, "I")


def test_solve_in_segments_equals_one_search(monkeypatch):
    pick = random.Random(12)
    for size in (3, 7):
        monkeypatch.setattr(C, "SEGMENT", size)
        for _ in range(60):
            symbols = "".join(pick.choice("xsuauaoSUA") for _ in range(pick.randrange(1, 40)))
            assert C.solve(symbols) == C.search(symbols), symbols
