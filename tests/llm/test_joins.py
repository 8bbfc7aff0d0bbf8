"""Jaccard classes, line dedup and nearest neighbours against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from popweave.llm import jaccard_join, line_dedup, nearest
from popweave.llm.components import components
from tests.conftest import SF_MID
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(rows, k, percent):
    """Brute force: {identifier: (set size, smallest reachable identifier)}."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


def family(seed, n=260):
    """Documents with a common passage, a family of near copies around the threshold, short and unrelated ones."""
    rnd = random.Random(seed)
    word = lambda: "w" + str(rnd.randint(0, 4000))
    passage, base = [word() for _ in range(40)], [word() for _ in range(60)]
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            w = [word() for _ in range(rnd.randint(30, 80))]
            w[5:5] = passage
        elif kind == 1:
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = word()
        elif kind == 2:
            w = passage[: rnd.randint(1, 12)]
        else:
            w = rows[rnd.randrange(len(rows))][1].split() + ([word()] if rnd.random() < 0.7 else [])
        rows.append((i + 1, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    return rows


@pytest.mark.parametrize("k,percent,small", [(4, 85, False), (5, 80, True)])
def test_jaccard_classes(spark, k, percent, small, monkeypatch):
    if small:
        for name, value in (("FAMILY", 4), ("BLOCK", 8), ("HOT_FROM", 5), ("BROADCAST_IDS", 0), ("COLUMNS", 64)):
            monkeypatch.setattr(jaccard_join, name, value)
        monkeypatch.setattr(jaccard_join.frequent, "__defaults__", (jaccard_join.HOT, 5))
    rows = family(k) + [(5000, None), (5001, ""), (5002, " \n"), (5003, edge.LONG), (5004, edge.LONG + " end"), (5005, "a"), (5006, "A")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs, k, percent).collect()}
    assert got == classes(rows, k, percent)


def near_copies(n):
    """Near copies of one text, some too far from the others to link, all sharing many shingles."""
    rnd = random.Random(n)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(n):
        at = set(rnd.sample(range(60), rnd.randint(1, 4)))
        rows.append((i + 1, " ".join(f"w{rnd.randint(0, 10**6)}" if x in at else w for x, w in enumerate(base))))
    return rows


def test_jaccard_opened_pairs_of_a_family(spark, monkeypatch):
    """The pairs that opened groups yield grow with a family of near copies, not with its square."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    found, opened = spark.sparkContext.accumulator(0), jaccard_join._opened

    def counted(*how):
        compare = opened(*how)

        def call(members, queries):
            out = compare(members, queries)
            found.add(len(out))
            return out

        return call

    monkeypatch.setattr(jaccard_join, "_opened", counted)
    n = 600
    rows = near_copies(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs, 4, 85).collect()}
    assert got == classes(rows, 4, 85)
    assert len({c for _, c in got.values()}) > n // 5  # many stay alone, though they meet the family
    assert found.value < 10 * n, found.value


def passages(n):
    """Documents of all sizes that share passages with documents of other sizes, and copies longer by up to a fifth."""
    rnd = random.Random(n)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    shared = [[word() for _ in range(14)] for _ in range(n // 40)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(int(20 * 1.09 ** (i % 40)))] + shared[i // 40 % len(shared)]
        if i % 10 == 9:
            w = rows[-1][1].split()
            w += [word() for _ in range(rnd.randint(0, len(w) // 5))]
        rows.append((i + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_jaccard_opened_rows(spark, monkeypatch, percent):
    """Only groups of sizes that can link are opened, those without a pair but once; the matrix alone finds each link."""
    met, opened, pairs = spark.sparkContext.accumulator(0), jaccard_join._opened, jaccard_join._star_pairs

    def counted(*how):
        compare = opened(*how)

        def call(members, queries):
            met.add(len(members) + len(queries))
            return compare(members, queries)

        return call

    monkeypatch.setattr(jaccard_join, "_opened", counted)
    monkeypatch.setattr(jaccard_join, "_star_pairs", lambda *a: pairs(*a).where("false"))
    n = 400
    rows = passages(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs, 4, percent).collect()}
    assert got == classes(rows, 4, percent)
    assert percent == 100 or n // 50 <= sum(c != i for i, (_, c) in got.items())
    assert percent != 85 or met.value < 2.5 * n, met.value


def test_jaccard_parities(monkeypatch):
    """A sketch never puts two sets further apart than they are, and folds to a narrower one."""
    monkeypatch.setattr(jaccard_join, "SKETCH_BYTES", 256)
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, k)) for k in (1, 2, 60, 64, 65, 129, 500, 700, 1500, 1500)] + [pool[:500], pool[:501], pool[:520]]
    table = pd.DataFrame({"_bits": [jaccard_join.parities(s) for s in sets]})
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = jaccard_join._apart(table, table, i, j)
    real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (apart <= real).all() and (apart % 2 == real % 2).all()
    assert (apart[real <= 20] >= real[real <= 20] - 2).all()


def test_jaccard_edges(spark):
    docs = edge.documents(spark)
    got = jaccard_join.jaccard_classes(docs, 4, 85).collect()
    assert len(got) == len(edge.rows())
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert [by_id[i] for i in (0, 1, 2, 3)] == [0, 0, 0, 0] and by_id[9] == 8 and by_id[4] == 4 and by_id[12] == 11
    assert by_id[None] is None
    kept = jaccard_join.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    left = Counter(r["doc_id"] for r in kept.collect())
    # One row of each group: also of rows that repeat an identifier and its text, and of those without identifier.
    assert left[0] == 1 and not {1, 2, 3, 9, 12} & set(left) and left[None] == 1 and left[20] == 2
    assert jaccard_join.jaccard_classes(edge.empty(spark), 4, 85).count() == 0
    assert jaccard_join.one_of_each(edge.empty(spark), 4, 85).count() == 0


def by_row(rows, k, percent):
    """Brute force over rows, whatever their identifiers: set size and number of the component of each."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    links = [(a, b) for a in label for b in range(a)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            changed |= label[a] != label[b]
            label[a] = label[b] = min(label[a], label[b])
    return [len(x) for x in sets], label


@pytest.mark.parametrize("seed", [2])
def test_jaccard_null_and_repeated_identifiers(spark, seed):
    """Links through rows without identifier, unique texts under a repeated one, equal rows."""
    rnd = random.Random(seed)
    rows = [(None if rnd.random() < 0.3 else rnd.randint(0, 90), t) for _, t in family(seed, 160)]
    base = [f"b{i}" for i in range(60)]
    near = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(base))
    rows += [(1000, near()), (2000, near(3)), (2000, "a text of its own under an identifier that repeats"), (None, near(3, 30)),
             (None, near(3, 30)), (3000, near(3, 30, 55)), (None, near(3, 30, 55, 58)), (None, None), (None, ""), (4000, None)]
    rows += rows[:6]
    docs = spark.createDataFrame([(*r, str(i % 5)) for i, r in enumerate(rows)], "doc_id long, text string, _key string").repartition(5)
    sizes, label = by_row(rows, 5, 80)
    groups = defaultdict(list)
    for (i, t), n, c in zip(rows, sizes, label, strict=True):
        groups[c if n else ("alone", len(groups))].append((i, t, n))
    want = Counter()
    for members in groups.values():
        ids = [i for i, *_ in members if i is not None]
        for i, _, n in members:
            want[i, n, min(ids) if ids else None] += 1
    got = jaccard_join.jaccard_classes(docs, 5, 80)
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = [tuple(r)[:2] for r in jaccard_join.one_of_each(docs, 5, 80).collect()]
    assert len(kept) == len(groups)
    # Of each group one row, one with its smallest identifier.
    left = Counter(kept)
    for members in groups.values():
        ids = [i for i, *_ in members if i is not None]
        low = min(ids) if ids else None
        here = [(i, t) for i, t, _ in members if i == low and left[i, t]]
        assert here
        left[here[0]] -= 1
    assert not +left


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    label = {x: x for ab in links for x in ab}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    alone = {x for x in label if all(a == b for a, b in links if x in (a, b))}
    assert got == {x: m for x, m in label.items() if x not in alone}


def test_line_dedup(spark):
    rnd = random.Random(2)
    rows = edge.rows()
    for i in range(200):
        lines = [rnd.choice(["Share this", "  All   rights reserved ", "", f"own {i}", f"line {rnd.randint(0, 40)}"]) for _ in range(6)]
        rows.append((100 + i, "\n".join(lines), "en", f"site{i % 30}" if i % 9 else None, 1, *edge.CLASHING))
    docs = spark.createDataFrame(rows, edge.SCHEMA).repartition(4)
    plain = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")
    sites = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            sites[plain(line)].add(r[3])
    gone = {x for x, s in sites.items() if x and len(s - {None}) >= line_dedup.MIN_SITES}
    want = Counter()
    for r in rows:
        lines = None if r[1] is None else r[1].split("\n")
        kept = None if lines is None else "\n".join(x for x in lines if plain(x) not in gone)
        want[r[0], kept, len(lines or []), sum(plain(x) in gone for x in lines or [])] += 1
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and "Share this" in gone
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == want
    assert line_dedup.dedup_lines(edge.empty(spark)).count() == 0


def brute(ids, x, asked, k):
    s = x[asked] @ x.T
    out = {}
    for row, a in enumerate(asked):
        order = sorted((i for i in range(len(ids)) if i != a), key=lambda i: (-round(s[row, i], 12), ids[i]))[:k]
        out[ids[a]] = [ids[i] for i in order]
    return out


def test_nearest_recall(spark):
    got = defaultdict(list)
    for r in nearest.op8_nearest(spark, SF_MID).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = spark.read.parquet(f"{SF_MID}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x, [i for i, v in enumerate(ids) if v % 20 == 0], nearest.NEAREST)
    assert set(got) == set(want)
    assert np.mean([len({v for _, v, _ in got[q]} & set(want[q])) / len(want[q]) for q in want]) >= 0.9
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        for _, v, s in found:
            assert abs(s - x[ids.index(q)] @ x[ids.index(v)]) < 1e-12


def test_nearest_edges(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MEMBERS", 16)
    monkeypatch.setattr(nearest, "QUERIES_", 4)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(200 + i, [1.0] * 8) for i in range(150)]
    bad = [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [float("inf")] * 8), (480, [None] * 8),
           (500, [1.0, 2.0]), (520, []), (None, [1.0] * 8)]
    data = spark.createDataFrame([(*r, "x") for r in rows + bad + rows[:3]], "vec_id long, embedding array<double>, rank string").repartition(5)
    model = nearest.fit(np.array([v for _, v in rows]))
    assert model["probes"] >= 1
    got = defaultdict(list)
    for r in nearest.search(data, nearest.F.col("_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    want = brute(ids, x, [i for i, v in enumerate(ids) if v % 20 == 0], 20)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    assert got[200] == [v for v in range(201, 221)]  # ties to the smaller identifier
    assert nearest.search(data.where("false"), nearest.F.col("_id") % 20 == 0).count() == 0


def test_nearest_small_parts(spark, monkeypatch):
    eye = np.eye(2) * 50
    net = {"a": eye, "b": np.zeros(2), "c": eye, "d": np.zeros(2), "scale": 1.0, "probes": 1, "dim": 2}
    monkeypatch.setattr(nearest, "train", lambda rows: net)  # a part by the larger coordinate
    rows = [(i, [1.0, 0.1 * i]) for i in range(3)] + [(i, [0.1, 1.0 + i / 50]) for i in range(3, 40)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(r["query_id"] for r in nearest.search(data, nearest.F.col("_id") < 6).collect())
    assert got == dict.fromkeys(range(6), 20)
    few = nearest.search(data.where("vec_id < 8"), nearest.F.col("_id") < 6).collect()
    assert Counter(r["query_id"] for r in few) == dict.fromkeys(range(6), 7)


def test_nearest_repeated_identifiers(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 40, rng.normal(size=6).tolist()) for i in range(90)] + [(7, rng.normal(size=6).tolist()) for _ in range(30)]
    rows += rows[:5]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = nearest.search(data, nearest.F.col("_id") % 20 == 0, nearest=10).collect()
    want = set()
    for q in (0, 20):
        best = {}
        for a, x in rows:
            for b, y in rows:
                if a == q and b != q:
                    best[b] = max(best.get(b, -np.inf), float(np.dot(x, y)))
        for rank, (b, s) in enumerate(sorted(best.items(), key=lambda i: (-i[1], i[0]))[:10], 1):
            want.add((q, rank, b, round(s, 9)))
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got} == want and len(got) == 20
