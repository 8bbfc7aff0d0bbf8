"""Spelling variants against a dictionary of deletion patterns, on whole tables and edge rows; filters against sets."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from popweave.llm import spelling as S
from tests.conftest import SF_SMALL
from tests.llm import edge

LOWER = {c: c + 32 for c in range(65, 91)}


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def grouped(words):
    """By patterns: two words of one length share one with a blanked letter; a longer word's deletions are looked up."""
    near, patterns = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            patterns[w[:i], w[i + 1:]].append(w)
            shorter = w[:i] + w[i + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in patterns.values():
        for a in same:
            near[a].update(b for b in same if b != a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = grouped(counted(docs))
    assert result(S.op11_spelling_variants(spark, SF_SMALL)) == want
    assert sum(v[3] > 0 for v in want.values()) > 50 and any(v[0] for v in want.values())


def made_words():
    """Families of frequent words with edits at every place, chains of forms and long words."""
    pick = random.Random(8)
    letters = "abcdefgxyzßàéöÿ÷×"
    words = {}
    for _ in range(60):
        base = "".join(pick.choice(letters) for _ in range(pick.randint(7, 15)))
        words[base] = pick.choice([100, 5000])
        for _ in range(40):
            i, kind = pick.randrange(len(base)), pick.random()
            edit = base[:i] + ("" if kind < 0.3 else pick.choice(letters)) + base[i + (0 if kind > 0.7 else 1):]
            if len(edit) >= 7:
                words.setdefault(edit, pick.choice([2, 9, 10, 11, 100]))
                j = pick.randrange(len(edit))
                words.setdefault(edit[:j] + "q" + edit[j:], 2)
    words.update({"aaaaaaaa": 40, "aaaaaaa": 4, "aaaaaaaaa": 4, "chainxaa": 2, "chainxab": 20, "chainxbb": 200, "chainybb": 2000,
                  "z" * 4000: 3, "z" * 3999: 30, "z" * 3000 + "y" + "z" * 999: 300})
    return words


@pytest.mark.parametrize("small", [False, True])
def test_families_and_chains(spark, monkeypatch, small):
    if small:  # filters of many ranges, sent in many rounds
        monkeypatch.setattr(S, "RANGE", 4)
        monkeypatch.setattr(S, "ROUND_BYTES", 16 * 64)
        monkeypatch.setattr(S, "PROBES", 500)
    words = made_words()
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    got, want = result(S.variants(df)), grouped(words)
    assert got == want
    assert got["chainxaa"][:2] == ("chainxab", "chainybb") and got["aaaaaaa"][0] == "aaaaaaaa"


def test_edge_rows(spark):
    texts = ["Colour colour COLOURED coloured", "naïveté naïveté naïvetÉ", "co-operate cooperate cooperate", "a1b2c3d4e5f6g7",
             "x" * 9000, "x" * 9000, "漢字abcdefgh漢字abcdefgh abcdefgx abcdefgx", "ÀÀÀÀÀÀÀ àààààààà àààààààà"]
    rows = [(*r[:5], *["c"] * len(edge.CLASHING)) for r in edge.rows()]
    rows += [(k if k % 3 else None, t, None, None, 0, *["c"] * len(edge.CLASHING)) for k, t in enumerate(texts * 20)]
    df = spark.createDataFrame(rows, edge.SCHEMA).repartition(4)
    want = grouped(counted([(r[0], r[1]) for r in rows]))
    assert result(S.variants(S.vocabulary(S.occurrences(df)))) == want and len(want) > 10
    assert S.variants(S.vocabulary(S.occurrences(edge.empty(spark)))).collect() == []


def test_filters_hold_all_words_and_few_others():
    pick = random.Random(9)
    words = list({"".join(pick.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)})
    layout = S.Layout({9: len(words)})
    block, bits = layout.place(S._word_hashes(words), 9)
    parts = [S._build(S.pd.DataFrame({"_range": r, "_block": block[block // S.RANGE == r] % S.RANGE,
                                      "_bits": bits[block // S.RANGE == r].view(np.int64)}))["_filter"][0]
             for r in range(-(-layout.total // S.RANGE))]
    filters = S.Filters(layout, 0, np.frombuffer(b"".join(parts), np.uint64))
    assert len(filters.has(S._word_hashes(words), 9)) == len(words)
    others = ["".join(pick.choice("klmnopqrst") for _ in range(9)) for _ in range(20_000)]
    assert len(filters.has(S._word_hashes(others), 9)) < 200
    assert filters.cover(9) and not filters.cover(8)
