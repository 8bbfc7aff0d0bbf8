"""Exact dedup, mixing and sharding against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from popweave.functions.hashing import py_hash_uniform
from popweave.llm import exact_dedup, mixing, sharding
from tests.llm import edge

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def expected_copies(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[WHITE.sub(" ", text or "")].append(i)
    out = Counter()
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            out[i, keep, len(ids), n == 0, sha] += 1
    return out


@pytest.mark.parametrize("hot_share", [0.001, 1.0])
def test_exact_dedup(spark, hot_share, monkeypatch):
    monkeypatch.setattr(exact_dedup.hot_texts, "__defaults__", (exact_dedup.SAMPLE_ROWS, hot_share))
    many = [(100 + i, "a hot text\nwith two lines") for i in range(300)] + [(900 + i % 2, "b  c") for i in range(40)]
    docs = edge.documents(spark).select("doc_id", "text").unionByName(
        spark.createDataFrame(many, "doc_id long, text string").repartition(4))
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == expected_copies([(r[0], r[1]) for r in edge.rows()] + many)


def test_dedup_rows_keep_columns(spark):
    docs = edge.documents(spark)
    kept = exact_dedup.dedup_rows(docs)
    assert kept.columns == docs.columns
    want = {k for k, n in expected_copies([(r[0], r[1]) for r in edge.rows()]).items() if k[3]}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k[0] for k in want)
    assert all(r["keep_id"] == "KEEP_ID" for r in kept.collect())
    assert exact_dedup.dedup_rows(edge.empty(spark)).count() == 0
    assert exact_dedup.exact_dedup(edge.empty(spark)).count() == 0


def expected_mix(rows, weights=None, total=None, alpha=mixing.ALPHA):
    sizes = Counter(s for _, s in rows)
    w = {s: (float(n) ** alpha if weights is None else weights.get(s, 0.0)) for s, n in sizes.items()}
    out = Counter()
    for i, s in rows:
        rate = (total or len(rows)) * w[s] / sum(w.values()) / sizes[s] if sum(w.values()) else 0.0
        u, n, cum = py_hash_uniform(mixing.SEED, "" if i is None else i), 0, 0.0
        while rate and (cum := cum + math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1))) <= u and n < 1000:
            n += 1
        for c in range(1, n + 1):
            out[i, s, c] += 1
    return out


@pytest.mark.parametrize("weights,total,bound", [(None, None, 10**6), ({"a": 3.0, "b": 1.0, "zz": 9.0}, 90, 0), (None, 200, 0),
                                                  ({"zz": 1.0}, None, 10**6)])
def test_mixing(spark, weights, total, bound, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", bound)
    docs = edge.documents(spark)
    got = mixing.mix_sources(docs, weights=weights, total=total, copy_col="_copy_", key_col=None)
    assert got.columns == [*docs.columns, "_copy_"]
    want = expected_mix([(r[0], r[3]) for r in edge.rows()], weights, total)
    assert Counter((r["doc_id"], r["source"], r["_copy_"]) for r in got.collect()) == want
    assert all(r["copy"] == "COPY" for r in got.collect())


def test_mixing_reaches_its_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'big', concat('s', id % 50)) as source")
    got = dict(mixing.mix_sources(docs, weights={"big": 1.0, "s1": 1.0}, total=30_000).groupBy("source").count().collect())
    assert set(got) == {"big", "s1"}
    assert all(abs(n - 15_000) < 5 * 15_000 ** 0.5 for n in got.values())


def test_mixing_empty(spark):
    assert mixing.mix_sources(edge.empty(spark)).count() == 0


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(12)]
    held = sharding.lookup_table(names, 1009)
    shares = Counter(held)
    assert max(shares.values()) - min(shares.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(held, fewer, strict=True) if a != 11)
    assert moved < 0.3 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_place(spark, tmp_path):
    docs = edge.documents(spark)
    got = sharding.place(docs, shards=5, slot_col="_slot_", shard_col="_shard_").collect()
    held = sharding.lookup_table([f"shard-{i}" for i in range(5)])
    for r in got:
        text = f"{sharding.SEED}:{'' if r['doc_id'] is None else r['doc_id']}"
        assert r["_slot_"] == int(hashlib.md5(text.encode()).hexdigest()[:13], 16) % sharding.SLOTS
        assert r["_shard_"] == held[r["_slot_"]] and r["slot"] == "SLOT"
    assert len(got) == len(edge.rows())
    assert sharding.place(edge.empty(spark)).count() == 0
    sharding.write_shards(docs.drop("shard", "slot"), str(tmp_path / "shards"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(edge.rows()) and len(list((tmp_path / "shards").glob("shard=*/*.parquet"))) <= 32
