"""Approximate nearest neighbours with learned partitions.

On a bounded sample (``SAMPLE`` vectors with the smallest seeded hashes) the
graph of nearest neighbours is cut into balanced parts: bisections along a
smoothed random vector over the graph, then moves to the part that holds most
of a vector's neighbours, within a capacity.  A small network learns how a
vector's neighbours spread over the parts.  Every row is indexed under its most
probable part; a query is routed to its most probable parts, as many as the
sample needs for ``TARGET`` of the true neighbours of vectors kept apart
(fewer where vectors cluster, many where they are spread evenly) and until they
hold enough candidates, and ranked there exactly, by inner products in double
precision.

Parts are dealt over blocks of bounded size, so a vector that a third of all
rows share makes more blocks, not a larger task; per query only the best of
each block are shuffled.

Edge cases: vectors that are null, zero, of another length than most of the
sample, or hold a null or non-finite number take no part, nor do null
identifiers; the vectors of one identifier are all indexed and all asked for,
its best score with another identifier counts, it is no neighbour of itself,
and equal rows count once; ties go to the smaller identifier; fewer candidates
than asked for are all returned; an empty table gives an empty result; other
columns take no part.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popweave.functions.hashing import hash_uniform
from popweave.llm.common import stash, table

NEAREST = 20
SAMPLE = 8_192
LINKS = 10
PARTS = 32
#: Sampled vectors of a part at least.
PART_ROWS = 64
HIDDEN = 128
TARGET = 0.95
#: Members and queries of a block.
MEMBERS, QUERIES_ = 2_048, 1_024


def usable(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)


def neighbours(x: np.ndarray, y: np.ndarray, k: int, skip: bool) -> np.ndarray:
    """Places in ``y`` of the ``k`` rows with the largest inner products with each row of ``x`` (``skip``: not itself)."""
    out = []
    for lo in range(0, len(x), 512):
        s = x[lo:lo + 512] @ y.T
        if skip:
            s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.vstack(out)


def balanced_parts(links: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each vertex of a graph, given the neighbours of each; parts are a power of two."""
    n, k = links.shape
    part = np.zeros(n, int)
    src = np.repeat(np.arange(n), k)
    a, b = np.concatenate((src, links.ravel())), np.concatenate((links.ravel(), src))
    while part.max() + 1 < parts:
        v = rng.normal(size=n)
        inside = part[a] == part[b]
        for _ in range(30):
            v = v + np.bincount(a[inside], weights=v[b[inside]], minlength=n) / np.maximum(
                np.bincount(a[inside], minlength=n), 1)
            for p in range(part.max() + 1):  # no constant direction
                v[part == p] -= v[part == p].mean()
            v /= np.abs(v).max() + 1e-12
        halves = np.zeros(n, int)
        for p in range(part.max() + 1):
            rows = np.flatnonzero(part == p)
            halves[rows[np.argsort(v[rows], kind="stable")[len(rows) // 2:]]] = 1
        part = part * 2 + halves
    capacity = int(np.ceil(1.05 * n / parts))
    for _ in range(8):
        counts = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        best = counts.argmax(1)
        gain = counts[np.arange(n), best] - counts[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < capacity and rng.random() < 0.7:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def probabilities(x: np.ndarray, net: dict) -> np.ndarray:
    h = np.maximum(x @ net["a"] + net["b"], 0)
    t = h @ net["c"] + net["d"]
    e = np.exp(t - t.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(x: np.ndarray, want: np.ndarray, rng: np.random.Generator, epochs: int = 40) -> dict:
    """A network of one hidden layer from vectors to shares of parts, by Adam."""
    d, p = x.shape[1], want.shape[1]
    net = {"a": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "b": np.zeros(HIDDEN),
           "c": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, p)), "d": np.zeros(p)}
    m, s, t = {k: 0.0 for k in net}, {k: 0.0 for k in net}, 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[rows] @ net["a"] + net["b"], 0)
            g = (probabilities(x[rows], net) - want[rows]) / len(rows)
            gh = (g @ net["c"].T) * (h > 0)
            grads = {"a": x[rows].T @ gh + 1e-5 * net["a"], "b": gh.sum(0), "c": h.T @ g + 1e-5 * net["c"], "d": g.sum(0)}
            t += 1
            for k, grad in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad ** 2
                net[k] = net[k] - 0.01 * (1 - epoch / epochs) * (m[k] / (1 - 0.9 ** t)) / (
                    np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
    return net


def fit(x: np.ndarray, nearest: int = NEAREST, seed: int = 8) -> dict:
    """The network and the number of parts that a query is routed to."""
    rng = np.random.default_rng(seed)
    scale = float(np.sqrt(np.square(x).sum(1).mean())) or 1.0
    x = x / scale
    parts = 1
    while parts < PARTS and len(x) >= 2 * parts * PART_ROWS:
        parts *= 2
    if parts == 1:
        zero = {"a": np.zeros((x.shape[1], 1)), "b": np.zeros(1), "c": np.zeros((1, 1)), "d": np.zeros(1)}
        return zero | {"scale": scale, "probes": 1, "dim": x.shape[1]}
    links = neighbours(x, x, min(LINKS, len(x) - 1), True)
    part = balanced_parts(links, parts, rng)
    want = np.zeros((len(x), parts))
    for column in (part[:, None], part[links]):
        np.add.at(want, (np.arange(len(x))[:, None], column), 1.0)
    want /= want.sum(1, keepdims=True)
    apart = rng.random(len(x)) < 0.1
    net = learn(x[~apart], want[~apart], rng)
    # Routing as the whole index will do it: rows under their most probable part.
    base, asked = x[~apart], x[apart]
    true = neighbours(asked, base, min(nearest, len(base)), False)
    home = probabilities(base, net).argmax(1)[true]
    order = probabilities(asked, net).argsort(1)[:, ::-1]
    place = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], home]
    recall = [(place < p).mean() for p in range(1, parts + 1)]
    probes = next((p for p, r in enumerate(recall, 1) if r >= TARGET), parts)
    return net | {"scale": scale, "probes": probes, "dim": x.shape[1]}


def train(vectors: DataFrame, sample: int = SAMPLE) -> dict | None:
    """vectors: ``_id, _vector``, usable ones; None if there are none."""
    chosen = vectors.orderBy(hash_uniform("vectors", F.col("_id"), F.xxhash64("_vector")), "_id", "_vector").limit(sample)

    def fit_all(batches):
        import pandas as pd

        rows = [v for pdf in batches for v in pdf["_vector"]]
        sizes = np.array([len(v) for v in rows])
        if len(rows):
            dim = int(np.bincount(sizes).argmax())
            model = fit(np.array([v for v in rows if len(v) == dim], float))
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    got = chosen.repartition(1).mapInPandas(fit_all, "model binary").first()
    return pickle.loads(got[0]) if got else None


def _route(model: dict, probes: int, held: np.ndarray | None = None, least: int = 0):
    """The ``probes`` most probable parts of a vector, and the next ones until they have ``least`` of what parts ``held``."""
    def route(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                p = probabilities(np.array(pdf["_vector"].tolist(), float) / model["scale"], model)
                best = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
                n = np.full(len(best), probes)
                if held is not None:
                    n = np.maximum(n, (np.cumsum(held[best], axis=1) < least).sum(1) + 1)
                yield pd.DataFrame({"_id": pdf["_id"], "_vector": pdf["_vector"], "_parts": [b[:k] for b, k in zip(best, n, strict=True)]})
    return route


def _best(nearest: int):
    """The best members of a block for each query of a block."""

    def best(members, queries):
        import pandas as pd

        if not len(members) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": float})
        members = members.sort_values("_id", kind="stable")
        m, q = (np.array(x["_vector"].tolist(), float) for x in (members, queries))
        ids, asked = members["_id"].to_numpy(), queries["_id"].to_numpy()
        s = q @ m.T
        s[asked[:, None] == ids[None, :]] = -np.inf
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        out = []
        for row, i in enumerate(asked):
            found = s[row]
            if len(first) > nearest:
                # All that may tie once summed in one order: equal vectors must score the same.
                top = np.maximum.reduceat(found, first)
                least = np.partition(top, len(top) - nearest)[len(top) - nearest]
                at = np.flatnonzero(found >= least - 1e-9 * max(1.0, abs(least)))
            else:
                at = np.arange(len(ids))
            at = at[np.isfinite(found[at])]
            score = (m[at] * q[row]).sum(axis=1)
            order = np.lexsort((ids[at], -score))
            _, once = np.unique(ids[at][order], return_index=True)  # an identifier by its best vector
            order = order[np.sort(once)][:nearest]
            out.append(pd.DataFrame({"query_id": i, "vec_id": ids[at][order], "score": score[order]}))
        return pd.concat(out)

    return best


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows that ``is_query`` marks (a condition on ``_id``) among all rows."""
    rows = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vector_col}`").alias("_vector"))
            .where(F.col("_id").isNotNull() & usable(F.col("_vector")))
            .distinct())
    rows = stash(rows, "usable-vectors")
    model = train(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("_vector") == model["dim"])
    kind = rows.schema["_vector"].dataType.simpleString()
    routed = lambda df, *how: df.mapInPandas(
        _route(model, *how), f"_id long, _vector {kind}, _parts array<int>").select("_id", "_vector", F.explode("_parts").alias("_part"))
    index = stash(routed(rows, 1), "vector-index")
    held = np.zeros(len(model["d"]), np.int64)
    for part, n in index.groupBy("_id").agg(F.min("_part").alias("_part")).groupBy("_part").count().collect():  # a row a part
        held[part] = n
    asked = stash(routed(rows.where(is_query), model["probes"], held, nearest + 1), "vector-queries")
    blocks = (index.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("_ms"))
              .join(asked.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / QUERIES_).cast("int").alias("_qs")), "_part"))
    blocks = F.broadcast(blocks)  # a row a part, PARTS at most
    of = lambda n: F.pmod(F.xxhash64("_id", "_vector"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = index.join(blocks, "_part").select("_part", of(F.col("_ms")).alias("_mb"), upto("_qs").alias("_qb"), "_id", "_vector")
    queries = asked.join(blocks, "_part").select("_part", upto("_ms").alias("_mb"), of(F.col("_qs")).alias("_qb"), "_id", "_vector")
    where = ["_part", "_mb", "_qb"]
    found = members.groupBy(*where).cogroup(queries.groupBy(*where)).applyInPandas(
        _best(nearest), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0)


QUERIES = {"op8_nearest": op8_nearest}
ORACLES: dict[str, str] = {}
