"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words (hashed into ``BUCKETS``, damped counts of
unit length), standardised statistics of its structure, and the decimal class
of its stated length.  The score adds to a linear part the interactions of all
pairs of features through rank-``RANK`` factors, in linear time:

    sum over pairs <v_i, v_j> x_i x_j = ((sum v_i x_i)^2 - sum (v_i x_i)^2) / 2.

The machine is trained in one task on a bounded sample of labelled rows
(``SAMPLE`` identifiers with the smallest seeded hashes, whole texts); the
fitted arrays have a fixed size.  Scoring is row-local, with no shuffle.

Edge cases: null and empty texts have no words and neutral statistics, and are
scored by the rest; very long texts are read whole; null labels are not
learned from; of a repeated identifier one row is learned from and all rows
are scored; without both labels in the sample every score is the share of
label 1 (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.functions.hashing import hash_uniform
from popweave.llm.common import table, whole_row
from popweave.llm.textarrays import batches_of, word_hashes

BUCKETS = 1 << 13
RANK = 8
SAMPLE = 5_000
EPOCHS = 12
#: Scores from here on are predicted as label 1.
THRESHOLD = 0.3
_LENGTH_CLASSES = 12
#: Byte classes: upper, lower, digit, blank, line feed, sentence marks, other ASCII, beyond ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
N_STATS = 8 + 8


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word part (unit rows of ``BUCKETS``) and structure statistics of each text."""
    words = np.zeros((len(texts), BUCKETS), np.float32)
    stats = np.zeros((len(texts), N_STATS), np.float32)
    for lo, hi, raw, begin in batches_of(texts):
        n = hi - lo
        size = np.diff(np.append(begin, len(raw)))
        doc_of_byte = np.repeat(np.arange(n), size)
        kind = _CLASS[raw]
        kinds = np.bincount(doc_of_byte * 8 + kind, minlength=n * 8).reshape(n, 8).astype(float)
        kinds[:, 4] -= 1  # the line feed put after the text
        bytes_ = np.maximum(size - 1, 1)[:, None]
        h, starts, ends = word_hashes(raw)
        doc = doc_of_byte[starts] if len(starts) else np.zeros(0, np.int64)
        counts = np.bincount(doc * BUCKETS + (h >> np.uint64(40)).astype(np.int64) % BUCKETS,
                             minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
        n_words = counts.sum(1)
        some = np.maximum(n_words, 1)
        length = ends - starts
        by_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
        last = raw[ends - 1] if len(ends) else raw[:0]
        first = raw[starts] if len(starts) else raw[:0]
        stats[lo:hi, :8] = kinds / bytes_
        stats[lo:hi, 8:] = np.stack([
            np.log1p(n_words), by_doc(length) / some, by_doc(np.square(length)) / some, np.log1p(kinds[:, 4]),
            (counts > 0).sum(1) / some, counts.max(1) / some,
            by_doc((_CLASS[last] == 6)) / some, by_doc((_CLASS[first] == 0)) / some], axis=1)
        damped = np.log1p(counts)
        words[lo:hi] = damped / np.maximum(np.sqrt(np.square(damped).sum(1, keepdims=True)), 1e-6)
    return words, stats


def _length_class(n_chars: np.ndarray) -> np.ndarray:
    """One column for each factor of two of tens of characters; the last for missing lengths."""
    known = np.isfinite(n_chars)
    k = np.where(known, np.clip(np.log2(np.maximum(np.where(known, n_chars, 0), 0) / 10 + 1), 0, _LENGTH_CLASSES - 2),
                 _LENGTH_CLASSES - 1).astype(int)
    return np.eye(_LENGTH_CLASSES, dtype=np.float32)[k]


def design(texts: list, n_chars: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    words, stats = features(texts)
    z = np.clip((stats - mean) / sd, -4, 4) * 0.5
    z[[not t for t in texts]] = 0
    return np.hstack([words, z, 0.5 * _length_class(n_chars)]).astype(np.float32)


def score(x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The machine's sum, pairs by the sum-of-squares identity."""
    s = x @ v
    return w0 + x @ w + 0.5 * (np.square(s) - np.square(x) @ np.square(v)).sum(1)


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def fit(texts: list, n_chars: np.ndarray, y: np.ndarray, seed: int = 9) -> dict:
    """AdaGrad on the log loss in small batches; labels weigh the same, so 0.5 keeps its meaning as the prior's."""
    share = float(y.mean()) if len(y) else 0.5
    zero = {"mean": np.zeros(N_STATS), "sd": np.ones(N_STATS), "w0": float(np.log((share + 1e-3) / (1 - share + 1e-3))),
            "w": np.zeros(BUCKETS + N_STATS + _LENGTH_CLASSES, np.float32),
            "v": np.zeros((BUCKETS + N_STATS + _LENGTH_CLASSES, RANK), np.float32)}
    if len(set(y.tolist())) < 2:
        return zero
    parts = [features(texts[lo:lo + 250]) for lo in range(0, len(texts), 250)]
    stats = np.vstack([s for _, s in parts])
    mean, sd = stats.mean(0), stats.std(0) + 1e-3
    sparse = [(lambda i: (i, row[i]))(np.flatnonzero(row)) for words, _ in parts for row in words]
    del parts
    z = np.clip((stats - mean) / sd, -4, 4) * 0.5
    z[[not t for t in texts]] = 0
    dense = np.hstack([z, 0.5 * _length_class(n_chars)]).astype(np.float32)
    rng = np.random.default_rng(seed)
    w0, w = zero["w0"], zero["w"].copy()
    v = rng.normal(0, 0.05, zero["v"].shape).astype(np.float32)
    g0, gw, gv = 1e-2, np.full_like(w, 1e-2), np.full_like(v, 1e-2)
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            x = np.zeros((len(some), len(w)), np.float32)
            for k, i in enumerate(some):
                at, val = sparse[i]
                x[k, at] = val
            x[:, BUCKETS:] = dense[some]
            s = x @ v
            x2 = np.square(x)
            p = sigmoid(w0 + x @ w + 0.5 * (np.square(s) - x2 @ np.square(v)).sum(1))
            d = ((p - y[some]) / len(some)).astype(np.float32)
            grad0, grad_w = d.sum(), x.T @ d + 1e-5 * w
            grad_v = x.T @ (d[:, None] * s) - (x2.T @ d)[:, None] * v + 1e-4 * v
            g0, gw, gv = g0 + grad0 ** 2, gw + grad_w ** 2, gv + grad_v ** 2
            w0 -= 0.1 * grad0 / np.sqrt(g0)
            w -= 0.1 * grad_w / np.sqrt(gw)
            v -= 0.05 * grad_v / np.sqrt(gv)
    return {"mean": mean, "sd": sd, "w0": float(w0), "w": w, "v": v}


def held_out(id_col: Column) -> Column:
    """Every fifth document by the CRC-32 of its identifier's text; such rows are never learned from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          size_col: str | None = "n_chars", label_col: str = "quality") -> dict:
    """Fitted arrays, of a fixed size; one task reads the sample."""
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0.0, 1.0) & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(hash_uniform("quality", F.col("_id")), "_id").limit(sample)
    )
    size = F.col(f"`{size_col}`").cast("double") if size_col in docs.columns else F.lit(None).cast("double")
    rows = (
        docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), size.alias("_n"))
        .join(F.broadcast(chosen), "_id")  # at most ``sample`` rows
        .dropDuplicates(["_id"])
    )

    def fit_all(batches):
        import pandas as pd

        pdf = pd.concat([pd.DataFrame({"_id": [], "_text": [], "_n": [], "_y": []}), *batches]).sort_values("_id")
        model = fit([t if isinstance(t, str) else None for t in pdf["_text"]],
                    pdf["_n"].to_numpy(float, na_value=np.nan), pdf["_y"].to_numpy(float))
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found = rows.repartition(1).mapInPandas(fit_all, "model binary").first()
    return pickle.loads(found[0]) if found else fit([], np.zeros(0), np.zeros(0))  # no task runs on no rows


def score_rows(docs: DataFrame, model: dict, text_col: str = "text", size_col: str | None = "n_chars",
               score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each row's whole text (``score_col`` replaces a column of that name)."""
    rest = docs.drop(score_col)
    size = F.col(f"`{size_col}`").cast("double") if size_col in docs.columns else F.lit(None).cast("double")
    rows = rest.select(whole_row(rest).alias("_row"), F.col(f"`{text_col}`").alias("_text"), size.alias("_n"))
    if set(rest.columns) - {text_col}:  # the text travels once
        rows = rest.select(whole_row(rest.drop(text_col)).alias("_row"), F.col(f"`{text_col}`").alias("_text"),
                           size.alias("_n"))

    def scores(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                some = batch.slice(lo, 128)
                col = lambda c: some.column(some.schema.names.index(c))  # noqa: E731, B023
                x = design(col("_text").to_pylist(), col("_n").to_numpy(zero_copy_only=False).astype(float),
                           model["mean"], model["sd"])
                got = sigmoid(score(x, model["w0"], model["w"], model["v"])).astype(float)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(got, pa.float64())],
                                                 names=[*some.schema.names, "_score"])

    done = rows.mapInArrow(scores, T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType())]))
    inside = {f.name for f in rows.schema["_row"].dataType.fields}
    return done.select(*[F.col("_row").getField(c).alias(c) if c in inside else F.col("_text").alias(c)
                         for c in rest.columns], F.col("_score").alias(score_col))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = score_rows(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
