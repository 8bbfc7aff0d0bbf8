"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, every run of characters that are no letters becomes one
blank, and its 1-, 2- and 3-grams are hashed into ``BUCKETS``.  Document
frequencies cover every document that may be learned from: each task counts
its rows into one array, and the arrays are summed by bucket.  The weights are
trained with follow-the-regularised-leader (per-coordinate rates, L1 and L2
penalties, so most weights are exactly zero) in one task on a bounded sample
of labelled rows: about ``SAMPLE_PER_LANG`` a language by a seeded hash, whole
texts.  A temperature fitted on a part of the sample that training does not
see calibrates the probabilities.  Prediction is row-local.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and
is not learned from, nor is a null label; very long texts are read whole;
repeated rows count each; with no labelled rows every text is ``und``; an empty
table gives an empty result; the input's other columns come back untouched.
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

BUCKETS = 1 << 14
#: Expected rows of a language in the training sample.
SAMPLE_PER_LANG = 1_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed 1-, 2- and 3-grams of each text, and whether it has a letter."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    some = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        if not text:
            continue
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ok = letters[c]
        some[i] = ok.any()
        if not some[i]:
            continue
        c = np.where(ok, c, np.uint64(32))
        blank = ~ok
        c = np.concatenate((c[:1] * 0 + 32, c[ok | ~np.concatenate(([True], blank[:-1]))], c[:1] * 0 + 32))
        two = (c[:-1] << np.uint64(21)) | c[1:]
        three = (two[:-1] << np.uint64(21)) | c[2:]
        keys = np.concatenate((c[1:-1], two, three)) * np.uint64(0x9E3779B97F4A7C15)
        out[i] = np.bincount((keys >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return out, some


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt(np.square(x).sum(1, keepdims=True)), 1e-9)


def softmax(t: np.ndarray) -> np.ndarray:
    e = np.exp(t - t.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Leader:
    """Follow the regularised leader: weights from summed gradients, per-coordinate rates, elastic net."""

    def __init__(self, rows: int, classes: int):
        self.z = np.zeros((rows, classes), np.float32)
        self.n = np.zeros((rows, classes), np.float32)

    def weights(self) -> np.ndarray:
        w = -(self.z - np.sign(self.z) * L1) / ((BETA + np.sqrt(self.n)) / ALPHA + L2)
        return np.where(np.abs(self.z) > L1, w, 0).astype(np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        w = self.weights()
        g = x.T @ (softmax(x @ w) - y)
        n = self.n + np.square(g)
        self.z += g - (np.sqrt(n) - np.sqrt(self.n)) / ALPHA * w
        self.n = n


def fit(texts: list[str], langs: list[str], idf: np.ndarray, seed: int = 7) -> dict:
    letters = _letters()
    parts = [gram_counts(texts[lo:lo + 200], letters) for lo in range(0, len(texts), 200)]
    ok = np.concatenate([s for _, s in parts]) if parts else np.zeros(0, bool)
    names = sorted({lang for lang, good in zip(langs, ok, strict=True) if good})
    if not names:
        return {"langs": [], "w": np.zeros((BUCKETS, 0), np.float32), "t": 1.0, "idf": idf}
    sparse = [(at := np.flatnonzero(row), row[at]) for counts, _ in parts for row in tf_idf(counts, idf)]
    y = np.eye(len(names), dtype=np.float32)[[names.index(x) if g else 0 for x, g in zip(langs, ok, strict=True)]]
    rng = np.random.default_rng(seed)
    order = rng.permutation(np.flatnonzero(ok))
    apart, learned = order[: len(order) // 5], order[len(order) // 5:]

    def rows(some):
        x = np.zeros((len(some), BUCKETS), np.float32)
        for k, i in enumerate(some):
            x[k, sparse[i][0]] = sparse[i][1]
        return x

    leader = Leader(BUCKETS, len(names))
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(learned), max(1, len(learned) // 32)):
            leader.step(rows(some), y[some])
    w = leader.weights()
    check = apart if len(apart) else learned
    logits = np.vstack([rows(some) @ w for some in np.array_split(check, max(1, len(check) // 200))])
    truth = y[check].argmax(1)
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return {"langs": names, "w": w, "t": float(grid[int(np.argmin(loss))]), "idf": idf}


def held_out(id_col: Column) -> Column:
    """Every fifth document by the CRC-32 of its identifier's text; such rows are never learned from."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def document_frequencies(texts: DataFrame) -> DataFrame:
    """``bucket, df`` over all rows of ``_text``; bucket -1 has the number of rows with a letter."""

    def count(batches):
        letters, df, n = _letters(), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                counts, some = gram_counts(batch.slice(lo, 64).column(0).to_pylist(), letters)
                df += (counts > 0).sum(0)
                n += int(some.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())],
                                         names=["bucket", "df"])

    return (texts.select("_text").mapInArrow(count, "bucket long, df long")
            .groupBy("bucket").agg(F.sum("df").alias("df")))


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> dict:
    """Fitted arrays, of a fixed size but for the number of languages."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"),
                       F.col(f"`{lang_col}`").cast("string").alias("_lang"))
    rows = rows.where(F.col("_text").isNotNull() & F.col("_lang").isNotNull() & ~held_out(F.col("_id")))
    idf = np.zeros(BUCKETS, np.float32)
    df = dict(document_frequencies(rows).collect())  # at most BUCKETS + 1 rows
    n = df.pop(-1, 0)
    at = np.array(list(df), int)
    idf[at] = np.log((1 + n) / (1 + np.array(list(df.values()), float))) + 1

    shares = rows.groupBy("_lang").agg((F.lit(float(per_lang)) / F.count(F.lit(1))).alias("_share"))
    sample = rows.join(F.broadcast(shares), "_lang").where(hash_uniform("lang", F.col("_id")) < F.col("_share"))

    def fit_all(batches):
        import pandas as pd

        pdf = pd.concat([pd.DataFrame({"_id": [], "_text": [], "_lang": []}), *batches]).sort_values(["_id", "_lang"])
        yield pd.DataFrame({"model": [pickle.dumps(fit(pdf["_text"].tolist(), pdf["_lang"].tolist(), idf))]})

    found = sample.select("_id", "_text", "_lang").repartition(1).mapInPandas(fit_all, "model binary").first()
    return pickle.loads(found[0]) if found else fit([], [], idf)  # no task runs on no rows


def predict(docs: DataFrame, model: dict, text_col: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability (replacing columns of those names)."""
    rest = docs.drop(lang_col, score_col)
    rows = rest.select(F.col(f"`{text_col}`").alias("_text"),
                       whole_row(rest.drop(text_col)).alias("_row") if set(rest.columns) - {text_col}
                       else F.struct(F.lit(1).alias("_")).alias("_row"))

    def languages(batches):
        letters, names = _letters(), model["langs"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                counts, some = gram_counts(part.column(part.schema.names.index("_text")).to_pylist(), letters)
                some &= bool(names)
                if names:
                    p = softmax(tf_idf(counts, model["idf"]) @ model["w"] / model["t"])
                    best, top = p.argmax(1), p.max(1)
                else:
                    best, top = np.zeros(len(some), int), np.zeros(len(some))
                lang = [names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(np.where(some, top, 0.0).astype(float), pa.float64())],
                    names=[*part.schema.names, "_lang", "_score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    return rows.mapInArrow(languages, schema).select(
        *[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in rest.columns],
        F.col("_lang").alias(lang_col), F.col("_score").alias(score_col))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}
