"""A small table with every edge case: nulls, empty and long texts, ties, repeats, clashing column names."""

from pyspark.sql import types as T

CLASHING = ["_id", "_text", "_row", "_key", "_u", "keep_id", "kept", "copy", "slot", "shard", "decoded", "_score", "_n"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in CLASHING]])

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(20_000))
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b"),
    (2, "The  quick brown\tfox jumps over\nthe lazy dog near the old river bank today.", "en", "a"),
    (3, "THE quick brown fox jumps over the lazy dog near the old river bank today.", "en", None),
    (4, None, "en", "a"), (5, "", None, "a"), (6, " ", "fr", "a"), (7, " \n\t ", "fr", "a"),
    (8, "one two three", "en", "b"), (9, "One two THREE", "en", "b"), (10, "12345 !!! ???", "de", "b"),
    (11, LONG, "en", "a"), (12, LONG + " tail", "en", "b"), (13, "x" * 40_000, None, "c"),
    (14, "héllo wörld ñandú 漢字 😀 ▁mark <s> <0x0A>", "es", "c"), (15, "a\nb\nc\n\nb\n", "en", "c"),
    (None, "no identifier here", "en", "a"), (None, "no identifier here", "en", "a"),
    (0, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (20, "same id, other text", "en", "a"), (20, "same id, another text altogether", "en", "a"),
]


def rows():
    return [(i, t, lang, s, None if t is None else len(t), *[c.upper() for c in CLASHING]) for i, t, lang, s in TEXTS]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
