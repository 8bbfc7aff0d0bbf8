"""Packing of documents into token sequences by a configuration linear program.

A document is its ids and an end id.  Only those longer than a sequence are
cut, into pieces of a whole sequence each, the first one shorter if need be.
Which pieces share a sequence depends on their lengths alone, so the program
is solved over the histogram of lengths (at most ``capacity`` numbers, whatever
the number of documents):

* a configuration is a multiset of lengths that fits a sequence; the program
  covers every length as often as it occurs with the fewest configurations;
* multiplicative weights price the lengths: a price falls as its length gets
  covered, so lengths that are hard to place grow dear; the first prices are
  the lengths themselves, the dual of a packing without waste;
* a knapsack dynamic program finds, for every length at once, the dearest
  configuration with that length; those near the dearest of all enter, each
  length's cover growing by at most ``STEP`` a round;
* rounding takes the whole part of each configuration's number, as far as
  pieces are left; the rest is a smaller program, solved in the same way, until
  whole parts place too little; the last pieces go best fit, two at a time.

The n-th piece of a length (counted by task, with the tasks before it added)
takes the n-th place that the configurations hold for its length, found by
binary search in a table of the places, whose size depends on the number of
configurations and not on that of pieces.

Edge cases: a null or empty text is the end id alone; a special token's string
in a text becomes its id, as the library has it; null and repeated
identifiers stay apart as rows; other columns are not read (``keep_ids`` adds
the ids of a piece); an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from popweave.llm.common import stash, table

CAPACITY = 1024
END_ID = 2
#: Growth of a length's cover in a round, exponent of the prices, slack of a configuration, rounds of a program.
STEP = 0.125
RATE = 0.5
SLACK = 0.02
ROUNDS = 40
#: A program that places less than this share of the tokens left is the last one.
LEAST_SHARE = 0.2
#: Characters that are encoded at once, one longer text apart.
TEXT = 1 << 20
#: Numbers of pieces of one length stay below this.
_MOST = 1 << 40

Config = tuple[tuple[int, int], ...]  # (length, copies), longest first


# ------------------------------------------------------- the program over the histogram

def _knapsack(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length, the value and the copies (rows) of the dearest configuration that holds it.

    Copies come in bundles of 1, 2, 4, ... so that any number up to what is
    there can be taken.
    """
    of, size, times = [], [], []
    for k, (length, there) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        most, bundle = min(there, capacity // length), 1
        while most > 0:
            t = min(bundle, most)
            of.append(k)
            size.append(t * length)
            times.append(t)
            most, bundle = most - t, bundle * 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(of), capacity + 1), bool)
    for j, (k, s, t) in enumerate(zip(of, size, times, strict=True)):
        with_it = best[:-s] + prices[k] * t
        better = with_it > best[s:]
        taken[j, s:] = better
        best[s:][better] = with_it[better]
    value = prices + best[capacity - lengths]
    copies = np.eye(len(lengths), dtype=np.int64)
    room, rows = capacity - lengths, np.arange(len(lengths))
    for j in range(len(of) - 1, -1, -1):
        use = taken[j, room]
        copies[rows[use], of[j]] += times[j]
        room = room - use * size[j]
    return value, copies


def _program(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[Config, float]:
    """Configurations and how often each is taken (a real number), by multiplicative weights."""
    weight, cover = np.ones(len(lengths)), np.zeros(len(lengths))
    taken: dict[Config, float] = {}
    for _ in range(ROUNDS):
        value, copies = _knapsack(lengths, counts, lengths * weight, capacity)
        grown = np.zeros(len(lengths))
        for k in np.argsort(cover - lengths / (2 * capacity), kind="stable"):  # the least covered first, then the longest
            if value[k] < (1 - SLACK) * value.max():
                continue
            held = np.flatnonzero(copies[k])
            each = copies[k, held] / counts[held]
            times = ((STEP - grown[held]) / each).min()
            if times <= 1e-12 or (copies[k, held] > counts[held]).any():
                continue
            grown[held] += times * each
            config = tuple((int(lengths[i]), int(copies[k, i])) for i in held[::-1])
            taken[config] = taken.get(config, 0.0) + float(times)
        cover += grown
        weight *= np.exp(-RATE * grown / STEP)
        weight /= weight.max()
        if cover.min() >= 1 or not grown.any():
            break
    scale = max(1.0, float(np.median(cover)))
    return {c: x / scale for c, x in taken.items()}


def _best_fit(left: dict[int, int], capacity: int) -> Iterator[tuple[Config, int]]:
    """Places what is left: the longest piece, then again and again the longer of the two that fill the room best."""
    while left:
        lengths = np.array(sorted(left))
        counts = np.array([left[int(x)] for x in lengths])
        used = np.zeros(len(lengths), np.int64)
        used[-1], room = 1, capacity - int(lengths[-1])
        while True:
            fits = np.flatnonzero((counts > used) & (lengths <= room))
            if not len(fits):
                break
            size = lengths[fits]
            second = np.searchsorted(size, room - size, "right") - 1  # the longest piece beside each
            second -= (second >= 0) & (size[second] == size) & (counts[fits] - used[fits] < 2)
            both = size + np.where(second >= 0, size[second], 0)
            take = fits[np.flatnonzero(both == both.max())[-1]]
            used[take] += 1
            room -= int(lengths[take])
        held = np.flatnonzero(used)
        times = int((counts[held] // used[held]).min())
        for i in held:
            left[int(lengths[i])] -= int(used[i]) * times
            if not left[int(lengths[i])]:
                del left[int(lengths[i])]
        yield tuple((int(lengths[i]), int(used[i])) for i in held[::-1]), times


def configurations(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """Configurations and whole numbers of them that place every piece of the histogram, few of them in all."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    out: list[tuple[Config, int]] = []
    while left:
        lengths = np.array(sorted(left))
        counts = np.array([left[int(x)] for x in lengths])
        before, placed = int((lengths * counts).sum()), 0
        chosen = _program(lengths, counts, capacity)
        # Whole numbers, as far as there are pieces, the fullest and most taken configurations first.
        fill = {c: sum(x * n for x, n in c) for c in chosen}
        for c in sorted(chosen, key=lambda c: (-fill[c], -chosen[c], c)):
            times = min(int(chosen[c]), *[left.get(x, 0) // n for x, n in c])
            if times > 0:
                for x, n in c:
                    left[x] -= n * times
                    if not left[x]:
                        del left[x]
                placed += times * fill[c]
                out.append((c, times))
        if placed < LEAST_SHARE * before:
            break
    return [*out, *_best_fit(left, capacity)]


def places(plan: Sequence[tuple[Config, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first number of its pieces), the sequence of that piece, and the offset there."""
    rows, sequence, used = [], 0, {}
    for config, times in plan:
        offset = 0
        for length, copies in config:
            for _ in range(copies):
                first = used.get(length, 0)
                used[length] = first + times
                rows.append((length * _MOST + first, sequence, offset))
                offset += length
        sequence += times
    keys, sequences, offsets = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    return keys, sequences, offsets


# ------------------------------------------------------------------ Spark side

def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_PIECES = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
           T.StructField("ids_crc32", T.LongType())]
_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
_PLACE = [T.StructField("_task", T.IntegerType()), T.StructField("_nth", T.LongType())]


#: Fixed value: the pattern by which a byte-level pre-tokenizer splits a text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: itself if it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as bytes (little-endian, 32 bits each), as ``tokenizers`` has them.

    For a byte-level model whose merges are ranked by their ids, tiktoken reads
    the same vocabulary and pattern and gives the same ids four times as fast.
    Texts with the string of an added token, or with a run of ``LONG_RUN``
    characters (which tiktoken merges in quadratic time), and all texts of other
    models go to ``tokenizers`` itself.
    """

    LONG_RUN = 1000

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model).encode_batch_fast
        spec = json.loads(model)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        import tiktoken

        before, bpe = spec.get("pre_tokenizer") or {}, spec["model"]
        if (before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
                or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
                or bpe["type"] != "BPE" or any(bpe.get(k) for k in (
                    "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))):
            return None
        letters, vocabulary = _byte_letters(), bpe["vocab"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in bpe["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in self.added}
        if len(ranks) != 256 + len(merged):
            return None
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def _long_run(self, text: str) -> bool:
        """Whether a run of ``LONG_RUN`` characters, all white space or none, may be there: it fills a half window."""
        half = self.LONG_RUN // 2
        return any(len(text[k:k + half].split(None, 1)) < 2 for k in range(0, len(text) - half + 1, half))

    def __call__(self, texts: list[str]) -> list[bytes]:
        slow = [k for k, t in enumerate(texts) if not self.fast or any(a in t for a in self.added) or self._long_run(t)]
        out = dict(zip(slow, (array("I", e.ids).tobytes() for e in self.library(
            [texts[k] for k in slow], add_special_tokens=False)), strict=True)) if slow else {}
        return [out[k] if k in out else self.fast(t, disallowed_special=()).astype("<u4").tobytes() for k, t in enumerate(texts)]


def _piece_task(model: str, capacity: int, end_id: int, keep_ids: bool, names: list[str]):
    """Reads ``(id, text)``; writes pieces, numbered within the task by length."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(model), array("I", [end_id]).tobytes()
        number, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= TEXT):
                    size += len(texts[hi])
                    hi += 1
                row, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
                for k, encoded in enumerate(encode(texts[lo:hi]), lo):
                    whole = encoded + end
                    at, p, n = 0, 0, len(whole) // 4
                    while at < n:
                        to = at + ((n - 1) % capacity + 1 if p == 0 else capacity)
                        row.append(k)
                        piece.append(p)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(whole[4 * at:4 * to]))
                        nth.append(int(seen[to - at]))
                        seen[to - at] += 1
                        if keep_ids:
                            ids.append(np.frombuffer(whole[4 * at:4 * to], "<i4"))
                        at, p = to, p + 1
                columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *[
                    pa.array(x, pa.int64()) for x in (start, length, crc)]]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                columns += [pa.array([number] * len(row), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                lo = hi
    return task


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row a piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    with open(model or default_model(), encoding="utf-8") as f:
        spec = f.read()  # a file of fixed size; goes to the tasks with the function
    extra = [_IDS] if keep_ids else []
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *_PIECES, *extra, *_PLACE])
    pieces = stash(docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(
        _piece_task(spec, capacity, end_id, keep_ids, schema.names), schema), "pieces")
    by_task = stash(pieces.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_there")), "piece-lengths")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_there").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    numbered = by_task.select("_task", "length", F.coalesce(F.sum("_there").over(before), F.lit(0)).alias("_before"))
    keys, sequences, offsets = places(configurations(histogram, capacity))
    out = T.StructType([*schema.fields[:-2], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names, at = out.names, schema.names.index("length")

    def place(batches):
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            nth = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            key = length * _MOST + nth
            k = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequences[k] + key - keys[k], pa.int64()), pa.array(offsets[k], pa.int64())],
                names=names)

    placed = pieces.join(numbered, ["_task", "length"]).select(
        *[f"`{c}`" for c in schema.names[:-2]], (F.col("_nth") + F.col("_before")).alias("_nth"))
    return placed.mapInArrow(place, out)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, from pieces with their ids."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op13_packing": op13_packing}
ORACLES: dict[str, str] = {}
