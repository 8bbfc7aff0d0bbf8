"""Spelling variant grouping by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced character lies between
them.  Every word generates its edits (deletions, and replacements by a later
letter of the alphabet in use, so that each pair is generated once) and probes
them against Bloom filters of the vocabulary: one filter for each word length,
a replacement probing that of its own length, a deletion that of the next
shorter.  A filter consists of blocks of 512 bits, a word's ``HASHES`` bits all
lie in one block.  Hashes are polynomials over the letters, so an edit's hash
comes from its word's by one addition.  Only probes that all bits confirm become
strings and are shuffled to the exact join with the vocabulary, which removes
the false positives: nothing else decides whether two words are near.

Filters are built by range of blocks, each in its own task, and are broadcast
in rounds of at most ``ROUND_BYTES``, whatever the size of the vocabulary; a
round generates only edits of the lengths it has blocks of.

A word's form is its most frequent near word, where that is ``RATIO`` times as
frequent; forms are followed to the last by pointer jumping (counts grow
tenfold at each step, so paths are short).

Edge cases: a null text has no words, a null identifier is the empty string in
the damage key; repeated rows count again; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.llm.common import stash, table
from popweave.llm.textarrays import mix

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: Damage: one in so many occurrences loses a character.
ONE_IN = 31

BLOCK_BITS = 512
BITS_A_WORD = 16
HASHES = 6
#: Blocks that one task builds, and bytes of filters that are broadcast at once.
RANGE = 2048
ROUND_BYTES = 32 << 20
#: Probes that a task tests at once.
PROBES = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


# ------------------------------------------------------------------ vocabulary

def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``: a row for each run of letters that can yield a word, lower-cased and damaged."""
    run = F.translate("_run", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_id"),
        # A run of fewer letters is none of these, and a longer one is matched whole.
        F.explode(F.regexp_extract_all(f"`{text_col}`", F.lit(rf"([A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}})"), F.lit(1)))
        .alias("_run")).select("_id", run.alias("_run"))
    h, length = F.crc32(F.concat_ws(":", "_id", "_run")), F.char_length("_run")
    at = (h % length).cast("int")
    cut = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, length))
    return runs.select(F.when(h % ONE_IN == 0, cut).otherwise(F.col("_run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: words that are long and frequent enough."""
    return (words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


# ------------------------------------------------------------------ filters

def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, np.uint64(base), np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths and the positions of their words."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(part):
            yield int(lengths[part[0]]), part


class Layout:
    """Where the blocks of each length's filter lie among all blocks."""

    def __init__(self, counts: dict[int, int]):
        lengths = sorted(counts)
        self.blocks = {k: -(-counts[k] * BITS_A_WORD // BLOCK_BITS) for k in lengths}
        ends = list(accumulate(self.blocks.values()))
        self.first = {k: end - self.blocks[k] for k, end in zip(lengths, ends, strict=True)}
        self.total = ends[-1] if ends else 0

    def place(self, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each key, and the bits in it (nine for each hash)."""
        h = mix(keys)
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks[length])) >> np.uint64(32)
        return block.astype(np.int64) + self.first[length], mix(h ^ _SECOND)


def _word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for length, part in _by_length(words):
        out[part] = (_codes([words[i] for i in part]) * _powers(length, _BASE)).sum(axis=1, dtype=np.uint64)
    return out


def _placed(layout: Layout) -> Callable:
    def task(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            block, bits = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64)
            hashes = _word_hashes(words)
            for length, part in _by_length(words):
                block[part], bits[part] = layout.place(hashes[part], length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block // RANGE), pa.array(block % RANGE), pa.array(bits.view(np.int64))],
                names=["_range", "_block", "_bits"])
    return task


def _build(f: pd.DataFrame) -> pd.DataFrame:
    """The bits of one range of blocks."""
    filled = np.zeros(RANGE * BLOCK_BITS // 64, np.uint64)
    block, bits = f["_block"].to_numpy(np.int64), f["_bits"].to_numpy(np.int64).view(np.uint64)
    for k in range(HASHES):
        bit = (bits >> np.uint64(9 * k)) & np.uint64(511)
        np.bitwise_or.at(filled, block * 8 + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return pd.DataFrame({"_range": f["_range"].iloc[:1].tolist(), "_filter": [filled.tobytes()]})


class Filters:
    """The filters' ranges of one round."""

    def __init__(self, layout: Layout, first: int, filled: np.ndarray):
        self.layout, self.first, self.filled = layout, first, filled

    def cover(self, length: int) -> bool:
        """Whether some blocks of this length are here."""
        first = self.layout.first.get(length, 0) - self.first
        return length in self.layout.blocks and first < len(self.filled) // 8 and first + self.layout.blocks[length] > 0

    def has(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Positions of the keys that may be words."""
        block, bits = self.layout.place(keys, length)
        block = (block - self.first) * 8
        at = np.flatnonzero((block >= 0) & (block < len(self.filled)))
        for k in range(HASHES):
            bit = (bits[at] >> np.uint64(9 * k)) & np.uint64(511)
            there = self.filled[block[at] + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))
            at = at[(there & np.uint64(1)).astype(bool)]
        return at


# ------------------------------------------------------------------ probes

def _edits(words: list[str], alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[int, str]]:
    """Edits of words of one length that the filters confirm, with the number of the word."""
    codes, length = _codes(words), len(words[0])
    power = _powers(length, _BASE)
    terms = codes * power
    prefix = np.concatenate((np.zeros((len(words), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
    whole = prefix[:, -1]
    # The letters after a deleted one move up by one place.
    shorter = prefix[:, :-1] + (whole[:, None] - prefix[:, 1:]) * np.uint64(_BACK)
    fresh = np.ones(codes.shape, bool)  # of equal neighbours the first one goes
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(fresh if filters.cover(length - 1) else fresh[:0])
    for j in filters.has(shorter[row, place], length - 1) if len(row) else ():
        w, i = words[row[j]], int(place[j])
        yield int(row[j]), w[:i] + w[i + 1:]
    for i in range(length if filters.cover(length) else 0):
        row, letter = np.nonzero(alphabet[None, :] > codes[:, i, None])
        keys = whole[row] + (alphabet[letter] - codes[row, i]) * power[i]
        for j in filters.has(keys, length):
            w = words[row[j]]
            yield int(row[j]), w[:i] + chr(int(alphabet[letter[j]])) + w[i + 1:]


def _probe_task(shared, layout: Layout, first: int, letters: list[int]) -> Callable:
    """Reads ``(word, n)``; writes ``(word, n, edit)`` for confirmed edits."""
    def task(batches):
        filters = Filters(layout, first, np.frombuffer(shared.value, np.uint64))
        alphabet = np.array(letters, np.uint64)
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for length, part in _by_length(words):
                # At most PROBES probes of one place, and deletions, at once.
                step = max(1, PROBES // max(len(letters), length))
                for lo in range(0, len(part), step):
                    some = part[lo:lo + step]
                    got = list(_edits([words[i] for i in some], alphabet, filters))
                    if got:
                        at = [int(some[k]) for k, _ in got]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([words[i] for i in at]), pa.array([counts[i] for i in at], pa.int64()),
                             pa.array([e for _, e in got])], names=["word", "n", "_edit"])
    return task


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every ordered pair of near words of ``word, n`` (distinct words)."""
    spark = words.sparkSession
    counts = {r["k"]: r["c"] for r in words.groupBy(F.char_length("word").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    letters = sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"))
                     .where("c <> ''").distinct().collect())  # an alphabet, not a vocabulary
    layout = Layout(counts)
    ranges = stash(words.select("word").mapInArrow(_placed(layout), "_range long, _block long, _bits long")
                   .groupBy("_range").applyInPandas(_build, "_range long, _filter binary"), "filter-ranges")
    found, each = [], max(1, ROUND_BYTES // (RANGE * BLOCK_BITS // 8))
    for first in range(0, -(-layout.total // RANGE), each):
        size = min(each * RANGE, layout.total - first * RANGE)
        filled = bytearray(-(-size // RANGE) * RANGE * BLOCK_BITS // 8)
        step = RANGE * BLOCK_BITS // 8
        for r in ranges.where(F.col("_range").between(first, first + each - 1)).collect():  # ROUND_BYTES at most
            filled[(r["_range"] - first) * step:(r["_range"] - first + 1) * step] = r["_filter"]
        shared = spark.sparkContext.broadcast(bytes(filled))
        found.append(stash(words.select("word", "n").mapInArrow(
            _probe_task(shared, layout, first * RANGE, letters), "word string, n long, _edit string"), "confirmed-edits"))
        shared.unpersist()
    if not found:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    edits = found[0]
    for more in found[1:]:
        edits = edits.unionByName(more)
    vocabulary = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = edits.join(vocabulary, F.col("_edit") == F.col("other")).select("word", "n", "other", "other_n")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))


def follow(forms: DataFrame) -> DataFrame:
    """``word, root``: forms (``word, form``) followed to the last, in rounds that double the steps."""
    paths = stash(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = stash(paths.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                                 F.col("_next").isNotNull().alias("_on")), "forms")
        if not longer.where("_on").limit(1).count():
            return longer.select("word", "root")
        paths = longer.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a vocabulary ``word, n`` of distinct words."""
    near = near_pairs(words).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("_best"))
    enough = -F.col("_best.less") >= ratio * F.col("n")
    known = stash(near.select("word", "n_near", F.when(enough, F.col("_best.other")).alias("form"),
                              F.when(enough, -F.col("_best.less")).alias("form_n")), "near-words")
    roots = follow(known.where("form is not null"))
    # A root is joined to the words that have one only.
    known = known.join(roots, "word", "left")
    return words.join(known, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(stash(vocabulary(occurrences(table(spark, sf_dir, "documents"))), "vocabulary"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES: dict[str, str] = {}
