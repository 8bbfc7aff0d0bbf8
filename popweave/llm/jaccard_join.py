"""N-gram Jaccard join by a token-group matrix.

Documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
word shingles.  The join is exact and returns classes, not pairs:

1. *Sets.*  Shingles are 64-bit hashes.  A bounded list of frequent shingles
   (``HOT``, broadcast) only settles the order in which shingles are
   looked at: rare ones first.  In that order two linked sets share a token
   of their prefixes (the first ``n - ceil(t n) + 1``), so only prefixes are
   shuffled, and of those only tokens that several documents have go on.
   Documents with identical sets are one class and are handled once.
2. *Families.*  Each class is paired with a few hubs among those that share a
   token, the first in ``HUBS`` random orders; pairs that share enough of their
   prefixes are compared in full.  This links the bulk of a family of near
   copies with a number of pairs linear in its size.  Tokens whose classes are
   all linked are done; ``TURNS`` says how often, each turn with other orders.
3. *Matrix.*  Classes are partitioned into groups of similar ones: those whose
   most shared token is the same and whose sizes are in one band (a large
   linked family apart), so that similar documents meet in few groups, however
   many they are.  The matrix holds the union of each group's prefix tokens.  A
   class looks only at the bands that hold sizes of sets it can link with.  Its
   overlap with a union bounds its overlap with every member; only groups that
   reach the needed overlap are opened, in blocks, and a pair inside is
   considered only if the two are not linked yet, their own prefix overlap
   reaches what a link needs and the parity sketches of their sets (a few bits a shingle) differ in no more bits
   than linked sets have shingles apart: first, in ``NEAR_BLOCKS`` blocks of
   each group, a spanning forest of the block's components by those pairs, the
   nearest first, is compared in full; then, with the new components, in groups
   that had such a pair or have more blocks, the whole sets of all classes with
   such a pair are brought to its block, which compares them there and returns a
   forest of the links.
   These bounds are necessary conditions, so no link between classes
   that are not connected already is lost.
4. Components of the links.

A hot token or a family that holds a third of all documents is pre-aggregated,
split by adaptive skew joins or dealt over blocks; no step emits the pairs of a
group, and only the bounded list of step 1 goes through the driver.

Edge cases: null and empty texts have no shingles and link with nothing; a
text of fewer words than a shingle is one shingle; the component of a
document is the smallest identifier reachable, null identifiers aside (null if
no row that is reached has one); every row is a document of its own, whatever
its identifier; an empty table gives an empty result; other
columns take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from popweave.llm.common import discard, stash, table, unpack, whole_row
from popweave.llm.components import components, partial_components
from popweave.llm.textarrays import LOWER, batches_of, mix, word_hashes

WORDS = 4
PERCENT = 85
#: Shingles that the frequency order knows, and the occurrences from which on one is frequent.
HOT = 1 << 16
HOT_FROM = 50
#: Members, and queries, of a group that one task compares.
BLOCK = 256
#: Shared tokens that are multiplied at once.
COLUMNS = 8192
#: Queries of one call, which can hold the blocks of several small groups.
CALL_ROWS = 2_000
#: Hubs of a token in a turn, and turns.
HUBS, TURNS = 4, 1
#: Blocks of a group that a class meets at first.
NEAR_BLOCKS = 4
#: Bytes of sketches that are compared at once.
SKETCH_BYTES = 1 << 24
#: Classes of a linked family from which on it is a group of its own.
FAMILY = 64
#: Identifiers that may be broadcast to select documents (8 bytes each).
BROADCAST_IDS = 1_000_000
_C = np.uint64(0x9E3779B97F4A7C15)


def _chain(words: list[np.ndarray]) -> np.ndarray:
    h = mix(words[0] + np.uint64(len(words)))
    for w in words[1:]:
        h = mix(h * _C ^ w)
    return h


def shingles(texts: list[str | None], k: int):
    """For each text its shingle hashes in text order, repeats included."""
    for lo, hi, raw, begin in batches_of(texts):
        h, starts, _ = word_hashes(LOWER[raw])
        at = np.searchsorted(starts, np.append(begin, len(raw)))
        full = _chain([h[i:len(h) - k + 1 + i] for i in range(k)]) if len(h) >= k else h[:0]
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            yield full[a:b - k + 1] if b - a >= k else _chain([h[j:j + 1] for j in range(a, b)]) if b > a else h[:0]


def token_set(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def _digest(s: np.ndarray) -> str:
    """128 bits of a set."""
    return f"{len(s):x}.{int(s.sum(dtype=np.uint64)):016x}{int(mix(s ^ _C).sum(dtype=np.uint64)):016x}"


def frequent(texts: DataFrame, k: int, hot: int = HOT, least: int = HOT_FROM) -> tuple[np.ndarray, np.ndarray]:
    """At most ``hot`` shingles in order of their hash, and the level of each (1 to 7, by occurrences)."""

    def count(batches):
        def flush(parts):
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        parts, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for s in shingles(batch.slice(lo, 500).column(0).to_pylist(), k):
                    parts.append(s)
                    size += len(s)
                if size > 2_000_000:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    found = (texts.select("_text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(hot).collect())
    h = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    level = np.clip(np.log2(np.array([r["n"] for r in found], float) / least) / 2 + 1, 1, 7).astype(np.uint64)
    order = np.argsort(h)
    return h[order], level[order]


def ordered_codes(s: np.ndarray, hot: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Positive 63-bit codes of a set, whose order is: infrequent first, then by hash."""
    code = s >> np.uint64(4)
    if len(hot) and len(s):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        code = code | np.where(hot[at] == s, level[at], np.uint64(0)) << np.uint64(60)
    return np.sort(code).view(np.int64)


def parities(s: np.ndarray) -> bytes:
    """Of each bucket of hashes whether a set has an odd number of them; at least two buckets a member.

    A member more or less changes one bit, so the bits in which two sketches
    differ are no more than the members that one of their sets has alone.
    """
    width = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sketch(rows: DataFrame, k: int, percent: int, hot: np.ndarray, level: np.ndarray) -> DataFrame:
    """``_id, _text_hash, _n, _key, _bits, _prefix``: size, digest, parities and prefix of each document's set."""

    def sketches(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sizes, keys, bits, prefixes = [], [], [], []
                for s in map(token_set, shingles(part.column(2).to_pylist(), k)):
                    n = len(s)
                    sizes.append(n)
                    keys.append(_digest(s) if n else None)
                    bits.append(parities(s) if n else None)
                    prefixes.append(ordered_codes(s, hot, level)[: n + percent * -n // 100 + 1 if n else 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()),
                     pa.array(bits, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()),
                                              pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))],
                    names=["_id", "_text_hash", "_n", "_key", "_bits", "_prefix"])

    schema = T.StructType([rows.schema["_id"], rows.schema["_text_hash"], T.StructField("_n", T.LongType()), T.StructField("_key", T.StringType()),
                           T.StructField("_bits", T.BinaryType()), T.StructField("_prefix", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(sketches, schema)


def _located(rows: DataFrame, at: DataFrame, once: bool) -> DataFrame:
    """The rows at the given identifiers and hashes of texts, each of these but once."""
    at = at.select(F.col("_id").alias("_at_id"), F.col("_text_hash").alias("_at_hash")).distinct()
    side = F.broadcast(at) if at.count() <= BROADCAST_IDS else at
    found = rows.join(side, F.col("_id").eqNullSafe(F.col("_at_id")) & (F.col("_text_hash") == F.col("_at_hash")), "left_semi")
    return found if once else found.dropDuplicates(["_id", "_text_hash"])


def _full_sets(rows: DataFrame, once: bool, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``_key, _set``: digest and whole set of the classes that ``wanted`` numbers, written."""
    at = stash(classes.join(wanted.distinct(), "_class").select("_id", "_text_hash"), "compared-rows")

    def sets(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                got = [token_set(s) for s in shingles(batch.slice(lo, 500).column(0).to_pylist(), k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in got], pa.string()), pa.array([s.tobytes() for s in got], pa.binary())],
                    names=["_key", "_set"])

    full = stash(_located(rows, at, once).select("_text").mapInArrow(sets, "_key string, _set binary"), "token-sets")
    discard(at)
    return full


def _verified(rows: DataFrame, once: bool, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (``_a``, ``_b``: numbers of classes) whose full sets link, written."""
    wanted = pairs.select(F.col("_a").alias("_class")).unionByName(pairs.select(F.col("_b").alias("_class")))
    full = _full_sets(rows, once, classes, wanted, k)

    def link(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["_a", "_b"]).filter(pa.array(keep, pa.bool_()))

    named = lambda side: classes.select(F.col("_class").alias(side), F.col("_key").alias(f"_key{side}"))
    keyed = pairs.join(named("_a"), "_a").join(named("_b"), "_b")
    left = full.select(F.col("_key").alias("_key_a"), F.col("_set").alias("_x"))
    right = full.select(F.col("_key").alias("_key_b"), F.col("_set").alias("_y"))
    links = stash(keyed.join(left, "_key_a").join(right, "_key_b").select("_a", "_b", "_x", "_y")
                  .mapInArrow(link, "_a long, _b long"), "links")
    discard(full, pairs)
    return links


def _needed(n: Column, other: Column, percent: int) -> Column:
    """Shared prefix tokens that a link needs if the prefix of the set of size ``n`` ends first."""
    both = F.ceil((n + other) * percent / F.lit(100.0 + percent) - 1e-9)
    return both - F.ceil(n * percent / F.lit(100.0) - 1e-9) + 1


def _band(n: Column, percent: int) -> Column:
    """Number of a range of sizes; below 100 percent any two in it are near enough to link."""
    return F.floor(F.log(n) / F.lit(math.log(100 / percent) if percent < 100 else 1.0))


def _apart(members, queries, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of a member and a query, a number of shingles that at least one of their sets has alone."""
    out = np.zeros(len(i), np.int64)
    wide, asked = (np.array([len(b) for b in x["_bits"]]) for x in (members, queries))
    both = np.minimum(wide[i], asked[j])
    for width in np.unique(both).tolist():
        here = np.nonzero(both == width)[0]
        sides = []
        for x, at in ((members, i[here]), (queries, j[here])):
            used, place = np.unique(at, return_inverse=True)
            # A wider sketch folds to a narrower one.
            folded = [np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0)
                      for b in x["_bits"].iloc[used]]
            sides.append((np.stack(folded), place))
        (a, at), (b, of) = sides
        step = max(1, SKETCH_BYTES // width)
        for lo in range(0, len(here), step):
            out[here[lo:lo + step]] = np.bitwise_count(a[at[lo:lo + step]] ^ b[of[lo:lo + step]]).sum(axis=1, dtype=np.int64)
    return out


def _forest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the pairs of components ``a``, ``b`` that make a spanning forest, the smallest ``far`` first."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    order = np.argsort(far, kind="stable")
    pair = np.minimum(x, y) * len(names) + np.maximum(x, y)
    order = order[np.sort(np.unique(pair[order], return_index=True)[1])]
    root, keep = list(range(len(names))), []

    def top(v):
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for at, u, v in zip(order.tolist(), x[order].tolist(), y[order].tolist(), strict=True):
        u, v = top(u), top(v)
        if u != v:
            root[u] = v
            keep.append(at)
    return np.array(keep, np.int64)


def _common(*sides) -> np.ndarray:
    """How many codes each array of the first side shares with each of the second."""
    shared = np.intersect1d(*[np.concatenate(x) for x in sides])
    held = []
    for x in sides if len(shared) else ():
        at = [np.searchsorted(shared, c) for c in x]
        sizes = [0] * len(x)
        for i, c in enumerate(x):
            at[i][at[i] == len(shared)] = 0
            at[i] = at[i][shared[at[i]] == c]
            sizes[i] = len(at[i])
        held.append((np.repeat(np.arange(len(x)), sizes), np.concatenate(at), len(x)))
    common = np.zeros([len(x) for x in sides], np.float32)
    for lo in range(0, len(shared), COLUMNS):
        grids = []
        for row, at, size in held:
            here = (at >= lo) & (at < lo + COLUMNS)
            grid = np.zeros((size, min(COLUMNS, len(shared) - lo)), np.float32)
            grid[row[here], at[here] - lo] = 1
            grids.append(grid)
        common += grids[0] @ grids[1].T
    return common


def _compared(members, queries, percent: int, forest: bool):
    """Places of a member and a query that may link, by their shared prefix tokens, sizes, sketches and families.

    ``forest``: only pairs that would connect the families which all of them connect.
    """
    common = _common(*[list(x["_codes"]) for x in (members, queries)])
    n, m = members["_n"].to_numpy(float)[:, None], queries["_n"].to_numpy(float)[None, :]
    both = np.ceil((n + m) * percent / (100 + percent) - 1e-9)
    need = lambda size: both - np.ceil(size * percent / 100 - 1e-9) + 1
    first = members["_last"].to_numpy()[:, None] <= queries["_last"].to_numpy()[None, :]
    ok = common >= np.maximum(np.where(first, need(n), need(m)), 1)
    ok &= (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    ok &= members["_comp"].to_numpy()[:, None] != queries["_comp"].to_numpy()[None, :]
    i, j = np.nonzero(ok)
    may = (n + m - 2 * both)[i, j]  # shingles that one of two linked sets has alone
    apart = _apart(members, queries, i, j)
    near = apart <= may
    i, j, apart, may = i[near], j[near], apart[near], may[near]
    if forest:
        of = _forest(members["_comp"].to_numpy()[i], queries["_comp"].to_numpy()[j], apart / np.maximum(may, 1))
        i, j = i[of], j[of]
    return i, j


def _opened(percent: int, forest: bool):
    """Compares blocks of queries with blocks of members; a call has the blocks of several groups.

    ``forest``: gives pairs of classes with their group; else the classes of each block that have any.
    """

    def compare(members, queries):
        import pandas as pd

        where = ["_group", "_mb", "_qb"]
        asked = queries.groupby(where).indices
        found = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("_group", "_a", "_b")}) if forest else
                 pd.DataFrame({c: np.zeros(0, np.int64) for c in (*where, "_class")} | {"_asks": np.zeros(0, bool)})]
        for at, rows in members.groupby(where).indices.items():
            if at in asked:
                ms, qs = members.iloc[rows], queries.iloc[asked[at]]
                i, j = _compared(ms, qs, percent, forest)
                if forest:
                    a, b = ms["_class"].to_numpy()[i], qs["_class"].to_numpy()[j]
                    found.append(pd.DataFrame({"_group": at[0], "_a": np.minimum(a, b), "_b": np.maximum(a, b)}))
                else:
                    i, j = np.unique(i), np.unique(j)
                    some = np.concatenate([ms["_class"].to_numpy()[i], qs["_class"].to_numpy()[j]])
                    found.append(pd.DataFrame(dict(zip(where, at, strict=True)) | {
                        "_class": some, "_asks": np.arange(len(some)) >= len(i)}))
        return pd.concat(found, ignore_index=True)

    return compare


def _block_links(rows: DataFrame, once: bool, classes: DataFrame, known: DataFrame, met: DataFrame, k: int,
                 percent: int) -> DataFrame:
    """Of each block the links that connect its components, by whole sets of its classes ``met``, written."""

    def link(block):
        import pandas as pd

        asks = block["_asks"].to_numpy(bool)
        members, queries = block[~asks], block[asks]
        sets = [[np.frombuffer(b, np.uint64) for b in x["_set"]] for x in (members, queries)]
        if not (sets[0] and sets[1]):
            return pd.DataFrame({"_a": np.zeros(0, np.int64), "_b": np.zeros(0, np.int64)})
        n, m = (np.array([len(c) for c in x], float) for x in sets)
        both = _common(*sets).astype(float)
        of, to = members["_comp"].to_numpy(), queries["_comp"].to_numpy()
        i, j = np.nonzero((100 * both >= percent * (n[:, None] + m[None, :] - both)) & (of[:, None] != to[None, :]))
        some = _forest(of[i], to[j], -both[i, j])
        a, b = members["_class"].to_numpy()[i[some]], queries["_class"].to_numpy()[j[some]]
        return pd.DataFrame({"_a": np.minimum(a, b), "_b": np.maximum(a, b)})

    full = _full_sets(rows, once, classes, met.select("_class"), k)
    links = stash(met.join(known.select("_class", "_comp"), "_class").join(classes.select("_class", "_key"), "_class")
                  .join(full, "_key").select("_group", "_mb", "_qb", "_class", "_asks", "_comp", "_set")
                  .groupBy("_group", "_mb", "_qb").applyInPandas(link, "_a long, _b long").distinct(), "links")
    discard(full, met)
    return links


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_shingles, component_id``."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_text_hash"), text.alias("_text"))
    sketch, linked, classes = _classes(rows, words, percent)
    named = classes.join(linked, "_class", "left").withColumn("_comp", F.coalesce("_comp", "_class"))
    smallest = named.groupBy("_comp").agg(F.min("_id").alias("_component"))
    of_class = named.join(smallest, "_comp").select("_key", "_component")
    return sketch.select("_id", "_n", "_key").join(of_class, "_key", "left").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
        F.when(F.col("_key").isNull(), F.col("_id")).otherwise(F.col("_component")).alias("component_id"))


def _star_pairs(placed: DataFrame, sizes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of a class and a hub of one of its tokens that are not linked yet and share enough of their prefixes."""
    # A hub brings its family, whose members it does not meet again.
    # Half of the hubs are the classes with the most links so far: near copies of a text gather around it.
    links = lambda h: -F.col("_links") if turn and h < HUBS // 2 else F.lit(0)
    first = [F.min(F.struct(links(h).alias("links"), F.xxhash64("_class", F.lit(turn * HUBS + h)).alias("at"),
                            F.col("_class").alias("a"), F.col("_comp").alias("of"))).alias(f"_h{h}") for h in range(HUBS)]
    hubs = placed.groupBy("_code").agg(*first, F.min("_comp").alias("_from"), F.max("_comp").alias("_to")).where("_from <> _to")
    found = F.array(*[F.struct(F.col(f"_h{h}.a"), F.col(f"_h{h}.of")) for h in range(HUBS)])
    side = lambda c: sizes.select(F.col("_class").alias(f"_{c}"), F.col("_n").alias(f"_n{c}"), F.col("_comp").alias(f"_c{c}"))
    return (
        placed.join(hubs.select("_code", F.array_distinct(found).alias("_hubs")), "_code")
        .select(F.col("_class").alias("_b"), "_comp", F.explode("_hubs").alias("_h")).where("_h.of <> _comp")
        .select(F.col("_h.a").alias("_a"), "_b")
        .groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_common"))
        .join(side("a"), "_a").join(side("b"), "_b").where("_ca <> _cb")
        .where(100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb"))
        .where(F.col("_common") * 300 >= (100 - percent) * F.least("_na", "_nb"))
        .select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    )


def _classes(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each row its class (``_key``), of each linked class its component, and the classes."""
    hot, level = frequent(rows, words)
    sketched = stash(_sketch(rows, words, percent, hot, level), "shingle-sketches")
    sketch = stash(sketched.drop("_prefix", "_bits"), "shingle-digests")
    where = F.min(F.struct(F.col("_id").isNull(), "_id", "_text_hash"))  # a row that has this set
    known = stash(
        sketched.where("_key is not null").groupBy("_key").agg(
            where.alias("_at"), F.first("_n").alias("_n"), F.first("_bits").alias("_bits"),
            F.first("_prefix").alias("_prefix"))
        .select(F.monotonically_increasing_id().alias("_class"), "_key", "_at._id", "_at._text_hash", "_n", "_bits",
                F.element_at("_prefix", -1).alias("_last"), "_prefix"), "shingle-prefixes")  # written, so the numbers stay
    discard(sketched)
    classes = stash(known.drop("_prefix"), "shingle-classes")
    once = sketch.groupBy("_id", "_text_hash").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").isEmpty()

    # Tokens of prefixes that several classes have.
    posted = known.select("_class", F.explode("_prefix").alias("_code"))
    several = posted.groupBy("_code").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1").select("_code")
    entries = stash(posted.join(several, "_code"), "token-classes")
    discard(known)

    # Families of near copies: each class meets, for every token, the first classes in a few orders.
    placed = entries.withColumn("_comp", F.col("_class"))
    sizes = classes.select("_class", "_n", F.col("_class").alias("_comp"))
    near = families = None
    for turn in range(TURNS):
        found = _verified(rows, once, classes, stash(_star_pairs(placed, sizes, turn, percent), "star-pairs"), words, percent)
        near = found if near is None else near.unionByName(found)
        if turn:  # what the turns before linked stands as one link each
            near = near.unionByName(families.select(F.col("_comp").alias("_a"), F.col("_class").alias("_b")))
        if turn == TURNS - 1 or found.isEmpty():
            break
        ends = near.select(F.explode(F.array("_a", "_b")).alias("_class")).groupBy("_class").agg(F.count(F.lit(1)).alias("_links"))
        families = stash(partial_components(near, "_a", "_b").toDF("_class", "_comp").join(ends, "_class", "full_outer").select(
            "_class", F.coalesce("_comp", "_class").alias("_comp"), "_links"), "families")
        placed = entries.join(families, "_class", "left").select(
            "_code", "_class", F.coalesce("_comp", "_class").alias("_comp"), F.coalesce("_links", F.lit(0)).alias("_links"))
        sizes = classes.select("_class", "_n").join(families, "_class", "left").select(
            "_class", "_n", F.coalesce("_comp", "_class").alias("_comp"))
    # Whole components before the matrix: classes that are connected already are never compared again.
    families = stash(components(near, "_a", "_b").toDF("_class", "_comp"), "families")
    placed = stash(entries.join(families, "_class", "left").select(
        "_code", "_class", F.coalesce("_comp", "_class").alias("_comp")), "token-families")
    discard(entries)
    sizes = placed.select("_class", "_comp").distinct().groupBy("_comp").agg(F.count(F.lit(1)).alias("_members"))

    # What is left: tokens of classes that are not all linked.
    left = (placed.groupBy("_code").agg(F.count(F.lit(1)).alias("_df"), F.min("_comp").alias("_from"), F.max("_comp").alias("_to"))
            .where("_from <> _to").select("_code", "_df"))
    known = stash(
        placed.join(left, "_code")
        .groupBy("_class", "_comp").agg(F.collect_list("_code").alias("_codes"),  # a prefix at most
                                        F.max(F.struct("_df", "_code"))["_code"].alias("_most_shared"))
        .join(classes.select("_class", "_n", "_last", "_bits"), "_class").join(sizes, "_comp", "left")
        .select("_class", "_codes", "_n", "_last", "_bits", "_comp",
                F.concat_ws("/", "_most_shared", _band(F.col("_n"), percent),
                            F.when(F.col("_members") >= FAMILY, F.col("_comp"))).alias("_name")),
        "grouped-classes")
    groups = stash(known.groupBy("_name").agg(
        F.count(F.lit(1)).alias("_size"), F.min("_n").alias("_least"), F.max("_n").alias("_most"),
        F.min("_comp").alias("_comp_a"), F.max("_comp").alias("_comp_b"))
        .withColumn("_group", F.monotonically_increasing_id()), "groups")
    named = known
    known = stash(known.join(groups.select("_name", "_group", "_size"), "_name").drop("_name"), "numbered-classes")
    discard(named)

    # The matrix, and the overlap of each class with each group's union.
    n = F.col("_n")
    fewest, largest = F.ceil(n * percent / F.lit(100.0) - 1e-9), F.floor(n * 100 / F.lit(float(percent)) + 1e-9)  # of a linked set
    bands = F.sequence(_band(fewest, percent), _band(largest, percent))
    asking = (known.select("_class", "_n", "_comp", F.col("_group").alias("_own"), F.col("_size").alias("_own_size"), "_codes",
                           F.explode(bands).alias("_band"))
              .withColumn("_code", F.explode("_codes")).drop("_codes"))
    matrix = (known.select("_group", F.explode("_codes").alias("_code")).distinct()
              .join(groups.drop("_name").withColumn("_band", _band(F.col("_least"), percent)), "_group"))
    smaller = (F.col("_own_size") < F.col("_size")) | (
        (F.col("_own_size") == F.col("_size")) & (F.col("_own") <= F.col("_group")))
    fits = (F.col("_n") * percent <= 100 * F.col("_most")) & (100 * F.col("_n") >= percent * F.col("_least"))
    linked = (F.col("_comp_a") == F.col("_comp_b")) & (F.col("_comp_a") == F.col("_comp"))
    overlap = (
        asking.join(matrix, ["_code", "_band"]).where(smaller & fits & ~linked)
        .groupBy("_class", "_group").agg(F.collect_list("_code").alias("_codes"), F.first("_n").alias("_n"),
                                         F.first("_least").alias("_least"), F.first("_most").alias("_most"),
                                         F.first("_size").alias("_size"))
    )
    low, high = F.greatest(F.col("_least"), fewest), F.least(F.col("_most"), largest)
    # One less in the second case: its two roundings need not fall together over the sizes between.
    bound = F.least(_needed(n, low, percent), _needed(high, n, percent) - 1, _needed(n, n, percent))
    opened = stash(overlap.where(F.size("_codes") >= F.greatest(bound, F.lit(1)))
                   .select("_class", "_group", "_size", "_codes"), "opened-groups")

    # First as few pairs as may connect what meets in a block, which brings stragglers to their families;
    # then whatever may link and is not connected yet.
    found = stash(_in_groups(known, opened, percent, True), "near-pairs")
    far = _verified(rows, once, classes, found.select("_a", "_b").distinct(), words, percent)
    families = stash(components(near.unionByName(far), "_a", "_b").toDF("_class", "_comp"), "families")
    # A group that met in all its blocks and had no pair has none now.
    more = groups.where(F.col("_size") > NEAR_BLOCKS * BLOCK).select("_group").unionByName(found.select("_group")).distinct()
    again = opened.join(more, "_group", "left_semi")
    wanted = known.join(more, "_group", "left_semi").select("_class").unionByName(again.select("_class")).distinct()
    moved = stash(known.drop("_comp").join(wanted, "_class").join(families, "_class", "left")
                  .withColumn("_comp", F.coalesce("_comp", "_class")), "moved-classes")
    range_ = moved.groupBy("_group").agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high"))
    still = stash(again.join(moved.select("_class", "_comp"), "_class").join(range_, "_group")
                  .where("_low <> _high or _low <> _comp").select(*opened.columns), "open-groups")
    discard(placed, known, opened, found)
    rest = _block_links(rows, once, classes, moved, stash(_in_groups(moved, still, percent, False), "met-classes"), words, percent)
    discard(moved, still)
    named = families.select(F.col("_comp").alias("_a"), F.col("_class").alias("_b"))
    linked = stash(components(named.unionByName(rest), "_a", "_b").toDF("_class", "_comp"), "class-components")
    return sketch, linked, classes


def _in_groups(known: DataFrame, opened: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Opens groups in blocks, several small ones in a call: pairs of classes, or classes of a block, that may link.

    ``forest``: in a few blocks of each group, a forest of such pairs.
    """
    ms = F.ceil(F.col("_size") / BLOCK).cast("int")
    meets = F.least(ms, F.lit(NEAR_BLOCKS)) if forest else ms  # blocks of members that a query meets
    parts = opened.groupBy("_group", "_size").agg(F.count(F.lit(1)).alias("_asked")).select(
        "_group", F.ceil(F.col("_asked") * meets / (ms * BLOCK)).cast("int").alias("_qs"))
    block = lambda of: F.pmod(F.xxhash64("_class"), of).cast("int")
    start = F.pmod(F.xxhash64("_class", F.lit(1)), ms).cast("int")
    columns = ["_class", "_codes", "_n", "_last", "_bits", "_comp"]
    calls = F.lit(max(1, opened.count() // CALL_ROWS))
    dealt = lambda df: df.withColumn("_call", F.pmod(F.xxhash64("_group", "_mb", "_qb"), calls)).toDF(
        "_group", "_mb", "_qb", *columns, "_call")
    members = dealt(known.join(parts, "_group").select(
        "_group", block(ms).alias("_mb"), F.explode(F.sequence(F.lit(0), F.col("_qs") - 1)).alias("_qb"), *columns))
    # A query brings the tokens that it shares with the group's union.
    queries = dealt(opened.join(parts, "_group").join(known.select("_class", "_n", "_last", "_bits", "_comp"), "_class").select(
        "_group", F.explode(F.transform(F.sequence(F.lit(0), meets - 1), lambda i: F.pmod(start + i, ms))).alias("_mb"),
        block(F.col("_qs")).alias("_qb"), *columns))
    return members.groupBy("_call").cogroup(queries.groupBy("_call")).applyInPandas(
        _opened(percent, forest),
        "_group long, _a long, _b long" if forest else "_group long, _mb int, _qb int, _class long, _asks boolean")


def one_of_each(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns kept: the smallest identifier's, nulls last.

    Of rows with that identifier the one with the smallest hash of its text
    stays, of equal ones in both the first in the order of their columns.  Rows
    without shingles link with nothing and stay.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_text_hash"), text.alias("_text"))
    sketch, linked, classes = _classes(rows, words, percent)
    of_class = classes.select("_class", "_key").join(linked, "_class", "left").select("_key", F.coalesce("_comp", "_class").alias("_comp"))
    placed = sketch.join(of_class, "_key").groupBy("_comp", "_id", "_text_hash").agg(F.count(F.lit(1)).alias("_rows"))
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_text_hash"))
    stays = placed.groupBy("_comp").agg(first.alias("_first")).select(
        F.col("_comp").alias("_of"), F.col("_first._id").alias("_first_id"), F.col("_first._text_hash").alias("_first_hash"))
    kept = F.col("_id").eqNullSafe(F.col("_first_id")) & (F.col("_text_hash") == F.col("_first_hash"))
    told = placed.join(stays, F.col("_comp") == F.col("_of")).select(
        F.col("_id").alias("_told_id"), F.col("_text_hash").alias("_told_hash"), kept.alias("_kept"), "_rows")
    told = stash(told.where("not _kept or _rows > 1").select("_told_id", "_told_hash", "_kept"), "near-copies")
    same = F.col("_found_id").eqNullSafe(F.col("_told_id")) & (F.col("_found_hash") == F.col("_told_hash"))
    found = docs.select(whole_row(docs).alias("_row"), F.col(f"`{id_col}`").alias("_found_id"), F.xxhash64(text).alias("_found_hash"))
    alone = found.join(told, same, "left_anti").select("_row")
    repeated = told.where("_kept")
    if not repeated.isEmpty():
        order = Window.partitionBy("_told_id", "_told_hash").orderBy(F.to_json("_row"))
        again = (found.join(repeated, same).withColumn("_at", F.row_number().over(order)).where("_at = 1").select("_row"))
        alone = alone.unionByName(again)
    return unpack(alone, "_row", docs)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES: dict[str, str] = {}
