"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A text, its spaces marked by U+2581 and one mark put in front, is a lattice
whose arcs are vocabulary pieces.  In a byte-pair model an arc may follow
another exactly if the model leaves the pair as it is (weight 0, else -inf);
the segmentation in which all neighbours satisfy that is the model's own, and
there is one.  So encoding is a best path, and best paths combine by max-plus
products:

* a text is cut into chunks of ``CHUNK`` characters wherever the cuts fall;
* a state at a cut is the piece that reaches or crosses it, with its overhang;
  each chunk yields the matrix of best weights from states at its left cut to
  states at its right cut, all chunks in parallel;
* the matrices are multiplied within blocks of ``BLOCK`` chunks, then over the
  blocks of a text (a row of Spark holds under 2^31 bytes, so both groups are
  bounded), and the states on the best path are handed back to the chunks;
* each chunk traces its own part back, independent of all others.

Where a word begins (a mark after another character) no piece of the
vocabulary crosses, which is verified when the model is loaded: there the
matrix has rank one, so inside a chunk only the cut words at its two ends need
the lattice, and the words between them go through the library.  A text of one
chunk has no cut, so its states are known at once.

Edge cases: a null text has null ids; an empty text has no ids; a character
outside the vocabulary becomes its UTF-8 bytes; U+2581 in a text is read back
as a space, as in the model itself; repeated rows and null identifiers are
told apart by a written row number; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.llm.common import stash, table, whole_row

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16_384
BLOCK = 256
MARK = "▁"
NONE = -np.inf


class Vocabulary:
    """A byte-pair model with the checks and look-ups that the lattice needs."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        m = self.model
        self.ids = {m.id_to_piece(i): i for i in range(m.vocab_size())
                    if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses the beginning of a word or a line feed")
        probe = " Aﬁ  b "
        if m.decode(m.encode(probe)) != probe or any(map(m.is_unknown, m.encode("\n\u0001"))):
            raise ValueError("a model with identity normalisation, a mark in front and byte pieces is needed")
        self.pairs: dict[tuple[str, str], float] = {}

    def whole(self, text: str) -> list[int]:
        """Ids of a string of marks and characters, with no mark put in front."""
        return self.model.encode("\n" + text)[2:]

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def weight(self, last: str | None, piece: str) -> float:
        """0 if ``piece`` may follow ``last`` (None: the beginning of a word), else -inf."""
        w = self.pairs.get((last, piece))
        if w is None:
            want = self.piece_ids(piece) if last is None else self.piece_ids(last) + self.piece_ids(piece)
            w = self.pairs[last, piece] = 0.0 if self.whole((last or "") + piece) == want else NONE
        return w

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces that begin there; a character that no piece holds stands for its bytes."""
        found = [text[at:end] for end in range(at + 1, min(at + self.longest, len(text)) + 1) if text[at:end] in self.ids]
        return found if text[at] in self.ids else [text[at], *found]

    def crossing(self, text: str, cut: int) -> list[tuple[str, int]]:
        """(piece, overhang) of those that begin before the cut and reach it."""
        return [(p, s + len(p) - cut) for s in range(max(0, cut - self.longest), cut)
                for p in self.starting(text, s) if s + len(p) >= cut]

    def encode_words(self, text: str) -> list[int]:
        """Ids of a text that begins with a mark and ends where a word ends."""
        # The library puts the mark in front of a text itself, but not of nothing.
        return self.model.encode(text[1:], num_threads=1) if len(text) > 1 else self.whole(text)

    def spells(self, ids: list[int], text: str) -> bool:
        """Whether ids from within a text decode to this part of it."""
        before = self.model.encode("\n")  # so that no mark is taken off the front
        return self.model.decode([*before, *ids]) == "\n" + text.replace(MARK, " ")


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def lattice(v: Vocabulary, text: str, end: int, inits: list[tuple[int, str | None]]):
    """Best weights from each of ``inits`` (place, last piece) to each (place, piece) at or past ``end``, and back pointers."""
    reached: dict[int, dict[str | None, np.ndarray]] = {}
    back: dict[tuple[int, str], tuple[int, str | None]] = {}
    for i, (at, last) in enumerate(inits):
        vec = reached.setdefault(at, {}).setdefault(last, np.full(len(inits), NONE))
        vec[i] = 0.0
    for at in range(end):
        here = reached.pop(at, None)
        if not here:
            continue
        for piece in v.starting(text, at):
            best, via = None, None
            for last, vec in here.items():
                w = v.weight(last, piece)
                if w > NONE:
                    got = vec + w
                    if best is None:
                        best, via = got, last
                    else:
                        via = last if got.max() > best.max() else via
                        best = np.maximum(best, got)
            if best is not None and best.max() > NONE:
                there = reached.setdefault(at + len(piece), {})
                if piece not in there or best.max() > there[piece].max():
                    back[at + len(piece), piece] = (at, via)
                there[piece] = np.maximum(there[piece], best) if piece in there else best
    return {(at, p): vec for at, found in reached.items() for p, vec in found.items()}, back


def _cuts(before: str, body: str) -> tuple[int, int] | None:
    """Places of the first and last beginning of a word in ``body``."""
    if not before:
        first = 0
    text, shift = before[-1:] + body, len(before[-1:])
    found = re.search(f"[^{MARK}]{MARK}", text)
    if before:
        if not found:
            return None
        first = found.start() + 1 - shift
    last, at = first, len(text)
    while found and (at := text.rfind(MARK, 0, at)) > 0:
        if text[at - 1] != MARK:
            last = at - shift
            break
    return first, last


def state(piece: str | None, overhang: int) -> str:
    return "" if piece is None else f"{overhang}:{piece}"


def unstate(s: str) -> tuple[int, str | None]:
    k, _, piece = s.partition(":")
    return (int(k), piece) if s else (0, None)


def _ends(found: dict, end: int, last_chunk: bool) -> dict[str, np.ndarray]:
    """Weights by state at the right cut; after the last chunk there is one state, the end."""
    out: dict[str, np.ndarray] = {}
    for (at, piece), vec in found.items():
        if last_chunk and at != end:
            continue
        key = "" if last_chunk else state(piece, at - end)
        out[key] = np.maximum(out[key], vec) if key in out else vec
    return out


def chunk_matrix(v: Vocabulary, before: str, body: str, after: str) -> tuple[list[str], list[str], np.ndarray]:
    """States at the left cut, states at the right cut, best weights between them."""
    crossing = v.crossing(before + body + after, len(before)) if before else [(None, 0)]
    ins = [state(p, k) for p, k in crossing]
    inits = [(k, p) for p, k in crossing]
    cuts = _cuts(before, body)
    if cuts is None:
        found, _ = lattice(v, body + after, len(body), inits)
        ends = _ends(found, len(body), not after)
        return ins, list(ends), np.array(list(ends.values())).reshape(len(ends), len(ins)).T
    first, last = cuts
    if before:
        found, _ = lattice(v, body[:first], first, inits)
        into = np.full(len(ins), NONE)
        for (at, _), vec in found.items():
            if at == first:
                into = np.maximum(into, vec)
    else:
        into = np.zeros(1)
    found, _ = lattice(v, body[last:] + after, len(body) - last, [(0, None)])
    ends = _ends(found, len(body) - last, not after)
    out = np.array([vec[0] for vec in ends.values()])
    return ins, list(ends), into[:, None] + out[None, :]


def _trace(v: Vocabulary, text: str, end: int, init: tuple[int, str | None], goal: str) -> list[str]:
    """Pieces of the best path from ``init`` to the state ``goal`` at ``end`` ('': exactly at the end)."""
    found, back = lattice(v, text, end, [init])
    ok = {n: vec[0] for n, vec in found.items()
          if (n[0] == end if goal == "" else state(n[1], n[0] - end) == goal)}
    node = max(ok, key=ok.get)
    if node == init:
        return []
    pieces = []
    while node != init:
        pieces.append(node[1])
        node = back[node]
    return pieces[::-1]


def chunk_ids(v: Vocabulary, before: str, body: str, after: str, into: str, out: str) -> list[int]:
    """Ids of the pieces that begin in the chunk, given the states at its cuts."""
    spell = lambda pieces: chain.from_iterable(map(v.piece_ids, pieces))
    init, cuts = unstate(into), _cuts(before, body)
    if cuts is None:
        return list(spell(_trace(v, body + after, len(body), init, out)))
    first, last = cuts
    head = spell(_trace(v, body[:first], first, init, "")) if before else ()
    tail = spell(_trace(v, body[last:] + after, len(body) - last, (0, None), out))
    return [*head, *v.encode_words(body[first:last]), *tail]


def product(a: tuple[list[str], list[str], np.ndarray], b: tuple[list[str], list[str], np.ndarray]):
    """Max-plus product of neighbouring chunks' matrices; associative."""
    place = {s: i for i, s in enumerate(b[0])}
    rows = np.array([place[s] for s in a[1]], dtype=int)
    right = b[2][rows]
    return a[0], b[1], (a[2][:, :, None] + right[None, :, :]).max(axis=1)


def best_states(parts: list[tuple[list[str], list[str], np.ndarray]], into: str, out: str) -> list[str]:
    """The state of the best path from ``into`` to ``out`` at each cut between neighbouring matrices, both ends included."""
    back = [{out: 0.0}]  # best weight from each state to the end
    for ins, outs, m in reversed(parts):
        to = np.array([back[-1].get(s, NONE) for s in outs])
        back.append(dict(zip(ins, (m + to[None, :]).max(axis=1), strict=True)))
    back.reverse()
    path = [into]
    for (ins, outs, m), after in zip(parts, back[1:], strict=True):
        row = m[ins.index(path[-1])] + np.array([after.get(s, NONE) for s in outs])
        path.append(outs[int(row.argmax())])
    return path


# ---------------------------------------------------------------- Spark jobs

_CHUNKS = T.StructType([T.StructField("_uid", T.LongType()), T.StructField("_chunk", T.IntegerType()),
                        T.StructField("_of", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("_before", "_body", "_after")]])
_MATRICES = T.StructType([T.StructField("_uid", T.LongType()), T.StructField("_block", T.IntegerType()),
                          T.StructField("_chunk", T.IntegerType()), T.StructField("_of", T.IntegerType()),
                          T.StructField("_ins", T.ArrayType(T.StringType())),
                          T.StructField("_outs", T.ArrayType(T.StringType())),
                          T.StructField("_m", T.ArrayType(T.DoubleType()))])
_STATES = T.StructType([T.StructField("_uid", T.LongType()), T.StructField("_part", T.IntegerType()),
                        T.StructField("_into", T.StringType()), T.StructField("_out", T.StringType())])
_STATE_TYPES = (pa.int64(), pa.int32(), pa.string(), pa.string())
_REACH = 64


def _splitter(size: int) -> Callable:
    def split(batches):
        for batch in batches:
            for uid, text in zip(batch.column("_uid").to_pylist(), batch.column("_text"), strict=True):
                text = marked(text.as_py())
                starts = range(0, len(text), size)
                for lo in range(0, len(starts), 64):
                    some = starts[lo:lo + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid] * len(some), pa.int64()),
                         pa.array(range(lo, lo + len(some)), pa.int32()), pa.array([len(starts)] * len(some), pa.int32()),
                         pa.array([text[max(0, s - _REACH):s] for s in some], pa.string()),
                         pa.array([text[s:s + size] for s in some], pa.string()),
                         pa.array([text[s + size:s + size + _REACH] for s in some], pa.string())],
                        names=_CHUNKS.names)
    return split


def _matrix_task(model: bytes) -> Callable:
    def matrices(batches):
        v = Vocabulary(model)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ins, outs, m = chunk_matrix(v, r["_before"], r["_body"], r["_after"])
                rows.append({"_uid": r["_uid"], "_block": r["_chunk"] // BLOCK, "_chunk": r["_chunk"],
                             "_of": r["_of"], "_ins": ins, "_outs": outs, "_m": m.ravel().tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("_uid", pa.int64()), ("_block", pa.int32()), ("_chunk", pa.int32()), ("_of", pa.int32()),
                 ("_ins", pa.list_(pa.string())), ("_outs", pa.list_(pa.string())), ("_m", pa.list_(pa.float64()))]))
    return matrices


def _parts(pdf, order: str):
    pdf = pdf.sort_values(order)
    return pdf[order].tolist(), [(list(i), list(o), np.array(m, dtype=float).reshape(len(i), len(o)))
                                 for i, o, m in zip(pdf["_ins"], pdf["_outs"], pdf["_m"], strict=True)]


def _multiply(key, pdf):
    import pandas as pd

    _, parts = _parts(pdf, "_chunk")
    whole = parts[0]
    for part in parts[1:]:
        whole = product(whole, part)
    return pd.DataFrame([{"_uid": key[0], "_block": key[1], "_chunk": key[1], "_of": 0, "_ins": whole[0], "_outs": whole[1],
                          "_m": whole[2].ravel().tolist()}])


def _text_states(batches):
    """States at the cuts of texts of one block, whose chunks come one after another."""
    def rows():
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                yield from batch.slice(lo, 500).to_pylist()

    out: list[tuple] = []
    for uid, run in groupby(rows(), key=lambda r: r["_uid"]):
        run = list(run)  # BLOCK at most
        parts = [(r["_ins"], r["_outs"], np.array(r["_m"], float).reshape(len(r["_ins"]), len(r["_outs"]))) for r in run]
        path = best_states(parts, "", "")
        out += [(uid, r["_chunk"], a, b) for r, a, b in zip(run, path, path[1:], strict=False)]
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _STATE_TYPES, strict=True)],
                                             names=_STATES.names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _STATE_TYPES, strict=True)],
                                         names=_STATES.names)


def _block_states(key, pdf):
    import pandas as pd

    blocks, parts = _parts(pdf, "_block")
    path = best_states(parts, "", "")
    return pd.DataFrame({"_uid": key[0], "_part": blocks, "_into": path[:-1], "_out": path[1:]})


def _chunk_states(key, matrices, states):
    import pandas as pd

    chunks, parts = _parts(matrices, "_chunk")
    path = best_states(parts, states["_into"].iloc[0], states["_out"].iloc[0])
    return pd.DataFrame({"_uid": key[0], "_part": chunks, "_into": path[:-1], "_out": path[1:]})


def _id_lists(lists: list) -> pa.Array:
    sizes = np.array([0, *(len(x) if x is not None else 0 for x in lists)])
    flat = np.fromiter(chain.from_iterable(x for x in lists if x is not None), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat),
                                    mask=pa.array([x is None for x in lists], pa.bool_()))


def _trace_task(model: bytes, check: bool) -> Callable:
    """Ids of chunks; ``check``: also whether they decode to the part of the text that their pieces cover."""
    def trace(batches):
        v = Vocabulary(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                ids, ok = [], []
                for r in some.to_pylist():
                    ids.append(chunk_ids(v, r["_before"], r["_body"], r["_after"], r["_into"], r["_out"]))
                    if check:
                        covered = (r["_body"] + r["_after"])[unstate(r["_into"])[0]:len(r["_body"]) + unstate(r["_out"])[0]]
                        ok.append(v.spells(ids[-1], covered))
                yield pa.RecordBatch.from_arrays([some.column("_uid"), some.column("_chunk"), _id_lists(ids),
                                                  *([pa.array(ok, pa.bool_())] if check else [])],
                                                 names=["_uid", "_chunk", "_ids", *["_ok"] * check])
    return trace


def _one_chunk_task(model: bytes, check: bool) -> Callable:
    """Texts of one chunk: no cut, so the whole text runs from the first state to the end.

    ``check``: also whether the ids decode to the text.
    """
    def encode(batches):
        v = Vocabulary(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                some = batch.slice(lo, 100)
                texts = some.column(some.schema.names.index("_text")).to_pylist()
                ids = [None if t is None else v.encode_words(marked(t)) if t else [] for t in texts]
                more = [pa.array([back == (t and t.replace(MARK, " ")) for t, back in zip(texts, _spelled(v.model, ids), strict=True)],
                                 pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*some.columns, _id_lists(ids), *more],
                                                 names=[*some.schema.names, "_ids", *["_ok"] * check])
    return encode


def _spelled(model, ids: list) -> list:
    """The text of each list of ids; null for null."""
    keep = [i for i, x in enumerate(ids) if x]
    out = [None if x is None else "" for x in ids]
    for i, text in zip(keep, model.decode([ids[i] for i in keep], num_threads=1) if keep else [], strict=True):
        out[i] = text
    return out


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", model: str = MODEL,
           chunk: int = CHUNK, check_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text, and in ``check_col``, if named, whether they decode to it.

    The new columns replace any of those names.
    """
    if chunk < _REACH:
        raise ValueError(f"chunks have {_REACH} characters at least")
    spec = _model_bytes(model)  # a file of fixed size; goes to the tasks with the function
    Vocabulary(spec)
    rest = docs.drop(text_col, ids_col, *([check_col] if check_col else []))
    rows = docs.select(whole_row(rest).alias("_row") if rest.columns else F.struct(F.lit(1).alias("_")).alias("_row"),
                       F.col(f"`{text_col}`").alias("_text"))
    size = F.char_length("_text")
    schema = T.StructType([*rows.schema.fields, T.StructField("_ids", _IDS),
                           *([T.StructField("_ok", T.BooleanType())] if check_col else [])])
    small = rows.where(size.isNull() | (size < chunk)).mapInArrow(_one_chunk_task(spec, bool(check_col)), schema)

    giant = stash(rows.where(size >= chunk).select(F.monotonically_increasing_id().alias("_uid"), "*"), "giant-texts")
    chunks = stash(giant.select("_uid", "_text").mapInArrow(_splitter(chunk), _CHUNKS).repartition("_uid", "_chunk"),
                   "text-chunks")
    matrices = stash(chunks.mapInArrow(_matrix_task(spec), _MATRICES), "chunk-matrices")
    # Texts of one block need no products: a task takes many of them.
    of_one = matrices.where(F.col("_of") <= BLOCK).repartition("_uid").sortWithinPartitions("_uid", "_chunk").mapInArrow(
        _text_states, _STATES)
    more = matrices.where(F.col("_of") > BLOCK)
    blocks = more.groupBy("_uid", "_block").applyInPandas(_multiply, _MATRICES)
    block_states = blocks.groupBy("_uid").applyInPandas(_block_states, _STATES)
    states = of_one.unionByName(more.groupBy("_uid", "_block").cogroup(
        block_states.withColumnRenamed("_part", "_block").groupBy("_uid", "_block")).applyInPandas(_chunk_states, _STATES))
    schema = T.StructType([*_CHUNKS.fields[:2], T.StructField("_ids", _IDS),
                           *([T.StructField("_ok", T.BooleanType())] if check_col else [])])
    traced = (chunks.join(states.withColumnRenamed("_part", "_chunk"), ["_uid", "_chunk"])
              .mapInArrow(_trace_task(spec, bool(check_col)), schema))
    # A text's ids go together again, as its characters were in one row.
    ids = traced.groupBy("_uid").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_ids"))), lambda x: x["_ids"])).alias("_ids"),
        *([F.bool_and("_ok").alias("_ok")] if check_col else []))
    large = giant.join(ids, "_uid").select("_row", "_text", "_ids", *["_ok"] * bool(check_col))
    both = small.unionByName(large)
    return both.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c)
                         for c in docs.columns if c not in (ids_col, check_col)], F.col("_ids").alias(ids_col),
                       *([F.col("_ok").alias(check_col)] if check_col else []))


def decode(tokens: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``tokens`` with the text of each list of ids (null for null); ``text_col`` replaces a column of that name."""
    spec = _model_bytes(model)

    def texts(batches):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_proto=spec)
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                some = batch.slice(lo, 100)
                got = _spelled(m, some.column(some.schema.names.index("_ids")).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(got, pa.string())],
                                                 names=[*some.schema.names, "_decoded"])

    rest = tokens.drop(text_col)
    rows = rest.select(whole_row(rest).alias("_row"), F.col(f"`{ids_col}`").alias("_ids"))
    done = rows.mapInArrow(texts, T.StructType([*rows.schema.fields, T.StructField("_decoded", T.StringType())]))
    return done.select(*[F.col("_row").getField(c).alias(c) for c in rest.columns], F.col("_decoded").alias(text_col))


def encoded_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, token_ids, round_trip``: ids of each text, and whether they decode to it."""
    tokens = encode(docs.select("doc_id", "text"), model=model, check_col="round_trip")
    return tokens.select("doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).alias("n_tokens"), "token_ids", "round_trip")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES: dict[str, str] = {}
