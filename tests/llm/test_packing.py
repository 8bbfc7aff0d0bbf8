"""Packing: pieces against the tokenizer itself, gapless sequences, and their number against exact packing and bounds."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from popweave.llm import packing as K
from tests.conftest import SF_SMALL
from tests.llm import edge


def expected_pieces(texts, capacity=K.CAPACITY):
    """(piece, start, length, crc, ids) of each text, from the library."""
    tokenizer = Tokenizer.from_file(K.default_model())
    out = []
    for text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = list(range(len(ids), 0, -capacity))[::-1]
        got, start = [], 0
        for k, end in enumerate(cuts):
            part = ids[start:end]
            got.append((k, start, end - start, zlib.crc32(np.array(part, "<u4").tobytes()), part))
            start = end
        out.append(got)
    return out


def sound(rows, capacity=K.CAPACITY):
    """Sequences are filled from 0 without gaps or overlaps; their number."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def least(lengths, capacity=K.CAPACITY):
    return max(math.ceil(sum(lengths) / capacity), sum(2 * x > capacity for x in lengths))


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    df = K.op13_packing(spark, SF_SMALL)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = df.collect()
    want = Counter((r["doc_id"], *p[:4]) for r, ps in zip(docs, expected_pieces([r["text"] for r in docs]), strict=True) for p in ps)
    assert Counter(tuple(r)[:5] for r in rows) == want
    used = sound(rows)
    assert used <= least([r["length"] for r in rows]) * 1.015 + 1


@pytest.mark.parametrize("capacity", [16, 1024])
def test_edge_rows_with_ids(spark, capacity):
    df = K.pack(edge.documents(spark), capacity=capacity, keep_ids=True)
    rows = df.collect()
    want = Counter((i, *p[:4], *p[4]) for (i, *_), ps in zip(
        edge.TEXTS, expected_pieces([t[1] for t in edge.TEXTS], capacity), strict=True) for p in ps)
    assert Counter((*tuple(r)[:5], *r["ids"]) for r in rows) == want
    used = sound(rows, capacity)
    whole = {r["sequence_id"]: r["ids"] for r in K.sequences(df).collect()}
    assert len(whole) == used and all(
        whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"] for r in rows)


def test_empty(spark):
    assert K.pack(edge.empty(spark)).collect() == []


def exact(lengths, capacity):
    """Fewest sequences by dynamic programming over subsets."""
    @lru_cache(None)
    def best(mask):  # sequences opened before the last one, and what the last one holds
        if not mask:
            return 0, 0
        ways = []
        for i, x in enumerate(lengths):
            if mask >> i & 1:
                n, used = best(mask ^ 1 << i)
                ways.append((n, used + x) if used + x <= capacity else (n + 1, x))
        return min(ways)

    return best((1 << len(lengths)) - 1)[0] + 1


def test_few_pieces_against_exact_packing():
    pick = random.Random(3)
    off = []
    for _ in range(60):
        capacity = pick.choice([10, 24, 100])
        lengths = [pick.randint(1, capacity) for _ in range(pick.randint(1, 11))]
        off.append(placed(Counter(lengths), capacity) - exact(lengths, capacity))
    assert max(off) <= 1 and sum(off) <= 6


def placed(histogram, capacity):
    plan = K.configurations(histogram, capacity)
    got = Counter()
    for config, times in plan:
        assert times > 0 and sum(x * n for x, n in config) <= capacity
        for x, n in config:
            got[x] += n * times
    assert got == Counter(histogram)
    return sum(times for _, times in plan)


@pytest.mark.parametrize("scale", [1, 1000, 10**6])
def test_program_packs_nearly_without_waste(scale):
    pick = random.Random(4)
    histogram = Counter()
    for _ in range(3000):
        histogram[min(1024, 1 + int(pick.expovariate(1 / 300)))] += scale
    assert placed(histogram, 1024) <= math.ceil(sum(x * n for x, n in histogram.items()) / 1024) * 1.005


def test_program_where_longest_first_is_wasteful():
    """Sixes, fours and threes of a length that taking the longest piece that fits would pack badly."""
    histogram = {501: 600, 264: 600, 259: 600, 253: 1200, 101: 600}
    lower = math.ceil(sum(x * n for x, n in histogram.items()) / 1024)
    assert placed(histogram, 1024) <= lower * 1.03


def test_places_hold_every_piece_once():
    plan = [(((600, 1), (200, 2)), 3), (((600, 1),), 2), (((200, 5),), 1)]
    keys, sequences, offsets = K.places(plan)
    at = {}
    for length, n in ((600, 5), (200, 11)):
        for nth in range(n):
            key = length * K._MOST + nth
            k = np.searchsorted(keys, key, "right") - 1
            at[length, nth] = (int(sequences[k] + key - keys[k]), int(offsets[k]))
    assert len(set(at.values())) == 16 and sound(
        [{"sequence_id": s, "offset": o, "length": x} for (x, _), (s, o) in at.items()]) == 6


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(K.default_model()).encode_batch(texts, add_special_tokens=False)]


def encoder(**changes):
    with open(K.default_model(), encoding="utf-8") as f:
        spec = json.loads(f.read())
    return K.Encoder(json.dumps({**spec, **changes}))


def test_encoder_equals_the_library():
    pick = random.Random(6)
    letters = [*"aàz09 .,'\n\t’“", "  ", " \n", "'s", "'LL", "don't", " the", " ", " ", "\u0085", "​", "漢字", "😀", "٣", "ß", "\x00", "\x1c"]
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(4000)]
    texts += ["x" * 3000, " " * 3000, "a " + "b" * 1200 + " c", "text <|endoftext|> text", "<|endoftext|>", "ab\n" * 5000, "1" * 5000]
    # Every character, between letters, digits, signs and spaces.
    texts += [f"a{c}a 1{c}1 .{c}. {c}{c}a  {c} '{c}s" for c in map(chr, [*range(0xD800), *range(0xE000, 0x3FFFF, 7)])]
    encode = encoder()
    assert encode.fast and encode._long_run("x" * 1500) and not encode._long_run("some words " * 500)
    got = [np.frombuffer(b, "<u4").tolist() for lo in range(0, len(texts), 5000) for b in encode(texts[lo:lo + 5000])]
    assert got == library_ids(texts)


def test_other_models_go_to_the_library():
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True,
                                                                          "trim_offsets": True, "use_regex": True}}):
        assert encoder(**change).fast is None
