"""Piece ids against the library's own, whole texts and chunked ones."""

import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor

from popweave.llm import pieces
from popweave.llm.common import stash
from tests.conftest import SF_MID
from tests.llm import edge

PARTS = ["a", " ", "  ", "the", "ing", "aaaa", "\n", "é", "漢", "😀", "-", "----", "0", "tion", "▁", "<s>", "<0x0A>", "xx",
         "=" * 17, "####", " t"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pieces.MODEL)


def texts(n, seed):
    rnd = random.Random(seed)
    for k in range(n):
        some = PARTS if k % 3 else [p for p in PARTS if " " not in p and p != "▁"]
        yield "".join(rnd.choice(some) for _ in range(rnd.randint(1, 400)))


def test_matrices_combine_in_any_grouping(library):
    v = pieces.Vocabulary(open(pieces.MODEL, "rb").read())
    for text in texts(40, 5):
        marked, size, reach = pieces.marked(text), 67, pieces._REACH
        cut = [(marked[max(0, s - reach):s], marked[s:s + size], marked[s + size:s + size + reach])
               for s in range(0, len(marked), size)]
        parts = [pieces.chunk_matrix(v, *c) for c in cut]
        one_by_one, right = parts[0], parts[-1]
        for p in parts[1:]:
            one_by_one = pieces.product(one_by_one, p)
        for p in parts[-2::-1]:
            right = pieces.product(p, right)
        assert (one_by_one[2] == right[2]).all() and one_by_one[2].max() == 0.0
        path = pieces.best_states(parts, "", "")
        ids = [i for c, a, b in zip(cut, path, path[1:], strict=False) for i in pieces.chunk_ids(v, *c, a, b)]
        assert ids == library.encode(text)


@pytest.mark.parametrize("chunk,block", [(64, 3), (16_384, 256)])
def test_encode_and_decode(spark, library, chunk, block, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", block)
    more = [(1000 + k, t, "x", "y", 1, *edge.CLASHING) for k, t in enumerate(texts(30, 9))]
    docs = spark.createDataFrame(edge.rows() + more, edge.SCHEMA).where("length(text) < 30000 or text is null or doc_id = 12")
    got = pieces.encode(docs, chunk=chunk)
    assert got.columns == [*docs.columns, "token_ids"]
    back = pieces.decode(got, text_col="back").collect()
    want = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert Counter((r["doc_id"], r["text"]) for r in back) == want
    for r in back:
        if r["text"] is None:
            assert r["token_ids"] is None and r["back"] is None
        else:
            assert r["token_ids"] == library.encode(r["text"])
            assert r["back"] == r["text"].replace("▁", " ")
        assert r["decoded"] in ("DECODED", "decoded")


def test_query_columns_and_empty(spark):
    got = pieces.encoded_documents(edge.documents(spark).where("length(text) < 100 or text is null")).collect()
    assert all(r["round_trip"] for r in got)
    assert {r["n_tokens"] for r in got if not r["token_ids"]} == {0}
    giants = edge.documents(spark).where("doc_id in (11, 13) or text is null").select("doc_id", "text")
    checked = pieces.encode(giants, chunk=1000, check_col="ok").collect()
    assert len(checked) == 3 and all(r["ok"] for r in checked)
    assert pieces.encoded_documents(edge.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(edge.empty(spark), chunk=3)


def test_long_texts_of_the_tables_enter_the_scan(spark, library, monkeypatch):
    sizes = {}

    def counted(df, name):
        out = stash(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(pieces, "stash", counted)
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").where("char_length(text) >= 16384")
    got = pieces.encode(docs).collect()
    assert len(got) == sizes["giant-texts"] == 9 and sizes["text-chunks"] >= 18
    assert all(r["token_ids"] == library.encode(r["text"]) for r in got)
