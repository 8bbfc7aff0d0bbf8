"""Every stage against a brute-force version on its own input, and edge tables through all stages."""

from collections import Counter

from sentencepiece import SentencePieceProcessor

import __spark_entry__ as E
import corpus_pipeline as P
from popweave.llm import pieces, quality
from popweave.llm.common import stash
from tests.conftest import SF_SMALL
from tests.llm import edge
from tests.llm.test_joins import classes
from tests.llm.test_native import WHITE, expected_mix


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        docs = stash(stage(spark, docs, SF_SMALL), f"test-{k}")
        after = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if k == 0:
            model = quality.train(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
            scores = [quality.sigmoid(quality.score(quality.design([r["text"]], [r["n_chars"]], model["mean"], model["sd"]),
                                                    model["w0"], model["w"], model["v"]))[0] for r in before]
            want = Counter(r for r, s in zip(before, scores, strict=True) if s >= quality.THRESHOLD)
            assert Counter(after) == want and 0 < len(after) <= len(before)
        elif k == 1:
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                first.setdefault(WHITE.sub(" ", r["text"] or ""), r)
            assert Counter(after) == Counter(first.values())
        elif k == 2:
            label = classes([(r["doc_id"], r["text"]) for r in before], P.NEAR_WORDS, P.NEAR_PERCENT)
            assert Counter(after) == Counter(r for r in before if label[r["doc_id"]][1] == r["doc_id"])
        elif k == 3:
            copies = Counter(i for i, _, _ in expected_mix([(r["doc_id"], r["source"]) for r in before]).elements())
            assert Counter(r["doc_id"] for r in after) == copies
        else:
            library = SentencePieceProcessor(model_file=pieces.MODEL)
            text = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before)
            assert all(r["token_ids"] == library.encode(text[r["doc_id"]]) and r["round_trip"] for r in after)


def test_edge_tables_through_all_stages(spark, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)], "doc_id long, quality int, toxic int")
    for name, docs in (("edge", edge.documents(spark)), ("empty", edge.empty(spark))):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        rows = docs = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in P.STAGES:
            docs = stash(stage(spark, docs, at), "test-edge")
        assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in rows.collect()}
        assert docs.where("not round_trip").count() == 0


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(E.oracle_sql()) <= names
