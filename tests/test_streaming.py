"""The row-local validation projection runs unchanged as a Structured Streaming query."""

from popweave.operators.validate import accepted, validate_generated
from popweave.session import scratch_path
from popweave.sources import fixtures as fx
from popweave.streaming import validate_stream as VS
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    gen = fx.gen_texts(spark, SF_SMALL).select("batch", "pos", "text")
    src = scratch_path(spark, "gen_src")
    gen.repartition(4).write.parquet(src)
    stream = VS.validated_stream(VS.read_generated(spark, src, max_files_per_trigger=1))
    out, ck = scratch_path(spark, "acc_out"), scratch_path(spark, "acc_ck")
    q = VS.start_accepted_sink(stream, out, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    want = accepted(validate_generated(spark.read.parquet(src), keep=["batch", "pos"]))
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    q2 = VS.start_reason_counts(VS.validated_stream(VS.read_generated(spark, src)), "reasons_t",
                                scratch_path(spark, "reason_ck"))
    q2.awaitTermination(300)
    n = spark.sql("SELECT sum(n) AS n FROM reasons_t").first().n
    assert n == gen.count()
