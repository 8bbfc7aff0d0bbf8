"""Plan-shape checks for the scale properties (read from ``explain`` output)."""

import io
import re
from contextlib import redirect_stdout

from popweave.operators.sampling import numbered_members, subsample_exact
from popweave.plans import catalog as K
from popweave.plans import methods as PM
from popweave.sources import fixtures as fx
from tests.conftest import SF_SMALL


def _plan(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def test_lineitem_shuffled_once_on_order_key(spark):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(K.QUERIES["cell_counts"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", p)
    on_order = {k for k in keys if "l_orderkey" in k}
    assert len(on_order) == 1 and next(iter(on_order)).startswith("l_orderkey#"), keys


def test_year_filter_reaches_orders_scan(spark):
    p = _plan(fx.pop_weighted(spark, SF_SMALL, years=[2000]))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", p)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", p)


def test_small_exact_subsample_is_take_ordered(spark):
    df = fx.pop_records(spark, SF_SMALL, with_rid=True)
    assert "TakeOrderedAndProject" in _plan(subsample_exact(df, 100, 1, ["rid"]), mode="simple")


def test_order_keys_of_the_years_filter_lineitem_at_the_scan(spark):
    """Catalyst's runtime filter passes the per-order aggregation; a cluster applies it from 10 GB of lineitem on."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        p = _plan(fx.pop_weighted(spark, SF_SMALL, years=[2000]), mode="simple")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert re.search(r"might_contain\(Subquery [^\n]*xxhash64\(l_orderkey", p)


def test_base_and_skewed_counts_read_lineitem_once(spark):
    p = _plan(fx.pop_weighted(spark, SF_SMALL, "both", years=[1999, 2000]), mode="simple")
    assert len(re.findall(r"FileScan parquet \[l_orderkey", p)) == 1


def test_resampled_records_are_never_broadcast(spark):
    """Draws and members of a cell are as many as the records, however few bytes their table takes."""
    records = spark.range(4000).selectExpr("if(id % 2 = 0, 'a', 'b') as x", "id")
    out = PM.rake_resample(records, {"x": {"a": 0.3, "b": 0.7}}, ["x"])
    assert out.count() == 4000
    p = _plan(out, mode="simple")
    assert re.search(r"SortMergeJoin \[[^\]]*_member", p)
    assert not re.search(r"BroadcastHashJoin \[[^\]]*_member", p)
    members = numbered_members(records, "x")
    assert not re.search(r"BroadcastHashJoin \[[^\]]*_part", _plan(members, mode="simple"))
    rows = [(r.x, r._member) for r in members.collect()]
    assert sorted(rows) == [(x, i) for x in "ab" for i in range(2000)]


def test_record_join_has_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    columns = fx.POP_COLUMNS
    before = fx.pop_records(spark, SF_SMALL).groupBy(*columns).count()
    monkeypatch.setattr(fx, "JOIN_ROWS", 400)
    dealt = fx.pop_records(spark, SF_SMALL)
    n = -(-fx.table(spark, SF_SMALL, "lineitem").count() // 400)
    assert len(re.findall(rf"hashpartitioning\(\w+_orderkey#\w+, {n}\), REPARTITION_BY_NUM", _plan(dealt, mode="simple"))) == 2
    assert dealt.groupBy(*columns).count().exceptAll(before).isEmpty()
    assert before.exceptAll(dealt.groupBy(*columns).count()).isEmpty()
