"""Reference-shaped API on census-shaped records (CEN proxy)."""

import pytest
from pyspark.sql import functions as F

from popweave import api
from popweave.domain import CENSUS_ATTRS
from popweave.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_ipf_synthesizer_contract(spark):
    cen = fx.cen_records(spark, SF_SMALL).select("year", *CENSUS_ATTRS)
    train = cen.where(F.col("year") <= 2010)
    target = cen.where(F.col("year") == 2015)
    with pytest.raises(RuntimeError):
        api.IPFSynthesizer().generate(10)
    ipf = api.IPFSynthesizer().fit(train)
    targets = api.compute_marginals(target)
    syn = ipf.generate(777, targets)
    assert syn.count() == 777 and syn.columns == CENSUS_ATTRS
    shuffled = ipf.generate(777, targets, shuffle=True)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, syn.collect()))
    res = api.evaluate(syn, target).first()
    assert 0 <= res.jsd_full_joint <= 1 and res.srmse_avg >= 0
    raked = api.ipf_reweight(syn, targets)
    assert raked.count() == 777


def test_conditional_and_text_roundtrip(spark):
    cen = fx.cen_records(spark, SF_SMALL).select("id", "year", *CENSUS_ATTRS)
    s = api.ConditionalSampler().fit(cen.drop("id"))
    assert s.generate(321, 2015).count() == 321
    texts = api.serialize_dataframe(cen, key_col="id")
    back = api.parse_records(texts, keep=["id"]).withColumnRenamed("year", "parsed_year")
    j = back.join(cen, "id").where(F.col("parsed_year") != F.col("year").cast("string"))
    assert j.count() == 0 and back.count() == cen.count()


def test_load_data_layouts(spark):
    from popweave.session import scratch_path

    cen = fx.cen_records(spark, SF_SMALL).select("year", *CENSUS_ATTRS)
    cen = cen.where(F.col("year") <= 2020)
    combined = scratch_path(spark, "combined_layout")
    cen.write.parquet(f"{combined}/{api.COMBINED_FILE}")
    tr, tg, y = api.load_data(spark, combined)
    assert y == 2015
    assert tr.count() == cen.where(F.col("year") <= 2010).count()
    assert tg.count() == cen.where(F.col("year") == 2015).count()
    per_year = scratch_path(spark, "per_year_layout")
    for yr in (1990, 2000, 2015):  # other years missing: skipped
        cen.where(F.col("year") == yr).drop("year").write.parquet(f"{per_year}/{api.YEAR_FILE.format(year=yr)}")
    tr2, tg2, _ = api.load_data(spark, per_year)
    assert sorted(r.year for r in tr2.select("year").distinct().collect()) == [1990, 2000]
    assert tg2.count() == cen.where(F.col("year") == 2015).count()
    with pytest.raises(FileNotFoundError):
        api.load_data(spark, scratch_path(spark, "empty_layout"))


def test_only_missing_paths_are_skipped(spark, tmp_path):
    cen = fx.cen_records(spark, SF_SMALL).select("year", *CENSUS_ATTRS)
    cen.where(F.col("year") == 2015).drop("year").write.parquet(f"{tmp_path}/y/{api.YEAR_FILE.format(year=2015)}")
    (tmp_path / "y" / api.YEAR_FILE.format(year=2000)).mkdir()  # there, but without a file
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA|infer schema"):
        api.load_data(spark, f"{tmp_path}/y")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / api.COMBINED_FILE).write_bytes(b"this is no Parquet file")
    with pytest.raises(Exception):  # noqa: B017 - any error but a fall-back to other files
        api.load_data(spark, f"{tmp_path}/c")[0].count()


def test_public_functions(spark):
    cen = fx.cen_records(spark, SF_SMALL).select("id", "year", *CENSUS_ATTRS)
    texts = api.serialize_dataframe(cen.drop("id"))  # no key: a row number
    assert texts.columns == ["text"] and texts.count() == cen.count()
    assert texts.select(F.regexp_extract("text", "recorded: (\\w+)", 1)).distinct().count() > 2  # orders differ
    ok = api.check_record_feasibility(cen)
    assert 0 < ok.where("feasible").count() < cen.count()
    p = spark.range(1).select(api.build_era_prefix(F.lit(2020)).alias("e"), api.build_generation_prefix(F.lit(2021)).alias("g")).first()
    assert p.e.startswith("[Context: In 2020") and p.g == "In 2021, a resident of Daejeon was recorded: "
    res = api.evaluate(cen, cen).first()
    assert res.srmse_per_attr == dict.fromkeys(CENSUS_ATTRS, 0.0)
    one = api.compute_srmse(cen.where("sex = 'Male'"), cen, "sex", ["Male", "Female"]).first()
    assert one.attr == "sex" and one.srmse == pytest.approx(1.0, abs=0.02)
    counts = cen.groupBy("sex").agg(F.count("*").alias("n"))
    assert api.compute_jsd(counts, counts, ["sex"], 2).first().jsd == pytest.approx(0.0, abs=1e-12)
    any_attr = spark.createDataFrame([("u", 1), ("v", 2)] * 50, "x string, y int")
    assert api.ipf_reweight(any_attr, {"x": {"u": 0.9, "v": 0.1}}).where("x = 'u'").count() > 75
    assert api.ipf_reweight(any_attr, {}).count() == 100


def test_workers_need_no_package(tmp_path):
    """In-task fits run from a plain session whose workers cannot import the package."""
    import subprocess
    import sys as _sys

    repo = str(__import__("pathlib").Path(__file__).resolve().parents[1])
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from popweave.operators import fitting as FT
seed = spark.createDataFrame([(0, "0", 1.5), (1, "1", 2.5)], "cell long, x string, seed double")
fit = FT.ipf(seed, {{"x": {{"0": 0.3, "1": 0.7}}}}, 11, ["x"], {{"x": ["0", "1"]}}).collect()
assert round(sum(r["fitted"] for r in fit), 6) == 11
cells = spark.createDataFrame([("0", 3), ("1", 5)], "x string, n long")
assert FT.rake(cells, {{"x": {{"0": 0.5, "1": 0.5}}}}).count() == 2
print("OK")
""")
    out = subprocess.run([_sys.executable, str(script)], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=600)
    assert "OK" in out.stdout, out.stderr[-2000:]
