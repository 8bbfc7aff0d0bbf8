"""The prefix index against the chain of rules, large domains, and the two-stage draw."""

import random
from collections import Counter

from pyspark.sql import functions as F

from popweave.domain import CENSUS_DOMAIN, domain_df
from popweave.functions.text import generation_prefix, match_category
from popweave.operators import matching as MT
from popweave.operators import sampling as SM
from popweave.plans import methods as PM


def values():
    pick = random.Random(4)
    out = {("edu", v) for v in ("", " ", "No", "noschooling", "x" * 3000, "no schooling at all", "Élémentaire", "  High School  ")}
    for a, cats in CENSUS_DOMAIN.items():
        for c in cats:
            for v in (c, c.upper(), f"\t{c.lower()} ", c + " dropout", c + "5", *(c[:k] for k in range(1, len(c))), c[::-1]):
                out.add((a, v))
            out.add((pick.choice(list(CENSUS_DOMAIN)), c))
    return sorted(out)


def test_index_equals_the_chain_of_rules(spark):
    attrs = list(CENSUS_DOMAIN)
    df = spark.createDataFrame(values() * 3 + [("edu", None), ("none", "Male")], "attr string, value string").repartition(5)
    got = {(r["attr"], r["value"]): r["matched"] for r in MT.match_values(df, domain_df(spark, attrs, CENSUS_DOMAIN)).collect()}
    chain = F.lit(None).cast("string")
    for a in attrs:
        chain = F.when(F.col("attr") == a, match_category(F.col("value"), CENSUS_DOMAIN[a])).otherwise(chain)
    want = {(r["attr"], r["value"]): r["m"] for r in df.where("attr <> 'none' and value is not null").distinct().select("*", chain.alias("m")).collect()}
    assert {k: v for k, v in got.items() if k[0] != "none"} == want and len(want) > 300
    assert sum(v is None for v in want.values()) > 30


def test_columns_keep_rows_and_other_columns(spark):
    rows = [(1, "male", "Managers"), (2, "FEM", None), (2, None, "manager"), (3, "?", "cler")] * 2
    df = spark.createDataFrame(rows, "id int, sex string, occupation string")
    domain = domain_df(spark, ["sex", "occupation"], CENSUS_DOMAIN)
    got = Counter(tuple(r) for r in MT.match_columns(df, ["sex", "occupation"], domain).collect())
    assert got == {(1, "Male", "Managers"): 2, (2, "Female", None): 2, (2, None, "Managers"): 2, (3, None, "Clerks"): 2}


def test_domain_of_a_hundred_thousand_categories(spark):
    domain = spark.range(100_000).select(F.lit("name").alias("attr"), F.col("id").cast("int").alias("ord"),
                                         F.format_string("Name %06d of many", "id").alias("cat"))
    asked = {"name 000042 OF MANY": "Name 000042 of many", "Name 000043 of many more": "Name 000043 of many", "nam": "Name 000000 of many",
             "name 0999": "Name 099900 of many", "na": None, "other": None}
    df = spark.createDataFrame([("name", v) for v in asked], "attr string, value string")
    assert {r["value"]: r["matched"] for r in MT.match_values(df, domain).collect()} == asked


def test_members_are_numbered_without_gaps(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("cell")).repartition(6)
    numbers = {}
    for r in SM.numbered_members(df, "cell").collect():
        numbers.setdefault(r["cell"], []).append(r["_member"])
    assert sum(map(len, numbers.values())) == 5000 and all(sorted(n) == list(range(len(n))) for n in numbers.values())


def test_resample_picks_members_evenly_and_keeps_their_columns(spark):
    rows = [(i, "a" if i % 4 else "b", None if i % 10 == 0 else f"note {i}", [i, i + 1]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, A string, note string, list array<int>").repartition(4)
    source = {r[0]: r for r in rows}
    hits = Counter()
    for seed in range(5):
        got = PM.rake_resample(df, {"A": {"a": 0.5, "b": 0.5}}, seed=seed).collect()
        assert len(got) == 400 and all((r["id"], r["A"], r["note"], r["list"]) == source[r["id"]] for r in got)
        hits.update(r["id"] for r in got)
    b = [hits[i] for i in range(0, 400, 4)]
    assert abs(sum(b) / 2000 - 0.5) < 0.05  # a quarter of the records, half of the draws
    assert 0.7 < sum((x - 10) ** 2 / 10 for x in b) / 99 < 1.4  # each about ten times, as independent draws would


def test_prompt_specs(spark):
    rows = [(2000, "Male", None), (2000, "Male", None), (2000, None, None), (2045, "Female", "0-4"), (None, "Male", "0-4")]
    df = spark.createDataFrame(rows, "year int, sex string, age_group string")
    specs = PM.prompt_specs(df, ["sex", "age_group"])
    assert {(r["year"], tuple(sorted(r["conditions"].items())), r["repeats"]) for r in specs.collect()} == {
        (2000, (("sex", "Male"),), 2), (2000, (), 1), (2045, (("age_group", "0-4"), ("sex", "Female")), 1),
        (None, (("age_group", "0-4"), ("sex", "Male")), 1)}
    got = [tuple(r) for r in PM.prompt_batch(specs.where("year is not null"), batch_size=3).orderBy("batch", "pos").collect()]
    one = lambda year, *conditions: spark.range(1).select(
        generation_prefix(F.lit(year), conditions=[(k, F.lit(v)) for k, v in conditions])).first()[0]
    plain, male = one(2000), one(2000, ("sex", "Male"))
    assert got == [(0, 0, plain), (0, 1, male), (0, 2, male), (1, 0, one(2045, ("sex", "Female"), ("age_group", "0-4")))]
