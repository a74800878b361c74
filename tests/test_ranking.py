import random

import pytest
from plain import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from molweave.operators import ranking


@pytest.fixture(scope="module")
def scored(spark):
    """One group holds a third of the rows, and most of its scores are equal."""
    rng = random.Random(4)
    data = []
    for i in range(900):
        group = 0 if i % 3 == 0 else rng.randrange(1, 6)
        score = 0.0 if rng.random() < 0.5 else rng.choice([0.25, 0.5, 1.0, rng.random()])
        data.append((group, f"n{i:04d}", score, 40 * (group + 1)))
    return spark.createDataFrame(data, "g int, name string, score double, cut long").repartition(6)


@pytest.mark.parametrize("small_rows", [10_000, 0])
def test_exact_rank(spark, scored, small_rows):
    order = [F.desc("score"), F.asc("name")]
    want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert rows(ranking.exact_rank(scored, ["g"], order, small_rows=small_rows), "name", "rank") == rows(want, "name", "rank")
    whole = ranking.exact_rank(scored, [], order, small_rows=small_rows)
    ranks = [r["rank"] for r in whole.orderBy(*order).collect()]
    assert ranks == list(range(1, 901))


@pytest.mark.parametrize("small_rows", [10_000, 0])
def test_exact_rank_keeps_groups_without_a_key(spark, scored, small_rows):
    order = [F.desc("score"), F.asc("name")]
    some = scored.withColumn("g", F.when(F.col("g") > 1, F.col("g")))
    want = some.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert rows(ranking.exact_rank(some, ["g"], order, small_rows=small_rows), "g", "name", "rank") == rows(want, "g", "name", "rank")


@pytest.mark.parametrize("small_rows", [10_000, 0])
def test_top_by_score(spark, scored, small_rows, monkeypatch):
    monkeypatch.setattr(ranking.exact_rank, "__defaults__", ("rank", small_rows))
    window = Window.partitionBy("g").orderBy(F.desc("score"), F.asc("name"))
    want = scored.withColumn("r", F.row_number().over(window)).where("r <= cut")
    assert rows(ranking.top_by_score(scored, ["g"], "score", "name"), "g", "name") == rows(want, "g", "name")


def test_cuts_at_the_ends(spark, scored):
    for cut, want in ((0, 0), (10_000, 900)):
        assert ranking.top_by_score(scored.withColumn("cut", F.lit(cut)), ["g"], "score", "name").count() == want


def test_first_and_last(spark):
    data = [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 2, "w")]
    df = spark.createDataFrame(data, "name string, ord int, v string")
    assert rows(ranking.last_by_name(df)) == [("a", 3, "y"), ("b", 2, "z")]
    assert rows(ranking.first_per_group(df, ["name"], ["ord"], 2), "name", "ord", "rank") == [("a", 1, 1), ("a", 2, 2), ("b", 2, 1)]


def test_small_limits_cut_before_the_shuffle(spark, scored):
    plan = ranking.first_per_group(scored, ["g"], ["score"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_percent_cut(spark):
    for percent in (2, 10, 29, 60, 75):
        got = spark.range(0, 500).select(ranking.percent_cut(percent, F.col("id")).alias("c"), "id").collect()
        assert all(r["c"] == int(percent / 100.0 * r["id"]) for r in got)
