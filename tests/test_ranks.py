import random
from bisect import bisect_left, bisect_right
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksrisk.operators import ranks
from worksrisk.operators.joins import hot_keys, spread_left_join


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_small_example(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0), (5, None)],
                               "id int, v double")
    assert rows(ranks.average_percentile(df, "id", ["v"]), "id", "pct") == [
        (1, 0.25), (2, 0.625), (3, 0.625), (4, 1.0)]
    below = ranks.left_percentile(ranks.melt(df, ["id"], ["v"]),
                                  ranks.reference_counts(df, ["v"]), "id")
    assert rows(below, "id", "pct") == [(1, 0.0), (2, 0.25), (3, 0.25), (4, 0.75)]


def test_percentile_without_reference_is_the_middle(spark):
    df = spark.createDataFrame([(1, 1.0)], "id int, v double")
    none = ranks.reference_counts(df.limit(0), ["v"])
    assert rows(ranks.left_percentile(ranks.melt(df, ["id"], ["v"]), none, "id"), "pct") == [(0.5,)]


def test_rank_ties(spark):
    df = spark.createDataFrame([("a", 90.0), ("b", 90.0), ("c", 80.0), ("d", None)],
                               "k string, v double")
    got = sorted(ranks.descending_rank(df, "v", "place").select("k", "place").collect())
    assert [tuple(r) for r in got] == [("a", 1), ("b", 1), ("c", 3), ("d", None)]


@pytest.mark.parametrize("partitions", [1, 16])
def test_against_brute_force_with_a_hot_value(spark, partitions):
    rng = random.Random(7)
    values = [5.0 if rng.random() < 0.4 else round(rng.gauss(0, 3), 2) for _ in range(4000)]
    groups = [rng.choice("aab") for _ in values]
    df = spark.createDataFrame(
        [(i, g, v) for i, (g, v) in enumerate(zip(groups, values))],
        "id int, feature string, value double").repartition(partitions)
    placed = ranks.with_positions(df, ["feature"])
    ordered = {g: sorted(v for h, v in zip(groups, values) if h == g) for g in "ab"}
    for r in placed.collect():
        line = ordered[r["feature"]]
        assert r["lt"] == bisect_left(line, r["value"])
        assert r["eq"] == bisect_right(line, r["value"]) - r["lt"]
        assert r["n"] == len(line)
    pos = ranks.positions(df, ["feature"])
    assert rows(ranks.medians(pos, ["feature"]), "feature", "median") == [
        (g, median(ordered[g])) for g in "ab"]
    got = dict(rows(ranks.quantile(pos, ["feature"], 0.05), "feature", "quantile"))
    assert got == pytest.approx({g: np.percentile(ordered[g], 5) for g in "ab"})


def test_hot_keys_are_few_and_spread_join_loses_nothing(spark):
    fact = spark.range(9000).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then 'none' "
              "else concat('k', id % 500) end as k")
    side = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(500)],
                                 "k string, v int")
    hot = hot_keys(fact.groupBy("k").count(), ["k"], "count")
    assert {r["k"] for r in hot.collect()} == {"hot", "none"}
    got = spread_left_join(fact, side, ["k"], hot)
    assert rows(got, "id", "k", "v") == rows(fact.join(side, "k", "left"), "id", "k", "v")
    scattered = spread_left_join(fact, side, ["k"], hot, scatter=fact["k"] == "none")
    assert rows(scattered, "id", "v") == rows(got, "id", "v")


def test_sketches_are_small_merge_and_err_little(spark):
    df = spark.range(200_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(50_000)) / 7.0).alias("value"),
                                     F.lit(3.0).alias("flat"))
    parts = [ranks.reference_sketches(df.filter(F.col("id") % 3 == i), ["value", "flat"]) for i in range(3)]
    merged = ranks.merged_sketches(*parts)
    sizes = {r.feature: (r.n, len(r.sketch)) for r in merged.collect()}
    assert sizes["value"][0] == 200_000 and sizes["value"][1] < 200_000
    asked = ranks.melt(df.filter("id < 3000"), ["id"], ["value", "flat"])
    near = {(r.id, r.feature): r.pct for r in ranks.sketch_percentile(asked, merged, "id").collect()}
    exact = ranks.left_percentile(asked, ranks.reference_counts(df, ["value", "flat"]), "id").collect()
    worst = max(abs(near[r.id, r.feature] - r.pct) for r in exact)
    assert len(near) == 6000 and worst <= ranks.RANK_ERROR
    other = asked.withColumn("feature", F.lit("never seen"))
    assert {r.pct for r in ranks.sketch_percentile(other, merged, "id").collect()} == {0.5}


def test_left_percentiles_beside_the_rows(spark, monkeypatch):
    """As the long form has them, whether places come to the rows or rows are shuffled to them."""
    rng = np.random.default_rng(9)
    rows = [(i, None if i % 7 == 0 else float(rng.integers(0, 30)), float("nan") if i % 11 == 0 else
             float(rng.normal()), 1.0 if i % 2 else -1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    reference = ranks.reference_counts(df.filter("id % 3 = 0"), {"a": F.col("a"), "b": F.col("b"), "c": F.abs("c")})
    values = {"a": F.col("a"), "b": F.col("b"), "c": F.abs("c"), "d": F.col("a") + 1}
    long = ranks.left_percentile(ranks.melt(df, ["id"], values), reference, "id")
    wanted = {(r["id"], r["feature"]): r["pct"] for r in long.collect()}
    assert wanted[1, "d"] == 0.5   # nothing to compare with
    for held in (10**6, 20, -1):
        monkeypatch.setattr(ranks, "HELD", held)
        asked = df.select("id", *(c.alias(f"_{n}") for n, c in values.items()))
        found = ranks.with_left_percentiles(asked, "id", {n: F.col(f"_{n}") for n in values}, reference).collect()
        assert len(found) == 400
        assert {(r["id"], n): r[n] for r in found for n in values if r[n] is not None} == wanted


def test_rows_are_not_taken_apart_to_be_ranked(spark):
    df = spark.createDataFrame([(f"w{i}", float(i % 5), float(i % 3)) for i in range(50)], "id string, a double, b double")
    reference = ranks.reference_counts(df, ["a", "b"])
    out = ranks.with_left_percentiles(df.select("id", F.col("a").alias("x"), F.col("b").alias("y")), "id",
                                      {"a": F.col("x"), "b": F.col("y")}, reference)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Join") == 2
