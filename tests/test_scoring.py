from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from worksrisk import schemas as S
from worksrisk import standin
from worksrisk.operators import models
from worksrisk.plans import scoring


@pytest.fixture(scope="module")
def engine(spark, sf):
    few = models.train_cross_check(standin.composite(spark, sf), trees=8, depth=4, rate=0.3, together=2)
    return standin.engine(spark, sf, few)   # the queries use 300 trees


@pytest.fixture(scope="module")
def some(engine):
    return engine.star.works.orderBy("Work_ID").limit(6).select("Work_ID", "Vendor_Name",
                                                               "Constituency", "Work_Description")


def known(engine, row):
    return engine.star.works.filter(F.col("Work_ID") == row["Work_ID"]).first()


def test_overlay_puts_the_request_on_top(spark, engine, some):
    first, second = some.limit(2).collect()
    asked = spark.createDataFrame(
        [(first["Work_ID"], "Pending", None, None), (second["Work_ID"], None, 5.0, "Sanction"),
         ("NEW/1", None, 10.0, None), (None, None, None, None)],
        "Work_ID string, NOC_Status string, Disbursed_Amount double, Work_Status string")
    got = {r["Work_ID"]: r for r in scoring.overlay(asked, engine.star).collect()}
    assert set(got) == {first["Work_ID"], second["Work_ID"], "NEW/1"}
    one, two, new = got[first["Work_ID"]], got[second["Work_ID"]], got["NEW/1"]
    assert one["NOC_Status"] == "Pending" and one["on_record"]
    assert one["Vendor_Name"] == first["Vendor_Name"]
    assert two["Disbursed_Amount"] == 5.0
    stored = known(engine, second)["Sanction_Amount"]
    paid = min(5.0 / stored, 1.5) if stored else 0.0
    assert two["Progress_Gap"] == pytest.approx(paid - 0.15)
    assert new["on_record"] is False and new["Progress_Gap"] == 0.0


def test_request_without_fields(spark, engine):
    with pytest.raises(ValueError):
        scoring.overlay(spark.createDataFrame([(1,)], "request_id int"), engine.star)


def test_enrich_looks_up_the_vendor(spark, engine, some):
    row = some.filter("Vendor_Name <> 'Unknown'").first()
    asked = spark.createDataFrame([("NEW/1", row["Vendor_Name"])],
                                  "Work_ID string, Vendor_Name string")
    plain = scoring.overlay(asked, engine.star).first()
    rich = scoring.overlay(asked, engine.star, enrich=True).first()
    assert plain["Vendor_Risk_Score"] is None and rich["Vendor_Risk_Score"] is not None


def test_suspicious_new_work_scores_high_and_finds_its_copy(spark, engine, some):
    row = some.filter("Vendor_Name <> 'Unknown'").first()
    asked = spark.createDataFrame(
        [("TEST/NEW/1", row["Vendor_Name"], row["Constituency"], row["Work_Description"],
          "Vendor Identification", 500000.0, 480000.0, 999999.0, 2, 20.0, "Pending", "",
          "Vendor issues"),
         ("TEST/NEW/2", row["Vendor_Name"], row["Constituency"], "", "Vendor Identification",
          500000.0, 175000.0, 1000.0, 25, 100.0, "Received",
          "Site Plan, NOC, Utilization Cert", None)],
        "Work_ID string, Vendor_Name string, Constituency string, Work_Description string, "
        "Work_Status string, Sanction_Amount double, Disbursed_Amount double, "
        "Cost_per_Unit double, Days_to_Sanction int, Compliance_Score double, "
        "NOC_Status string, Documents_Submitted string, Issues_Encountered string")
    got = {r["work_id"]: r for r in scoring.score_works(asked, engine).collect()}
    bad, good = got["TEST/NEW/1"], got["TEST/NEW/2"]
    assert bad["components"]["compliance"] == pytest.approx(88.5)
    assert bad["components"]["duplicate"] == 100 and bad["duplicate_detail"]["checked"]
    assert bad["components"]["spatial"] == 47
    assert bad["components"]["contractor"] == pytest.approx(41.07)
    assert good["components"]["compliance"] == 0 and not good["duplicate_detail"]["checked"]
    assert bad["final_risk_score"] > good["final_risk_score"] + 30
    # the duplicate ties with the anomaly at 100, and comes after it in the fixed order
    assert len(bad["top_risk_factors"]) == 3
    assert "cosine similarity 1.00" in bad["top_risk_factors"][1]


def test_scores_of_stored_works(engine, some):
    got = scoring.score_works(some.select("Work_ID"), engine).collect()
    assert len(got) == 6
    for r in got:
        parts = r["components"].asDict()
        total = sum(S.RISK_WEIGHTS[k] * parts[k] for k in parts)
        assert r["final_risk_score"] == pytest.approx(total, abs=0.02)
        assert all(0 <= v <= 100 for v in parts.values())
        assert 0 <= r["cross_check_score"] <= 100


def test_reports(spark, engine, some):
    asked = some.select("Work_ID").unionByName(
        spark.createDataFrame([("no such work",)], "Work_ID string"))
    got = {r["work_id"]: r for r in scoring.investigate(asked, engine).collect()}
    assert set(got) == {r["Work_ID"] for r in some.collect()}
    for work_id, r in got.items():
        assert r["recommended_action"] == S.ACTIONS[r["risk_level"]]
        assert len(r["nearby_similar_works"]) == 5
        assert work_id not in [w["work_id"] for w in r["nearby_similar_works"]]
        near = [w["similarity"] for w in r["nearby_similar_works"]]
        assert near == sorted(near, reverse=True)
        scores = [w["score"] for w in r["why"]]
        assert scores == sorted(scores, reverse=True) and all(s >= 40 for s in scores)
        bench = r["historical_benchmark"]
        assert bench["peer_group_size"] > 0 and 0 <= bench["cost_percentile_vs_peers"] <= 1


def test_report_without_vectors_or_duplicates(engine, some):
    bare = replace(engine, duplicates=None, index=None, text=None)
    got = scoring.investigate(some.select("Work_ID"), bare).collect()
    assert all(r["nearby_similar_works"] == [] for r in got)
    assert all(r["contractor_history"]["other_flagged_duplicate_count"] is None for r in got)


def test_benchmark_edges(spark):
    works = spark.createDataFrame(
        [("a", "m", 2.0), ("b", "m", 4.0), ("c", "m", None), ("d", "m", 0.0), ("e", None, 3.0)],
        "Work_ID string, Work_Scope_Unit string, Cost_per_Unit double")
    got = {r["Work_ID"]: r for r in scoring.benchmark(works, works).collect()}
    assert got["b"]["peer_group_size"] == 4 and got["b"]["peer_median_cost_per_unit"] == 2.0
    assert got["b"]["cost_percentile_vs_peers"] == 0.5
    assert got["b"]["cost_vs_peer_median_ratio"] == 2.0
    assert got["c"]["cost_percentile_vs_peers"] == 0 and got["c"]["cost_vs_peer_median_ratio"] is None
    assert got["d"]["cost_vs_peer_median_ratio"] is None
    assert got["e"]["peer_group_size"] == 0 and got["e"]["cost_percentile_vs_peers"] is None
    whole = {r["Work_ID"]: r for r in
             scoring.benchmark(works, works, no_unit_means_all=True).collect()}
    assert whole["e"]["peer_group_size"] == 5 and whole["e"]["cost_percentile_vs_peers"] == 0.4
    assert whole["b"]["peer_group_size"] == 4


def test_missing_features_count_as_the_middle(spark):
    columns = list(S.REFERENCE_FEATURES)
    reference = spark.createDataFrame([(c, float(v), 1) for c in columns for v in (-2, 0, 1, 3)],
                                      "feature string, value double, eq long")
    rows = spark.createDataFrame([("a", None, None, None, None, None), ("b", 2.0, 0.5, 0.0, -2.5, 9.0)],
                                 "Work_ID string, " + ", ".join(f"{c} double" for c in columns))
    got = {r["Work_ID"]: tuple(r)[1:] for r in
           scoring.feature_anomalies(rows, reference).collect()}
    assert got == {"a": (50.0, 50.0), "b": (100.0, 75.0)}


def test_spatial_gap_takes_the_batch_mean(spark):
    df = spark.createDataFrame([(10.0,), (None,), (30.0,)], "Zone_Fraud_Risk_Score double")
    for c, kind in (("Documents_Submitted", "string"), ("NOC_Status", "string"),
                    ("Issues_Encountered", "string"), ("Compliance_Score", "double"),
                    ("Vendor_Risk_Score", "double"), ("Vendor_Monopoly_Score", "double"),
                    ("Vendor_Quality_Rating", "double"), ("Vendor_Total_Projects_Count", "long")):
        df = df.withColumn(c, F.lit(None).cast(kind))
    assert sorted(r["spatial"] for r in scoring.rule_signals(df).collect()) == [10, 20, 30]
    single = scoring.rule_signals(df, batch=False).collect()
    assert sorted(r["spatial"] for r in single) == [10, 30, 47]


def test_composite_is_the_weighted_sum(spark, sf):
    bad = standin.composite(spark, sf).withColumn(
        "sum", 0.25 * F.col("anomaly") + 0.2 * F.col("compliance") + 0.2 * F.col("contractor")
        + 0.15 * F.col("spatial") + 0.2 * F.col("duplicate_risk_score")).filter(
        (F.abs(F.col("sum") - F.col("composite")) > 1e-9) | ~F.col("composite").between(0, 100))
    assert bad.count() == 0


def test_cross_check_learns_and_survives_storage(spark, sf, tmp_path):
    df = standin.composite(spark, sf)
    model = models.train_cross_check(df, trees=8, depth=4, rate=0.3, together=2)
    assert model.metrics["r2"] > 0.35
    model.save(str(tmp_path / "x"))
    again = models.CrossCheck.load(spark, str(tmp_path / "x"))
    some = df.orderBy("Work_ID").limit(20)
    for frame in (some, some.withColumn("NOC_Status", F.lit("never seen"))):
        old = {r["Work_ID"]: r["cross_check"] for r in model.predict(frame, "Work_ID").collect()}
        new = {r["Work_ID"]: r["cross_check"] for r in again.predict(frame, "Work_ID").collect()}
        assert old == new and all(0 <= v <= 100 for v in old.values())


def test_split_is_stable_and_about_four_fifths(spark, sf):
    works = standin.star(spark, sf).works
    learn, test = models.split(works)
    other, _ = models.split(works.repartition(3))
    assert learn.select("Work_ID").exceptAll(other.select("Work_ID")).count() == 0
    assert 0.75 < learn.count() / works.count() < 0.85
    assert learn.count() + test.count() == works.count()


def test_baseline(spark, sf):
    compliance = standin.star(spark, sf).compliance
    found = models.train_baseline(compliance, trees=5, depth=4)
    assert set(found.metrics) == {"mse", "r2"} and found.metrics["r2"] < 0.3
    assert models.importances(found.model, models.baseline_frame(compliance), 3).count() == 3
