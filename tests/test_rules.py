import pytest
from pyspark.sql import functions as F

from worksrisk import schemas as S
from worksrisk.functions import rules


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def lit(v, kind="double"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize("early, late, days", [
    ("2024-01-01 23:00:00", "2024-01-03 10:00:00", 1),
    ("2024-01-03 10:00:00", "2024-01-01 23:00:00", -2),
    ("2024-03-01 00:00:00", "2024-04-01 00:00:00", 31),
    ("2024-01-01 00:00:00", "2024-01-01 00:00:00", 0),
])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_whole_days_rounds_down_in_any_zone(spark, zone, early, late, days):
    stamp = [lit(t, "timestamp_ntz") for t in (late, early)]
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert value(spark, rules.whole_days(*stamp)) == days
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_overruns(spark):
    partly = F.lit("Work partially Completed")
    assert value(spark, rules.overrun_ratio(partly, lit(120), lit(100))) == pytest.approx(1.2)
    assert value(spark, rules.overrun_ratio(partly, lit(120), lit(0))) is None
    assert value(spark, rules.overrun_ratio(F.lit("Sanction"), lit(120), lit(100))) is None
    assert value(spark, rules.overrun_amount(partly, lit(120), lit(0))) == 120
    assert value(spark, rules.cost_per_unit(lit(10), lit(0))) == 0


@pytest.mark.parametrize("paid, sanctioned, status, expected", [
    (480000, 500000, "Vendor Identification", 0.61), (900, 100, "Sanction", 1.35),
    (5, 0, "Physical Inspection", -0.65), (50, 100, "whatever", 0.5), (None, 10, "Sanction", -0.15),
])
def test_progress_gap(spark, paid, sanctioned, status, expected):
    gap = rules.progress_gap(lit(paid), lit(sanctioned), F.lit(status))
    assert value(spark, gap) == pytest.approx(expected)


@pytest.mark.parametrize("similarity, expected", [(0.85, 0), (0.915, 50), (0.98, 100), (0.99, 100)])
def test_similarity_risk(spark, similarity, expected):
    assert value(spark, rules.similarity_risk(lit(similarity))) == pytest.approx(expected)


def test_documents_by_count_and_by_name(spark):
    flags = rules.document_flags(F.lit("X,Y,Z"), F.lit("Vendor issues"))
    assert value(spark, flags["Docs_Missing_Count"]) == 0
    assert value(spark, rules.missing_required(F.lit("X,Y,Z"))) == 3
    assert value(spark, flags["Issue_Vendor_issues"]) is True
    assert value(spark, flags["Doc_NOC"]) is False


@pytest.mark.parametrize("score, level", [(75, "Critical"), (74.99, "High"), (50, "High"),
                                          (25, "Medium"), (0, "Low")])
def test_levels(spark, score, level):
    assert value(spark, rules.risk_level(lit(score))) == level
    assert value(spark, rules.recommended_action(F.lit(level))) == S.ACTIONS[level]


@pytest.mark.parametrize("score, name", [(70, "critical"), (40, "warning"), (39.9, None)])
def test_severity(spark, score, name):
    assert value(spark, rules.severity(lit(score))["severity"]) == name


def test_compliance(spark):
    def score(*cells):
        docs, noc, issues, points = cells
        return value(spark, rules.compliance_score(
            lit(docs, "string"), lit(noc, "string"), lit(issues, "string"), lit(points)))

    every = "Site Plan, NOC, Utilization Cert"
    assert score("", "Pending", "Vendor issues", 20) == pytest.approx(88.5)
    assert score(every, "Received", None, 100) == 0
    assert score(every, None, None, 100) == pytest.approx(12)
    assert score("Site Plan", "Pending", None, 40) > score(every, "Received", None, 95.5)


def test_contractor_tells_absent_from_empty(spark):
    nothing = [lit(None)] * 4
    assert value(spark, rules.contractor_score(*nothing)) == pytest.approx(50.0714285714)
    assert value(spark, rules.contractor_score(*nothing, F.lit(False))) == pytest.approx(41.0714285714)


def test_spatial(spark):
    assert value(spark, rules.spatial_score(lit(None))) == 47
    assert value(spark, rules.spatial_score(lit(None), lit(20))) == 20
    assert value(spark, rules.spatial_score(lit(120))) == 100


def test_composite_needs_weights_that_sum_to_one(spark):
    parts = {k: lit(100.0) for k in S.RISK_WEIGHTS}
    assert value(spark, rules.composite(parts)) == pytest.approx(100)
    with pytest.raises(ValueError):
        rules.composite(parts, {"anomaly": 0.5, "spatial": 0.4})


def reasons(spark, checked=True, **scores):
    parts = {k: lit(float(scores.get(k, 0))) for k in S.RISK_WEIGHTS}
    return value(spark, rules.top_reasons(parts, F.lit(checked), F.lit("W1"), lit(0.9)))


def test_three_heaviest_reasons(spark):
    got = reasons(spark, compliance=50, contractor=60, anomaly=60, spatial=61, duplicate=50)
    assert [g.split(" ")[0] for g in got] == ["Located", "Vendor", "Compliance"]
    assert reasons(spark) == [rules.NO_REASON]
    assert "0.90) to work W1" in reasons(spark, duplicate=5)[0]
    assert reasons(spark, checked=False, duplicate=5) == [rules.NO_REASON]


def test_disagreement_note(spark):
    assert value(spark, rules.disagreement_note(lit(80), lit(50)))[0].startswith("Note:")
    assert value(spark, rules.disagreement_note(lit(70), lit(50))) == []


def test_why_panel_orders_by_score(spark):
    panel = value(spark, rules.why_panel(lit(90), lit(39.9), lit(90.001), lit(45), F.lit(True),
                                         F.lit("W2"), lit(0.954)))
    assert [(w["label"], w["severity"], w["score"]) for w in panel] == [
        ("Duplicate similarity", "critical", 90.0), ("Timeline anomaly", "critical", 90.0),
        ("Compliance gaps", "warning", 45.0)]
    assert panel[0]["detail"] == "Similarity 0.95 to W2"
