import pytest
from pyspark.sql import functions as F

from worksrisk import schemas as S
from worksrisk import standin
from worksrisk.operators import browse, etl
from worksrisk.operators import features as feat
from worksrisk.sources import star as star_io


def test_expenditure_vendor_rule(spark):
    df = spark.createDataFrame(
        [("w", None, 1.0), ("w", "B", 2.0), ("w", "A", 3.0), ("v", None, 4.0), (None, "C", 5.0)],
        "Work_ID string, `Vendor Name` string, Disbursed_Amount double")
    got = {r["Work_ID"]: (r["Disbursed_Amount"], r["Vendor_Name"])
           for r in etl.expenditure_per_work(df).collect()}
    assert got == {"w": (6.0, "A"), "v": (4.0, "Unknown")}


def test_null_key_is_one_key_and_matches_itself(spark):
    rec = spark.createDataFrame([(None, "a", 2), (None, "b", 1), ("x", "c", 3)],
                                "Work_ID string, v string, o int")
    first = etl.keep_first(rec, ["Work_ID"], ["o"])
    assert sorted(r["v"] for r in first.collect()) == ["b", "c"]
    san = spark.createDataFrame([(None, "2024", 5.0, "Sanction")],
                                "Work_ID string, Sanction_Date string, Sanction_Amount double, "
                                "Work_Status string")
    com = spark.createDataFrame([], "Work_ID string, Completion_Date string")
    exp = spark.createDataFrame([], "Work_ID string, `Vendor Name` string, Disbursed_Amount double")
    got = {r["v"]: r["Sanction_Amount"] for r in etl.join_master(first, san, com, exp).collect()}
    assert got == {"b": 5.0, "c": 0.0}


def test_dimensions(spark):
    df = spark.createDataFrame(
        [("M", "w1", "V", "S", "C", 10.0, 5.0, 4.0, 3, 1.5, "2024"),
         ("M", "w2", "V", "S", "D", 0.0, 5.0, 4.0, None, None, None),
         ("N", "w3", "Unknown", None, "C", 0.0, 5.0, 4.0, 7, None, None),
         (None, "w4", "V", "R", "C", 1.0, 1.0, 1.0, 5, None, None)],
        "MP_Name string, Work_ID string, Vendor_Name string, State string, Constituency string, "
        "Recommended_Amount double, Sanction_Amount double, Disbursed_Amount double, "
        "Days_to_Complete int, Cost_Overrun_Ratio double, Completion_Date string")
    members = {r["MP_Name"]: r for r in etl.member_dimension(df).collect()}
    assert set(members) == {"M", "N"}
    assert members["M"]["MP_Completion_Rate"] == 50 and members["M"]["MP_Performance_Rank"] == 1
    assert members["M"]["MP_Budget_Utilization_Percent"] == 80
    assert members["N"]["MP_Budget_Utilization_Percent"] == 0
    vendor = etl.vendor_dimension(df).collect()
    assert [(r["Vendor_Name"], r["Vendor_Total_Projects_Count"], r["Vendor_Avg_Timeline_Days"],
             r["Vendor_Avg_Cost_Overrun_Ratio"]) for r in vendor] == [("V", 3, 4.0, 1.5)]
    places = etl.geography_dimension(df).orderBy("Constituency_ID").collect()
    assert [(r["State"], r["Constituency"], r["Constituency_ID"]) for r in places] == [
        (None, "C", "CONST_0"), ("R", "C", "CONST_1"), ("S", "C", "CONST_2"), ("S", "D", "CONST_3")]
    with_id = etl.attach_constituency_id(df, etl.geography_dimension(df))
    assert with_id.filter("Constituency_ID is null").count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_star_is_read_back_as_written(spark, sf, tmp_path, fmt):
    star = standin.star(spark, sf)
    star_io.write_star(star, str(tmp_path / "s"), fmt=fmt)
    again = star_io.read_star(spark, str(tmp_path / "s"), fmt=fmt)
    for name, df in again.tables().items():
        assert set(df.columns) <= set(S.STAR[name].names)
        columns = [c for c in df.columns if df.schema[c].dataType.typeName() != "double"]
        assert df.select(columns).exceptAll(star.tables()[name].select(columns)).count() == 0


def test_issue_text_none_reads_back_as_missing(spark, tmp_path):
    df = spark.createDataFrame([("w", "None", "NA")],
                               "Work_ID string, Issues_Encountered string, NOC_Status string")
    df.write.option("header", True).csv(str(tmp_path / "c.csv"))
    got = star_io.read_table(spark, str(tmp_path / "c.csv"), S.COMPLIANCE, "csv").first()
    assert got["Issues_Encountered"] is None and got["NOC_Status"] is None


def test_absent_duplicate_scores(spark, tmp_path):
    assert star_io.read_duplicates(spark, str(tmp_path / "none")) is None
    assert star_io.read_index(spark, str(tmp_path / "none")) is None


def test_imputation_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 10.0), (3, None, 20.0), (4, 8.0, None)],
                               "i int, Vendor_Avg_Cost_Overrun_Ratio double, "
                               "Vendor_Avg_Timeline_Days double")
    values = feat.median_values(feat.feature_medians(df))
    assert values == {"Vendor_Avg_Cost_Overrun_Ratio": 3.0, "Vendor_Avg_Timeline_Days": 15.0}
    got = {r["i"]: r for r in feat.impute_vendor_features(df, values).collect()}
    assert got[3]["Vendor_Avg_Cost_Overrun_Ratio"] == 3.0
    assert got[3]["Vendor_Avg_Cost_Overrun_Ratio_missing"] is True
    assert got[1]["Vendor_Avg_Timeline_Days"] == 15.0 and len(got) == 4


# --------------------------------------------------------------------- browse
def test_pages_cover_the_sorted_whole(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 1.0), ("e", 2.0)],
                               "Vendor_Name string, Vendor_Risk_Score double")

    def page(skip, **options):
        got = browse.sorted_page(df, "Vendor_Risk_Score", S.SORTABLE_VENDORS, tie=["Vendor_Name"],
                                 skip=skip, limit=2, **options).collect()
        return [r["Vendor_Name"] for r in got]

    assert page(0, descending=True) + page(2, descending=True) + page(4, descending=True) == [
        "c", "e", "a", "d", "b"]
    assert page(0, descending=False) + page(2, descending=False) + page(4, descending=False) == [
        "a", "d", "e", "c", "b"]
    assert page(9, descending=True) == [] and browse.total(df).first()["total"] == 5


def test_unknown_sort_column_and_page_bounds(spark, sf):
    works = standin.star(spark, sf).works
    with pytest.raises(ValueError):
        browse.list_works(works, sort_by="Work_Description")
    with pytest.raises(ValueError):
        browse.list_works(works, limit=501)


def test_details_of_nothing_are_empty(spark, sf):
    star = standin.star(spark, sf)
    assert browse.work_detail(star, "no such work").count() == 0
    assert browse.constituency_detail(star.geography, "x", "y").count() == 0
    assert browse.vendor_sample(star, "nobody").count() == 0
    none = browse.vendor_sample(star, "supplier#000000003", works_limit=0).first()
    assert none["works_sample"] == [] and none["works_count"] > 0


def test_value_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("x", "s"), (None, "s")], "Work_Status string, State string")
    got = browse.value_counts(df, ("Work_Status", "State")).collect()
    assert sorted((r["field"], r["value"], r["n"]) for r in got) == [
        ("State", "s", 2), ("Work_Status", "x", 1)]


def test_retention(spark):
    df = spark.createDataFrame([(1.0, 1, 0.0), (None, 1, 0.0)],
                               "Cost_per_Unit double, Days_to_Sanction int, Progress_Gap double")
    assert tuple(feat.retention(df).first()) == (2, 1)
    assert feat.drop_incomplete(df).count() == 1


def test_lists_filter_by_flag_and_amount(spark, sf):
    works = standin.star(spark, sf).works
    got = browse.filter_works(works, calamity_flag=True, min_sanction_amount=1000.0)
    bad = got.filter(~F.col("Calamity_Flag") | (F.col("Sanction_Amount") < 1000))
    assert got.count() > 0 and bad.count() == 0
