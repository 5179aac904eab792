"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from worksrisk import standin
from worksrisk.operators import browse, etl, features, ranks
from worksrisk.plans import scoring
from worksrisk.sources import star as star_io


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["master_features", "composite_rules", "top_reasons",
                                  "doc_flags", "pct_rank_avg", "peer_benchmark", "why_panel",
                                  "work_id_extract", "date_parse", "what_if_overlay"])
def test_no_python_and_no_product(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_ranks_do_not_meet_in_one_task(spark, sf):
    works = standin.star(spark, sf).works
    text = plan(ranks.average_percentile(works, "Work_ID", ["Cost_per_Unit"]))
    assert "Window" in text
    assert not re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", text)


def test_filters_and_columns_reach_the_scan(spark, sf):
    works = standin.star(spark, sf).works
    df = browse.filter_works(works, min_sanction_amount=5.0).select("Work_ID")
    text = plan(df)
    assert "GreaterThanOrEqual(Sanction_Amount,5.0)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(c.split(":")[0] for c in schema.split(",")) == {"Work_ID", "Sanction_Amount"}


def test_state_filter_prunes_partitions(spark, sf):
    works = standin.star(spark, sf).works
    text = plan(browse.filter_works(works, state="asia").select("Work_ID"))
    assert re.search(r"PartitionFilters: \[[^\]]*State", text)


def test_page_keeps_only_its_rows(spark, sf):
    assert "TakeOrderedAndProject" in plan(
        browse.list_works(standin.star(spark, sf).works, skip=10, limit=5))


def test_repeats_are_dropped_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    text = plan(etl.keep_first(df, ["k"], ["id"]))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_master_shuffles_each_export_once(spark):
    from worksrisk.operators import etl
    from worksrisk.sources.raw import ORDER, HouseFiles

    def export(columns):
        return spark.createDataFrame([], f"Work_ID string, {columns}, {ORDER} int")

    files = HouseFiles(
        export("Recommended_Date string, Recommended_Amount double, MP_Name string"),
        export("Sanction_Date string, Sanction_Amount double, Work_Status string"),
        export("Completion_Date string"), export("Disbursed_Amount double, `Vendor Name` string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        master = etl.build_master(files, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        text = master._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 4


def _scanned(df):
    """Rows that the scans of a plan gave out, after row groups were skipped."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    leaves = (plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
              ).collectLeaves()
    for i in range(leaves.size()):
        rows += leaves.apply(i).metrics().get("numOutputRows").get().value()
    return rows


def test_a_point_look_up_skips_row_groups(spark, sf, tmp_path):
    star = standin.star(spark, sf)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "32768")   # many row groups in a small table
    conf.set("parquet.page.size.row.check.min", "50")
    conf.set("parquet.block.size.row.check.min", "50")
    try:
        star_io.write_star(star, str(tmp_path / "s"))
    finally:
        for name in ("parquet.block.size", "parquet.page.size.row.check.min", "parquet.block.size.row.check.min"):
            conf.unset(name)
    works = star_io.read_star(spark, str(tmp_path / "s")).works
    one = works.agg(F.max("Work_ID")).first()[0]
    found = works.filter(F.col("Work_ID") == one)
    assert _scanned(found) < works.count() / 10 and found.count() == 1
    # a key between others that no row has is ruled out by the Bloom filters
    assert _scanned(works.filter(F.col("Work_ID") == one[:-1] + "x")) < works.count() / 10


def test_words_are_counted_once_for_a_search(spark, sf):
    df = entry.queries()["text_duplicates"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "Work_Description" not in plan


def test_few_vendors_reach_works_without_a_shuffle(spark, sf):
    """Whatever the broadcast limit: a table of vendors that a task can hold is brought to the works."""
    star = standin.star(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = features.attach_vendor(star.works, star.vendors)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_mean_zone_risk_needs_no_other_join(spark, sf):
    star, df = standin.star(spark, sf), standin.features(spark, sf)
    near, whole = (scoring.rule_signals(df, zone=z) for z in (scoring.zones(star), None))
    assert near.select("Work_ID", "spatial").exceptAll(whole.select("Work_ID", "spatial")).isEmpty()
    plan = scoring.zones(star).agg(F.avg("Zone_Fraud_Risk_Score"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
