"""Registered queries: each wires one or more operators to the given tables."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle_queries import ORACLES
from worksrisk import schemas as S
from worksrisk import standin
from worksrisk.functions import cells, rules
from worksrisk.operators import boosting, browse, etl, iforest, models, ranks, similarity, texts
from worksrisk.operators import features as feat
from worksrisk.plans import scoring
from worksrisk.session import storage_folder, stored
from worksrisk.sources import raw
from worksrisk.sources import star as star_io


def _optional(name: str):
    """A module of the training-data operators, or None if they have been taken out.

    The library works without them; an import that fails for another reason is an error.
    """
    try:
        return importlib.import_module(name)
    except ImportError as missing:
        if missing.name in ("worksrisk.llm", "worksrisk.llm.queries", "corpus_pipeline"):
            return None
        raise


llm_queries = _optional("worksrisk.llm.queries")
corpus_pipeline = _optional("corpus_pipeline")

Query = Callable[[SparkSession, str], DataFrame]

WORK_COLUMNS = ["Work_ID", "House", "MP_Name", "Vendor_Name", "State", "Constituency",
                "Work_Status", "Sanction_Amount", "Disbursed_Amount"]


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# ------------------------------------------------------------------- clean-up
def work_id_extract(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("l_linenumber") % 4
    cell = (F.when(step == 0, F.concat(F.lit("WS/ MP"), "l_suppkey", F.lit("/2024-2025/"),
                                       "l_orderkey", F.lit("-Road")))
            .when(step == 1, F.concat(F.lit("AB "), "l_orderkey", F.lit("-"), "l_returnflag",
                                      F.lit("-x")))
            .when(step == 2, F.concat(F.lit(" work\t "), "l_partkey", F.lit(" "))))
    return standin.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        cells.work_id(cell).alias("work_id")).distinct()


def currency_clean(spark: SparkSession, sf: str) -> DataFrame:
    kind, price = F.col("o_orderkey") % 4, F.col("o_totalprice")
    cell = (F.when(kind == 0, F.concat(F.lit(" ₹ "), F.format_number(price, 2)))
            .when(kind == 1, F.floor(price).cast("string"))
            .when(kind == 2, F.concat(F.floor(price).cast("string"), F.lit("d"))))
    return standin.table(spark, sf, "orders").select(
        "o_orderkey", cells.currency(cell).alias("amount"))


def token_split(spark: SparkSession, sf: str) -> DataFrame:
    found = cells.tokens(F.col("text"))
    return standin.table(spark, sf, "documents").select(
        "doc_id", F.size(found).cast("long").alias("n_tokens"),
        F.try_element_at(found, F.lit(1)).alias("first_token"))


def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    kind, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    cell = (F.when(kind == 0, F.date_format(day, "dd-MMM-yyyy"))
            .when(kind == 1, F.date_format(day, "dd/MM/yyyy"))
            .when(kind == 2, F.date_format(day, "yyyy-MM-dd"))
            .when(kind == 3, F.date_format(day, "dd-MM-yyyy")).otherwise(F.lit("junk")))
    return standin.table(spark, sf, "orders").select(
        "o_orderkey", cells.day_first_timestamp(cell).alias("parsed"))


# ------------------------------------------------------------------------ ETL
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    lines = standin._lines(spark, sf)
    return etl.keep_first(lines, ["Work_ID"], [raw.ORDER]).select(
        "Work_ID", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def expenditure_per_work(spark: SparkSession, sf: str) -> DataFrame:
    return etl.expenditure_per_work(standin.exports(spark, sf).expenditure)


def master_join(spark: SparkSession, sf: str) -> DataFrame:
    return etl.build_master(standin.exports(spark, sf, keyed=True), standin.as_of()).select(
        "Work_ID", "House", "MP_Name", "Vendor_Name", "State", "Constituency",
        "Work_Description", "Work_Status", "Recommended_Date", "Sanction_Date",
        "Completion_Date", "Recommended_Amount", "Sanction_Amount", "Disbursed_Amount")


def etl_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Write the four exports of both houses as raw CSV, then run the whole ETL on them."""
    houses = []
    for house in ("Lok Sabha", "Rajya Sabha"):
        folder = standin.write_csv_exports(spark, sf, house)
        houses.append(raw.read_house(spark, folder, house))
    master = etl.build_master(raw.union_houses(houses), standin.as_of())
    return master.select(
        "Work_ID", "House", "Elected_or_Nominated", "MP_Name", "Vendor_Name", "State",
        "Constituency", "Work_Description", "Work_Status", "Recommended_Date", "Sanction_Date",
        "Completion_Date", "Days_to_Sanction", "Days_to_Complete", "Days_Pending",
        "Recommended_Amount", "Sanction_Amount", "Disbursed_Amount", "Cost_Overrun_Amount")


def star_roundtrip_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Write the star schema as packed CSV and read it back with its declared types."""
    folder = f"{storage_folder(spark)}/star-csv-{spark.sparkContext.applicationId}"
    folder = f"{folder}/{sf.rstrip('/').rsplit('/', 1)[-1]}"
    star_io.write_star(standin.star(spark, sf), folder, fmt="csv", mode="overwrite",
                       compression="gzip")
    return star_io.read_star(spark, folder, fmt="csv").works.select(
        "Work_ID", "Constituency_ID", "Calamity_Flag", "Recommended_Date", "Completion_Date",
        "Days_to_Sanction", "Days_to_Complete", "Days_Pending", "Sanction_Amount",
        "Work_Quantity")


def date_spans(spark: SparkSession, sf: str) -> DataFrame:
    return standin.master(spark, sf).select(
        "Work_ID", "Days_to_Sanction", "Days_to_Complete", "Days_Pending")


def overruns(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(standin.master(spark, sf).select(
        "Work_ID", "Cost_Overrun_Amount", "Cost_Overrun_Ratio", "Cost_per_Unit"),
        {"Cost_Overrun_Ratio": 9, "Cost_per_Unit": 6})


def mp_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(etl.member_dimension(standin.master(spark, sf)),
                    {"MP_Completion_Rate": 9, "MP_Budget_Utilization_Percent": 9})


def vendor_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(etl.vendor_dimension(standin.master(spark, sf)),
                    {"Vendor_Avg_Timeline_Days": 6, "Vendor_Avg_Cost_Overrun_Ratio": 6})


def geo_keys(spark: SparkSession, sf: str) -> DataFrame:
    return etl.geography_dimension(standin.exports(spark, sf).recommended)


# --------------------------------------------------------------------- browse
def list_works(spark: SparkSession, sf: str) -> DataFrame:
    return browse.list_works(standin.star(spark, sf).works, skip=100).select(*WORK_COLUMNS)


def list_works_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return browse.list_works(
        standin.star(spark, sf).works, state="asia", work_status="WORK COMPLETED", search="Ring",
        min_sanction_amount=20000, max_sanction_amount=90000, calamity_flag=False,
        sort_by="Disbursed_Amount", descending=True, limit=100).select(*WORK_COLUMNS)


def works_total(spark: SparkSession, sf: str) -> DataFrame:
    return browse.total(browse.filter_works(standin.star(spark, sf).works, search="Ring"))


def list_members(spark: SparkSession, sf: str) -> DataFrame:
    return browse.list_members(standin.star(spark, sf).members, search="#0000000").select(
        "MP_Name", "MP_Total_Projects", "MP_Performance_Rank")


def list_vendors(spark: SparkSession, sf: str) -> DataFrame:
    return browse.list_vendors(standin.star(spark, sf).vendors, min_risk_score=20).select(
        "Vendor_Name", "Vendor_Total_Projects_Count",
        F.round("Vendor_Risk_Score", 6).alias("Vendor_Risk_Score"))


def list_geography(spark: SparkSession, sf: str) -> DataFrame:
    return browse.list_geography(standin.star(spark, sf).geography, min_zone_risk=30).select(
        "State", "Constituency", "Constituency_ID", "Zone_Fraud_Risk_Score")


def work_detail(spark: SparkSession, sf: str) -> DataFrame:
    star = standin.star(spark, sf)
    first = star.works.agg(F.min("Work_ID")).first()[0]
    return browse.work_detail(star, first).select(
        "Work_ID", "Vendor_Name", "Constituency_ID", "Spatial_Cluster_ID", "NOC_Status",
        F.round("Progress_Gap", 9).alias("Progress_Gap"), "Vendor_Total_Projects_Count")


def constituency_detail(spark: SparkSession, sf: str) -> DataFrame:
    geography = standin.star(spark, sf).geography
    first = browse.list_geography(geography, state="ASIA", sort_by="Constituency",
                                  descending=False, limit=1).first()
    return browse.constituency_detail(geography, "Asia", first["Constituency_ID"].lower()).select(
        "State", "Constituency", "Constituency_ID", "Zone_Fraud_Risk_Score")


def member_detail(spark: SparkSession, sf: str) -> DataFrame:
    return browse.member_works(standin.star(spark, sf), "customer#000000007").select(
        "MP_Name", "MP_Total_Projects", "MP_Performance_Rank", "Work_ID", "Work_Status", "State",
        "Constituency", "Sanction_Amount", "Disbursed_Amount")


def vendor_detail(spark: SparkSession, sf: str) -> DataFrame:
    detail = browse.vendor_sample(standin.star(spark, sf), "SUPPLIER#000000003")
    return (detail.withColumn("w", F.explode("works_sample"))
            .select("Vendor_Name", "Vendor_Total_Projects_Count", "works_count", "w.Work_ID",
                    "w.Work_Status", "w.Sanction_Amount"))


def overview(spark: SparkSession, sf: str) -> DataFrame:
    return browse.overview(standin.star(spark, sf))


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return browse.value_counts(standin.star(spark, sf).works)


# ------------------------------------------------------------------- features
def master_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(standin.features(spark, sf).select(
        "Work_ID", "Constituency_ID", "Spatial_Cluster_ID", "Vendor_Total_Projects_Count",
        "Vendor_Risk_Score", "NOC_Status", "Compliance_Score", "Progress_Gap",
        "Docs_Submitted_Count", "Issues_Count"),
        {"Vendor_Risk_Score": 6, "Compliance_Score": 6, "Progress_Gap": 9})


def progress_gap(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(feat.add_progress_gap(standin.star(spark, sf).works)
                    .select("Work_ID", "Progress_Gap"), {"Progress_Gap": 9})


def doc_flags(spark: SparkSession, sf: str) -> DataFrame:
    return feat.add_document_flags(standin.star(spark, sf).compliance).select(
        "Work_ID", "Doc_Site_Plan", "Doc_Utilization_Cert", "Doc_NOC", "Docs_Submitted_Count",
        "Docs_Missing_Count", "Issue_Weather_delays", "Issue_Vendor_issues", "Issues_Count")


def impute_vendor(spark: SparkSession, sf: str) -> DataFrame:
    df = stored(standin.features(spark, sf).select("Work_ID", *S.IMPUTED_FEATURES))
    filled = feat.impute_vendor_features(df, feat.median_values(feat.feature_medians(df)))
    return _rounded(filled.select(
        "Work_ID", "Vendor_Avg_Cost_Overrun_Ratio", "Vendor_Avg_Timeline_Days",
        "Vendor_Avg_Cost_Overrun_Ratio_missing", "Vendor_Avg_Timeline_Days_missing"),
        {"Vendor_Avg_Cost_Overrun_Ratio": 6, "Vendor_Avg_Timeline_Days": 6})


def retention(spark: SparkSession, sf: str) -> DataFrame:
    return feat.retention(feat.add_progress_gap(standin.star(spark, sf).works))


# -------------------------------------------------------------------- signals
def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.rule_signals(standin.features(spark, sf), zone=scoring.zones(standin.star(spark, sf)))


def _signal(name: str) -> Query:
    return lambda spark, sf: _signals(spark, sf).select(
        "Work_ID", F.round(name, 6).alias(name))


def composite_rules(spark: SparkSession, sf: str) -> DataFrame:
    parts = {n: F.col(n) for n in ("compliance", "contractor", "spatial")}
    parts |= {"anomaly": F.lit(0.0), "duplicate": F.lit(0.0)}
    return _signals(spark, sf).select(
        "Work_ID", F.round(rules.composite(parts), 6).alias("composite"))


def risk_level(spark: SparkSession, sf: str) -> DataFrame:
    level = rules.risk_level(F.col("compliance"))
    return _signals(spark, sf).select("Work_ID", level.alias("level"),
                                      rules.recommended_action(level).alias("action"))


def severity(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).select(
        "Work_ID", rules.severity(F.col("contractor"))["severity"].alias("severity"))


def top_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The leading words of the reasons, without the two signals that need a model."""
    parts = {n: F.col(n) for n in ("compliance", "contractor", "spatial")}
    parts |= {"anomaly": F.lit(0.0), "duplicate": F.lit(0.0)}
    texts = rules.top_reasons(parts, F.lit(False), F.lit(None).cast("string"), F.lit(0.0))
    heads = F.transform(texts, lambda t: F.regexp_extract(
        t, "^(Compliance gaps|Vendor track record risk|Located in a geographic zone"
           "|No individual signal)", 1))
    return _signals(spark, sf).select("Work_ID", heads.alias("h")).select(
        "Work_ID", *(F.get("h", F.lit(i)).alias(n)
                     for i, n in enumerate(("first", "second", "third"))))


# ---------------------------------------------------------------------- ranks
def _events(spark: SparkSession, sf: str) -> DataFrame:
    return standin.table(spark, sf, "events").select("event_id", "event_type", "value")


def pct_rank_avg(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.average_percentile(_events(spark, sf), "event_id", ["value"]).select(
        "event_id", F.round("pct", 9).alias("pct"))


def pct_vs_reference(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    reference = ranks.reference_counts(events.filter("event_type = 'click'"), ["value"])
    asked = ranks.melt(events, ["event_id"], ["value"])
    return ranks.left_percentile(asked, reference, "event_id").select(
        "event_id", F.round("pct", 9).alias("pct"))


def pct_vs_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a percentile by a sketch of two halves is within its bound of the exact one."""
    events = _events(spark, sf)
    clicks = events.filter("event_type = 'click'")
    halves = [ranks.reference_sketches(clicks.filter(F.col("event_id") % 2 == i), ["value"]) for i in (0, 1)]
    asked = ranks.melt(events, ["event_id"], ["value"])
    near = ranks.sketch_percentile(asked, ranks.merged_sketches(*halves), "event_id")
    exact = ranks.left_percentile(asked, ranks.reference_counts(clicks, ["value"]), "event_id")
    return near.join(exact.select("event_id", F.col("pct").alias("exact")), "event_id").select(
        "event_id", (F.abs(F.col("pct") - F.col("exact")) <= ranks.RANK_ERROR).alias("within"))


def pct_two_sided(spark: SparkSession, sf: str) -> DataFrame:
    df = standin.features(spark, sf).select("Work_ID", F.abs("Progress_Gap").alias("gap"))
    asked = ranks.melt(df, ["Work_ID"], ["gap"])
    return ranks.left_percentile(asked, ranks.reference_counts(df, ["gap"]), "Work_ID").select(
        "Work_ID", F.round("pct", 9).alias("pct"))


def performance_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.descending_rank(_events(spark, sf), "value", "place").select("event_id", "place")


def group_medians(spark: SparkSession, sf: str) -> DataFrame:
    placed = ranks.positions(_events(spark, sf), ["event_type"])
    return (ranks.medians(placed, ["event_type"])
            .join(ranks.quantile(placed, ["event_type"], 0.05), "event_type")
            .select("event_type", F.round("median", 9).alias("median"),
                    F.round("quantile", 9).alias("low")))


def peer_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    works = standin.star(spark, sf).works
    return _rounded(scoring.benchmark(works, works), {
        "peer_median_cost_per_unit": 6, "this_cost_per_unit": 6,
        "cost_vs_peer_median_ratio": 6, "cost_percentile_vs_peers": 9})


def _extremes(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    df = stored(standin.features(spark, sf).select("Work_ID", *S.REFERENCE_FEATURES))
    filled = feat.impute_vendor_features(df, feat.median_values(feat.feature_medians(df)))
    reference = ranks.reference_counts(feat.drop_incomplete(filled),
                                       list(S.REFERENCE_FEATURES))
    return scoring.feature_anomalies(df, reference, kinds=kinds, store=False)


def cost_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return _extremes(spark, sf, "cost_anomaly").select(
        "Work_ID", F.round("cost_anomaly", 6).alias("cost_anomaly"))


def timeline_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return _extremes(spark, sf, "timeline_anomaly").select(
        "Work_ID", F.round("timeline_anomaly", 6).alias("timeline_anomaly"))


def why_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged factors, without the duplicate one; scores next to a limit are kept exact."""
    both = _extremes(spark, sf, "cost_anomaly", "timeline_anomaly").join(
        _signals(spark, sf).select("Work_ID", "compliance"), "Work_ID")
    panel = rules.why_panel(F.lit(0.0), F.col("cost_anomaly"), F.col("timeline_anomaly"),
                            F.col("compliance"), F.lit(False), F.lit(None).cast("string"),
                            F.lit(0.0))
    return both.select("Work_ID", F.explode(panel).alias("w")).select(
        "Work_ID", "w.label", "w.severity")


# ----------------------------------------------------------------- similarity
SMALL_CELLS = {"chunk": 1, "cell": 8}   # every block of two and more vectors is cut into cells


def _vendor_of_label() -> Column:
    return F.when(F.col("label") > 0, F.concat(F.lit("V"), "label")).otherwise(F.lit("Unknown "))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return standin.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("Work_ID"), _vendor_of_label().alias("Vendor_Name"),
        F.lit("x").alias("Constituency"), "embedding")


def _vector_scores(spark: SparkSession, sf: str, **options) -> DataFrame:
    return similarity.duplicate_scores(_vectors(spark, sf), floor=0.25, ceiling=0.45, **options)


def duplicate_nearest(spark: SparkSession, sf: str, **options) -> DataFrame:
    return _vector_scores(spark, sf, **options).select(
        F.col("Work_ID").alias("vec_id"), F.col("nearest_duplicate_work_id").alias("nearest_id"),
        F.round("nearest_similarity", 6).alias("similarity"),
        F.round("duplicate_risk_score", 6).alias("risk"),
        F.col("duplicate_checked").alias("checked"))


def duplicate_nearest_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the way that large blocks take, whatever their size."""
    return duplicate_nearest(spark, sf, **SMALL_CELLS)


def dup_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(similarity.flag_rate(_vector_scores(spark, sf)), {"rate": 9})


def vendor_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.flagged_per_vendor(_vector_scores(spark, sf))


def nearby_top5(spark: SparkSession, sf: str, **options) -> DataFrame:
    cluster = F.when(F.col("label") % 3 != 0, F.concat(F.lit("k"), "label"))
    places = standin.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("Work_ID"), cluster.alias("Spatial_Cluster_ID"),
        F.concat(F.lit("c"), F.col("label") % 4).alias("Constituency"))
    found = similarity.nearby_works(places, places, _vectors(spark, sf), **options)
    return found.select(F.col("Work_ID").alias("vec_id"), "nearest_id",
                        F.round("similarity", 6).alias("similarity"),
                        F.col("position").alias("place"))


def nearby_top5_cells(spark: SparkSession, sf: str) -> DataFrame:
    return nearby_top5(spark, sf, **SMALL_CELLS)


def new_work_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector reversed, as a new work, against the whole index."""
    known = _vectors(spark, sf)
    index = known.select(F.col("Work_ID").alias("work_id"), F.col("Vendor_Name").alias("vendor_name"),
                         F.col("Constituency").alias("constituency"), "embedding")
    asked = known.select(
        (-F.col("Work_ID") - 1).alias("Work_ID"), "Vendor_Name", "Constituency",
        F.lit("new").alias("Work_Description"), F.reverse("embedding").alias("embedding"))
    return similarity.new_work_duplicates(asked, index).select(
        (-F.col("Work_ID") - 1).alias("vec_id"),
        F.col("nearest_duplicate_work_id").alias("nearest_id"),
        F.round("nearest_similarity", 6).alias("similarity"),
        F.col("duplicate_checked").alias("checked"))


def text_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as descriptions, compared within their language."""
    docs = standin.table(spark, sf, "documents").select(
        F.col("doc_id").alias("Work_ID"), F.col("source").alias("Vendor_Name"),
        F.col("lang").alias("Constituency"), F.col("text").alias("Work_Description"))
    # stored: the search, its copies and its answers each read them
    vectors = stored(texts.fit_words(docs, "Work_Description").vectors(docs, "Work_Description")
                     .drop("Work_Description"))
    return _rounded(similarity.duplicate_scores(vectors, block=F.col("Constituency")).select(
        "Work_ID", "Constituency", "nearest_duplicate_work_id", "nearest_similarity",
        "duplicate_risk_score", "duplicate_checked"),
        {"nearest_similarity": 6, "duplicate_risk_score": 4})


def duplicate_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(standin.duplicates(spark, sf),
                    {"nearest_similarity": 6, "duplicate_risk_score": 4})


# ------------------------------------------------------- requests and reports
def what_if_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Every work asked about: a changed clearance for some, a changed payment for others."""
    star = standin.star(spark, sf)
    requests = star.works.select(
        "Work_ID", F.when(F.col("Calamity_Flag"), "Pending").alias("NOC_Status"),
        F.when(F.col("House") == "Rajya Sabha", 2 * F.col("Disbursed_Amount"))
        .alias("Disbursed_Amount"))
    return _rounded(scoring.overlay(requests, star).select(
        "Work_ID", "NOC_Status", "Disbursed_Amount", "Sanction_Amount", "Vendor_Name",
        "on_record", "Progress_Gap"), {"Progress_Gap": 9})


def contractor_history(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scoring.contractor_history(standin.features(spark, sf), None).select(
        "Work_ID", "vendor_name", "total_projects", "avg_timeline_days", "quality_rating",
        "vendor_risk_score"),
        {"avg_timeline_days": 6, "quality_rating": 6, "vendor_risk_score": 6})


def iforest_scores(spark: SparkSession, sf: str) -> DataFrame:
    model = standin.anomaly_model(spark, sf)
    return iforest.batch_risk(standin.features(spark, sf), model).select(
        "Work_ID", "raw_score", "anomaly",
        iforest.outlier_label(F.col("raw_score"), model).alias("label"))


def composite_full(spark: SparkSession, sf: str) -> DataFrame:
    return standin.composite(spark, sf).select(
        "Work_ID", "anomaly", "compliance", "contractor", "spatial", "duplicate_risk_score",
        "composite", rules.risk_level(F.col("composite")).alias("risk_level"))


def composite_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.distribution(standin.composite(spark, sf))


def score_works(spark: SparkSession, sf: str) -> DataFrame:
    """Each work once as it is stored, and once as a new work with a stripped record."""
    works = standin.star(spark, sf).works
    known = works.select("Work_ID")
    fresh = works.select(
        F.concat(F.lit("NEW/"), "Work_ID").alias("Work_ID"), "Vendor_Name", "Constituency",
        "State", "Constituency_ID", "Work_Description",
        F.lit("Vendor Identification").alias("Work_Status"), "Sanction_Amount",
        "Disbursed_Amount", "Cost_per_Unit", F.lit("Pending").alias("NOC_Status"),
        F.lit("Vendor issues").alias("Issues_Encountered"))
    scored = scoring.score_works(known.unionByName(fresh, allowMissingColumns=True),
                                 standin.engine(spark, sf))
    return scored.select("work_id", "final_risk_score", "risk_level", "components.*",
                         F.to_json("duplicate_detail").alias("duplicate_detail"),
                         F.to_json("top_risk_factors").alias("top_risk_factors"))


def investigation_report(spark: SparkSession, sf: str) -> DataFrame:
    """The nested report of every work, its lists and structs as JSON text."""
    report = scoring.investigate(standin.star(spark, sf).works, standin.engine(spark, sf))
    nested = ("why", "nearby_similar_works", "contractor_history", "historical_benchmark")
    return report.withColumns({c: F.to_json(c) for c in nested})


def cross_check(spark: SparkSession, sf: str) -> DataFrame:
    model = standin.cross_check(spark, sf)
    return model.predict(standin.composite(spark, sf), "Work_ID")


def cross_check_importances(spark: SparkSession, sf: str) -> DataFrame:
    return standin.cross_check(spark, sf).importances(spark)


def baseline_rf(spark: SparkSession, sf: str) -> DataFrame:
    compliance = standin.star(spark, sf).compliance
    return models.train_baseline(compliance).model.transform(models.baseline_frame(compliance)).select(
        "Work_ID", "label", "prediction")


# ------------------------------------- around the models, with a forest of known nodes
def _known_forest(spark: SparkSession, sf: str) -> iforest.AnomalyModel:
    """Two small trees in place of trained ones; everything else comes from the tables."""
    df = standin.features(spark, sf)
    medians = feat.median_values(feat.feature_medians(df))
    at = {name: i for i, name in enumerate(S.ANOMALY_FEATURES)}
    nodes = spark.createDataFrame([
        (0, 0, at["Cost_per_Unit"], 2000.0, 1, 2, 0.0), (0, 1, -1, 0.0, 1, 1, 6.0),
        (0, 2, at["Progress_Gap"], 0.5, 3, 4, 0.0), (0, 3, -1, 0.0, 3, 3, 3.0),
        (0, 4, -1, 0.0, 4, 4, 2.0),
        (1, 0, at["Days_to_Sanction"], 30.0, 1, 2, 0.0), (1, 1, -1, 0.0, 1, 1, 5.0),
        (1, 2, -1, 0.0, 2, 2, 3.5)], iforest.NODES)
    unscaled = spark.createDataFrame([(n, 0.0, 1.0) for n in S.ANOMALY_FEATURES],
                                     "feature string, mean double, sd double")
    return iforest.AnomalyModel(nodes, 256, S.ANOMALY_FEATURES, medians, unscaled, -0.75,
                                nodes.limit(0), nodes.limit(0))


def forest_scores_known(spark: SparkSession, sf: str) -> DataFrame:
    model = _known_forest(spark, sf)
    raw = iforest.raw_scores(standin.features(spark, sf), model)
    return raw.select("Work_ID", F.round("raw_score", 9).alias("raw_score"),
                      iforest.outlier_label(F.col("raw_score"), model).alias("label"))


def composite_known(spark: SparkSession, sf: str) -> DataFrame:
    """All five signals: the anomaly by the known forest, duplicate scores from the works."""
    works = standin.star(spark, sf).works
    duplicates = works.filter(F.col("Days_to_Sanction") % 2 == 0).select(
        "Work_ID", (F.col("Sanction_Amount") % 101).alias("duplicate_risk_score"))
    found = scoring.composite_frame(standin.star(spark, sf), _known_forest(spark, sf), duplicates)
    level = rules.risk_level(F.round("composite", 9))
    return found.select("Work_ID", F.round("anomaly", 6).alias("anomaly"),
                        F.round("duplicate_risk_score", 6).alias("duplicate"),
                        F.round("composite", 6).alias("composite"), level.alias("level"),
                        rules.recommended_action(level).alias("action"))


def _encoder() -> texts.Encoder:
    """A model that SQL can repeat: how often three letters stand in a description."""
    def load():
        return lambda told: np.array([[t.count(c) + 0.5 for c in "aeo"] for t in told], np.float32)

    return texts.Encoder("three letters", load)


def _known_cross_check() -> models.CrossCheck:
    """Two trees of known nodes, with a side for missing values."""
    categories = {"NOC_Status": ["Pending"], "House": []}
    names = models.cross_check_inputs(categories)[1]
    at = {name: i for i, name in enumerate(names)}
    edges = [{"Compliance_Score": [40.0], "Cost_per_Unit": [1000.0], "Issues_Count": [0.0],
              "NOC_Status_Pending": [0.0]}.get(n, []) for n in names]
    first, second = boosting.Tree.blank(2), boosting.Tree.blank(2)
    first.feature[[0, 1]] = at["Compliance_Score"], at["Issues_Count"]
    first.missing_left[0] = True
    first.value[[2, 3, 4]] = -6.4, 4.0, 22.3
    second.feature[[0, 2]] = at["Cost_per_Unit"], at["NOC_Status_Pending"]
    second.value[[1, 5, 6]] = 1.5, 2.7, 30.5
    return models.CrossCheck(boosting.Boosted(names, edges, 30.0, [first, second], 2), categories, {})


def _known_engine(spark: SparkSession, sf: str) -> scoring.Engine:
    """All parts of scoring with known models; tables, vectors and distributions are the data's."""
    star, forest = standin.star(spark, sf), _known_forest(spark, sf)
    df = standin.features(spark, sf)
    scores = ranks.reference_counts(iforest.raw_scores(df, forest), ["raw_score"])
    filled = feat.impute_vendor_features(df, forest.medians)
    reference = ranks.reference_counts(feat.drop_incomplete(filled), list(S.REFERENCE_FEATURES))
    forest = replace(forest, scores=stored(scores), reference=stored(reference))
    checked = F.col("Days_to_Sanction") % 2 == 0
    duplicates = star.works.select(
        "Work_ID", "Vendor_Name", "Constituency",
        F.when(checked, F.col("Sanction_Amount") % 101).otherwise(F.lit(0.0)).alias("duplicate_risk_score"),
        F.when(checked, F.concat("Work_ID", F.lit("-twin"))).alias("nearest_duplicate_work_id"),
        F.when(checked, F.lit(0.9)).otherwise(F.lit(0.0)).alias("nearest_similarity"),
        checked.alias("duplicate_checked"))
    encoder = _encoder()
    path = f"{storage_folder(spark)}/known-index-{uuid.uuid4().hex}"
    star_io.write_index(encoder.vectors(star.works, "Work_Description"), path, encoder.name)
    return scoring.Engine(star, forest, duplicates, star_io.read_index(spark, path, encoder.name),
                          encoder, _known_cross_check())


def score_works_known(spark: SparkSession, sf: str) -> DataFrame:
    """Every work as it is stored, and once more as a new work, by known models."""
    works = standin.star(spark, sf).works
    fresh = works.select(
        F.concat(F.lit("NEW/"), "Work_ID").alias("Work_ID"), "Vendor_Name", "Constituency",
        "State", "Constituency_ID", "Work_Description",
        F.lit("Vendor Identification").alias("Work_Status"), "Sanction_Amount",
        "Disbursed_Amount", "Cost_per_Unit", F.lit("Pending").alias("NOC_Status"),
        F.lit("Vendor issues").alias("Issues_Encountered"))
    found = scoring.score_works(works.select("Work_ID").unionByName(fresh, allowMissingColumns=True),
                                _known_engine(spark, sf))
    return found.select(
        "work_id", "final_risk_score", "risk_level", "components.*",
        F.col("duplicate_detail.checked").alias("checked"),
        F.col("duplicate_detail.nearest_duplicate_work_id").alias("nearest_id"),
        F.col("duplicate_detail.nearest_similarity").alias("similarity"),
        "cross_check_score", F.concat_ws(" | ", "top_risk_factors").alias("factors"))


def investigation_known(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of all works by known models, lists as text in their order."""
    report = scoring.investigate(standin.star(spark, sf).works, _known_engine(spark, sf))
    why = F.transform("why", lambda w: F.concat_ws(
        "; ", w["label"], w["severity"], w["icon"], F.format_string("%.2f", w["score"]), w["detail"]))
    near = F.transform("nearby_similar_works", lambda w: F.concat_ws(
        "; ", w["work_id"], w["vendor_name"], w["work_status"],
        F.format_string("%.2f", w["cost_per_unit"]), F.format_string("%.3f", w["similarity"])))
    history = F.col("contractor_history")
    exact = ("avg_timeline_days", "avg_cost_overrun_ratio", "quality_rating", "vendor_risk_score")
    return report.select(
        "work_id", "risk_score", "risk_level", F.concat_ws(" | ", why).alias("why"),
        F.concat_ws(" | ", near).alias("nearby"),
        history["vendor_name"].alias("vendor_name"), history["total_projects"].alias("total_projects"),
        *(F.round(history[c], 6).alias(c) for c in exact),
        history["monopoly_score"].alias("monopoly_score"),
        history["other_flagged_duplicate_count"].alias("other_flagged_duplicate_count"),
        "historical_benchmark.*", "recommended_action", "cross_check_score")


BOOST_EDGES = {"Work_Quantity": [5.0, 10.0, 20.0, 30.0, 40.0], "Days_to_Complete": [20.0, 40.0, 60.0, 80.0],
               "Days_to_Sanction": [10.0, 20.0, 30.0]}


def boosted_known(spark: SparkSession, sf: str) -> DataFrame:
    """Two trees grown on given bins: days to complete are missing for most works."""
    works = standin.star(spark, sf).works.withColumn("label", F.floor(F.col("Disbursed_Amount") / 100))
    x = F.array(*(F.col(c).cast("double") for c in BOOST_EDGES))
    model = boosting.fit(works, "Work_ID", "label", x, list(BOOST_EDGES), boosting.Params(
        trees=2, depth=2, rate=0.5, rows=1, columns=1), edges=list(BOOST_EDGES.values()), base=300.0)
    return model.predict(works, "Work_ID", x).select("Work_ID", F.round("prediction", 6).alias("prediction"))


def feature_scaling(spark: SparkSession, sf: str) -> DataFrame:
    df = standin.features(spark, sf)
    filled = feat.impute_vendor_features(df, feat.median_values(feat.feature_medians(df)))
    return _rounded(iforest.fit_scaling(feat.drop_incomplete(filled), S.ANOMALY_FEATURES),
                    {"mean": 6, "sd": 6})


def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    learn, test = models.split(standin.star(spark, sf).works.select("Work_ID"))
    return learn.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test")))


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared error and R2 of the sanctioned amount as a guess of the paid one."""
    works = standin.star(spark, sf).works.select(
        F.col("Sanction_Amount").alias("prediction"), F.col("Disbursed_Amount").alias("label"))
    found = models.evaluate(works, "label")
    return spark.createDataFrame([(found["mse"], found["r2"])], "mse double, r2 double").select(
        F.round("mse", 1).alias("mse"), F.round("r2", 9).alias("r2"))


def cross_check_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, flags and categories that the cross-check is fed, without fills."""
    frame = feat.cross_check_frame(standin.features(spark, sf), {})
    numbers = ("Cost_per_Unit", "Days_to_Sanction", "Progress_Gap", "Vendor_Risk_Score",
               "Vendor_Avg_Timeline_Days_missing", "Zone_Fraud_Risk_Score", "Compliance_Score",
               "Vendor_Total_Projects_Count")
    return _rounded(frame.select("Work_ID", *numbers, "Calamity_Flag", "NOC_Status", "House"),
                    {n: 6 for n in numbers})


def entry(spark: SparkSession) -> DataFrame:
    """Investigation reports of all works."""
    return investigation_report(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    plain = (
        work_id_extract, currency_clean, token_split, date_parse,
        dedupe_first, expenditure_per_work, master_join, etl_from_csv, star_roundtrip_csv,
        date_spans, overruns, mp_dimension, vendor_dimension, geo_keys,
        list_works, list_works_filtered, works_total, list_members, list_vendors, list_geography,
        work_detail, constituency_detail, member_detail, vendor_detail, overview, value_counts,
        master_features, progress_gap, doc_flags, impute_vendor, retention,
        composite_rules, risk_level, severity, top_reasons,
        pct_rank_avg, pct_vs_reference, pct_vs_sketch, pct_two_sided, performance_rank, group_medians,
        peer_benchmark, cost_anomaly, timeline_anomaly, why_panel,
        duplicate_nearest, duplicate_nearest_cells, dup_rate, vendor_flagged, nearby_top5,
        nearby_top5_cells, new_work_nearest,
        text_duplicates, duplicate_lookup,
        what_if_overlay, contractor_history, iforest_scores, composite_full,
        composite_distribution, score_works, investigation_report,
        cross_check, cross_check_importances, baseline_rf,
        forest_scores_known, composite_known, score_works_known, investigation_known, boosted_known,
        feature_scaling, train_test_split,
        regression_metrics, cross_check_inputs,
    )
    named = {f.__name__: f for f in plain}
    named |= {f"{n}_score": _signal(n) for n in ("compliance", "contractor", "spatial")}
    if llm_queries is not None:
        named |= llm_queries.QUERIES
    if corpus_pipeline is not None:
        named["pipeline"] = corpus_pipeline.run
    return named


def oracle_sql() -> dict[str, str]:
    known, sql = queries(), dict(ORACLES)
    if llm_queries is not None:
        sql |= llm_queries.ORACLES
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: text for name, text in sql.items() if name in known}
