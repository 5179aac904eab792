"""Listings, look-ups, details and dashboard totals over the stored tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksrisk import schemas as S
from worksrisk.functions.cells import has_text, same_text
from worksrisk.operators.features import master_dataset
from worksrisk.sources.star import Star

# fixed values
MAX_PAGE = 500
MAX_SAMPLE = 200
MEMBER_WORK_COLUMNS = ("Work_ID", "Work_Status", "State", "Constituency", "Sanction_Amount",
                       "Disbursed_Amount")
VENDOR_WORK_COLUMNS = ("Work_ID", "Work_Status", "State", "Constituency", "Sanction_Amount",
                       "Cost_Overrun_Ratio")


def _where(df: DataFrame, conditions: Iterable[Column | None]) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def _matches(**wanted: str | None) -> list[Column]:
    return [same_text(F.col(name), value) for name, value in wanted.items() if value]


def sorted_page(df: DataFrame, sort_by: str, allowed: tuple[str, ...], descending: bool,
                tie: list[str], skip: int = 0, limit: int = 50) -> DataFrame:
    """One page in a total order: nulls last either way, key columns break ties."""
    if sort_by not in allowed:
        raise ValueError(f"unknown sort column {sort_by!r}, expected one of {sorted(allowed)}")
    if skip < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"skip must be >= 0 and limit within 1..{MAX_PAGE}")
    c = F.col(sort_by)
    order = [c.desc_nulls_last() if descending else c.asc_nulls_last()]
    order += [F.col(t).asc_nulls_last() for t in tie if t != sort_by]
    return df.orderBy(*order).offset(skip).limit(limit)


def total(df: DataFrame) -> DataFrame:
    """Row count of a filtered listing before it is paged."""
    return df.agg(F.count("*").alias("total"))


# ------------------------------------------------------------------- listings
def filter_works(works: DataFrame, *, state: str | None = None, constituency: str | None = None,
                 mp_name: str | None = None, vendor_name: str | None = None,
                 work_status: str | None = None, calamity_flag: bool | None = None,
                 search: str | None = None, min_sanction_amount: float | None = None,
                 max_sanction_amount: float | None = None) -> DataFrame:
    amount = F.col("Sanction_Amount")
    return _where(works, [
        *_matches(State=state, Constituency=constituency, MP_Name=mp_name,
                  Vendor_Name=vendor_name, Work_Status=work_status),
        None if calamity_flag is None else F.col("Calamity_Flag") == calamity_flag,
        None if min_sanction_amount is None else amount >= min_sanction_amount,
        None if max_sanction_amount is None else amount <= max_sanction_amount,
        (has_text(F.col("Work_ID"), search) | has_text(F.col("Work_Description"), search))
        if search else None,
    ])


def list_works(works: DataFrame, *, sort_by: str = "Work_ID", descending: bool = False,
               skip: int = 0, limit: int = 50, **filters) -> DataFrame:
    return sorted_page(filter_works(works, **filters), sort_by, S.SORTABLE_WORKS, descending,
                       ["Work_ID"], skip, limit)


def filter_members(members: DataFrame, search: str | None = None) -> DataFrame:
    return _where(members, [has_text(F.col("MP_Name"), search) if search else None])


def list_members(members: DataFrame, *, search: str | None = None,
                 sort_by: str = "MP_Performance_Rank", descending: bool = False,
                 skip: int = 0, limit: int = 50) -> DataFrame:
    return sorted_page(filter_members(members, search), sort_by, S.SORTABLE_MEMBERS, descending,
                       ["MP_Name"], skip, limit)


def filter_vendors(vendors: DataFrame, search: str | None = None,
                   min_risk_score: float | None = None) -> DataFrame:
    return _where(vendors, [
        has_text(F.col("Vendor_Name"), search) if search else None,
        None if min_risk_score is None else F.col("Vendor_Risk_Score") >= min_risk_score])


def list_vendors(vendors: DataFrame, *, search: str | None = None,
                 min_risk_score: float | None = None, sort_by: str = "Vendor_Risk_Score",
                 descending: bool = True, skip: int = 0, limit: int = 50) -> DataFrame:
    return sorted_page(filter_vendors(vendors, search, min_risk_score), sort_by,
                       S.SORTABLE_VENDORS, descending, ["Vendor_Name"], skip, limit)


def filter_geography(geography: DataFrame, state: str | None = None,
                     min_zone_risk: float | None = None) -> DataFrame:
    return _where(geography, [
        *_matches(State=state),
        None if min_zone_risk is None else F.col("Zone_Fraud_Risk_Score") >= min_zone_risk])


def list_geography(geography: DataFrame, *, state: str | None = None,
                   min_zone_risk: float | None = None, sort_by: str = "Zone_Fraud_Risk_Score",
                   descending: bool = True, skip: int = 0, limit: int = 50) -> DataFrame:
    return sorted_page(filter_geography(geography, state, min_zone_risk), sort_by,
                       S.SORTABLE_GEOGRAPHY, descending, ["State", "Constituency"], skip, limit)


# -------------------------------------------------------------------- details
def work_detail(star: Star, work_id: str) -> DataFrame:
    """Full record of one work; no row when it is not stored."""
    one = Star(star.works.filter(F.col("Work_ID") == work_id), star.members, star.vendors,
               star.geography, star.compliance.filter(F.col("Work_ID") == work_id))
    return master_dataset(one, spread=False).limit(1)


def constituency_detail(geography: DataFrame, state: str, constituency_id: str) -> DataFrame:
    return geography.filter(same_text(F.col("State"), state)
                            & same_text(F.col("Constituency_ID"), constituency_id)).limit(1)


def member_works(star: Star, mp_name: str) -> DataFrame:
    """Member row beside each of the member's works, one row per work.

    A member may hold a large share of all works, so the list stays a table; nothing
    gathers it into one cell.
    """
    detail = star.members.filter(same_text(F.col("MP_Name"), mp_name)).limit(1)
    works = (star.works.filter(same_text(F.col("MP_Name"), mp_name))
             .select(*MEMBER_WORK_COLUMNS, F.lower("MP_Name").alias("_k")))
    return (detail.withColumn("_k", F.lower("MP_Name"))
            .join(works, "_k", "left").drop("_k"))


def vendor_sample(star: Star, vendor_name: str, works_limit: int = 20) -> DataFrame:
    """Vendor row with its number of works and a nested sample of the first few."""
    if not 0 <= works_limit <= MAX_SAMPLE:
        raise ValueError(f"works_limit must be within 0..{MAX_SAMPLE}")
    detail = (star.vendors.filter(same_text(F.col("Vendor_Name"), vendor_name)).limit(1)
              .withColumn("_k", F.lower("Vendor_Name")))
    works = star.works.filter(same_text(F.col("Vendor_Name"), vendor_name))
    counted = works.groupBy(F.lower("Vendor_Name").alias("_k")).agg(
        F.count("*").alias("works_count"))
    first = Window.partitionBy("_k").orderBy("Work_ID")
    sample = (works.select(F.lower("Vendor_Name").alias("_k"), *VENDOR_WORK_COLUMNS)
              .withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= works_limit)
              .groupBy("_k").agg(F.sort_array(F.collect_list(
                  F.struct("_n", *VENDOR_WORK_COLUMNS))).alias("_s")))
    shown = F.transform(F.coalesce("_s", F.array()), lambda w: F.struct(
        *(w[c].alias(c) for c in VENDOR_WORK_COLUMNS)))
    return (detail.join(counted, "_k", "left").join(sample, "_k", "left")
            .withColumn("works_count", F.coalesce("works_count", F.lit(0)))
            .withColumn("works_sample", shown).drop("_k", "_s"))


# ------------------------------------------------------------------ dashboard
def overview(star: Star) -> DataFrame:
    """Table sizes, money totals and averages in one row."""
    def size(df: DataFrame) -> Column:
        return df.select(F.count("*")).scalar()

    sums = star.works.agg(
        F.count("*").alias("total_works"),
        F.sum("Recommended_Amount").alias("total_recommended_amount"),
        F.sum("Sanction_Amount").alias("total_sanctioned_amount"),
        F.sum("Disbursed_Amount").alias("total_disbursed_amount"),
        F.round(F.avg("Cost_Overrun_Ratio"), 3).alias("avg_cost_overrun_ratio"),
        F.round(F.avg("Days_to_Sanction"), 1).alias("avg_days_to_sanction"),
        F.count_if(F.coalesce("Calamity_Flag", F.lit(False))).alias("calamity_flagged_works"))
    return sums.withColumns({
        "total_mps": size(star.members),
        "total_vendors": size(star.vendors),
        "total_constituencies": size(star.geography),
    })


def value_counts(works: DataFrame, columns: tuple[str, ...] = ("Work_Status", "State", "House")
                 ) -> DataFrame:
    """(field, value, n) of several columns in one scan, nulls left out, largest first."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
                      for c in columns))
    return (works.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null")
            .groupBy("field", "value").agg(F.count("*").alias("n"))
            .orderBy("field", F.desc("n"), "value"))
