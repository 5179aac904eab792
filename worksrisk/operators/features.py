"""The one-row-per-work feature frame that training, scoring and browsing share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksrisk import schemas as S
from worksrisk.functions import rules
from worksrisk.functions.cells import is_real_vendor, number
from worksrisk.operators.joins import few, hot_keys, left_join, spread_left_join
from worksrisk.operators.ranks import medians, melt, positions
from worksrisk.sources.star import Star


def add_progress_gap(df: DataFrame) -> DataFrame:
    return df.withColumn("Progress_Gap", rules.progress_gap(
        F.col("Disbursed_Amount"), F.col("Sanction_Amount"), F.col("Work_Status")))


def add_document_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(rules.document_flags(
        F.col("Documents_Submitted"), F.col("Issues_Encountered")))


def attach_vendor(works: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vendor columns on each work.

    The table of vendors says how many works each one has, so the few that hold a
    large share are known without another pass; works of nobody in particular have
    no partner and are dealt out. Vendors that a task can hold come to the works instead.
    """
    if few(vendors):
        return left_join(works, F.broadcast(vendors), ["Vendor_Name"])
    salt = F.xxhash64("Work_ID") if "Work_ID" in works.columns else None   # other columns need not be read
    hot = hot_keys(vendors, ["Vendor_Name"], "Vendor_Total_Projects_Count")
    return spread_left_join(works, vendors, ["Vendor_Name"], hot,
                            scatter=~is_real_vendor(F.col("Vendor_Name")), salt=salt, store=True)


def master_dataset(star: Star, *, spread: bool = True) -> DataFrame:
    """Works with vendor, compliance and geography columns, progress gap and flags.

    ``spread=False`` skips dealing out hot vendors, for look-ups of few works.
    """
    df = (attach_vendor(star.works, star.vendors) if spread
          else left_join(star.works, star.vendors, ["Vendor_Name"]))
    df = left_join(df, star.compliance, ["Work_ID"], null_safe=True)
    df = left_join(df, star.geography, ["State", "Constituency", "Constituency_ID"],
                   null_safe=True)
    return add_document_flags(add_progress_gap(df))


def feature_medians(df: DataFrame, features: tuple[str, ...] = S.IMPUTED_FEATURES) -> DataFrame:
    """(feature, median) over all rows, exact."""
    return medians(positions(melt(df, [], list(features)), ["feature"]), ["feature"])


def median_values(table: DataFrame) -> dict[str, float]:
    """The medians as numbers: one row per imputed feature."""
    return {r["feature"]: r["median"] for r in table.collect()}


def impute_vendor_features(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Keep every row: flag a vendor without history, then fill in the median."""
    out = df
    for name in S.IMPUTED_FEATURES:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out.withColumns(
        {f"{n}_missing": F.col(n).isNull() for n in S.IMPUTED_FEATURES}
        | {n: F.coalesce(F.col(n), F.lit(values.get(n)).cast("double"))
           for n in S.IMPUTED_FEATURES})


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["Cost_per_Unit", "Days_to_Sanction", "Progress_Gap"])


def retention(df: DataFrame) -> DataFrame:
    """Rows before and after dropping incomplete ones, in one pass."""
    whole = (F.col("Cost_per_Unit").isNotNull() & F.col("Days_to_Sanction").isNotNull()
             & F.col("Progress_Gap").isNotNull())
    return df.agg(F.count("*").alias("rows_before"), F.count_if(whole).alias("rows_kept"))


def cross_check_frame(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Raw-field inputs of the cross-check model: numbers, 0/1 flags, categories.

    A missing number becomes the given fill for that column, or stays null.
    """
    if f"{S.IMPUTED_FEATURES[0]}_missing" not in df.columns:
        df = impute_vendor_features(df, values)
    kinds = dict(df.dtypes)

    def numeric(name: str):
        if name not in kinds:
            return F.lit(None).cast("double")
        c = number(F.col(name)) if kinds[name] == "string" else F.col(name).cast("double")
        return F.coalesce(c, F.lit(values.get(name)).cast("double"))

    def flag(name: str):
        c = F.coalesce(F.col(name), F.lit(False)) if name in kinds else F.lit(False)
        return c.cast("int").cast("double")

    def category(name: str):
        return F.coalesce(F.col(name), F.lit("Missing")) if name in kinds else F.lit("Missing")

    return df.withColumns(
        {n: numeric(n) for n in S.CROSS_CHECK_NUMERIC}
        | {n: flag(n) for n in S.CROSS_CHECK_BOOLEAN}
        | {n: category(n) for n in S.CROSS_CHECK_CATEGORY})
