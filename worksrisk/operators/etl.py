"""From the raw house tables to the five-table star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksrisk import schemas as S
from worksrisk.functions import rules
from worksrisk.functions.cells import day_first_timestamp
from worksrisk.operators.joins import left_join
from worksrisk.operators.ranks import descending_rank, melt, positions
from worksrisk.session import stored
from worksrisk.sources.raw import ORDER, HouseFiles
from worksrisk.sources.star import Star

# fixed values: columns the right-hand tables bring, and so must not come twice
JOINED_IN = ("Sanction_Date", "Sanction_Amount", "Work_Status", "Completion_Date")
KEY, NO_WORK = "_work_key", "\u0000"
GROUP = "_work_group"   # optional: a number that all rows of a work share, and few works
COMPLIANCE_ONLY = tuple(c for c in S.COMPLIANCE.names if c not in ("Work_ID", "Work_Description_Full"))
DATES = ("Recommended_Date", "Sanction_Date", "Completion_Date")


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key in the given order; all null keys are one key.

    The row limit is applied before the shuffle as well, so a key that holds
    most of the table sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def expenditure_per_work(payments: DataFrame, key: str = "Work_ID") -> DataFrame:
    """Total paid and one vendor per work; payments without an identifier are left out."""
    keys = work_keys(payments) if key == KEY else [key]
    return (payments.filter(F.col(key).isNotNull()).groupBy(*keys)
            .agg(F.sum("Disbursed_Amount").alias("Disbursed_Amount"),
                 F.coalesce(F.min("`Vendor Name`"), F.lit(S.PLACEHOLDER_VENDOR))
                 .alias("Vendor_Name")))


def work_keys(df: DataFrame) -> list[str]:
    return [GROUP, KEY] if GROUP in df.columns else [KEY]


def join_of_work(master: DataFrame, side: DataFrame) -> DataFrame:
    """Left join by ``KEY``; tables with groups meet by group, so buckets of it need no shuffle.

    The keys are then compared by their difference: as an equality, Spark would shuffle by them.
    """
    if GROUP not in side.columns:
        return left_join(master, side, [KEY])
    right = side.withColumnsRenamed({GROUP: "_r_group", KEY: "_r_key"})
    same = (F.col(GROUP) == F.col("_r_group")) & (F.col(KEY) - F.col("_r_key") == 0)
    return master.join(right, same, "left").drop("_r_group", "_r_key")


def work_key(work_id: Column) -> Column:
    """Never null, so that equality and hash partitioning fit; the null work has its own."""
    return F.coalesce(work_id, F.lit(NO_WORK))


def keyed(df: DataFrame) -> DataFrame:
    """``KEY`` in place of the identifier, so that a shuffle carries it once.

    A table may bring a ``KEY`` of numbers beside the identifier: never null, equal where and only
    where the identifiers are equal.
    """
    if KEY in df.columns:
        return df
    return df.withColumn(KEY, work_key(F.col("Work_ID"))).drop("Work_ID")


def join_master(recommended: DataFrame, sanctioned: DataFrame, completed: DataFrame,
                expenditure: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """One row per recommended work with what the other exports say about it.

    The three work tables are unique per ``KEY``, on which they were deduplicated and are
    joined now, so each side is shuffled once, the caller's ``inputs`` too. Where the tables
    bring a ``KEY`` of their own, all must; only the first then carries the identifier. So with
    ``GROUP``: tables stored in buckets of it are not shuffled at all.
    """
    recommended, sanctioned, completed = (keyed(df) for df in (recommended, sanctioned, completed))
    master = recommended.drop(*JOINED_IN)
    keys = work_keys(recommended)
    sides = [sanctioned.select(*keys, "Sanction_Date", "Sanction_Amount", "Work_Status"),
             completed.select(*keys, "Completion_Date"),
             expenditure_per_work(expenditure if KEY in expenditure.columns
                                  else expenditure.withColumn(KEY, F.col("Work_ID")), KEY)]
    if inputs is not None:   # a work without an identifier finds nothing there
        sides.append(inputs.drop("Work_ID") if KEY in inputs.columns else
                     inputs.filter(F.col("Work_ID").isNotNull()).withColumnRenamed("Work_ID", KEY))
    for side in sides:
        master = join_of_work(master, side)
    work = (F.col("Work_ID") if "Work_ID" in master.columns
            else F.when(F.col(KEY) != NO_WORK, F.col(KEY)).alias("Work_ID"))
    return master.select(work, *(F.col(f"`{c}`") for c in master.columns
                                 if c not in (KEY, GROUP, "Work_ID"))).fillna({
        "Work_Status": "Recommended", "Disbursed_Amount": 0.0, "Sanction_Amount": 0.0,
        "Vendor_Name": S.PLACEHOLDER_VENDOR,
    })


def parse_dates(master: DataFrame) -> DataFrame:
    """Text dates to time stamps; dates that are typed already are kept."""
    kinds = dict(master.dtypes)
    return master.withColumns({
        d: day_first_timestamp(F.col(d)) if kinds[d] == "string" else F.col(d).cast("timestamp_ntz")
        for d in DATES})


def derive_measures(master: DataFrame, as_of: Column) -> DataFrame:
    """Day counts, overruns and unit cost; ``as_of`` stands for today."""
    c = {n: F.col(n) for n in (*DATES, "Work_Status", "Disbursed_Amount", "Sanction_Amount")}
    out = master.withColumns({
        "Days_to_Sanction": rules.whole_days(c["Sanction_Date"], c["Recommended_Date"]),
        "Days_to_Complete": rules.whole_days(c["Completion_Date"], c["Sanction_Date"]),
        "Days_Pending": rules.days_pending(c["Recommended_Date"], c["Completion_Date"], as_of),
        "Cost_Overrun_Amount": rules.overrun_amount(
            c["Work_Status"], c["Disbursed_Amount"], c["Sanction_Amount"]),
        "Cost_Overrun_Ratio": rules.overrun_ratio(
            c["Work_Status"], c["Disbursed_Amount"], c["Sanction_Amount"]),
    })
    if "Work_Quantity" in master.columns:
        out = out.withColumn(
            "Cost_per_Unit", rules.cost_per_unit(c["Disbursed_Amount"], F.col("Work_Quantity")))
    return out


def build_master(files: HouseFiles, as_of: Column, inputs: DataFrame | None = None) -> DataFrame:
    """Deduplicate, join, fill and derive.

    ``inputs`` may bring per-work columns that the exports do not have (quantity,
    unit, calamity flag), keyed by ``Work_ID``. A ``KEY`` or ``GROUP`` of the caller's counts if
    all tables have it.
    """
    tables = {kind: getattr(files, kind) for kind in ("recommended", "sanctioned", "completed", "expenditure")}
    for own in ([KEY, GROUP], [GROUP]):   # groups only beside keys
        if not all(own[0] in df.columns for df in (*tables.values(), *([] if inputs is None else [inputs]))):
            tables = {kind: df.drop(*own) for kind, df in tables.items()}
            inputs = None if inputs is None else inputs.drop(*own)
    first = {kind: keep_first(keyed(df), work_keys(df) if KEY in df.columns else [KEY], [ORDER]).drop(ORDER)
             for kind, df in tables.items() if kind != "expenditure"}
    master = join_master(first["recommended"], first["sanctioned"], first["completed"],
                         tables["expenditure"], inputs)
    return derive_measures(parse_dates(master), as_of)


# ----------------------------------------------------------------- dimensions
def member_dimension(master: DataFrame) -> DataFrame:
    """Totals, completion rate, budget use and rank of each member.

    The totals are stored once: ranking reads them twice, and works only once.
    """
    totals = master.filter(F.col("MP_Name").isNotNull()).groupBy("MP_Name").agg(
        F.sum("Recommended_Amount").alias("MP_Total_Allocation"),
        F.sum("Sanction_Amount").alias("MP_Total_Sanctioned"),
        F.sum("Disbursed_Amount").alias("MP_Total_Disbursed"),
        F.count("Work_ID").alias("MP_Total_Projects"),
        F.count("Completion_Date").alias("MP_Completed_Projects"))
    allocated, paid = F.col("MP_Total_Allocation"), F.col("MP_Total_Disbursed")
    rated = stored(totals.withColumns({
        "MP_Completion_Rate":
            F.try_divide("MP_Completed_Projects", "MP_Total_Projects") * 100,
        "MP_Budget_Utilization_Percent":
            F.when(allocated > 0, F.try_divide(paid, allocated) * 100).otherwise(F.lit(0.0)),
    }))
    return descending_rank(rated, "MP_Completion_Rate", "MP_Performance_Rank")


def vendor_dimension(master: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Project count and mean timeline and overrun per vendor, the placeholder apart.

    ``inputs`` brings quality, monopoly and risk per ``Vendor_Name``.
    """
    named = F.col("Vendor_Name").isNotNull() & (F.col("Vendor_Name") != S.PLACEHOLDER_VENDOR)
    out = master.filter(named).groupBy("Vendor_Name").agg(
        F.count("Work_ID").alias("Vendor_Total_Projects_Count"),
        F.avg("Days_to_Complete").alias("Vendor_Avg_Timeline_Days"),
        F.avg("Cost_Overrun_Ratio").alias("Vendor_Avg_Cost_Overrun_Ratio"))
    return out if inputs is None else left_join(out, inputs, ["Vendor_Name"])


def _order_number(c: Column) -> Column:
    """First six bytes of a text as a number that sorts like the text."""
    head = F.substring(F.rpad(F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-8")), 12, "0"), 1, 12)
    return F.conv(head, 16, 10).cast("double")


def number_places(places: DataFrame) -> DataFrame:
    """Dense keys 0, 1, 2 ... by (State, Constituency).

    Places are first counted per leading bytes of the state name, which gives each
    such group its offset; numbering inside a group is a window over that group.
    """
    keyed = places.withColumn("_head", _order_number(F.col("State")))
    groups = positions(melt(keyed, [], ["_head"]), ["feature"]).select(
        F.col("value").alias("_head"), F.col("lt").alias("_offset"))
    inside = Window.partitionBy("_head").orderBy(
        F.col("State").asc_nulls_first(), F.col("Constituency").asc_nulls_first())
    return (keyed.join(groups, "_head")
            .withColumn("_index", F.col("_offset") + F.row_number().over(inside) - 1)
            .drop("_head", "_offset"))


def geography_dimension(master: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Distinct places with surrogate keys numbered by (State, Constituency).

    ``inputs`` brings coordinates, cluster and zone risk per (State, Constituency).
    """
    places = number_places(master.select("State", "Constituency").distinct())
    out = places.select(
        "State", "Constituency",
        F.concat(F.lit("CONST_"), F.col("_index")).alias("Constituency_ID"),
        F.concat(F.lit("DIST_"), F.col("_index")).alias("District_Code"))
    if inputs is not None:
        out = left_join(out, inputs, ["State", "Constituency"], null_safe=True)
    return out


def attach_constituency_id(master: DataFrame, geography: DataFrame) -> DataFrame:
    keys = geography.select("State", "Constituency", "Constituency_ID")
    return left_join(master, keys, ["State", "Constituency"], null_safe=True)


def compliance_table(master: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Caller's compliance columns per work, with the full description.

    Without ``inputs``, those that the master's own inputs have brought.
    """
    brought = [c for c in COMPLIANCE_ONLY if c in master.columns and inputs is None]
    text = master.select(
        "Work_ID", F.coalesce("Work_Description", F.lit("")).alias("Work_Description_Full"), *brought)
    return text if inputs is None else left_join(text, inputs, ["Work_ID"])


def build_star(master: DataFrame, *, vendor_inputs: DataFrame | None = None,
               geography_inputs: DataFrame | None = None,
               compliance_inputs: DataFrame | None = None) -> Star:
    """All five tables of one master; store the master first, five outputs read it.

    The places are stored here: two tables read them, and once their size is known, works need
    no shuffle to find their place. Compliance columns may come with the master's inputs, which
    joins them once, or in ``compliance_inputs``.
    """
    geography = stored(geography_dimension(master, geography_inputs))
    return Star(
        works=attach_constituency_id(master.drop(*COMPLIANCE_ONLY), geography),
        members=member_dimension(master),
        vendors=vendor_dimension(master, vendor_inputs),
        geography=geography,
        compliance=compliance_table(master, compliance_inputs))
