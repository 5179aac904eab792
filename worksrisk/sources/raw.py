"""Reading the per-house CSV exports: header forms, trailers, file order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksrisk.functions.cells import currency, normalise_missing, payment_work_id, work_id

# fixed values: file name patterns and the header phrases they are known by
FILE_PATTERNS = {
    "recommended": "*Works Recommended*.csv",
    "sanctioned": "*Works Sanctioned*.csv",
    "completed": "*Works Completed*.csv",
    "expenditure": "*Expenditure*.csv",
}
HEADER_PHRASES = (
    ("WORK DESCRIPTION", "Work_Description"),
    ("RECOMMENDED DATE", "Recommended_Date"),
    ("RECOMMENDED AMOUNT", "Recommended_Amount"),
    ("HON'BLE", "MP_Name"),
    ("MEMBERS OF PARLIAMENT", "MP_Name"),
    ("SANCTION DATE", "Sanction_Date"),
    ("SANCTION AMOUNT", "Sanction_Amount"),
    ("WORK STATUS", "Work_Status"),
    ("COMPLETION DATE", "Completion_Date"),
    ("COMPLETE DATE", "Completion_Date"),
)
NOT_THE_WORK_CELL = ("DESCRIPTION", "ID", "CATEGORY", "STATUS")
NOMINATED_HOUSE = "Rajya Sabha"

ORDER = "_row_order"
PAID = "Fund Disbursed Amount ( ₹ )"


@dataclass(frozen=True)
class HouseFiles:
    """The four exports of one house; each row carries its place in file order."""

    recommended: DataFrame
    sanctioned: DataFrame
    completed: DataFrame
    expenditure: DataFrame


def canonical_header(name: str) -> str:
    """First matching phrase decides; an unknown header keeps its own name."""
    upper = name.strip().upper()
    for phrase, column in HEADER_PHRASES:
        if phrase in upper:
            return column
    if "WORK" in upper and not any(word in upper for word in NOT_THE_WORK_CELL):
        return "Work_String"
    return name


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename every header; of several headers with one meaning the first is kept."""
    seen: dict[str, Column] = {}
    for name in df.columns:
        seen.setdefault(canonical_header(name), F.col(f"`{name}`"))
    return df.select([c.alias(name) for name, c in seen.items()])


def amount_header(columns: list[str]) -> str | None:
    """The rupee column of a payment file."""
    return next((c for c in columns if "Amount" in c and "₹" in c), None)


def read_csv(spark: SparkSession, path: str, *, multi_line: bool = True,
             drop_trailer: bool = True) -> DataFrame:
    """One export as text columns, in file order.

    Cells may hold line breaks, so a file is read whole by default; pass
    ``multi_line=False`` for clean exports, which lets Spark split large files.
    The order column stays right either way. ``drop_trailer`` leaves out the rows of the
    totals, which say so in place of a serial number; every other row is kept.
    """
    raw = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).option("encoding", "UTF-8")
        .option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path)
    )
    named = raw.select([F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in raw.columns]
                       + [F.struct(F.col("_metadata.file_path").alias("file"),
                                   F.col("_metadata.file_block_start").alias("block"),
                                   F.monotonically_increasing_id().alias("line")).alias(ORDER)])
    serial = next((c for c in named.columns if re.sub(r"\W", "", c).lower() == "srno"), None)
    if drop_trailer and serial is not None:
        total = F.lower(F.trim(F.col(f"`{serial}`"))).rlike(r"^(grand|sub)?\s*total")
        named = named.filter(~F.coalesce(total, F.lit(False)))
    return normalise_missing(named)


def _matches(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files (or folders of part files) whose names fit the pattern, in order of name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(h.getPath().toString() for h in files.globStatus(path) or [])


def _stacked(frames: list[DataFrame]) -> DataFrame:
    """Files of one kind under each other; a column that one of them lacks is null there."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _one_paid_column(df: DataFrame) -> DataFrame:
    """Payment files name the rupee column each in their own way."""
    paid = amount_header(df.columns)
    return df.withColumnRenamed(paid, PAID) if paid else df


def read_house(spark: SparkSession, folder: str, house: str, **options) -> HouseFiles | None:
    """All four exports of a house, or None when any of them is missing.

    An export may be spread over several files; all that fit the pattern are read.
    """
    paths = {kind: _matches(spark, folder, glob) for kind, glob in FILE_PATTERNS.items()}
    if not all(paths.values()):
        return None
    tables = {}
    for kind, found in paths.items():
        same = _one_paid_column if kind == "expenditure" else canonical_columns
        tables[kind] = _stacked([same(read_csv(spark, path, **options)) for path in found])
    return shape_house(house=house, **tables)


def shape_house(recommended: DataFrame, sanctioned: DataFrame, completed: DataFrame,
                expenditure: DataFrame, house: str) -> HouseFiles:
    """Canonical headers, identifiers and amounts; absent columns get their default."""
    rec, san, com = (canonical_columns(df) for df in (recommended, sanctioned, completed))
    rec = _with_amount(_with_work_id(rec), "Recommended_Amount").withColumns({
        "House": F.lit(house),
        "Elected_or_Nominated": F.lit("Nominated" if house == NOMINATED_HOUSE else "Elected"),
    })
    san = _with_amount(_with_work_id(san), "Sanction_Amount")
    com = _with_work_id(com)

    paid = amount_header(expenditure.columns)
    exp = expenditure.withColumns({
        "Disbursed_Amount": currency(F.col(f"`{paid}`")) if paid else F.lit(0.0),
        "Work_ID": (payment_work_id(F.col("`Work ID`")) if "Work ID" in expenditure.columns
                    else F.lit(None).cast("string")),
    })
    return HouseFiles(rec, san, com, exp)


def _with_work_id(df: DataFrame) -> DataFrame:
    found = work_id(F.col("Work_String")) if "Work_String" in df.columns else F.lit(None)
    return df.withColumn("Work_ID", found.cast("string"))


def _with_amount(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, currency(F.col(name)) if name in df.columns else F.lit(0.0))


def union_houses(houses: list[HouseFiles | None]) -> HouseFiles:
    """Stack the houses that were found; columns may differ between them."""
    found = [h for h in houses if h is not None]
    if not found:
        raise ValueError("no house has all four exports")

    def stack(kind: str) -> DataFrame:
        frames = [
            getattr(h, kind).withColumn(
                ORDER, F.struct(F.lit(i).alias("house"), F.col(f"{ORDER}.*")))
            for i, h in enumerate(found)
        ]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    return HouseFiles(*(stack(kind) for kind in FILE_PATTERNS))
