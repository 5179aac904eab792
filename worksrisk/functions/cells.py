"""Column expressions that clean raw text cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worksrisk.schemas import NA_TOKENS, PLACEHOLDER_VENDOR

# fixed patterns: the identifier form, and what counts as a number
WORK_ID_PATTERN = r"(WS/\s*[A-Za-z0-9]+/\d{4}-\d{4}/\d+)"
NUMBER_PATTERN = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"
DATE_LAYOUTS = (
    "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy", "d MMMM yyyy",
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d",
)
TIME_OF_DAY = "[ H:mm[:ss]]['T'H:mm[:ss]]"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def normalise_missing(df: DataFrame) -> DataFrame:
    """Missing-value texts become null, and NaN becomes null, in one projection."""
    def clean(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = na_to_null(c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        return c.alias(field.name)

    return df.select([clean(f) for f in df.schema.fields])


def work_id(c: Column) -> Column:
    """The identifier inside a free-text work cell, else what precedes the first dash."""
    flat = F.translate(c, "\t\r\n", "")
    found = F.regexp_extract(flat, WORK_ID_PATTERN, 1)
    first = F.split_part(flat, F.lit("-"), F.lit(1))
    return (
        F.when(found != "", F.replace(found, F.lit(" ")))
        .when(flat.contains("-"), strip(F.replace(first, F.lit(" "))))
        .otherwise(strip(flat))
    )


def payment_work_id(c: Column) -> Column:
    return strip(F.translate(c, " \t", ""))


def currency(c: Column) -> Column:
    """Amount without digit grouping and rupee sign; anything unreadable is 0."""
    return F.coalesce(number(F.translate(c.cast("string"), ",₹", "")), F.lit(0.0))


def number(c: Column) -> Column:
    """Lenient numeric reading: null where the cell is not a number."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def day_first_timestamp(c: Column) -> Column:
    """First of the accepted layouts that reads the cell, else null."""
    text = strip(c)
    return F.coalesce(*(
        F.try_to_timestamp(text, F.lit(day + TIME_OF_DAY)).cast("timestamp_ntz")
        for day in DATE_LAYOUTS
    ))


def tokens(c: Column) -> Column:
    """Comma list to trimmed, non-empty tokens; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.filter(parts, lambda t: t != "")


def is_real_vendor(c: Column) -> Column:
    """Neither missing nor the placeholder, whatever its case and padding."""
    return F.coalesce(F.lower(strip(c)) != PLACEHOLDER_VENDOR.lower(), F.lit(False))


def is_completed(status: Column) -> Column:
    """A partially completed work counts too."""
    return F.coalesce(F.lower(status).contains("completed"), F.lit(False))


def same_text(c: Column, value: str) -> Column:
    return F.lower(c) == F.lower(F.lit(value))


def has_text(c: Column, needle: str) -> Column:
    """Literal, case-insensitive search; a missing cell never matches."""
    return F.coalesce(F.lower(c).contains(F.lower(F.lit(needle))), F.lit(False))
