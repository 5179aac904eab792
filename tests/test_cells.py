import pytest
from pyspark.sql import functions as F

from worksrisk.functions import cells


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize("cell, expected", [
    ("WS/ MP005/2024-2025/145074-Road", "WS/MP005/2024-2025/145074"),
    ("WS/\tMP005/2024-\t2025/145074\r\n-Road", "WS/MP005/2024-2025/145074"),
    ("AB 12-Road", "AB12"),
    (" plain text ", "plain text"),
    (None, None),
])
def test_work_id(spark, cell, expected):
    assert column(spark, [cell], cells.work_id) == [expected]


def test_currency(spark):
    given = ["₹ 4,05,67,400", "abc", None, "12d", "1e3", "-5.50", " 7 ", ""]
    assert column(spark, given, cells.currency) == [40567400.0, 0, 0, 0, 1000.0, -5.5, 7.0, 0]


def test_dates_are_day_first(spark):
    given = ["07-Dec-2025", "07-DEC-2025", "03/04/2024", "2024-05-06", "13/02/2024 10:11",
             "2024-05-06T07:08:09", "junk", None, "31/02/2024"]
    got = [None if d is None else d.isoformat() for d in
           column(spark, given, cells.day_first_timestamp)]
    assert got == ["2025-12-07T00:00:00", "2025-12-07T00:00:00", "2024-04-03T00:00:00",
                   "2024-05-06T00:00:00", "2024-02-13T10:11:00", "2024-05-06T07:08:09", None,
                   None, None]


def test_tokens(spark):
    assert column(spark, ["Site Plan, NOC,,", "", None, " , "], cells.tokens) == [
        ["Site Plan", "NOC"], [], [], []]


def test_search_is_literal(spark):
    assert column(spark, ["xA.Cx", "abc", None], lambda c: cells.has_text(c, "a.c")) == [
        True, False, False]


def test_placeholder_vendor(spark):
    assert column(spark, ["Unknown", " UNKNOWN ", None, "Unknown Ltd"], cells.is_real_vendor) == [
        False, False, False, True]


def test_missing_texts_become_null(spark):
    df = spark.createDataFrame([("None", float("nan")), ("x", 1.0)], "s string, d double")
    assert [tuple(r) for r in cells.normalise_missing(df).collect()] == [(None, None), ("x", 1.0)]


def test_completed_counts_partly_completed(spark):
    assert column(spark, ["Work partially Completed", "COMPLETED", "Sanction", None],
                  cells.is_completed) == [True, True, False, False]
