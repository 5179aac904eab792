import pytest
from pyspark.sql import functions as F

from worksrisk.operators import etl
from worksrisk.sources import raw

HEAD = {
    "Works Recommended (1).csv": '"Sr. No.","State","Constituency","Work","Work Description",'
                                 '"Recommended Date","Recommended Amount ( ₹ )",'
                                 '"Hon\'ble Members of Parliament"',
    "Works Sanctioned (1).csv": '"Sr. No.","Work","SANCTION DATE","Sanction Amount ( ₹ )",'
                                '"Work Status"',
    "Works Completed (1).csv": '"Sr. No.","Work","Complete Date"',
    "Expenditure (1).csv": '"Sr. No.","Work ID","Vendor Name","Fund Disbursed Amount ( ₹ )"',
}
BODY = {
    "Works Recommended (1).csv": [
        '"1","S","C","WS/ MP1/2024-2025/7-Road\nto school","Road ""A""","01-Jan-2024",'
        '"4,05,67,400","M One"',
        '"2","S","C","WS/MP1/2024-2025/7-again","later copy","02-Jan-2024","1","M Two"',
        '"3","S","D","AB 12-Hall","NA","03/02/2024","abc","M One"',
        '"Grand Total"," "," "," "," "," ","4,05,67,401"," "'],
    "Works Sanctioned (1).csv": [
        '"1","WS/MP1/2024-2025/7","11-Jan-2024","₹ 100","Work partially Completed"',
        '"2","WS/MP1/2024-2025/7","12-Jan-2024","200","Sanction"'],
    "Works Completed (1).csv": ['"1","WS/MP1/2024-2025/7","21/01/2024"'],
    "Expenditure (1).csv": ['"1"," WS/MP1/2024-2025/7 ","B","60"',
                            '"2","WS/MP1/2024-2025/7","A","60"', '"3","","Z","5"'],
}


@pytest.fixture
def folder(tmp_path):
    for name, head in HEAD.items():
        (tmp_path / name).write_text("﻿" + "\n".join([head, *BODY[name]]) + "\n", "utf-8")
    return str(tmp_path)


def as_of():
    return F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")


def test_whole_run(spark, folder):
    house = raw.read_house(spark, folder, "Rajya Sabha")
    files = raw.union_houses([None, house])
    got = {r["Work_ID"]: r for r in etl.build_master(files, as_of()).collect()}
    assert set(got) == {"WS/MP1/2024-2025/7", "AB12"}
    road, hall = got["WS/MP1/2024-2025/7"], got["AB12"]
    assert road["MP_Name"] == "M One" and road["Work_Description"] == 'Road "A"'
    assert road["Recommended_Amount"] == 40567400 and road["Sanction_Amount"] == 100
    assert road["Disbursed_Amount"] == 120 and road["Vendor_Name"] == "A"
    assert (road["Days_to_Sanction"], road["Days_to_Complete"], road["Days_Pending"]) == (10, 10, None)
    assert road["Cost_Overrun_Ratio"] == pytest.approx(1.2) and road["Cost_Overrun_Amount"] == 20
    assert road["Elected_or_Nominated"] == "Nominated"
    assert hall["Work_Status"] == "Recommended" and hall["Vendor_Name"] == "Unknown"
    assert hall["Recommended_Amount"] == 0 and hall["Work_Description"] is None
    assert hall["Days_Pending"] == 27 and hall["Disbursed_Amount"] == 0


def test_trailer_can_be_kept(spark, folder):
    kept = raw.read_house(spark, folder, "Lok Sabha", drop_trailer=False)
    assert kept.recommended.count() == 4


def test_every_file_of_a_kind_is_read_in_order_of_name(spark, folder, tmp_path):
    more = {"Works Recommended (2).csv": ['"1,001","S","E","WS/MP9/2024-2025/9","more","04-Jan-2024","5","M Two"',
                                          '"","S","E","WS/MP1/2024-2025/7","a copy in a later file","",'
                                          '"9","M Two"'],
            "Expenditure (2).csv": ['"12.0","WS/MP9/2024-2025/9","C","7"']}
    for name, rows in more.items():
        head = HEAD[name.replace("(2)", "(1)")].replace("Fund Disbursed Amount", "Amount paid")
        (tmp_path / name).write_text("\n".join([head, *rows]) + "\n", "utf-8")
    house = raw.read_house(spark, folder, "Lok Sabha")
    got = {r["Work_ID"]: r for r in etl.build_master(raw.union_houses([house]), as_of()).collect()}
    assert set(got) == {"WS/MP1/2024-2025/7", "AB12", "WS/MP9/2024-2025/9"}
    assert got["WS/MP9/2024-2025/9"]["Disbursed_Amount"] == 7
    assert got["WS/MP1/2024-2025/7"]["Work_Description"] == 'Road "A"'
    assert got["WS/MP1/2024-2025/7"]["Disbursed_Amount"] == 120


def test_missing_house(spark, folder, tmp_path):
    assert raw.read_house(spark, str(tmp_path / "nowhere"), "Lok Sabha") is None
    with pytest.raises(ValueError):
        raw.union_houses([None, None])


def test_absent_columns_get_defaults(spark):
    def frame(*names):
        return spark.createDataFrame([("x",) * len(names) + ((0,),)],
                                     ", ".join(f"`{n}` string" for n in names)
                                     + f", {raw.ORDER} struct<line:int>")

    files = raw.shape_house(frame("State"), frame("Work Status"), frame("Complete Date"),
                            frame("Vendor Name"), "Lok Sabha")
    assert files.recommended.first()["Recommended_Amount"] == 0.0
    assert files.recommended.first()["Work_ID"] is None
    assert files.expenditure.first()["Disbursed_Amount"] == 0.0
    assert files.expenditure.first()["Work_ID"] is None


def test_houses_may_differ_in_columns(spark, folder):
    a = raw.read_house(spark, folder, "Lok Sabha")
    b = raw.HouseFiles(a.recommended.withColumn("Extra", F.lit(1)), a.sanctioned, a.completed,
                       a.expenditure)
    both = raw.union_houses([a, b])
    assert both.recommended.filter("Extra is null").count() == 3
    assert etl.keep_first(both.recommended, ["Work_ID"], [raw.ORDER]).filter(
        "Extra is not null").count() == 0


@pytest.mark.parametrize("header, name", [
    (" work description ", "Work_Description"), ("Hon'ble Member", "MP_Name"),
    ("Date of Completion Date", "Completion_Date"), ("Work", "Work_String"),
    ("Work Category", "Work Category"), ("Work ID", "Work ID"), ("IDA", "IDA"),
])
def test_headers(header, name):
    assert raw.canonical_header(header) == name
