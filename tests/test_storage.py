"""What is stored between steps, and what the joins of the ETL carry."""

import re

from pyspark.sql import functions as F

from worksrisk import standin
from worksrisk.operators import etl
from worksrisk.operators.features import attach_vendor
from worksrisk.session import stored
from worksrisk.sources import star as star_io
from worksrisk.sources.raw import ORDER, HouseFiles

TINY = "/root/testdata/sf0.001"


def test_stored_rows_are_columns_on_disk(spark):
    df = spark.range(5).select("id", F.array("id").alias("a"), F.when(F.col("id") > 2, "x").alias("s"))
    kept = stored(df)
    assert all(f.endswith(".parquet") for f in kept.inputFiles()) and kept.inputFiles()
    assert kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())


def test_rows_that_parquet_cannot_hold_are_stored_too(spark):
    kept = stored(spark.range(2).withColumn("gap", F.lit(None)))
    assert kept.count() == 2


def test_master_shuffles_the_identifier_once_and_inputs_by_the_same_key(spark):
    def table(rows, columns):
        return spark.createDataFrame(rows, f"Work_ID string, {columns}, {ORDER} int")

    day = "Recommended_Date timestamp_ntz"
    files = HouseFiles(
        table([("a", None, 2.0, 1), ("a", None, 9.0, 2), (None, None, 3.0, 3)],
              f"{day}, Recommended_Amount double"),
        table([("a", None, 5.0, "Sanction", 1)],
              "Sanction_Date timestamp_ntz, Sanction_Amount double, Work_Status string"),
        table([], "Completion_Date timestamp_ntz"),
        spark.createDataFrame([("a", "v", 1.0)], "Work_ID string, `Vendor Name` string, Disbursed_Amount double"))
    inputs = spark.createDataFrame([("a", 4), (None, 7)], "Work_ID string, Work_Quantity int")
    master = etl.build_master(files, F.lit("2024-01-01").cast("timestamp_ntz"), inputs)
    got = {r["Work_ID"]: (r["Recommended_Amount"], r["Work_Quantity"]) for r in master.collect()}
    assert got == {"a": (2.0, 4), None: (3.0, None)}
    assert "Work_ID" not in etl.keyed(files.recommended).columns and ORDER not in master.columns


def test_first_lines_are_those_of_the_dedupe(spark):
    first = standin._first_lines(spark, TINY).select("Work_ID", "l_partkey", "l_suppkey", "l_quantity")
    whole = etl.keep_first(standin._lines(spark, TINY), ["Work_ID"], [ORDER]).select(first.columns)
    assert sorted(first.collect()) == sorted(whole.collect())


def test_inputs_are_read_from_the_stored_lines(spark):
    """No export or input shuffles lines to meet customers or parts, whatever the size of those."""
    standin.exports(spark, TINY)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 2000)   # only nations and regions are smaller
    try:
        for df in (standin.exports(spark, TINY).recommended, standin.work_inputs(spark, TINY),
                   standin.compliance_inputs(spark, TINY)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            for key in ("custkey", "partkey"):
                assert not re.search(rf"hashpartitioning\([lopc]_{key}", plan), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_the_order_of_entries_is_that_of_whole_lines(spark, tmp_path):
    """Also where two orders share a work, or lines have none."""
    lines = spark.read.parquet(f"{TINY}/lineitem.parquet")
    orders = spark.read.parquet(f"{TINY}/orders.parquet")
    odd = {"none": (lines, orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")))),
           "two": (lines.withColumn("l_linenumber", (F.col("l_linenumber") + F.when(
               F.col("l_orderkey") % 3 == 0, 10).otherwise(0)).cast("int")),
               orders.withColumns({"o_custkey": F.lit(5).cast("long"), "o_orderdate": F.lit("1996-05-01").cast("timestamp_ntz")}))}
    for name, (some, of) in odd.items():
        folder = str(tmp_path / name)
        for other in ("customer", "part", "supplier", "nation", "region"):
            spark.read.parquet(f"{TINY}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
        some.write.parquet(f"{folder}/lineitem.parquet")
        of.write.parquet(f"{folder}/orders.parquet")
        short = etl.build_master(standin.exports(spark, folder), standin.as_of())
        long = etl.build_master(standin.exports(spark, folder, sortable=True), standin.as_of())
        assert short.count() == long.count() and short.exceptAll(long).isEmpty()
    short = standin.exports(spark, TINY).sanctioned
    assert dict(short.dtypes)[ORDER] == "int"
    first = etl.keep_first(short, ["Work_ID"], [ORDER]).drop(ORDER)
    whole = etl.keep_first(standin.exports(spark, TINY, sortable=True).sanctioned, ["Work_ID"], [ORDER]).drop(ORDER)
    assert sorted(first.collect()) == sorted(whole.collect())


def test_a_small_side_reaches_works_without_a_shuffle_of_them(spark):
    star = standin.star(spark, TINY)
    plan = attach_vendor(star.works, star.vendors)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(Vendor_Name" not in plan


def test_works_in_buckets_of_their_order_are_joined_without_a_shuffle(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10000)   # only suppliers are smaller
    try:
        files = standin.exports(spark, TINY, keyed=True)
        first = etl.keep_first(etl.keyed(files.sanctioned), [etl.GROUP, etl.KEY], [ORDER])
        paid = etl.expenditure_per_work(files.expenditure, etl.KEY)
        for side in (paid, standin.work_inputs(spark, TINY).drop("Work_ID")):
            plan = etl.join_of_work(first, side)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plain = etl.build_master(standin.exports(spark, TINY), standin.as_of(), standin.work_inputs(spark, TINY))
    assert plain.exceptAll(standin.master(spark, TINY)).isEmpty() and plain.count() == standin.master(spark, TINY).count()


def test_orders_of_one_key_and_two_customers_make_different_works(spark, tmp_path):
    folder = str(tmp_path / "mixed")
    orders = spark.read.parquet(f"{TINY}/orders.parquet")
    for other in ("customer", "part", "supplier", "nation", "region", "lineitem"):
        spark.read.parquet(f"{TINY}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
    orders.union(orders.filter("o_orderkey % 9 = 0").withColumn(
        "o_custkey", (F.col("o_custkey") + 1).cast("long"))).write.parquet(f"{folder}/orders.parquet")
    short = standin.master(spark, folder)
    whole = etl.build_master(standin.exports(spark, folder, sortable=True), standin.as_of(),
                             standin.work_inputs(spark, folder))
    assert short.count() == whole.count() > standin.master(spark, TINY).count()
    assert short.exceptAll(whole).isEmpty()


def test_compliance_columns_that_come_with_the_master_equal_those_joined_later(spark):
    plain = etl.compliance_table(standin.master(spark, TINY), standin.compliance_inputs(spark, TINY))
    kept = standin.star(spark, TINY).compliance.select(plain.columns)
    assert kept.count() == plain.count() and kept.exceptAll(plain).isEmpty()


def test_entries_of_a_work_follow_one_another_in_its_export(spark, tmp_path, monkeypatch):
    """In one part file, in the order of the work's lines; where orders share works, whole files are sorted."""
    def entries(name):
        path = f"{standin.write_csv_exports(spark, TINY, 'Lok Sabha')}/{name}"
        rows = (spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
                .select("*", F.col("_metadata.file_path").alias("file"),
                        F.monotonically_increasing_id().alias("line")).orderBy("file", "line").collect())
        assert all(r.file.endswith(".csv.gz") for r in rows)
        return rows

    rows = entries("Works Sanctioned (1).csv")
    works = [(r.file, r.Work) for r in rows]
    runs = [w for i, w in enumerate(works) if i == 0 or works[i - 1] != w]
    assert len(rows) > len(runs) == len(set(runs)) == len({w for _, w in runs})
    day = next(c for c in rows[0].asDict() if "Sanction" in c and "Date" in c)
    first = {}
    for r in rows:
        first.setdefault(r.Work.rsplit("-", 1)[0], r[day])
    kept = etl.keep_first(standin.exports(spark, TINY, sortable=True).sanctioned, ["Work_ID"], [ORDER])
    wanted = {r.Work_ID: r.day for r in kept.select("Work_ID", F.date_format("Sanction_Date", "dd-MMM-yyyy").alias("day"))
              .collect()}
    assert {w: wanted[w] for w in first} == first
    monkeypatch.setattr(standin, "_works_share_orders", lambda *_: True)
    sorted_rows = entries("Works Sanctioned (1).csv")
    assert sorted((r.Work, r[day]) for r in sorted_rows) == sorted((r.Work, r[day]) for r in rows)


def test_a_star_may_be_packed_csv(spark, tmp_path):
    star = standin.star(spark, TINY)
    sizes = {}
    for codec in (None, "gzip"):
        folder = tmp_path / str(codec)
        star_io.write_star(star, str(folder), fmt="csv", compression=codec)
        sizes[codec] = sum(f.stat().st_size for f in folder.rglob("*.csv*") if f.is_file())
        works = star_io.read_star(spark, str(folder), fmt="csv").works
        assert works.count() == star.works.count() and works.exceptAll(star.works.select(works.columns)).isEmpty()
    assert sizes["gzip"] * 3 < sizes[None]
