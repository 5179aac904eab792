"""Helpers that several training-data operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksrisk.operators.joins import hot_keys, spread_left_join

BROADCAST_ROWS = 20_000   # narrow sides with at most so many rows are sent to every task


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python at most 1,000 at a time, in this session from now on.

    Spark's 10,000 are meant for narrow rows; a smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named_apart(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys; the keys of the left side stay."""
    renamed = right.select([F.col(c).alias(f"_right_{c}") if c in keys else F.col(c)
                            for c in right.columns])
    match = reduce(lambda a, b: a & b,
                   [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, match, "left").drop(*(f"_right_{k}" for k in keys))


def checked_join(fact: DataFrame, side: DataFrame, keys: list[str], side_rows: int) -> DataFrame:
    """Left join, null-safe, with a narrow table of one row per key and known row count.

    A side of at most 20,000 rows is broadcast. A larger one is joined by a shuffle in which
    the keys with more than 1/128 of the fact rows are dealt over many tasks.
    """
    if side_rows <= BROADCAST_ROWS:
        return named_apart(fact, F.broadcast(side), keys)
    marked = [f"_k_{k}" for k in keys]

    def keyed(df: DataFrame) -> DataFrame:
        # never null, so that plain equality and hash partitioning fit; no two keys meet
        return df.withColumns({m: F.struct(F.col(k).isNull(), F.col(k)).cast("string")
                               for m, k in zip(marked, keys)})

    fact = keyed(fact)
    hot = hot_keys(fact.groupBy(*marked).agg(F.count(F.lit(1)).alias("_n")), marked, "_n")
    return spread_left_join(fact, keyed(side).drop(*keys), marked, hot).drop(*marked)
