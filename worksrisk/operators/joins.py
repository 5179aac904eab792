"""Left joins that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksrisk.session import stored

HELD = 500_000    # rows of a side that a task may hold, some 60 MB; larger sides are shuffled
HOT_SHARE = 128   # a key is hot above 1/128 of all rows, so there are fewer than 128 of them


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def hot_keys(counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Keys that hold more than 1/128 of the total: fewer than 128 rows whatever the input.

    ``counts`` has one row per key, so the share is a sum over few rows per key and the
    result is small enough to broadcast by construction. ``_salts`` is the number of tasks
    that a key's rows are dealt over: its share of the shuffle partitions, rounded up, and
    twice that, so that no salt holds much more than an ordinary partition.
    """
    total = counts.select(F.sum(count).alias("total")).scalar()
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salts = F.greatest(F.lit(2), F.ceil(F.col(count) * F.lit(2.0 * tasks) / total)).cast("int")
    return (counts.filter(F.col(count) * F.lit(HOT_SHARE) > total)
            .select(*keys, salts.alias("_salts")))


def left_join(fact: DataFrame, side: DataFrame, keys: list[str], *,
              null_safe: bool = False) -> DataFrame:
    """Plain left join; ``null_safe`` lets a null key find the null key of the side.

    No hint: the size of the side is measured at run time and decides between a
    broadcast and a sort-merge join, where oversized partitions are split.
    """
    if not null_safe:
        return fact.join(side, keys, "left")
    right = side.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c)
                         for c in side.columns])
    match = _all([F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return fact.join(right, match, "left").drop(*(f"_r_{k}" for k in keys))


def few(side: DataFrame) -> bool:
    """Whether a stored side has so few rows that it may reach the others without shuffling them."""
    return side.limit(HELD + 1).count() <= HELD


def spread_left_join(fact: DataFrame, side: DataFrame, keys: list[str], hot: DataFrame, *,
                     scatter: Column | None = None, salt: Column | None = None,
                     store: bool = False) -> DataFrame:
    """Left join whose hot keys are dealt over many tasks.

    Rows of a hot key take one of its salts, and the side repeats its rows of those keys
    (only those) once per salt. ``scatter`` marks fact rows known to have no partner, such
    as a placeholder; they are dealt out too instead of meeting in one task. ``salt`` is a
    whole number that varies among a key's rows, by default a hash of the whole row. ``hot``
    must come from :func:`hot_keys`. ``store`` writes the side with its repeats first: its size is
    then known before the join, so a small side reaches the fact rows without shuffling them.
    """
    marks = F.broadcast(hot)
    tasks = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salts = F.col("_salts")
    if scatter is not None:
        salts = F.coalesce(salts, F.when(F.coalesce(scatter, F.lit(False)), F.lit(tasks)))
    if salt is None:
        salt = F.xxhash64(*[F.col(f"`{c}`") for c in fact.columns])
    salted = (fact.withColumn("_deal", salt).join(marks, keys, "left")
              .withColumn("_salt", F.coalesce(F.pmod("_deal", salts), F.lit(0)).cast("int"))
              .drop("_salts", "_deal"))
    copies = (side.join(marks, keys, "left")
              .withColumn("_salt", F.explode(F.sequence(
                  F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts"))
    if store:
        copies = stored(copies)
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")
