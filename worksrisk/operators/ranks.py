"""Exact ranks, percentiles and medians over whole tables without a one-task window.

Everything starts from ``positions``: for each distinct value, how many rows hold it
(``eq``), how many lie below (``lt``), and how many there are (``n``). Equal values are
counted before the shuffle, so a value shared by a third of the rows costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksrisk.operators.joins import HELD, hot_keys, left_join, spread_left_join
from worksrisk.session import stored


def melt(df: DataFrame, ids: list[str], values: dict[str, Column] | list[str]) -> DataFrame:
    """One (ids, feature, value) row per named measure; nulls are left out."""
    if not isinstance(values, dict):
        values = {name: F.col(name) for name in values}
    pairs = F.array(*(F.struct(F.lit(name).alias("feature"), c.cast("double").alias("value"))
                      for name, c in values.items()))
    return (df.select(*ids, F.explode(pairs).alias("_p")).select(*ids, "_p.*")
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))


def _buckets(df: DataFrame) -> int:
    """A power of two near the number of shuffle partitions, so a bucket fits a task."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return 1 << max(3, partitions.bit_length() - 1)


def _with_bucket(df: DataFrame, k: int) -> DataFrame:
    """``_bucket``: how many of the k-1 sorted cuts are at or below the value.

    A binary search written as log2(k) projections, which stay in generated code; a
    lambda over the array would be interpreted k times per row.
    """
    out, step = df.withColumn("_bucket", F.lit(0)), k // 2
    while step:
        cut = F.get("_cuts", F.col("_bucket") + F.lit(step - 1))
        out = out.withColumn("_bucket", F.col("_bucket") + F.when(
            cut <= F.col("value"), F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return out.drop("_cuts")


def counted_positions(counts: DataFrame, by: list[str]) -> DataFrame:
    """``lt`` and ``n`` for a table of (by, value, eq, ...), one row per distinct value.

    Approximate quantiles of the distinct values cut each group into buckets; the
    running count is taken inside a bucket and shifted by the total of the buckets
    below. The cut points need not be exact for the result to be.
    """
    k = _buckets(counts)
    # reading the count keeps this branch on the same shuffle as the others
    cuts = counts.filter("eq >= 0").groupBy(*by).agg(
        F.percentile_approx("value", [i / k for i in range(1, k)], F.lit(20 * k)).alias("_cuts"))
    if by == ["feature"]:   # one row for each measure that a caller named
        cuts = F.broadcast(cuts)
    placed = _with_bucket(counts.join(cuts, by), k)
    below = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (placed.groupBy(*by, "_bucket").agg(F.sum("eq").alias("_eq"))
              .withColumn("_before", F.coalesce(F.sum("_eq").over(below), F.lit(0)))
              .withColumn("n", F.sum("_eq").over(Window.partitionBy(*by)))
              .drop("_eq"))
    running = (Window.partitionBy(*by, "_bucket").orderBy("value")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (placed.join(totals, [*by, "_bucket"])
            .withColumn("lt", F.col("_before") + F.sum("eq").over(running) - F.col("eq"))
            .drop("_bucket", "_before"))


def value_counts(long: DataFrame, by: list[str]) -> DataFrame:
    return long.groupBy(*by, "value").agg(F.count("*").alias("eq"))


def positions(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, eq, lt, n) of a long table with a ``value`` column."""
    return counted_positions(value_counts(long, by), by)


def medians(placed: DataFrame, by: list[str]) -> DataFrame:
    """Exact median per group: the middle value, or the mean of the two middle ones."""
    def at(offset: int) -> Column:
        rank = F.floor((F.col("n") - offset) / 2)
        return F.max(F.when((F.col("lt") <= rank) & (rank < F.col("lt") + F.col("eq")),
                            F.col("value")))

    return (placed.groupBy(*by).agg(at(1).alias("_low"), at(0).alias("_high"))
            .select(*by, ((F.col("_low") + F.col("_high")) / 2).alias("median")))


def quantile(placed: DataFrame, by: list[str], q: float) -> DataFrame:
    """Exact quantile per group, interpolated between the two values around it."""
    spot = (F.col("n") - 1) * F.lit(q)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("lt") <= rank) & (rank < F.col("lt") + F.col("eq")),
                            F.col("value")))

    low, high, part = F.col("_low"), F.col("_high"), F.col("_part")
    return (placed.groupBy(*by).agg(at(F.floor(spot)).alias("_low"), at(F.ceil(spot)).alias("_high"),
                                    F.max(spot - F.floor(spot)).alias("_part"))
            .select(*by, (low + (high - low) * part).alias("quantile")))


def with_positions(long: DataFrame, by: list[str]) -> DataFrame:
    """Positions on every row; values shared by many rows are dealt over tasks."""
    keys = [*by, "value"]
    counts = value_counts(long, by)
    hot = hot_keys(counts.filter("eq > 1"), keys, "eq")
    return spread_left_join(long, counted_positions(counts, by), keys, hot)


def descending_rank(df: DataFrame, value: str, alias: str) -> DataFrame:
    """1 for the largest value, ties share the best rank, a null value has none."""
    counts = value_counts(melt(df, [], [value]), ["feature"])
    ranks = counted_positions(counts, ["feature"]).select(
        F.col("value").alias(value),
        (F.col("n") - F.col("lt") - F.col("eq") + 1).cast("int").alias(alias))
    hot = hot_keys(counts.filter("eq > 1").withColumnRenamed("value", value), [value], "eq")
    return spread_left_join(df, ranks, [value], hot).select(*df.columns, alias)


def average_percentile(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, feature, value, pct): share at or below, equal values take their mean rank."""
    ranked = with_positions(melt(df, [key], values), ["feature"])
    return ranked.select(key, "feature", "value",
                         ((F.col("lt") + (F.col("eq") + 1) / 2) / F.col("n")).alias("pct"))


def left_positions(queries: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, feature, value, lt, n): reference rows strictly below each query value, and all of them.

    ``queries`` is (key, feature, value); ``reference`` is (feature, value, eq), one row
    per distinct value. Queried values join the reference with a count of zero, so
    one pass places both and no range join is needed.
    """
    asked = value_counts(queries, ["feature"])
    both = (reference.select("feature", "value", "eq")
            .unionByName(asked.withColumn("eq", F.col("eq") * 0))
            .groupBy("feature", "value").agg(F.sum("eq").alias("eq")))
    placed = counted_positions(both, ["feature"]).drop("eq")
    hot = hot_keys(asked.filter("eq > 1"), ["feature", "value"], "eq")
    return (spread_left_join(queries, placed, ["feature", "value"], hot)
            .select(key, "feature", "value", "lt", "n"))


def left_percentile(queries: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, feature, value, pct): share of the reference strictly below; without any, 0.5."""
    share = F.when(F.col("n") > 0, F.col("lt") / F.col("n")).otherwise(F.lit(0.5))
    return left_positions(queries, reference, key).select(
        key, "feature", "value", share.alias("pct"))


def with_left_percentiles(df: DataFrame, key: str, values: dict[str, Column], reference: DataFrame) -> DataFrame:
    """``df`` with a column for each named measure: its :func:`left_percentile`, null where it has no value.

    The places of distinct values are found and stored once. Measures of few distinct values bring them to
    the rows; each of the others shuffles the rows once, by their values. No row is taken apart.
    """
    asked = value_counts(melt(df, [], values), ["feature"]).withColumns(
        {"_asked": F.col("eq"), "eq": F.col("eq") * 0})
    both = (reference.select("feature", "value", "eq", F.lit(0).cast("long").alias("_asked")).unionByName(asked)
            .groupBy("feature", "value").agg(F.sum("eq").alias("eq"), F.sum("_asked").alias("_asked")))
    share = F.when(F.col("n") > 0, F.col("lt") / F.col("n")).otherwise(F.lit(0.5))
    placed = stored(counted_positions(both, ["feature"]).filter("_asked > 0")
                    .select("feature", "value", share.alias("pct"), "_asked"))
    sizes = {r["feature"]: r["count"] for r in placed.groupBy("feature").count().collect()}
    out = df
    for name, value in values.items():
        out = out.withColumn("_value", value.cast("double"))
        found = placed.filter(F.col("feature") == name)
        side = found.select(F.col("value").alias("_value"), F.col("pct").alias(name))
        if sizes.get(name, 0) <= HELD:
            out = left_join(out, F.broadcast(side), ["_value"])
        else:
            hot = hot_keys(found.select(F.col("value").alias("_value"), "_asked").filter("_asked > 1"),
                           ["_value"], "_asked")
            gap = F.col("_value").isNull() | F.isnan("_value")
            out = spread_left_join(out, side, ["_value"], hot, scatter=gap, salt=F.xxhash64(key))
        out = out.drop("_value")
    return out


def reference_counts(df: DataFrame, values: dict[str, Column] | list[str]) -> DataFrame:
    """A stored distribution: (feature, value, eq), one row per distinct value."""
    return melt(df, [], values).groupBy("feature", "value").agg(F.count("*").alias("eq"))


# ------------------------------------------------------- distributions of fixed size
SKETCH = 4096     # k of a sketch: ranks err by about 2.3 / k^0.9, here 0.13 %
GRID = 1024       # percentiles that are read off a sketch
RANK_ERROR = 2.3 / SKETCH ** 0.9 + 1 / GRID


def reference_sketches(df: DataFrame, values: dict[str, Column] | list[str], k: int = SKETCH) -> DataFrame:
    """A stored distribution of bounded size: (feature, sketch, n), one row per measure.

    :func:`reference_counts` keeps a row per distinct value and is exact; a KLL sketch is at most
    some 100 KB however many rows it has seen.
    """
    return melt(df, [], values).groupBy("feature").agg(
        F.kll_sketch_agg_double("value", k).alias("sketch"), F.count("*").alias("n"))


def merged_sketches(*parts: DataFrame) -> DataFrame:
    """One distribution of several, such as last month's and this month's."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("feature").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketch_percentile(queries: DataFrame, sketches: DataFrame, key: str) -> DataFrame:
    """(key, feature, value, pct) as :func:`left_percentile`, within ``RANK_ERROR``.

    Each sketch gives a grid of percentiles once, which is searched for every value; a measure
    without any rows gives 0.5.
    """
    shares = F.array(*(F.lit(i / GRID) for i in range(1, GRID)))
    grids = sketches.select("feature", F.kll_sketch_get_quantile_double("sketch", shares).alias("_cuts"))
    # one row of 1,023 numbers for each measure that a caller named
    out, step = queries.join(F.broadcast(grids), "feature", "left").withColumn("_below", F.lit(0)), GRID // 2
    while step:
        cut = F.get("_cuts", F.col("_below") + F.lit(step - 1))
        out = out.withColumn("_below", F.col("_below") + F.when(
            cut < F.col("value"), F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    share = F.when(F.col("_cuts").isNull(), F.lit(0.5)).otherwise(F.col("_below") / F.lit(float(GRID)))
    return out.select(key, "feature", "value", share.alias("pct"))
