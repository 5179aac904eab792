"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight. A source whose
target is ``e`` times its size is taken ``floor(e)`` times whole (complete epochs); the
remainder goes to the documents with the smallest keys, by a running sum of sizes.

No task orders a whole source: keys are cut into buckets of bounded share, whole buckets
are decided from their sums, and only the one bucket of each source in which the budget
runs out is put in order row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksrisk.llm.common import checked_join, named_apart
from worksrisk.session import Staging

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = (0.25, 0.5, 1.0, 2.0, 4.0)   # quality weights are clipped to this range
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """2 for words of 6 characters on average, less the further away; 0.25 at least."""
    mean = F.char_length(F.coalesce(text, F.lit(""))) / F.when(size > 0, size)
    return F.greatest(F.lit(LEVELS[0]),
                      F.coalesce(F.lit(2.0) / (F.lit(1.0) + F.abs(mean - 6.0)), F.lit(0.0)))


def sampling_key(doc_id: Column, weight: Column, seed: int = 0) -> Column:
    """Exponential draw divided by the weight; the draw depends on the id and seed alone."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"))), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(uniform) / F.least(F.lit(LEVELS[-1]), F.greatest(F.lit(LEVELS[0]), weight))


def _spread(key: Column) -> Column:
    """A rising function of the key to 0..1 that no weight concentrates.

    It is the mean of the exponential distributions of five weights, so a bucket of width
    1/B holds at most 10/B of the rows of any one weight, whatever the weights are.
    """
    parts = [F.lit(1.0) - F.exp(key * -w) for w in LEVELS]
    return sum(parts[1:], parts[0]) / float(len(parts))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0,
                   ) -> DataFrame:
    """``source, source_size`` (one row per source) with ``target`` added.

    Sources by code point, null last, take the weights in turn and share the total size. A
    target stops at ``most`` times its source's size and the excess goes to the others by
    weight until none is above: the limit of that sharing is one level L, with target =
    min(weight * L, cap), found from running sums in order of cap / weight. Works on one row
    per source.
    """
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    by_cap = everything.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (sizes.withColumn("_w", F.element_at(
                  F.array(*[F.lit(float(w)) for w in weights]),
                  ((place - 1) % len(weights) + 1).cast("int")))
              .withColumn("_cap", F.col("source_size") * float(most))
              .withColumn("_ratio", F.col("_cap") / F.col("_w")))
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = (ranked.withColumn("_level", left / weight_left)
             .withColumn("_open", F.when(F.col("_ratio") > F.col("_level"), F.col("_level")))
             .withColumn("_level", F.first("_open", ignorenulls=True).over(
                 by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return level.select("source", "source_size", F.when(
        F.col("_level").isNull(), F.col("_cap")).otherwise(
        F.least(F.col("_w") * F.col("_level"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0,
        seed: int = 0, size: Column | None = None, quality: Column | None = None) -> DataFrame:
    """Every row of ``docs`` (``doc_id, source, text``, any others) with the mix's decision.

    Adds ``size`` (words), ``source_size``, ``target`` and ``taken`` (words taken, repeats
    counted; ``taken / size`` copies). Columns of ``docs`` with these names are replaced. A
    null or empty text has size 0 and is never taken. Null sources are one source. Equal keys
    go by doc_id, then by size; repeated rows are decided one by one. No document is taken
    more than ``ceil(most)`` times. An empty table gives an empty result.
    """
    stage = Staging(docs.sparkSession, "mix")
    own = ["size", "source_size", "target", "taken"]
    names = [c for c in docs.columns if c not in own]
    size = word_count(F.col("text")) if size is None else size
    # the other columns travel in one struct, so that their names cannot clash with ours
    sized = docs.select("doc_id", "source", "text", F.struct(*names).alias("_row"),
                        size.alias("size"))
    weight = quality_weight(F.col("text"), F.col("size")) if quality is None else quality
    sized = sized.withColumn("_key", sampling_key(F.col("doc_id"), weight, seed))

    narrow = stage.table("keys", sized.select("source", "size", _spread(F.col("_key")).alias("_p")))
    per_source = stage.table("sources", narrow.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    n_sources = per_source.count()
    plan = (source_targets(per_source.select("source", "source_size"), weights, most)
            .withColumn("_full", F.when(F.col("source_size") > 0, F.least(
                F.floor(F.col("target") / F.col("source_size")),
                F.lit(math.floor(most)))).otherwise(F.lit(0)).cast("long"))
            .withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size")))
    plan = named_apart(per_source.select("source", "_rows"), plan, ["source"])
    plan = stage.table("plan", plan.withColumn(
        "_buckets", (F.floor(F.col("_rows") / BUCKET_ROWS) + 1).cast("long")))

    def bucket(p: Column) -> Column:
        return F.least(F.floor(p * F.col("_buckets")), F.col("_buckets") - 1)

    sums = (checked_join(narrow, plan.select("source", "_buckets", "_rest"), ["source"], n_sources)
            .groupBy("source", "_rest", bucket(F.col("_p")).alias("_bucket"))
            .agg(F.sum("size").alias("_words")))
    order = Window.partitionBy("source").orderBy("_bucket")
    cut = (sums.withColumn("_end", F.sum("_words").over(order))
           .filter(F.col("_end") > F.col("_rest"))
           .groupBy("source").agg(F.min("_bucket").alias("_cut"),
                                  F.min(F.col("_end") - F.col("_words")).alias("_start")))
    plan = stage.table("cuts", named_apart(plan, cut, ["source"]))
    stage.drop("keys")

    rows = checked_join(sized, plan, ["source"], n_sources)
    rows = rows.withColumn("_bucket", bucket(_spread(F.col("_key"))))
    inside = F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    whole = rows.filter(~inside).withColumn("_more", F.coalesce(
        F.col("_bucket") < F.col("_cut"), F.lit(True)))
    running = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    # a document on the edge is taken if that brings the sum nearer to the budget
    middle = F.col("_start") + F.sum("size").over(running) - F.col("size") / 2
    edge = rows.filter(inside).withColumn("_more", middle <= F.col("_rest"))
    taken = F.col("size") * (F.col("_full") + F.col("_more").cast("long"))
    return whole.unionByName(edge).withColumn("taken", taken).select(
        *[F.col("_row")[c].alias(c) for c in names], *own)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, as often as :func:`mix` takes them.

    Texts without words are not in it.
    """
    names = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*names).alias("_packed"))
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    rows = mix(packed, **how).filter(copies > 0)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select(
        *[F.col("_packed")[c].alias(c) for c in names])
