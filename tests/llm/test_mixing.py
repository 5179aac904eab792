import random
import re

import pytest
from pyspark.sql import functions as F

from worksrisk.llm import mixing


def fill(sizes, weights=(5, 2, 1), most=3.0):
    """Share the total by weight, again and again, until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = {s: 0.0 for s in sizes}
    left, open_ = float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        full, give = set(), left
        for s in open_:
            part = give * weight[s] / total
            room = most * sizes[s] - target[s]
            used = min(part, room)
            target[s] += used
            left -= used
            if part >= room:
                full.add(s)
        open_ -= full
        if not full:
            break
    return target


def rows(n, seed=1):
    draw = random.Random(seed)
    names = ["a", "B", "é", None, "z", "m"]
    return [(i, draw.choices(names, [20, 3, 1, 2, 1, 1])[0], " ".join("w" * draw.randint(1, 9) for _ in range(
        draw.choice([0, 1, 5, 30, 200])))) for i in range(n)]


def check(spark, data):
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, source string, text string, taken string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(data)
    sizes, taken, largest = {}, {}, {}
    for r in out:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.taken == 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    want = fill(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] / 2 + 1e-6
        copies = {r.taken // r.size for r in out if r.source == source and r.size}
        assert not copies or max(copies) - min(copies) <= 1   # complete epochs come first
    return sorted(((r.doc_id, r.taken) for r in out), key=repr)


@pytest.mark.parametrize("per_bucket", [mixing.BUCKET_ROWS, 10])
def test_targets_and_budgets(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", per_bucket)
    data = rows(1500)
    first = check(spark, data)
    random.Random(2).shuffle(data)
    assert check(spark, data) == first


def test_buckets_change_nothing(spark, monkeypatch):
    data = rows(600, 3)
    first = check(spark, data)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert check(spark, data) == first


def test_many_sources_are_joined_without_broadcast(spark, monkeypatch):
    from worksrisk.llm import common
    data = rows(500, 4)
    first = check(spark, data)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert check(spark, data) == first


def test_odd_rows(spark):
    check(spark, [(1, None, None), (1, None, None), (None, "a", "x y"), (2, "a", ""), (3, "b", "w " * 100_000)])
    check(spark, [(1, "a", None)])
    check(spark, [])
    check(spark, [(1, "only", "one two three")])


def test_weights_matter(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("w").alias("text"))
    heavy = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    size = F.lit(1).cast("long")
    out = mixing.mix(docs.unionByName(docs.withColumn("source", F.lit("t")).limit(500)), quality=heavy, size=size,
                     weights=(1, 1)).filter("source = 's'")
    shares = {r.even: r.n for r in out.groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.avg("taken").alias("n")).collect()}
    assert shares[True] > shares[False] * 1.2


def test_keys_rank_like_weighted_draws(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"))
    key = mixing.sampling_key(F.col("doc_id"), F.lit(2.0))
    assert docs.select(F.avg(key)).first()[0] == pytest.approx(0.5, rel=0.1)
