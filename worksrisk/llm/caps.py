"""Similar vectors by spherical-cap filters with structured random product codes.

A code turns the space at random and halves its dimensions; each half has B random unit
codewords, and every pair of codewords is one of B*B filter directions. A vector is list-decoded
to the filters whose caps hold it: the caps' height is the vector's own, so that its list has
L filters from each of R independent codes. The sorted scores of both halves give the list
without looking at B*B directions. Vectors with a cosine of 0.9 in 64 dimensions share
about 18 filters of 72; 0.3 % of them share none.

Vectors that share a filter are compared exactly, in blocks, and a pair counts only in the
smallest filter that both have. Nothing is ever listed pair by pair: each block gives sums of
links and a spanning forest.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksrisk.llm.graph import connected_components
from worksrisk.session import Staging

CODES, LIST = 3, 24
OCCUPANCY = 0.3        # unlike vectors for each filter of a code, by choice of B
MOST_CODEWORDS = 1 << 14   # bounds a code's size; beyond it filters fill up, none is cut
BLOCK = 512


# ------------------------------------------------------------------------ codes
def codewords(n: int) -> int:
    """Codewords of a half for n vectors."""
    return int(min(MOST_CODEWORDS, max(LIST, math.ceil(math.sqrt(LIST * n / OCCUPANCY)))))


@functools.lru_cache(maxsize=4)
def _codes(d: int, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each code: both halves' codewords, turned back into the whole space."""
    draw = np.random.default_rng([d, size, 5])
    found = []
    for _ in range(CODES):
        turn, _ = np.linalg.qr(draw.normal(size=(d, d)))
        halves = []
        for part in np.array_split(np.arange(d), 2):
            words = draw.normal(size=(size, len(part)))
            length = np.linalg.norm(words, axis=1, keepdims=True)
            halves.append(words / np.where(length > 0, length, 1) @ turn[part])
        found.append(tuple(halves))
    return found


_PAIRS = np.array([(i, j) for i in range(LIST) for j in range(LIST) if (i + 1) * (j + 1) <= LIST])


def decode(units: np.ndarray, size: int) -> np.ndarray:
    """Ids of the filters of each row: ``CODES * LIST`` columns, each row sorted.

    The best pair sums are among places i, j of the halves' orders with (i+1)(j+1) <= LIST.
    """
    n, d = units.shape
    lists = []
    for number, halves in enumerate(_codes(d, size)):
        best, score = [], []
        for words in halves:
            s = units @ words.T
            top = np.argpartition(-s, LIST - 1, axis=1)[:, :LIST] if size > LIST else \
                np.tile(np.arange(size), (n, 1))
            order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
            best.append(np.take_along_axis(top, order, 1))
            score.append(np.take_along_axis(s, best[-1], 1))
        a, b = _PAIRS.T
        total = score[0][:, a] + score[1][:, b]
        ids = best[0][:, a].astype(np.int64) * size + best[1][:, b]
        chosen = np.argsort(-total, axis=1, kind="stable")[:, :LIST]
        lists.append(np.take_along_axis(ids, chosen, 1) + number * size * size)
    return np.sort(np.concatenate(lists, axis=1), axis=1)


# ------------------------------------------------------------------------ tasks
def _units(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        names, units = [], []
        for value in batch.column("v").to_pylist():
            v = np.array(value, np.float64) + 0.0 if value else np.zeros(0)
            largest = np.abs(v).max() if len(v) else 0.0
            if not (np.isfinite(largest) and largest > 0):
                names.append(None)
                units.append(None)
                continue
            scaled = v / largest
            names.append(xxhash.xxh128_digest(v.tobytes()))
            units.append((scaled / np.linalg.norm(scaled)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(names, pa.binary()), pa.array(units, pa.binary())],
            names=["vec_id", "class", "unit"])


def _decode_task(batches: Iterator[pa.RecordBatch], size: int):
    for batch in batches:
        units = [np.frombuffer(u.as_buffer(), np.float64) for u in batch.column("unit")]
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_length.setdefault(len(u), []).append(i)
        filters: list = [None] * len(units)
        for d, rows in by_length.items():
            for lo in range(0, len(rows), 256):
                some = rows[lo:lo + 256]
                found = decode(np.stack([units[i] for i in some]), size)
                for i, ids in zip(some, found):
                    filters[i] = ids
        yield pa.RecordBatch.from_arrays(
            [batch.column("class"), pa.array([len(u) for u in units], pa.int32()),
             pa.array(filters, pa.list_(pa.int64()))], names=["class", "d", "filters"])


def compare(f: int, units: np.ndarray, weights: np.ndarray, filters: list[np.ndarray],
            side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member inside one filter, and the place of its smallest linked one.

    Members of unequal sides are compared, or all if there is one side. Pairs that share a
    smaller filter are left to that.
    """
    n = len(units)
    linked = units @ units.T >= least
    np.fill_diagonal(linked, False)
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    if linked.any():
        before = [ids[ids < f] for ids in filters]
        known, place = np.unique(np.concatenate(before), return_inverse=True)
        if len(known):
            has = np.zeros((n, len(known)), np.float32)
            has[np.repeat(np.arange(n), [len(b) for b in before]), place] = 1
            linked &= has @ has.T == 0
    label = np.arange(n)
    near = linked | np.eye(n, dtype=bool)
    while True:
        lower = np.where(near, label[None, :], n).min(axis=1)
        if (lower == label).all():
            return linked @ weights, label
        label = lower


def _compare_task(batches: Iterator[pa.RecordBatch], least: float):
    """Rows come sorted by (d, filter, lo, hi); a group is held until the next one begins."""
    held: list[dict] = []
    out: list[tuple] = []

    def finish():
        if len(held) > 1:
            units = np.stack([np.frombuffer(r["unit"], np.float64) for r in held])
            links, label = compare(
                held[0]["filter"], units, np.array([r["weight"] for r in held], np.int64),
                [np.array(r["filters"], np.int64) for r in held],
                np.array([r["at"] for r in held]), least)
            out.extend((held[i]["class"], int(links[i]), held[label[i]]["class"])
                       for i in np.flatnonzero(links))
        held.clear()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        a, n, b = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.binary()), pa.array(n, pa.int64()), pa.array(b, pa.binary())],
            names=["class", "links", "root"])

    key = None
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["d"], row["filter"], row["lo"], row["hi"])
            if now != key:
                finish()
                key = now
            held.append(row)
        if out:
            yield batch_of(out)
            out.clear()
    finish()
    if out:
        yield batch_of(out)


# -------------------------------------------------------------------- operator
def similar_vectors(vectors: DataFrame, *, least: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row (``vec_id, embedding``).

    Rows are linked if the cosine of their vectors, in double precision, is at least
    ``least``. ``n_links`` counts the other rows linked directly, component_id is the smallest
    vec_id that links reach. Null, empty and zero vectors and those with a null or non-finite
    component link with nothing; nor do vectors of different length link. Rows without
    an id are linked with nothing and kept. Equal vectors are one class with a weight, so
    copies are not compared with one another.
    """
    stage = Staging(vectors.sparkSession, "caps")
    v = F.when(~F.exists("embedding", lambda x: x.isNull()), F.col("embedding").cast("array<double>"))
    rows = stage.table("rows", vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                                              F.when(F.col("vec_id").isNotNull(), v).alias("v"))
                       .mapInArrow(_units, "vec_id long, class binary, unit binary"))
    classes = stage.table("classes", rows.filter("class IS NOT NULL").groupBy("class").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"),
        F.first("unit").alias("unit")))
    size = codewords(classes.count())
    lists = stage.table("lists", classes.select("class", "unit").mapInArrow(
        lambda it: _decode_task(it, size), "class binary, d int, filters array<long>"))
    # vectors of different length never meet: they have filters of their own
    entries = lists.select("class", "d", F.explode("filters").alias("filter"))
    shared = entries.groupBy("d", "filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = entries.join(shared, ["d", "filter"]).groupBy("class", "d").agg(
        F.array_sort(F.collect_list(F.struct("filter", "n"))).alias("met"))
    live = stage.table("live", classes.drop("rep").join(met, "class"))
    stage.drop("lists")
    parts = F.ceil(F.col("one.n") / BLOCK).cast("int")
    rows_in = (live.select("class", "d", "weight", "unit", F.col("met.filter").alias("filters"),
                           F.explode("met").alias("one"))
               .withColumn("filter", F.col("one.filter"))
               .withColumn("at", F.pmod(F.xxhash64("class"), parts).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
               .select("d", "filter", F.least("at", "other").alias("lo"),
                       F.greatest("at", "other").alias("hi"), "at", "class", "weight", "unit",
                       "filters"))
    keys = ["d", "filter", "lo", "hi"]   # at most about 1,000 rows for each, however full the filter
    links = stage.table("links", rows_in.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        lambda it: _compare_task(it, least), "class binary, links long, root binary"))
    stage.drop("live")
    found = connected_components(links.select(F.col("class").alias("a"), F.col("root").alias("b")),
                                 stage, "parts")
    found = found.join(classes.select(F.col("class").alias("node"), "rep"), "node")
    smallest = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = found.join(smallest, "component").select(F.col("node").alias("class"), "component_id")
    sums = links.groupBy("class").agg(F.sum("links").alias("links"))
    facts = stage.table("facts", classes.select("class", "rep", "weight").join(
        of_class, "class", "left").join(sums, "class", "left").select(
        "class", F.coalesce("component_id", "rep").alias("component_id"),
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return rows.select("vec_id", "class").join(facts, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
