"""PCA whitening of vectors on a grid, fitted once per distinct vector.

Vectors are rounded down to whole multiples of a step. Equal ones are grouped first, each with
its number of copies, so that whatever follows costs one row per distinct vector: column sums,
then a weighted matrix product of centred rows, summed over tasks, then the whitened vector.
Rows get it by joining back on their vector. Sums of whole numbers are exact; centring uses
the exact mean (a whole part and a remainder), so no digits are lost to a large offset.

The driver holds one square matrix and its components for each length of vectors, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksrisk.llm.common import checked_join
from worksrisk.session import Staging

STEP, OFFSET = 64, 1_000_000      # x = floor(64 * c) + 1000000
COMPONENTS = 16
FLAT = 1e-12                      # components below this share of the variance have no direction
LARGEST = (1 << 63) - 1
ROWS = 2048                       # vectors multiplied at a time


class Fit(NamedTuple):
    """What whitening needs to know about the vectors of one length."""

    n: int                       # weight of the fit list
    sums: list[int]              # of every dimension
    eigenvalues: np.ndarray      # falling, at most COMPONENTS, all positive
    vectors: np.ndarray          # one unit eigenvector in each column
    explained: np.ndarray        # shares of the whole variance


# ------------------------------------------------------------------ inside a task
def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n for rows of whole numbers, rounded once."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    if max(abs(low), abs(high), *map(abs, whole)) < 1 << 61:
        return (x - np.array(whole, np.int64)).astype(np.float64) - rest
    return (x.astype(object) - np.array(whole, object)).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sums) squared, exact; at most the largest long."""
    whole = [s // n for s in sums]
    rest = [s - w * n for s, w in zip(sums, whole)]
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    most = n * (max(abs(low), abs(high), *map(abs, whole)) * 2 + 1)
    near = x - np.array(whole, np.int64) if most < 1 << 62 else None
    if near is not None and x.shape[1] * (n * (int(np.abs(near).max(initial=0)) + 1)) ** 2 <= LARGEST:
        return ((n * near - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    gaps = n * (x.astype(object) - np.array(whole, object)) - np.array(rest, object)
    return [min(LARGEST, int(v)) for v in (gaps ** 2).sum(axis=1)]


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and matrix of a batch's vectors, at most 2,048 at a time."""
    lists = batch.column(column)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()[:-1]
    flat = lists.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        for lo in range(0, len(own), ROWS):
            rows = own[lo:lo + ROWS]
            yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)]


def _products(batches: Iterator[pa.RecordBatch], means: dict[int, tuple[int, list[int]]], column: str):
    """Weighted sum of the outer products of centred rows: one row per length and dimension."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        weight = batch.column("weight").to_numpy().astype(np.float64)
        for d, rows, x in _by_length(batch, column):
            y = centred(x, *means[d]) if x.dtype.kind == "i" else x - means[d][1]
            total[d] = total.get(d, 0.0) + (y * weight[rows][:, None]).T @ y
    for d, matrix in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()),
             pa.array(list(matrix), pa.list_(pa.float64()))], names=["d", "i", "products"])


def _whiten(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]):
    for batch in batches:
        size = batch.num_rows
        white: list = [None] * size
        away: list = [None] * size
        for d, rows, x in _by_length(batch, "x"):
            fit = fits[d]
            z = centred(x, fit.n, fit.sums) @ fit.vectors / np.sqrt(fit.eigenvalues)
            for i, values, far in zip(rows, z, deviations(x, fit.n, fit.sums)):
                white[i], away[i] = values, far
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("x"), batch.column("weight"),
             pa.array(white, pa.list_(pa.float64())), pa.array(away, pa.int64())],
            names=["key", "x", "weight", "z", "deviation"])


# ------------------------------------------------------------------ across tasks
def grid(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: rows whose vector has whole-number coordinates, one for each entry.

    Rows with a null or empty vector, or with a null or non-finite entry, are left out.
    Coordinates beyond 2^62 in size are cut to that.
    """
    values = F.col("embedding").cast("array<double>")
    sound = (F.size("embedding") > 0) & ~F.exists(
        values, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def x(c):
        bound = float(1 << 62)   # beyond any grid; the floor of more would not be a long
        scaled = F.greatest(F.lit(-bound), F.least(F.lit(bound), c * float(STEP)))
        return F.floor(scaled).cast("long") + OFFSET

    return vectors.filter(F.col("embedding").isNotNull() & sound).select(
        "vec_id", F.transform(values, x).alias("x"))


def _matrices(rows: DataFrame, n_of: dict[int, int]) -> dict[int, np.ndarray]:
    """The summed rows of :func:`_products`, divided by n: a square matrix for each length."""
    sums = (rows.select("d", "i", F.posexplode("products").alias("j", "v"))
            .groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
            .groupBy("d", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("v"))
            .select("d", "i", "v.v"))
    out = {d: np.zeros((d, d)) for d in n_of}
    for r in sums.toLocalIterator():
        out[r.d][r.i] = r.v
    return {d: m / n_of[d] for d, m in out.items()}


def fit(classes: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of ``x, weight`` rows, for each length of x.

    Covariances are divided by the sum of weights. Directions with no variance to speak of
    (below 1e-12 of the whole) are left out, so there may be fewer than ``components``.
    """
    long = classes.select("weight", F.size("x").alias("d"), F.posexplode("x").alias("i", "v"))
    exact = F.sum(F.col("v").cast("decimal(38,0)") * F.col("weight"))
    moments: dict[int, tuple[int, list[int]]] = {}
    for r in (long.groupBy("d", "i").agg(F.sum("weight").alias("n"), exact.cast("decimal(38,0)").alias("s"))
              .groupBy("d").agg(F.max("n").alias("n"),
                                F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"))
              .toLocalIterator()):
        moments[r.d] = (r.n, [int(e.s) for e in r.s])
    rows = classes.select("x", "weight").mapInArrow(
        lambda it: _products(it, moments, "x"), "d int, i int, products array<double>")
    fits = {}
    for d, v in _matrices(rows, {d: n for d, (n, _) in moments.items()}).items():
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        whole = float(np.trace(v))
        order = [i for i in order if whole > 0 and values[i] > FLAT * whole]
        fits[d] = Fit(*moments[d], values[order], vectors[:, order], values[order] / whole if whole else
                      values[order])
    return fits


def _identity_errors(white: DataFrame, fits: dict[int, Fit]) -> float:
    """Largest entry of the whitened vectors' own covariance minus the identity."""
    sizes = white.filter(F.size("z") > 0).select("weight", F.size("x").alias("d"), "z")
    middle = sizes.select("d", "weight", F.posexplode("z").alias("i", "v")).groupBy("d", "i").agg(
        (F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("m"))
    means = {d: np.zeros(len(f.eigenvalues)) for d, f in fits.items()}
    for r in middle.toLocalIterator():
        means[r.d][r.i] = r.m
    worst = 0.0
    for d, f in fits.items():   # lengths; almost always one
        k = len(f.eigenvalues)
        if not k:
            continue
        rows = sizes.filter(F.col("d") == d).select("z", "weight").mapInArrow(
            lambda it, k=k, m=means[d]: _products(it, {k: (0, m)}, "z"),
            "d int, i int, products array<double>")
        worst = max(worst, float(np.abs(_matrices(rows, {k: f.n})[k] - np.eye(k)).max()))
    return worst


def whiten(vectors: DataFrame, stage: Staging, *, components: int = COMPONENTS,
           weigh_copies: bool = False) -> DataFrame:
    """``vec_id, n, deviation, explained, identity_error, z`` of every sound row.

    ``z`` holds the whitened coordinates along the components of largest variance and
    ``explained`` their shares of it; ``n`` is the weight of the fit list, ``deviation`` the
    exact squared distance from the mean times n squared (at most the largest long), and
    ``identity_error`` tells how far the whitened fit list is from an identity covariance.

    Each distinct vector is fitted once, or with ``weigh_copies`` as often as it occurs.
    Rows dropped by :func:`grid` are not returned; repeated rows and null ids are. Vectors of
    different length are fitted apart, the error is the largest of all. If all vectors are
    equal, ``z`` is empty. Only ``vec_id`` and ``embedding`` are read.
    """
    # rows are joined by a digest of their vector, which is a tenth of its size
    rows = stage.table("rows", grid(vectors).withColumn("key", F.sha2(F.col("x").cast("string"), 256)))
    copies = F.count(F.lit(1))
    classes = stage.table("classes", rows.groupBy("x", "key").agg(
        copies.alias("copies"), (copies if weigh_copies else F.lit(1).cast("long")).alias("weight")))
    fits = fit(classes, components)
    white = stage.table("white", classes.select("key", "x", "weight").mapInArrow(
        lambda it: _whiten(it, fits),
        "key string, x array<long>, weight long, z array<double>, deviation long"))
    error = _identity_errors(white, fits)
    facts = white.select(
        "key", "deviation", "z", *(F.element_at(F.create_map(*(
            v for d, f in fits.items() for v in (F.lit(d), value(f)))) if fits else
            F.lit(None).cast(f"map<int,{kind}>"), F.size("x")).alias(name)
            for name, kind, value in (
                ("n", "bigint", lambda f: F.lit(f.n).cast("long")),
                ("explained", "array<double>", lambda f: F.array(
                    *(F.lit(float(e)) for e in f.explained)).cast("array<double>")))))
    found = checked_join(rows.select("vec_id", "key"), facts, ["key"], classes.count())
    return found.withColumn("identity_error", F.lit(error)).drop("key")
