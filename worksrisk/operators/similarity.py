"""Exact nearest neighbours inside blocks, and what the duplicate checks make of them.

``nearest`` is a top-k cosine search where a query only meets candidates of its own
block. Nothing is sampled and no pair list is ever shuffled:

1. Copies (equal vectors of one block) are merged first, keeping the k+1 smallest
   identifiers, so a block of copies shrinks to one vector.
2. Work is cut into units of a few thousand candidates that meet a bounded number of
   queries. Units are sorted runs that a task streams through, so memory holds one
   unit, and thousands of small blocks share a task.
3. Dense vectors: blocks with many candidates and many queries are split into cells around
   pivots (cosine order is distance order on the unit sphere). A query searches its own
   cell, then only the cells that the triangle inequality cannot rule out. Small cells share
   a unit, so a query travels once for each unit it can reach, not once for each cell.
4. Sparse vectors (terms and weights): a unit is bounded by its terms, not by its candidates, so
   that a query travels to few units; it keeps an inverted list for each term. A query first adds up the lists of its heavy terms; a candidate whose sum cannot make up for the
   light rest of the query is out, and only the others are multiplied in full. Units of few
   candidates and terms are multiplied as a matrix instead. When vectors are searched among
   themselves, blocks of one unit and one run travel once, as candidates and queries at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worksrisk import schemas as S
from worksrisk.functions import rules
from worksrisk.functions.cells import is_real_vendor
from worksrisk.operators.joins import hot_keys, left_join, spread_left_join
from worksrisk.session import stored

# task functions travel with the job, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 4000        # candidates a unit holds in memory
POSTINGS = 6_000_000  # terms of sparse candidates that a unit holds in memory, about 30 bytes each
QUERY_RUN = 40_000  # queries that one copy of a unit serves
SPARSE_RUNS = (4, 2000)  # a unit of words is copied for up to 4 runs of 2,000 queries, as they take long
CELL = 1000         # candidates for each cell of a block
STEP = 1024         # queries multiplied at a time, fewer beside many candidates
MOST = 4_000_000    # similarities that a task holds at a time
KEYS = ["block", "f1", "f2"]
CELLS = 1 << 20     # a unit of words with no more places for weights than this is held as a matrix
TAIL = 0.4          # length of the light end of a sparse vector that is looked at last
SEPARATOR = "\u0001"


# ------------------------------------------------------------ inside one task
def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero, so its cosine is 0."""
    m = np.stack(vectors).astype(np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _stream(visit):
    """Task function over rows sorted by unit, candidates first.

    ``visit(held, asked, sims)`` sees the candidates of one unit, a slice of its queries
    and their similarities, and returns (rows of the slice, new columns). What it
    returns is gathered into one frame per incoming batch.
    """
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, parts, held = None, [], None
        for pdf in batches:
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            cols["vec"] = _unit(cols["vec"])
            names, is_query = cols["unit"], cols["role"] == 1
            edges = (names[1:] != names[:-1]) | (is_query[1:] != is_query[:-1])
            cuts = [0, *(np.flatnonzero(edges) + 1), len(pdf)]
            rows, found = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if names[lo] != name:
                    name, parts, held = names[lo], [], None
                if not is_query[lo]:
                    parts.append({c: v[lo:hi] for c, v in cols.items()})
                    held = None
                    continue
                if not parts:
                    continue
                if held is None:
                    held = parts[0] if len(parts) == 1 else {
                        c: np.concatenate([p[c] for p in parts]) for c in cols}
                    parts = [held]
                step = max(1, min(STEP, MOST // len(held["vec"])))
                for at in range(lo, hi, step):
                    cut = slice(at, min(at + step, hi))
                    # rounded so that the order of summation cannot decide a tie
                    sims = np.round(cols["vec"][cut] @ held["vec"].T, 12)
                    picked, values = visit(held, {c: v[cut] for c, v in cols.items()}, sims)
                    rows.append(picked + at)
                    found.append(values)
            if rows:
                out = pdf[KEYS].take(np.concatenate(rows))
                for c in found[0]:
                    out[c] = np.concatenate([f[c] for f in found])
                yield out
    return task


def _search(k: int, own: bool | None = None):
    """The k best candidates; with ``own`` those of the query's own cell only, or all others."""
    def visit(held, asked, sims):
        if own is not None:
            sims[(held["cell"][None, :] == asked["cell"][:, None]) != own] = -np.inf
        picked, near, ids = [], [], []
        for _ in range(min(k, sims.shape[1])):
            best = sims.argmax(axis=1)  # first of equals: the smallest identifier
            rows = np.flatnonzero(sims[np.arange(len(sims)), best] > -np.inf)
            best = best[rows]
            picked.append(rows)
            near.append(sims[rows, best])
            ids.append(held["ids"][best])
            sims[rows, best] = -np.inf
        return np.concatenate(picked), {"similarity": np.concatenate(near),
                                        "ids": np.concatenate(ids)}
    return _stream(visit)


def _distance(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * sims, 0.0))


def _assign(held, asked, sims):
    rows, best = np.arange(len(sims)), sims.argmax(axis=1)
    return rows, {"cell": held["cell"][best], "pack": held["pack"][best],
                  "distance": _distance(sims[rows, best])}


def _reachable(held, asked, sims):
    """Packs of other cells that may hold something as near as the best found so far."""
    gap = _distance(sims) - held["reach"][None, :]
    near = gap <= asked["reach"][:, None] + 1e-5
    near &= held["cell"][None, :] != asked["cell"][:, None]
    packs, place = np.unique(held["pack"], return_inverse=True)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(packs)))
    row, col = np.nonzero(np.logical_or.reduceat(near[:, order], starts, axis=1))
    return row, {"pack": packs[col]}


class Postings:
    """Sparse candidates of one unit: by candidate, and by term. Earlier ones win ties."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.terms, self.weights = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.sizes = np.concatenate([p[2] for p in parts])
        self.n, self.starts = len(self.sizes), np.cumsum(self.sizes) - self.sizes
        order = np.argsort(self.terms, kind="stable")
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)[order]
        self.weight_of = self.weights[order]
        self.words, self.first, self.length = np.unique(
            self.terms[order], return_index=True, return_counts=True)

    @staticmethod
    def _runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Places of several runs, one after the other."""
        return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())

    def sums(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Dot product of every candidate with these terms."""
        if not len(terms) or not len(self.words):
            return np.zeros(self.n)
        at = np.minimum(np.searchsorted(self.words, terms), len(self.words) - 1)
        hit = self.words[at] == terms
        at, weights = at[hit], weights[hit]
        runs = self._runs(self.first[at], self.length[at])
        return np.bincount(self.owner[runs], self.weight_of[runs] * np.repeat(weights, self.length[at]),
                           self.n)

    def products(self, chosen: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Dot product of some candidates with the whole query, its terms in rising order."""
        runs = self._runs(self.starts[chosen], self.sizes[chosen])
        own = self.terms[runs]
        at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
        value = np.where(terms[at] == own, self.weights[runs] * weights[at], 0.0)
        return np.bincount(np.repeat(np.arange(len(chosen)), self.sizes[chosen]), value, len(chosen))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k best candidates, best first."""
        k = min(k, self.n)
        heavy = np.argsort(-weights, kind="stable")
        tails = np.sqrt(np.append(np.cumsum(weights[heavy][::-1] ** 2)[::-1], 0.0))
        cut = int(np.argmax(tails <= TAIL))
        head = self.sums(terms[heavy[:cut]], weights[heavy[:cut]])
        # no candidate is longer than 1, so the rest of the query adds at most its own length
        least = np.partition(head, self.n - k)[self.n - k]
        chosen = np.flatnonzero(head + tails[cut] >= least - 1e-9)
        if 8 * len(chosen) < self.n and len(terms):
            sims = self.products(chosen, terms, weights)
        else:
            chosen = np.arange(self.n)
            sims = head + self.sums(terms[heavy[cut:]], weights[heavy[cut:]])
        sims = np.round(sims, 12)   # so that the order of summation cannot decide a tie
        best = np.argsort(-sims, kind="stable")[:k]
        return chosen[best], sims[best]


class Matrix:
    """Sparse candidates of a small unit as a matrix of candidates and terms. Earlier ones win ties."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        terms, weights, sizes = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2))
        self.words, place = np.unique(terms, return_inverse=True)
        self.n, self.rows = len(sizes), np.zeros((len(sizes), len(self.words)))
        self.rows[np.repeat(np.arange(self.n), sizes), place] = weights

    def asked(self, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Queries as rows over the candidates' terms; other terms match nothing."""
        out = np.zeros((len(sizes), len(self.words)))
        if len(terms) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, terms), len(self.words) - 1)
            hit = self.words[at] == terms
            out[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = weights[hit]
        return out

    def nearest(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities, a row for each query, best first."""
        # rounded so that the order of summation cannot decide a tie
        sims = np.round(asked @ self.rows.T, 12)
        rows, places, near = np.arange(len(sims)), [], []
        for _ in range(min(k, self.n)):
            best = sims.argmax(axis=1)   # first of equals
            places.append(best)
            near.append(sims[rows, best])
            sims[rows, best] = -np.inf
        return np.stack(places, axis=1), np.stack(near, axis=1)


def _small(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> bool:
    return sum(len(p[2]) for p in parts) * sum(len(p[0]) for p in parts) <= CELLS


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _answers(batch: pa.RecordBatch, rows: list, near: list, ids: list) -> pa.RecordBatch:
    keys = [batch.column(c).take(pa.array(rows)) for c in KEYS]
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array(np.concatenate(near)), pa.array(ids, batch.schema.field("ids").type)],
        names=[*KEYS, "similarity", "ids"])


def _search_whole(k: int):
    """Task function over rows sorted by unit that are candidates and queries at a time.

    A unit is searched when its last row has come; small units share a batch.
    """
    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column("unit").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), batch.num_rows]
        at, terms = _lists(batch.column("terms"))
        weights, ids = _lists(batch.column("weights"))[1], batch.column("ids").to_pylist()
        sizes, rows, near, found = np.diff(at), [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            some = slice(at[lo], at[hi])
            parts = [(terms[some], weights[some], sizes[lo:hi])]
            if _small(parts):
                held = Matrix(parts)
                places, sims = held.nearest(held.rows, k)
                rows += np.repeat(np.arange(lo, hi), places.shape[1]).tolist()
                near.append(sims.ravel())
                found += [ids[lo + i] for i in places.ravel().tolist()]
                continue
            held = Postings(parts)
            for row in range(lo, hi):
                own = slice(at[row], at[row + 1])
                best, sims = held.nearest(terms[own], weights[own], k)
                rows += [row] * len(best)
                near.append(sims)
                found += [ids[lo + i] for i in best.tolist()]
        return _answers(batch, rows, near, found)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []   # rows of the last unit so far
        for batch in batches:
            names = batch.column("unit").to_numpy(zero_copy_only=False)
            if not len(names):
                continue
            fresh = not waiting or waiting[0].column("unit")[0].as_py() != names[0]
            if names[0] == names[-1] and not fresh:
                waiting.append(batch)
                continue
            last = int(np.flatnonzero(names != names[-1]).max(initial=-1)) + 1
            ready = [*waiting, batch.slice(0, last)]
            waiting = [batch.slice(last)]
            if sum(b.num_rows for b in ready):
                yield visit(pa.concat_batches(ready))
        if waiting:
            yield visit(pa.concat_batches(waiting))
    return task


def _search_sparse(k: int):
    """Task function over rows sorted by unit, candidates first; the sparse form of _search."""
    lists = _lists

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, ids, held = None, [], [], None
        for batch in batches:
            names = batch.column("unit").to_numpy(zero_copy_only=False)
            is_query = batch.column("role").to_numpy() == 1
            at, terms = lists(batch.column("terms"))
            weights = lists(batch.column("weights"))[1]
            edges = (names[1:] != names[:-1]) | (is_query[1:] != is_query[:-1])
            cuts = [0, *(np.flatnonzero(edges) + 1), batch.num_rows]
            rows, near, places = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if names[lo] != name:
                    name, parts, ids, held = names[lo], [], [], None
                if not is_query[lo]:
                    some = slice(at[lo], at[hi])
                    parts.append((terms[some], weights[some], np.diff(at[lo:hi + 1])))
                    ids += batch.column("ids").slice(lo, hi - lo).to_pylist()
                    held = None
                    continue
                if not parts:
                    continue
                held = held or (Matrix(parts) if _small(parts) else Postings(parts))
                if isinstance(held, Matrix):
                    for first in range(lo, hi, STEP):
                        end = min(first + STEP, hi)
                        some = slice(at[first], at[end])
                        asked = held.asked(terms[some], weights[some], np.diff(at[first:end + 1]))
                        best, sims = held.nearest(asked, k)
                        rows += np.repeat(np.arange(first, end), best.shape[1]).tolist()
                        near.append(sims.ravel())
                        places += [ids[i] for i in best.ravel().tolist()]
                    continue
                for row in range(lo, hi):
                    some = slice(at[row], at[row + 1])
                    best, sims = held.nearest(terms[some], weights[some], k)
                    rows += [row] * len(best)
                    near.append(sims)
                    places += [ids[i] for i in best]
            if rows:
                yield _answers(batch, rows, near, places)
    return task


# --------------------------------------------------------------- across tasks
def _sparse(df: DataFrame) -> bool:
    return isinstance(df.schema["vec"].dataType, T.StructType)


def _prepare(df: DataFrame) -> DataFrame:
    """(id, block, vec) with a 128-bit fingerprint of the vector."""
    return (df.select("id", F.col("block").cast("string").alias("block"), "vec")
            .filter(F.col("block").isNotNull() & F.col("vec").isNotNull())
            .withColumns({"f1": F.xxhash64("vec"), "f2": F.xxhash64(F.lit(1), F.col("vec"))}))


def _distinct(df: DataFrame, keep: int) -> DataFrame:
    """One row per block and vector with its first identifiers."""
    w = Window.partitionBy(*KEYS).orderBy("id")
    return (df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep)
            .groupBy(*KEYS).agg(F.sort_array(F.collect_list("id")).alias("ids"),
                                F.min_by("vec", "_n").alias("vec")))


def _scan(candidates: DataFrame, queries: DataFrame, unit: list[str], fn, schema: str,
          extra: list[str] = ()) -> DataFrame:
    """Bring both sides of each unit together, candidates first, and stream them."""
    rows = _side(candidates, unit, 0, extra).unionByName(_side(queries, unit, 1, extra))
    rows = rows.repartition("unit").sortWithinPartitions("unit", "role", "first_id")
    return rows.mapInArrow(fn, schema) if _sparse(candidates) else rows.mapInPandas(fn, schema)


def _side(df: DataFrame, unit: list[str], role: int, extra: list[str] = ()) -> DataFrame:
    """Rows of a unit, as candidates (role 0, with their identifiers) or as queries."""
    vec = ["vec.terms", "vec.weights"] if _sparse(df) else ["vec"]
    ids = F.col("ids") if role == 0 else F.lit(None).cast(df.schema["ids"].dataType)
    return df.select(F.concat_ws(SEPARATOR, *unit).alias("unit"), F.lit(role).alias("role"), *KEYS, *vec,
                     ids.alias("ids"), ids[0].alias("first_id"), *extra)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy(F.desc("similarity"), F.col("ids")[0])
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def _parts(n: Column, size: int) -> Column:
    return F.ceil(n / F.lit(float(size))).cast("int")


def _with_sizes(df: DataFrame, sizes: DataFrame, group: list[str], count: str) -> DataFrame:
    """Sizes of its group on every row; a group with much of the table is dealt out."""
    return spread_left_join(df, sizes, group, hot_keys(sizes, group, count),
                            salt=F.col("f1")).filter("_g > 0")


def _search_units(candidates: DataFrame, queries: DataFrame, group: list[str], k: int,
                  chunk: int | None, result: str, own: bool | None = None) -> DataFrame:
    """Every query against every candidate of its group, in bounded units.

    ``own`` narrows that to candidates of the query's own cell, or to all others.
    """
    sparse = _sparse(candidates)
    units, runs = _parts(F.col("_nc"), chunk or CHUNK), _parts(F.col("_nq"), QUERY_RUN)
    terms = F.size("vec.terms") if sparse else F.lit(0)
    if sparse:
        most, least = SPARSE_RUNS
        runs = F.greatest(runs, F.least(F.lit(most), _parts(F.col("_nq"), least)))
        if chunk is None:
            units = F.greatest(F.lit(1), _parts(F.col("_nt"), POSTINGS))
    sizes = (candidates.groupBy(*group).agg(F.count("*").alias("_nc"), F.sum(terms).alias("_nt"))
             .join(queries.groupBy(*group).agg(F.count("*").alias("_nq")), group)
             .select(*group, "_nc", "_nq", units.alias("_g"), runs.alias("_s")))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    whole = None
    if sparse and queries is candidates:
        # blocks of several units or runs are few, and have thousands of rows each
        sizes = stored(sizes.filter("_g > 1 or _s > 1"))
        small = _side(candidates.join(sizes.select(*group), group, "left_anti"), group, 0)
        whole = (small.repartition("unit").sortWithinPartitions("unit", "first_id")
                 .mapInArrow(_search_whole(k), result))
    cand = (_with_sizes(candidates, sizes, group, "_nc")
            .withColumn("_j", F.pmod("f1", F.col("_g"))).withColumn("_q", every("_s")))
    ask = (_with_sizes(queries, sizes, group, "_nq")
           .withColumn("_q", F.pmod("f2", F.col("_s"))).withColumn("_j", every("_g")))
    search = _search_sparse(k) if sparse else _search(k, own)
    found = _scan(cand, ask, [*group, "_j", "_q"], search, result, [] if own is None else ["cell"])
    if whole is None:
        return found
    return whole if sizes.isEmpty() else whole.unionByName(found)


def _search_cells(candidates: DataFrame, queries: DataFrame, k: int, cell: int,
                  result: str) -> DataFrame:
    """Own cell first, then the cells still in reach.

    One candidate in ``cell``, by hash, is a pivot; the smallest hash is one in any case.
    Cells smaller than a unit are packed, by hash, to units of about ``CHUNK`` candidates: what
    is shuffled grows with the units that a query can reach, not with the candidates.
    """
    keys = "block string, f1 long, f2 long"
    least = candidates.groupBy("block").agg(
        F.min("f1").alias("_least"), _parts(F.count("*"), CHUNK).alias("_packs"))
    pack = F.col("f1") if cell >= CELL else F.pmod(F.xxhash64(F.lit(3), "f1"), F.col("_packs"))
    marks = (candidates.join(least, "block")
             .filter((F.col("f1") == F.col("_least")) | (F.pmod(F.xxhash64(F.lit(2), "f1"), F.lit(cell)) == 0))
             .withColumns({"cell": F.col("f1"), "reach": F.lit(0.0), "pack": pack})
             .drop("_least", "_packs"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("_q", F.pmod("f2", F.col("_s")))

    def with_marks(df: DataFrame, marks: DataFrame, fn, schema: str) -> DataFrame:
        runs = df.groupBy("block").agg(_parts(F.count("*"), QUERY_RUN).alias("_s"))
        copies = marks.join(runs, "block").withColumn(
            "_q", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
        return _scan(copies, dealt(df.join(runs, "block")), ["block", "_q"], fn, schema,
                     extra=["cell", "reach", "pack"])

    def in_cells(df: DataFrame) -> DataFrame:
        blank = df.withColumns({"cell": F.lit(0).cast("long"), "reach": F.lit(0.0),
                                "pack": F.lit(0).cast("long")})
        placed = with_marks(blank, marks, _stream(_assign),
                            f"{keys}, cell long, pack long, distance double")
        return stored(df.join(placed, KEYS))

    cand = in_cells(candidates)
    same = queries is candidates
    ask = cand if same else in_cells(queries)
    unit = ["block", "pack"]
    own = stored(_best(_search_units(cand, ask, unit, k, CHUNK, result, own=True), k))

    radius = cand.groupBy("block", "cell").agg(F.max("distance").alias("reach"))
    worst = own.groupBy(*KEYS).agg(F.count("*").alias("_n"), F.min("similarity").alias("_s"))
    reach = F.when(F.col("_n") >= k, F.sqrt(F.greatest(2 - 2 * F.col("_s"), F.lit(0.0))))
    pending = (ask.join(worst, KEYS, "left")
               .withColumn("reach", F.coalesce(reach, F.lit(4.0))).drop("_n", "_s"))
    rings = marks.drop("reach").join(radius, ["block", "cell"])
    visits = with_marks(pending, rings, _stream(_reachable), f"{keys}, pack long")
    again = ask.drop("pack").join(visits, KEYS)
    return own.unionByName(_search_units(cand, again, unit, k, CHUNK, result, own=False))


def _search_dense(cand: DataFrame, ask: DataFrame, k: int, chunk: int, cell: int,
                  result: str) -> DataFrame:
    """Blocks of one unit, or asked by few, are searched whole; others by cells."""
    sizes = (cand.groupBy("block").agg(F.count("*").alias("nc"))
             .join(ask.groupBy("block").agg(F.count("*").alias("nq")), "block"))
    large = sizes.filter((F.col("nc") > chunk) & (F.col("nq") > chunk)).select("block")
    plain_c, plain_q = (df.join(large, "block", "left_anti") for df in (cand, ask))
    found = _search_units(plain_c, plain_q, ["block"], k, chunk, result)
    if not large.isEmpty():
        big_c = cand.join(large, "block", "left_semi")
        big_q = big_c if ask is cand else ask.join(large, "block", "left_semi")
        found = found.unionByName(_search_cells(big_c, big_q, k, cell, result))
    return found


def nearest(queries: DataFrame, candidates: DataFrame | None = None, *, k: int = 1,
            chunk: int | None = None, cell: int = CELL) -> DataFrame:
    """The k most similar candidates of each query's block, never the query itself.

    Both sides are (id, block, vec) with ``id`` unique per block; ``candidates=None``
    searches the queries among themselves. ``vec`` is an array of numbers, or a struct of
    ``terms`` (rising) and ``weights`` of length one at most, as word models give it. Returns (id, nearest_id, similarity,
    position); equal similarities rank by identifier, and a query alone in its block
    has no row. ``chunk`` is the number of candidates of a unit: by default ``CHUNK``, for words
    as many as have ``POSTINGS`` terms.
    """
    asked = _prepare(queries)
    known = asked if candidates is None else _prepare(candidates)
    cand = stored(_distinct(known, k + 1))
    ask = cand if candidates is None else stored(_distinct(asked, 1))
    id_type = dict(known.dtypes)["id"]
    result = f"block string, f1 long, f2 long, similarity double, ids array<{id_type}>"

    if _sparse(cand):
        found = _search_units(cand, ask, ["block"], k + 1, chunk, result)
    else:
        found = _search_dense(cand, ask, k + 1, chunk or CHUNK, cell, result)

    entry = F.struct((-F.col("similarity")).alias("minus"), F.col("one").alias("id"))
    answers = (_best(found, k + 1).withColumn("one", F.explode("ids"))
               .groupBy(*KEYS).agg(F.sort_array(F.collect_list(entry)).alias("_a")))
    copies = asked.groupBy(*KEYS).agg(F.count("*").alias("_copies"))
    hot = hot_keys(copies.filter("_copies > 1"), KEYS, "_copies")
    merged = spread_left_join(asked.select("id", *KEYS), answers, KEYS, hot)
    others = F.slice(F.filter("_a", lambda e: e["id"] != F.col("id")), 1, k)
    return (merged.select("id", F.posexplode(others).alias("_p", "_e"))
            .select("id", F.col("_e.id").alias("nearest_id"),
                    (-F.col("_e.minus")).alias("similarity"),
                    (F.col("_p") + 1).alias("position")))


# ------------------------------------------------------------ duplicate checks
def vendor_block(vendor: Column, constituency: Column) -> Column:
    """Works are compared within a vendor and place; nobody in particular is no vendor."""
    return F.when(is_real_vendor(vendor) & constituency.isNotNull(),
                  F.concat_ws(SEPARATOR, vendor, constituency))


def duplicate_scores(works: DataFrame, *, block: Column | None = None,
                     floor: float = S.SIMILARITY_FLOOR, ceiling: float = S.SIMILARITY_CEILING,
                     **options) -> DataFrame:
    """Each work's most similar other work in its block and the risk that implies.

    ``works`` has Work_ID, Vendor_Name, Constituency and ``embedding``. Works without
    a real vendor or alone in their block are unchecked and score 0.
    """
    if block is None:
        block = vendor_block(F.col("Vendor_Name"), F.col("Constituency"))
    vectors = works.select(F.col("Work_ID").alias("id"), block.alias("block"),
                           F.col("embedding").alias("vec"))
    best = nearest(vectors, **options).withColumnRenamed("id", "Work_ID")
    return scored(left_join(works.drop("embedding"), best, ["Work_ID"]), floor, ceiling)


def scored(df: DataFrame, floor: float = S.SIMILARITY_FLOOR,
           ceiling: float = S.SIMILARITY_CEILING) -> DataFrame:
    """Neighbour columns to the stored duplicate columns."""
    checked = F.col("nearest_id").isNotNull()
    risk = rules.similarity_risk(F.col("similarity"), floor, ceiling)
    return df.withColumns({
        "duplicate_risk_score": F.when(checked, risk).otherwise(F.lit(0.0)),
        "nearest_duplicate_work_id": F.col("nearest_id"),
        "nearest_similarity": F.coalesce("similarity", F.lit(0.0)),
        "duplicate_checked": checked,
    }).drop("nearest_id", "similarity", "position")


def new_work_duplicates(requests: DataFrame, index: DataFrame, **options) -> DataFrame:
    """Works that are not in the index against their block of it."""
    described = F.coalesce(F.col("Work_Description"), F.lit("")) != ""
    asked = requests.select(
        F.col("Work_ID").alias("id"), F.col("embedding").alias("vec"),
        F.when(described, vendor_block(F.col("Vendor_Name"), F.col("Constituency")))
        .alias("block"))
    known = index.select(
        F.col("work_id").alias("id"), F.col("embedding").alias("vec"),
        vendor_block(F.col("vendor_name"), F.col("constituency")).alias("block"))
    wanted = asked.select("block").distinct()
    best = nearest(asked, known.join(wanted, "block", "left_semi"), **options)
    return scored(left_join(requests.drop("embedding"),
                            best.withColumnRenamed("id", "Work_ID"), ["Work_ID"]))


def nearby_works(requests: DataFrame, places: DataFrame, vectors: DataFrame,
                 k: int = S.NEARBY_WORKS, **options) -> DataFrame:
    """The k most similar works of the same cluster, else of the same constituency.

    ``requests`` and ``places`` have Work_ID, Spatial_Cluster_ID and Constituency;
    ``vectors`` has Work_ID and ``embedding``. Vectors are fetched only for the places
    that were asked for. Returns (Work_ID, nearest_id, similarity, position).
    """
    cluster = F.concat(F.lit("k:"), F.col("Spatial_Cluster_ID"))
    place = F.concat(F.lit("c:"), F.col("Constituency"))
    asked = requests.select("Work_ID", F.coalesce(cluster, place).alias("block"))
    known = (places.select("Work_ID", F.explode(F.array(cluster, place)).alias("block"))
             .join(asked.select("block").distinct(), "block", "left_semi"))

    def with_vectors(df: DataFrame) -> DataFrame:
        return df.join(vectors.select("Work_ID", "embedding"), "Work_ID").select(
            F.col("Work_ID").alias("id"), "block", F.col("embedding").alias("vec"))

    return (nearest(with_vectors(asked), with_vectors(known), k=k, **options)
            .withColumnRenamed("id", "Work_ID"))


def flag_rate(scores: DataFrame) -> DataFrame:
    """Works with a duplicate score, and their share."""
    flagged = F.count_if(F.col("duplicate_risk_score") > 0)
    return scores.agg(F.count("*").alias("works"), flagged.alias("flagged"),
                      F.try_divide(flagged, F.count("*")).alias("rate"))


def flagged_per_vendor(scores: DataFrame) -> DataFrame:
    """(Vendor_Name, other_flagged_duplicate_count) of real vendors."""
    return (scores.filter(is_real_vendor(F.col("Vendor_Name"))).groupBy("Vendor_Name")
            .agg(F.count_if(F.col("duplicate_risk_score") > 0)
                 .alias("other_flagged_duplicate_count")))
