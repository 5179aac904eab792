"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes ratios.

Every text is a set of hashed character n-grams. Each n-gram's presence is scaled by the log
of the ratio of its rates in toxic and other texts, and a logistic regression is fitted on
the scaled presences. The rates are counted over all training labels; the regression takes a
bounded sample of them, in one task; scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksrisk.llm.common import small_batches
from worksrisk.llm.units import kept
from worksrisk.session import Staging

_BLANKS = re.compile(r"\s+")
BROADCAST_LABELS = 4_000_000   # labels (two numbers each) that are sent to every task


class Params(NamedTuple):
    orders: tuple[int, ...] = (3, 4, 5, 6)   # characters in an n-gram
    bits: int = 20                 # n-grams are hashed to 2^bits features
    sample: int = 2500             # at most so many labelled rows of each class are fitted
    smooth: float = 1.0            # added to the counts of the ratios
    least_docs: int = 3            # features of fewer labelled rows have no weight
    least_ratio: float = 1.5       # nor have those whose log ratio is nearer to 0
    l2: float = 1e-3
    steps: int = 300
    rate: float = 0.05
    threshold: float = 0.3


def features(text: str, params: Params, scratch: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of a text in lower case, with single blanks around and between."""
    text = " " + _BLANKS.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = []
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, max(params.orders) + 1):
        if n > len(codes):
            break
        rolled = rolled[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:]
        if n in params.orders:
            mixed = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - params.bits)).astype(np.int32))
    if not found:
        return np.zeros(0, np.int32)
    hashed = np.concatenate(found)
    # each feature once: the last place that wrote to its cell keeps it
    places = np.arange(len(hashed), dtype=np.int32)
    scratch[hashed] = places
    return hashed[scratch[hashed] == places]


def _scratch(params: Params) -> np.ndarray:
    return np.zeros(1 << params.bits, np.int32)


def counts(rows: list[np.ndarray], toxic: np.ndarray, params: Params) -> np.ndarray:
    """How many other rows (first line) and toxic rows (second) hold each feature.

    The last column counts the rows themselves.
    """
    found = np.zeros((2, (1 << params.bits) + 1), np.int64)
    for ids, label in zip(rows, toxic):
        found[int(label), ids] += 1
        found[int(label), -1] += 1
    return found


def ratios(found: np.ndarray, params: Params) -> np.ndarray:
    """Log ratio of each feature's rates in toxic and other rows; 0 where it tells too little."""
    rate = np.log(found[:, :-1] + params.smooth) - np.log(found[:, -1:] + 2 * params.smooth)
    ratio = rate[1] - rate[0]
    used = (found[:, :-1].sum(axis=0) >= params.least_docs) & (np.abs(ratio) >= params.least_ratio)
    return np.where(used, ratio, 0.0)


def fit(rows: list[np.ndarray], toxic: np.ndarray, share: float, params: Params,
        ratio: np.ndarray | None = None) -> np.ndarray:
    """Weights of all features and, last, the intercept, for a share of toxic rows overall.

    ``ratio`` has the log ratios of more rows than these; without it they are counted here.
    """
    size = 1 << params.bits
    weights = np.zeros(size + 1)
    toxic = toxic.astype(bool)
    n_toxic, n_other = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_other:
        # one class only: its share, kept off 0 and 1
        weights[-1] = np.log((n_toxic + 0.5) / (n_other + 0.5)) if n_toxic + n_other else -9.0
        return weights
    if ratio is None:
        ratio = ratios(counts(rows, toxic, params), params)
    used = ratio != 0
    kept = [ids[used[ids]] for ids in rows]
    column = np.cumsum(used) - 1
    indices = column[np.concatenate(kept)]
    row_of = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    scale = ratio[used]
    values = scale[indices]
    target = toxic.astype(float)
    # rows count so that both classes weigh the same; the intercept is put right afterwards
    importance = np.where(toxic, 0.5 / n_toxic, 0.5 / n_other)
    u, b = np.zeros(len(scale)), 0.0
    m, v, mb, vb = np.zeros_like(u), np.zeros_like(u), 0.0, 0.0
    for step in range(1, params.steps + 1):
        z = np.bincount(row_of, values * u[indices], len(kept)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * importance
        grad = np.bincount(indices, values * error[row_of], len(u)) + params.l2 * u
        grad_b = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b * grad_b
        c1, c2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        u -= params.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= params.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights[:size][used] = scale * u
    share = min(max(share, 1e-4), 1 - 1e-4)
    weights[-1] = b + np.log(share / (1 - share))
    return weights


# ------------------------------------------------------------------------ Spark
def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for measuring only; null ids are not among them."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _extract(batches: Iterator[pa.RecordBatch], params: Params):
    scratch = kept(("toxicity", params), lambda: _scratch(params))
    for batch in batches:
        ids = [features(t, params, scratch) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.list_(pa.int32())), batch.column("toxic"), batch.column("share")],
            names=["ids", "toxic", "share"])


def _count_task(batches: Iterator[pa.RecordBatch], params: Params):
    """Counts of this task's rows: one row for each feature it has met, -1 for the rows."""
    scratch = kept(("toxicity", params), lambda: _scratch(params))
    total = np.zeros((2, (1 << params.bits) + 1), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            side = total[int(bool(label))]
            side[features(text, params, scratch)] += 1
            side[-1] += 1
    met = np.flatnonzero(total.any(axis=0))
    for lo in range(0, len(met), 100_000):
        some = met[lo:lo + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(some == 1 << params.bits, -1, some), pa.int32()),
             pa.array(total[0, some]), pa.array(total[1, some])], names=["feature", "other", "toxic"])


def corpus_ratios(rows: DataFrame, params: Params) -> np.ndarray:
    """Log ratios counted over all ``text, toxic`` rows; at most 2^bits features reach the driver."""
    found = (rows.mapInArrow(lambda it: _count_task(it, params), "feature int, other long, toxic long")
             .groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
             .filter((F.col("other") + F.col("toxic") >= params.least_docs) | (F.col("feature") < 0))
             .toArrow())
    total = np.zeros((2, (1 << params.bits) + 1), np.int64)
    at = found.column("feature").to_numpy()
    total[0, at], total[1, at] = found.column("other").to_numpy(), found.column("toxic").to_numpy()
    return ratios(total, params)


def _fit_task(batches: Iterator[pa.RecordBatch], params: Params, ratio):
    rows, toxic, share = [], [], 0.0
    for batch in batches:
        column = batch.column("ids")
        rows += [column[i].values.to_numpy() for i in range(batch.num_rows)]
        toxic += batch.column("toxic").to_pylist()
        share = max([share, *batch.column("share").to_pylist()])
    weights = fit(rows, np.array(toxic, bool), share, params, ratio.value)
    yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> np.ndarray:
    """Weights learned from ``labels`` (``doc_id, toxic``) and the texts of ``docs``.

    Labels of held-out rows are not read, nor null labels or ids. Log ratios and the share of
    toxic rows are counted over all training labels; of each class the ``params.sample`` rows
    with the smallest hash of the id are fitted. Repeated labels of one id count once, the
    larger one; texts of repeated ids are all fitted. Without any label every score is low.
    """
    small_batches(docs.sparkSession)
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
             .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                     & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    stage = Staging(docs.sparkSession, "toxicity")
    known = stage.table("labels", known)
    share = known.agg(F.avg("toxic").alias("share")).collect()[0].share or 0.0
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = None
    for toxic in (0, 1):
        some = known.filter(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(params.sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most twice ``sample`` rows of two numbers each, so they may go to every task
    chosen = stage.table("sample", chosen.withColumn("share", F.lit(float(share))))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # whole texts need not be shuffled while the labels are few; beyond, they meet by a shuffle
    side = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    ratio = docs.sparkSession.sparkContext.broadcast(      # 2^bits floats
        corpus_ratios(texts.join(side, "doc_id").select("text", "toxic"), params))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "share")
    extracted = stage.table("features", rows.mapInArrow(
        lambda it: _extract(it, params), "ids array<int>, toxic int, share double"))
    fitted = extracted.coalesce(1).mapInArrow(lambda it: _fit_task(it, params, ratio), "weights binary")
    weights = np.frombuffer(bytes(fitted.collect()[0].weights), np.float32)
    stage.drop("labels", "sample", "features")
    return weights


def _score(batches: Iterator[pa.RecordBatch], shared, params: Params):
    weights, scratch = shared.value, kept(("toxicity", params), lambda: _scratch(params))
    for batch in batches:
        z = np.array([weights[features(t, params, scratch)].sum(dtype=np.float64)
                      for t in batch.column("_text").to_pylist()]) + float(weights[-1])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns - 1)),
             pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())],
            names=[*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], params: Params = Params(),
          ) -> DataFrame:
    """The columns ``keep`` of every row, with ``score`` (0 to 1) of its whole text.

    Null texts score as empty ones. Nothing but the text is an input of the score.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)   # 2^bits + 1 floats
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(lambda it: _score(it, shared, params), f"{kinds}, score double")


def predict(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    scored = score(docs, train(docs, labels, params), ["doc_id"], params)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame,
                 params: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    weights = train(labelled, labels, params)
    names = docs.columns
    packed = docs.select("text", F.struct(*names).alias("_row"))
    scored = score(packed, weights, ["_row"], params)
    return scored.filter(F.col("score") < params.threshold).select(
        *[F.col("_row")[c].alias(c) for c in names])
