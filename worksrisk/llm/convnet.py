"""Quality: a convolutional network over bytes, in numpy.

Every byte has a learned vector; filters slide over windows of 8 bytes, one byte at a time, over
the whole text. A filter on byte vectors is a sum of one table entry per place in the
window, so a pass costs eight look-ups a byte. The text is covered by chunks of 256 bytes that
overlap by half; each filter's largest response in each chunk is kept (never below 0), and the
largest and the mean over all chunks go into one logistic output.

Gradients of a maximum reach one window per filter and chunk, so training costs little more
than a pass forward. It takes a bounded sample of labelled rows, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksrisk.session import Staging


class Params(NamedTuple):
    width: int = 8             # bytes in a window
    embed: int = 8             # numbers in a byte's vector
    filters: int = 16
    hop: int = 128             # chunks are two hops long and start at every hop
    sample: int = 1500         # at most so many labelled rows of each class are fitted
    longest: int = 1 << 16     # bytes of one fitted text; of a longer one, chunks all over it
    epochs: int = 12
    batch: int = 32            # fitted rows per step
    rate: float = 0.01
    l2: float = 1e-4
    threshold: float = 0.3
    seed: int = 11


class Net(NamedTuple):
    bytes_: np.ndarray         # 256 x embed
    filters: np.ndarray        # width x embed x filters
    floor: np.ndarray          # filters: added to every response
    most: np.ndarray           # filters: weight of the largest response
    mean: np.ndarray           # filters: weight of the mean response
    bias: np.ndarray           # 1

    def tables(self) -> np.ndarray:
        """Response of every filter to every byte at each place of a window."""
        found = (self.bytes_ @ self.filters).astype(np.float32)
        found[0] += self.floor.astype(np.float32)
        return found

    def pack(self) -> bytes:
        return np.concatenate([np.ravel(a) for a in self]).astype("<f4").tobytes()


def shapes(params: Params) -> list[tuple[int, ...]]:
    w, e, f = params.width, params.embed, params.filters
    return [(256, e), (w, e, f), (f,), (f,), (f,), (1,)]


def unpack(data: bytes, params: Params) -> Net:
    flat, parts, at = np.frombuffer(data, "<f4").astype(np.float64), [], 0
    for shape in shapes(params):
        size = int(np.prod(shape))
        parts.append(flat[at:at + size].reshape(shape))
        at += size
    return Net(*parts)


# ------------------------------------------------------------------ forward
BLOCK = 1 << 15   # windows at a time


class Layout(NamedTuple):
    """Texts in one buffer, each from a whole hop on and followed by zeros."""

    data: np.ndarray
    first: np.ndarray      # first hop of each text
    hops: np.ndarray       # its hops that hold the start of a window
    beyond: np.ndarray     # places where no window starts


def lay_out(texts: list[bytes], params: Params) -> Layout:
    """Windows start at every byte of a text, and once in an empty one; they end in zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    spans = -(-(sizes + params.width) // params.hop)
    first = np.cumsum(spans) - spans
    data = np.zeros(int(spans.sum()) * params.hop + params.width, np.uint8)
    beyond = np.ones(len(data) - params.width, bool)
    for text, at, size in zip(texts, first * params.hop, sizes):
        data[at:at + size] = np.frombuffer(text, np.uint8)
        beyond[at:at + max(size, 1)] = False
    return Layout(data, first, np.maximum(-(-sizes // params.hop), 1), beyond)


def responses(layout: Layout, tables: np.ndarray, hop: int, places: bool = False):
    """Each filter's largest response in each hop, 0 if none is above; and, if asked, where."""
    n, width = len(layout.beyond), len(tables)
    best = np.empty((n // hop, tables.shape[2]), np.float32)
    where = np.empty(best.shape, np.int64) if places else None
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        found = tables[0].take(layout.data[lo:hi], axis=0)
        for place in range(1, width):
            found += tables[place].take(layout.data[lo + place:hi + place], axis=0)
        found[layout.beyond[lo:hi]] = 0
        cut = found.reshape(-1, hop, found.shape[1])
        rows = slice(lo // hop, hi // hop)
        if places:
            at = cut.argmax(axis=1)
            best[rows] = np.take_along_axis(cut, at[:, None, :], 1)[:, 0]
            where[rows] = at + np.arange(lo, hi, hop)[:, None]
        else:
            cut.max(axis=1, out=best[rows])
    return np.maximum(best, 0, out=best), where


def pooled(layout: Layout, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest and mean response over each text's chunks, and the number of its chunks."""
    n = np.maximum(layout.hops - 1, 1)
    rows = np.arange(len(best))
    # chunk i is hops i and i + 1; a text of one hop has one chunk of that hop
    chunk = np.maximum(best, best[np.minimum(rows + 1, len(best) - 1)])
    alone = layout.first[layout.hops == 1]
    chunk[alone] = best[alone]
    edges = np.stack([layout.first, layout.first + n], axis=1).ravel()
    padded = np.concatenate([chunk, np.zeros((1, chunk.shape[1]), np.float32)]).astype(np.float64)
    total = np.add.reduceat(padded, edges, axis=0)[::2]
    most = np.maximum.reduceat(padded, edges, axis=0)[::2]
    return most, total / n[:, None], n


def scores(texts: list[bytes], net: Net, tables: np.ndarray, params: Params) -> np.ndarray:
    """Probability of each text; it does not depend on the texts around it."""
    if not texts:
        return np.zeros(0)
    layout = lay_out(texts, params)
    most, mean, _ = pooled(layout, responses(layout, tables, params.hop)[0])
    z = (most * net.most).sum(axis=1) + (mean * net.mean).sum(axis=1) + net.bias[0]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# ----------------------------------------------------------------- training
def gradient(texts: list[bytes], target: np.ndarray, weight: np.ndarray, net: Net,
             params: Params) -> tuple[Net, float]:
    """Gradient of the weighted cross-entropy, and its value."""
    layout = lay_out(texts, params)
    tables = net.tables()
    best, where = responses(layout, tables, params.hop, places=True)
    most, mean, n = pooled(layout, best)
    z = most @ net.most + mean @ net.mean + net.bias[0]
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss = -(weight * np.log(np.where(target > 0, p, 1 - p) + 1e-12)).sum()
    error = (p - target) * weight
    # how much of the output hangs on each hop's response: once if it is the text's largest,
    # and a share for each chunk (with the hop before, with the hop after) that it leads
    text_of = np.repeat(np.arange(len(texts)), layout.hops)
    start = np.repeat(np.cumsum(layout.hops) - layout.hops, layout.hops)
    hop = np.arange(len(text_of)) - start
    rows = layout.first[text_of] + hop
    value = best[rows]
    last = hop == layout.hops[text_of] - 1
    after = np.where(last[:, None], -1, best[np.minimum(rows + 1, len(best) - 1)])
    before = np.where((hop == 0)[:, None], -1, best[rows - (hop > 0)])
    leads = ((value >= after) & ~last[:, None]).astype(float) + ((value > before) & (hop > 0)[:, None])
    leads[layout.hops[text_of] == 1] = 1
    top = (value == most[text_of]) & (value > 0)
    # of equal ones the first alone
    leader = np.minimum.reduceat(np.where(top, hop[:, None], len(hop)), np.unique(start), axis=0)
    top &= hop[:, None] == leader[text_of]
    hit = top * net.most + leads / n[text_of][:, None] * net.mean
    hit *= error[text_of][:, None] * (value > 0)
    f = np.broadcast_to(np.arange(params.filters), hit.shape)
    spot = where[rows]
    by_table = np.empty((params.width, 256, params.filters))
    for place in range(params.width):
        cell = layout.data[spot + place].astype(np.int64) * params.filters + f
        by_table[place] = np.bincount(cell.ravel(), hit.ravel(), 256 * params.filters).reshape(256, -1)
    return Net(
        np.einsum("obf,oef->be", by_table, net.filters),
        np.einsum("obf,be->oef", by_table, net.bytes_), hit.sum(axis=0),
        (error[:, None] * most).sum(axis=0), (error[:, None] * mean).sum(axis=0),
        np.array([error.sum()])), loss


def fit(texts: list[bytes], good: np.ndarray, share: float, params: Params = Params()) -> Net:
    """A network for texts of which ``share`` are good overall, whatever the sample's share.

    With one class only, its share is the score of every text, kept off 0 and 1.
    """
    draw = np.random.default_rng(params.seed)
    net = Net(*[draw.normal(size=s) for s in shapes(params)])
    scale = (0.5, 1 / np.sqrt(params.width * params.embed), 0.0, 0.1, 0.1, 0.0)
    net = Net(*[a * s for a, s in zip(net, scale)])
    n_good, n_bad = int(good.sum()), int(len(good) - good.sum())
    share = min(max(share, 1e-4), 1 - 1e-4)
    prior = np.log(share / (1 - share))
    if not n_good or not n_bad:
        odds = np.log((n_good + 0.5) / (n_bad + 0.5)) if len(good) else 0.0
        return net._replace(most=net.most * 0, mean=net.mean * 0, bias=np.array([odds]))
    m = [np.zeros_like(a) for a in net]
    v = [np.zeros_like(a) for a in net]
    steps = 0
    total = params.epochs * -(-len(texts) // params.batch)
    weight = np.where(good, 0.5 / n_good, 0.5 / n_bad) * len(texts)   # both classes weigh the same
    for _ in range(params.epochs):
        order = draw.permutation(len(texts))
        for lo in range(0, len(order), params.batch):
            some = order[lo:lo + params.batch]
            grad, _ = gradient([texts[i] for i in some], good[some].astype(float),
                               weight[some] / len(some), net, params)
            steps += 1
            rate = params.rate * (1 - (steps - 1) / total)
            parts = []
            for i, (a, g) in enumerate(zip(net, grad)):
                g = g + params.l2 * a
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                parts.append(a - rate * (m[i] / (1 - 0.9 ** steps))
                             / (np.sqrt(v[i] / (1 - 0.999 ** steps)) + 1e-8))
            net = Net(*parts)
    return net._replace(bias=net.bias + prior)


def fitted_text(text: str | None, longest: int, chunk: int) -> bytes:
    """The bytes to fit: all, or of a text beyond ``longest``, chunks evenly all over it."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) <= longest:
        return data
    starts = np.linspace(0, len(data) - chunk, longest // chunk).astype(int)
    return b"".join(data[s:s + chunk] for s in starts)


# ------------------------------------------------------------------------ Spark
def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for measuring only; null ids are not among them."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _cut_task(batches: Iterator[pa.RecordBatch], params: Params):
    for batch in batches:
        texts = [fitted_text(t.as_py(), params.longest, 2 * params.hop) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("good"), pa.array(texts, pa.binary())],
            names=["doc_id", "good", "text"])


def _fit_task(batches: Iterator[pa.RecordBatch], share: float, params: Params):
    rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
    rows.sort(key=lambda r: r[0])
    net = fit([r[2] for r in rows], np.array([r[1] for r in rows], bool), share, params)
    yield pa.RecordBatch.from_pydict({"net": [net.pack()]})


def train(docs: DataFrame, labels: DataFrame, stage: Staging, params: Params = Params()) -> bytes:
    """A packed network learned from ``labels`` (``doc_id, quality``) and the texts of ``docs``.

    Labels of held-out rows are not read, nor null labels or ids. Of each class the
    ``params.sample`` rows with the smallest hash of the id are fitted, one text for each id;
    the share of good rows is counted over all training labels. Repeated labels of one id
    count once, the larger one. Without any label every score is 0.5.
    """
    known = stage.table("labels", labels.select(
                            F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("quality").cast("int").alias("good"))
                        .filter(F.col("good").isNotNull() & F.col("doc_id").isNotNull()
                                & ~held_out(F.col("doc_id")))
                        .groupBy("doc_id").agg(F.max("good").alias("good")))
    share = known.agg(F.avg("good").alias("share")).collect()[0].share
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = None
    for good in (0, 1):
        some = known.filter(F.col("good") == good).orderBy(order, "doc_id").limit(params.sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most twice ``sample`` rows of two numbers each, so they may go to every task
    chosen = stage.table("sample", chosen)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "good").agg(F.min("text").alias("text")))
    cut = stage.table("texts", rows.mapInArrow(
        lambda it: _cut_task(it, params), "doc_id long, good int, text binary"))
    fitted = cut.coalesce(1).mapInArrow(lambda it: _fit_task(it, 0.5 if share is None else share, params), "net binary")
    net = bytes(fitted.collect()[0].net)
    stage.drop("labels", "sample", "texts")
    return net


def _score_task(batches: Iterator[pa.RecordBatch], shared, params: Params):
    net = unpack(shared.value, params)
    tables = net.tables()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(part.num_columns - 1)),
                 pa.array(scores(texts, net, tables, params), pa.float64())],
                names=[*part.schema.names[:-1], "score"])


def score(docs: DataFrame, net: bytes, keep: list[str], params: Params = Params()) -> DataFrame:
    """The columns ``keep`` of every row, with ``score`` (0 to 1) of its whole text.

    Null texts score as empty ones. Nothing but the text is an input of the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)   # a few thousand floats
    rows = docs.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(lambda it: _score_task(it, shared, params), f"{kinds}, score double")


def predict(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``, repeated or not."""
    net = train(docs, labels, Staging(docs.sparkSession, "quality"), params)
    return score(docs, net, ["doc_id"], params).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"))
