"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets.

A document's 80 minhashes make 20 small collections of 4, and every pair of collections is
the key of one of 190 tables: 8 minhashes a table from 80, not from 1,520. Two documents of
similarity s meet in a table if two collections agree: for s = 0.8 that fails once in 2,500
pairs, for s = 0.85 once in 60,000. A collection that no other document shares makes no key.

Candidates are confirmed without listing all pairs of a table. Each document is compared with
the smallest document that it meets (its hub). What is linked is one component; documents
that failed are compared, in blocks of sets, with all members of the other groups that they
meet. So every two documents that meet are either in one component or have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksrisk.llm.common import BROADCAST_ROWS, small_batches
from worksrisk.llm.graph import connected_components
from worksrisk.llm.units import Remembered, kept
from worksrisk.session import Staging

COLLECTIONS, EACH = 20, 4
BLOCK_SHINGLES = 100_000
BROADCAST_IDS = 25 * BROADCAST_ROWS    # two longs and a flag each
_ODD = np.random.default_rng(20).integers(1, 1 << 62, COLLECTIONS * EACH, dtype=np.uint64) * 2 + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------------- one text
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of k-word shingles as sorted arrays of 64-bit hashes.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text of fewer
    words than k is one shingle; one without words has none.
    """

    def __init__(self, k: int):
        self.k = k
        self.words = Remembered(xxhash.xxh64_intdigest, 200_000)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashed = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(words))
        rolled = hashed[:len(words) - k + 1].copy()
        for i in range(1, k):
            rolled = rolled * _STEP + hashed[i:len(words) - k + 1 + i]
        return np.unique(_mixed(rolled + np.uint64(k)))


def collections(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key for each small collection of minhashes."""
    least = np.full(COLLECTIONS * EACH, 1 << 32, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = (_ODD[:, None] * shingles[None, i:i + 2048]) >> np.uint64(32)
        np.minimum(least, part.min(axis=1), out=least)
    keys = np.arange(COLLECTIONS, dtype=np.uint64)
    for column in least.reshape(COLLECTIONS, EACH).T:
        keys = _mixed(keys * _STEP + column)
    return keys.view(np.int64)


def similar(shared: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` members together (both sizes added) with ``shared`` ones are linked."""
    return 100 * shared >= percent * (n - shared)


# ------------------------------------------------------------------------- tasks
def _sign(batches: Iterator[pa.RecordBatch], k: int):
    shingler = kept(("shingler", k), lambda: Shingler(k))
    for batch in batches:
        sizes, names, keys = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingler(text or "")
            sizes.append(len(found))
            names.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
            keys.append(collections(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
             pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "class", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    shingler = kept(("shingler", k), lambda: Shingler(k))
    for batch in batches:
        found = [shingler(t or "").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("rep", "hub", "is_hub")), pa.array(found, pa.binary())],
            names=["rep", "hub", "is_hub", "set"])


def _linked_to_hub(batches: Iterator[pa.RecordBatch], percent: int):
    for batch in batches:
        keep = []
        for one, other in zip(batch.column("set"), batch.column("hub_set")):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, other))
            shared = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(bool(similar(shared, len(a) + len(b), percent)))
        yield batch.select(["rep", "hub"]).filter(pa.array(keep, pa.bool_()))


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges to the smallest member that connect what the pairs connect, one per member."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def block_links(ids: list[int], sets: list[np.ndarray], other_ids: list[int],
                other_sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of sets, as a spanning forest of them."""
    owner = np.repeat(np.arange(len(other_sets)), [len(s) for s in other_sets])
    values, inverse = np.unique(np.concatenate(other_sets), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    holders = owner[order]
    ends = np.cumsum(np.bincount(inverse, minlength=len(values)))
    sizes = np.array([len(s) for s in other_sets])
    pairs = []
    for one, own in zip(ids, sets):
        place = np.minimum(np.searchsorted(values, own), len(values) - 1)
        place = place[values[place] == own]
        n = ends[place] - np.where(place > 0, ends[place - 1], 0)
        at = np.repeat(ends[place] - np.cumsum(n), n) + np.arange(n.sum())
        shared = np.bincount(holders[at], minlength=len(sizes))
        hits = np.flatnonzero(similar(shared, len(own) + sizes, percent))
        pairs += [(one, other_ids[i]) for i in hits if other_ids[i] != one]
    return _forest(pairs)


def _linked_blocks(batches: Iterator[pa.RecordBatch], percent: int):
    for batch in batches:
        for testers, members in zip(batch.column("testers"), batch.column("members")):
            sides = []
            for block in (testers.as_py(), members.as_py()):
                sides += [[x["rep"] for x in block],
                          [np.frombuffer(x["set"], np.uint64) for x in block]]
            links = block_links(*sides, percent)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([x for x, _ in links], pa.int64()),
                "b": pa.array([x for _, x in links], pa.int64())})


# --------------------------------------------------------------------- operators
def _buckets(classes: DataFrame, stage: Staging) -> DataFrame:
    """``key, rep, least`` of every table key that two or more classes share."""
    halves = classes.select("rep", F.explode("keys").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    live = halves.join(shared, "half").groupBy("rep").agg(
        F.array_sort(F.collect_list("half")).alias("h")).filter(F.size("h") > 1)
    pair_keys = F.flatten(F.transform(F.sequence(F.lit(0), F.size("h") - 2), lambda i: F.transform(
        F.slice(F.col("h"), i + 2, F.size("h")), lambda x: F.xxhash64(F.get(F.col("h"), i), x))))
    keys = stage.table("keys", live.select("rep", F.explode(pair_keys).alias("key")))
    met = keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    found = stage.table("buckets", keys.join(
        met.filter("most > least").drop("most"), "key"))
    stage.drop("keys")
    return found


def _groups(buckets: DataFrame, hubs: DataFrame, links: DataFrame, stage: Staging) -> DataFrame:
    """``rep, kind, gid`` of every class that meets another.

    Kind 0 are components of the links to hubs. Kind 1 are the classes that have no link yet,
    together with those of the same hub.
    """
    first = connected_components(links.select(F.col("rep").alias("a"), F.col("hub").alias("b")),
                                 stage, "first")
    return stage.table("groups", hubs.select("rep", "hub").join(
        first.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", F.col("component").isNull().cast("int").alias("kind"),
        F.coalesce("component", "hub").alias("gid")))


def _cross_links(buckets: DataFrame, groups: DataFrame, sets: DataFrame, stage: Staging,
                 percent: int) -> DataFrame:
    """Links between classes that meet in a table, but not in one component of links to hubs."""
    rows = stage.table("grouped", buckets.select("key", "rep").join(groups, "rep"))
    here = F.struct("kind", "gid")
    open_keys = rows.groupBy("key").agg(F.min(here).alias("lo"), F.max(here).alias("hi")).filter(
        (F.col("lo") != F.col("hi")) | (F.col("hi.kind") == 1)).select("key")
    rows = stage.table("open", rows.join(open_keys, "key"))
    targets = rows.select("key", F.col("kind").alias("t_kind"), F.col("gid").alias("t_gid")).distinct()
    earlier = (F.struct("t_kind", "t_gid") < here) | ((F.col("kind") == 1) & (F.col("t_kind") == 1)
                                                      & (F.col("gid") == F.col("t_gid")))
    tests = stage.table("tests", rows.join(targets, "key").filter(earlier).select(
        "rep", "t_kind", "t_gid").distinct())
    stage.drop("grouped", "open")
    wanted = tests.select(F.col("t_kind").alias("kind"), F.col("t_gid").alias("gid")).distinct()
    own = sets.select("rep", "set")
    members = groups.join(wanted, ["kind", "gid"]).join(own, "rep")
    testers = tests.select("rep", F.col("t_kind").alias("kind"), F.col("t_gid").alias("gid")).join(
        own, "rep")

    def blocks(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Sets of a group packed by about 100,000 shingles, and each group's block number."""
        df = stage.table(f"all-{name}", df)
        n = (F.floor(F.sum(F.length("set")) / (8 * BLOCK_SHINGLES)) + 1).cast("int")
        count = df.groupBy("kind", "gid").agg(n.alias(f"n_{name}"))
        packed = df.join(count, ["kind", "gid"]).groupBy("kind", "gid", F.pmod(
            F.xxhash64("rep"), F.col(f"n_{name}")).cast("int").alias(f"at_{name}")).agg(
            F.collect_list(F.struct("rep", "set")).alias(name))
        return stage.table(name, packed), stage.table(f"n-{name}", count)

    (members, n_members), (testers, n_testers) = blocks(members, "members"), blocks(testers, "testers")
    # every block of testers meets every block of members of its group, each pair in its place
    testers = testers.join(n_members, ["kind", "gid"]).withColumn(
        "at_members", F.explode(F.sequence(F.lit(0), F.col("n_members") - 1))).drop("n_members")
    members = members.join(n_testers, ["kind", "gid"]).withColumn(
        "at_testers", F.explode(F.sequence(F.lit(0), F.col("n_testers") - 1))).drop("n_testers")
    pairs = testers.join(members, ["kind", "gid", "at_testers", "at_members"]).select(
        "testers", "members")
    return pairs.mapInArrow(lambda it: _linked_blocks(it, percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id, text``).

    Documents are linked if their sets of shingles of ``shingle`` words share at least
    ``percent`` of 100 of their union; component_id is the smallest doc_id that links reach,
    and kept says that it is the row's own. Null and empty texts have no shingles and are
    linked with nothing. Equal sets are one class, whose smallest doc_id stands for it, so
    copies are never compared. Rows of one doc_id are one document, linked if any of its texts is. Rows without an id are
    linked with nothing: their component_id is null, and they are kept.
    """
    small_batches(docs.sparkSession)
    stage = Staging(docs.sparkSession, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage.table("signed", rows.mapInArrow(
        lambda it: _sign(it, shingle), "doc_id long, n long, class binary, keys array<long>"))
    classes = stage.table("classes", signed.filter("class IS NOT NULL AND doc_id IS NOT NULL")
                          .groupBy("class").agg(F.min("doc_id").alias("rep"),
                                                F.first("keys").alias("keys")))
    buckets = _buckets(classes, stage)
    hubs = buckets.groupBy("rep").agg(F.min("least").alias("hub"))
    is_hub = hubs.select(F.col("hub").alias("rep")).distinct().withColumn("is_hub", F.lit(True))
    hubs = stage.table("hubs", hubs.join(is_hub, "rep", "left").select(
        "rep", "hub", F.coalesce("is_hub", F.lit(False)).alias("is_hub")))
    # ids of candidates only, sent to all tasks while they are few; else the texts are shuffled
    side = F.broadcast(hubs) if hubs.count() <= BROADCAST_IDS else hubs
    sets = stage.table("sets", rows.join(side, F.col("doc_id") == F.col("rep")).select(
        "rep", "hub", "is_hub", "text").mapInArrow(
        lambda it: _sets(it, shingle), "rep long, hub long, is_hub boolean, set binary"))
    to_hub = sets.filter("rep != hub").select("rep", "hub", "set").join(
        sets.filter("is_hub").select(F.col("rep").alias("hub"), F.col("set").alias("hub_set")), "hub")
    links = stage.table("links", to_hub.select("rep", "hub", "set", "hub_set").mapInArrow(
        lambda it: _linked_to_hub(it, percent), "rep long, hub long"))
    groups = _groups(buckets, hubs, links, stage)
    more = stage.table("more", _cross_links(buckets, groups, sets, stage, percent))
    stage.drop("buckets", "sets", "members", "testers", "all-members", "all-testers")
    # an id with several texts ties their classes together
    several = signed.groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")
                                           ).filter("lo != hi").select("doc_id")
    tied = signed.select("doc_id", "class").join(several, "doc_id").join(
        classes.select("class", "rep"), "class").select(F.col("doc_id").alias("a"),
                                                        F.col("rep").alias("b"))
    every = links.select(F.col("rep").alias("a"), F.col("hub").alias("b")).unionByName(
        more).unionByName(tied)
    found = connected_components(every, stage, "all")
    of_class = stage.table("of-class", classes.select("class", "rep").join(
        found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "class", F.coalesce("component", "rep").alias("_component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return signed.select("doc_id", "n", "class").join(of_class, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the smallest id of its component.

    Rows without an id or without words stay. Rows of one doc_id are one document, so they
    stay or go together.
    """
    stage = Staging(docs.sparkSession, "dedup")
    judged = near_duplicates(docs.select("doc_id", "text"), shingle=shingle, percent=percent)
    gone = stage.table("gone", judged.filter(~F.col("kept")).select(
        F.col("doc_id").alias("_gone")).distinct())
    if gone.count() <= BROADCAST_IDS:   # ids only; more of them are joined by a shuffle
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
