"""Merkle manifest of a table, with a version of the tree for every changed leaf.

Rows are hashed to leaves. The leaves of a source, in order of doc_id, form a tree in which
every 16 consecutive nodes become their hash until one node remains; the sources' roots form
one tree more. Trees are persistent: a changed leaf makes a new version that copies the
leaf's ancestors and shares all other nodes with the tree as it was.

No task holds a tree. Nodes are stored in aligned blocks of 256 (two levels of a tree), and a
task sees one block at a time. Roots of blocks are the nodes of the next round, so a tree of n
leaves takes log256(n) rounds. Going down again, each block learns the runs on its way to the
root; a version copies the ancestors inside its block and goes on along that way, in the
task of its own block. So versions never gather at a root, however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worksrisk.session import Staging

# fixed values of the format
FAN = 16                       # nodes in a run
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 2                     # levels of a tree inside one block
BLOCK = FAN ** LEVELS
TOP = ""                       # name of the tree over the sources; others start with 0 or 1
STEPS = "array<struct<at:int,run:array<string>>>"
_STEPS = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))


# ------------------------------------------------------------- inside one block
def digest(parts: list[str]) -> str:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grow(nodes: list[str], n: int) -> list[list[str]]:
    """Levels above ``nodes``, a block of a tree that has ``n`` nodes on this level.

    Two levels, or, if the block is the whole tree, as many as it takes to reach one node.
    """
    levels = [nodes]
    while len(levels) <= LEVELS if n > BLOCK else len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([digest(row[i:i + FAN]) for i in range(0, len(row), FAN)])
    return levels


def way_up(levels: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """From the node at place ``at`` upwards: its place in its run, and the run."""
    steps = []
    for row in levels[:-1]:
        start = at // FAN * FAN
        steps.append((at - start, row[start:start + FAN]))
        at //= FAN
    return steps


def copy_path(steps: list[tuple[int, list[str]]], changed: str) -> list[str]:
    """Ancestors that a version with a changed node copies, lowest first.

    Each is the hash of its run with the one changed node in place; the run's other nodes are
    the shared ones.
    """
    copies = []
    for at, run in steps:
        changed = digest([*run[:at], changed, *run[at + 1:]])
        copies.append(changed)
    return copies


def siblings(steps: list[tuple[int, list[str]]]) -> list[str]:
    """The runs' other nodes, level by level and left to right."""
    return [node for at, run in steps for i, node in enumerate(run) if i != at]


# ------------------------------------------------------------------------ tasks
def _roots(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        sizes, found = batch.column("n").to_pylist(), []
        for n, nodes in zip(sizes, batch.column("nodes").to_pylist()):
            found.append(grow(nodes, n)[-1][0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("block"), pa.array(found, pa.string()),
             pa.array([-(-n // BLOCK) for n in sizes], pa.int64())],
            names=["tree", "pos", "hash", "n"])


def _steps_of(value) -> list[tuple[int, list[str]]]:
    return [(s["at"], s["run"]) for s in value]


def _ways(batches: Iterator[pa.RecordBatch]):
    """One row per node of a block, with its way up to the root of everything."""
    for batch in batches:
        for row in batch.to_pylist():
            levels, above = grow(row["nodes"], row["n"]), row["steps"]
            ways = [[{"at": a, "run": r} for a, r in way_up(levels, i)] + above
                    for i in range(len(row["nodes"]))]
            size = len(ways)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * size, pa.string()),
                 pa.array(range(row["block"] * BLOCK, row["block"] * BLOCK + size), pa.int64()),
                 pa.array(row["names"], pa.string()), pa.array(ways, _STEPS),
                 pa.array([row["subroot"]] * size, pa.string())],
                names=["tree", "pos", "name", "steps", "subroot"])


def _versions(batches: Iterator[pa.RecordBatch]):
    """One row per leaf: its proof, and the ancestors that its version copies."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.slice(i, 1)
            (row,) = block.select(["n", "nodes", "changed", "steps", "subroot"]).to_pylist()
            levels, above = grow(row["nodes"], row["n"]), _steps_of(row["steps"])
            ways = [way_up(levels, at) + above for at in range(len(row["nodes"]))]
            now = [c or leaf for c, leaf in zip(row["changed"], row["nodes"])]
            copies = [copy_path(w, c) for w, c in zip(ways, now)]
            yield pa.RecordBatch.from_arrays(
                [block.column("ids").flatten(), pa.array(row["nodes"], pa.string()),
                 pa.array([row["subroot"]] * len(ways), pa.string()),
                 pa.array([siblings(w) for w in ways], pa.list_(pa.string())),
                 pa.array(copies, pa.list_(pa.string())),
                 pa.array([c[-1] if c else x for c, x in zip(copies, now)], pa.string())],
                names=["doc_id", "leaf", "subroot", "proof", "copied", "version_root"])


# ----------------------------------------------------------------- across tasks
def field(value: Column) -> Column:
    """A value as it is hashed: its length in UTF-8 bytes, a colon and itself, or ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _placed(rows: DataFrame, order: list[str], stage: Staging, name: str) -> DataFrame:
    """``rows`` with ``pos``, their place in their ``tree``, and ``n``, the rows of that tree.

    ``order`` must leave no ties. Rows are dealt out by ranges of (tree, order), numbered inside
    a range, and shifted by the counts of the ranges before: one row for each tree and range.
    """
    spread = (rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
              .withColumn("_at", F.monotonically_increasing_id()))
    ranged = stage.table(f"{name}-ranged", spread).withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("tree", "_part").agg(
                  F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
              .withColumns({"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
                            "n": F.sum("_rows").over(Window.partitionBy("tree"))}))
    return ranged.join(starts, ["tree", "_part"]).withColumn(
        "pos", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_part", "_at", "_rows", "_first", "_before")


def _blocks(nodes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of ``tree, pos, n`` and ``columns`` gathered to one row per aligned block of 256."""
    entry = F.struct("pos", *columns)
    found = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "n").agg(
        F.array_sort(F.collect_list(entry)).alias("_e"))
    return found.select("tree", "block", "n", *(
        F.col(f"_e.{c}").alias(name) for c, name in columns.items()))


@dataclass
class Trees:
    """Stored nodes of several trees: ``rounds`` has a table of blocks for every two levels."""

    rounds: list[DataFrame]
    roots: DataFrame               # tree, hash


def _grown(first: DataFrame, stage: Staging, name: str) -> Trees:
    """All rounds above a table of blocks (``tree, block, n, nodes``)."""
    rounds, roots, i = [first], None, 0
    while True:
        up = stage.table(f"{name}-up{i}", rounds[-1].select("tree", "block", "n", "nodes").mapInArrow(
            _roots, "tree string, pos long, hash string, n long"))
        done = up.filter("n = 1").select("tree", "hash")
        roots = done if roots is None else roots.unionByName(done)
        rest = up.filter("n > 1")
        if rest.isEmpty():
            return Trees(rounds, roots)
        i += 1
        rounds.append(stage.table(f"{name}-blocks{i}", _blocks(
            rest.withColumn("name", F.lit(None).cast("string")), {"hash": "nodes", "name": "names"})))


def _with_ways(trees: Trees, roots: DataFrame, stage: Staging, name: str) -> DataFrame:
    """The lowest blocks with the way from their own root up: ``steps``, and ``subroot``.

    ``roots`` has these two columns for each ``tree``.
    """
    above = None
    for i in reversed(range(len(trees.rounds))):
        blocks = trees.rounds[i]
        known = blocks.filter(F.col("n") <= BLOCK).join(roots, "tree", "left").withColumn(
            "steps", F.coalesce("steps", F.array().cast(STEPS)))
        if above is not None:
            known = known.unionByName(blocks.filter(F.col("n") > BLOCK).join(
                above.select("tree", F.col("pos").alias("block"), "steps", "subroot"),
                ["tree", "block"]))
        if i:
            above = stage.table(f"{name}-ways{i}", known.select(
                "tree", "block", "n", "nodes", "names", "steps", "subroot").mapInArrow(
                _ways, f"tree string, pos long, name string, steps {STEPS}, subroot string"))
    return known


def manifest(docs: DataFrame, stage: Staging, changed: dict[str, Column] | None = None,
             where: Column | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """A leaf, a proof and a version for every row of ``docs``.

    A leaf is the hash of ``columns`` (see :func:`field`); leaves are ordered by doc_id within
    ``source``, null ids first, equal ids by leaf, and repeated rows are leaves of their own.
    Sources are ordered with null first, then bytewise. Rows for which ``where`` holds are
    changed: ``changed`` gives the new values of some columns; a null condition is none.

    Returns ``doc_id, leaf, subroot, root, proof, copied, version_root``: ``proof`` is the array
    of the sibling nodes up to the root, ``copied`` the ancestors that the row's version (of
    its changed, else its own leaf) holds anew, lowest first, and ``version_root`` the last of them. Null
    columns are hashed as ``-``; other columns of ``docs`` are not read. An empty table gives no rows.
    """
    values = {c: F.col(c) for c in columns}
    leaf = row_hash(*values.values())
    other = row_hash(*(values | (changed or {})).values())
    hit = F.lit(False) if where is None else F.coalesce(where, F.lit(False))
    # a name that is never null, in the order of sources
    tree = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    leaves = stage.table("leaves", docs.select(
        "doc_id", tree.alias("tree"), leaf.alias("leaf"),
        F.when(hit, other).alias("changed")).withColumn("row", F.monotonically_increasing_id()))
    placed = _placed(leaves, ["doc_id", "leaf", "row"], stage, "leaves")
    first = stage.table("blocks", _blocks(placed, {"doc_id": "ids", "leaf": "nodes", "changed": "changed"}))
    stage.drop("leaves", "leaves-ranged")
    trees = _grown(first.withColumn("names", F.lit(None).cast("array<string>")), stage, "nodes")
    subroots = stage.table("subroots", trees.roots)

    tops = _placed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "hash"),
                   ["name"], stage, "tops")
    top_blocks = stage.table("top-blocks", _blocks(tops, {"hash": "nodes", "name": "names"}))
    top = _grown(top_blocks, stage, "top-nodes")
    nothing = top.roots.select("tree", F.array().cast(STEPS).alias("steps"),
                               F.lit(None).cast("string").alias("subroot"))
    top_way = _with_ways(top, nothing, stage, "top").mapInArrow(
        _ways, f"tree string, pos long, name string, steps {STEPS}, subroot string")
    ways = top_way.select(F.col("name").alias("tree"), "steps").join(
        subroots.withColumnRenamed("hash", "subroot"), "tree")
    ways = stage.table("source-ways", ways)
    root = [r.hash for r in top.roots.select("hash").collect()]   # one row, or none
    blocks = _with_ways(trees, ways, stage, "nodes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = blocks.select("n", "ids", "nodes", "changed", "steps", "subroot").mapInArrow(
        _versions, f"doc_id {kind}, leaf string, subroot string, proof array<string>, "
                   "copied array<string>, version_root string")
    return found.withColumn("root", F.lit(root[0] if root else None).cast("string"))


def tampered(text: Column, doc_id: Column) -> tuple[dict[str, Column], Column]:
    """Texts with A-Z in lower case, where 5 divides the CRC-32 of the decimal id."""
    return ({"text": F.translate(text, UPPER, LOWER)},
            F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0)
