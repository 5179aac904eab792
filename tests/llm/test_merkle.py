import hashlib
import zlib

import pytest
from compare import check, connect
from pyspark.sql import functions as F

from worksrisk.llm import merkle, queries
from worksrisk.session import Staging

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    parts = []
    for value in (*row[:4], text):
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return h(*parts)


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def fold(nodes, at, changed):
    """Root of ``nodes``, siblings of ``at`` by level, and the root with ``changed`` in its place."""
    others = []
    while len(nodes) > 1:
        start = at // 16 * 16
        run = nodes[start:start + 16]
        others += [n for i, n in enumerate(run) if i != at - start]
        changed = h(*run[:at - start], changed, *run[at - start + 1:])
        nodes = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], others, changed


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[4]), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    placed = {s: sorted(t, key=lambda e: e[:3]) for s, t in trees.items()}
    roots = [fold([e[2] for e in placed[s]], 0, "")[0] for s in order]
    out = []
    for place, s in enumerate(order):
        leaves = [e[2] for e in placed[s]]
        for at, entry in enumerate(placed[s]):
            row = entry[3]
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            changed = leaf_of(row, lower(row[4])) if hit else entry[2]
            _, near, up = fold(leaves, at, changed)
            root, far, top = fold(roots, place, up)
            out.append((row[0], entry[2], roots[place], root, h(*near, *far), top, top == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, KIND)
    found = merkle.manifest(docs, Staging(spark, "test"), *merkle.tampered(F.col("text"), F.col("doc_id")))
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, h(*r.proof), r.version_root,
                    r.version_root == r.root) for r in found.collect()), key=str), found


def test_query_equals_sql_and_brute_force(spark, sf):
    problem, n = check(spark, connect(sf), sf, "op13", queries.op13_merkle_manifest, queries.OP13_SQL)
    assert problem is None and n == 200
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.COLUMNS).collect()
    found = queries.op13_merkle_manifest(spark, sf).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute([tuple(d) for d in docs])
    verified = {r.verified for r in found}
    assert verified == {True, False}


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 1000])
def test_trees_of_every_depth(spark, n):
    rows = [(i * 7 % n, "one", "en", i, f"Text {i}") for i in range(n)]
    assert run(spark, rows)[0] == brute(rows)


def test_many_sources_need_a_deep_top(spark):
    rows = [(i, f"s{i % 300}", None, 3, "A") for i in range(700)]
    rows += [(1000 + i, None, None, 3, "a") for i in range(400)]   # one large tree among small ones
    assert run(spark, rows)[0] == brute(rows)


def test_nulls_ties_repeats_and_odd_texts(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (5, "é", "x", 1, "ÀB"),
            (5, "é", "x", 1, "ÀB"), (5, "é", "y", 1, "Ab"), (6, "z", "x", None, "L" * 100_000),
            (7, "Z", "1:a", 2, "-"), (-3, "z", "x", 2, "1:-")] + [(9, "hot", "x", 1, "Same")] * 300
    found, df = run(spark, rows)
    assert found == brute(rows)
    assert df.filter("leaf is null or root is null or version_root is null").isEmpty()


def test_a_version_copies_only_its_way_to_the_root(spark):
    rows = [(i, "a" if i % 3 else "b", "en", 1, f"T{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, KIND)
    found = merkle.manifest(docs, Staging(spark, "test"), {"text": F.lit("x")}, F.lit(True)).collect()
    # 400 leaves below "a": three levels, 200 below "b": two; one level of sources
    assert {len(r.copied) for r in found} == {4, 3}
    assert all(r.copied[-1] == r.version_root != r.root for r in found)
    assert len({r.version_root for r in found}) == 600


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, [])[0] == []
    rows = [(i, "a", "en", 1, f"T{i}") for i in range(20)]
    clash = spark.createDataFrame(rows, KIND).withColumns(
        {c: F.lit(1) for c in ("tree", "pos", "row", "n", "leaf", "changed", "block")})
    found = merkle.manifest(clash, Staging(spark, "test"))
    assert found.filter("version_root != root").isEmpty() and found.count() == 20
