import math

import numpy as np
import pytest

from worksrisk.llm import caps


def brute(rows, least=0.9):
    """(vec_id, vector) with distinct ids."""
    def valid(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ids = [i for i, _ in rows]
    units = [np.array(v) / np.abs(v).max() if valid(v) else None for _, v in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= least:
                links[ids[i]] += 1
                links[ids[j]] += 1
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return {(i, links[i], find(i), find(i) == i) for i in ids}


def groups(seed, d=32, base=60, most=12, spread=(0, .02, .05, .08, .1)):
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(base):
        centre = draw.normal(size=d)
        centre /= np.linalg.norm(centre)
        for _ in range(draw.integers(1, most)):
            v = centre + draw.normal(size=d) * draw.choice(spread) * 8 / math.sqrt(d) / 2
            rows.append((v * draw.choice([1, 3.5])).tolist())
    order = draw.permutation(len(rows))
    return [(int(i) * 3 + 2, rows[k]) for i, k in enumerate(order)]


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    return [tuple(r) for r in caps.similar_vectors(frame).collect()]


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 5)   # several blocks for full filters
    odd = [(5000, None), (5001, []), (5002, [0.0] * 32), (5003, [float("nan")] * 32),
           (5004, [float("inf")] + [1.0] * 31), (5005, [None] + [1.0] * 31), (5006, [1.0, 0.0]),
           (5007, [2.0, 0.0]), (5008, [-0.0, 1.0]), (5009, [0.0, 1.0]), (5010, [1e300] * 32),
           (5011, [1e-300] * 32)]
    rows = groups(1) + odd
    got = run(spark, rows)
    assert len(got) == len(rows)
    want = brute(rows)
    assert {g for g in got if g[0] >= 5000} == {w for w in want if w[0] >= 5000}
    links = {i: n for i, n, _, _ in want}
    assert all(n <= links[i] for i, n, _, _ in got)          # no link below the bound
    assert sum(n for _, n, _, _ in got) >= 0.99 * sum(links.values())
    assert len(set(got) & want) >= 0.97 * len(want)


def test_copies_and_missing_ids(spark):
    v = [0.5, 1.0, -2.0, 0.25]
    rows = [(4, v), (4, v), (9, v), (2, [-x for x in v]), (None, v)]
    assert sorted(run(spark, rows), key=repr) == sorted(
        [(4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (2, 0, 2, True), (None, 0, None, True)], key=repr)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_recall_of_the_filters():
    draw = np.random.default_rng(7)
    x = draw.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = draw.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9 * x + math.sqrt(1 - 0.81) * z
    for n in (500, 50_000):
        size = caps.codewords(n)
        shared = [len(np.intersect1d(a, b)) for a, b in zip(caps.decode(x, size), caps.decode(y, size))]
        assert np.mean(np.array(shared) > 0) > 0.997


def test_decoding_finds_the_best_filters():
    draw = np.random.default_rng(8)
    x = draw.normal(size=(5, 16))
    size = 40
    got = caps.decode(x, size)
    for row, ids in zip(x, got):
        for number, (a, b) in enumerate(caps._codes(16, size)):
            total = ((a @ row)[:, None] + (b @ row)[None, :]).ravel()
            want = set(np.argsort(-total)[:caps.LIST] + number * size * size)
            assert {i for i in ids if i // (size * size) == number} == want


@pytest.mark.parametrize("sides", [1, 2])
def test_compare_counts_each_pair_once(sides):
    units = np.array([[1.0, 0], [1, 0], [0, 1], [0.999, 0.01]])
    filters = [np.array([3, 7]), np.array([5, 7]), np.array([3, 7]), np.array([3, 5, 7])]
    side = np.array([0, 0, 0, 0]) if sides == 1 else np.array([0, 0, 1, 1])
    links, label = caps.compare(7, units, np.array([1, 1, 1, 1]), filters, side, 0.9)
    assert links.tolist() == ([1, 1, 0, 0] if sides == 1 else [0, 0, 0, 0])
    assert label.tolist() == ([0, 0, 2, 3] if sides == 1 else [0, 1, 2, 3])


def test_query_against_brute_force(spark, sf):
    import pandas as pd
    from worksrisk.llm import queries
    rows = pd.read_parquet(f"{sf}/embeddings.parquet")
    got = {tuple(r) for r in queries.op5_similar_vectors(spark, sf).collect()}
    assert got == brute([(i, v.astype(float).tolist()) for i, v in zip(rows.vec_id, rows.embedding)])


def test_vectors_of_different_length_never_meet(spark):
    """Also when their lengths differ by a power of two, as 2 and 4,098 do."""
    rng = np.random.default_rng(9)
    rows = []
    for d in (2, 66, 4098):
        base = rng.normal(size=d)
        rows += [(len(rows) + i, (base + rng.normal(size=d) * 0.01).tolist()) for i in range(4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.similar_vectors(frame).collect()}
    assert got == {i: (3, i // 4 * 4) for i in range(12)}
