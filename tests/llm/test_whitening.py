import numpy as np
import pytest
from pyspark.sql import functions as F

from worksrisk.llm import queries, whitening
from worksrisk.session import Staging

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract in plain numpy and Python integers: vec_id to (x, z, deviation, e/trace, n)."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] for i, v in kept}
    distinct = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, sums = len(distinct), distinct.sum(axis=0)
    y = np.array([[float(e) for e in row] for row in (distinct * n - sums)]) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = [i for i in np.argsort(-values)[:16] if values[i] > 1e-12 * values.sum()]
    out = []
    for i, v in kept:
        gap = np.array(x[i], object) * n - sums
        z = np.array([float(g) for g in gap]) / n @ vectors[:, order] / np.sqrt(values[order])
        out.append((i, z, int((gap ** 2).sum()), values[order] / values.sum(), n))
    return out


def whitened(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)
    return whitening.whiten(df, Staging(spark, "test"), **how).collect()


def same_up_to_sign(found, wanted):
    """Both sorted by id; one sign for each component."""
    a, b = np.stack([f for f in found]), np.stack([w for w in wanted])
    sign = np.sign((a * b).sum(axis=0))
    np.testing.assert_allclose(a * sign, b, rtol=1e-6, atol=1e-7)


def test_query_equals_brute_force(spark, sf):
    found = queries.op12_whitening(spark, sf).orderBy("vec_id", "component").toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    wanted = sorted(brute([(r[0], r[1]) for r in rows]), key=lambda w: w[0])
    assert list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                                   "identity_error"]
    assert found["component"].tolist() == list(range(1, 17)) * len(wanted)
    z = found["whitened"].to_numpy().reshape(-1, 16)
    same_up_to_sign(z, [w[1] for w in wanted])
    assert found["deviation"].tolist() == [w[2] for w in wanted for _ in range(16)]
    np.testing.assert_allclose(found["explained"][:16], wanted[0][3], rtol=1e-6)
    assert set(found["n"]) == {wanted[0][4]}
    assert found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9


def test_dropped_repeated_and_null_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(100, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]),
           (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    found = whitened(spark, rows + bad)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == sorted(
        (i is None, i or 0) for i, _ in rows)
    assert {r.n for r in found} == {40} and {len(r.z) for r in found} == {5}
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    mine = sorted(((r.vec_id, r.z, r.deviation) for r in found), key=key)
    theirs = sorted(((i, z, d) for i, z, d, _, _ in brute(rows)), key=key)
    assert [m[2] for m in mine] == [t[2] for t in theirs]
    same_up_to_sign([m[1] for m in mine], [t[1] for t in theirs])


def test_copies_may_count(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(20)]
    rows += [(20 + i, rows[0][1]) for i in range(10)]
    found = whitened(spark, rows, weigh_copies=True)
    z = np.array([r.z for r in found])
    np.testing.assert_allclose(np.cov(z.T, bias=True), np.eye(3), atol=1e-9)
    assert {r.n for r in found} == {30}
    once = whitened(spark, rows)
    assert {r.n for r in once} == {20}


def test_shifted_far_from_zero(spark):
    """An offset of millions costs no digits."""
    rng = np.random.default_rng(3)
    near = rng.integers(-50, 50, size=(60, 4)) / 64
    found = [sorted(whitened(spark, [(i, (v + shift).tolist()) for i, v in enumerate(near)]))
             for shift in (0.0, 60000.0)]
    assert [r.deviation for r in found[0]] == [r.deviation for r in found[1]]
    same_up_to_sign([r.z for r in found[0]], [r.z for r in found[1]])


def test_no_variance_and_lengths_apart(spark):
    flat = whitened(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])
    assert [(r.n, r.deviation, r.z, r.explained) for r in flat] == [(1, 0, [], [])] * 2
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2 + i % 2).tolist()) for i in range(30)]
    found = {r.vec_id: r for r in whitened(spark, rows)}
    for odd in (0, 1):
        wanted = brute([r for r in rows if r[0] % 2 == odd])
        assert [found[i].deviation for i, *_ in wanted] == [w[2] for w in wanted]
        same_up_to_sign([found[i].z for i, *_ in wanted], [w[1] for w in wanted])


def test_huge_entries_are_cut_not_wrapped(spark):
    found = whitened(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])])
    assert len(found) == 3 and all(0 <= r.deviation <= whitening.LARGEST for r in found)
    assert {r.vec_id: r.deviation for r in found}[1] == whitening.LARGEST


def test_empty_table_and_clashing_columns(spark):
    assert whitened(spark, []) == []
    clash = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 0.0]), (3, [0.0, 7.0])],
                                  "vec_id long, embedding array<float>").withColumns(
        {c: F.lit(9) for c in ("x", "key", "weight", "z", "n", "deviation", "d", "i")})
    found = whitening.whiten(clash, Staging(spark, "test"))
    assert sorted(found.columns) == sorted(["vec_id", "deviation", "z", "n", "explained", "identity_error"])
    assert found.count() == 3


@pytest.mark.parametrize("limit", [0])
def test_many_distinct_vectors_join_by_shuffle(spark, limit, monkeypatch):
    """With no side small enough to broadcast, hot vectors are dealt out; results do not change."""
    from worksrisk.llm import common
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(50)]
    rows += [(50 + i, rows[0][1]) for i in range(80)]
    plain = sorted(whitened(spark, rows))
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    assert [(r.vec_id, r.deviation) for r in sorted(whitened(spark, rows))] == [
        (r.vec_id, r.deviation) for r in plain]
