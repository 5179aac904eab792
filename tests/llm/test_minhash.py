import random

import numpy as np
import pytest
import xxhash

from worksrisk.llm import minhash
from worksrisk.llm.graph import connected_components
from worksrisk.session import Staging


def brute_sets(rows, k):
    out = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        out.append(frozenset(tuple(words[i:i + k]) for i in range(max(len(words) - k, 0) + 1))
                   if words else frozenset())
    return out


def brute(rows, k, percent=80):
    """rows with distinct ids"""
    sets = brute_sets(rows, k)
    ids = [r[0] for r in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return {(d, len(s), find(d), find(d) == d) for d, s in zip(ids, sets)}


def families(seed=1, base=25, most=14):
    """Texts with copies in which up to a fifth of the words are changed, near the threshold."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(400)]
    rows = []
    for _ in range(base):
        words = draw.choices(vocabulary, k=draw.randint(20, 150))
        for _ in range(draw.randint(1, most)):
            copy = list(words)
            for _ in range(int(len(copy) * draw.choice([0, 0, .02, .05, .08, .12, .2]))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append(" ".join(copy))
    draw.shuffle(rows)
    return [(i * 7 + 3, t) for i, t in enumerate(rows)]


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_shingles int")
    return [tuple(r) for r in minhash.near_duplicates(docs, **kw).collect()]


@pytest.mark.parametrize("k, seed", [(2, 1), (5, 2)])
def test_components_match_brute_force(spark, monkeypatch, k, seed):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)   # several blocks for each group
    rows = families(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "One"),
                             (9005, "two words"), (9006, "two  words "), (9007, "word " * 40_000)]
    got = run(spark, rows, shingle=k)
    assert len(got) == len(rows)
    assert set(got) == brute(rows, k)


def test_one_large_family(spark):
    rows = [(i, t) for i, (_, t) in enumerate(families(4, base=1, most=1) * 40)]
    draw = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    for i in range(300):
        copy = list(base)
        for _ in range(draw.randint(0, 12)):
            copy[draw.randrange(100)] = f"x{draw.randrange(50)}"
        rows.append((1000 + i, " ".join(copy)))
    assert set(run(spark, rows, shingle=2)) == brute(rows, 2)


def test_repeated_and_missing_ids(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    got = sorted(run(spark, [(3, b), (5, a), (5, b), (5, a), (7, a), (None, a), (9, c), (8, None)],
                     shingle=2), key=repr)
    assert got == sorted([(3, 6, 3, True), (5, 6, 3, False), (5, 6, 3, False), (5, 6, 3, False),
                          (7, 6, 3, False), (None, 6, None, True), (9, 6, 9, True), (8, 0, 8, True)], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0


def test_collections_estimate_similarity():
    draw = np.random.default_rng(3)
    agree = []
    for _ in range(100):
        both = draw.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both[:800], own])) for own in
                (both[800:], draw.integers(0, 1 << 63, 100, dtype=np.uint64)))
        agree.append((minhash.collections(a) == minhash.collections(b)).mean())
    assert abs(np.mean(agree) - 0.8 ** minhash.EACH) < 0.05


def test_block_links_match_pairs():
    draw = random.Random(4)
    sets = [np.unique(np.array(draw.choices(range(40), k=30), np.uint64)) for _ in range(60)]
    got = minhash.block_links(list(range(30)), sets[:30], list(range(30, 60)), sets[30:], 60)
    parent = list(range(60))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(30):
        for j in range(30, 60):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= 60 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert set(got) == {(i, find(i)) for i in range(60) if find(i) != i}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 7), (1, 2), (2, 1)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Staging(spark, "g"), "c")
    got = {r.node: r.component for r in found.collect()}
    assert got == ({i: 100 for i in range(100, 161)} | {i: 3 for i in (3, *range(7, 60))} | {1: 1, 2: 1})
    none = connected_components(spark.createDataFrame([], "a long, b long"), Staging(spark, "g"), "c")
    assert none.count() == 0


def test_shingles_are_hashes_of_words():
    s = minhash.Shingler(2)
    assert len(s("A b\x0ba B A b")) == 2 and (s("A b") == s("a\tB ")).all()
    assert len(s("x")) == 1 and s("x")[0] != s("x x")[0]
    assert xxhash.xxh64_intdigest(b"a") == s.words[b"a"]


def test_no_link_is_lost_on_the_tables(spark):
    import pandas as pd
    from worksrisk.llm import queries
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in queries.op4_near_duplicates(spark, sf).collect()}
    assert got == brute(list(zip(docs.doc_id, docs.text)), 2)
