import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from worksrisk.operators import similarity, texts
from worksrisk.sources import star


@pytest.fixture(scope="module")
def cloud(spark):
    """Vectors where a third are copies of one, a third nearly so, and one is zero."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12))
    vectors = []
    for i in range(900):
        v = base[rng.integers(0, 300)]
        v = base[0] if i % 3 == 0 else base[1] + rng.normal(size=12) * 0.05 if i % 3 == 1 else v
        vectors.append([float(x) for x in np.float32(v)])
    vectors[5] = [0.0] * 12
    blocks = ["big" if i < 600 else f"b{i % 60}" for i in range(900)]
    blocks[2] = "alone"
    m = np.array(vectors)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    df = spark.createDataFrame(list(zip(range(900), blocks, vectors)),
                               "id long, block string, vec array<float>")
    return df, blocks, np.round(unit @ unit.T, 12)


def brute(blocks, sims, k):
    out = {}
    for i, b in enumerate(blocks):
        peers = [j for j, c in enumerate(blocks) if c == b and j != i]
        peers.sort(key=lambda j: (-sims[i, j], j))
        out[i] = [(j, round(float(sims[i, j]), 9)) for j in peers[:k]]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("k, parts, sizes", [
    (1, 3, {}), (1, 16, {"chunk": 50, "cell": 20}), (5, 1, {"chunk": 60, "cell": 150})])
def test_nearest_is_exact(cloud, k, parts, sizes):
    df, blocks, sims = cloud
    found = similarity.nearest(df.repartition(parts), k=k, **sizes)
    got = {}
    for r in found.orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append((r["nearest_id"], round(r["similarity"], 9)))
    assert got == brute(blocks, sims, k)


@pytest.mark.parametrize("k", [1, 5])
def test_small_cells_do_not_multiply_what_is_shuffled(spark, monkeypatch, k):
    rng = np.random.default_rng(4)
    m = np.float32(rng.normal(size=(400, 24)))
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "one", [float(x) for x in v]) for i, v in enumerate(m)],
                               "id long, block string, vec array<float>")
    sent, scan = [], similarity._scan

    def counted(candidates, queries, *rest, **more):
        sent.append(candidates.count() + queries.count())
        return scan(candidates, queries, *rest, **more)

    monkeypatch.setattr(similarity, "_scan", counted)
    found = similarity.nearest(df, k=k, chunk=1, cell=8)
    got = {}
    for r in found.orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append((r["nearest_id"], round(r["similarity"], 9)))
    assert got == brute(["one"] * 400, np.round(unit @ unit.T, 12), k)
    # placed, searched at home, asked for reach and searched abroad: a few rows for each vector
    assert sum(sent) <= 8 * 400


def test_a_task_holds_a_bounded_number_of_similarities(monkeypatch):
    monkeypatch.setattr(similarity, "MOST", 600)
    n, seen = 100, []
    side = pd.DataFrame({"unit": "u", "role": 0, "block": "b", "f1": range(n), "f2": range(n),
                         "vec": [np.eye(4)[i % 4] for i in range(n)], "ids": [[i] for i in range(n)]})

    def visit(held, asked, sims):
        seen.append(sims.shape)
        return np.arange(len(sims)), {"similarity": sims.max(axis=1)}

    out = pd.concat(similarity._stream(visit)(iter([pd.concat([side, side.assign(role=1)])])))
    assert len(out) == n and (out["similarity"] == 1).all()
    assert max(a * b for a, b in seen) <= 600


def test_many_queries_share_copies_of_a_unit(cloud, monkeypatch):
    df, blocks, sims = cloud
    monkeypatch.setattr(similarity, "QUERY_RUN", 40)
    found = similarity.nearest(df, k=1)
    assert {r["id"]: r["nearest_id"] for r in found.collect()} == {
        i: v[0][0] for i, v in brute(blocks, sims, 1).items()}


def works(spark, *rows):
    return spark.createDataFrame(
        list(rows), "Work_ID string, Vendor_Name string, Constituency string, embedding array<float>")


def test_duplicate_scores(spark):
    df = works(spark, ("a", "V", "c", [1.0, 0.0]), ("b", "V", "c", [1.0, 0.0]),
               ("alone", "W", "c", [1.0, 0.0]), ("x", " UNKNOWN ", "c", [1.0, 0.0]),
               ("y", " UNKNOWN ", "c", [1.0, 0.0]), ("z", None, "c", [1.0, 0.0]))
    got = {r["Work_ID"]: r for r in similarity.duplicate_scores(df).collect()}
    assert got["a"]["nearest_duplicate_work_id"] == "b" and got["b"]["duplicate_risk_score"] == 100
    assert got["a"]["nearest_similarity"] == pytest.approx(1)
    for k in ("alone", "x", "y", "z"):
        assert got[k]["duplicate_checked"] is False
        assert got[k]["duplicate_risk_score"] == 0 and got[k]["nearest_similarity"] == 0
    rate = similarity.flag_rate(similarity.duplicate_scores(df)).first()
    assert (rate["works"], rate["flagged"]) == (6, 2)


def test_new_work_against_its_block(spark):
    index = works(spark, ("a", "V", "c", [1.0, 0.0]), ("b", "V", "d", [0.0, 1.0]),
                  ("n", "V", "c", [0.6, 0.8])).toDF("work_id", "vendor_name", "constituency",
                                                    "embedding")
    asked = (works(spark, ("q", "V", "c", [0.0, 1.0]), ("r", "V", "e", [0.0, 1.0]),
                   ("s", "V", "c", [1.0, 0.1]))
             .withColumn("Work_Description", F.when(F.col("Work_ID") != "s", "text")))
    got = {r["Work_ID"]: r for r in similarity.new_work_duplicates(asked, index).collect()}
    assert got["q"]["nearest_duplicate_work_id"] == "n"
    assert got["q"]["nearest_similarity"] == pytest.approx(0.8, abs=1e-6)
    assert not got["r"]["duplicate_checked"] and not got["s"]["duplicate_checked"]


def test_nearby_falls_back_to_the_constituency(spark):
    places = spark.createDataFrame(
        [("a", "k1", "c1"), ("b", "k1", "c2"), ("c", None, "c1"), ("d", "k2", "c1")],
        "Work_ID string, Spatial_Cluster_ID string, Constituency string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [1.0, 0.1]),
                                     ("d", [0.0, 1.0])], "Work_ID string, embedding array<float>")
    got = similarity.nearby_works(places, places, vectors).orderBy("Work_ID", "position").collect()
    assert [(r["Work_ID"], r["nearest_id"]) for r in got] == [
        ("a", "b"), ("b", "a"), ("c", "a"), ("c", "d")]


@pytest.fixture(scope="module")
def bags(spark):
    """Sparse vectors: some common terms, many rare ones, copies, near copies and an empty one."""
    rng = np.random.default_rng(8)
    m = np.zeros((400, 600))
    for i in range(400):
        m[i, rng.integers(0, 20, 6)] += 1
        m[i, rng.integers(20, 600, 5)] += rng.integers(2, 6, 5)
        if i % 4 == 1:
            m[i] = m[i - 1]
            m[i, rng.integers(20, 600, i % 3)] += 1
    m[7] = 0
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    blocks = ["big" if i < 250 else f"b{i % 40}" for i in range(400)]
    rows = [(i, b, (np.flatnonzero(v).tolist(), v[v > 0].tolist())) for i, (b, v) in enumerate(zip(blocks, m))]
    df = spark.createDataFrame(
        rows, "id long, block string, vec struct<terms:array<bigint>,weights:array<double>>")
    return df, blocks, np.round(m @ m.T, 12)


@pytest.mark.parametrize("k, sizes", [(1, {}), (1, {"chunk": 30}), (4, {"chunk": 70})])
def test_sparse_search_is_exact(bags, k, sizes):
    df, blocks, sims = bags
    got = {}
    for r in similarity.nearest(df.repartition(5), k=k, **sizes).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append((r["nearest_id"], round(r["similarity"], 9)))
    assert got == brute(blocks, sims, k)


def test_units_of_words_are_bounded_by_their_terms(bags, monkeypatch):
    df, blocks, sims = bags
    sent, scan = [], similarity._scan

    def counted(candidates, queries, *rest, **more):
        sent.append((candidates.count(), queries.count()))
        return scan(candidates, queries, *rest, **more)

    monkeypatch.setattr(similarity, "_scan", counted)
    monkeypatch.setattr(similarity, "CHUNK", 10)   # no limit for words
    for terms, copies in ((10**6, 1), (400, 2)):
        monkeypatch.setattr(similarity, "POSTINGS", terms)
        got = {r["id"]: r["nearest_id"] for r in similarity.nearest(df).collect()}
        assert got == {i: v[0][0] for i, v in brute(blocks, sims, 1).items()}
        asked = sent[-1][1]
        assert asked <= 400 if copies == 1 else asked > 400
    monkeypatch.setattr(similarity, "POSTINGS", 10**6)
    monkeypatch.setattr(similarity, "SPARSE_RUNS", (8, 50))   # the work of a block is shared out
    got = {r["id"]: r["nearest_id"] for r in similarity.nearest(df).collect()}
    assert got == {i: v[0][0] for i, v in brute(blocks, sims, 1).items()}
    assert sent[-1][0] > 400 >= sent[-1][1]


def test_small_blocks_of_words_travel_once(bags, monkeypatch):
    """Blocks of one unit and one run are candidates and queries at a time; only others are sent as both."""
    df, blocks, sims = bags
    sent, scan = [], similarity._scan

    def counted(candidates, queries, *rest, **more):
        sent.append((candidates.count(), queries.count()))
        return scan(candidates, queries, *rest, **more)

    monkeypatch.setattr(similarity, "_scan", counted)
    wanted = {i: [(j, round(s, 9)) for j, s in v] for i, v in brute(blocks, sims, 3).items()}

    def found():
        got = {}
        for r in similarity.nearest(df.repartition(3), k=3).orderBy("id", "position").collect():
            got.setdefault(r["id"], []).append((r["nearest_id"], round(r["similarity"], 9)))
        return got

    assert found() == wanted and sent.pop() == (0, 0)
    monkeypatch.setattr(similarity, "SPARSE_RUNS", (8, 50))
    assert found() == wanted and sent.pop()[1] <= 250   # the large block alone
    monkeypatch.setattr(similarity, "CELLS", 0)         # no unit is held as a matrix
    assert found() == wanted


def test_whole_units_may_come_in_pieces(bags):
    """A unit is searched when its last row has come, however its rows are cut into batches."""
    df, blocks, sims = bags
    rows = df.filter("block = 'b0' or block = 'b1' or block = 'b39'").orderBy("block", "id").collect()
    table = pa.table({"unit": [r.block for r in rows], "block": [r.block for r in rows],
                      "f1": [r.id for r in rows], "f2": [r.id for r in rows],
                      "terms": pa.array([r.vec.terms for r in rows], pa.list_(pa.int64())),
                      "weights": pa.array([r.vec.weights for r in rows], pa.list_(pa.float64())),
                      "ids": [[r.id] for r in rows]})
    for size in (1, 2, 3, 100):
        out = pa.Table.from_batches(similarity._search_whole(3)(iter(table.to_batches(max_chunksize=size))))
        got = {}
        for r in out.to_pylist():
            got.setdefault(r["f1"], []).append((r["ids"][0], round(r["similarity"], 9)))
        for i, best in got.items():
            mates = [j for j in range(400) if blocks[j] == blocks[i]]
            wanted = sorted(mates, key=lambda j: (-sims[i, j], j))[:3]
            assert best == [(j, round(sims[i, j], 9)) for j in wanted]
        assert len(got) == len(rows)


def test_a_model_runs_once_for_an_index(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        def encode(told):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in told))
            return np.ones((len(told), 2), np.float32)
        return encode

    works = spark.createDataFrame([(f"w{i}", f"v{i % 3}", "c", f"text {i}") for i in range(50)],
                                  "Work_ID string, Vendor_Name string, Constituency string, text string")
    star.write_index(texts.Encoder("ones", load).vectors(works, "text"), str(tmp_path / "index"), "ones")
    with open(log) as f:
        assert sorted(f.read().split("\n")[:-1]) == sorted(f"text {i}" for i in range(50))


def test_light_terms_are_only_read_where_they_matter(bags):
    """Most candidates share no heavy term with a query and are not multiplied in full."""
    df, _, sims = bags
    rows = [r.vec for r in df.filter("block = 'big'").orderBy("id").collect()]
    held = similarity.Postings([(np.array(v.terms, np.int64), np.array(v.weights), np.array([len(v.terms)]))
                                for v in rows])
    full = []
    plain = held.products
    held.products = lambda chosen, *rest: (full.append(len(chosen)), plain(chosen, *rest))[1]
    for i, v in enumerate(rows):
        best, near = held.nearest(np.array(v.terms, np.int64), np.array(v.weights), 2)
        wanted = sorted(range(250), key=lambda j: (-sims[i, j], j))[:2]
        assert best.tolist() == wanted and near == pytest.approx([sims[i, j] for j in wanted])
    assert len(full) > 100 and np.mean(full) < 15


def test_text_vectors_find_copies(spark):
    df = spark.createDataFrame([("a", "new road to the school"), ("b", "new road to the school"),
                                ("c", "street lights"), ("d", None)], "Work_ID string, t string")
    got = texts.fit_words(df, "t").vectors(df, "t").select(
        F.col("Work_ID").alias("id"), F.lit("x").alias("block"), F.col("embedding").alias("vec"))
    best = {r["id"]: r for r in similarity.nearest(got).collect()}
    assert best["a"]["nearest_id"] == "b" and best["a"]["similarity"] == pytest.approx(1, abs=1e-5)


def test_texts_of_every_script_are_compared(spark):
    told = {"a": "सड़क का निर्माण गाँव तक", "b": "सड़क का निर्माण गाँव तक", "c": "विद्यालय भवन की मरम्मत",
             "d": "école à Béziers", "e": "école à Béziers", "f": "pont sur la rivière", "g": "", "h": " -- ", "i": None}
    works = spark.createDataFrame([(k, "V", "P", t) for k, t in told.items()],
                                  "Work_ID string, Vendor_Name string, Constituency string, text string")
    model = texts.fit_words(works, "text")
    got = {r["Work_ID"]: r for r in similarity.duplicate_scores(model.vectors(works, "text")).collect()}
    for a, b in ("ab", "de"):
        assert got[a]["nearest_duplicate_work_id"] == b and got[a]["nearest_similarity"] == pytest.approx(1.0)
        assert got[a]["duplicate_risk_score"] == 100
    assert got["c"]["nearest_similarity"] < 0.5 and got["f"]["nearest_similarity"] < 0.5
    assert not any(got[k]["duplicate_checked"] for k in "ghi")


def test_words_never_share_a_slot_and_keep_their_weights(spark, tmp_path):
    """Weights and lengths by hand; unknown words take length and match nothing."""
    df = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "a"), (4, None), (5, "--")], "id long, t string")
    model = texts.fit_words(df, "t")
    assert model.documents == 5
    model.save(str(tmp_path / "w"))
    again = texts.WordModel.load(spark, str(tmp_path / "w"))
    assert again.name == model.name
    term = {r.word: r.term for r in model.vocabulary.collect()}
    idf = {"a": np.log(6 / 4), "b": np.log(6 / 2), "c": np.log(6 / 2), "new": np.log(6)}
    got = {r.id: r.embedding for r in again.vectors(df, "t").collect()}
    assert got[4] is None and got[5] is None
    for i, counts in {1: {"a": 1, "b": 1}, 2: {"a": 2, "c": 1}, 3: {"a": 1}}.items():
        length = np.sqrt(sum((n * idf[w]) ** 2 for w, n in counts.items()))
        wanted = sorted((term[w], n * idf[w] / length) for w, n in counts.items())
        assert list(got[i].terms) == [t for t, _ in wanted]
        assert list(got[i].weights) == pytest.approx([w for _, w in wanted])
    asked = again.vectors(spark.createDataFrame([(1, "B new"), (2, "new new")], "id long, t string"), "t")
    got = {r.id: r.embedding for r in asked.collect()}
    assert list(got[1].weights) == pytest.approx([idf["b"] / np.hypot(idf["b"], idf["new"])])
    assert list(got[2].terms) == []
    other = texts.fit_words(df.limit(3), "t")
    assert other.name != model.name


def test_a_callers_model_serves_index_and_requests(spark, tmp_path):
    def letters():
        """Loaded once in a worker: counts of a few letters."""
        return lambda told: np.array([[t.count(c) + 0.5 for c in "aeo"] for t in told], np.float32)

    encoder = texts.Encoder("letters 1", letters)
    df = spark.createDataFrame(
        [("w1", "V", "c", "aaa e"), ("w2", "V", "c", "oo e"), ("w3", "V", "c", ""), ("w4", "V", "c", None)],
        "Work_ID string, Vendor_Name string, Constituency string, Work_Description string")
    vectors = encoder.vectors(df, "Work_Description")
    assert {r.Work_ID: r.embedding and list(r.embedding) for r in vectors.collect()} == {
        "w1": [3.5, 1.5, 0.5], "w2": [0.5, 1.5, 2.5], "w3": None, "w4": None}
    path = str(tmp_path / "index")
    star.write_index(vectors, path, encoder.name)
    index = star.read_index(spark, path, "letters 1")
    asked = encoder.vectors(spark.createDataFrame(
        [("n1", "V", "c", "ooooo ee")], df.schema), "Work_Description")
    assert similarity.new_work_duplicates(asked, index).first()["nearest_duplicate_work_id"] == "w2"
    with pytest.raises(ValueError, match="letters 1"):
        star.read_index(spark, path, "letters 2")


def test_word_vectors_are_stored_with_their_model(spark, tmp_path):
    df = spark.createDataFrame([("a", "V", "c", "new road"), ("b", "V", "c", "old bridge")],
                               "Work_ID string, Vendor_Name string, Constituency string, t string")
    model = texts.fit_words(df, "t")
    star.write_index(model.vectors(df, "t"), str(tmp_path / "i"), model.name)
    index = star.read_index(spark, str(tmp_path / "i"), model.name)
    asked = model.vectors(spark.createDataFrame([("n", "V", "c", "a new road")], df.schema), "t")
    found = similarity.new_work_duplicates(asked.withColumnRenamed("t", "Work_Description"), index).first()
    known, unknown = 2 * np.log(3 / 2) ** 2, np.log(3) ** 2   # squared weights of the request's words
    assert found["nearest_duplicate_work_id"] == "a"
    assert found["nearest_similarity"] == pytest.approx(np.sqrt(known / (known + unknown)))


def test_vectors_by_a_held_vocabulary_need_no_shuffle_and_equal_the_joined_ones(spark, monkeypatch):
    df = spark.createDataFrame([(1, "road road  to A"), (2, "to a bridge"), (3, ""), (4, None), (5, "to"), (6, "\u0905\u093e to x9"),
                                (7, "unheard of"), (8, "to to")], "i int, t string")
    model = texts.fit_words(df.filter("i < 7"), "t")
    held = model.vectors(df, "t")
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(texts, "VOCABULARY", 1)
    joined = {r["i"]: r["embedding"] for r in model.vectors(df, "t").collect()}
    for row in held.collect():
        a, b = row["embedding"], joined[row["i"]]
        assert (a is None) == (b is None)
        if a is not None:
            assert a["terms"] == b["terms"] and a["weights"] == pytest.approx(b["weights"], rel=1e-12)
    assert joined[3] is None and joined[7]["terms"] == []
