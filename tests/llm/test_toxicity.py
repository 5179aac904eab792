import random
import zlib

import numpy as np
import pandas as pd
import pytest

from worksrisk.llm import queries, toxicity

P = toxicity.Params(bits=14, steps=120)
BAD = ["idiot", "moron", "loser"]


def made(n, seed=1):
    """Texts of invented words; every fourth has two insults among them."""
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghimnoprstu", k=draw.randint(2, 8))) for _ in range(150)]
    rows = []
    for i in range(n):
        text = draw.choices(words, k=draw.randint(10, 60))
        for bad in draw.sample(BAD, 2) if i % 4 == 0 else []:
            text.insert(draw.randint(0, len(text)), bad)
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return rows


def brute_features(text, params):
    text = " " + " ".join(text.lower().split()) + " "
    mask, found = (1 << 64) - 1, set()
    for n in params.orders:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i:i + n]:
                h = (h * 0x100000001B3 + ord(c)) & mask
            found.add((((h + n) * 0x9E3779B97F4A7C15) & mask) >> (64 - params.bits))
    return found


@pytest.mark.parametrize("text", ["", " ", "a", "Ab", "An  IDIOT\n and a 🙂 é", "x" * 500])
def test_features_match_brute_force(text):
    got = toxicity.features(text, P, toxicity._scratch(P))
    assert len(set(got.tolist())) == len(got)
    assert set(got.tolist()) == brute_features(text, P)


def test_fit_finds_the_insults():
    scratch = toxicity._scratch(P)
    rows = made(400)
    x = [toxicity.features(t, P, scratch) for _, t, _ in rows]
    y = np.array([b for _, _, b in rows])
    w = toxicity.fit(x[:300], y[:300], 0.25, P)
    z = np.array([w[i].sum() for i in x]) + w[-1]
    assert ((z > 0) == y)[300:].mean() > 0.95
    assert toxicity.fit(x[:3], np.array([0, 0, 0]), 0.0, P)[-1] < -1


def test_predict(spark):
    rows = made(400)
    docs = [(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "a loser", "x"),
                                                (3, rows[3][1], "x"), (902, "moron and loser " * 30_000, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame(
        [(i, b, 0) for i, _, b in rows] + [(4, None, 0), (None, 1, 0), (0, 1, 0)],
        "doc_id long, toxic int, quality int")
    got = toxicity.predict(frame, labels, P).toPandas()
    assert len(got) == len(docs)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    ids = got.doc_id.dropna().astype(int)
    assert (got.held_out[ids.index] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]).all()
    empty = got[got.doc_id.isin([900, 901])].score
    assert empty.nunique() == 1 and (empty < 0.5).all()
    truth = {i: b for i, _, b in rows}
    held = got[got.held_out & got.doc_id.isin(list(truth))]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.95
    assert got[got.doc_id == 902].predicted.item() == 1
    again = toxicity.predict(frame, labels, P).toPandas()
    assert sorted(again.score) == sorted(got.score)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = made(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    turned = [(i, 1 - b if zlib.crc32(str(i).encode()) % 4 == 2 else b) for i, _, b in rows]
    a, b = (toxicity.train(docs, spark.createDataFrame(l, "doc_id long, toxic int"), P)
            for l in ([(i, b) for i, _, b in rows], turned))
    assert (a == b).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.predict(docs, labels, P).collect()[0].predicted == 0
    assert toxicity.predict(docs.limit(0), labels, P).count() == 0


def test_reject_keeps_all_columns(spark):
    rows = made(300)
    docs = spark.createDataFrame([(i, t, i) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    kept = toxicity.reject_toxic(docs, docs, labels, P)
    assert kept.columns == docs.columns
    assert abs(kept.count() - 225) < 10 and kept.filter("score != doc_id").count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"))
    held = got[got.held_out]
    a, b = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = (a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()
    assert auc > 0.75
    assert held[held.toxic == 0].predicted.mean() < 0.1


def test_ratios_are_counted_over_all_labels(spark):
    """An insult that the fitted sample of ten rows a class need not hold still has its ratio."""
    rows, scratch = made(400), toxicity._scratch(P)
    frame = spark.createDataFrame([(t, b) for _, t, b in rows], "text string, toxic int").repartition(5)
    got = toxicity.corpus_ratios(frame, P)
    x = [toxicity.features(t, P, scratch) for _, t, _ in rows]
    y = [b for _, _, b in rows]
    n = [y.count(0), y.count(1)]
    for f in {*x[0].tolist(), *x[1].tolist(), 0}:
        c = [sum(f in set(ids.tolist()) for ids, b in zip(x, y) if b == k) for k in (0, 1)]
        ratio = np.log((c[1] + 1) / (n[1] + 2)) - np.log((c[0] + 1) / (n[0] + 2))
        wanted = ratio if sum(c) >= P.least_docs and abs(ratio) >= P.least_ratio else 0
        assert got[f] == pytest.approx(wanted)
    few = P._replace(sample=10)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.predict(docs, labels, few).collect()}
    order = sorted(found, key=found.get)
    assert sum(i % 4 == 0 for i in order[-80:]) > 70


def test_recall_of_held_out_rows(spark):
    """At the threshold, most toxic rows whose labels were not read are found."""
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).filter("held_out").toPandas().set_index("doc_id")
    labels = pd.read_parquet(f"{sf}/labels.parquet").dropna(subset=["toxic"]).set_index("doc_id")
    held = got.join(labels, how="inner")
    # almost a third of the toxic rows hold no insult that others hold too
    assert held[held.toxic == 1].predicted.mean() > 0.7
    assert held[held.toxic == 0].predicted.mean() < 0.05
