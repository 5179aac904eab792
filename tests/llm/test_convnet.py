import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksrisk.llm import convnet, queries
from worksrisk.llm.convnet import Net, Params

SMALL = Params(width=3, embed=2, filters=4, hop=8, sample=40, epochs=2, batch=8)
KIND = "doc_id long, text string, lang string, source string"


def some_net(params, seed=0):
    draw = np.random.default_rng(seed)
    return Net(*[draw.normal(size=s) for s in convnet.shapes(params)])


def plain_score(text, net, params):
    """The network written out window by window and chunk by chunk."""
    windows = []
    padded = text + bytes(params.width)
    for at in range(max(len(text), 1)):
        z = net.floor + sum(net.bytes_[padded[at + o]] @ net.filters[o] for o in range(params.width))
        windows.append(np.maximum(z, 0))
    hops = [np.max(windows[i:i + params.hop], axis=0) for i in range(0, len(windows), params.hop)]
    chunks = [np.maximum(a, b) for a, b in zip(hops, hops[1:])] or hops
    z = np.max(chunks, axis=0) @ net.most + np.mean(chunks, axis=0) @ net.mean + net.bias[0]
    return 1 / (1 + np.exp(-z))


TEXTS = [b"", b"a", b"ab\x00c", bytes(range(8)), bytes(range(9)), b"hello world, hello bytes" * 3,
         "zażółć gęślą jaźń ".encode() * 40, bytes(16), bytes(np.arange(4000) * 7 % 251 % 256)]


def test_scores_equal_the_plain_network():
    net = some_net(SMALL)
    found = convnet.scores(TEXTS, net, net.tables(), SMALL)
    assert found == pytest.approx([plain_score(t, net, SMALL) for t in TEXTS], rel=1e-4, abs=1e-7)


def test_a_score_does_not_depend_on_its_neighbours_or_blocks(monkeypatch):
    net = some_net(SMALL)
    together = convnet.scores(TEXTS, net, net.tables(), SMALL)
    alone = [convnet.scores([t], net, net.tables(), SMALL)[0] for t in TEXTS]
    monkeypatch.setattr(convnet, "BLOCK", 64)
    assert together.tolist() == alone == convnet.scores(TEXTS, net, net.tables(), SMALL).tolist()


def test_every_byte_counts_wherever_it_stands():
    """A filter that answers to one byte alone finds it at any place of a long text."""
    params = Params()
    net = Net(*[np.zeros(s) for s in convnet.shapes(params)])
    net.bytes_[ord("!"), 0], net.filters[0, 0, 0], net.most[0] = 1, 1, 5
    for at in (0, 1, 127, 128, 255, 256, 70_000, 99_999):
        text = bytearray(b"x" * 100_000)
        text[at] = ord("!")
        clean, found = convnet.scores([b"x" * 100_000, bytes(text)], net, net.tables(), params)
        assert clean == 0.5 and found > 0.99


def test_gradient_is_that_of_the_loss():
    net, target = some_net(SMALL, 3), np.array([1, 0, 1, 0, 1, 1, 0, 0, 1.0])
    weight = np.linspace(0.5, 1.5, len(TEXTS))
    grad, _ = convnet.gradient(TEXTS, target, weight, net, SMALL)
    draw = np.random.default_rng(1)
    for k, part in enumerate(net):
        for _ in range(6):
            at = tuple(draw.integers(s) for s in part.shape)
            moved = []
            for step in (1e-3, -1e-3):
                other = [a.copy() for a in net]
                other[k][at] += step
                moved.append(convnet.gradient(TEXTS, target, weight, Net(*other), SMALL)[1])
            assert grad[k][at] == pytest.approx((moved[0] - moved[1]) / 2e-3, rel=0.05, abs=2e-3)


def test_packing_keeps_the_network():
    net = some_net(SMALL)
    for a, b in zip(net, convnet.unpack(net.pack(), SMALL)):
        np.testing.assert_allclose(a, b, rtol=1e-6)


def test_long_texts_are_fitted_by_chunks_all_over_them():
    cut = convnet.fitted_text("a" * 1000 + "b" * 1000, 256, 16)
    assert len(cut) == 256 and cut.count(b"a") == cut.count(b"b") == 128
    assert convnet.fitted_text("é", 256, 16) == "é".encode() and convnet.fitted_text(None, 256, 16) == b""


def test_held_out_labels(spark):
    """Fitted on the rest, junk is told from prose on rows whose labels were not read."""
    sf = "/root/testdata/sf0.1"
    found = queries.op11_byte_convnet(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    auc = np.mean([(g > np.array(bad)).mean() for g in good])
    assert len(bad) > 50 and auc > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.99      # clean documents are kept
    assert np.mean([s < 0.3 for s in bad]) > 0.8         # and most junk is found


def _docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    rows = [(i, ("!!" if i % 3 else "fine words ") * 20, "en", "s") for i in range(60)]
    labels = [(i, int(i % 3 == 0), 0) for i in range(60)]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    other = [(i, 1 - q if i in held else q, 1) for i, q, _ in labels]
    first = {r.doc_id: r.score for r in convnet.predict(_docs(spark, rows), _labels(spark, labels), SMALL).collect()}
    moved = [(i, t, "xx", None) for i, t, _, _ in rows]
    again = {r.doc_id: r.score for r in convnet.predict(_docs(spark, moved), _labels(spark, other), SMALL).collect()}
    assert first == again and len(first) == 60


def test_odd_rows(spark):
    rows = [(1, "good", "en", "s"), (1, "good", "en", "s"), (None, "good", "en", "s"), (2, None, None, None),
            (3, "", "en", "s"), (4, "Ω" * 50_000, "en", "s"), (5, "!!!!", "en", "s")]
    labels = [(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0), (4, 0, 0), (5, 0, None), (99, 1, 0)]
    clash = _docs(spark, rows).withColumns({c: F.lit(7) for c in ("score", "held_out", "good", "quality", "_text")})
    found = convnet.predict(clash, _labels(spark, labels), SMALL).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[1][0] == by[1][1] == by[None][0] and by[2] == by[3]
    assert [r.held_out for r in found if r.doc_id is None] == [False]


def test_empty_tables_and_one_class(spark):
    assert convnet.predict(_docs(spark, []), _labels(spark, []), SMALL).collect() == []
    rows = [(i, f"text {i}", "en", "s") for i in range(8)]
    nothing = convnet.predict(_docs(spark, rows), _labels(spark, []), SMALL).collect()
    assert [r.score for r in nothing] == [0.5] * 8
    ones = convnet.predict(_docs(spark, rows), _labels(spark, [(i, 1, 0) for i in range(8)]), SMALL).collect()
    assert all(r.score > 0.5 and r.predicted == 1 for r in ones)
