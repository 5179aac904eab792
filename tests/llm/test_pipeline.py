import hashlib
from collections import Counter

import pandas as pd
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.test_minhash import brute
from worksrisk.llm import byte_bpe, mixing


def test_stages_match_brute_force(spark, sf):
    """Each stage against its own input: scores by the operator, all else by plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for _, function in corpus_pipeline.STAGES:
        frames.append(function(spark, frames[-1], sf).cache())
    clean, unique, mixed, encoded = frames[1:]
    for frame in frames[1:4]:
        assert frame.schema.names == docs.schema.names
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").toxic
    kept = clean.toPandas()
    known = labels[labels == 0].index
    assert 0.95 * len(known) <= kept.doc_id.isin(known).sum() and len(kept) < docs.count()

    want = {d for d, _, _, stays in brute(list(zip(kept.doc_id, kept.text)), 5) if stays}
    alone = unique.toPandas()
    assert set(alone.doc_id) == want and len(alone) == len(want)

    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(unique).collect() if r.size}
    rows = mixed.toPandas()
    assert Counter(rows.doc_id) == {d: n for d, n in taken.items() if n}
    texts = alone.set_index("doc_id").text
    assert all(t == texts[d] for d, t in zip(rows.doc_id, rows.text))

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks=byte_bpe.load(
        P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks)
    out = encoded.collect()
    assert Counter(r.doc_id for r in out) == Counter(rows.doc_id)
    for r in out:
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_repeatable_and_keeps_odd_columns(spark, sf):
    a, b = (Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect())
            for _ in range(2))
    assert a == b and sum(a.values()) > 0


def test_stages_take_empty_and_odd_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None, 1, "x", 2), (1, "", "en", None, 0, 2, "y", 3),
                                 (2, "some plain words here", "en", "s", 21, 3, "z", 4)],
                                docs.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
                                + ", size int, rep string, score int")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, odd.limit(0), sf).count() == 0
    for name, function in corpus_pipeline.STAGES[:3]:
        got = function(spark, odd, sf)
        assert got.columns == odd.columns
        assert 2 in [r.doc_id for r in got.collect()] or name == "mix"
