import hashlib
import random

import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

from worksrisk.llm import byte_bpe
from worksrisk.llm.units import Remembered, units

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    bpe = byte_bpe.load(PATH, P.PATTERN)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks,
                             special_tokens={})


def texts(n, seed=3):
    draw = random.Random(seed)
    alphabet = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "\x1c", " ", "　", "'s",
                "'", ".", "9", "12", "é", "ß", "日本", "🙂", "<|endoftext|>", "A", "  \n "]
    return ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(n)]


def test_tree_gives_the_library_s_tokens(known):
    bpe = byte_bpe.load(PATH, P.PATTERN)
    for text in texts(1500):
        found = [i for u in units(text) for i in bpe.encode_unit(u)]
        assert found == known.encode_ordinary(text), repr(text)
        assert bpe.decode(tuple(found)) == text.encode()


def test_long_runs_are_joined_right(known):
    bpe = byte_bpe.load(PATH, P.PATTERN)
    draw = random.Random(5)
    for alphabet in ("ab", "a", "=-", "thein", "é日"):
        for n in (25, 49, 300, 3000):
            text = "".join(draw.choices(alphabet, k=n))
            assert list(bpe.encode_unit(text)) == known.encode_ordinary(text)


def test_join_of_any_two_encodings(known):
    bpe = byte_bpe.load(PATH, P.PATTERN)
    draw = random.Random(6)
    for _ in range(500):
        data = bytes(draw.choices(b"theansiongr ", k=draw.randint(2, 60)))
        at = draw.randint(0, len(data))
        joined = bpe.join(bpe.merge(data[:at]), bpe.merge(data[at:]))
        assert joined == bpe.merge(data)


def test_matches_of_the_tables_are_trees():
    """Most matches are joined from halves, and every join is checked against plain merging."""
    bpe, joined = byte_bpe.load(PATH, P.PATTERN), []
    plain = bpe.join

    def join(left, right):
        found = plain(left, right)
        joined.append(found)
        assert found == bpe.merge(bpe.decode(left) + bpe.decode(right))
        return found

    bpe.join = join
    matches = set()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].dropna()
    for text in docs[:60]:
        matches.update(bpe.matches(text))
    for match in matches:
        bpe.encode_bytes(match.encode())
    # tokens as they stand and the halves met before need none
    assert len(joined) > len(matches) / 2
    assert byte_bpe.up([b"a", b"b", b"c"]) == b"abc" and byte_bpe.up([]) == b""


def test_units_are_the_text_again():
    for text in texts(300, 8):
        assert "".join(units(text)) == text


def test_remembered_is_bounded():
    seen = Remembered(len, entries=3)
    for key in ("a", "bb", "ccc", "dddd", "x" * 1000):
        assert seen[key] == len(key)
        assert len(seen) <= 3


def test_documents(spark, known):
    rows = [(1, "Hello world", "clash"), (1, "Hello world", "clash"), (2, None, None), (None, "", ""),
            (3, "x " * 50_000, "long"), (4, "  \n a  b\n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, byte_bpe.encode_digests(docs, PATH, P.PATTERN).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        ids = known.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    whole = byte_bpe.encode_documents(docs, PATH, P.PATTERN).collect()
    assert all(list(r.ids) == known.encode_ordinary(bytes(r.decoded).decode()) for r in whole)
    assert byte_bpe.encode_digests(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_query_against_the_library(spark, sf, known):
    from worksrisk.llm import queries
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = queries.op7_byte_bpe(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = known.encode_ordinary(text or "")
        row = got.loc[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
