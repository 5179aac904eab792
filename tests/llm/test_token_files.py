import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.test_byte_bpe import texts
from worksrisk.llm import simple8b, token_files
from worksrisk.session import Staging

PATH = P.path("byte_bpe_50k.json")


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**63)), max_size=400))
def test_simple8b_round_trip(numbers):
    values = np.array(numbers, np.uint64)
    words, at, escaped = simple8b.encode(values)
    assert (simple8b.decode(words, len(values), at, escaped) == values).all()
    assert len(words) <= max(1, len(values))


def test_simple8b_packs_like_the_greedy_rule():
    draw = random.Random(2)
    values = [draw.choice([0, 1, 3, 200, 5000, 50_000]) for _ in range(3000)]
    words, _, _ = simple8b.encode(np.array(values, np.uint64))
    place = n = 0
    while place < len(values):
        place += next(c for c, b in zip(simple8b.COUNTS, simple8b.BITS)
                      if all(v < 1 << b for v in values[place:place + c]))
        n += 1
    assert len(words) == n
    assert len(simple8b.encode(np.zeros(600, np.uint64))[0]) == 10


def test_encoder_gives_the_library_s_ids():
    own, library = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    assert own.plain
    some = texts(800, 11) + ["", " ", "x" * 3000, "日本語" * 200 + " a"]
    for text, ids in zip(some, own.encode(some)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def expected(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_match_the_library(spark, monkeypatch):
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts(101, 4))]
    rows += [(500, None), (501, ""), (None, "no id"), (502, "long text " * 30_000), (7, rows[0][1]), (7, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    manifest = token_files.write_tokens(docs, PATH, Staging(spark, "t"))
    got = token_files.read_tokens(manifest).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)


def test_blocks_and_broken_files():
    ids = [np.array([1, 70_000, 2], np.uint32), np.array([2], np.uint32)]
    doc_ids, back = token_files.read_block(token_files.block_bytes([4, None], ids))
    assert doc_ids == [4, None] and [b.tolist() for b in back] == [[1, 70_000, 2], [2]]
    import io

    import pyarrow as pa
    with pytest.raises(ValueError):
        token_files.read_offsets(pa.PythonFile(io.BytesIO(b"x" * 40), mode="r"))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_tokens(token_files.write_tokens(docs, PATH, Staging(spark, "t"))).count() == 0


def test_query_against_the_library(spark, sf):
    from worksrisk.llm import queries
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, queries.op3_token_files(spark, sf).collect()), key=lambda r: r[1])
    assert got == expected(list(zip(docs.doc_id, docs.text)))


def test_plain_pieces_are_the_pre_tokeniser_s_matches():
    """Every piece that is cut without the library is cut as the library would."""
    encoder = token_files.Encoder(P.path("byte_bpe_50k.json"))
    split = encoder.tokenizer.pre_tokenizer.pre_tokenize_str
    for rest in ["word", "word,", "one.\ntwo", "é!!", "ab***\nÀcd,", "x\ny\nz."]:
        found = token_files.plain_matches(rest)
        wanted = [(" " + rest)[a:b] for _, (a, b) in split(" " + rest)]
        assert found == wanted, rest
    for rest in ["", "a1", "don't", "a\n", "\na", "a\n\nb", "a\tb", "日本", ".", "a-b", "a.b"]:
        assert token_files.plain_matches(rest) is None, rest


def test_new_words_are_encoded_several_at_a_time(monkeypatch):
    """Words that share a text of the library get the ids they have alone."""
    own, library = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    some = ["".join(random.Random(i).choices("abcdeéñwüя", k=3 + i % 9)) for i in range(400)]
    text = "\n".join(" ".join(some[i:i + 7]) for i in range(0, 400, 7)) + " last, 日本 x1"
    asked, plain = [], own._ids

    def counted(texts):
        asked.extend(texts)
        return plain(texts)

    monkeypatch.setattr(own, "_ids", counted)
    wanted = library.encode(text, add_special_tokens=False).ids
    assert own.encode([text])[0].tolist() == wanted
    assert len(asked) < 60
    own = token_files.Encoder(PATH)
    own.bytes_of[:] += 1     # lengths that tell nothing: words go to the library one by one
    assert own.encode([text])[0].tolist() == wanted


def test_texts_are_worked_on_some_characters_at_a_time(monkeypatch):
    some = texts(60, 5)
    whole = token_files.Encoder(PATH).encode(some)
    monkeypatch.setattr(token_files, "CHARACTERS", 50)
    for a, b in zip(whole, token_files.Encoder(PATH).encode(some), strict=True):
        assert a.tolist() == b.tolist()
    assert token_files.Encoder(PATH).encode([]) == []
