import gzip
import hashlib
import io
import zlib

import pytest

from worksrisk.llm import files, queries, warc
from worksrisk.session import Staging


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        other = page_id is not None and len(data) >= 100 and page_id > first[html or ""]
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(),
                    "revisit" if other else "response", first[html or ""] if other else None))
    return out


ROWS = [(1, "http://a.b/c", "x" * 100), (2, "http://a.b/d", "x" * 100), (3, None, "x" * 99),
        (4, "http://a.b/ü\r\nWARC-Type: evil", "x" * 99), (5, "u", None), (6, "u", ""),
        (7, "u", "ü\r\n\r\nWARC/1.1\r\n\r\n" * 50), (9, "u", "ü\r\n\r\nWARC/1.1\r\n\r\n" * 50),
        (2, "http://a.b/d", "x" * 100), (1, "http://a.b/c", "x" * 100), (None, None, "x" * 100),
        (10, "u", "long " * 700_000), (11, "u", "long " * 700_000)]


def run(spark, rows):
    pages = spark.createDataFrame([(*r, "response") for r in rows],
                                  "page_id long, url string, html string, record_type string")
    stage = Staging(spark, "w")
    members = warc.normalise(warc.write_archives(pages, stage), stage)
    return members, warc.read_back(members)


def test_round_trip(spark):
    members, back = run(spark, ROWS)
    got = [tuple(r)[:5] for r in back.collect()]
    assert sorted(got, key=repr) == sorted(expected(ROWS), key=repr)
    total = 0
    for row in members.collect():
        with files.open_stream(row.file) as source:
            data = source.read()
        assert len(data) == row.bytes
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == row.n_records
        total += row.n_records
    assert total == len(ROWS)


def test_empty_table(spark):
    assert run(spark, [])[1].count() == 0


def archive(n):
    rows = [warc.record(i, f"http://h/{i}", b"p%d" % i * (i * 500), "d", None) for i in range(n)]
    return rows, zlib.compressobj(6, zlib.DEFLATED, 31)


@pytest.mark.parametrize("members", [False, True])
def test_normalised_members_hold_the_same_records(members):
    rows, whole = archive(40)
    data = b"".join(gzip.compress(r) for r in rows) if members else \
        b"".join(map(whole.compress, rows)) + whole.flush()
    sink, index = io.BytesIO(), io.BytesIO()
    n, size = warc.normalise_stream(io.BytesIO(data), sink, index)
    assert (n, size) == (40, len(sink.getvalue()))
    index.seek(0)
    entries = list(warc._index_lines(index))
    for row, entry in zip(rows, entries, strict=True):
        part = sink.getvalue()[entry["offset"]:entry["offset"] + entry["length"]]
        assert gzip.decompress(part) == row
        fields, block = warc.read_record(sink, entry["offset"], entry["length"])
        assert row.endswith(block + b"\r\n\r\n") and fields["Page-Id"] == entry["Page-Id"]


@pytest.mark.parametrize("cut", [1, 9, 200])
def test_cut_streams_are_reported(cut):
    rows, whole = archive(9)
    data = b"".join(map(whole.compress, rows)) + whole.flush()
    with pytest.raises(EOFError):
        warc.normalise_stream(io.BytesIO(data[:-cut]), io.BytesIO(), io.BytesIO())


def test_query_against_brute_force(spark, sf):
    import pandas as pd
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    got = [tuple(r) for r in queries.op2_warc(spark, sf).collect()]
    assert sorted(got) == sorted(expected(list(zip(pages.page_id, pages.url, pages.html))))
