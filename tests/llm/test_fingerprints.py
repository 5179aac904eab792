import hashlib

import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from worksrisk.llm import fingerprints as fp

WORD = regex.compile(fp.WORD.replace("Is", "").replace("&&[^", "--[").replace("]]+", "]]+"),
                     regex.V1)


def brute_marks(text, k=fp.GRAM, w=fp.WINDOW):
    words = WORD.findall((text or "").lower())
    if not words:
        return []
    grams = []
    for i in range(max(len(words) - k, 0) + 1):
        h = 42
        for word in words[i:i + k]:
            h = xxhash.xxh64_intdigest(word.encode(), h)
        grams.append(h & 0xFFFFFFFF)
    kept = []
    for i in range(max(len(grams) - w, 0) + 1):
        part = list(enumerate(grams[i:i + w], i))
        best = min(part, key=lambda p: (p[1], -p[0]))
        if best not in kept:
            kept.append(best)
    return kept


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """rows: (doc_id, text); ids distinct or null."""
    order = sorted(((d, t or "") for d, t in rows),
                   key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = {}
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        marks = brute_marks(text)
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(),
                       jaccard(marks, brute_marks(edited)), jaccard(marks, brute_marks(after)))
    return out


TEXTS = ["", None, "one", "one two", "One two THREE four five six seven eight nine",
         "a a a a a a a a a a a a a a a", "école à Béziers", "हिन्दी में लिखा हुआ काम", "今日は良い天気です",
         "... !!! ---", "x" * 5000, "very long " * 8000]


def test_marks_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = docs.select("id", fp.winnow(F.col("text")).alias("m")).select(
        "id", fp.positions(F.col("m")).alias("p"), fp.hashes(F.col("m")).alias("h")).collect()
    for row in got:
        want = brute_marks(TEXTS[row["id"]])
        assert list(row["p"]) == [p for p, _ in want]
        assert set(row["h"]) == {h - (1 << 31) for _, h in want}


def test_shared_runs_leave_a_shared_hash(spark):
    run = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(1, f"some start words here {run} and an end"),
                                  (2, f"another {run} tail of words")], "doc_id long, text string")
    marks = fp.fingerprints(docs)
    both = marks.groupBy("hash").agg(F.countDistinct("doc_id").alias("n")).filter("n = 2")
    assert both.count() >= 1


@pytest.mark.parametrize("rows", [
    list(enumerate(TEXTS)), [(5, "only one document here, its own next")],
    [(7 * i, f"document number {i} of some words {i % 3}" * (i % 5)) for i in range(300)] + [(None, "no id")],
])
def test_edits_match_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, next_text string")
    want = expected(rows)
    got = fp.compare_with_edits(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        n, sha, near, after = want[row.doc_id]
        assert (row.n_chars, row.edited_sha256) == (n, sha)
        assert row.near_edited == pytest.approx(near) and row.near_next == pytest.approx(after)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (2, "other")],
                                 "doc_id long, text string")
    rows = fp.compare_with_edits(docs).collect()
    assert len(rows) == 3
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert fp.compare_with_edits(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    from worksrisk.llm import queries
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = expected(list(zip(docs.doc_id, docs.text)))
    got = queries.op1_winnowing(spark, sf).collect()
    assert len(got) == len(docs)
    for row in got:
        n, sha, near, after = want[row.doc_id]
        assert (row.n_chars, row.edited_sha256) == (n, sha)
        assert row.near_edited == pytest.approx(near) and row.near_next == pytest.approx(after)
    frame = pd.DataFrame([r.asDict() for r in got])
    assert (frame.near_edited > frame.near_next).mean() > 0.8
