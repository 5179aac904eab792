"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed in k-grams. Of every window of ``w`` neighbouring hashes the smallest is
kept, the rightmost one of equals, with its position. Any run of ``w + k - 1`` words that two
texts share therefore leaves at least one hash in common.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 3, 4
#: Letters, marks and digits make words; characters of scripts without spaces stand alone.
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
WORD = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_ALONE}]]+|[{_ALONE}]"
LOW = (1 << 31) - 1
FIRST_ID = -(1 << 63)   # where rows without an id stand in order


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Array of longs, each a 32-bit hash and its position, in order of position.

    The upper 32 of 63 bits are the hash; the lower 31 are 2^31 - 1 less the index of the
    k-gram's first word, so that the least number of a window is its smallest hash and, of
    equal ones, the rightmost. Null and texts without words give an empty array. Fewer than
    ``gram`` words give one hash of them all, fewer than ``window`` hashes one window.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def grams(w: Column) -> Column:
        def one(i: Column) -> Column:
            hashed = F.xxhash64(*[F.get(w, i + j) for j in range(gram)])
            return (F.shiftleft(hashed.bitwiseAND(F.lit((1 << 32) - 1)), 31)
                    .bitwiseOR(F.lit(LOW).cast("long") - i))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - gram, F.lit(0))), one)

    def kept(h: Column) -> Column:
        least = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(h) - window, F.lit(0))),
            lambda i: F.least(*[F.get(h, i + j) for j in range(window)]))
        return F.array_distinct(least)

    return let(words, lambda w: F.when(F.size(w) > 0, let(grams(w), kept)).otherwise(
        F.array().cast("array<bigint>")))


def hashes(marks: Column) -> Column:
    """Distinct hashes of :func:`winnow`'s array, as ints (the hash less 2^31)."""
    return F.array_distinct(F.transform(
        marks, lambda m: (F.shiftright(m, 31) - (1 << 31)).cast("int")))


def positions(marks: Column) -> Column:
    """Word index of each kept k-gram of :func:`winnow`'s array."""
    return F.transform(marks, lambda m: (F.lit(LOW) - m.bitwiseAND(F.lit(LOW))).cast("int"))


def digest(marks: Column) -> Column:
    """128 bits in hex over all hashes and positions; empty for no words."""
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(n), marks)), 16, "0") for n in (1, 2)]
    return F.when(F.size(marks) > 0, F.lower(F.concat(*halves))).otherwise(F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes by all hashes of two :func:`hashes` arrays; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, hash, position`` of every kept k-gram of every row, for joins on the hash."""
    marks = docs.select("doc_id", F.explode(winnow(F.col("text"))).alias("_mark"))
    return marks.select("doc_id", (F.shiftright("_mark", 31) - (1 << 31)).cast("int").alias("hash"),
                        (F.lit(LOW) - F.col("_mark").bitwiseAND(F.lit(LOW))).cast("int")
                        .alias("position"))


def _bucket(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most the value, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    known = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(known, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame],
              carried: list[str]) -> DataFrame:
    """Rows of ``derive(docs)`` with ``next_<column>`` of the row that follows in descending doc_id.

    The last row gets the first one's. ``derive`` adds or replaces columns row by row; it keeps
    ``doc_id``, ``text`` and those whose names begin with ``_``.

    Rows are cut into ranges of doc_id, as many as two for each shuffle partition, and put in
    order range by range, so the rows are shuffled once. The first row of each range is also
    sent to the range that it follows. Equal ids go by descending text; null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select("_id").approxQuantile(
        "_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    bounds = sorted({min(int(c), -1 - FIRST_ID) for c in cuts})
    rows = rows.withColumn("_range", _bucket(bounds, F.col("_id")))
    # one row per range: the driver holds at most as many as there are ranges
    heads = sorted((r["_range"], r["head"]) for r in
                   rows.groupBy("_range").agg(F.max("_id").alias("head")).collect())
    into = [heads[(i + 1) % len(heads)][0] for i in range(len(heads))]
    copies = spark.createDataFrame(
        [(head, to) for (_, head), to in zip(heads, into)], "_id long, _to int")
    copied = (rows.join(F.broadcast(copies), "_id").withColumn("_range", F.col("_to")).drop("_to")
              .withColumn("_copy", F.lit(True)))
    order = Window.partitionBy("_range").orderBy("_copy", F.desc("_id"), F.desc("text"))
    # copies are few: what is derived is worked out after they have been chosen
    ordered = derive(rows.withColumn("_copy", F.lit(False)).unionByName(copied)).withColumns(
        {f"next_{c}": F.lead(c).over(order) for c in carried})
    return ordered.filter(~F.col("_copy")).drop("_id", "_range", "_copy")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, and its edit, and compare both and the next text.

    The edit replaces the last third of the code points (rounded down) by as many of the
    start of the next document in descending doc_id. ``docs`` needs ``doc_id`` and ``text``;
    other columns are not read. Null texts count as empty. One output row per input row:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_marks``. A single row is its own next.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    def marked(rows: DataFrame) -> DataFrame:
        marks = rows.withColumn("_marks", winnow(F.col("text")))
        return marks.withColumns({
            "fingerprint": digest(F.col("_marks")), "n_marks": F.size("_marks"),
            "hashes": hashes(F.col("_marks"))}).drop("_marks")

    both = with_next(docs.select("doc_id", text.alias("text")), marked, ["text", "hashes"])
    length = F.char_length("text")
    third = F.floor(length / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), length - third),
                      F.substr("next_text", F.lit(1), third))
    both = (both.select("doc_id", "fingerprint", "n_marks", "hashes",
                        length.cast("long").alias("n_chars"), edited.alias("_edited"),
                        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
            .withColumn("_marks", winnow(F.col("_edited"))))
    return both.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint",
        digest(F.col("_marks")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes(F.col("_marks"))).alias("near_edited"), "near_next",
        "n_marks")
