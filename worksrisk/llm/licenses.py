"""License scan by ordered signature rules, in DataFrame functions only.

Hundreds of patterns are gated twice: a text without any root word is done at once, and each
remaining pattern is tried only if its keyword is in the text. Detections carry their place;
one that lies inside another of higher priority, or of the same priority but longer, is
suppressed. All of it happens row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksrisk.llm.fingerprints import let
from worksrisk.llm.license_rules import CONFIDENCE, ROOTS, SIGNS, Rule, rules

_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"   # what words are not made of, A-Z being lowered
WORD = rf"[^{_GAP}]+"
#: Base labels and their phrases.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
_HIT = "array<struct<start:int,upto:int,priority:int,rule:int,label:string,text:string>>"


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def _phrase(words: str) -> str:
    return rf"(?i)(?<![^{_GAP}])" + rf"[{_GAP}]+".join(words.split()) + rf"(?![^{_GAP}])"


def _base(text: Column, gate: Column) -> Column:
    """Struct of number, first and last place and labels of the base phrases."""
    pattern = F.lit("|".join(_phrase(p) for p in BASE.values()))
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("first"),
                    F.lit(None).cast("long").alias("last"),
                    F.array().cast("array<string>").alias("labels"))

    def starting(phrase: str):
        return lambda x: x.rlike("^" + _phrase(phrase))

    def places(found: Column) -> Column:
        def read(between: Column) -> Column:
            n = F.size(found)
            words = F.aggregate(F.slice(between, 1, n), F.lit(0), lambda a, x: a + _words(x))
            inside = F.aggregate(F.slice(found, 1, n - 1), F.lit(0), lambda a, x: a + _words(x))
            labels = F.filter(F.array(*[
                F.when(F.exists(found, starting(phrase)), F.lit(label))
                for label, phrase in BASE.items()]), lambda x: x.isNotNull())
            return F.struct(n.alias("n"), _words(between[0]).cast("long").alias("first"),
                            (words + inside).cast("long").alias("last"), labels.alias("labels"))
        return F.when(F.size(found) == 0, none).otherwise(
            let(F.split(text, pattern, -1), read))

    return F.when(gate, let(F.regexp_extract_all(text, pattern, F.lit(0)), places)).otherwise(none)


def _find(text: Column, rule: Column) -> Column:
    """All places of one rule's pattern: between the pieces that it splits the text into."""
    def places(found: Column, pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_HIT).alias("hits"))

        def step(done: Column, i: Column) -> Column:
            begin = done["at"] + F.char_length(F.get(pieces, i))
            end = begin + F.char_length(F.get(found, i))
            hit = F.struct(begin.alias("start"), end.alias("upto"),
                           rule["priority"].alias("priority"), rule["rule"].alias("rule"),
                           rule["label"].alias("label"), F.get(found, i).alias("text"))
            return F.struct(end.alias("at"), F.array_append(done["hits"], hit).alias("hits"))

        return F.when(F.size(found) == 0, F.array().cast(_HIT)).otherwise(F.aggregate(
            F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda done: done["hits"]))

    pattern = rule["pattern"]
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: let(
        F.when(F.size(found) > 0, F.split(text, pattern, -1)), lambda p: places(found, p)))


def _suppress(hits: Column) -> Column:
    """Drop what lies inside an earlier rule's detection of at least the same priority.

    In order of start, then longest first, whatever holds a detection comes before it, so
    one running maximum of ends for each priority (and those above) is enough.
    """
    order = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), (-h["upto"]).alias("_a"), (-h["priority"]).alias("_b"),
        h["rule"].alias("rule"), h.alias("hit"))))
    top = max(CONFIDENCE)
    start = F.struct(F.array(*[F.lit(-1)] * top).alias("ends"), F.array().cast(_HIT).alias("kept"))

    def step(done: Column, item: Column) -> Column:
        hit = item["hit"]
        return F.struct(
            F.transform(done["ends"], lambda e, i: F.when(
                i < hit["priority"], F.greatest(e, hit["upto"])).otherwise(e)).alias("ends"),
            F.when(F.get(done["ends"], hit["priority"] - 1) >= hit["upto"], done["kept"])
            .otherwise(F.array_append(done["kept"], hit)).alias("kept"))

    return F.aggregate(order, start, step, lambda done: done["kept"])


def detections(text: Column, lowered: Column, signatures: list[Rule]) -> Column:
    """Array of (start, upto, priority, rule, label, text) that are not suppressed, by place."""
    table = F.array(*[F.struct(
        F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
        F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"),
        F.lit(i).alias("rule")) for i, r in enumerate(signatures)])
    plain = F.regexp_replace(lowered, SIGNS + "+", " ")
    tried = let(plain, lambda t: F.filter(table, lambda r: F.contains(t, r["keyword"])))
    return let(F.flatten(F.transform(tried, lambda r: _find(text, r))), lambda hits: F.when(
        F.size(hits) > 0, _suppress(hits)).otherwise(F.array().cast(_HIT)))


def scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found``.

    One row per input row, repeated or not; only ``doc_id`` and ``text`` are read. Null texts
    count as empty: no words, no places, empty label strings, score 0. ``found`` lists the
    detections that are left, with their places in code points. ``score`` is 1 less the
    product, over labels, of 1 less the confidence of the label's best detection.
    """
    signatures = rules() if signatures is None else signatures
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    lowered = F.lower("text")
    gate = F.lit(False)
    for root in ROOTS:
        gate = gate | F.contains(lowered, F.lit(root))
    rows = rows.select(
        "doc_id", _words(F.col("text")).cast("long").alias("n_words"),
        _base(F.col("text"), F.contains(lowered, F.lit("licen"))).alias("_base"),
        F.when(gate, detections(F.col("text"), lowered, signatures)).otherwise(
            F.array().cast(_HIT)).alias("found"))
    base = F.col("_base")["labels"]
    labels = F.array_sort(F.array_union(base, F.transform("found", lambda h: h["label"])))
    sure = F.array(*[F.lit(CONFIDENCE[i]) for i in sorted(CONFIDENCE)])
    best = lambda label: F.greatest(
        F.when(F.array_contains(base, label), F.lit(CONFIDENCE[2])).otherwise(F.lit(0.0)),
        F.coalesce(F.array_max(F.transform(
            F.filter("found", lambda h: h["label"] == label),
            lambda h: F.get(sure, h["priority"] - 1))), F.lit(0.0)))
    return (rows.withColumn("_labels", labels).select(
        "doc_id", "n_words", F.col("_base")["n"].cast("long").alias("n_base"),
        F.col("_base")["first"].alias("first_word"), F.col("_base")["last"].alias("last_word"),
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"),
        F.concat_ws(",", "_labels").alias("labels"),
        (F.lit(1.0) - F.aggregate("_labels", F.lit(1.0), lambda a, label: a * (
            F.lit(1.0) - best(label)))).alias("score"), "found"))
