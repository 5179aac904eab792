"""URL filter: hand-written rules first, then a path-template tree learned per host.

The tree has one level per path segment and is as deep as the paths. At each level a host's
segments whose labelled pages are judged alike become one wildcard, and so do segments that are
many, rare and too seldom labelled to tell; the others stay, so what a wildcard says comes
from several of its segments. A template is rejected if enough of its labelled pages are blocked. Everything is counting and
joining on (host, template): no task holds a host, and no list of templates is collected.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksrisk.session import Staging

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


class TreeParams(NamedTuple):
    many: int = 20             # a variable level has more children than this; its variable
    rare: float = 0.05         # children have less than this share each, and few labels
    least_labels: int = 5      # branches with fewer labelled pages are not compared or judged
    z: float = 1.96            # branches are alike if block rates differ by less (two shares)
    reject: float = 0.8        # smoothed share of blocked pages that rejects a template


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null and for texts without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equal ones the first), else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.host) + len(r.path)):
        fits = (((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}")))
                & F.startswith(path, F.lit(rule.path)))
        text = F.when(fits, F.lit(rule.host + rule.path)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """Array of a path's segments, each itself or the shape of a number, code or date.

    Empty ones at the end are left out.
    """
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)

    def shape(part: Column) -> Column:
        return (F.when(part.rlike(r"^\d+$"), F.lit("{n}"))
                .when(part.rlike(r"^\d+\.[A-Za-z]{1,5}$"),
                      F.concat(F.lit("{n}"), F.regexp_extract(part, r"(\.[A-Za-z]+)$", 1)))
                .when(part.rlike(r"^\d{4}-\d\d-\d\d$"), F.lit("{date}"))
                .when(part.rlike(r"^(?=.*\d)[0-9A-Fa-f-]{8,}$"), F.lit("{code}"))
                .when(F.char_length(part) > 60, F.lit("{long}")).otherwise(part))

    levels = F.transform(parts, shape)
    last = F.array_max(F.transform(levels, lambda x, i: F.when(x != "", i + 1).otherwise(F.lit(0))))
    return F.slice(levels, F.lit(1), F.coalesce(last, F.lit(0)))


def learn_templates(pages: DataFrame, stage: Staging, params: TreeParams = TreeParams()) -> DataFrame:
    """Templates from ``host, shape, label`` (``block``, ``allow`` or null).

    Gives one row per distinct ``host, shape`` with its ``template``, the template's labelled
    and blocked pages, and ``rejected``. The tree is as deep as its branches: a branch is left
    when no path in it goes on, or when it has one shape, which keeps its further segments.
    """
    bad = F.count(F.when(F.col("label") == "block", 1))
    shapes = stage.table("shapes", pages.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), bad.alias("bad"), F.count("label").alias("known"))
        .withColumn("template", F.lit("")))
    name, level = "segment", 0
    while True:
        shapes = shapes.withColumn(name, F.coalesce(F.get("shape", F.lit(level)), F.lit("")))
        child = shapes.groupBy("host", "template", name).agg(
            *[F.sum(c).alias(c) for c in ("n", "bad", "known")],
            F.count(F.lit(1)).alias("shapes"), F.max(F.size("shape")).alias("longest"))
        child = stage.table(f"children{level}", child)
        parent = child.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("p_children"), F.max("longest").alias("p_longest"),
            *[F.sum(c).alias(f"p_{c}") for c in ("n", "bad", "known", "shapes")])
        both = child.join(parent, ["host", "template"])
        # the block rate of this branch against that of all its siblings, by pooled shares
        rest = F.col("p_known") - F.col("known")
        pooled = F.col("p_bad") / F.col("p_known")
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("known") + 1 / rest))
        gap = F.abs(F.col("bad") / F.col("known") - (F.col("p_bad") - F.col("bad")) / rest)
        enough = (F.col("known") >= params.least_labels) & (rest >= params.least_labels)
        alike = F.when(enough, gap <= params.z * error).otherwise(F.lit(False))
        variable = ((F.col("p_children") > params.many) & (F.col("known") < params.least_labels)
                    & (F.col("n") < params.rare * F.col("p_n")))
        token = F.when(F.col(name) == "", F.lit("")).when(
            alike | variable, F.lit("*")).otherwise(F.col(name))
        goes_on = (F.col("p_shapes") > 1) & (F.col("p_longest") > level)
        node = both.select("host", "template", name, token.alias("_token"), goes_on.alias("open"))
        whole = F.aggregate(
            F.filter(F.slice("shape", level + 1, 1 << 30), lambda x: x != ""), F.col("template"),
            lambda a, x: F.concat(a, F.lit("/"), x))
        done = stage.table(f"level{level}", shapes.join(node, ["host", "template", name]).select(
            "host", "shape", "n", "bad", "known", "open",
            F.when(~F.col("open"), whole).when(F.col("_token") == "", F.col("template")).otherwise(
                F.concat("template", F.lit("/"), "_token")).alias("template")))
        stage.drop(f"children{level}")
        shapes = done.filter("open").drop("open")
        level += 1
        if shapes.isEmpty():
            break
    shapes = pages.sparkSession.read.schema(done.schema).parquet(
        *[stage.path(f"level{i}") for i in range(level)]).filter("not open")
    judged = shapes.groupBy("host", "template").agg(
        F.sum("known").alias("labelled"), F.sum("bad").alias("blocked"))
    # one blocked and one allowed page more, so that few labels say little
    purity = (F.col("blocked") + 1) / (F.col("labelled") + 2)
    judged = judged.withColumn("rejected", (F.col("labelled") >= params.least_labels)
                               & (purity >= params.reject))
    return shapes.select("host", "shape", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, rules: list[UrlRule], params: TreeParams = TreeParams()) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, rejected`` of every row.

    The longest rule that fits decides. What no rule fits is blocked if its host's tree has
    rejected its template, with the rules' verdicts as labels, and allowed otherwise; unknown
    templates are allowed. Null urls and urls without ``://`` have empty host and path. One
    output row per input row, repeated or not; only ``page_id`` and ``url`` are read.
    """
    stage = Staging(pages.sparkSession, "urls")
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = stage.table("rows", rows.select(
        "page_id", "host", "path", text.alias("rule"), verdict.alias("label"),
        segments(F.col("path")).alias("shape")))
    templates = stage.table("templates", learn_templates(rows, stage, params))
    # a hot host is dealt out by its shapes; adaptive execution splits what is still too large
    return rows.join(templates, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("label", F.when(
            F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")))
        .alias("verdict"), "template", F.coalesce("rejected", F.lit(False)).alias("rejected"))
