"""Row-level rules as native column expressions: derived measures and risk signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from worksrisk import schemas as S
from worksrisk.functions.cells import is_completed, tokens


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small fixed mapping, null for an unknown key."""
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))[key]


def clip(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Bound a number; null stays null (greatest and least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


# ------------------------------------------------------------------- measures
def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed days rounded down, by the clock of the stamps whatever the session's zone.

    Midnights between the two, less one when the later stamp is earlier in its day.
    """
    def clock(c: Column) -> Column:
        return (F.hour(c) * 3600 + F.minute(c) * 60
                + F.date_part(F.lit("SECOND"), c).cast("double"))

    return (F.date_diff(later, earlier)
            - F.when(clock(later) < clock(earlier), 1).otherwise(0)).cast("int")


def days_pending(recommended: Column, completed: Column, as_of: Column) -> Column:
    return F.when(completed.isNull(), whole_days(as_of, recommended))


def overrun_amount(status: Column, disbursed: Column, sanctioned: Column) -> Column:
    return F.when(is_completed(status), disbursed - sanctioned)


def overrun_ratio(status: Column, disbursed: Column, sanctioned: Column) -> Column:
    return F.when(is_completed(status) & (sanctioned > 0), F.try_divide(disbursed, sanctioned))


def cost_per_unit(disbursed: Column, quantity: Column) -> Column:
    return F.when(quantity > 0, F.try_divide(disbursed, quantity)).otherwise(F.lit(0.0))


def progress_gap(disbursed: Column, sanctioned: Column, status: Column) -> Column:
    """Share of the money out, less the progress the status implies."""
    paid = F.coalesce(clip(F.try_divide(disbursed, sanctioned), 0.0, 1.5), F.lit(0.0))
    return paid - F.coalesce(lookup(S.STATUS_PROGRESS, status), F.lit(0.0))


def similarity_risk(similarity: Column, floor: float = S.SIMILARITY_FLOOR,
                    ceiling: float = S.SIMILARITY_CEILING) -> Column:
    """Nothing up to the floor, everything from the ceiling, linear between."""
    return (
        F.when(similarity <= floor, F.lit(0.0))
        .when(similarity >= ceiling, F.lit(100.0))
        .otherwise((similarity - floor) / (ceiling - floor) * 100.0)
    )


# ---------------------------------------------------------- documents and issues
def flag_name(prefix: str, name: str) -> str:
    return f"{prefix}_{name.replace(' ', '_')}"


def document_flags(documents: Column, issues: Column) -> dict[str, Column]:
    """One boolean per required document and issue type, and the three counts."""
    docs, found = tokens(documents), tokens(issues)
    required = len(S.REQUIRED_DOCUMENTS)
    flags = {flag_name("Doc", d): F.array_contains(docs, d) for d in S.REQUIRED_DOCUMENTS}
    flags["Docs_Submitted_Count"] = F.size(docs)
    flags["Docs_Missing_Count"] = required - F.least(F.size(docs), F.lit(required))
    flags |= {flag_name("Issue", i): F.array_contains(found, i) for i in S.ISSUE_TYPES}
    flags["Issues_Count"] = F.size(found)
    return flags


def missing_required(documents: Column) -> Column:
    """Required documents not on the list, by name."""
    required = F.array(*(F.lit(d) for d in S.REQUIRED_DOCUMENTS))
    return F.size(F.array_except(required, tokens(documents)))


# -------------------------------------------------------------- risk signals
def compliance_score(documents: Column, noc: Column, issues: Column, score: Column) -> Column:
    absent = missing_required(documents) / F.lit(float(len(S.REQUIRED_DOCUMENTS))) * 100
    clearance = F.coalesce(lookup(S.NOC_PENALTY, noc), F.lit(S.NOC_PENALTY_OTHER))
    trouble = F.least(F.size(tokens(issues)), F.lit(2)) / F.lit(2.0) * 100
    shortfall = 100 - clip(F.coalesce(score, F.lit(50.0)))
    return clip(0.35 * absent + 0.30 * clearance + 0.15 * trouble + 0.20 * shortfall)


def contractor_score(risk: Column, monopoly: Column, quality: Column, projects: Column,
                     on_record: Column | None = None) -> Column:
    """Vendor track record.

    A stored work whose vendor has no history counts as one project and is
    penalised; a work nobody has on record says nothing about history and is not.
    ``on_record`` tells the two apart (default: every row is on record).
    """
    unknown = F.lit(1) if on_record is None else F.when(on_record, 1).otherwise(5)
    n = F.coalesce(projects, unknown)
    share = clip((F.coalesce(monopoly, F.lit(20.0)) - 5) / F.lit(35.0) * 100)
    poor = clip((5 - F.coalesce(quality, F.lit(3.0))) / F.lit(4.0) * 100)
    thin = F.when(n <= 1, 60.0).when(n <= 3, 25.0).otherwise(0.0)
    return clip(0.45 * F.coalesce(risk, F.lit(50.0)) + 0.20 * share + 0.20 * poor + 0.15 * thin)


def spatial_score(zone_risk: Column, batch_mean: Column | None = None) -> Column:
    """Zone risk; a batch fills gaps with its own mean, a single record with 47."""
    fills = [zone_risk, F.lit(S.SPATIAL_DEFAULT)]
    if batch_mean is not None:
        fills.insert(1, batch_mean)
    return clip(F.coalesce(*fills))


def composite(parts: dict[str, Column], weights: dict[str, float] = S.RISK_WEIGHTS) -> Column:
    S.check_weights(weights)
    return clip(reduce(lambda a, b: a + b, (weights[k] * parts[k] for k in weights)))


def risk_level(score: Column) -> Column:
    (first, label), *rest = S.RISK_LEVELS
    level = F.when(score >= first, label)
    for at, name in rest:
        level = level.when(score >= at, name)
    return level.otherwise(S.LOWEST_LEVEL)


def severity(score: Column, critical: float = 70.0, warning: float = 40.0) -> Column:
    """Struct of severity and icon, both null below the warning mark."""
    def mark(name: str, icon: str) -> Column:
        return F.struct(F.lit(name).alias("severity"), F.lit(icon).alias("icon"))

    nothing = F.struct(F.lit(None).cast("string").alias("severity"),
                       F.lit(None).cast("string").alias("icon"))
    return (F.when(score >= critical, mark("critical", "\U0001F534"))
            .when(score >= warning, mark("warning", "\U0001F7E0"))
            .otherwise(nothing))


def recommended_action(level: Column) -> Column:
    return lookup(S.ACTIONS, level)


# ----------------------------------------------------------- reasons in words
# fixed texts
REASON_TEXT = {
    "compliance": "Compliance gaps: missing required documents, pending NOC, and/or a low "
                  "compliance score.",
    "contractor": "Vendor track record risk: high vendor risk score, monopoly concentration, "
                  "low quality rating, or thin project history.",
    "anomaly": "Statistical outlier vs peers on cost-per-unit, timeline, or "
               "disbursement-vs-progress profile.",
    "spatial": "Located in a geographic zone with an elevated historical fraud-risk score.",
    "duplicate": "Description is highly similar (cosine similarity %.2f) to work %s by the same "
                 "vendor in the same constituency - possible duplicate/phantom billing, but also "
                 "consistent with legitimately repeated small-scale works; recommend manual review.",
}
NO_REASON = "No individual signal exceeded its risk threshold."
DISAGREEMENT = ("Note: the cross-check model (%.1f) disagrees notably with the rule-based "
                "composite (%.1f) - this project's feature combination is unusual relative to "
                "historical patterns and may warrant a closer look.")
WHY_TEXT = {
    "Cost anomaly": "Cost-per-unit and/or vendor cost-overrun history is a statistical outlier.",
    "Timeline anomaly": "Sanction speed, vendor timeline, or disbursement-vs-progress gap is a "
                        "statistical outlier.",
    "Compliance gaps": "Missing documents, pending NOC, logged issues, and/or a low compliance "
                       "score.",
}
REASON_THRESHOLD = {"compliance": 40.0, "contractor": 40.0, "anomaly": 60.0, "spatial": 60.0}


def _ranked(entries: list[Column]) -> Column:
    """Entries (score, position, ...) by score, earlier position first on a tie."""
    kept = F.filter(F.array(*entries), lambda e: e["applies"])
    return F.array_sort(kept, lambda a, b: (
        F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
        .when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1)
        .otherwise(0)))


def top_reasons(parts: dict[str, Column], checked: Column, nearest: Column,
                similarity: Column) -> Column:
    """The three heaviest reasons in words, or one sentence that there is none."""
    entries = []
    for name, limit in REASON_THRESHOLD.items():
        entries.append((parts[name], parts[name] > limit, F.lit(REASON_TEXT[name])))
    entries.append((parts["duplicate"], checked & (parts["duplicate"] > 0),
                    F.format_string(REASON_TEXT["duplicate"], similarity, nearest)))
    structs = [
        F.struct(score.alias("score"), F.lit(i).alias("position"),
                 F.coalesce(applies, F.lit(False)).alias("applies"), text.alias("text"))
        for i, (score, applies, text) in enumerate(entries)
    ]
    texts = F.transform(F.slice(_ranked(structs), 1, 3), lambda e: e["text"])
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(NO_REASON)))


def disagreement_note(cross_check: Column, score: Column) -> Column:
    """One-entry list when the learned score is more than 25 away, else an empty list."""
    note = F.array(F.format_string(DISAGREEMENT, cross_check, score))
    return (F.when(F.abs(cross_check - score) > 25, note)
            .otherwise(F.array().cast("array<string>")))


def why_panel(duplicate: Column, cost: Column, timeline: Column, compliance: Column,
              checked: Column, nearest: Column, similarity: Column) -> Column:
    """Flagged factors with severity, icon and text, by rounded score."""
    detail = F.when(checked, F.format_string("Similarity %.2f to %s", similarity, nearest))
    rows = [("Duplicate similarity", duplicate, detail)]
    for label, score in (("Cost anomaly", cost), ("Timeline anomaly", timeline),
                         ("Compliance gaps", compliance)):
        rows.append((label, score, F.lit(WHY_TEXT[label])))
    entries = [
        F.struct(F.round(score, 2).alias("score"), F.lit(i).alias("position"),
                 F.coalesce(severity(score)["severity"].isNotNull(), F.lit(False)).alias("applies"),
                 F.lit(label).alias("label"), severity(score)["severity"].alias("severity"),
                 severity(score)["icon"].alias("icon"), text.alias("detail"))
        for i, (label, score, text) in enumerate(rows)
    ]
    return F.transform(_ranked(entries), lambda e: F.struct(
        e["label"].alias("label"), e["severity"].alias("severity"), e["icon"].alias("icon"),
        e["score"].alias("score"), e["detail"].alias("detail")))
