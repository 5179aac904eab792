"""Risk scoring and investigation reports for any number of works at once."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksrisk import schemas as S
from worksrisk.functions import rules
from worksrisk.functions.cells import is_real_vendor
from worksrisk.operators import iforest, similarity
from worksrisk.operators.features import (add_document_flags, impute_vendor_features,
                                          master_dataset)
from worksrisk.operators.joins import hot_keys, left_join, spread_left_join
from worksrisk.operators.models import CrossCheck
from worksrisk.operators.ranks import left_positions, medians, positions, with_left_percentiles
from worksrisk.operators.texts import Encoder, WordModel
from worksrisk.session import stored
from worksrisk.sources.star import Star

KEY = "request_id"
ALL_UNITS = "*"

# fixed values: which features tell a cost anomaly, and which a timeline anomaly
COST_FEATURES = ("Cost_per_Unit", "Vendor_Avg_Cost_Overrun_Ratio")
TIMELINE_FEATURES = ("Days_to_Sanction", "Vendor_Avg_Timeline_Days", "Progress_Gap")


@dataclass(frozen=True)
class Engine:
    """Stored tables and fitted models; the optional ones may be missing."""

    star: Star
    anomaly: iforest.AnomalyModel
    duplicates: DataFrame | None = None      # stored duplicate scores
    index: DataFrame | None = None           # stored vectors of known works
    text: WordModel | Encoder | None = None  # the index's own model, for new descriptions
    cross_check: CrossCheck | None = None


# --------------------------------------------------------------- whole table
def attach_duplicates(df: DataFrame, duplicates: DataFrame | None) -> DataFrame:
    """Stored duplicate score per work; a work without one, or no table at all, scores 0."""
    if duplicates is None:
        return df.withColumn("duplicate_risk_score", F.lit(0.0))
    side = duplicates.select("Work_ID", "duplicate_risk_score")
    return left_join(df, side, ["Work_ID"]).fillna(0.0, subset=["duplicate_risk_score"])


def zones(star: Star) -> DataFrame:
    """The zone risk of each work: that column of the master frame, without its other joins."""
    place = ["State", "Constituency", "Constituency_ID"]
    return left_join(star.works.select(*place), star.geography.select(*place, "Zone_Fraud_Risk_Score"), place,
                     null_safe=True).select("Zone_Fraud_Risk_Score")


def rule_signals(df: DataFrame, *, batch: bool = True, zone: DataFrame | None = None) -> DataFrame:
    """Compliance, contractor and spatial signals of a master frame.

    ``zone`` may bring the zone risk of the same works, if it is cheaper to read than ``df``.
    """
    risk = df if zone is None else zone
    mean = risk.select(F.avg("Zone_Fraud_Risk_Score")).scalar() if batch else None
    return df.withColumns({
        "compliance": rules.compliance_score(
            F.col("Documents_Submitted"), F.col("NOC_Status"), F.col("Issues_Encountered"),
            F.col("Compliance_Score")),
        "contractor": rules.contractor_score(
            F.col("Vendor_Risk_Score"), F.col("Vendor_Monopoly_Score"),
            F.col("Vendor_Quality_Rating"), F.col("Vendor_Total_Projects_Count")),
        "spatial": rules.spatial_score(F.col("Zone_Fraud_Risk_Score"), mean),
    })


def composite_frame(star: Star, model: iforest.AnomalyModel,
                    duplicates: DataFrame | None = None,
                    weights: dict[str, float] = S.RISK_WEIGHTS) -> DataFrame:
    """Every work with its five signals and the composite: also the training set of the
    cross-check."""
    df = master_dataset(star)
    risk = iforest.batch_risk(df, model).select("Work_ID", "anomaly")
    df = rule_signals(impute_vendor_features(df, model.medians), zone=zones(star))
    df = attach_duplicates(left_join(df, risk, ["Work_ID"]), duplicates)
    parts = {"anomaly": F.col("anomaly"), "compliance": F.col("compliance"),
             "contractor": F.col("contractor"), "spatial": F.col("spatial"),
             "duplicate": F.col("duplicate_risk_score")}
    return df.withColumn("composite", rules.composite(parts, weights))


def distribution(df: DataFrame, column: str = "composite") -> DataFrame:
    return df.select(column).summary()


def feature_anomalies(df: DataFrame, reference: DataFrame, key: str = "Work_ID", *,
                      kinds: tuple[str, ...] = ("cost_anomaly", "timeline_anomaly"),
                      store: bool = True) -> DataFrame:
    """(key, cost_anomaly, timeline_anomaly): 100 times the most extreme feature.

    ``df`` has the features of the kinds asked for as they are, without imputation: a
    missing one counts as the middle. The gap is extreme in either direction, so its size
    is ranked. Only the features of those kinds are read and ranked; ``store=False`` if they are
    stored already.
    """
    groups = {k: {"cost_anomaly": COST_FEATURES, "timeline_anomaly": TIMELINE_FEATURES}[k]
              for k in kinds}
    names = [f for f in S.REFERENCE_FEATURES if any(f in g for g in groups.values())]
    df = stored(df.select(key, *names)) if store else df.select(key, *names)

    def sized(name: str, value: Column) -> Column:
        return F.abs(value) if name == "Progress_Gap" else value

    size = F.when(F.col("feature") == "Progress_Gap", F.abs("value")).otherwise(F.col("value"))
    base = (reference.filter(F.col("feature").isin(names)).withColumn("value", size)
            .groupBy("feature", "value").agg(F.sum("eq").alias("eq")))

    def missing(features: tuple[str, ...]) -> Column:
        gaps = [F.when(F.col(n).isNull(), 0.5).otherwise(0.0) for n in features]
        return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]

    floor = df.select(key, *names, *(missing(g).alias(f"_floor_{k}") for k, g in groups.items()))
    ranked = with_left_percentiles(floor, key, {f"_found_{n}": sized(n, F.col(n)) for n in names}, base.withColumn(
        "feature", F.concat(F.lit("_found_"), "feature")))
    return ranked.select(key, *(
        (100 * F.greatest(*(f"_found_{n}" for n in g), f"_floor_{k}")).alias(k) for k, g in groups.items()))


def benchmark(df: DataFrame, works: DataFrame, key: str = "Work_ID", *,
              no_unit_means_all: bool = False) -> DataFrame:
    """Each work's unit cost against all works measured in the same unit.

    A stored work without a unit has no peers; with ``no_unit_means_all`` (new works)
    it is compared with everything. Percentiles are strict, and peers without a cost
    still count. A cost or median of 0 gives no ratio.
    """
    unit, cost = F.col("Work_Scope_Unit"), F.col("Cost_per_Unit")
    own = F.coalesce(unit, F.lit(ALL_UNITS)) if no_unit_means_all else unit
    groups = F.array(unit, F.lit(ALL_UNITS)) if no_unit_means_all else F.array(unit)
    peers = (works.select(F.explode(groups).alias("feature"), cost.alias("value"))
             .filter(F.col("feature").isNotNull()))
    sizes = peers.groupBy("feature").agg(F.count("*").alias("size"))
    counts = (peers.filter(F.col("value").isNotNull()).groupBy("feature", "value")
              .agg(F.count("*").alias("eq")))
    middle = medians(positions(peers.filter(F.col("value").isNotNull()), ["feature"]),
                     ["feature"])
    mine = df.select(key, unit, cost, own.alias("feature"))
    asked = mine.select(key, "feature", cost.alias("value")).filter(
        F.col("feature").isNotNull() & F.col("value").isNotNull())
    below = left_positions(asked, counts, key).select(key, "lt")
    stats = left_join(sizes, middle, ["feature"])
    out = spread_left_join(mine, stats, ["feature"], hot_keys(sizes, ["feature"], "size"),
                           scatter=F.col("feature").isNull())
    out = left_join(out, below, [key])
    return out.select(
        key, unit.alias("work_scope_unit"),
        F.coalesce("size", F.lit(0)).alias("peer_group_size"),
        F.col("median").alias("peer_median_cost_per_unit"),
        cost.alias("this_cost_per_unit"),
        F.when((cost != 0) & (F.col("median") != 0), F.try_divide(cost, F.col("median")))
        .alias("cost_vs_peer_median_ratio"),
        F.when(F.col("size") > 0, F.coalesce("lt", F.lit(0)) / F.col("size"))
        .alias("cost_percentile_vs_peers"))


def contractor_history(df: DataFrame, duplicates: DataFrame | None,
                       key: str = "Work_ID") -> DataFrame:
    """Vendor record of each work, with how many of the vendor's works are flagged."""
    if duplicates is None:
        flagged = df.withColumn("other_flagged_duplicate_count", F.lit(None).cast("long"))
    else:
        counts = similarity.flagged_per_vendor(duplicates)
        sizes = duplicates.groupBy("Vendor_Name").agg(F.count("*").alias("works"))
        joined = spread_left_join(df, counts, ["Vendor_Name"],
                                  hot_keys(sizes, ["Vendor_Name"], "works"),
                                  scatter=~is_real_vendor(F.col("Vendor_Name")))
        flagged = joined.withColumn(
            "other_flagged_duplicate_count",
            F.when(is_real_vendor(F.col("Vendor_Name")),
                   F.coalesce("other_flagged_duplicate_count", F.lit(0))))
    return flagged.select(
        key, F.col("Vendor_Name").alias("vendor_name"),
        F.col("Vendor_Total_Projects_Count").alias("total_projects"),
        F.col("Vendor_Avg_Timeline_Days").alias("avg_timeline_days"),
        F.col("Vendor_Avg_Cost_Overrun_Ratio").alias("avg_cost_overrun_ratio"),
        F.col("Vendor_Quality_Rating").alias("quality_rating"),
        F.col("Vendor_Monopoly_Score").alias("monopoly_score"),
        F.col("Vendor_Risk_Score").alias("vendor_risk_score"),
        "other_flagged_duplicate_count")


# ------------------------------------------------------------------- requests
def _only(star: Star, ids: DataFrame) -> Star:
    """The star schema narrowed to some works before anything is joined."""
    return replace(star, works=star.works.join(ids, "Work_ID", "left_semi"),
                   compliance=star.compliance.join(ids, "Work_ID", "left_semi"))


def overlay(requests: DataFrame, star: Star, *, enrich: bool = False) -> DataFrame:
    """Stored record of each request's work with the request's own fields on top.

    A null field of a request is a field not given. ``on_record`` tells whether the work
    is stored. ``enrich`` lets a new work take the stored vendor and place columns.
    """
    named = requests.drop(KEY)
    if not named.columns:
        raise ValueError("a request needs a Work_ID or at least one field of a work")
    given = requests.dropna(how="all", subset=named.columns)
    if KEY not in given.columns:
        given = stored(given.withColumn(KEY, F.monotonically_increasing_id()))
    if "Work_ID" not in given.columns:
        given = given.withColumn("Work_ID", F.lit(None).cast("string"))
    ids = given.select("Work_ID").filter(F.col("Work_ID").isNotNull()).distinct()
    known = master_dataset(_only(star, ids), spread=False).withColumn("on_record", F.lit(True))
    asked = [c for c in given.columns if c not in ("Work_ID", KEY)]
    mine = given.select(KEY, "Work_ID", *(F.col(c).alias(f"_r_{c}") for c in asked))
    both = _left_join_known(mine, known)
    types = {f.name: f.dataType for f in known.schema.fields}
    out = both.withColumns({
        c: F.coalesce(F.col(f"_r_{c}").cast(types[c]), F.col(c)) if c in types
        else F.col(f"_r_{c}") for c in asked}).fillna(False, subset=["on_record"])
    if enrich:
        out = _enrich(out, star)
    gap = rules.progress_gap(F.col("Disbursed_Amount"), F.col("Sanction_Amount"),
                             F.col("Work_Status"))
    told = (F.col("Disbursed_Amount").isNotNull() & F.col("Sanction_Amount").isNotNull()
            & F.col("Work_Status").isNotNull())
    fresh = F.when(F.col("on_record") | told, gap).otherwise(F.lit(0.0))
    if "Progress_Gap" in asked:
        fresh = F.coalesce(F.col("_r_Progress_Gap").cast("double"), fresh)
    return add_document_flags(out.withColumn("Progress_Gap", fresh)).drop(
        *(f"_r_{c}" for c in asked))


def _left_join_known(requests: DataFrame, side: DataFrame) -> DataFrame:
    """Left join on Work_ID in which requests without one are spread by their own number."""
    own = F.coalesce("Work_ID", F.concat(F.lit("\u0000"), F.col(KEY).cast("string")))
    keyed = requests.withColumn("_join_id", own)
    return left_join(keyed, side.withColumnRenamed("Work_ID", "_join_id"),
                     ["_join_id"]).drop("_join_id")


def _enrich(df: DataFrame, star: Star) -> DataFrame:
    """Fill vendor and place columns that are still empty from their dimension tables."""
    def fill(df: DataFrame, side: DataFrame, keys: list[str], null_safe: bool) -> DataFrame:
        extra = [c for c in side.columns if c not in keys]
        renamed = side.select(*keys, *(F.col(c).alias(f"_d_{c}") for c in extra))
        return (left_join(df, renamed, keys, null_safe=null_safe)
                .withColumns({c: F.coalesce(F.col(c), F.col(f"_d_{c}")) for c in extra})
                .drop(*(f"_d_{c}" for c in extra)))

    df = fill(df, star.vendors, ["Vendor_Name"], False)
    return fill(df, star.geography, ["State", "Constituency"], True)


def duplicate_details(rows: DataFrame, engine: Engine) -> DataFrame:
    """(request_id, duplicate, checked, nearest, similarity): stored, or searched if new.

    A work on record that the stored scores leave out is unchecked: its own entry in the
    index would be its nearest.
    """
    columns = ["duplicate_risk_score", "duplicate_checked", "nearest_duplicate_work_id",
               "nearest_similarity"]
    base = rows.select(KEY, "Work_ID")
    if engine.duplicates is not None:
        lookup = engine.duplicates.select("Work_ID", *columns)
        found = _left_join_known(base, lookup)
    else:
        found = base.withColumns({
            "duplicate_risk_score": F.lit(None).cast("double"),
            "duplicate_checked": F.lit(None).cast("boolean"),
            "nearest_duplicate_work_id": F.lit(None).cast("string"),
            "nearest_similarity": F.lit(None).cast("double")})
    if engine.index is not None and engine.text is not None:
        asked = rows.filter(~F.col("on_record")).select(
            KEY, F.concat(F.lit("request "), F.col(KEY)).alias("Work_ID"), "Vendor_Name",
            "Constituency", "Work_Description")
        vectors = engine.text.vectors(asked, "Work_Description")
        live = similarity.new_work_duplicates(vectors, engine.index).select(
            KEY, *(F.col(c).alias(f"_n_{c}") for c in columns))
        found = (left_join(found, live, [KEY])
                 .withColumns({c: F.coalesce(F.col(c), F.col(f"_n_{c}")) for c in columns}))
    return found.select(
        KEY, F.coalesce(columns[0], F.lit(0.0)).alias("duplicate"),
        F.coalesce(columns[1], F.lit(False)).alias("checked"),
        F.col(columns[2]).alias("nearest"),
        F.coalesce(columns[3], F.lit(0.0)).alias("similarity"))


def score_rows(rows: DataFrame, engine: Engine,
               weights: dict[str, float] = S.RISK_WEIGHTS) -> DataFrame:
    """Signals, composite, cross-check and reasons of resolved rows, one row per request."""
    parts = ("anomaly", "compliance", "contractor", "spatial", "duplicate")
    signals = rows.select(
        KEY, "Work_ID",
        rules.compliance_score(F.col("Documents_Submitted"), F.col("NOC_Status"),
                               F.col("Issues_Encountered"), F.col("Compliance_Score"))
        .alias("compliance"),
        rules.contractor_score(F.col("Vendor_Risk_Score"), F.col("Vendor_Monopoly_Score"),
                               F.col("Vendor_Quality_Rating"),
                               F.col("Vendor_Total_Projects_Count"), F.col("on_record"))
        .alias("contractor"),
        rules.spatial_score(F.col("Zone_Fraud_Risk_Score")).alias("spatial"))
    anomaly = iforest.reference_risk(rows, engine.anomaly, KEY).select(KEY, "anomaly")
    out = left_join(left_join(signals, anomaly, [KEY]), duplicate_details(rows, engine), [KEY])
    if engine.cross_check is None:
        out = out.withColumn("cross_check", F.lit(None).cast("double"))
    else:
        out = left_join(out, engine.cross_check.predict(rows, KEY), [KEY])
    values = {p: F.col(p) for p in parts}
    out = out.withColumn("score", rules.composite(values, weights))
    reasons = rules.top_reasons(values, F.col("checked"), F.col("nearest"), F.col("similarity"))
    note = rules.disagreement_note(F.col("cross_check"), F.col("score"))
    return out.select(
        KEY, F.col("Work_ID").alias("work_id"),
        F.round("score", 2).alias("final_risk_score"),
        rules.risk_level(F.col("score")).alias("risk_level"),
        F.struct(*(F.round(p, 2).alias(p) for p in parts)).alias("components"),
        F.struct(*(F.lit(weights[p]).alias(p) for p in parts)).alias("component_weights"),
        F.struct(F.col("checked").alias("checked"),
                 F.col("nearest").alias("nearest_duplicate_work_id"),
                 F.round("similarity", 3).alias("nearest_similarity")).alias("duplicate_detail"),
        F.round("cross_check", 2).alias("cross_check_score"),
        F.concat(reasons, F.coalesce(note, F.array().cast("array<string>")))
        .alias("top_risk_factors"))


def score_works(requests: DataFrame, engine: Engine, *, enrich: bool = False) -> DataFrame:
    """Score known works, changed works and new works, whatever each request gives."""
    return score_rows(stored(overlay(requests, engine.star, enrich=enrich)), engine)


def nearby(rows: DataFrame, engine: Engine) -> DataFrame:
    """(request_id, nearby_similar_works): up to five, most similar first."""
    geo = ["State", "Constituency", "Constituency_ID"]
    columns = ["Work_ID", "Spatial_Cluster_ID", "Constituency"]
    places = left_join(engine.star.works.select("Work_ID", *geo),
                       engine.star.geography.select(*geo, "Spatial_Cluster_ID"), geo,
                       null_safe=True).select(*columns)
    vectors = engine.index.select(F.col("work_id").alias("Work_ID"), "embedding")
    found = similarity.nearby_works(rows.select(*columns), places, vectors)
    facts = engine.star.works.select(F.col("Work_ID").alias("nearest_id"), "Vendor_Name",
                                     "Work_Status", "Cost_per_Unit")
    item = F.struct(
        "position", F.col("nearest_id").alias("work_id"), F.col("Vendor_Name").alias("vendor_name"),
        F.col("Work_Status").alias("work_status"),
        F.round("Cost_per_Unit", 2).alias("cost_per_unit"),
        F.round("similarity", 3).alias("similarity"))
    listed = (found.join(facts, "nearest_id").groupBy("Work_ID")
              .agg(F.sort_array(F.collect_list(item)).alias("nearby_similar_works")))
    return left_join(rows.select(KEY, "Work_ID"), listed, ["Work_ID"]).select(
        KEY, F.transform("nearby_similar_works", lambda w: w.dropFields("position"))
        .alias("nearby_similar_works"))


def investigate(work_ids: DataFrame, engine: Engine) -> DataFrame:
    """Nested report of each stored work; an identifier that is not stored has no row."""
    asked = work_ids.select("Work_ID").distinct()
    rows = overlay(asked, engine.star).filter("on_record")
    rows = stored(rows)
    risk = score_rows(rows, engine)
    extremes = feature_anomalies(rows, engine.anomaly.reference, KEY)
    history = contractor_history(rows, engine.duplicates, KEY)
    peers = benchmark(rows, engine.star.works, KEY)
    history = history.select(KEY, F.struct(*(c for c in history.columns if c != KEY))
                             .alias("contractor_history"))
    digits = {"peer_median_cost_per_unit": 2, "this_cost_per_unit": 2,
              "cost_vs_peer_median_ratio": 2, "cost_percentile_vs_peers": 3}
    peers = peers.select(KEY, F.struct(*(
        (F.round(c, digits[c]) if c in digits else F.col(c)).alias(c)
        for c in peers.columns if c != KEY)).alias("historical_benchmark"))
    out = risk
    for side in (extremes, history, peers):
        out = left_join(out, side, [KEY])
    if engine.index is not None:
        out = left_join(out, nearby(rows, engine), [KEY])
    else:
        out = out.withColumn("nearby_similar_works", F.lit(None))
    detail = F.col("duplicate_detail")
    return out.select(
        "work_id", F.col("final_risk_score").alias("risk_score"), "risk_level",
        rules.why_panel(F.col("components.duplicate"), F.col("cost_anomaly"),
                        F.col("timeline_anomaly"), F.col("components.compliance"),
                        detail["checked"], detail["nearest_duplicate_work_id"],
                        detail["nearest_similarity"]).alias("why"),
        F.coalesce("nearby_similar_works", F.array()).alias("nearby_similar_works")
        if engine.index is not None else F.array().alias("nearby_similar_works"),
        "contractor_history", "historical_benchmark",
        rules.recommended_action(F.col("risk_level")).alias("recommended_action"),
        "cross_check_score")
