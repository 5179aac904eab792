"""Stored-table schemas and the fixed values the rules are defined by."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _d, _b = T.StringType(), T.DoubleType(), T.BooleanType()
_i, _l, _ts = T.IntegerType(), T.LongType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


WORKS = _struct(
    Work_ID=_s, House=_s, MP_Name=_s, Vendor_Name=_s, Constituency_ID=_s, State=_s,
    Constituency=_s, Work_Category=_s, Work_Description=_s, Work_Status=_s,
    Implementing_Agency=_s, Calamity_Flag=_b, Recommended_Date=_ts, Sanction_Date=_ts,
    Completion_Date=_ts, Days_to_Sanction=_i, Days_to_Complete=_i, Days_Pending=_i,
    Recommended_Amount=_d, Sanction_Amount=_d, Disbursed_Amount=_d, Cost_Overrun_Amount=_d,
    Cost_Overrun_Ratio=_d, Work_Quantity=_i, Work_Scope_Unit=_s, Cost_per_Unit=_d,
)
MEMBERS = _struct(
    MP_Name=_s, MP_Total_Allocation=_d, MP_Total_Sanctioned=_d, MP_Total_Disbursed=_d,
    MP_Total_Projects=_l, MP_Completed_Projects=_l, MP_Completion_Rate=_d,
    MP_Budget_Utilization_Percent=_d, MP_Performance_Rank=_i,
)
VENDORS = _struct(
    Vendor_Name=_s, Vendor_Total_Projects_Count=_l, Vendor_Avg_Timeline_Days=_d,
    Vendor_Avg_Cost_Overrun_Ratio=_d, Vendor_Quality_Rating=_d, Vendor_Monopoly_Score=_d,
    Vendor_Risk_Score=_d,
)
GEOGRAPHY = _struct(
    State=_s, Constituency=_s, Constituency_ID=_s, District_Code=_s, Latitude=_d,
    Longitude=_d, Spatial_Cluster_ID=_s, Zone_Fraud_Risk_Score=_d,
)
COMPLIANCE = _struct(
    Work_ID=_s, Documents_Submitted=_s, NOC_Status=_s, Compliance_Score=_d,
    Is_Duplicate_Work=_b, Cost_Anomaly_Flag=_b, Overall_Fraud_Risk_Score=_d,
    Work_Description_Full=_s, Inspection_Summary=_s, Issues_Encountered=_s,
)
DUPLICATES = _struct(
    Work_ID=_s, Vendor_Name=_s, Constituency=_s, duplicate_risk_score=_d,
    nearest_duplicate_work_id=_s, nearest_similarity=_d, duplicate_checked=_b,
)
STAR = {
    "works_master": WORKS,
    "mp_dimension": MEMBERS,
    "vendor_dimension": VENDORS,
    "geography_dimension": GEOGRAPHY,
    "compliance_and_ml": COMPLIANCE,
}

# ---------------------------------------------------------------- fixed values
# Cell texts that count as missing in CSV input.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Physical progress expected at each status.
STATUS_PROGRESS = {
    "Time Estimation": 0.0,
    "Sanction": 0.15,
    "Vendor Identification": 0.35,
    "Physical Inspection": 0.65,
    "Work partially Completed": 0.85,
    "Work Completed": 1.0,
}

REQUIRED_DOCUMENTS = ("Site Plan", "Utilization Cert", "NOC")
ISSUE_TYPES = ("Weather delays", "Vendor issues")
NOC_PENALTY = {"Pending": 100.0, "Not_Required": 0.0, "Received": 0.0}
NOC_PENALTY_OTHER = 40.0

RISK_WEIGHTS = {
    "anomaly": 0.25,
    "compliance": 0.20,
    "contractor": 0.20,
    "spatial": 0.15,
    "duplicate": 0.20,
}

RISK_LEVELS = ((75.0, "Critical"), (50.0, "High"), (25.0, "Medium"))
LOWEST_LEVEL = "Low"
ACTIONS = {
    "Critical": "AUDIT / FIELD VERIFICATION",
    "High": "Priority review by compliance officer",
    "Medium": "Routine monitoring",
    "Low": "No action required",
}

SIMILARITY_FLOOR = 0.85
SIMILARITY_CEILING = 0.98
SPATIAL_DEFAULT = 47.0
PLACEHOLDER_VENDOR = "Unknown"
NEARBY_WORKS = 5

ANOMALY_FEATURES = (
    "Cost_per_Unit",
    "Vendor_Avg_Cost_Overrun_Ratio",
    "Vendor_Avg_Timeline_Days",
    "Days_to_Sanction",
    "Progress_Gap",
    "Vendor_Avg_Cost_Overrun_Ratio_missing",
    "Vendor_Avg_Timeline_Days_missing",
)
IMPUTED_FEATURES = ("Vendor_Avg_Cost_Overrun_Ratio", "Vendor_Avg_Timeline_Days")
REFERENCE_FEATURES = (
    "Cost_per_Unit", "Vendor_Avg_Timeline_Days", "Days_to_Sanction", "Progress_Gap",
    "Vendor_Avg_Cost_Overrun_Ratio",
)

CROSS_CHECK_NUMERIC = (
    "Cost_per_Unit", "Days_to_Sanction", "Progress_Gap",
    "Vendor_Avg_Cost_Overrun_Ratio", "Vendor_Avg_Timeline_Days",
    "Vendor_Avg_Cost_Overrun_Ratio_missing", "Vendor_Avg_Timeline_Days_missing",
    "Vendor_Risk_Score", "Vendor_Monopoly_Score", "Vendor_Quality_Rating",
    "Vendor_Total_Projects_Count", "Compliance_Score", "Zone_Fraud_Risk_Score",
    "Docs_Submitted_Count", "Docs_Missing_Count", "Issues_Count",
)
CROSS_CHECK_BOOLEAN = (
    "Doc_Site_Plan", "Doc_Utilization_Cert", "Doc_NOC",
    "Issue_Weather_delays", "Issue_Vendor_issues", "Calamity_Flag",
)
CROSS_CHECK_CATEGORY = ("NOC_Status", "House")

# Columns each listing may be sorted by.
SORTABLE_WORKS = (
    "Work_ID", "House", "MP_Name", "Vendor_Name", "State", "Constituency", "Work_Status",
    "Recommended_Date", "Sanction_Date", "Completion_Date", "Days_to_Sanction",
    "Days_to_Complete", "Days_Pending", "Recommended_Amount", "Sanction_Amount",
    "Disbursed_Amount", "Cost_Overrun_Amount", "Cost_Overrun_Ratio", "Cost_per_Unit",
)
SORTABLE_MEMBERS = tuple(MEMBERS.names)
SORTABLE_VENDORS = tuple(VENDORS.names)
SORTABLE_GEOGRAPHY = (
    "State", "Constituency", "Constituency_ID", "District_Code", "Spatial_Cluster_ID",
    "Zone_Fraud_Risk_Score",
)


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """A composite is only a 0-100 score if its weights sum to one."""
    if abs(sum(weights.values()) - 1.0) >= 1e-9:
        raise ValueError(f"risk weights must sum to 1, got {sum(weights.values())}")
    return weights


check_weights(RISK_WEIGHTS)
