"""What the registered queries should return, as plain SQL over the given tables."""

from __future__ import annotations

from worksrisk.functions.rules import DISAGREEMENT, NO_REASON, REASON_TEXT, WHY_TEXT  # fixed texts

# ------------------------------------------------------------ star schema in SQL
LINES = """
lines AS MATERIALIZED (
  SELECT l.*, o.*,
         'WS/MP' || o_custkey || '/' || year(o_orderdate) || '-' || (year(o_orderdate) + 1)
           || '/' || (l_orderkey * 10 + l_linenumber) AS Work_ID,
         CAST(o_orderdate AS DATE) AS rec_day,
         CAST(o_orderdate AS DATE) + CAST(l_linenumber * 7 + l_partkey % 30 AS INTEGER) AS san_day,
         CAST(l_shipdate AS DATE) AS ship_day
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
first_line AS MATERIALIZED (
  SELECT * FROM lines
  QUALIFY row_number() OVER (PARTITION BY Work_ID ORDER BY l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) = 1),
first_done AS MATERIALIZED (
  SELECT Work_ID, ship_day FROM lines WHERE l_returnflag = 'A' AND ship_day >= san_day
  QUALIFY row_number() OVER (PARTITION BY Work_ID ORDER BY l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) = 1),
paid AS MATERIALIZED (
  SELECT Work_ID, sum(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax))) AS Disbursed_Amount,
         coalesce(min(CASE WHEN l_suppkey % 10 <> 0 THEN s_name END), 'Unknown') AS Vendor_Name
  FROM lines JOIN supplier ON l_suppkey = s_suppkey GROUP BY Work_ID)"""

MASTER = LINES + """,
base AS MATERIALIZED (
  SELECT f.Work_ID,
         CASE WHEN l_orderkey % 3 = 0 THEN 'Rajya Sabha' ELSE 'Lok Sabha' END AS House,
         c_name AS MP_Name, r_name AS State, n_name AS Constituency,
         p_name || ' at ' || n_name AS Work_Description,
         CAST(rec_day AS TIMESTAMP) AS Recommended_Date,
         CAST(san_day AS TIMESTAMP) AS Sanction_Date,
         CAST(d.ship_day AS TIMESTAMP) AS Completion_Date,
         floor(o_totalprice) AS Recommended_Amount,
         CASE WHEN l_discount = 0 THEN 0.0 ELSE floor(l_extendedprice) END AS Sanction_Amount,
         CASE l_returnflag || l_linestatus
           WHEN 'AF' THEN 'Work Completed' WHEN 'AO' THEN 'Work partially Completed'
           WHEN 'NF' THEN 'Physical Inspection' WHEN 'NO' THEN 'Vendor Identification'
           WHEN 'RF' THEN 'Sanction' WHEN 'RO' THEN 'Time Estimation'
           ELSE 'Recommended' END AS Work_Status,
         p.Disbursed_Amount, p.Vendor_Name,
         CAST(l_quantity AS INTEGER) AS Work_Quantity, p_type AS Work_Scope_Unit,
         (l_tax = 0.08) AS Calamity_Flag,
         CASE l_linenumber % 4 WHEN 1 THEN 'Site Plan' WHEN 2 THEN 'Site Plan, NOC'
           WHEN 3 THEN 'Site Plan,NOC,Utilization Cert' END AS Documents_Submitted,
         l_linenumber % 4 AS n_docs,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Pending' WHEN '3-MEDIUM' THEN 'Not_Required'
           WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Received' END AS NOC_Status,
         CASE WHEN o_custkey % 13 <> 0 THEN (c_acctbal + 1000) / 110 END AS Compliance_Score,
         CASE l_returnflag WHEN 'R' THEN 'Weather delays, Vendor issues'
           WHEN 'A' THEN 'Vendor issues' END AS Issues_Encountered,
         CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS n_issues,
         n_nationkey
  FROM first_line f
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
  LEFT JOIN first_done d ON f.Work_ID = d.Work_ID
  LEFT JOIN paid p ON f.Work_ID = p.Work_ID),
master AS MATERIALIZED (
  SELECT *,
    CAST(date_diff('day', Recommended_Date, Sanction_Date) AS INTEGER) AS Days_to_Sanction,
    CAST(date_diff('day', Sanction_Date, Completion_Date) AS INTEGER) AS Days_to_Complete,
    CASE WHEN Completion_Date IS NULL THEN CAST(date_diff('day', Recommended_Date,
      TIMESTAMP '2002-01-01 00:00:00') AS INTEGER) END AS Days_Pending,
    CASE WHEN Work_Status LIKE '%Completed' THEN Disbursed_Amount - Sanction_Amount END
      AS Cost_Overrun_Amount,
    CASE WHEN Work_Status LIKE '%Completed' AND Sanction_Amount > 0
      THEN Disbursed_Amount / Sanction_Amount END AS Cost_Overrun_Ratio,
    CASE WHEN Work_Quantity > 0 THEN Disbursed_Amount / Work_Quantity ELSE 0.0 END AS Cost_per_Unit
  FROM base)"""

VENDORS = """
vendors AS MATERIALIZED (
  SELECT v.*, 1 + (s_suppkey % 41) / 10.0 AS Vendor_Quality_Rating,
         CAST(5 + s_suppkey % 36 AS DOUBLE) AS Vendor_Monopoly_Score,
         (s_acctbal + 1000) / 110 AS Vendor_Risk_Score
  FROM (SELECT Vendor_Name, count(Work_ID) AS Vendor_Total_Projects_Count,
               avg(Days_to_Complete) AS Vendor_Avg_Timeline_Days,
               round(avg(Cost_Overrun_Ratio), 6) AS Vendor_Avg_Cost_Overrun_Ratio
        FROM master WHERE Vendor_Name <> 'Unknown' GROUP BY Vendor_Name) v
  JOIN supplier ON s_name = Vendor_Name)"""

MEMBERS = """
members AS MATERIALIZED (
  SELECT *, CAST(rank() OVER (ORDER BY MP_Completion_Rate DESC) AS INTEGER) AS MP_Performance_Rank
  FROM (SELECT *, MP_Completed_Projects / MP_Total_Projects * 100 AS MP_Completion_Rate,
               CASE WHEN MP_Total_Allocation > 0 THEN MP_Total_Disbursed / MP_Total_Allocation * 100
                 ELSE 0.0 END AS MP_Budget_Utilization_Percent
        FROM (SELECT MP_Name, sum(Recommended_Amount) AS MP_Total_Allocation,
                     sum(Sanction_Amount) AS MP_Total_Sanctioned,
                     sum(Disbursed_Amount) AS MP_Total_Disbursed,
                     count(Work_ID) AS MP_Total_Projects,
                     count(Completion_Date) AS MP_Completed_Projects
              FROM master GROUP BY MP_Name)))"""

GEOGRAPHY = """
geo AS MATERIALIZED (
  SELECT g.State, g.Constituency,
         'CONST_' || (row_number() OVER (ORDER BY g.State, g.Constituency) - 1) AS Constituency_ID,
         'DIST_' || (row_number() OVER (ORDER BY g.State, g.Constituency) - 1) AS District_Code,
         'CLUSTER_' || (n_nationkey % 5) AS Spatial_Cluster_ID,
         CAST(10 + (n_nationkey * 17) % 81 AS DOUBLE) AS Zone_Fraud_Risk_Score
  FROM (SELECT DISTINCT State, Constituency FROM master) g
  JOIN nation ON n_name = g.Constituency)"""

FULL = MASTER + "," + VENDORS + "," + GEOGRAPHY + """,
full_set AS MATERIALIZED (
  SELECT m.*, Constituency_ID, District_Code, Spatial_Cluster_ID, Zone_Fraud_Risk_Score,
         Vendor_Total_Projects_Count, Vendor_Avg_Timeline_Days, Vendor_Avg_Cost_Overrun_Ratio,
         Vendor_Quality_Rating, Vendor_Monopoly_Score, Vendor_Risk_Score,
         least(greatest(coalesce(Disbursed_Amount / nullif(Sanction_Amount, 0), 0.0), 0.0), 1.5)
           - CASE Work_Status WHEN 'Time Estimation' THEN 0.0 WHEN 'Sanction' THEN 0.15
               WHEN 'Vendor Identification' THEN 0.35 WHEN 'Physical Inspection' THEN 0.65
               WHEN 'Work partially Completed' THEN 0.85 WHEN 'Work Completed' THEN 1.0
               ELSE 0.0 END::DOUBLE AS Progress_Gap,
         3 - n_docs AS n_missing
  FROM master m LEFT JOIN vendors USING (Vendor_Name)
  LEFT JOIN geo USING (State, Constituency)),
signals AS MATERIALIZED (
  SELECT *,
    0.35 * (n_missing / 3.0::DOUBLE * 100)
      + 0.30 * CASE NOC_Status WHEN 'Pending' THEN 100.0 WHEN 'Not_Required' THEN 0.0
          WHEN 'Received' THEN 0.0 ELSE 40.0 END::DOUBLE
      + 0.15 * (n_issues / 2.0::DOUBLE * 100)
      + 0.20 * (100 - greatest(0.0::DOUBLE, least(100.0::DOUBLE, coalesce(Compliance_Score, 50.0))))
      AS compliance,
    0.45 * coalesce(Vendor_Risk_Score, 50.0)
      + 0.20 * greatest(0.0::DOUBLE, least(100.0::DOUBLE,
          (coalesce(Vendor_Monopoly_Score, 20.0) - 5) / 35.0 * 100))
      + 0.20 * greatest(0.0::DOUBLE, least(100.0::DOUBLE,
          (5 - coalesce(Vendor_Quality_Rating, 3.0)) / 4.0 * 100))
      + 0.15 * CASE WHEN coalesce(Vendor_Total_Projects_Count, 1) <= 1 THEN 60
          WHEN coalesce(Vendor_Total_Projects_Count, 1) <= 3 THEN 25 ELSE 0 END AS contractor,
    coalesce(Zone_Fraud_Risk_Score, (SELECT avg(Zone_Fraud_Risk_Score) FROM full_set), 47.0)
      AS spatial
  FROM full_set)"""

# Each feature of each work beside its reference: the imputed values of all works.
REFERENCE = FULL + """,
middle AS (SELECT median(Vendor_Avg_Cost_Overrun_Ratio) AS r, median(Vendor_Avg_Timeline_Days) AS t
           FROM full_set),
ref AS MATERIALIZED (
  SELECT feature, abs_value, (rank() OVER (PARTITION BY feature ORDER BY abs_value) - 1)
           / count(*) OVER (PARTITION BY feature) AS pct
  FROM (SELECT 'cost' AS feature, Cost_per_Unit AS abs_value FROM full_set
        UNION ALL SELECT 'overrun', coalesce(Vendor_Avg_Cost_Overrun_Ratio, r) FROM full_set, middle
        UNION ALL SELECT 'timeline', coalesce(Vendor_Avg_Timeline_Days, t) FROM full_set, middle
        UNION ALL SELECT 'sanction', Days_to_Sanction FROM full_set
        UNION ALL SELECT 'gap', abs(Progress_Gap) FROM full_set)),
ref_one AS MATERIALIZED (SELECT DISTINCT feature, abs_value, pct FROM ref),
extremes AS MATERIALIZED (
  SELECT f.Work_ID,
         100 * greatest(a.pct, coalesce(b.pct, 0.5)) AS cost_anomaly,
         100 * greatest(c.pct, coalesce(d.pct, 0.5), e.pct) AS timeline_anomaly,
         e.pct AS gap_pct
  FROM full_set f
  JOIN ref_one a ON a.feature = 'cost' AND a.abs_value = Cost_per_Unit
  LEFT JOIN ref_one b ON b.feature = 'overrun' AND b.abs_value = Vendor_Avg_Cost_Overrun_Ratio
  JOIN ref_one c ON c.feature = 'sanction' AND c.abs_value = Days_to_Sanction
  LEFT JOIN ref_one d ON d.feature = 'timeline' AND d.abs_value = Vendor_Avg_Timeline_Days
  JOIN ref_one e ON e.feature = 'gap' AND e.abs_value = abs(Progress_Gap))"""

# Nearest other vector with the same label.
PAIRS = """
pairs AS MATERIALIZED (
  SELECT a.vec_id, b.vec_id AS other, a.label,
         list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
scores AS MATERIALIZED (
  SELECT e.vec_id, e.label, other, sim,
         CASE WHEN sim IS NULL OR sim <= 0.25 THEN 0.0 WHEN sim >= 0.45 THEN 100.0
           ELSE (sim - 0.25) / (0.45 - 0.25) * 100 END::DOUBLE AS risk
  FROM embeddings e LEFT JOIN (
    SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id
      ORDER BY round(sim, 12) DESC, other) = 1) p ON e.vec_id = p.vec_id AND e.label > 0)"""

# Words of texts weighted by their rarity, and each text's nearest other text of its block.
# The texts come from a table ``texts`` (id, block, text); a null block is not searched.
WORDS = r"""
tokens AS MATERIALIZED (
  SELECT id, block, word, count(*) AS n FROM (
    SELECT id, block, unnest(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+')) AS word
    FROM texts) WHERE word <> '' GROUP BY 1, 2, 3),
rarity AS MATERIALIZED (
  SELECT word, ln(((SELECT count(*) FROM texts) + 1.0)::DOUBLE / (count(*) + 1)) AS idf FROM tokens GROUP BY 1),
weighted AS MATERIALIZED (SELECT id, block, word, n * idf AS w FROM tokens JOIN rarity USING (word)),
lengths AS MATERIALIZED (SELECT id, block, sqrt(sum(w * w)) AS length FROM weighted GROUP BY 1, 2),
unit AS MATERIALIZED (
  SELECT id, block, word, w / length AS w FROM weighted JOIN lengths USING (id, block) WHERE w > 0),
shared AS MATERIALIZED (
  SELECT a.id, b.id AS other, round(sum(a.w * b.w), 12) AS sim
  FROM unit a JOIN unit b ON a.block = b.block AND a.word = b.word AND a.id <> b.id GROUP BY 1, 2),
firsts AS MATERIALIZED (  -- what a text that shares no word with any other is nearest to
  SELECT block, list(id ORDER BY id)[1:2] AS two FROM lengths WHERE block IS NOT NULL GROUP BY 1),
closest AS MATERIALIZED (
  SELECT id, other, sim FROM shared QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) = 1),
found AS MATERIALIZED (
  SELECT l.id, coalesce(CASE WHEN sim > 0 THEN other END,
           CASE WHEN two[1] = l.id THEN two[2] ELSE two[1] END) AS other,
         greatest(coalesce(sim, 0.0), 0.0)::DOUBLE AS sim
  FROM lengths l JOIN firsts USING (block) LEFT JOIN closest c ON c.id = l.id WHERE len(two) > 1),
texts_found AS MATERIALIZED (
  SELECT t.id, f.other, coalesce(f.sim, 0.0) AS sim, f.other IS NOT NULL AS checked,
         CASE WHEN f.sim IS NULL OR f.sim <= 0.85 THEN 0.0 WHEN f.sim >= 0.98 THEN 100.0
           ELSE (f.sim - 0.85) / (0.98 - 0.85) * 100 END::DOUBLE AS risk
  FROM texts t LEFT JOIN found f USING (id))"""

# Two trees of known nodes, and the signals they complete.
KNOWN = FULL + """,
paths AS MATERIALIZED (
  SELECT *, ((CASE WHEN coalesce(Cost_per_Unit, 0) <= 2000 THEN 6.0
                WHEN coalesce(Progress_Gap, 0) <= 0.5 THEN 3.0 ELSE 2.0 END)::DOUBLE
             + (CASE WHEN coalesce(Days_to_Sanction, 0) <= 30 THEN 5.0 ELSE 3.5 END)::DOUBLE) / 2
           AS path
  FROM signals),
scored AS MATERIALIZED (
  SELECT *, -pow(2.0::DOUBLE, -path / (2 * (ln(255.0::DOUBLE) + 0.5772156649015329)
                                       - 2 * 255 / 256.0::DOUBLE)) AS raw_score,
         CASE WHEN Days_to_Sanction % 2 = 0 THEN Sanction_Amount % 101 ELSE 0.0 END::DOUBLE AS duplicate
  FROM paths),
placed AS MATERIALIZED (
  SELECT path, sum(n) OVER (ORDER BY path) - n AS lt, n, sum(n) OVER () AS total
  FROM (SELECT path, count(*) AS n FROM paths GROUP BY path)),
blended AS MATERIALIZED (
  SELECT scored.*, greatest(0.0::DOUBLE, least(100.0::DOUBLE,
           (1 - (lt + (n + 1) / 2.0::DOUBLE) / total::DOUBLE) * 100)) AS anomaly
  FROM scored JOIN placed USING (path))"""

WORK_COLUMNS = """Work_ID, House, MP_Name, Vendor_Name, State, Constituency, Work_Status,
  Sanction_Amount, Disbursed_Amount"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


ORACLES: dict[str, str] = {
    # ------------------------------------------------------------------ clean-up
    "work_id_extract": """
        WITH cells AS (
          SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
            CASE l_linenumber % 4
              WHEN 0 THEN 'WS/ MP' || l_suppkey || '/2024-2025/' || l_orderkey || '-Road'
              WHEN 1 THEN 'AB ' || l_orderkey || '-' || l_returnflag || '-x'
              WHEN 2 THEN ' work ' || l_partkey || ' '
              ELSE NULL END AS cell FROM lineitem)
        SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          CASE l_linenumber % 4
            WHEN 0 THEN 'WS/MP' || l_suppkey || '/2024-2025/' || l_orderkey
            WHEN 1 THEN 'AB' || l_orderkey
            WHEN 2 THEN 'work ' || l_partkey END AS work_id FROM cells""",
    "currency_clean": """
        SELECT o_orderkey,
          CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN floor(o_totalprice)
            WHEN 2 THEN 0.0 ELSE 0.0 END AS amount FROM orders""",
    "token_split": """
        SELECT doc_id,
          len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, E' \\t\\n\\r')),
              lambda x: x <> '')) AS n_tokens,
          list_filter(list_transform(string_split(text, ','), lambda x: trim(x, E' \\t\\n\\r')),
              lambda x: x <> '')[1] AS first_token
        FROM documents""",
    "date_parse": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL
          ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS parsed FROM orders""",
    # ------------------------------------------------------------------------ ETL
    "dedupe_first": _with(LINES, """
        SELECT Work_ID, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM first_line"""),
    "expenditure_per_work": _with(LINES, "SELECT * FROM paid"),
    "master_join": _with(MASTER, """
        SELECT Work_ID, House, MP_Name, Vendor_Name, State, Constituency, Work_Description,
          Work_Status, Recommended_Date, Sanction_Date, Completion_Date, Recommended_Amount,
          Sanction_Amount, Disbursed_Amount FROM master"""),
    "etl_from_csv": _with(MASTER, """
        SELECT Work_ID, House,
          CASE WHEN House = 'Rajya Sabha' THEN 'Nominated' ELSE 'Elected' END
            AS Elected_or_Nominated,
          MP_Name, Vendor_Name, State, Constituency, Work_Description, Work_Status,
          Recommended_Date, Sanction_Date, Completion_Date, Days_to_Sanction, Days_to_Complete,
          Days_Pending, Recommended_Amount, Sanction_Amount, Disbursed_Amount,
          Cost_Overrun_Amount FROM master"""),
    "star_roundtrip_csv": _with(FULL, """
        SELECT Work_ID, Constituency_ID, Calamity_Flag, Recommended_Date, Completion_Date,
          Days_to_Sanction, Days_to_Complete, Days_Pending, Sanction_Amount, Work_Quantity
        FROM full_set"""),
    "date_spans": _with(MASTER, """
        SELECT Work_ID, Days_to_Sanction, Days_to_Complete, Days_Pending FROM master"""),
    "overruns": _with(MASTER, """
        SELECT Work_ID, Cost_Overrun_Amount, round(Cost_Overrun_Ratio, 9) AS Cost_Overrun_Ratio,
          round(Cost_per_Unit, 6) AS Cost_per_Unit FROM master"""),
    "mp_dimension": _with(MASTER + "," + MEMBERS, """
        SELECT MP_Name, MP_Total_Allocation, MP_Total_Sanctioned, MP_Total_Disbursed,
          MP_Total_Projects, MP_Completed_Projects,
          round(MP_Completion_Rate, 9) AS MP_Completion_Rate,
          round(MP_Budget_Utilization_Percent, 9) AS MP_Budget_Utilization_Percent,
          MP_Performance_Rank FROM members"""),
    "vendor_dimension": _with(MASTER + "," + VENDORS, """
        SELECT Vendor_Name, Vendor_Total_Projects_Count,
          round(Vendor_Avg_Timeline_Days, 6) AS Vendor_Avg_Timeline_Days,
          Vendor_Avg_Cost_Overrun_Ratio FROM vendors"""),
    "geo_keys": _with(MASTER + "," + GEOGRAPHY, """
        SELECT State, Constituency, Constituency_ID, District_Code FROM geo"""),
    # --------------------------------------------------------------------- browse
    "list_works": _with(MASTER, f"""
        SELECT {WORK_COLUMNS} FROM master ORDER BY Work_ID LIMIT 50 OFFSET 100"""),
    "list_works_filtered": _with(MASTER, f"""
        SELECT {WORK_COLUMNS} FROM master
        WHERE lower(State) = 'asia' AND lower(Work_Status) = 'work completed'
          AND contains(lower(Work_Description), 'ring')
          AND Sanction_Amount >= 20000 AND Sanction_Amount <= 90000 AND NOT Calamity_Flag
        ORDER BY Disbursed_Amount DESC NULLS LAST, Work_ID LIMIT 100"""),
    "works_total": _with(MASTER, """
        SELECT count(*) AS total FROM master WHERE contains(lower(Work_Description), 'ring')
          OR contains(lower(Work_ID), 'ring')"""),
    "list_members": _with(MASTER + "," + MEMBERS, """
        SELECT MP_Name, MP_Total_Projects, MP_Performance_Rank FROM members
        WHERE contains(lower(MP_Name), '#0000000') ORDER BY MP_Performance_Rank, MP_Name LIMIT 50"""),
    "list_vendors": _with(MASTER + "," + VENDORS, """
        SELECT Vendor_Name, Vendor_Total_Projects_Count,
          round(Vendor_Risk_Score, 6) AS Vendor_Risk_Score FROM vendors
        WHERE Vendor_Risk_Score >= 20 ORDER BY vendors.Vendor_Risk_Score DESC, Vendor_Name LIMIT 50"""),
    "list_geography": _with(MASTER + "," + GEOGRAPHY, """
        SELECT State, Constituency, Constituency_ID, Zone_Fraud_Risk_Score FROM geo
        WHERE Zone_Fraud_Risk_Score >= 30 ORDER BY Zone_Fraud_Risk_Score DESC, State, Constituency
        LIMIT 50"""),
    "work_detail": _with(FULL, """
        SELECT Work_ID, Vendor_Name, Constituency_ID, Spatial_Cluster_ID, NOC_Status,
          round(Progress_Gap, 9) AS Progress_Gap, Vendor_Total_Projects_Count
        FROM full_set WHERE Work_ID = (SELECT min(Work_ID) FROM full_set)"""),
    "constituency_detail": _with(MASTER + "," + GEOGRAPHY, """
        SELECT State, Constituency, Constituency_ID, Zone_Fraud_Risk_Score FROM geo
        WHERE State = 'ASIA' AND Constituency_ID = (SELECT Constituency_ID FROM geo
          WHERE State = 'ASIA' ORDER BY Constituency LIMIT 1)"""),
    "member_detail": _with(MASTER + "," + MEMBERS, """
        SELECT m.MP_Name, MP_Total_Projects, MP_Performance_Rank, Work_ID, Work_Status, State,
          Constituency, Sanction_Amount, Disbursed_Amount
        FROM members m JOIN master w ON w.MP_Name = m.MP_Name
        WHERE m.MP_Name = 'Customer#000000007'"""),
    "vendor_detail": _with(MASTER + "," + VENDORS, """
        SELECT v.Vendor_Name, Vendor_Total_Projects_Count,
          count(*) OVER () AS works_count, Work_ID, Work_Status, Sanction_Amount
        FROM vendors v JOIN master w ON w.Vendor_Name = v.Vendor_Name
        WHERE v.Vendor_Name = 'Supplier#000000003' ORDER BY Work_ID LIMIT 20"""),
    "overview": _with(MASTER + "," + MEMBERS + "," + VENDORS + "," + GEOGRAPHY, """
        SELECT count(*) AS total_works, (SELECT count(*) FROM members) AS total_mps,
          (SELECT count(*) FROM vendors) AS total_vendors,
          (SELECT count(*) FROM geo) AS total_constituencies,
          sum(Recommended_Amount) AS total_recommended_amount,
          sum(Sanction_Amount) AS total_sanctioned_amount,
          sum(Disbursed_Amount) AS total_disbursed_amount,
          round(avg(Cost_Overrun_Ratio), 3) AS avg_cost_overrun_ratio,
          round(avg(Days_to_Sanction), 1) AS avg_days_to_sanction,
          count(*) FILTER (WHERE Calamity_Flag) AS calamity_flagged_works FROM master"""),
    "value_counts": _with(MASTER, """
        SELECT 'Work_Status' AS field, Work_Status AS value, count(*) AS n FROM master GROUP BY 2
        UNION ALL SELECT 'State', State, count(*) FROM master GROUP BY 2
        UNION ALL SELECT 'House', House, count(*) FROM master GROUP BY 2"""),
    # ------------------------------------------------------------------- features
    "master_features": _with(FULL, """
        SELECT Work_ID, Constituency_ID, Spatial_Cluster_ID, Vendor_Total_Projects_Count,
          round(Vendor_Risk_Score, 6) AS Vendor_Risk_Score, NOC_Status,
          round(Compliance_Score, 6) AS Compliance_Score, round(Progress_Gap, 9) AS Progress_Gap,
          n_docs AS Docs_Submitted_Count, n_issues AS Issues_Count FROM full_set"""),
    "progress_gap": _with(FULL, """
        SELECT Work_ID, round(Progress_Gap, 9) AS Progress_Gap FROM full_set"""),
    "doc_flags": _with(MASTER, """
        SELECT Work_ID, n_docs >= 1 AS Doc_Site_Plan, n_docs = 3 AS Doc_Utilization_Cert,
          n_docs >= 2 AS Doc_NOC, n_docs AS Docs_Submitted_Count, 3 - n_docs AS Docs_Missing_Count,
          n_issues = 2 AS Issue_Weather_delays, n_issues >= 1 AS Issue_Vendor_issues,
          n_issues AS Issues_Count FROM master"""),
    "impute_vendor": _with(FULL, """
        SELECT Work_ID,
          round(coalesce(Vendor_Avg_Cost_Overrun_Ratio, r), 6) AS Vendor_Avg_Cost_Overrun_Ratio,
          round(coalesce(Vendor_Avg_Timeline_Days, t), 6) AS Vendor_Avg_Timeline_Days,
          Vendor_Avg_Cost_Overrun_Ratio IS NULL AS Vendor_Avg_Cost_Overrun_Ratio_missing,
          Vendor_Avg_Timeline_Days IS NULL AS Vendor_Avg_Timeline_Days_missing
        FROM full_set, (SELECT median(Vendor_Avg_Cost_Overrun_Ratio) AS r,
                               median(Vendor_Avg_Timeline_Days) AS t FROM full_set)"""),
    "retention": _with(FULL, """
        SELECT count(*) AS rows_before, count(*) FILTER (WHERE Cost_per_Unit IS NOT NULL
          AND Days_to_Sanction IS NOT NULL AND Progress_Gap IS NOT NULL) AS rows_kept FROM full_set"""),
    # -------------------------------------------------------------------- signals
    "compliance_score": _with(FULL, "SELECT Work_ID, round(compliance, 6) AS compliance FROM signals"),
    "contractor_score": _with(FULL, "SELECT Work_ID, round(contractor, 6) AS contractor FROM signals"),
    "spatial_score": _with(FULL, "SELECT Work_ID, round(spatial, 6) AS spatial FROM signals"),
    "composite_rules": _with(FULL, """
        SELECT Work_ID, round(0.20 * compliance + 0.20 * contractor + 0.15 * spatial, 6) AS composite
        FROM signals"""),
    "risk_level": _with(FULL, """
        SELECT Work_ID, CASE WHEN compliance >= 75 THEN 'Critical' WHEN compliance >= 50 THEN 'High'
          WHEN compliance >= 25 THEN 'Medium' ELSE 'Low' END AS level,
          CASE WHEN compliance >= 75 THEN 'AUDIT / FIELD VERIFICATION'
            WHEN compliance >= 50 THEN 'Priority review by compliance officer'
            WHEN compliance >= 25 THEN 'Routine monitoring' ELSE 'No action required' END AS action
        FROM signals"""),
    "severity": _with(FULL, """
        SELECT Work_ID, CASE WHEN contractor >= 70 THEN 'critical' WHEN contractor >= 40 THEN 'warning'
          END AS severity FROM signals"""),
    "top_reasons": _with(FULL, """
        , entries AS (
          SELECT Work_ID, compliance AS s, 0 AS pos, 'Compliance gaps' AS head FROM signals
            WHERE compliance > 40
          UNION ALL SELECT Work_ID, contractor, 1, 'Vendor track record risk' FROM signals
            WHERE contractor > 40
          UNION ALL SELECT Work_ID, spatial, 3, 'Located in a geographic zone' FROM signals
            WHERE spatial > 60),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY Work_ID ORDER BY s DESC, pos) AS n
                   FROM entries)
        SELECT f.Work_ID, coalesce(a.head, 'No individual signal') AS first, b.head AS second,
          c.head AS third
        FROM signals f LEFT JOIN ranked a ON a.Work_ID = f.Work_ID AND a.n = 1
        LEFT JOIN ranked b ON b.Work_ID = f.Work_ID AND b.n = 2
        LEFT JOIN ranked c ON c.Work_ID = f.Work_ID AND c.n = 3""").replace("\n        , entries",
                                                                        ", entries", 1),
    # ---------------------------------------------------------------------- ranks
    "pct_rank_avg": """
        SELECT event_id, round((rank() OVER w - 1
          + (count(*) OVER (PARTITION BY value) + 1) / 2.0) / count(*) OVER (), 9) AS pct
        FROM events WINDOW w AS (ORDER BY value)""",
    "pct_vs_reference": """
        WITH placed AS (
          SELECT event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (
                   ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 - sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (
                     PARTITION BY value) AS lt,
                 sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER () AS n FROM events)
        SELECT event_id, round(CAST(lt AS DOUBLE) / n, 9) AS pct FROM placed""",
    "pct_vs_sketch": "SELECT event_id, true AS within FROM events",
    "pct_two_sided": _with(REFERENCE, "SELECT Work_ID, round(gap_pct, 9) AS pct FROM extremes"),
    "performance_rank": """
        SELECT event_id, CAST(rank() OVER (ORDER BY value DESC) AS INTEGER) AS place FROM events""",
    "group_medians": """
        SELECT event_type, round(median(value), 9) AS median,
          round(quantile_cont(value, 0.05), 9) AS low FROM events GROUP BY event_type""",
    "peer_benchmark": _with(MASTER, """
        SELECT Work_ID, Work_Scope_Unit AS work_scope_unit,
          count(*) OVER u AS peer_group_size, round(med, 6) AS peer_median_cost_per_unit,
          round(Cost_per_Unit, 6) AS this_cost_per_unit,
          CASE WHEN Cost_per_Unit <> 0 THEN round(Cost_per_Unit / nullif(med, 0), 6) END
            AS cost_vs_peer_median_ratio,
          round((rank() OVER (PARTITION BY Work_Scope_Unit ORDER BY Cost_per_Unit) - 1)
            / count(*) OVER u, 9) AS cost_percentile_vs_peers
        FROM master JOIN (SELECT Work_Scope_Unit, median(Cost_per_Unit) AS med FROM master
                          GROUP BY 1) USING (Work_Scope_Unit)
        WINDOW u AS (PARTITION BY Work_Scope_Unit)"""),
    "cost_anomaly": _with(REFERENCE, """
        SELECT Work_ID, round(cost_anomaly, 6) AS cost_anomaly FROM extremes"""),
    "timeline_anomaly": _with(REFERENCE, """
        SELECT Work_ID, round(timeline_anomaly, 6) AS timeline_anomaly FROM extremes"""),
    "why_panel": _with(REFERENCE, """
        , entries AS (
          SELECT Work_ID, 'Cost anomaly' AS label, cost_anomaly AS s, 1 AS pos FROM extremes
          UNION ALL SELECT Work_ID, 'Timeline anomaly', timeline_anomaly, 2 FROM extremes
          UNION ALL SELECT Work_ID, 'Compliance gaps', compliance, 3 FROM signals)
        SELECT Work_ID, label, CASE WHEN s >= 70 THEN 'critical' ELSE 'warning' END AS severity
        FROM entries WHERE s >= 40""").replace("\n        , entries", ", entries", 1),
    # ----------------------------------------------------------------- similarity
    "duplicate_nearest": _with(PAIRS, """
        SELECT vec_id, other AS nearest_id, round(coalesce(sim, 0.0), 6) AS similarity,
          round(risk, 6) AS risk, other IS NOT NULL AS checked FROM scores"""),
    "dup_rate": _with(PAIRS, """
        SELECT count(*) AS works, count(*) FILTER (WHERE risk > 0) AS flagged,
          round(count(*) FILTER (WHERE risk > 0) / count(*), 9) AS rate FROM scores"""),
    "vendor_flagged": _with(PAIRS, """
        SELECT 'V' || label AS Vendor_Name,
          count(*) FILTER (WHERE risk > 0) AS other_flagged_duplicate_count
        FROM scores WHERE label > 0 GROUP BY 1"""),
    "nearby_top5": """
        WITH keyed AS (SELECT vec_id, embedding::DOUBLE[] AS v,
            CASE WHEN label % 3 <> 0 THEN 'k' || label END AS cluster, 'c' || (label % 4) AS place
          FROM embeddings),
        pairs AS (
          SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.v, b.v) AS sim
          FROM keyed a JOIN keyed b ON a.vec_id <> b.vec_id AND a.cluster = b.cluster
          UNION ALL
          SELECT a.vec_id, b.vec_id, list_cosine_similarity(a.v, b.v)
          FROM keyed a JOIN keyed b ON a.vec_id <> b.vec_id AND a.place = b.place
          WHERE a.cluster IS NULL)
        SELECT vec_id, other AS nearest_id, round(sim, 6) AS similarity,
          CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, other) AS INTEGER)
            AS place
        FROM pairs QUALIFY place <= 5""",
    "new_work_nearest": """
        WITH pairs AS (
          SELECT a.vec_id, b.vec_id AS other,
            list_cosine_similarity(list_reverse(a.embedding::DOUBLE[]), b.embedding::DOUBLE[]) AS sim
          FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.label > 0)
        SELECT e.vec_id, other AS nearest_id, round(coalesce(sim, 0.0), 6) AS similarity,
          other IS NOT NULL AS checked
        FROM embeddings e LEFT JOIN (SELECT * FROM pairs QUALIFY row_number() OVER (
          PARTITION BY vec_id ORDER BY round(sim, 12) DESC, other) = 1) p ON e.vec_id = p.vec_id""",
    "text_duplicates": _with("texts AS (SELECT doc_id AS id, lang AS block, text FROM documents)," + WORDS, """
        SELECT id AS Work_ID, lang AS Constituency, other AS nearest_duplicate_work_id,
          round(sim, 6) AS nearest_similarity, round(risk, 4) AS duplicate_risk_score,
          checked AS duplicate_checked
        FROM texts_found JOIN documents ON doc_id = id"""),
    "duplicate_lookup": _with(MASTER + """, texts AS MATERIALIZED (
        SELECT Work_ID AS id, CASE WHEN Vendor_Name <> 'Unknown' THEN Vendor_Name || '|' || Constituency
          END AS block, Work_Description AS text FROM master),""" + WORDS, """
        SELECT Work_ID, Vendor_Name, Constituency, round(risk, 4) AS duplicate_risk_score,
          other AS nearest_duplicate_work_id, round(sim, 6) AS nearest_similarity,
          checked AS duplicate_checked
        FROM texts_found JOIN master ON Work_ID = id"""),
    # ------------------------------------------------------------------- requests
    "what_if_overlay": _with(FULL, """
        SELECT Work_ID,
          CASE WHEN Calamity_Flag THEN 'Pending' ELSE NOC_Status END AS NOC_Status,
          CASE WHEN House = 'Rajya Sabha' THEN 2 * Disbursed_Amount ELSE Disbursed_Amount END
            AS Disbursed_Amount, Sanction_Amount, Vendor_Name, true AS on_record,
          round(least(coalesce(CASE WHEN House = 'Rajya Sabha' THEN 2 * Disbursed_Amount
              ELSE Disbursed_Amount END / nullif(Sanction_Amount, 0), 0.0), 1.5)
            - (least(greatest(coalesce(Disbursed_Amount / nullif(Sanction_Amount, 0), 0.0), 0.0), 1.5)
               - Progress_Gap), 9) AS Progress_Gap
        FROM full_set"""),
    "contractor_history": _with(FULL, """
        SELECT Work_ID, Vendor_Name AS vendor_name, Vendor_Total_Projects_Count AS total_projects,
          round(Vendor_Avg_Timeline_Days, 6) AS avg_timeline_days,
          round(Vendor_Quality_Rating, 6) AS quality_rating,
          round(Vendor_Risk_Score, 6) AS vendor_risk_score FROM full_set"""),
    # ------------------------------------------------------- around the models
    "forest_scores_known": _with(KNOWN, """
        SELECT Work_ID, round(raw_score, 9) AS raw_score,
               CASE WHEN raw_score < -0.75 THEN -1 ELSE 1 END AS label FROM scored"""),
    "composite_known": _with(KNOWN, """
        SELECT Work_ID, round(anomaly, 6) AS anomaly, round(duplicate, 6) AS duplicate,
          round(c, 6) AS composite,
          CASE WHEN l >= 75 THEN 'Critical' WHEN l >= 50 THEN 'High' WHEN l >= 25 THEN 'Medium'
            ELSE 'Low' END AS level,
          CASE WHEN l >= 75 THEN 'AUDIT / FIELD VERIFICATION'
            WHEN l >= 50 THEN 'Priority review by compliance officer'
            WHEN l >= 25 THEN 'Routine monitoring' ELSE 'No action required' END AS action
        FROM (SELECT *, round(c, 9) AS l FROM (
          SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.25 * anomaly + 0.20 * compliance
            + 0.20 * contractor + 0.15 * spatial + 0.20 * duplicate)) AS c FROM blended))"""),
    "feature_scaling": _with(REFERENCE, """
        SELECT feature, round(avg(v), 6) AS mean,
          round(CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END, 6) AS sd
        FROM (
          SELECT unnest(['Cost_per_Unit', 'Vendor_Avg_Cost_Overrun_Ratio', 'Vendor_Avg_Timeline_Days',
                         'Days_to_Sanction', 'Progress_Gap', 'Vendor_Avg_Cost_Overrun_Ratio_missing',
                         'Vendor_Avg_Timeline_Days_missing']) AS feature,
                 unnest([Cost_per_Unit::DOUBLE, coalesce(Vendor_Avg_Cost_Overrun_Ratio, r)::DOUBLE,
                         coalesce(Vendor_Avg_Timeline_Days, t)::DOUBLE, Days_to_Sanction::DOUBLE,
                         Progress_Gap::DOUBLE, (Vendor_Avg_Cost_Overrun_Ratio IS NULL)::INT::DOUBLE,
                         (Vendor_Avg_Timeline_Days IS NULL)::INT::DOUBLE]) AS v
          FROM full_set, middle
          WHERE Cost_per_Unit IS NOT NULL AND Days_to_Sanction IS NOT NULL
            AND Progress_Gap IS NOT NULL)
        GROUP BY feature"""),
    "train_test_split": _with(MASTER, """
        SELECT Work_ID, CASE WHEN ('0x' || substr(md5('42|' || Work_ID), 1, 8))::BIGINT % 100 < 80
          THEN 'train' ELSE 'test' END AS part FROM master"""),
    "regression_metrics": _with(MASTER, """
        SELECT round(avg(e), 1) AS mse, round(1 - sum(e) / sum(d), 9) AS r2
        FROM (SELECT (Sanction_Amount - Disbursed_Amount) ** 2 AS e,
                     (Disbursed_Amount - (SELECT avg(Disbursed_Amount) FROM master)) ** 2 AS d
              FROM master)"""),
    "cross_check_inputs": _with(FULL, """
        SELECT Work_ID, round(Cost_per_Unit::DOUBLE, 6) AS Cost_per_Unit,
          Days_to_Sanction::DOUBLE AS Days_to_Sanction, round(Progress_Gap::DOUBLE, 6) AS Progress_Gap,
          round(Vendor_Risk_Score::DOUBLE, 6) AS Vendor_Risk_Score,
          (Vendor_Avg_Timeline_Days IS NULL)::INT::DOUBLE AS Vendor_Avg_Timeline_Days_missing,
          round(Zone_Fraud_Risk_Score::DOUBLE, 6) AS Zone_Fraud_Risk_Score,
          round(Compliance_Score::DOUBLE, 6) AS Compliance_Score,
          Vendor_Total_Projects_Count::DOUBLE AS Vendor_Total_Projects_Count,
          coalesce(Calamity_Flag, false)::INT::DOUBLE AS Calamity_Flag,
          coalesce(NOC_Status, 'Missing') AS NOC_Status, coalesce(House, 'Missing') AS House
        FROM signals"""),
}
ORACLES |= {f"{name}_cells": ORACLES[name] for name in ("duplicate_nearest", "nearby_top5")}


# ------------------------------------------------ scores and reports by known models
def _half_up(value: str, digits: int) -> str:
    """Rounded as the decimal text of the number says."""
    return f"round(({value})::VARCHAR::DECIMAL(34, 16), {digits})::DOUBLE"


_PARTS = ("anomaly", "compliance", "contractor", "spatial", "duplicate")
_LEVEL = """CASE WHEN {0} >= 75 THEN 'Critical' WHEN {0} >= 50 THEN 'High'
  WHEN {0} >= 25 THEN 'Medium' ELSE 'Low' END"""
_REASONS = "\n    UNION ALL ".join(
    f"SELECT work_id, {name} AS s, {i} AS pos, '{REASON_TEXT[name]}' AS text FROM parts WHERE {name} > {limit}"
    for i, (name, limit) in enumerate((("compliance", 40), ("contractor", 40), ("anomaly", 60), ("spatial", 60))))
_DUPLICATE = REASON_TEXT["duplicate"]

RISK = REFERENCE + """,
paths AS MATERIALIZED (
  SELECT *, ((CASE WHEN coalesce(Cost_per_Unit, 0) <= 2000 THEN 6.0
                WHEN coalesce(Progress_Gap, 0) <= 0.5 THEN 3.0 ELSE 2.0 END)::DOUBLE
             + (CASE WHEN coalesce(Days_to_Sanction, 0) <= 30 THEN 5.0 ELSE 3.5 END)::DOUBLE) / 2 AS path
  FROM signals),
letters AS MATERIALIZED (
  SELECT *, [length(Work_Description) - length(replace(Work_Description, 'a', '')) + 0.5,
             length(Work_Description) - length(replace(Work_Description, 'e', '')) + 0.5,
             length(Work_Description) - length(replace(Work_Description, 'o', '')) + 0.5]::DOUBLE[] AS v
  FROM paths),
twins AS MATERIALIZED (  -- a new work's nearest stored work of the same vendor and place
  SELECT a.Work_ID, b.Work_ID AS other, list_cosine_similarity(a.v, b.v) AS sim
  FROM letters a JOIN letters b ON a.Vendor_Name = b.Vendor_Name AND a.Constituency = b.Constituency
  WHERE a.Vendor_Name <> 'Unknown'
  QUALIFY row_number() OVER (PARTITION BY a.Work_ID
    ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.Work_ID) = 1),
raw AS MATERIALIZED (
  SELECT Work_ID AS work_id, path, compliance, contractor, spatial,
         CASE WHEN Days_to_Sanction % 2 = 0 THEN Sanction_Amount % 101 ELSE 0.0 END::DOUBLE AS duplicate,
         Days_to_Sanction % 2 = 0 AS checked,
         CASE WHEN Days_to_Sanction % 2 = 0 THEN Work_ID || '-twin' END AS nearest_id,
         CASE WHEN Days_to_Sanction % 2 = 0 THEN 0.9 ELSE 0.0 END::DOUBLE AS similarity,
         30.0 + CASE WHEN Compliance_Score > 40 THEN -6.4 WHEN n_issues > 0 THEN 22.3 ELSE 4.0 END
           + CASE WHEN Cost_per_Unit <= 1000 THEN 1.5 WHEN NOC_Status = 'Pending' THEN 30.5 ELSE 2.7 END
           AS cross_check
  FROM paths
  UNION ALL
  SELECT 'NEW/' || p.Work_ID, ((CASE WHEN Cost_per_Unit <= 2000 THEN 6.0
             WHEN least(coalesce(Disbursed_Amount / nullif(Sanction_Amount, 0), 0.0), 1.5) - 0.35 <= 0.5
               THEN 3.0 ELSE 2.0 END)::DOUBLE + 5.0) / 2,
         0.35 * 100 + 0.30 * 100 + 0.15 * 50 + 0.20 * 50,
         0.45 * 50 + 0.20 * (15 / 35.0::DOUBLE * 100) + 0.20 * 50, 47.0,
         CASE WHEN sim IS NULL OR sim <= 0.85 THEN 0.0 WHEN sim >= 0.98 THEN 100.0
           ELSE (sim - 0.85) / (0.98 - 0.85) * 100 END::DOUBLE,
         sim IS NOT NULL, other, coalesce(sim, 0.0),
         30.0 + 22.3 + CASE WHEN Cost_per_Unit <= 1000 THEN 1.5 ELSE 30.5 END
  FROM paths p LEFT JOIN twins t ON t.Work_ID = p.Work_ID),
by_path AS MATERIALIZED (SELECT path, count(*) AS n FROM paths GROUP BY 1),
below AS MATERIALIZED (
  SELECT p.path, coalesce((SELECT sum(n) FROM by_path b WHERE b.path < p.path), 0)::DOUBLE
           / (SELECT sum(n) FROM by_path) AS pct
  FROM (SELECT DISTINCT path FROM raw) p),
parts AS MATERIALIZED (
  SELECT raw.*, greatest(0.0::DOUBLE, least(100.0::DOUBLE, (1 - pct) * 100)) AS anomaly,
         greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.25 * greatest(0.0::DOUBLE, least(100.0::DOUBLE, (1 - pct) * 100))
           + 0.20 * compliance + 0.20 * contractor + 0.15 * spatial + 0.20 * duplicate)) AS score
  FROM raw JOIN below USING (path)),
reasons AS MATERIALIZED (
  SELECT work_id, string_agg(text, ' | ' ORDER BY s DESC, pos) AS text FROM (
    SELECT * FROM (
    """ + _REASONS + """
    UNION ALL SELECT work_id, duplicate, 4, printf('""" + _DUPLICATE + """', similarity, nearest_id)
      FROM parts WHERE checked AND duplicate > 0)
    QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY s DESC, pos) <= 3)
  GROUP BY 1)"""

_ROUNDED = ", ".join(f"{_half_up(p, 2)} AS {p}" for p in _PARTS)

ORACLES["score_works_known"] = _with(RISK, f"""
    SELECT work_id, {_half_up("score", 2)} AS final_risk_score, {_LEVEL.format("score")} AS risk_level,
      {_ROUNDED}, checked, nearest_id, {_half_up("similarity", 3)} AS similarity,
      {_half_up("cross_check", 2)} AS cross_check_score,
      coalesce(text, '{NO_REASON}') || CASE WHEN abs(cross_check - score) > 25
        THEN ' | ' || printf('{DISAGREEMENT.replace("'", "''")}', cross_check, score) ELSE '' END AS factors
    FROM parts LEFT JOIN reasons USING (work_id)""")

_ICON = "CASE WHEN s >= 70 THEN 'critical; \U0001F534' ELSE 'warning; \U0001F7E0' END"

ORACLES["investigation_known"] = _with(RISK + f""",
panel AS MATERIALIZED (
  SELECT work_id, string_agg(label || '; ' || {_ICON} || '; ' || printf('%.2f', {_half_up("s", 2)})
           || coalesce('; ' || detail, ''), ' | ' ORDER BY {_half_up("s", 2)} DESC, pos) AS why
  FROM (
    SELECT work_id, 0 AS pos, 'Duplicate similarity' AS label, {_half_up("duplicate", 2)} AS s,
           CASE WHEN checked THEN printf('Similarity %.2f to %s', similarity, nearest_id) END AS detail FROM parts
    UNION ALL SELECT Work_ID, 1, 'Cost anomaly', cost_anomaly, '{WHY_TEXT["Cost anomaly"]}' FROM extremes
    UNION ALL SELECT Work_ID, 2, 'Timeline anomaly', timeline_anomaly, '{WHY_TEXT["Timeline anomaly"]}'
      FROM extremes
    UNION ALL SELECT work_id, 3, 'Compliance gaps', {_half_up("compliance", 2)}, '{WHY_TEXT["Compliance gaps"]}'
      FROM parts)
  WHERE s >= 40 GROUP BY 1),
shapes AS MATERIALIZED (
  SELECT Spatial_Cluster_ID AS place, v, list(Work_ID ORDER BY Work_ID)[1:6] AS ids FROM letters GROUP BY 1, 2),
around AS MATERIALIZED (
  SELECT place, v, id, sim FROM (
    SELECT a.place, a.v, unnest(b.ids) AS id, list_cosine_similarity(a.v, b.v) AS sim
    FROM shapes a JOIN shapes b ON a.place = b.place)
  QUALIFY row_number() OVER (PARTITION BY place, v ORDER BY round(sim, 12) DESC, id) <= 6),
near AS MATERIALIZED (
  SELECT w.Work_ID AS work_id, id, sim FROM letters w JOIN around ON place = Spatial_Cluster_ID AND around.v = w.v
  WHERE id <> w.Work_ID
  QUALIFY row_number() OVER (PARTITION BY w.Work_ID ORDER BY round(sim, 12) DESC, id) <= 5),
nearby AS MATERIALIZED (
  SELECT near.work_id, string_agg(id || '; ' || Vendor_Name || '; ' || Work_Status || '; '
           || printf('%.2f', {_half_up("Cost_per_Unit", 2)}) || '; ' || printf('%.3f', {_half_up("sim", 3)}),
           ' | ' ORDER BY round(sim, 12) DESC, id) AS nearby
  FROM near JOIN master ON master.Work_ID = id GROUP BY 1),
flagged AS MATERIALIZED (
  SELECT Vendor_Name, count(*) FILTER (WHERE Days_to_Sanction % 2 = 0 AND Sanction_Amount % 101 > 0) AS n
  FROM master WHERE Vendor_Name <> 'Unknown' GROUP BY 1),
peers AS MATERIALIZED (
  SELECT Work_ID, Work_Scope_Unit, count(*) OVER u AS size, med, Cost_per_Unit AS cost,
         (rank() OVER (PARTITION BY Work_Scope_Unit ORDER BY Cost_per_Unit) - 1) / count(*) OVER u AS pct
  FROM master JOIN (SELECT Work_Scope_Unit, median(Cost_per_Unit) AS med FROM master GROUP BY 1)
    USING (Work_Scope_Unit)
  WINDOW u AS (PARTITION BY Work_Scope_Unit))""", f"""
    SELECT p.work_id, {_half_up("score", 2)} AS risk_score, {_LEVEL.format("score")} AS risk_level,
      coalesce(why, '') AS why, coalesce(nearby, '') AS nearby, f.Vendor_Name AS vendor_name,
      Vendor_Total_Projects_Count AS total_projects,
      round(Vendor_Avg_Timeline_Days, 6) AS avg_timeline_days,
      round(Vendor_Avg_Cost_Overrun_Ratio, 6) AS avg_cost_overrun_ratio,
      round(Vendor_Quality_Rating, 6) AS quality_rating, round(Vendor_Risk_Score, 6) AS vendor_risk_score,
      Vendor_Monopoly_Score AS monopoly_score, n AS other_flagged_duplicate_count,
      peers.Work_Scope_Unit AS work_scope_unit, size AS peer_group_size,
      {_half_up("med", 2)} AS peer_median_cost_per_unit, {_half_up("cost", 2)} AS this_cost_per_unit,
      CASE WHEN cost <> 0 THEN {_half_up("cost / nullif(med, 0)", 2)} END AS cost_vs_peer_median_ratio,
      {_half_up("pct", 3)} AS cost_percentile_vs_peers,
      CASE {_LEVEL.format("score")} WHEN 'Critical' THEN 'AUDIT / FIELD VERIFICATION'
        WHEN 'High' THEN 'Priority review by compliance officer' WHEN 'Medium' THEN 'Routine monitoring'
        ELSE 'No action required' END AS recommended_action,
      {_half_up("cross_check", 2)} AS cross_check_score
    FROM parts p JOIN full_set f ON f.Work_ID = p.work_id JOIN peers ON peers.Work_ID = p.work_id
    LEFT JOIN panel ON panel.work_id = p.work_id LEFT JOIN nearby ON nearby.work_id = p.work_id
    LEFT JOIN flagged ON flagged.Vendor_Name = f.Vendor_Name""")


# --------------------------------------------------------------- two boosted trees
def _boosted(edges: dict[str, list[float]], base: float, rate: float, trees: int, depth: int) -> str:
    """Trees grown level by level: sums by node, feature and bin, every cut, the best one."""
    missing = max(map(len, edges.values())) + 1

    def bin_of(column: str, cuts: list[float]) -> str:
        below = " + ".join(f"({column} > {c})::INT" for c in cuts)
        return f"CASE WHEN {column} IS NULL THEN {missing} ELSE {below} END"

    bins = ", ".join(bin_of(c, cuts) for c, cuts in edges.items())
    sql = [MASTER, f"""boost0 AS MATERIALIZED (
  SELECT Work_ID, floor(Disbursed_Amount / 100)::DOUBLE AS y, {base}::DOUBLE AS p, [{bins}] AS f FROM master),
scale AS MATERIALIZED (
  SELECT pow(2.0, floor(log2(pow(2.0, 52) / (count(*) * 2 * greatest(max(y) - {base}, {base} - min(y),
    max(y) - min(y)))))) AS k FROM boost0)"""]
    for t in range(trees):
        rows = f"boost{t}n0"
        sql.append(f"""{rows} AS MATERIALIZED (
  SELECT *, 0 AS node, round((p - y) * k) AS g FROM boost{t}, scale)""")
        for level in range(depth):
            name = f"boost{t}c{level}"
            sql.append(f"""{name} AS MATERIALIZED (
  WITH hist AS (
    SELECT node, feature, bin, sum(g) AS g, count(*) AS n FROM (
      SELECT node, g, unnest(range({len(edges)})) AS feature, unnest(f) AS bin FROM {rows}
      WHERE node >= {(1 << level) - 1}) GROUP BY 1, 2, 3),
  cuts AS (
    SELECT node, feature, cut, side, sum(g) AS whole_g, sum(n) AS whole_n,
           coalesce(sum(g) FILTER (WHERE bin <= cut OR bin = {missing} AND side = 1), 0) AS lg,
           coalesce(sum(n) FILTER (WHERE bin <= cut OR bin = {missing} AND side = 1), 0) AS ln
    FROM hist, range({missing}) b(cut), (VALUES (1), (0)) s(side) GROUP BY 1, 2, 3, 4)
  SELECT *, lg * lg / (ln + 1.0) + (whole_g - lg) * (whole_g - lg) / (whole_n - ln + 1.0)
    - whole_g * whole_g / (whole_n + 1.0) AS gain
  FROM cuts WHERE ln > 0 AND ln < whole_n AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, cut, side DESC) = 1)""")
            after = f"boost{t}n{level + 1}"
            sql.append(f"""{after} AS MATERIALIZED (
  SELECT r.* REPLACE (CASE WHEN c.node IS NULL THEN r.node
      WHEN f[feature + 1] <= cut OR f[feature + 1] = {missing} AND side = 1 THEN 2 * r.node + 1
      ELSE 2 * r.node + 2 END AS node)
  FROM {rows} r LEFT JOIN {name} c ON c.node = r.node)""")
            rows = after
        sql.append(f"""boost{t + 1} AS MATERIALIZED (
  SELECT Work_ID, y, p - {rate} * (sum(g) OVER leaf / k) / (count(*) OVER leaf + 1.0) AS p, f
  FROM {rows} WINDOW leaf AS (PARTITION BY node))""")
    return _with(",\n".join(sql), f"SELECT Work_ID, round(p, 6) AS prediction FROM boost{trees}")


ORACLES["boosted_known"] = _boosted(
    {"Work_Quantity": [5.0, 10.0, 20.0, 30.0, 40.0], "Days_to_Complete": [20.0, 40.0, 60.0, 80.0],
     "Days_to_Sanction": [10.0, 20.0, 30.0]}, 300.0, 0.5, 2, 2)
