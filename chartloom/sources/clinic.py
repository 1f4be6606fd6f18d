"""Chart entities as views over the driver's tables.

The SQL is in the dialect that Spark and the oracle share, so that an oracle
query can start from the very same views.  List columns are "|"-joined there;
``load`` turns them into arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.sources.tables import table

VIEWS = {
    "patient": (
        ("customer", "nation"),
        """SELECT CAST(c_custkey AS STRING) AS patient_id, 'M' || CAST(c_custkey AS STRING) AS medical_record_number, c_mktsegment AS first_name, c_name AS last_name,
        DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INT) AS date_of_birth, CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, c_custkey % 5 = 0 AS is_smoker,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE n_name END AS primary_clinician,
        CASE c_custkey % 4 WHEN 0 THEN 'Penicillin' WHEN 2 THEN 'Latex|Pollen' WHEN 3 THEN 'Dust' ELSE '' END AS allergies,
        CASE WHEN c_acctbal < 0 THEN 'Unpaid balance' ELSE '' END AS risk_flags, CASE WHEN c_custkey % 3 = 0 THEN 'smart_fhir' ELSE 'manual_entry' END AS source_kind
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    ),
    "record": (
        ("orders",),
        """SELECT CAST(o_orderkey AS STRING) AS record_id, CAST(o_custkey AS STRING) AS patient_id, o_orderdate AS date_recorded,
        CASE o_orderkey % 8 WHEN 0 THEN 'Melanoma in situ' WHEN 1 THEN 'Plaque Psoriasis' WHEN 2 THEN 'Atopic dermatitis' WHEN 3 THEN 'Rosacea ' WHEN 4 THEN 'Acne  vulgaris'
          WHEN 5 THEN 'Basal cell carcinoma' WHEN 6 THEN 'Kératose' ELSE 'keratose' END AS condition_name,
        CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Preliminary' ELSE 'Pending' END AS status, o_orderpriority AS severity,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Follow-up' END AS visit_type, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Itch reported at ' || o_orderpriority END AS cc_hpi,
        CASE o_orderkey % 8 WHEN 0 THEN ' D03.9' WHEN 5 THEN 'c44.91' WHEN 2 THEN 'L20.9' WHEN 4 THEN '' ELSE NULL END AS icd10_code,
        CASE o_orderstatus WHEN 'F' THEN 'signed' WHEN 'O' THEN 'draft' ELSE 'reviewed' END AS documentation_status,
        CASE o_orderkey % 6 WHEN 0 THEN 'scalp' WHEN 1 THEN 'neck|torso' WHEN 2 THEN 'left_hand' WHEN 3 THEN 'left_hand|left_hand' WHEN 4 THEN 'other' ELSE '' END AS zones
        FROM {orders}""",
    ),
    "medication": (
        ("lineitem", "orders", "part"),
        """SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS rx_id, CAST(o_custkey AS STRING) AS patient_id, p_name AS medication_name, p_type AS generic_name, p_brand AS indication,
        l_shipdate AS written_date, CASE l_returnflag WHEN 'A' THEN 'Active' WHEN 'N' THEN NULL ELSE 'Discontinued' END AS status, CAST(CAST(l_quantity AS INT) AS STRING) || ' mg' AS dose
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    ),
    "appointment": (
        ("events",),
        """SELECT CAST(event_id AS STRING) AS appointment_id, CAST(user_id AS STRING) AS patient_id, ts AS scheduled_time, event_type AS reason_for_visit,
        CASE event_type WHEN 'view' THEN 'Scheduled' WHEN 'click' THEN 'confirmed' WHEN 'purchase' THEN 'Completed' WHEN 'signup' THEN 'In Exam' ELSE 'Cancelled' END AS status, value
        FROM {events}""",
    ),
    "photo": (
        ("supplier",),
        """SELECT CAST(s_suppkey AS STRING) AS photo_id, CAST(s_suppkey % 50 AS STRING) AS patient_id, DATE '2024-01-01' + CAST(s_suppkey % 28 AS INT) AS capture_date,
        CASE s_nationkey % 5 WHEN 0 THEN 'scalp' WHEN 1 THEN 'neck' WHEN 2 THEN 'left_hand' WHEN 3 THEN 'chin' ELSE 'unmapped' END AS anatomical_region
        FROM {supplier}""",
    ),
}
LISTS = {"patient": ("allergies", "risk_flags"), "record": ("zones",)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    df = spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})
    for c in LISTS.get(name, ()):
        df = df.withColumn(c, F.filter(F.split(c, r"\|"), lambda x: x != ""))
    return df


def oracle(sql: str) -> str:
    """An oracle query that may use the views by name."""
    used = [n for n in VIEWS if f" {n} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace("(", " ").replace(",", " ")]
    views = ",\n".join(f"{n} AS ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in used)
    return f"WITH {views}\n{sql}" if views else sql
