"""The normalised ``projects`` table built from the driver's star-schema tables.

The register has one row per funded project. On the test tables an order plays the
project (SURVEY 7.3): its customer is the recipient, the customer's market segment the
ministry, nation/region give state and country, the order date the start, the last
ship date of its lines the end, the first line's part the classification, and a
document with the same id (else the part name) the title.

Join plan (what matters at scale):
* ``lineitem`` is reduced to one row per order with a partial + final hash aggregate
  keyed on ``l_orderkey``; orders joins it on the same key.
* ``nation``/``region`` have a fixed row count (25 / 5) -> broadcast.
* ``customer``, ``part`` and ``documents`` grow with the data, so they are left to
  the planner: AQE broadcasts them only when their measured runtime size is under
  ``spark.sql.autoBroadcastJoinThreshold``, otherwise it shuffles. ``documents`` comes last,
  so that no other join shuffles the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.functions import normalize as N

PROJECT_COLUMNS = [
    "row_id", "fkz", "ministry", "unit", "sponsor", "work_unit", "recipient",
    "municipality_code", "municipality", "city", "state", "country", "executing_body",
    "title", "class_code", "class_text", "start_date", "end_date", "amount", "profile",
    "joint_name", "funding_type", "start_year", "end_year", "start_month", "decade",
    "duration_months", "is_joint",
]


PART_SPAN = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive(df: DataFrame) -> DataFrame:
    """Add the derived columns every analysis uses."""
    return (df
            .withColumn("start_year", F.year("start_date"))
            .withColumn("end_year", F.year("end_date"))
            .withColumn("start_month", F.month("start_date"))
            .withColumn("decade", N.decade("start_year"))
            .withColumn("duration_months", N.duration_months("start_date", "end_date"))
            .withColumn("is_joint", N.is_joint("joint_name")))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    geo = (table(spark, sf_dir, "nation")
           .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "n_name", "r_name"))
    # First line of the order: smallest line number, then (line numbers repeat) smallest
    # part. Packed into one BIGINT (part keys < 2^40) so the aggregate stays a hash
    # aggregate with a fixed-width buffer instead of a sort-based one over all lines.
    fits = F.col("l_partkey").between(0, PART_SPAN - 1) & F.col("l_linenumber").between(0, (1 << 22) - 1)
    packed = (F.when(fits, F.col("l_linenumber").cast("long") * F.lit(PART_SPAN) + F.col("l_partkey"))
              .otherwise(F.raise_error(F.lit("lineitem: part key or line number out of range")).cast("long")))
    lines = (table(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.max("l_shipdate").alias("last_ship"), F.min(packed).alias("_first"))
             .select("l_orderkey", "last_ship", (F.col("_first") % F.lit(PART_SPAN)).alias("first_part")))
    # One row per key by construction: Catalyst then knows the keys are unique and drops the
    # left join, and the scan under it, from every query that uses none of its columns.
    part = (table(spark, sf_dir, "part").groupBy("p_partkey")
            .agg(F.min("p_name").alias("p_name"), F.min("p_brand").alias("p_brand"), F.min("p_type").alias("p_type")))
    docs = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("text").alias("text"))

    j = (orders
         .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
         .join(customer, F.col("o_custkey") == F.col("c_custkey"))
         .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
         .join(part, F.col("first_part") == F.col("p_partkey"), "left")
         .join(docs, F.col("o_orderkey") == F.col("doc_id"), "left"))

    prio = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    region = F.col("r_name")
    base = j.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderkey").cast("string").alias("fkz"),
        F.col("c_mktsegment").alias("ministry"),
        F.concat(F.col("c_mktsegment"), F.lit("-"), status).alias("unit"),
        prio.alias("sponsor"),
        status.alias("work_unit"),
        F.col("c_name").alias("recipient"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("municipality_code"),
        F.col("n_name").alias("municipality"),
        F.concat(F.col("n_name"), F.lit("-"), (F.col("c_custkey") % 5).cast("string")).alias("city"),
        F.when(F.col("n_nationkey") % 9 == 0, F.lit("")).otherwise(F.col("n_name")).alias("state"),
        F.when(region.isin("EUROPE", "AMERICA"), F.lit("Deutschland"))
         .when(region == "ASIA", F.lit(""))
         .when(region == "AFRICA", F.lit(None).cast("string"))
         .otherwise(F.col("n_name")).alias("country"),
        F.col("c_name").alias("executing_body"),
        F.coalesce(F.col("text"), F.col("p_name")).alias("title"),
        F.col("p_brand").alias("class_code"),
        F.col("p_type").alias("class_text"),
        F.to_date("o_orderdate").alias("start_date"),
        F.to_date("last_ship").alias("end_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(prio == "5-LOW", F.lit(None).cast("string"))
         .when(prio == "4-NOT SPECIFIED", F.lit(""))
         .otherwise(prio.substr(3, 100)).alias("profile"),
        F.when(status == "F", F.concat(F.lit("VP-"), F.col("c_mktsegment"), F.lit("-"), prio))
         .when(status == "O", F.lit(""))
         .when(prio == "1-URGENT", F.lit(None).cast("string"))
         .when(prio == "2-HIGH", F.lit("nan"))
         .when(prio == "3-MEDIUM", F.lit("  "))
         .otherwise(F.concat(F.lit("VP-"), prio)).alias("joint_name"),
        status.alias("funding_type"),
    )
    return derive(base)


# DuckDB twin of ``projects`` for the oracle queries. Same columns, same rules.
PROJECTS_SQL = r"""
li AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part
  FROM lineitem GROUP BY l_orderkey
),
p0 AS (
  SELECT
    o.o_orderkey AS row_id,
    CAST(o.o_orderkey AS VARCHAR) AS fkz,
    c.c_mktsegment AS ministry,
    c.c_mktsegment || '-' || o.o_orderstatus AS unit,
    o.o_orderpriority AS sponsor,
    o.o_orderstatus AS work_unit,
    c.c_name AS recipient,
    lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS municipality_code,
    n.n_name AS municipality,
    n.n_name || '-' || CAST(c.c_custkey % 5 AS VARCHAR) AS city,
    CASE WHEN n.n_nationkey % 9 = 0 THEN '' ELSE n.n_name END AS state,
    CASE WHEN r.r_name IN ('EUROPE', 'AMERICA') THEN 'Deutschland'
         WHEN r.r_name = 'ASIA' THEN ''
         WHEN r.r_name = 'AFRICA' THEN NULL
         ELSE n.n_name END AS country,
    c.c_name AS executing_body,
    coalesce(d.text, pa.p_name) AS title,
    pa.p_brand AS class_code,
    pa.p_type AS class_text,
    CAST(o.o_orderdate AS DATE) AS start_date,
    CAST(li.last_ship AS DATE) AS end_date,
    CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL
         WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN ''
         ELSE substr(o.o_orderpriority, 3, 100) END AS profile,
    CASE WHEN o.o_orderstatus = 'F' THEN 'VP-' || c.c_mktsegment || '-' || o.o_orderpriority
         WHEN o.o_orderstatus = 'O' THEN ''
         WHEN o.o_orderpriority = '1-URGENT' THEN NULL
         WHEN o.o_orderpriority = '2-HIGH' THEN 'nan'
         WHEN o.o_orderpriority = '3-MEDIUM' THEN '  '
         ELSE 'VP-' || o.o_orderpriority END AS joint_name,
    o.o_orderstatus AS funding_type
  FROM orders o
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN (SELECT doc_id, min(text) AS text FROM documents GROUP BY doc_id) d ON o.o_orderkey = d.doc_id
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT p_partkey, min(p_name) AS p_name, min(p_brand) AS p_brand, min(p_type) AS p_type
             FROM part GROUP BY p_partkey) pa ON li.first_part = pa.p_partkey
),
projects AS (
  SELECT *,
    CAST(year(start_date) AS INTEGER) AS start_year,
    CAST(year(end_date) AS INTEGER) AS end_year,
    CAST(month(start_date) AS INTEGER) AS start_month,
    CAST(floor(year(start_date) / 10) * 10 AS INTEGER) AS decade,
    CASE WHEN start_date IS NOT NULL AND end_date IS NOT NULL
         THEN greatest(date_diff('day', start_date, end_date) / 30.44, 0.0) END AS duration_months,
    coalesce(trim(joint_name) <> '' AND joint_name <> 'nan', true) AS is_joint
  FROM p0
)
"""


# Two exports of the register for the snapshot diff (J4). The later export has the
# projects that started in the last month of data (added), and no longer lists the
# urgent, pending projects that started before March 1995 (withdrawn).
def snapshot_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects(spark, sf_dir).where(~(F.col("start_date") >= F.lit("2001-07-01").cast("date")))


def snapshot_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projects(spark, sf_dir)
    withdrawn = ((F.col("work_unit") == "P") & (F.col("sponsor") == "1-URGENT")
                 & (F.col("start_date") < F.lit("1995-03-01").cast("date")))
    return p.where(~withdrawn)


def snapshot_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later export with corrected cells: pending projects from 1997 on cost a tenth more, low-priority
    ones have a profile, and projects without a state are moved to another city."""
    n = snapshot_new(spark, sf_dir)
    dearer = (F.col("work_unit") == "P") & (F.col("start_year") >= 1997)
    raised = F.when(dearer, (F.col("amount") * F.lit(1.1).cast("decimal(2,1)")).cast("decimal(18,2)")).otherwise(F.col("amount"))
    profile = F.when((F.col("sponsor") == "5-LOW") & (F.col("funding_type") == "F"), F.lit("LOW")).otherwise(F.col("profile"))
    city = F.when((F.col("state") == "") & (F.col("start_year") == 1995), F.lit("MOVED")).otherwise(F.col("city"))
    return n.withColumns({"amount": raised, "profile": profile, "city": city})


SNAPSHOT_SQL = """
snap_old AS (SELECT * FROM projects WHERE NOT (start_date >= DATE '2001-07-01')),
snap_new AS (SELECT * FROM projects
             WHERE NOT (work_unit = 'P' AND sponsor = '1-URGENT' AND start_date < DATE '1995-03-01'))
"""

REVISED_SQL = """
snap_revised AS (SELECT * REPLACE (
  CASE WHEN work_unit = 'P' AND start_year >= 1997 THEN CAST(amount * 1.1 AS DECIMAL(18,2)) ELSE amount END AS amount,
  CASE WHEN sponsor = '5-LOW' AND funding_type = 'F' THEN 'LOW' ELSE profile END AS profile,
  CASE WHEN state = '' AND start_year = 1995 THEN 'MOVED' ELSE city END AS city) FROM snap_new)
"""
