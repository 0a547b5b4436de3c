"""Tables that hold the data of billing exports under other names, as canonical lines.

The SQL below is plain enough for Spark and DuckDB alike, so both derive the same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.functions.policy import Mapping

#: Events as billing lines: ids in mixed case, costs in several notations, tags that differ by resource and have gaps.
EVENT_LINES = """
SELECT event_id + 1 AS line_no, concat('export-', CAST(user_id % 7 AS STRING)) AS source,
  CASE WHEN event_id % 23 = 0 THEN 'N/A' WHEN event_id % 29 = 0 THEN '' WHEN event_id % 2 = 1 THEN concat('RES-', CAST(user_id AS STRING)) ELSE concat('Res-', CAST(user_id AS STRING)) END AS resource_id,
  CASE WHEN event_id % 31 = 0 THEN '' ELSE event_type END AS service,
  CASE WHEN user_id % 3 = 0 THEN 'aws' WHEN user_id % 3 = 1 THEN 'azure' ELSE '' END AS provider,
  concat('region-', CAST(event_id % 5 AS STRING)) AS region,
  CASE WHEN event_id % 11 = 0 THEN concat('(', CAST(value AS STRING), ')') WHEN event_id % 13 = 0 THEN concat('$', CAST(value AS STRING)) WHEN event_id % 17 = 0 THEN replace(CAST(value AS STRING), '.', ',')
       WHEN event_id % 19 = 0 THEN 'n.a' WHEN event_id % 37 = 0 THEN concat('-', CAST(value AS STRING)) WHEN event_id % 41 = 0 THEN '1.234,56' WHEN event_id % 43 = 0 THEN concat('$-', CAST(value AS STRING))
       WHEN event_id % 59 = 0 THEN '1,234' WHEN event_id % 61 = 0 THEN '1.2.3' WHEN event_id % 67 = 0 THEN '-900000' ELSE CAST(value AS STRING) END AS cost_raw,
  CASE WHEN event_id % 7 = 0 THEN ' usd ' WHEN event_id % 47 = 0 THEN 'N/A' ELSE 'USD' END AS currency,
  CASE WHEN event_id % 53 = 0 THEN 'Tax' WHEN event_id % 53 = 1 THEN 'Credit' WHEN event_id % 53 = 2 THEN 'RI Fee' ELSE 'Usage' END AS charge_type,
  CASE WHEN user_id % 4 = 0 THEN CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE '' END WHEN event_id % 3 = 0 THEN '' ELSE concat('owner-', CAST(user_id % 10 AS STRING)) END AS tag_owner,
  CASE user_id % 13 WHEN 0 THEN 'payments-team' WHEN 1 THEN 'team-payments' WHEN 2 THEN 'platform' WHEN 3 THEN 'plaform' WHEN 4 THEN 'CC-1042' WHEN 5 THEN 'CC-1043' WHEN 6 THEN concat('Platform', chr(160), ' ') WHEN 7 THEN 'TBD' WHEN 8 THEN '' WHEN 9 THEN 'data' WHEN 10 THEN 'database' ELSE concat('squad-', CAST(user_id % 3 AS STRING)) END AS tag_team,
  CASE user_id % 9 WHEN 0 THEN 'prod' WHEN 1 THEN 'PROD' WHEN 2 THEN 'production' WHEN 3 THEN 'dev' WHEN 4 THEN 'development' WHEN 5 THEN 'stage' WHEN 6 THEN 'unknown' WHEN 7 THEN concat(chr(160), ' prod') ELSE 'staging' END AS tag_environment,
  CASE WHEN user_id % 6 = 0 THEN '' WHEN event_id % 4 = 0 THEN '-' ELSE concat('CC-', CAST(1040 + user_id % 6 AS STRING)) END AS tag_cost_center,
  CASE WHEN event_id % 50 = 0 THEN '{"cc": "CC-77", "app": "shop"}' WHEN event_id % 50 = 1 THEN '"cc": "none","env": "prod"' WHEN event_id % 50 = 2 THEN 'null' WHEN event_id % 50 = 3 THEN '{broken' ELSE '' END AS tags_json
FROM events
"""

EVENT_MAPPING = Mapping(
    roles={r: r for r in ("resourceId", "service", "provider", "region", "cost", "currency", "chargeType")},
    tag_columns={k: f"tag_{k}" for k in ("owner", "team", "environment", "cost_center")},
    json_column="tags_json",
    json_keys={"cost_center": "cc"},
)


def _from_events(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = text.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return spark.sql(text, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical lines from the events table, of seven exports (source)."""
    return _from_events(spark, sf_dir, EVENT_LINES)


VOLUME_MAPPING = Mapping(
    roles={r: r for r in ("resourceId", "service", "provider", "region", "cost", "currency")},
    tag_columns={"owner": "tag_owner", "environment": "tag_environment"}
)


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical lines from lineitem, some thirty a part: the volume case. Lines are numbered by a hash of the whole row."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = lambda c: F.col(c).cast("string")
    return df.select(
        F.xxhash64(*df.columns).alias("line_no"),
        F.concat(F.lit("part-"), text("l_partkey")).alias("resource_id"),
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 40).cast("string")).alias("service"),
        F.lit("aws").alias("provider"),
        F.col("l_linestatus").alias("region"),
        text("l_extendedprice").alias("cost_raw"),
        F.lit("USD").alias("currency"),
        F.lit(None).cast("string").alias("charge_type"),
        F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("o"), (F.col("l_partkey") % 100).cast("string"))).alias("tag_owner"),
        F.when(F.col("l_returnflag") == "R", "n/a").otherwise("prod").alias("tag_environment"),
        F.lit(None).cast("string").alias("tags_json"),
    )


#: A header catalogue from columns of the tables: one source for each part of the data.
HEADERS = """
SELECT DISTINCT concat('export-', CAST(user_id % 7 AS STRING)) AS source, CAST(event_id % 16 AS INT) AS position,
  CASE event_id % 16
    WHEN 0 THEN CASE user_id % 7 WHEN 0 THEN 'lineItem/ResourceId' WHEN 1 THEN 'ResourceId' ELSE 'Resource ID' END
    WHEN 1 THEN CASE user_id % 7 WHEN 0 THEN 'product/ProductName' WHEN 1 THEN 'MeterCategory' ELSE 'service' END
    WHEN 2 THEN CASE user_id % 7 WHEN 0 THEN 'lineItem/UnblendedCost' WHEN 1 THEN 'PreTaxCost' WHEN 2 THEN 'BilledCost' WHEN 3 THEN 'UnblendedCost' WHEN 4 THEN 'note' ELSE 'monthly_cost' END
    WHEN 3 THEN CASE user_id % 7 WHEN 2 THEN 'ChargeCategory' WHEN 0 THEN 'lineItem/LineItemType' ELSE 'comment' END
    WHEN 4 THEN CASE user_id % 7 WHEN 0 THEN 'resourceTags/user:owner' WHEN 1 THEN 'tags/owner' ELSE 'Owner' END
    WHEN 5 THEN 'env' WHEN 6 THEN 'Environment' WHEN 7 THEN CASE WHEN user_id % 7 = 3 THEN 'Env' ELSE 'labels:stage_name' END
    WHEN 8 THEN 'ProviderName' WHEN 9 THEN 'region' WHEN 10 THEN 'currency' WHEN 11 THEN 'Tags'
    WHEN 12 THEN CASE WHEN user_id % 7 < 3 THEN 'cost-center' ELSE 'other' END WHEN 13 THEN 'usage' WHEN 14 THEN 'Product' ELSE 'user:dept' END AS header
FROM events
"""
#: Cells for the catalogue: source, line, position, value.
CELLS = """
SELECT concat('export-', CAST(user_id % 7 AS STRING)) AS source, event_id AS line, CAST(event_id % 16 AS INT) AS position,
  CASE WHEN event_id % 16 = 5 AND event_id % 3 = 0 THEN ' ' WHEN event_id % 16 = 6 AND event_id % 5 > 0 THEN ''
       WHEN event_id % 16 = 11 THEN CASE WHEN event_id % 3 = 0 THEN '' WHEN user_id % 7 = 5 THEN 'plain' WHEN event_id % 2 = 1 THEN '{"squad": "a", "cost-code": "7"}' ELSE '"bu": "x"' END ELSE event_type END AS value
FROM events
"""


def event_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, HEADERS)


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, CELLS)
