"""The given tables in the roles that the operators expect, once as DataFrames and once as DuckDB common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NOW_TEXT = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the DuckDB SQL of the same rows if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def now() -> Column:
    return F.to_timestamp_ntz(F.lit(NOW_TEXT))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search and click log from ``events``."""
    return _log_of(table(spark, sf_dir, "events"))


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stream, with ts as a point in time. A stream takes a folder or a pattern, and the table may be one file."""
    schema = table(spark, sf_dir, "events").schema
    return _log_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")).withColumn("ts", F.col("ts").cast("timestamp"))


def _log_of(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.selectExpr(
        "event_id AS id", "ts", "concat(event_type, '-', cast(user_id % 7 AS string)) AS query", "k AS shown",
        "CASE WHEN event_type = 'click' THEN k END AS item", "user_id AS session",
        "CASE WHEN event_type = 'click' THEN k % 10 + 1 END AS position", "cast(floor(value) AS bigint) % 5 AS result_count",
        "CASE user_id % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' END AS location",
        "CASE user_id % 5 WHEN 0 THEN 'Phone/1 Mobile' WHEN 1 THEN 'iPad' WHEN 2 THEN 'Tablet mobile' WHEN 3 THEN 'Desktop/9' END AS user_agent",
    )


LOG = """log AS (
  SELECT event_id AS id, ts, event_type || '-' || CAST(user_id % 7 AS VARCHAR) AS query, k AS shown,
    CASE WHEN event_type = 'click' THEN k END AS item, user_id AS session,
    CASE WHEN event_type = 'click' THEN k % 10 + 1 END AS position, CAST(floor(value) AS BIGINT) % 5 AS result_count,
    CASE user_id % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' END AS location,
    CASE user_id % 5 WHEN 0 THEN 'Phone/1 Mobile' WHEN 1 THEN 'iPad' WHEN 2 THEN 'Tablet mobile' WHEN 3 THEN 'Desktop/9' END AS user_agent
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item table from ``part``."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_name AS name", "p_brand AS category", "concat(p_type, ' item of size ', cast(p_size AS string), ' for ', p_name) AS description",
        "CASE p_partkey % 5 WHEN 0 THEN 'Calgary' WHEN 1 THEN 'Edmonton' WHEN 2 THEN 'Province-wide' WHEN 3 THEN 'Red Deer, Calgary' END AS location",
        "CASE WHEN p_partkey % 3 <> 0 THEN concat('403-555-', lpad(cast(p_partkey % 700 AS string), 4, '0')) END AS phone",
        "CASE WHEN p_partkey % 4 <> 0 THEN concat('Desk', cast(p_partkey % 90 AS string), '@mail.test') ELSE '' END AS email",
        "CASE WHEN p_partkey % 6 <> 1 THEN concat('https://site', cast(p_partkey % 40 AS string), '.test/a') END AS website_url",
        "CASE WHEN p_partkey % 7 < 3 THEN concat(cast(p_partkey % 60 + 1 AS string), ' Main Street') END AS address",
        "CASE p_partkey % 4 WHEN 0 THEN 'women' WHEN 1 THEN 'all' WHEN 2 THEN 'men' END AS gender_restriction",
        "CASE p_partkey % 6 WHEN 0 THEN 'youth' WHEN 1 THEN 'adult' WHEN 2 THEN 'youth_and_adult' WHEN 3 THEN 'senior' END AS age_group",
        "CASE p_partkey % 3 WHEN 0 THEN 'in-person' WHEN 1 THEN 'Online' END AS service_format",
        "p_partkey % 11 <> 0 AS is_active", "cast(p_size * 2 AS int) AS confidence_score", "cast(p_partkey % 37 AS int) AS click_count",
        "cast('2024-01-31 00:00:00' AS timestamp_ntz) - make_dt_interval(cast(p_partkey % 400 AS int)) AS last_updated",
        "CASE WHEN p_partkey % 9 <> 0 THEN cast('2024-01-31 00:00:00' AS timestamp_ntz) - make_dt_interval(cast(p_partkey % 200 AS int)) END AS last_checked",
        "CASE WHEN p_partkey % 8 <> 0 THEN cast((p_partkey * 37) % 180 - 90 AS double) / 10 + 51 END AS latitude",
        "CASE WHEN p_partkey % 8 <> 0 THEN cast((p_partkey * 53) % 360 - 180 AS double) / 20 - 114 END AS longitude",
        "p_retailprice AS price",
    )


ITEMS = """items AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS category, p_type || ' item of size ' || CAST(p_size AS VARCHAR) || ' for ' || p_name AS description,
    CASE p_partkey % 5 WHEN 0 THEN 'Calgary' WHEN 1 THEN 'Edmonton' WHEN 2 THEN 'Province-wide' WHEN 3 THEN 'Red Deer, Calgary' END AS location,
    CASE WHEN p_partkey % 3 <> 0 THEN '403-555-' || lpad(CAST(p_partkey % 700 AS VARCHAR), 4, '0') END AS phone,
    CASE WHEN p_partkey % 4 <> 0 THEN 'Desk' || CAST(p_partkey % 90 AS VARCHAR) || '@mail.test' ELSE '' END AS email,
    CASE WHEN p_partkey % 6 <> 1 THEN 'https://site' || CAST(p_partkey % 40 AS VARCHAR) || '.test/a' END AS website_url,
    CASE WHEN p_partkey % 7 < 3 THEN CAST(p_partkey % 60 + 1 AS VARCHAR) || ' Main Street' END AS address,
    CASE p_partkey % 4 WHEN 0 THEN 'women' WHEN 1 THEN 'all' WHEN 2 THEN 'men' END AS gender_restriction,
    CASE p_partkey % 6 WHEN 0 THEN 'youth' WHEN 1 THEN 'adult' WHEN 2 THEN 'youth_and_adult' WHEN 3 THEN 'senior' END AS age_group,
    CASE p_partkey % 3 WHEN 0 THEN 'in-person' WHEN 1 THEN 'Online' END AS service_format,
    p_partkey % 11 <> 0 AS is_active, CAST(p_size * 2 AS INT) AS confidence_score, CAST(p_partkey % 37 AS INT) AS click_count,
    TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(p_partkey % 400 AS INT)) AS last_updated,
    CASE WHEN p_partkey % 9 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(p_partkey % 200 AS INT)) END AS last_checked,
    CASE WHEN p_partkey % 8 <> 0 THEN CAST((p_partkey * 37) % 180 - 90 AS DOUBLE) / 10 + 51 END AS latitude,
    CASE WHEN p_partkey % 8 <> 0 THEN CAST((p_partkey * 53) % 360 - 180 AS DOUBLE) / 20 - 114 END AS longitude,
    p_retailprice AS price
  FROM part
)"""


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries from the distinct names of ``part`` and the user turns of ``conversations``."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.selectExpr("concat(cast(conv_id AS string), '-', cast(turn AS string)) AS query_id", "array_join(slice(split(text, ' '), 1, 4), ' ') AS text", "text AS whole")


TURNS = """turns AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS query_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS text, text AS whole
  FROM conversations WHERE role = 'user'
)"""


def term_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per distinct name of ``part``, with a place."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return p.selectExpr("k AS query_id", "p_name AS text", "CASE k % 3 WHEN 0 THEN 'Calgary' WHEN 1 THEN 'Edmonton' END AS location", "k % 5 = 1 AS location_only")


TERMS = """terms AS (
  SELECT k AS query_id, p_name AS text, CASE k % 3 WHEN 0 THEN 'Calgary' WHEN 1 THEN 'Edmonton' END AS location, k % 5 = 1 AS location_only
  FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1)
)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"
