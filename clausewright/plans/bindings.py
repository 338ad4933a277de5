"""Driver tables read as the engine's own entities, and the same readings in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.session import table

VERSIONS_SQL = """versions AS (
  SELECT o_custkey AS document, o_orderkey AS version, o_orderkey % 7 AS number,
         CASE WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderstatus = 'O' THEN 'draft' ELSE 'discarded' END AS status,
         CAST(o_orderdate AS DATE) AS effective
  FROM orders)"""

TEXTS_SQL = """raw_texts AS (
  SELECT l_partkey AS node, l_orderkey * 8 + l_linenumber AS text_id,
         CASE l_returnflag WHEN 'A' THEN 'en' WHEN 'N' THEN 'ar' ELSE 'fr' END AS lang,
         l_linestatus = 'O' AS is_authoritative, CAST(l_shipdate AS DATE) AS applies_from, l_quantity > 45 AS pending
  FROM lineitem),
texts AS (SELECT *, lead(applies_from) OVER (PARTITION BY node, lang ORDER BY applies_from, text_id) AS applies_until FROM raw_texts)"""

LOG_SQL = """entries AS (
  SELECT event_id AS id, ts AS created_at, CASE WHEN user_id % 17 = 0 THEN NULL ELSE user_id END AS actor,
         CASE user_id % 3 WHEN 0 THEN 'mcp' WHEN 1 THEN 'dashboard' ELSE 'api' END AS surface,
         CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'get_clause' WHEN 'signup' THEN 'list_documents' ELSE 'ask' END AS operation,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'no_match' ELSE 'ok' END AS status,
         'law' || CAST(user_id % 5 AS VARCHAR) AS pack, 'art-' || CAST(CAST(floor(value) AS BIGINT) % 40 AS VARCHAR) AS clause, props, value
  FROM events)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as document versions."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("discarded")
    return o.select(
        F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") % 7).alias("number"),
        status.alias("status"), F.to_date("o_orderdate").alias("effective"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as dated texts of clauses."""
    li = table(spark, sf_dir, "lineitem")
    lang = F.when(F.col("l_returnflag") == "A", "en").when(F.col("l_returnflag") == "N", "ar").otherwise("fr")
    raw = li.select(
        F.col("l_partkey").alias("node"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("text_id"), lang.alias("lang"),
        (F.col("l_linestatus") == "O").alias("is_authoritative"), F.to_date("l_shipdate").alias("applies_from"),
        (F.col("l_quantity") > 45).alias("pending"),
    )
    until = F.lead("applies_from").over(W.partitionBy("node", "lang").orderBy("applies_from", "text_id"))
    return raw.withColumn("applies_until", until)


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as query-log entries with their first result."""
    e = table(spark, sf_dir, "events")
    user, kind = F.col("user_id"), F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(user % 17 != 0, user).alias("actor"),
        F.when(user % 3 == 0, "mcp").when(user % 3 == 1, "dashboard").otherwise("api").alias("surface"),
        F.when(kind == "view", "search").when(kind == "click", "get_clause").when(kind == "signup", "list_documents").otherwise("ask").alias("operation"),
        F.when(kind == "error", "error").when(kind == "signup", "no_match").otherwise("ok").alias("status"),
        F.concat(F.lit("law"), (user % 5).cast("string")).alias("pack"),
        F.concat(F.lit("art-"), (F.floor("value").cast("long") % 40).cast("string")).alias("clause"),
        "props", "value",
    )
