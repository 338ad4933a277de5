"""Batch forms of the streaming operators, on events; the tests hold the streams to them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from clausewright.plans.bindings import LOG_SQL, log_entries
from clausewright.plans.catalog import query
from clausewright.session import table
from clausewright.streaming import bounded, limits, log


def requests(events):
    """events as requests of a user, of a shared range of users, of a group of ranges."""
    user = F.col("user_id")
    return events.select(
        F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("at"), user.cast("string").alias("address"), (user % 5).cast("string").alias("shared"), (user % 2).cast("string").alias("everybody")
    )


def stamped(events):
    """events with their time as a point in time."""
    return events.select("event_id", F.col("ts").cast("timestamp").alias("created_at"))


def agent_events(events):
    """events as steps of a user's run."""
    kind = F.when(F.col("event_type") == "view", "call").when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "purchase", "answer").otherwise("retry")
    return events.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("value") > 8).alias("ok"))


@query(
    "sm1_folded_runs",
    """WITH e AS (SELECT user_id AS run, event_id AS seq, CASE event_type WHEN 'view' THEN 'call' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'answer' ELSE 'retry' END AS kind, value > 8 AS ok FROM events),
    f AS (SELECT run, min(seq) FILTER (kind = 'call' AND ok) AS first_call, min(seq) FILTER (kind = 'edit') AS first_edit, bool_or(kind = 'answer') AS answered, count(*) FILTER (kind = 'retry') AS retries, max(seq) FILTER (kind = 'answer') AS a, max(seq) FILTER (kind = 'retry') AS r FROM e GROUP BY run)
    SELECT run, first_call, first_edit, coalesce(first_call < first_edit, first_call IS NOT NULL) AS searched_first, answered, retries, coalesce(a > coalesce(r, -1), false) AS settled FROM f""",
)
def folded_runs(spark, sf_dir):
    """SM1: turning points of every run."""
    return log.folded_runs(agent_events(table(spark, sf_dir, "events")))


_REQUESTS = "requests AS (SELECT event_id AS id, epoch_us(ts) / 3600000000e0 AS sec, CAST(user_id AS VARCHAR) AS address, CAST(user_id % 5 AS VARCHAR) AS shared, CAST(user_id % 2 AS VARCHAR) AS everybody FROM events)"


def _bucket(name: str, rows: str, column: str, per_minute: int) -> str:
    """CTEs that fold each key's requests in order: name (key, id, allowed, wait)."""
    full, rate = f"{per_minute}e0", f"({per_minute} / 60e0)"
    return f"""{name}_rows AS MATERIALIZED (SELECT {column} AS key, id, sec, row_number() OVER (PARTITION BY {column} ORDER BY sec, id) AS n FROM {rows}),
    {name}_fold AS (
      SELECT key, id, sec, n, {full} AS had FROM {name}_rows WHERE n = 1
      UNION ALL SELECT r.key, r.id, r.sec, r.n, least({full}, CASE WHEN f.had < 1 THEN f.had ELSE f.had - 1 END + greatest(0e0, r.sec - f.sec) * {rate}) FROM {name}_fold f JOIN {name}_rows r ON r.key = f.key AND r.n = f.n + 1),
    {name} AS MATERIALIZED (SELECT key, id, had >= 1 AS allowed, CASE WHEN had < 1 THEN greatest(1, CAST(trunc((1 - had) / {rate}) AS INTEGER)) END AS wait FROM {name}_fold)"""


@query("sm2_token_bucket", f"WITH RECURSIVE {_REQUESTS}, {_bucket('b', 'requests', 'address', 2)} SELECT * FROM b")
def token_bucket(spark, sf_dir):
    """SM2: requests that a bucket a user lets through; the tests hold the stream to it."""
    rows = requests(table(spark, sf_dir, "events"))
    return limits.token_bucket(rows.select(F.col("address").alias("key"), "id", "at"), 2)


@query(
    "sm4_layered_limits",
    f"""WITH RECURSIVE {_REQUESTS}, {_bucket("a", "requests", "address", 4)}, left_a AS (SELECT * FROM requests WHERE id IN (SELECT id FROM a WHERE allowed)),
    {_bucket("s", "left_a", "shared", 10)}, left_s AS (SELECT * FROM left_a WHERE id IN (SELECT id FROM s WHERE allowed)), {_bucket("e", "left_s", "everybody", 20)}
    SELECT id, 'address' AS refused_by, wait FROM a WHERE NOT allowed UNION ALL SELECT id, 'shared', wait FROM s WHERE NOT allowed UNION ALL SELECT id, 'everybody', wait FROM e WHERE NOT allowed
    UNION ALL SELECT id, NULL, NULL FROM e WHERE allowed""",
)
def layered_limits(spark, sf_dir):
    """SM4: which layer refuses a request."""
    return limits.layered(requests(table(spark, sf_dir, "events")), [("address", 4), ("shared", 10), ("everybody", 20)])


@query("sm6_local_days", "SELECT CAST(ts + INTERVAL 4 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def local_days(spark, sf_dir):
    """SM6: entries by local day, as the stream counts them."""
    return log.days(stamped(table(spark, sf_dir, "events")), "Asia/Dubai")


@query(
    "sm5_timed_sessions",
    f"""WITH RECURSIVE {LOG_SQL}, own AS (SELECT CAST(actor AS VARCHAR) AS actor, epoch_us(created_at) AS us, row_number() OVER (PARTITION BY actor ORDER BY created_at) AS n FROM entries WHERE actor IS NOT NULL),
    f AS (
      SELECT actor, n, us AS start_us, us AS last_us FROM own WHERE n = 1
      UNION ALL SELECT o.actor, o.n, CASE WHEN f.start_us + 172800000000 <= o.us OR o.us - f.last_us > 43200000000 THEN o.us ELSE f.start_us END,
        CASE WHEN f.start_us + 172800000000 <= o.us OR o.us - f.last_us > 43200000000 OR o.us - f.last_us >= 60000000 THEN o.us ELSE f.last_us END
      FROM f JOIN own o ON o.actor = f.actor AND o.n = f.n + 1)
    SELECT actor, make_timestamp(start_us) AS start, make_timestamp(max(last_us)) AS last_seen, count(*) AS n, make_timestamp(least(max(last_us) + 43200000000, start_us + 172800000000)) AS ended_at,
      CASE WHEN max(last_us) + 43200000000 < start_us + 172800000000 THEN 'idle' ELSE 'expired' END AS reason FROM f GROUP BY actor, start_us""",
)
def timed_sessions(spark, sf_dir):
    """SM5, FIL14: sessions that end by idling or at their absolute lifetime; the tests hold the stream to it."""
    return bounded.sessions(log_entries(spark, sf_dir), timedelta(hours=12), timedelta(days=2))
