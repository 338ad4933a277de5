"""Query-log analytics on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.operators import querylog as ql
from clausewright.plans.bindings import LOG_SQL, log_entries
from clausewright.plans.catalog import query
from clausewright.session import table

START, DAYS, ZONE = "2024-01-10", 14, "Asia/Dubai"
_DAY = "CAST(created_at + INTERVAL 4 HOUR AS DATE)"
_IN = f"{_DAY} >= DATE '{START}' AND {_DAY} < DATE '{START}' + {DAYS}"
_CITED = "status = 'ok' AND (operation = 'search' OR (operation = 'get_clause' AND surface <> 'dashboard'))"
_SPINE = f"spine AS (SELECT CAST(DATE '{START}' + CAST(i AS INTEGER) AS DATE) AS day FROM range({DAYS}) t(i))"


@query(
    "ag1_status_counts",
    f"""WITH {LOG_SQL}, w AS (SELECT *, {_DAY} AS day FROM entries)
    SELECT count(*) FILTER (day >= DATE '{START}') AS asked, count(*) FILTER (day >= DATE '{START}' AND status = 'ok') AS answered,
           count(*) FILTER (day >= DATE '{START}' AND status = 'no_match') AS nothing, count(*) FILTER (day < DATE '{START}') AS asked_before
    FROM w WHERE day >= DATE '{START}' - {DAYS} AND day < DATE '{START}' + {DAYS}""",
)
def status_counts(spark, sf_dir):
    """AG1, AG2: this window and the one before."""
    return ql.status_counts(log_entries(spark, sf_dir), START, DAYS, ZONE)


@query(
    "ag3_by_day_surface",
    f"""WITH {LOG_SQL}, {_SPINE}, d AS (SELECT {_DAY} AS day, count(*) FILTER (surface = 'mcp') AS assistants, count(*) FILTER (surface = 'dashboard') AS dashboard,
      count(*) FILTER (surface NOT IN ('mcp', 'dashboard')) AS other FROM entries WHERE {_IN} GROUP BY 1)
    SELECT spine.day, coalesce(assistants, 0) AS assistants, coalesce(dashboard, 0) AS dashboard, coalesce(other, 0) AS other FROM spine LEFT JOIN d ON d.day = spine.day""",
)
def by_day_surface(spark, sf_dir):
    """AG3, SC10, SM6: zero-filled local days."""
    return ql.by_day_and_surface(log_entries(spark, sf_dir), START, DAYS, ZONE)


@query(
    "ag5_most_cited",
    f"""WITH {LOG_SQL} SELECT clause, count(DISTINCT (actor, {_DAY})) AS people, max(pack) AS pack FROM entries
    WHERE {_IN} AND {_CITED} AND pack IN ('law0', 'law1', 'law3') GROUP BY clause ORDER BY people DESC, clause LIMIT 5""",
)
def most_cited(spark, sf_dir):
    """AG4, AG5, FIL15: people a day."""
    return ql.most_cited(log_entries(spark, sf_dir), START, DAYS, ZONE, ["law0", "law1", "law3"])


@query("ag6_sources", f"WITH {LOG_SQL} SELECT coalesce(pack, 'policies') AS source, count(*) AS n FROM entries WHERE {_IN} AND status = 'ok' AND operation = 'search' GROUP BY 1")
def sources(spark, sf_dir):
    """AG6: sources of first results."""
    return ql.sources(log_entries(spark, sf_dir), START, DAYS, ZONE)


@query("ag7_latest_unanswered", f"WITH {LOG_SQL} SELECT id, created_at FROM entries WHERE status = 'no_match' ORDER BY created_at DESC, id DESC LIMIT 4")
def latest_unanswered(spark, sf_dir):
    """AG7: top four."""
    return ql.latest_unanswered(log_entries(spark, sf_dir))


@query(
    "ag8_clause_activity",
    f"""WITH {LOG_SQL}, {_SPINE}, d AS (SELECT {_DAY} AS day, count(DISTINCT (actor, {_DAY})) AS people FROM entries WHERE {_IN} AND {_CITED} AND clause = 'art-7' GROUP BY 1)
    SELECT spine.day, coalesce(people, 0) AS people, coalesce((SELECT sum(people) FROM d), 0) AS total FROM spine LEFT JOIN d ON d.day = spine.day""",
)
def clause_activity(spark, sf_dir):
    """AG8: one clause's days and total."""
    return ql.clause_activity(log_entries(spark, sf_dir), "art-7", START, DAYS, ZONE)


@query(
    "fil10_log_filter",
    f"""WITH {LOG_SQL} SELECT id, surface, status FROM entries WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20' AND surface IN ('mcp', 'api')
    AND status IN ('ok', 'no_match') AND (contains(lower(props), '"k": 1') OR contains(lower(clause), '"k": 1'))
    AND clause IN (SELECT clause FROM entries WHERE value > 90) AND actor IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def log_filter(spark, sf_dir):
    """FIL10, FIL16, JN4: window, lists, escaped text, semi joins."""
    log = log_entries(spark, sf_dir)
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("actor"))
    found = ql.matching(
        log, since="2024-01-05", until="2024-01-20", surfaces=["mcp", "api"], statuses=["ok", "no_match"], contains='"K": 1',
        clauses=log.where("value > 90"), actors=rich,
    )
    return found.select("id", "surface", "status")


@query(
    "so1_keyset_page",
    f"""WITH {LOG_SQL} SELECT id, created_at, rtrim(translate(to_base64(encode(strftime(created_at, '%Y-%m-%d %H:%M:%S') || '|' || CAST(id AS VARCHAR))), '+/', '-_'), '=') AS cursor, (SELECT count(*) FROM entries) AS total
    FROM (SELECT id, date_trunc('second', created_at) AS created_at FROM entries)
    WHERE created_at < TIMESTAMP '2024-01-15' OR (created_at = TIMESTAMP '2024-01-15' AND id < 5000) ORDER BY created_at DESC, id DESC LIMIT 21""",
)
def keyset_page(spark, sf_dir):
    """SO1, SC14: a page behind a cursor, with the total."""
    log = log_entries(spark, sf_dir).select("id", F.date_trunc("second", "created_at").alias("created_at"))
    rows = ql.page(log, 20, ("2024-01-15", 5000))
    return rows.withColumn("cursor", ql.encode_cursor(F.col("created_at"), F.col("id")))


@query(
    "so2_offset_page",
    "SELECT n_name, n_regionkey, (SELECT count(*) FROM nation) AS total FROM nation ORDER BY n_regionkey DESC NULLS LAST, n_name LIMIT 7 OFFSET 5",
)
def offset_page(spark, sf_dir):
    """SO2, SO3: a page by offset with its total."""
    rows = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    return ql.offset_page(rows, [F.desc_nulls_last("n_regionkey"), "n_name"], 5, 7)


@query("snk7_retention", f"WITH {LOG_SQL} SELECT surface, count(*) AS kept FROM entries WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY GROUP BY surface")
def retention(spark, sf_dir):
    """SNK7, PRJ3: what retention leaves."""
    return ql.kept(log_entries(spark, sf_dir), "2024-01-31", 10).groupBy("surface").agg(F.count("*").alias("kept"))


@query(
    "snk10_safe_cells",
    """SELECT conv_id, turn, CASE WHEN substr(cell, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || cell ELSE cell END AS cell
    FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '=' || text WHEN 1 THEN text ELSE '@' || text END AS cell FROM conversations)""",
)
def safe_cells(spark, sf_dir):
    """SNK10, SC17: cells no spreadsheet runs."""
    cell = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("="), "text")).when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("@"), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ql.spreadsheet_safe(cell).alias("cell"))


@query(
    "sm3_sign_in_throttle",
    """WITH a AS (SELECT user_id AS key, event_id AS id, ts AS at_, event_type = 'purchase' AS ok FROM events),
    s AS (SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY key ORDER BY at_, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM a)
    SELECT key, id, coalesce(sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY key, epoch ORDER BY epoch_us(at_) RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING), 0) >= 5 AS blocked FROM s""",
)
def sign_in_throttle(spark, sf_dir):
    """SM3: failures in a sliding window, cleared by success."""
    events = table(spark, sf_dir, "events")
    return ql.throttled(
        events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("ok")),
        minutes=2880,
    )


@query(
    "sm5_sessions",
    f"""WITH {LOG_SQL}, g AS (SELECT actor, created_at, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM entries WHERE actor IS NOT NULL WINDOW w AS (PARTITION BY actor ORDER BY created_at)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY actor ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT actor, min(created_at) AS start, max(created_at) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY actor, s.n""",
)
def idle_sessions(spark, sf_dir):
    """SM5, FIL14: sessions that idling ends."""
    return ql.sessions(log_entries(spark, sf_dir), "6 hours")


@query(
    "ag10_words_by_conversation",
    """SELECT conv_id, count(*) FILTER (role = 'user') AS asked, string_agg(text, ' ' ORDER BY turn, text) AS words FROM conversations GROUP BY conv_id""",
)
def words_by_conversation(spark, sf_dir):
    """AG9, AG10: ordered concatenation, filtered count."""
    pair = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.array_join(pair, " ").alias("words"))


@query(
    "fil11_governance_filter",
    f"""WITH {LOG_SQL} SELECT id, action FROM (SELECT *, operation || '.' || status AS action FROM entries)
    WHERE (action = 'search' OR starts_with(action, 'search.')) AND (actor IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR CAST(floor(value) AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""",
)
def governance_filter(spark, sf_dir):
    """FIL11, JN8: dotted prefix; an OR-join as two equi-joins."""
    log = log_entries(spark, sf_dir).withColumn("action", F.concat_ws(".", "operation", "status")).withColumn("target", F.floor("value").cast("long"))
    log = log.where((F.col("action") == "search") | F.col("action").startswith("search."))
    people = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    by_actor = log.join(people, F.col("actor") == F.col("c_custkey"), "left_semi")
    by_target = log.join(people, F.col("target") == F.col("c_custkey"), "left_semi")
    return by_actor.union(by_target).select("id", "action").distinct()


@query(
    "fil11_entries_asked_for",
    f"""WITH {LOG_SQL}, e AS (SELECT *, operation || '.' || status AS action, CAST(floor(value) AS BIGINT) AS target FROM entries)
    SELECT id, action, p.c_name AS actor_name, t.c_name AS target_name FROM e LEFT JOIN customer p ON p.c_custkey = e.actor LEFT JOIN customer t ON t.c_custkey = e.target
    WHERE (action = 'search' OR starts_with(action, 'search.')) AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-25'
    AND (contains(lower(action), '07') OR contains(lower(surface), '07') OR contains(lower(operation), '07') OR contains(lower(status), '07') OR contains(lower(pack), '07') OR contains(lower(clause), '07') OR contains(lower(props), '07') OR contains(lower(p.c_name), '07') OR contains(lower(t.c_name), '07'))""",
)
def entries_asked_for(spark, sf_dir):
    """FIL11: action and what is below it, a window, a text in any of nine columns, two of them names."""
    log = log_entries(spark, sf_dir).withColumn("action", F.concat_ws(".", "operation", "status")).withColumn("target", F.floor("value").cast("long"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"))
    found = ql.governance_entries(log, people, action="search", since="2024-01-05", until="2024-01-25", text="07")
    return found.select("id", "action", "actor_name", "target_name")


@query(
    "ag20_actors",
    "SELECT DISTINCT c_name AS actor, lower(c_name) AS sort_name FROM events JOIN customer ON user_id = c_custkey",
)
def actors(spark, sf_dir):
    """AG20: who is in the log."""
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left_semi").select(F.col("c_name").alias("actor"), F.lower("c_name").alias("sort_name")).distinct()


@query(
    "ag21_last_change",
    """SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS document, max(event_id) AS seq, arg_max(event_type, event_id) AS action FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1""",
)
def last_change(spark, sf_dir):
    """AG21, SC16: the last entry of each document named in JSON."""
    key = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(key.alias("document"), F.struct(F.col("event_id").alias("seq"), "event_type").alias("e")).where("document is not null")
    return rows.groupBy("document").agg(F.max("e").alias("e")).select("document", "e.seq", F.col("e.event_type").alias("action"))
