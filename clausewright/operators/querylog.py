"""The query log: filters, pages, people-a-day analytics, retention."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SURFACES = {"assistants": ["mcp"], "dashboard": ["dashboard"]}


def local_day(zone: str, at: str = "created_at") -> Column:
    """The reader's date of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(F.col(at), zone))


def in_window(entries: DataFrame, start: str, days: int, zone: str) -> DataFrame:
    """Entries of ``days`` local days from start on, with their local ``day``."""
    first = F.lit(start).cast("date")
    return entries.withColumn("day", local_day(zone)).where((F.col("day") >= first) & (F.col("day") < F.date_add(first, days)))


def spine(entries: DataFrame, start: str, days: int) -> DataFrame:
    """Every date of the window."""
    return entries.sparkSession.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))


def people_a_day() -> Column:
    """Distinct (actor, day): a row value, so entries without an actor count as one person."""
    return F.count_distinct(F.struct("actor", "day"))


def cited() -> Column:
    """First results that were read: ok searches from anywhere, or clauses opened outside the dashboard."""
    opened = (F.col("operation") == "get_clause") & (F.col("surface") != "dashboard")
    return (F.col("status") == "ok") & ((F.col("operation") == "search") | opened)


def status_counts(entries: DataFrame, start: str, days: int, zone: str) -> DataFrame:
    """Asked, answered, found nothing; and asked in as many days just before: one pass over both windows."""
    before = F.date_sub(F.lit(start).cast("date"), days)
    both = entries.withColumn("day", local_day(zone)).where((F.col("day") >= before) & (F.col("day") < F.date_add(F.lit(start).cast("date"), days)))
    now = F.col("day") >= F.lit(start).cast("date")
    return both.agg(
        F.count_if(now).alias("asked"), F.count_if(now & (F.col("status") == "ok")).alias("answered"),
        F.count_if(now & (F.col("status") == "no_match")).alias("nothing"), F.count_if(~now).alias("asked_before"),
    )


def by_day_and_surface(entries: DataFrame, start: str, days: int, zone: str) -> DataFrame:
    """Counts a day for assistants, dashboard and others; days without entries have zeros."""
    known = [s for own in SURFACES.values() for s in own]
    sums = [F.count_if(F.col("surface").isin(own)).alias(name) for name, own in SURFACES.items()]
    daily = in_window(entries, start, days, zone).groupBy("day").agg(*sums, F.count_if(~F.col("surface").isin(known)).alias("other"))
    return spine(entries, start, days).join(daily, "day", "left").na.fill(0)


def most_cited(entries: DataFrame, start: str, days: int, zone: str, packs: list[str], limit: int = 5) -> DataFrame:
    """The clauses most people came upon, a person counting once a day."""
    seen = in_window(entries, start, days, zone).where(cited() & F.col("pack").isin(packs))
    counted = seen.groupBy("clause").agg(people_a_day().alias("people"), F.max("pack").alias("pack"))
    return counted.orderBy(F.desc("people"), "clause").limit(limit)


def sources(entries: DataFrame, start: str, days: int, zone: str) -> DataFrame:
    """First results of ok searches by pack; no pack means policies."""
    own = in_window(entries, start, days, zone).where("status = 'ok' and operation = 'search'")
    return own.groupBy(F.coalesce("pack", F.lit("policies")).alias("source")).agg(F.count("*").alias("n"))


def latest_unanswered(entries: DataFrame, limit: int = 4) -> DataFrame:
    """The newest entries that found nothing."""
    return entries.where("status = 'no_match'").orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", "created_at")


def clause_activity(entries: DataFrame, clause: str, start: str, days: int, zone: str) -> DataFrame:
    """People a day for one clause, zero-filled, and their total."""
    own = in_window(entries, start, days, zone).where(cited() & (F.col("clause") == clause))
    daily = own.groupBy("day").agg(people_a_day().alias("people"))
    filled = spine(entries, start, days).join(daily, "day", "left").na.fill(0)
    return filled.crossJoin(F.broadcast(daily.agg(F.coalesce(F.sum("people"), F.lit(0)).alias("total"))))


def escaped_like(text: str) -> str:
    r"""text as a LIKE pattern for anything that contains it; \ % and _ stand for themselves."""
    for c in "\\%_":
        text = text.replace(c, "\\" + c)
    return f"%{text}%"


def matching(
    entries: DataFrame, *, since: str | None = None, until: str | None = None, surfaces: list[str] | None = None,
    statuses: list[str] | None = None, contains: str | None = None, clauses: DataFrame | None = None, actors: DataFrame | None = None,
) -> DataFrame:
    """Entries of a half-open window, in lists of values, containing a text, citing clauses, by actors."""
    out = entries
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col("created_at") < F.lit(until).cast("timestamp"))
    if surfaces is not None:
        out = out.where(F.col("surface").isin(surfaces))
    if statuses is not None:
        out = out.where(F.col("status").isin(statuses))
    if contains is not None:
        out = out.where(F.col("props").ilike(escaped_like(contains)) | F.col("clause").ilike(escaped_like(contains)))
    if clauses is not None:
        out = out.join(clauses.select("clause").distinct(), "clause", "left_semi")
    return out if actors is None else out.join(actors.select("actor").distinct(), "actor", "left_semi")


def governance_entries(entries: DataFrame, people: DataFrame, *, actor: int | None = None, action: str | None = None, since: str | None = None, until: str | None = None, text: str | None = None) -> DataFrame:
    """Entries (id, created_at, actor, target, action and other columns) that a reader of the log asks for, with actor_name and target_name.

    actor: that person acted or was acted on; action: exactly that, or below it (``search`` takes ``search.ok``); since <= created_at <
    until; text: somewhere in a text column or in a name, whatever its case, taken as it is written (``%`` and ``_`` too). What isn't
    given doesn't filter. people: person (once), name. Names are joined after everything that needs none of them has filtered.
    """
    kept = entries
    if action is not None:
        kept = kept.where((F.col("action") == action) | F.col("action").startswith(f"{action}."))
    if since is not None:
        kept = kept.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        kept = kept.where(F.col("created_at") < F.lit(until).cast("timestamp"))
    if actor is not None:
        kept = kept.where(F.coalesce(F.col("actor") == actor, F.lit(False)) | F.coalesce(F.col("target") == actor, F.lit(False)))
    for who in ("actor", "target"):
        kept = kept.join(people.select(F.col("person").alias(who), F.col("name").alias(f"{who}_name")), who, "left")
    if text is not None:
        columns = [c for c, kind in kept.dtypes if kind == "string"]
        found = [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns]
        kept = kept.where(functools.reduce(lambda a, b: a | b, found))
    return kept


def page(entries: DataFrame, limit: int, before: tuple[str, int] | None = None) -> DataFrame:
    """The newest entries before a cursor (created_at, id), each with the total of all; one more than limit tells that there are others."""
    total = entries.agg(F.count("*").alias("total"))
    if before is not None:
        at, key = F.lit(before[0]).cast("timestamp"), F.lit(before[1])
        entries = entries.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < key)))
    return entries.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1).crossJoin(F.broadcast(total))


def offset_page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page by offset, with the total in every row."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def encode_cursor(created_at: Column, key: Column) -> Column:
    """An opaque URL-safe cursor."""
    return F.rtrim(F.translate(F.base64(F.encode(F.concat_ws("|", created_at.cast("string"), key.cast("string")), "UTF-8")), "+/=", "-_ "))


def kept(entries: DataFrame, today: str, retention_days: int) -> DataFrame:
    """Entries that the retention rule leaves."""
    return entries.where(F.col("created_at") >= F.lit(today).cast("timestamp") - F.expr(f"interval {retention_days} days"))


def spreadsheet_safe(cell: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(F.substring(cell, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), cell)).otherwise(cell)


def throttled(attempts: DataFrame, failures: int = 5, minutes: int = 15) -> DataFrame:
    """key, id, blocked: ``failures`` within the minutes before an attempt (key, id, at, ok), since the last success."""
    ordered = W.partitionBy("key").orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1)
    epoch = F.coalesce(F.sum(F.col("ok").cast("int")).over(ordered), F.lit(0))
    staged = attempts.withColumn("epoch", epoch).withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))
    near = W.partitionBy("key", "epoch").orderBy("us").rangeBetween(-minutes * 60_000_000, -1)
    recent = F.coalesce(F.sum((~F.col("ok")).cast("int")).over(near), F.lit(0))
    return staged.select("key", "id", (recent >= failures).alias("blocked"))


def sessions(entries: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """actor, start, end, n: entries with no gap of ``idle`` between them."""
    grouped = entries.where("actor is not null").groupBy("actor", F.session_window("created_at", idle).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("actor", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def resolved(entries: DataFrame, known: DataFrame, on: str, order: list[str]) -> DataFrame:
    """Results of entries (id, ...) that resolve in known by ``on``, ranked from 1 a entry by order; those that don't are skipped."""
    rank = F.row_number().over(W.partitionBy("id").orderBy(*order))
    return entries.join(known, on).withColumn("rank", rank)
