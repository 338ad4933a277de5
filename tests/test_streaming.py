"""Streams give the rows of their batch forms, and batch forms those of plain loops."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clausewright.plans import stream_queries as sq
from clausewright.session import scratch
from clausewright.streaming import bounded, limits, log

SF = "/root/testdata/sf0.001"


def dealt(spark, rows, tmp_path, parts=3):
    """rows as a stream of several batches, in order of id."""
    path = f"{tmp_path}/in"
    ids = sorted(r[0] for r in rows.select("event_id").collect())
    for k in range(parts):
        low, high = ids[len(ids) * k // parts], ids[len(ids) * (k + 1) // parts - 1]
        rows.where(F.col("event_id").between(low, high)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, tmp_path, mode):
    """All rows that a stream puts out, in order of batch."""
    out = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: out.append(b.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None and len(out) >= 3
    return out


def plain_bucket(rows, per_minute):
    state, out = {}, {}
    for at, own, key in sorted((r["at"], r["id"], r["key"]) for r in rows):
        left, before = state.get(key, (per_minute, at))
        left = min(per_minute, left + (at - before) * per_minute / 60)
        ok = left >= 1
        out[own] = ok
        state[key] = (left - ok, at)
    return out


def test_bucket_is_the_plain_loop(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    keyed = lambda df: sq.requests(df).select(F.col("shared").alias("key"), "id", "at")
    batch = {r.id: (r.key, r.allowed, r.wait) for r in limits.token_bucket(keyed(events), 2).collect()}
    assert {i: ok for i, (_, ok, _) in batch.items()} == plain_bucket(keyed(events).collect(), 2)
    assert Counter(ok for _, ok, _ in batch.values())[False] > 50 and all((w is None) == ok and (ok or w >= 1) for _, ok, w in batch.values())
    assert limits.token_bucket(keyed(events.limit(0)), 2).count() == 0


def test_layers_are_plain_loops_one_after_another(spark):
    rows = sq.requests(spark.read.parquet(f"{SF}/events.parquet")).collect()
    left, want = rows, {r["id"]: None for r in rows}
    for column, n in (("address", 4), ("shared", 10), ("everybody", 20)):
        ok = plain_bucket([{"id": r["id"], "at": r["at"], "key": r[column]} for r in left], n)
        want |= {i: column for i, x in ok.items() if not x}
        left = [r for r in left if ok[r["id"]]]
    got = sq.layered_limits(spark, SF).collect()
    assert {r.id: r.refused_by for r in got} == want and len(got) == len(want) and len(set(want.values())) >= 3, Counter(want.values())


def test_runs_on_a_stream_end_as_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    last = {}
    for batch in drained(log.folded_runs(sq.agent_events(dealt(spark, events, tmp_path))), tmp_path, "update"):
        last |= {r.run: r for r in batch}
    assert last == {r.run: r for r in log.folded_runs(sq.agent_events(events)).collect()}


def test_days_on_a_stream_are_the_batch_s(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    last = {}
    for batch in drained(log.days(sq.stamped(dealt(spark, events, tmp_path)), "Asia/Dubai"), tmp_path, "update"):
        last |= {r.day: r.n for r in batch}
    assert last == {r.day: r.n for r in sq.local_days(spark, SF).collect()}


def test_closed_days_leave_the_state_and_late_rows_are_dropped(spark, tmp_path):
    """Append mode, a row a file: a day is put out once it is over; what comes after that isn't counted."""
    day = lambda n, hour=12: datetime(2024, 1, n, hour)
    rows = spark.createDataFrame([(0, day(1)), (1, day(1, 19)), (2, day(2)), (3, day(9)), (4, day(10)), (5, day(1, 13)), (6, day(20)), (7, day(21))], "event_id int, created_at timestamp")
    stream = log.days(dealt(spark, rows, tmp_path, 8), "Asia/Dubai")
    out, states = [], []
    query = stream.writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(240)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # 19:00 UTC is the next day's in Dubai only from 20:00 on; the late row of the first day is gone.
    assert sorted((str(r.day), r.n) for r in out) == [("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-09", 1), ("2024-01-10", 1)]
    assert max(states) <= 3 and states[-1] <= 2


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, bounded.ROCKSDB)
    yield
    spark.conf.set(key, before)


def progressed(stream, tmp_path):
    """All rows, and the state rows after each batch, of an append stream."""
    out = []
    query = stream.writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(400)
    assert query.exception() is None
    return out, [[o["numRowsTotal"] for o in p["stateOperators"]] for p in query.recentProgress if p["stateOperators"]]


def test_limits_on_a_stream_are_the_batch_s_and_full_buckets_are_forgotten(spark, tmp_path, rocks):
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 600")
    timed = sq.requests(events).withColumn("created_at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withColumn("event_id", F.col("id"))
    layers = [("address", 4), ("everybody", 20)]
    batch = limits.layered(timed.withColumn("at", F.unix_micros("created_at") / 1e6), layers).collect()
    want = {r.id: (r.refused_by, r.wait) for r in batch}
    out, states = progressed(bounded.layered_stream(dealt(spark, timed, tmp_path, 5), layers, "0 seconds"), tmp_path)
    assert {r.id: (r.refused_by, r.wait) for r in out} == want and len(out) == len(want) and len({w for w, _ in want.values()}) == 3
    # The first layer's keys, each a bucket and its timer: those of a minute, not those of the whole stream.
    keys = len({r.address for r in timed.select("address").collect()})
    assert states and max(s[-1] for s in states) <= 2 * keys + 8 and min(s[-1] for s in states[1:]) < 2 * keys


def plain_sessions(times, idle, absolute):
    out = []
    for at in sorted(times):
        if out and out[-1][0] + absolute > at and at - out[-1][1] <= idle:
            out[-1][2] += 1
            if at - out[-1][1] >= timedelta(seconds=60):
                out[-1][1] = at
        else:
            out.append([at, at, 1])
    return {(s, last, n, min(last + idle, s + absolute), "idle" if last + idle < s + absolute else "expired") for s, last, n in out}


def test_sessions_end_by_timer_as_in_the_batch(spark, tmp_path, rocks):
    idle, absolute = timedelta(hours=9), timedelta(days=1)
    start = datetime(2024, 1, 1)
    some = [timedelta(seconds=s) for s in (0, 30, 59, 60, 119, 120, 121, 32_520, 32_521, 64_921, 86_400, 86_401, 200_000, 200_030, 232_430, 264_831)]
    rows = [(i, "a" if i % 2 else None, start + timedelta(hours=i)) for i in range(60)] + [(100 + i, "b", start + t) for i, t in enumerate(some)] + [(200, "b", start + some[0]), (201, "c", start + timedelta(days=30))]
    entries = spark.createDataFrame(rows, "event_id int, actor string, created_at timestamp")
    want = {(a, *s) for a in ("a", "b", "c") for s in plain_sessions([t for _, x, t in rows if x == a], idle, absolute)}
    got = [tuple(r) for r in bounded.sessions(entries, idle, absolute).collect()]
    assert set(got) == want and len(got) == len(want) and {r[-1] for r in got} == {"idle", "expired"}
    assert bounded.sessions(entries.limit(0), idle, absolute).count() == 0
    by_time = entries.withColumn("event_id", F.unix_seconds("created_at").cast("long") * 1000 + F.col("event_id"))
    out, states = progressed(bounded.session_stream(dealt(spark, by_time, tmp_path, 6), idle, absolute), tmp_path)
    # c's session is still open: the stream has seen no time after it.
    assert {tuple(r) for r in out} == {r for r in want if r[0] != "c"} and len(out) == len(want) - 1
    assert max(s[0] for s in states) <= 3 * 3 and states[-1][0] <= 3


def test_new_texts_are_embedded_once(spark, tmp_path):
    texts = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("event_id").alias("text_id"))
    stream, store = dealt(spark, texts, tmp_path), scratch(spark, "vectors")
    encode = lambda df: df.select("text_id", F.array(F.col("text_id").cast("float")).alias("vector"))
    for run in ("a", "b"):  # the second run sees every text again
        log.embedded(stream, store, encode, f"{tmp_path}/{run}").awaitTermination(240)
    assert spark.read.parquet(store).count() == texts.count()


def test_kept_drops_old_entries(spark):
    rows = spark.sql("select current_timestamp() - interval 1 day as created_at union all select current_timestamp() - interval 40 days")
    assert log.kept(rows, 30).count() == 1


def test_layers_hold_a_batch_not_a_group(spark):
    rows = sq.requests(spark.read.parquet(f"{SF}/events.parquet"))
    layers = [("address", 4), ("shared", 10), ("everybody", 20)]
    want = Counter(limits.layered(rows, layers).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = limits.layered(rows, layers)
        assert Counter(found.collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Whole keys lay in a task's Python before, two keys with all requests in the last layer.
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
