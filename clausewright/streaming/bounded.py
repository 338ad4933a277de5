"""Streams whose state ends: buckets that are full again are forgotten, sessions close by timer, at idling or at their absolute end.

They keep their state in RocksDB: set ``spark.sql.streaming.stateStore.providerClass`` to ROCKSDB before they start.
Event time decides; rows later than the watermark are dropped, so that a key's state never has to be kept for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clausewright.streaming.limits import spend

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A session's last use is noted once a minute at most.
RESOLUTION = timedelta(seconds=60)
SESSION = "actor string, start timestamp, last_seen timestamp, n long, ended_at timestamp, reason string"


def _micros(time: timedelta) -> int:
    return time // timedelta(microseconds=1)


def _rows(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(list(order))


def _timer(handle: StatefulProcessorHandle, at: float) -> None:
    """One timer, in milliseconds, in place of those that were set."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(int(at))


class _Buckets(StatefulProcessor):
    """A layer's buckets: two numbers a key, until the bucket is full again."""

    def __init__(self, layer: str, per_minute: int):
        self.layer, self.per_minute = layer, per_minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "left double, at double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        rows = _rows(rows, "created_at", "id")
        state, out = tuple(self.state.get()) if self.state.exists() else None, []
        for row in rows.itertuples(index=False):
            refused_by, wait = row.refused_by, row.wait
            if pd.isna(refused_by):
                state, wait = spend(state, row.created_at.timestamp(), self.per_minute)
                refused_by = None if wait is None else self.layer
            out.append((refused_by, wait))
        if state is not None:
            self.state.update((float(state[0]), float(state[1])))
            _timer(self.handle, math.ceil((state[1] + (self.per_minute - state[0]) * 60 / self.per_minute) * 1000) + 1)
        told = pd.DataFrame(out, columns=["refused_by", "wait"]).astype({"refused_by": object})
        told["wait"] = told["wait"].astype("Int32")
        kept = rows.drop(columns=["key", "refused_by", "wait"]).reset_index(drop=True)
        yield pd.concat([kept, told], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def layered_stream(requests: DataFrame, layers: list[tuple[str, int]], late: str = "10 seconds") -> DataFrame:
    """id, created_at, layers' columns, refused_by, wait of a stream of requests (id, created_at, a column a layer), as ``limits.layered``.

    Each layer is a stateful step after the narrower one; what one refuses goes past the others untouched. A bucket that has
    had time to fill again is as one never used, so its state ends there, by a timer: what is kept is bounded by the keys
    used within a minute before the watermark.
    """
    columns = [c for c, _ in layers]
    rows = requests.withWatermark("created_at", late).select("id", "created_at", *[F.col(c).cast("string").alias(c) for c in columns], F.lit(None).cast("string").alias("refused_by"), F.lit(None).cast("int").alias("wait"))
    schema = ", ".join(["id long", "created_at timestamp", *[f"{c} string" for c in columns], "refused_by string", "wait int"])
    for column, per_minute in layers:
        keyed = rows.withColumn("key", F.coalesce(column, F.lit("")))
        rows = keyed.groupBy("key").transformWithStateInPandas(_Buckets(column, per_minute), schema, "Append", "EventTime", eventTimeColumnName="created_at")
    return rows


class _Sessions(StatefulProcessor):
    """One open session an actor: its start, the last use that was noted, both in microseconds, and its entries."""

    def __init__(self, idle: timedelta, absolute: timedelta):
        self.idle, self.absolute = _micros(idle), _micros(absolute)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "start long, last_seen long, n long")

    def _closed(self, actor: str, start: int, last: int, n: int) -> tuple:
        by_idling, by_age = last + self.idle, start + self.absolute
        return actor, start, last, n, min(by_idling, by_age), "idle" if by_idling < by_age else "expired"

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            found = pd.DataFrame(out, columns=[x.split()[0] for x in SESSION.split(", ")])
            yield found.assign(**{c: pd.to_datetime(found[c], unit="us") for c in ("start", "last_seen", "ended_at")})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        state, out = tuple(self.state.get()) if self.state.exists() else None, []
        for at in _rows(rows, "created_at")["created_at"]:
            at = at.value // 1000
            if state is not None and (state[0] + self.absolute <= at or at - state[1] > self.idle):
                out.append(self._closed(key[0], *state))
                state = None
            if state is None:
                state = (at, at, 1)
            else:
                state = (state[0], at if at - state[1] >= _micros(RESOLUTION) else state[1], state[2] + 1)
        self.state.update(state)
        _timer(self.handle, self._closed(key[0], *state)[4] // 1000 + 2)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.state.exists():
            state = tuple(self.state.get())
            self.state.clear()
            yield from self._frame([self._closed(key[0], *state)])

    def close(self) -> None:
        pass


def session_stream(entries: DataFrame, idle: timedelta, absolute: timedelta, late: str = "1 minute") -> DataFrame:
    """Closed sessions (SESSION) of a stream of entries (actor, created_at), each put out once, when its end has surely come."""
    rows = entries.where("actor is not null").select(F.col("actor").cast("string").alias("actor"), "created_at").withWatermark("created_at", late)
    return rows.groupBy("actor").transformWithStateInPandas(_Sessions(idle, absolute), SESSION, "Append", "EventTime")


def sessions(entries: DataFrame, idle: timedelta, absolute: timedelta) -> DataFrame:
    """session_stream's rows of a table, open sessions with the end they would have.

    A session ends when nothing came for longer than idle since its last use was noted (at most once in RESOLUTION), or when
    its absolute lifetime is over. Entries that idling parts for sure are parted first, by a window; the rest is folded in order,
    one uninterrupted stretch of one actor at a time. Null actors have no sessions.
    """
    rows = entries.where("actor is not null").select(F.col("actor").cast("string").alias("actor"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    own = W.partitionBy("actor").orderBy("at")
    parted = F.coalesce((F.col("at") - F.lag("at").over(own) > _micros(idle)).cast("int"), F.lit(0))
    stretches = rows.withColumn("fresh", parted).withColumn("stretch", F.sum("fresh").over(own.rowsBetween(W.unboundedPreceding, 0)))
    times = stretches.groupBy("actor", "stretch").agg(F.array_sort(F.collect_list("at")).alias("times"))
    none = F.expr("cast(array() as array<struct<start: bigint, last: bigint, n: bigint>>)")

    def step(found: Column, at: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        new = F.struct(at.alias("start"), at.alias("last"), F.lit(1).cast("bigint").alias("n"))
        over = (F.size(found) == 0) | (last["start"] + _micros(absolute) <= at) | (at - last["last"] > _micros(idle))
        seen = F.when(at - last["last"] >= _micros(RESOLUTION), at).otherwise(last["last"])
        more = F.struct(last["start"].alias("start"), seen.alias("last"), (last["n"] + 1).alias("n"))
        return F.when(over, F.array_append(found, new)).otherwise(F.array_append(F.slice(found, 1, F.size(found) - 1), more))

    each = times.select("actor", F.explode(F.aggregate("times", none, step)).alias("s"))
    by_idling, by_age = F.col("s.last") + _micros(idle), F.col("s.start") + _micros(absolute)
    return each.select(
        "actor", F.timestamp_micros("s.start").alias("start"), F.timestamp_micros("s.last").alias("last_seen"), "s.n", F.timestamp_micros(F.least(by_idling, by_age)).alias("ended_at"),
        F.when(by_idling < by_age, "idle").otherwise("expired").alias("reason"),
    )
