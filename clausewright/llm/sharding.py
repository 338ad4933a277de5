"""Sharding through fixed virtual slots.

Records hash to a fixed number of slots. Bytes are summed per slot, and a small versioned table
maps slots to shards. Rebalancing edits that table, so that only the records of moved slots move.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.llm.shared import written

#: Slots that records hash to; bounds every table of slots that reaches the driver.
N_SLOTS = 4096
#: A slot of more than this share of a shard's even part of the bytes is cut, by its texts, into so many units.
SPLIT_SHARE, CUT_UNITS = 0.9, 16
#: Pieces of a shard's even part that a text of more than that part is dealt in.
PIECES = 16
MAP_SCHEMA = (
    "version int, n_shards int, slot int, hot_text long, unit int, part int, units int, parts int, bytes long, rows long, shard int"
)
#: What one entry of the map is for.
PLACE = ["virtual_slot", "hot_text", "unit", "part"]


def even_out(units: list[tuple], n_shards: int, now: dict | None = None) -> dict:
    """unit -> shard, for units (key, bytes): sizes of shards near equal.

    now: the map so far. Units leave only shards that are over the even part, largest first as long
    as they fit, and go to the emptiest shards; all others stay where they are.
    """
    even = sum(size for _, size in units) / n_shards
    load, stay, moved = [0] * n_shards, {}, []
    for key, size in sorted(units, key=lambda x: (-x[1], x[0])):
        shard = (now or {}).get(key)
        if shard is not None and shard < n_shards and load[shard] + size <= even:
            stay[key] = shard
            load[shard] += size
        else:
            moved.append((key, size))
    heap = [(size, shard) for shard, size in enumerate(load)]
    heapq.heapify(heap)
    for key, size in moved:
        total, shard = heapq.heappop(heap)
        stay[key] = shard
        heapq.heappush(heap, (total + size, shard))
    return stay


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, text_key and virtual_slot of every row of docs (equal texts share a slot)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.pmod(F.xxhash64(text), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def _dealt(salt: int, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id", "size", "text_crc32"), n).cast("int")


def _with_place(rows: DataFrame, slots: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with hot_text, unit and part. slots: virtual_slot, units, parts where either is over 1; hot: text_key, pieces.

    A slot is one unit, or CUT_UNITS by its texts; a hot text's rows are units of their own, dealt by
    row. Parts cut a unit for numbering only. Both tables are bounded: N_SLOTS and n_shards rows.
    """
    joined = rows.join(F.broadcast(slots), "virtual_slot", "left").join(F.broadcast(hot), "text_key", "left")
    by_text = F.pmod(F.xxhash64(F.lit(7), "text_key"), F.coalesce("units", F.lit(1))).cast("int")
    is_hot = F.col("pieces").isNotNull()
    return joined.select(
        *rows.columns,
        F.when(is_hot, F.col("text_key")).otherwise(F.lit(0)).alias("hot_text"),
        F.when(is_hot, _dealt(11, F.col("pieces"))).otherwise(by_text).alias("unit"),
        F.when(is_hot, F.lit(0)).otherwise(_dealt(13, F.coalesce("parts", F.lit(1)))).alias("part"),
        F.when(is_hot, F.col("pieces")).otherwise(F.coalesce("units", F.lit(1))).alias("units"),
        F.when(is_hot, F.lit(1)).otherwise(F.coalesce("parts", F.lit(1))).alias("parts"),
    )


def slot_map(rows: DataFrame, n_shards: int, *, version: int = 1, before: DataFrame | None = None) -> DataFrame:
    """The versioned map of rows' slots to shards: near equal bytes in each shard.

    before: the map of the version before; its slots move only out of shards that are too full. A slot
    stays whole in one shard unless its bytes near a shard's even part; then its texts are dealt in
    units, and only a text that alone exceeds the even part is spread over shards.
    """
    spark = rows.sparkSession
    # At most N_SLOTS rows, whatever the input's size.
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    even, n_rows = sum(t.bytes for t in totals) / n_shards, sum(t.n for t in totals)
    # Parts bound the rows that one task numbers; there are at most 512 of these beyond one a slot.
    row_cap = max(256, n_rows // 512)
    shape = {t.virtual_slot: (CUT_UNITS if t.bytes > SPLIT_SHARE * even else 1, -(-t.n // row_cap)) for t in totals}
    cut = [(s,) for s, (units, _) in shape.items() if units > 1]
    texts = rows.join(F.broadcast(spark.createDataFrame(cut, "virtual_slot int")), "virtual_slot", "left_semi").groupBy("text_key")
    # Each of these holds over a shard's even part: fewer than n_shards rows.
    hot = texts.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(F.col("bytes") > even).collect() if cut else []
    pieces = [(h.text_key, max(-(-h.n // row_cap), -(-PIECES * h.bytes // max(1, int(even))))) for h in hot]
    counted = (
        _with_place(
            rows,
            spark.createDataFrame([(s, u, p) for s, (u, p) in shape.items() if u > 1 or p > 1], "virtual_slot int, units int, parts int"),
            spark.createDataFrame(pieces, "text_key long, pieces int"),
        )
        .groupBy(*PLACE, "units", "parts")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .collect()
    )
    sizes: dict = {}
    for c in counted:
        key = (c.virtual_slot, c.hot_text, c.unit)
        sizes[key] = sizes.get(key, 0) + c.bytes
    now = {}
    if before is not None:
        now = {(b.slot, b.hot_text, b.unit): b.shard for b in before.collect()}
    to = even_out(list(sizes.items()), n_shards, now)
    return spark.createDataFrame(
        [
            (version, n_shards, c.virtual_slot, c.hot_text, c.unit, c.part, c.units, c.parts, c.bytes, c.n, to[(c.virtual_slot, c.hot_text, c.unit)])
            for c in counted
        ],
        MAP_SCHEMA,
    )


def store_map(slots: DataFrame, path: str) -> DataFrame:
    """Append a version of the map to the table of versions at path; gives the newest version back."""
    slots.write.mode("append").parquet(path)
    return latest_map(slots.sparkSession, path)


def latest_map(spark: SparkSession, path: str) -> DataFrame:
    """The newest version in the table of versions at path: one entry a slot, hot text, unit and part.

    Where two runs stored the same version at once, one entry of each pair counts (the least shard).
    """
    every = spark.read.schema(MAP_SCHEMA).parquet(path)
    newest = every.join(F.broadcast(every.agg(F.max("version").alias("version"))), "version").select(*every.columns)
    keys = ["slot", "hot_text", "unit", "part"]
    rest = [c for c in every.columns if c not in keys]
    one = newest.groupBy(*keys).agg(F.min(F.struct("shard", *[c for c in rest if c != "shard"])).alias("m"))
    return one.select(*[c if c in keys else f"m.{c}" for c in every.columns])


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest stored version, None where nothing is stored yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    newest = latest_map(spark, path)
    return None if newest.isEmpty() else newest


def place(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Each row's shard and its place there, gapless from 0.

    slots: a map of the same rows. Besides N_SLOTS entries it has at most 512 parts, CUT_UNITS times
    as many for large slots, and the pieces of fewer than n_shards hot texts, so it is broadcast; rows
    are numbered inside a part only, and the parts' places follow from the map's counts.
    """
    order = ["slot", "hot_text", "unit", "part"]
    before = W.partitionBy("shard").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    starts = slots.select(
        F.col("slot").alias("virtual_slot"), *order[1:], "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    shape = slots.where("hot_text = 0 and (units > 1 or parts > 1)").select(F.col("slot").alias("virtual_slot"), "units", "parts").distinct()
    hot = slots.where("hot_text <> 0").select(F.col("hot_text").alias("text_key"), F.col("units").alias("pieces")).distinct()
    own = W.partitionBy(*PLACE).orderBy("doc_id", "size", "text_crc32")
    return (
        _with_place(rows, shape, hot)
        .withColumn("at", F.row_number().over(own) - 1)
        .join(F.broadcast(starts), PLACE)
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).alias("slot"), "virtual_slot")
    )


def shard(docs: DataFrame, n_shards: int = 16, map_path: str | None = None) -> DataFrame:
    """docs (doc_id, text) dealt to shards 0 to n_shards - 1 by the law ``bytes``.

    map_path: a table of versions of the map. Its newest version is edited, so that only what must
    move moves, and stored as the next version; where there is none yet, the first one is made.

    size is the text's UTF-8 bytes and 1 more; a null text counts as empty, a null doc_id is an id
    like another, repeated rows each get a place. Equal texts share a shard unless they alone
    exceed its even part. Very long texts can't be cut: a shard holds at least the longest of its
    own. Other columns aren't read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = written(records(docs), "records")
    before = _stored(spark, map_path) if map_path else None
    version = 1 if before is None else before.first().version + 1
    slots = slot_map(rows, n_shards, version=version, before=before)
    slots = store_map(slots, map_path) if map_path else written(slots, "slot-map")
    return place(rows, slots)


def op3_virtual_slots(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, sizes near equal."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
