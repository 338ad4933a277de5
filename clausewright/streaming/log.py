"""The log as a stream: runs folded to their turning points, local days counted, old entries left out, new texts embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded_runs(events: DataFrame) -> DataFrame:
    """run, first_call, first_edit, searched_first, answered, retries, settled of events (run, seq, kind, ok).

    Built-in aggregates only, so that it is one plan for a table and for a stream in update mode: a
    run's state is a few numbers. kinds: call, edit, answer, retry; settled: an answer came after the last retry.
    """
    at = lambda kind, ok=False: F.min(F.when((F.col("kind") == kind) & (F.col("ok") if ok else F.lit(True)), F.col("seq")))
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("seq")))
    folded = events.groupBy("run").agg(
        at("call", True).alias("first_call"), at("edit").alias("first_edit"), F.bool_or(F.col("kind") == "answer").alias("answered"),
        F.count_if(F.col("kind") == "retry").alias("retries"), last("answer").alias("a"), last("retry").alias("r"),
    )
    before = F.coalesce(F.col("first_call") < F.col("first_edit"), F.col("first_call").isNotNull())
    settled = F.coalesce(F.col("a") > F.coalesce("r", F.lit(-1)), F.lit(False))
    return folded.select("run", "first_call", "first_edit", before.alias("searched_first"), "answered", "retries", settled.alias("settled"))


def days(entries: DataFrame, zone: str, late: str = "2 days") -> DataFrame:
    """day, n: entries (created_at) by local day; on a stream, days stay open for ``late`` and later rows are dropped.

    The watermark stands on the local time, of which the windows are made, so that a closed day leaves the state.
    """
    local = entries.select(F.from_utc_timestamp("created_at", zone).alias("local"))
    counted = local.withWatermark("local", late) if entries.isStreaming else local
    return counted.groupBy(F.window("local", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def kept(entries: DataFrame, retention_days: int) -> DataFrame:
    """Entries younger than the retention rule; on a stream each batch is held to its own time."""
    return entries.where(F.col("created_at") >= F.current_timestamp() - F.expr(f"interval {retention_days} days"))


def embedded(texts: DataFrame, store: str, encode: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A stream of texts (text_id, ...) whose new ones are encoded and appended to the Parquet table at store; the started query.

    encode: text rows -> rows with text_id and vector. An anti-join keeps texts out that are there already, so
    that a batch which comes twice after a failure is embedded once.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        there = spark.read.schema("text_id long").parquet(store) if _exists(spark, store) else spark.createDataFrame([], "text_id long")
        encode(batch.dropDuplicates(["text_id"]).join(there, "text_id", "left_anti")).write.mode("append").parquet(store)

    return texts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
