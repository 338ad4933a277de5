"""What the operators share: the cluster's shared folder, and tables written to it."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Tables of this session that ``drop_written`` can still remove, by identity.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the session has it.

    Only on a single machine (a local master) may it be unset; a folder under /tmp stands in there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="clausewright-", dir="/tmp/checkpoints"))
    return _LOCAL[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/clausewright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """df as a written table: cuts lineage, survives lost executors, is not computed twice."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = (table, path)
    return table


def drop_written(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing will read again, by way of Spark's file system."""
    for table in tables:
        _, path = _PATHS.pop(id(table))
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tidy(task):
    """task, of mapInPandas or mapInArrow, handing memory that it freed back to the system when a partition ends.

    Python workers are used again: what Arrow and the C library keep for themselves would still be held in later stages.
    """

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
        if trim:
            trim(0)

    return run


def held_out(doc_id) -> F.Column:
    """Rows kept from learning: crc32 of doc_id as text, modulo 5, is 0 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def row_key(doc_id: str = "doc_id", text: str = "text") -> F.Column:
    """A key of a document row that holds where ids are null or used twice: id and text digest.

    Rows with equal keys are copies of one row and get equal results.
    """
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"))
