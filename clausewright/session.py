"""SparkSession factory used by the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spark_session(app: str = "clausewright", cpus: int | None = None) -> SparkSession:
    """A local session with the settings every query here assumes (UTC, AQE, Arrow)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table; sf_dir may be any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only on a single machine may that be unset; a folder under /tmp stands in there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            os.makedirs("/tmp/checkpoints", exist_ok=True)
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="clausewright-", dir="/tmp/checkpoints"))
        path = _LOCAL[0]
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows that a task sorts or groups at once, where the number of tasks follows the rows.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about so many rows, dealt by keys to as many tasks as keep each one's share bounded, whatever the session's setting is."""
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(least, -(-rows // ROWS_A_TASK)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the checkpoint folder from then on."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()
