"""Session helpers: a tuned session for tests and benches, shared scratch space, and
lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Groups with more rows than this are never handed to a single task; see operators.ordered.
MAX_GROUP_ROWS_KEY = "spanloom.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 1_000_000


def get_spark(app: str = "spanloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators rely on (AQE, skew joins, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_GROUP_ROWS_KEY, str(DEFAULT_MAX_GROUP_ROWS)))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local session, whose driver
    and executors are one process, may go without: it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spanloom-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str = "frame") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, fixes every
    non-deterministic choice (range bounds, partition numbers) and computes the plan once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/spanloom/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
