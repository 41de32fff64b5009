"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Timestamps in the logs carry no zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # For joins of two plain shuffles; logs meet aggregates through operators.skew.
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


#: The scratch folder of a local run without a setting, made when first asked for.
_SCRATCH: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every job relies on; cluster sizing is left to the cluster."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", name: str = "stayline") -> SparkSession:
    """A single-machine session for tests and the bench."""
    parallel = 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Recording the call site of every column expression costs more than the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's, or a scratch one in local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _SCRATCH:
        _SCRATCH.append(tempfile.mkdtemp(prefix="stayline-"))
    return _SCRATCH[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several later jobs read, and read it back.

    Cuts lineage and survives the loss of executors, unlike a cached or locally
    checkpointed frame.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
