"""Matrix tables between jobs: Parquet partitioned by split and model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_matrices(matrices: dict[int, DataFrame], path: str, split: str,
                   mode: str = "errorifexists") -> None:
    """Write one matrix per prediction point under ``split=/model=``.

    Each has its own columns, so each partition keeps its own schema.
    """
    for model, matrix in matrices.items():
        matrix.write.mode(mode).parquet(f"{path}/split={split}/model={model}")


def read_matrix(spark: SparkSession, path: str, split: str, model: int) -> DataFrame:
    """One matrix; only its own files are listed and read."""
    return spark.read.parquet(f"{path}/split={split}/model={model}")


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Write a table partitioned by columns."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def read_partition(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """Read the partitions with the given values."""
    df = spark.read.parquet(path)
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in wanted.items()]))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text export with a header in every part file."""
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)
