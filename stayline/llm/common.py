"""What the operators share: staging, word rules, and sizing from the input."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import stayline.llm
from stayline.session import fresh_path

# Task functions travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(stayline.llm)

#: Fixed value: a word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _shuffles_removed(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts lineage, outlives lost executors, and lets Spark drop the shuffle files of
    the write as soon as it ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing will read any more, wherever the shared folder is."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Rows of long texts or packed arrays go to the tasks' Python a few at a time."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A long per row that is stable only once the result has been written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a key per row that is the same in every plan that reads it: its file and
    its place there, or, where ``df`` is not read from files, a number that is written."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        keyed = df.withColumn(name, place)
        keyed.schema  # resolves the names
        return keyed
    except AnalysisException:
        return keep(numbered(df, name), "rows")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_row(docs: DataFrame, carry: list[str] | None = None) -> Column:
    """The columns ``carry`` (default: all) as one struct named ``row``.

    Operators hand rows on in this form beside what they add, so no column of the input
    can clash with theirs.
    """
    names = docs.columns if carry is None else carry
    fields = [F.col(f"`{c}`") for c in names] or [F.lit(None).alias("none")]
    return F.struct(*fields).alias("row")


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` hold ``total``."""
    return max(least, -(-int(total) // each))


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts: one column read, one row back."""
    return docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0


def keep_bucketed(df: DataFrame, parts: int, column: str, label: str) -> DataFrame:
    """As ``keep``, dealt into ``parts`` buckets by ``column``: later groupings and joins on
    that column read the rows where they are."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with _shuffles_removed(spark):
        df.repartition(parts, column).write.format("parquet").option("path", path).bucketBy(
            parts, column).saveAsTable(name)
    return spark.table(name)


def add_bucketed(df: DataFrame, parts: int, column: str, label: str, to: DataFrame | None = None) -> DataFrame:
    """A table in ``parts`` buckets by ``column``, or ``to`` with more rows, without a shuffle:
    each task writes its rows of each bucket, so rows of a value should be in one task."""
    spark = df.sparkSession
    path = fresh_path(spark, label) if to is None else to._kept_at
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with _shuffles_removed(spark):
        df.write.mode("append").format("parquet").option("path", path).bucketBy(parts, column).saveAsTable(name)
    added = spark.table(name)
    added._kept_at = path
    return added
