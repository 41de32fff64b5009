"""A training corpus from raw documents: rules, near copies, repeated passages, mix, token ids.

Every stage takes all that the one before has kept. All but the last return the columns of
``documents``; the last adds ``ids``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.llm import bpe, quality_rules, queries, simhash, substrings
from stayline.llm.common import free_name, keep, with_row_key

#: SQL can express neither the fingerprints nor the token ids.
ORACLE_SQL = None


def _only(rows: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in the one column of ``chosen``."""
    wanted = chosen.toDF("chosen")
    return rows.join(wanted, F.col(f"`{key}`") == F.col("chosen"), "left_semi").drop(key)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Only statistics are written, no texts."""
    key = free_name(docs, "row_key")
    rows = with_row_key(docs, key)
    counted = quality_rules.with_statistics(rows, carry=["lang", "source", key])
    judged = quality_rules.judge(keep(quality_rules.with_points(counted), "statistics"))
    return _only(rows, key, judged.where("kept").select(F.col("row")[key]))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id stays (of rows with one id,
    one). A group without any id is one of equal fingerprints, and one row of it stays."""
    key = free_name(docs, "row_key")
    rows = with_row_key(docs, key)
    named = keep(simhash.near_duplicates(rows, carry=["doc_id", key]), "named")
    alone = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    place = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("row")[key].alias("key"))
    first = named.groupBy("component_id", alone.alias("alone")).agg(F.min(place).alias("first"))
    return _only(rows, key, first.select("first.key"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from texts; texts without any stay as they are."""
    done = substrings.without_repeats(docs, as_given=True)
    columns = [F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return done.select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one that two epochs select comes twice."""
    taken = queries.mix(docs)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their whole texts."""
    done = bpe.encoded(docs, queries.tokenizer())
    return done.select("row.*", F.col("ids").alias(free_name(docs, "ids")))


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_copies),
    ("repeated passages", passages),
    ("mix", mix),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
