"""Readers of the raw CSV exports.

No schema is inferred: only the header line is looked at, everything is read as text
once and cast by name, and unread columns are pruned by the scan. A whole number may be
written with a point (``13.0``), as a column with gaps is. Rows in which a text that is not
empty can be read as neither a value nor a time are left out; the ``read_rejected_*``
functions return them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stayline.operators.clean import repair_split_header
from stayline.sources.infer import with_types
from stayline.sources.schema import (
    CORRUPT, INDEX_RESIDUE, RAW_CAMPAIGNS, RAW_EVENTS, RAW_LEVELS, RAW_USERS, TIMES, event_schema,
    survey_name,
)

_RFC_QUOTES = {"quote": '"', "escape": '"'}


def _typed(text: Column, kind: str) -> Column:
    """The value of a text, null if it has none."""
    if kind not in ("int", "bigint"):
        return text.try_cast(kind)
    number = text.try_cast("double")
    whole = F.when(number == F.floor(number), F.floor(number).try_cast(kind))
    return F.coalesce(text.try_cast(kind), whole)


def _unread(columns: dict[str, tuple[str, str]]) -> Column:
    """True for rows with a text, not empty, that has no value."""
    found = F.lit(False)
    for header, (name, kind) in columns.items():
        text = F.col(f"`{header}`")
        value = F.try_to_timestamp(text) if name in TIMES else _typed(text, kind)
        if name in TIMES or kind != "string":
            found = found | ((F.trim(text) != "") & value.isNull())
    return F.coalesce(found, F.lit(False))


def _named(raw: DataFrame, columns: dict[str, tuple[str, str]]) -> list[Column]:
    return [_typed(F.col(f"`{header}`"), kind).alias(name) for header, (name, kind) in columns.items()]


def _read_text(spark: SparkSession, path) -> DataFrame:
    return spark.read.options(header=True, **_RFC_QUOTES).csv(path)


def _read_users_text(spark: SparkSession, path) -> DataFrame:
    raw = spark.read.options(
        header=True, ignoreLeadingWhiteSpace=False, **_RFC_QUOTES
    ).csv(path).drop(INDEX_RESIDUE)
    headers = raw.columns
    cut = [i for i, h in enumerate(headers) if i and h.startswith(" ")]
    if cut:
        at = cut[0]
        raw = repair_split_header(
            raw, headers[at - 1], headers[at], headers[at + 1:], headers[at].strip()
        )
    return raw


def read_users(spark: SparkSession, path, infer_survey: bool = False) -> DataFrame:
    """Users with the modelled columns typed and every survey answer as text, or, with
    ``infer_survey``, under the least type that all answers of its column share.

    A survey header with an unquoted comma shows up as a name that starts with a
    blank; the values it displaced are moved back.
    """
    raw = _read_users_text(spark, path)
    survey = [h for h in raw.columns if h not in RAW_USERS]
    users = raw.where(~_unread(RAW_USERS)).select(
        *_named(raw, RAW_USERS), *[F.col(f"`{h}`").alias(survey_name(h)) for h in survey]
    )
    return with_types(users, [survey_name(h) for h in survey]) if infer_survey else users


def read_rejected_users(spark: SparkSession, path) -> DataFrame:
    """The rows that ``read_users`` leaves out, as text."""
    return _read_users_text(spark, path).where(_unread(RAW_USERS))


def read_levels(spark: SparkSession, path) -> DataFrame:
    raw = _read_text(spark, path)
    return raw.where(~_unread(RAW_LEVELS)).select(*_named(raw, RAW_LEVELS))


def read_rejected_levels(spark: SparkSession, path) -> DataFrame:
    """The rows that ``read_levels`` leaves out, as text."""
    return _read_text(spark, path).where(_unread(RAW_LEVELS))


def read_campaigns(spark: SparkSession, path) -> DataFrame:
    raw = _read_text(spark, path)
    return raw.select(*_named(raw, RAW_CAMPAIGNS))


def _read_events_raw(spark: SparkSession, path, payload: int) -> DataFrame:
    schema = event_schema(payload).add(CORRUPT, T.StringType())
    return (
        spark.read.schema(schema)
        # A pruned line is not checked for its number of fields.
        .options(header=True, enforceSchema=True, mode="PERMISSIVE", columnPruning=False,
                 columnNameOfCorruptRecord=CORRUPT, **_RFC_QUOTES)
        .csv(path)
    )


def _too_long(width: int) -> Column:
    """True for a rejected line with more fields than names; short lines are rejected too."""
    unquoted = F.regexp_replace(F.col(CORRUPT), '"[^"]*"', "")
    commas = F.length(F.regexp_replace(unquoted, "[^,]", ""))
    # Never true: keeps a parsed column in every query, as Spark refuses the raw line alone.
    parsed = F.length(F.coalesce("created", F.lit(""))) < 0
    return F.coalesce(commas >= width, F.lit(False)) | parsed


def _read_event_text(spark: SparkSession, path, payload: int) -> tuple[DataFrame, Column]:
    """Events as text, and what tells the lines to leave out."""
    raw = _read_events_raw(spark, path, payload)
    return raw, _too_long(len(raw.columns) - 1) | _unread(RAW_EVENTS)


def read_events(spark: SparkSession, path, payload: int = 4) -> DataFrame:
    """Events by position: short lines padded with nulls; lines that are too long, or whose
    user or time has no value, left out."""
    raw, out = _read_event_text(spark, path, payload)
    return raw.where(~out).drop(CORRUPT).withColumn("user_id", _typed(F.col("user_id"), "bigint"))


def read_rejected_events(spark: SparkSession, path, payload: int = 4) -> DataFrame:
    """The lines that ``read_events`` leaves out; ``line`` is filled for over-long ones."""
    raw, out = _read_event_text(spark, path, payload)
    return raw.where(out).select(
        _typed(F.col("user_id"), "bigint").alias("user_id"), "created", F.col(CORRUPT).alias("line")
    )


def join_parts(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Part files as one table."""
    for part in rest:
        first = first.unionByName(part)
    return first
