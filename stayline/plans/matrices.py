"""Per-model user files and the cumulative model matrices.

Features are built long, one row per (user, chunk), from one pass over the logs, then
turned wide once per user. Every model's matrix is a selection from the wide frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions import people
from stayline.operators import chunks as ch
from stayline.operators.clean import TARGETS, at_least_levels, majority
from stayline.operators.sessions import count_logins
from stayline.plans.profile import with_demographics, with_targets
from stayline.session import stage

LANGUAGE_SHARES = tuple(f"share_{language}" for language in ch.LANGUAGES)
MAJORITY_PYTHON = "mostly_python"
LOGINS = "logins"
BASE_FEATURES = (
    "signed_up", "paid_subscription", "english_speaking",
    *people.COUNTRY_DUMMIES, *people.AGE_DUMMIES,
)
META = ("id", *TARGETS)


def chunk_column(feature: str, upper: int) -> str:
    return f"{feature}_chunk_{upper}"


def chunk_facts(
    users: DataFrame, events: DataFrame, numbered: DataFrame, chunks: Sequence[ch.Chunk] = ch.CHUNKS
) -> DataFrame:
    """Rows per (user, chunk) with features, and rows with the logins up to the chunk's end.

    The two kinds are stacked, not joined; turning them wide merges them. Both start from
    the chunk bounds, which are few rows and so written once.
    """
    joined = users.select(F.col("id").alias("user_id"), "date_joined")
    bounds = stage(ch.chunk_bounds(events, numbered, chunks), "bounds")
    spans = bounds.join(joined, "user_id")
    logins = count_logins(
        spans, events, ["user_id", "chunk"], "date_joined", "date_completed", LOGINS
    )
    features = ch.chunk_features(events, numbered, chunks, bounds=bounds).drop("date_started", "date_completed")
    return features.unionByName(logins, allowMissingColumns=True)


def wide_features(
    facts: DataFrame, numbered: DataFrame, chunks: Sequence[ch.Chunk] = ch.CHUNKS
) -> DataFrame:
    """One row per user with every chunk's columns."""
    measures = ("victories", *ch.CHUNK_FEATURES, LOGINS)
    wide = facts.groupBy("user_id").agg(*[
        F.max(F.when(F.col("chunk") == c.upper, F.col(m))).alias(chunk_column(m, c.upper))
        for c in chunks for m in measures
    ])
    shares = [
        ch.language_share(
            F.col(ch.language_column(x, c)), F.col(chunk_column("victories", c.upper))
        ).alias(chunk_column(f"share_{x}", c.upper))
        for c in chunks for x in ch.LANGUAGES
    ]
    return wide.join(ch.user_language_counts(numbered, chunks), "user_id", "left").select(
        *wide.columns, *shares
    )


def history_rows(wide: DataFrame, chunks: Sequence[ch.Chunk] = ch.CHUNKS) -> DataFrame:
    """The language shares and logins of a wide frame as rows per (user, chunk)."""
    measures = (*LANGUAGE_SHARES, LOGINS)
    rows = F.array(*[
        F.struct(F.lit(c.upper).alias("chunk"), F.col(chunk_column("victories", c.upper)).alias("_n"),
                 *[F.col(chunk_column(m, c.upper)).alias(m) for m in measures])
        for c in chunks
    ])
    return wide.select("user_id", F.explode(rows).alias("r")).where(F.col("r._n") > 0).select(
        "user_id", "r.chunk", *[f"r.{m}" for m in measures]
    )


def wide_users(
    users: DataFrame,
    numbered: DataFrame,
    events: DataFrame,
    campaigns: DataFrame,
    chunks: Sequence[ch.Chunk] = ch.CHUNKS,
) -> DataFrame:
    """Targets, demographics and all chunk columns, one row per user.

    The level attempts are read four times: pass numbered attempts from a written table.
    """
    people_block = with_demographics(with_targets(users, numbered.drop("level_num"), campaigns))
    wide = wide_features(chunk_facts(users, events, numbered, chunks), numbered, chunks)
    df = people_block.join(wide.withColumnRenamed("user_id", "id"), "id", "left")
    # A user without victories in a chunk has no shares and no logins there, which
    # count as zero; rates and times stay missing.
    zeros = {chunk_column(s, c.upper): 0.0 for c in chunks for s in LANGUAGE_SHARES}
    return df.fillna(zeros).fillna({chunk_column(LOGINS, c.upper): 0 for c in chunks})


def upto_model(model: ch.Model, chunks: Sequence[ch.Chunk] = ch.CHUNKS) -> list[ch.Chunk]:
    """The chunks a cumulative matrix draws on."""
    return [c for c in chunks if c.upper <= model.upto]


def _chunk_block(uppers: Sequence[int]) -> list[str]:
    return [chunk_column(f, u) for u in uppers for f in ch.CHUNK_FEATURES]


def _mostly_python(upper: int) -> Column:
    share = F.col(chunk_column("share_python", upper))
    return majority(share).alias(chunk_column(MAJORITY_PYTHON, upper))


def model_population(users: DataFrame, model: ch.Model, chunks: Sequence[ch.Chunk] = ch.CHUNKS) -> DataFrame:
    """Users that completed at least the model's newest chunk."""
    return at_least_levels(users, max(c.upper for c in model.chunks(chunks)))


def model_file(wide: DataFrame, model: ch.Model, chunks: Sequence[ch.Chunk] = ch.CHUNKS) -> DataFrame:
    """The model's own file: its population, its chunks, all language shares, logins."""
    own = [c.upper for c in model.chunks(chunks)]
    newest = max(own)
    return model_population(wide, model, chunks).select(
        *META, *BASE_FEATURES, *_chunk_block(own),
        *[chunk_column(s, newest) for s in LANGUAGE_SHARES], chunk_column(LOGINS, newest),
    )


def clean_model_file(df: DataFrame, upper: int) -> DataFrame:
    """Keep only the python share, as a majority flag, and drop repeated rows."""
    shares = [chunk_column(s, upper) for s in LANGUAGE_SHARES]
    return df.select(
        *[c for c in df.columns if c not in shares], _mostly_python(upper)
    ).dropDuplicates()


def model_features(model: ch.Model, chunks: Sequence[ch.Chunk] = ch.CHUNKS) -> list[str]:
    """Feature columns of a cumulative matrix, in order."""
    upto = [c.upper for c in upto_model(model, chunks)]
    newest = max(upto)
    return [
        *BASE_FEATURES, *_chunk_block(upto),
        chunk_column(MAJORITY_PYTHON, newest), chunk_column(LOGINS, newest),
    ]


def model_matrix(wide: DataFrame, model: ch.Model, chunks: Sequence[ch.Chunk] = ch.CHUNKS) -> DataFrame:
    """The cumulative matrix: every chunk up to the model's, newest flag and logins."""
    newest = max(c.upper for c in upto_model(model, chunks))
    return (
        at_least_levels(wide, newest)
        .withColumn(chunk_column(MAJORITY_PYTHON, newest), _mostly_python(newest))
        .select(*META, *model_features(model, chunks))
    )


def model_matrices(
    wide: DataFrame, models: Sequence[ch.Model] = ch.MODELS, chunks: Sequence[ch.Chunk] = ch.CHUNKS
) -> dict[int, DataFrame]:
    """One matrix per prediction point. Stage ``wide`` first when writing them all."""
    return {m.threshold: model_matrix(wide, m, chunks) for m in models}


def standalone_matrix(wide: DataFrame, model: ch.Model = ch.MODEL_13,
                      chunks: Sequence[ch.Chunk] = (ch.CHUNK_6,)) -> DataFrame:
    """The uncleaned stand-alone matrix: language shares stay as shares."""
    return model_file(wide, model, chunks)


def standalone_features(model: ch.Model = ch.MODEL_13, chunks: Sequence[ch.Chunk] = (ch.CHUNK_6,)) -> list[str]:
    """Feature columns of the stand-alone matrix, in order."""
    own = [c.upper for c in model.chunks(chunks)]
    newest = max(own)
    return [
        *BASE_FEATURES, *_chunk_block(own), *[chunk_column(s, newest) for s in LANGUAGE_SHARES],
        chunk_column(LOGINS, newest),
    ]


def model_matrices_by_joins(
    files: dict[int, DataFrame], models: Sequence[ch.Model] = ch.MODELS,
    chunks: Sequence[ch.Chunk] = ch.CHUNKS,
) -> dict[int, DataFrame]:
    """The same matrices from per-model files, each left-joined to its predecessor's features.

    For callers that kept the files; ``model_matrices`` needs no join.
    """
    matrices: dict[int, DataFrame] = {}
    earlier: DataFrame | None = None
    for model in models:
        newest = max(c.upper for c in model.chunks(chunks))
        own = clean_model_file(files[model.threshold], newest)
        matrix = own if earlier is None else own.join(earlier, "id", "left")
        matrices[model.threshold] = matrix.select(*META, *model_features(model, chunks))
        earlier = matrix.select("id", *_chunk_block([c.upper for c in chunks if c.upper <= newest]))
    return matrices
