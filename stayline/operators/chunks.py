"""Features inside level-number chunks.

A chunk is a range of level numbers. Each user's victories in it give its bounds in
time, and what the user did between those bounds gives the rates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stayline.functions.elapsed import elapsed_seconds, ratio, seconds_within_day
from stayline.operators.levels import level_numbers
from stayline.operators.skew import HOT_ROWS, spread_join

# Event names, feature names and coding languages.
VICTORY = "Saw Victory"
EVENT_RATES = {
    "Hint Used": "rate_hint_used",
    "Hints Clicked": "rate_hints_clicked",
    "Hints Next Clicked": "rate_hints_next_clicked",
    "Started Level": "rate_started_level",
    "Show problem alert": "rate_show_problem_alerts",
}
PRACTICE = "_practice"
PRACTICE_RATE = "rate_practice_levels"
AVERAGE_TIME = "avg_time_to_complete_level"
CHUNK_FEATURES = (AVERAGE_TIME, *EVENT_RATES.values(), PRACTICE_RATE)
LANGUAGES = ("python", "lua", "javascript", "coffeescript", "java")


@dataclass(frozen=True)
class Chunk:
    """Level numbers in [low, high), or the named levels if any are given."""

    upper: int
    low: int
    high: int
    levels: tuple[str, ...] = ()

    def holds(self, number: Column, level: Column) -> Column:
        if self.levels:
            return level.isin(*self.levels)
        return (number >= self.low) & (number < self.high)


@dataclass(frozen=True)
class Model:
    """A prediction point and the chunks (after, upto] that feed it."""

    threshold: int
    after: int
    upto: int

    def chunks(self, chunks: Sequence[Chunk]) -> list[Chunk]:
        return [c for c in chunks if self.after < c.upper <= self.upto]


# Chunk and model specifications. Numbers are 1-based, so the first
# chunk holds levels 1 to 4.
CHUNKS = (Chunk(5, 0, 5), Chunk(10, 5, 10), Chunk(15, 10, 15), Chunk(30, 15, 30), Chunk(60, 30, 60))
MODELS = (Model(10, 0, 5), Model(15, 5, 10), Model(30, 10, 15), Model(60, 15, 30), Model(100, 30, 60))
CHUNK_6 = Chunk(6, 0, 6)
CHUNK_12 = Chunk(12, 0, 12)
MODEL_13 = Model(13, 0, 6)
MODEL_13_LONG = Model(13, 0, 12)


def assign_chunks(df: DataFrame, chunks: Sequence[Chunk], number: str = "level_num") -> DataFrame:
    """Add ``chunk``, one row per chunk that holds the row; rows in no chunk go."""
    level = F.col("level")
    members = [F.when(c.holds(F.col(number), level), F.lit(c.upper)) for c in chunks]
    return df.withColumn("chunk", F.explode(F.array_compact(F.array(*members))))


def chunk_spec(levels_numbered: DataFrame, chunks: Sequence[Chunk] = CHUNKS) -> DataFrame:
    """Level attempts per chunk, beside the chunk's range; chunks without attempts too."""
    counts = assign_chunks(levels_numbered, chunks).groupBy("chunk").agg(F.count("*").alias("n_levels"))
    ranges = levels_numbered.sparkSession.createDataFrame(
        [(c.upper, c.low, c.high) for c in chunks], "chunk int, lo int, hi int")
    return ranges.join(counts, "chunk", "left").select("chunk", "lo", "hi", F.coalesce("n_levels", F.lit(0)).alias("n_levels"))


def chunk_bounds(
    events: DataFrame, numbered: DataFrame, chunks: Sequence[Chunk] = CHUNKS, fanout: bool = False
) -> DataFrame:
    """First and last victory and their number per (user, chunk).

    Victories collapse per (user, level) on the map side before they meet the level
    numbers, so the join sees one row per level a user won, however often.
    """
    wins = (
        events.where((F.col("event_name") == VICTORY) & F.col("level").isNotNull())
        .groupBy("user_id", "level")
        .agg(F.min("created").alias("first"), F.max("created").alias("last"),
             F.count("*").alias("wins"))
    )
    if any(c.levels for c in chunks):
        won = wins.join(level_numbers(numbered, fanout), ["user_id", "level"], "left")
    else:
        # No chunk holds a higher number, so only the early attempts need joining.
        early = numbered.where(F.col("level_num") < max(c.high for c in chunks))
        won = wins.join(level_numbers(early, fanout), ["user_id", "level"])
    return (
        assign_chunks(won, chunks)
        .groupBy("user_id", "chunk")
        .agg(F.min("first").alias("date_started"), F.max("last").alias("date_completed"),
             F.sum("wins").alias("victories"))
    )


def within_bounds(
    facts: DataFrame,
    bounds: DataFrame,
    start: str = "date_started",
    end: str = "date_completed",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Facts (user_id, created, ...) joined to the bounds of their user that hold them.

    Both ends are inclusive. The join runs on the user with the range as its residual
    condition, and a hot user's facts are dealt to many tasks.
    """
    joined = spread_join(facts, bounds, ["user_id"], hot_rows=hot_rows)
    return joined.where(F.col("created").between(F.col(start), F.col(end)))


def count_inside(bounds: DataFrame, facts: DataFrame, name: str, reference: str = "victories") -> DataFrame:
    """Bounds plus the number of facts inside them over a reference count."""
    counts = within_bounds(facts.select("user_id", "created"), bounds).groupBy("user_id", "chunk").agg(
        F.count("*").alias("_n")
    )
    return (
        bounds.join(counts, ["user_id", "chunk"], "left")
        .withColumn(name, ratio(F.coalesce("_n", F.lit(0)), F.col(reference)))
        .drop("_n")
    )


def average_time(wrap_days: bool = True) -> Column:
    """Seconds per victory; by default only the part of the span within a day counts."""
    span = seconds_within_day if wrap_days else elapsed_seconds
    return ratio(span(F.col("date_started"), F.col("date_completed")), F.col("victories"))


def chunk_features(
    events: DataFrame,
    numbered: DataFrame,
    chunks: Sequence[Chunk] = CHUNKS,
    wrap_days: bool = True,
    bounds: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per (user, chunk): bounds, victories, average time and six rates.

    Events and practice levels go through one join and one aggregate. Victories ride
    along: every chunk holds at least its own, so no outer join back is needed.
    """
    if bounds is None:
        bounds = chunk_bounds(events, numbered, chunks)
    facts = (
        events.where(F.col("event_name").isin(VICTORY, *EVENT_RATES))
        .select("user_id", "created", F.col("event_name").alias("kind"))
        .unionByName(
            numbered.where(F.col("practice"))
            .select("user_id", "created", F.lit(PRACTICE).alias("kind"))
        )
    )
    rates = {**EVENT_RATES, PRACTICE: PRACTICE_RATE}
    span = ("date_started", "date_completed", "victories")
    counted = (
        within_bounds(facts, bounds, hot_rows=hot_rows)
        .groupBy("user_id", "chunk")
        .agg(
            *[F.min(c).alias(c) for c in span],
            *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in rates.items()],
        )
    )
    return counted.select(
        "user_id", "chunk", *span,
        average_time(wrap_days).alias(AVERAGE_TIME),
        *[ratio(F.col(name), F.col("victories")).alias(name) for name in rates.values()],
    )


def language_column(language: str, chunk: Chunk) -> str:
    return f"n_{language}_upto_{chunk.upper}"


def user_language_counts(numbered: DataFrame, chunks: Sequence[Chunk] = CHUNKS) -> DataFrame:
    """Completed levels per language from the start up to each chunk's end, one row per user."""

    def upto(chunk: Chunk) -> Column:
        if chunk.levels:
            return F.col("level").isin(*chunk.levels)
        return F.col("level_num") <= chunk.upper

    done = numbered.where(F.col("date_completed").isNotNull())
    if not any(c.levels for c in chunks):
        done = done.where(F.col("level_num") <= max(c.upper for c in chunks))
    return done.groupBy("user_id").agg(*[
        F.count_if(upto(c) & (F.col("code_language") == language)).alias(language_column(language, c))
        for c in chunks for language in LANGUAGES
    ])


def language_share(count: Column, victories: Column) -> Column:
    """Levels completed in a language over victories in the chunk; zero when undefined."""
    return F.coalesce(ratio(F.coalesce(count, F.lit(0)), victories), F.lit(0.0))


def language_shares(
    spans: DataFrame, numbered: DataFrame, chunks: Sequence[Chunk] = CHUNKS
) -> DataFrame:
    """Add ``share_<language>``: completed levels so far over victories in the chunk.

    The two ranges differ on purpose, so a share can exceed 1.
    """
    joined = spans.join(user_language_counts(numbered, chunks), "user_id", "left")

    def count(language: str) -> Column:
        return F.coalesce(*[
            F.when(F.col("chunk") == c.upper, F.col(language_column(language, c))) for c in chunks
        ])

    return joined.select(
        *spans.columns,
        *[language_share(count(x), F.col("victories")).alias(f"share_{x}") for x in LANGUAGES],
    )
