"""Users, level attempts, events and campaigns derived from the test tables.

See FIXTURES.md. The running level ordinal uses the slot-wise running total, so the
adapter itself holds no user's history in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayline.operators.chunks import Chunk, LANGUAGES, Model
from stayline.operators.levels import number_levels
from stayline.operators.ordered import running_total
from stayline.session import configure, stage

DATA_THROUGH = "2024-02-15"
OPENING_LEVELS = tuple(f"level-{i}" for i in range(1, 7))
# Users of the event log reach 26 levels at most, so there the third prediction point sits
# at 18; all points as they are run over the long histories.
TEST_MODELS = (Model(10, 0, 5), Model(15, 5, 10), Model(18, 10, 15))
TEST_CHUNKS = (Chunk(5, 0, 5), Chunk(10, 5, 10), Chunk(15, 10, 15))

_COUNTRIES = {
    "united-states": (0, 10, 20), "united-kingdom": (1,), "australia": (2,), "canada": (3,),
    "germany": (4,), "russia": (5,), "new-zealand": (6,), "ireland": (7,), "singapore": (8,),
}
_AGES = {"AUTOMOBILE": "13-15", "BUILDING": "16-17", "FURNITURE": "18-24", "MACHINERY": "25-34"}


def _level_name(ordinal: Column, user: Column) -> Column:
    name = F.concat(F.lit("level-"), ordinal.cast("string"))
    return F.when(ordinal <= 12, name).otherwise(
        F.concat(name, F.lit("-"), (user % 3).cast("string"))
    )


@dataclass
class Tables:
    """The derived tables of one scale factor.

    With ``long`` the event log is made of order lines instead, which gives users about a
    hundred levels each, so that every prediction point has users of both classes.
    """

    spark: SparkSession
    folder: str
    long: bool = False

    def __post_init__(self) -> None:
        configure(self.spark)

    def raw(self, name: str) -> DataFrame:
        if self.long and name == "events":
            return self._line_events
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _line_events(self) -> DataFrame:
        """Three events per order line: started, won, and a hint or an alert.

        Every third user has the lines of three customers, about a hundred. The others have
        a few neighbouring orders of customers with odd keys, one to five parts of about
        six lines.
        """
        lines = self.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_shipdate").cast("timestamp").alias("day"), F.sum("l_quantity").alias("value"), F.min("l_partkey").alias("part"))
        order, line = F.col("l_orderkey"), F.col("l_linenumber")
        third = F.element_at(F.array(*map(F.lit, ("error", "signup", "click"))), (order % 3 + 1).cast("int"))
        parts = F.array(*[
            F.struct(F.lit(i).alias("i"), kind.alias("event_type"), wait.cast("long").alias("wait"))
            for i, (kind, wait) in enumerate(((F.lit("view"), F.lit(0)), (F.lit("purchase"), F.col("value") * 60), (third, F.lit(60))))])
        owners = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        group = F.floor(order / 20)
        short = (F.col("o_custkey") % 2 == 1) & (order % 20 < 4 * (group % 5 + 1))
        user = F.when(short, 3 * F.floor(group / 2) + 1 + group % 2).otherwise(3 * F.floor(F.col("o_custkey") / 3))
        seconds = line * 3600 + order % 60 * 60 + F.col("p.wait")
        return lines.join(owners, "l_orderkey").withColumn("p", F.explode(parts)).select(
            ((order * 8 + line) * 4 + F.col("p.i")).alias("event_id"),
            F.timestamp_micros(F.unix_micros("day") + seconds * 1_000_000).alias("ts"),
            user.alias("user_id"), F.col("p.event_type").alias("event_type"), "value",
            F.format_string('{"k": %d}', F.col("part") % 100).alias("props"))

    @cached_property
    def _log(self) -> DataFrame:
        typed = self.raw("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("created"), "user_id", "event_type",
            "value",
            F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k").cast("int")).alias("k"),
        )
        won = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
        numbered = running_total(
            typed, ["user_id"], "created", ["event_id"], "_won", won, include_current=False
        )
        return numbered.withColumn("ordinal", F.col("_won") + 1).withColumn(
            "level", _level_name(F.col("ordinal"), F.col("user_id"))
        )

    @cached_property
    def events(self) -> DataFrame:
        kind = F.col("event_type")
        name = (
            F.when(kind == "purchase", "Saw Victory").when(kind == "view", "Started Level")
            .when(kind == "error", "Show problem alert").when(kind == "signup", "Hint Used")
            .when(F.col("k") < 50, "Hints Clicked").otherwise("Hints Next Clicked")
        )
        level = F.when(~kind.isin("signup", "click"), F.col("level"))
        return self._log.select("event_id", "created", "user_id", name.alias("event_name"),
                                level.alias("level"))

    @cached_property
    def plain_events(self) -> DataFrame:
        """Events without their level, for jobs that do not read it."""
        return self.raw("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("created"), "user_id"
        )

    @cached_property
    def levels(self) -> DataFrame:
        language = F.array(*[F.lit(x) for x in LANGUAGES])
        at = ((F.col("user_id") + F.floor(F.col("ordinal") / 6)) % len(LANGUAGES) + 1).cast("int")
        return (
            self._log.groupBy("user_id", "ordinal", "level")
            .agg(
                F.min("created").alias("created"),
                F.max(F.when(F.col("event_type") == "purchase", F.col("created"))).alias("date_completed"),
                F.sum(F.round(F.col("value") * 100).cast("long")).alias("playtime"),
            )
            .select(
                "user_id", "created", "level", "date_completed", "playtime",
                F.element_at(language, at).alias("code_language"),
                ((F.col("ordinal") * 7 + F.col("user_id")) % 4 == 0).alias("practice"),
            )
        )

    @cached_property
    def numbered(self) -> DataFrame:
        return number_levels(self.levels)

    @cached_property
    def users(self) -> DataFrame:
        activity = self.raw("events").groupBy("user_id").agg(
            F.coalesce(
                F.min(F.when(F.col("event_type") == "signup", F.col("ts"))), F.min("ts")
            ).cast("timestamp").alias("date_joined"),
            F.count_if(F.col("event_type") == "purchase").cast("int").alias("levels_completed"),
        )
        nation = F.col("c_nationkey")
        country = F.when(nation == 9, F.lit(None))
        for name, keys in _COUNTRIES.items():
            country = country.when(nation.isin(*keys), name)
        age = F.lit(None).cast("string")
        for segment, bucket in _AGES.items():
            age = F.when(F.col("c_mktsegment") == segment, bucket).otherwise(age)
        return (
            self.raw("customer").withColumnRenamed("c_custkey", "user_id").join(activity, "user_id")
            .select(
                F.col("user_id").alias("id"), "date_joined", "levels_completed",
                (F.col("c_acctbal") > 0).alias("signed_up"),
                (F.col("c_mktsegment") == "BUILDING").alias("paid_subscription"),
                country.otherwise(F.concat(F.lit("country-"), nation.cast("string"))).alias("country"),
                age.alias("age"),
            )
        )

    @cached_property
    def campaigns(self) -> DataFrame:
        """Campaign of every level name up to ordinal 19; later ones are in none."""
        n = F.col("ordinal")
        campaign = (
            F.when(n <= 4, "dungeon").when(n <= 9, "forest").when(n <= 14, "desert")
            .when(n <= 19, "mountain")
        )
        return self._log.where(n <= 19).select(campaign.alias("campaign"), "level").distinct()

    def staged(self) -> Tables:
        """The same tables read back from written files, for jobs that read them many times.
        Each is written when it is first asked for."""
        return _Staged(self.spark, self.folder, self.long)

    @cached_property
    def order_attempts(self) -> DataFrame:
        """Orders as level attempts, a second and larger source of attempts."""
        return self.raw("orders").select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").cast("timestamp").alias("created"),
            F.col("o_orderpriority").alias("code_language"),
            (F.col("o_orderstatus") != "P").alias("done"),
            F.col("o_orderkey").alias("attempt_id"),
        )

    @cached_property
    def burst_attempts(self) -> DataFrame:
        """Orders as attempts where user 0 makes a third of all within one second, and a
        tenth of those at one instant."""
        key = F.col("o_orderkey")
        micros = F.when(key % 30 == 0, 500_000).otherwise(key * 7919 % 1_000_000)
        burst = F.timestamp_micros(F.lit(1_704_067_200_000_000).cast("long") + micros)
        return self.raw("orders").select(
            F.when(key % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("o_custkey")).alias("user_id"),
            F.when(key % 3 == 0, burst).otherwise(F.col("o_orderdate").cast("timestamp")).alias("created"),
            key.alias("attempt_id"),
        )


class _Staged(Tables):
    @cached_property
    def _log(self) -> DataFrame:
        return stage(Tables._log.func(self), "log")

    @cached_property
    def levels(self) -> DataFrame:
        return stage(Tables.levels.func(self), "levels")

    @cached_property
    def numbered(self) -> DataFrame:
        return stage(Tables.numbered.func(self), "numbered")
