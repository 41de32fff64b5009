"""Sources, sinks, splits, set operations (S, U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from catalog.adapter import Tables
from catalog.base import bit, check, us
from stayline import job
from stayline.operators.clean import clean_events, clean_levels, clean_users
from stayline.session import fresh_path, stage
from stayline.sources import csv, splits, tables
from stayline.sources.schema import RAW_CAMPAIGNS, RAW_LEVELS, RAW_USERS

TEXT_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
USER_COLUMNS = ("id", "date_joined", "levels_completed", "signed_up", "paid_subscription",
                "country", "age")
USERS_SQL = f"""
SELECT id, {us('date_joined')}, levels_completed, {bit('signed_up')}, {bit('paid_subscription')},
       country, age FROM us"""
LEVELS_SQL = f"""
SELECT user_id, {us('created')}, level, {us('date_completed')}, playtime, code_language,
       {bit('practice')} FROM lv"""
EVENTS_SQL = f"SELECT {us('created')}, user_id, event_name, level FROM ev"


def raw_export(df: DataFrame, headers: dict[str, tuple[str, str]], *more) -> DataFrame:
    """A table under its raw headers, times as text."""
    kinds = dict(df.dtypes)

    def text(name: str):
        return F.date_format(name, TEXT_TIME) if kinds[name].startswith("timestamp") else F.col(name)

    return df.select(*[text(name).alias(h) for h, (name, _) in headers.items()], *more)


def written_csv(t: Tables, df: DataFrame, label: str) -> str:
    path = fresh_path(t.spark, label)
    df.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False).csv(path)
    return path


@check("s1_read_users", f"""
SELECT id, {us('date_joined')}, levels_completed, {bit('signed_up')}, {bit('paid_subscription')},
       country, age, country AS survey_how_fast_is_it, age AS survey_would_you_return FROM us""")
def s1(t: Tables) -> DataFrame:
    # One header holds a comma, so its values and the next ones sit one name to the left.
    shifted = raw_export(
        t.users, RAW_USERS,
        F.col("country").alias("After a week"), F.col("age").alias(" how fast is it?"),
        F.lit(None).cast("string").alias("Would you return?"),
    )
    return clean_users(csv.read_users(t.spark, written_csv(t, shifted, "users")))


@check("s1_inferred_types", f"""
SELECT id, levels_completed::BIGINT AS survey_number, CASE WHEN id % 3 = 0 THEN id::DOUBLE ELSE levels_completed::DOUBLE / 4 END AS survey_mixed,
       {bit('signed_up', 'survey_flag')}, {us('date_joined', 'survey_time')},
       CASE WHEN id % 2 = 0 THEN id::VARCHAR ELSE country END AS survey_text, NULL::VARCHAR AS survey_nothing,
       '0' || id AS survey_code FROM us""")
def s1_inferred(t: Tables) -> DataFrame:
    """Survey columns of every kind, and of mixed kinds, under the types their values share."""
    own, quarter = F.col("id").cast("string"), (F.col("levels_completed") / 4).cast("string")
    export = raw_export(
        t.users, RAW_USERS, F.col("levels_completed").cast("string").alias("Number"),
        F.when(F.col("id") % 3 == 0, own).otherwise(quarter).alias("Mixed"),
        F.initcap(F.col("signed_up").cast("string")).alias("Flag"), F.date_format("date_joined", TEXT_TIME).alias("Time"),
        F.when(F.col("id") % 2 == 0, own).otherwise(F.col("country")).alias("Text"),
        F.lit(None).cast("string").alias("Nothing"), F.concat(F.lit("0"), own).alias("Code"))
    users = csv.read_users(t.spark, written_csv(t, export, "users"), infer_survey=True)
    return users.select("id", *[c for c in users.columns if c.startswith("survey_")])


@check("s2_read_levels", LEVELS_SQL)
def s2(t: Tables) -> DataFrame:
    return clean_levels(csv.read_levels(t.spark, written_csv(t, raw_export(t.levels, RAW_LEVELS), "levels")))


def _event_lines(t: Tables) -> str:
    """Event lines by position; some cut after three fields, some two fields too long."""
    kind = F.col("event_id") % 50
    level = F.coalesce("level", F.lit(""))
    fields = [F.date_format("created", TEXT_TIME), F.col("user_id").cast("string"), F.col("event_name")]
    payload = [F.lit("a"), F.lit('"b,b"'), F.lit("c"), F.lit("d")]
    line = (
        F.when(kind == 1, F.concat_ws(",", *fields))
        .when(kind == 2, F.concat_ws(",", *fields, level, *payload, F.lit("e"), F.lit("f")))
        .when(kind == 3, F.concat_ws(",", *fields, level, *payload, F.lit("")))
        .otherwise(F.concat_ws(",", *fields, level, *payload))
    )
    header = "created,user,name,level,p1,p2,p3,p4"
    path = fresh_path(t.spark, "events")
    t.events.select(line.alias(header)).write.options(
        header=True, sep="\x01", quote="", escape="\x02"
    ).csv(path)
    return path


@check("s3_read_events", f"""
SELECT {us('created')}, user_id, event_name,
       CASE WHEN event_id % 50 = 1 THEN NULL ELSE level END AS level
FROM ev WHERE event_id % 50 NOT IN (2, 3)""")
def s3(t: Tables) -> DataFrame:
    return clean_events(csv.read_events(t.spark, _event_lines(t)))


@check("s3_rejected_events", """
SELECT user_id, count(*) AS n FROM ev WHERE event_id % 50 IN (2, 3) GROUP BY user_id""")
def s3_rejected(t: Tables) -> DataFrame:
    lines = csv.read_rejected_events(t.spark, _event_lines(t))
    return lines.groupBy("user_id").agg(F.count("*").alias("n"))


@check("s4_read_campaigns", "SELECT campaign, level FROM camp")
def s4(t: Tables) -> DataFrame:
    return csv.read_campaigns(
        t.spark, written_csv(t, raw_export(t.campaigns, RAW_CAMPAIGNS), "campaigns")
    )


def _parts(t: Tables) -> DataFrame:
    first, second = splits.halves(t.events, "event_id")
    return csv.join_parts(first, second)


@check("s5_join_parts", f"SELECT event_id, {us('created')}, user_id, event_name, level FROM ev")
def s5(t: Tables) -> DataFrame:
    return _parts(t)


@check("u1_union_all", "SELECT event_name, count(*) AS n FROM ev GROUP BY event_name")
def u1(t: Tables) -> DataFrame:
    return _parts(t).groupBy("event_name").agg(F.count("*").alias("n"))


@check("u2_distinct", "SELECT DISTINCT user_id, level, event_name FROM ev")
def u2(t: Tables) -> DataFrame:
    return t.events.select("user_id", "level", "event_name").distinct()


_SPLIT_SQL = "CASE WHEN substr(md5(CAST(id AS VARCHAR)), 1, 2) < 'c0' THEN 'train' ELSE 'test' END"


@check("s6_read_partition", f"""
SELECT id, levels_completed, country FROM us WHERE {_SPLIT_SQL} = 'test'""")
def s6(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "users")
    tables.write_partitioned(
        splits.with_split(t.users.select("id", "levels_completed", "country")), path, "split"
    )
    return tables.read_partition(t.spark, path, split=splits.TEST).drop("split")


@check("s7_write_partitioned", f"""
SELECT {_SPLIT_SQL} AS split, count(*) AS n, CAST(sum(levels_completed) AS BIGINT) AS levels
FROM us GROUP BY 1""")
def s7(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "users")
    tables.write_partitioned(splits.with_split(t.users), path, "split")
    return t.spark.read.parquet(path).groupBy("split").agg(
        F.count("*").alias("n"), F.sum("levels_completed").alias("levels")
    )


@check("s7_write_csv", "SELECT user_id, level, playtime FROM lv")
def s7_csv(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "levels")
    tables.write_csv(t.levels.select("user_id", "level", "playtime"), path)
    return t.spark.read.schema("user_id long, level string, playtime long").option(
        "header", True
    ).csv(path)


@check("s8_user_split", f"SELECT id, {_SPLIT_SQL} AS split FROM us")
def s8(t: Tables) -> DataFrame:
    return splits.with_split(t.users).select("id", "split")


@check("s8_random_split", """
SELECT count(*) AS n_full, 0 AS n_overlap, 0 AS n_missing, 0 AS n_stray FROM us""")
def s8_random(t: Tables) -> DataFrame:
    """A seeded split is complete and disjoint."""
    users = stage(t.users.select("id"), "ids")
    train, test = splits.random_split(users, seed=7)
    return splits.split_audit(users, train, test).drop("n_train", "n_test")


@check("s9_event_halves", """
SELECT CASE WHEN substr(md5(CAST(event_id AS VARCHAR)), 1, 2) < '80' THEN 'a' ELSE 'b' END AS half,
       event_id FROM ev""")
def s9(t: Tables) -> DataFrame:
    a, b = splits.halves(t.events.select("event_id"), "event_id")
    return a.select(F.lit("a").alias("half"), "event_id").unionByName(
        b.select(F.lit("b").alias("half"), "event_id")
    )


@check("s10_split_audit", f"""
SELECT count(*) AS n_full, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'test') AS n_test, CAST(0 AS BIGINT) AS n_overlap,
       CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_stray
FROM (SELECT {_SPLIT_SQL} AS split FROM us)""")
def s10(t: Tables) -> DataFrame:
    users = splits.with_split(t.users.select("id"))
    return splits.split_audit(
        users, users.where(F.col("split") == "train"), users.where(F.col("split") == "test")
    )


@check("u3_split_overlap", f"""
SELECT id, 'overlap' AS kind FROM (
  SELECT id FROM us WHERE {_SPLIT_SQL} = 'train' INTERSECT SELECT id FROM us WHERE signed_up)
UNION ALL
SELECT id, 'uncovered' AS kind FROM (
  SELECT id FROM us EXCEPT SELECT id FROM us WHERE {_SPLIT_SQL} = 'train'
  EXCEPT SELECT id FROM us WHERE signed_up)""")
def u3(t: Tables) -> DataFrame:
    users = splits.with_split(t.users)
    train = users.where(F.col("split") == "train")
    signed = users.where("signed_up")
    return splits.overlap(train, signed).withColumn("kind", F.lit("overlap")).unionByName(
        splits.uncovered(users, train, signed).withColumn("kind", F.lit("uncovered"))
    )


def _exports(t: Tables) -> str:
    """A folder with the four raw exports under the names the job reads."""
    folder = fresh_path(t.spark, "exports")
    payload = [F.lit("x").alias(f"p{i}") for i in range(4)]
    events = {"Created": ("created", ""), "User Id": ("user_id", ""), "Event Name": ("event_name", ""), "Level": ("level", "")}
    for name, df in {
        "users": raw_export(t.users, RAW_USERS), "levels": raw_export(t.levels, RAW_LEVELS),
        "campaign_list": raw_export(t.campaigns, RAW_CAMPAIGNS), "events": raw_export(t.events, events, *payload),
    }.items():
        df.write.options(header=True, quote='"', escape='"').csv(f"{folder}/{name}.csv")
    return folder


_SIDE = "CASE WHEN substr(md5(CAST({} AS VARCHAR)), 1, 2) < 'c0' THEN 'train' ELSE 'test' END AS side"


@check("s11_chosen_side", " UNION ALL ".join(
    f"SELECT side, '{name}' AS log, count(*) AS n, count(DISTINCT k) AS users FROM (SELECT {key} AS k, {_SIDE.format(key)} "
    f"FROM {table}) GROUP BY side UNION ALL SELECT 'all', '{name}', count(*), count(DISTINCT {key}) FROM {table}"
    for name, table, key in (("users", "(SELECT * FROM us WHERE levels_completed >= 1)", "id"), ("numbered", "lv", "user_id"),
                             ("events", "ev", "user_id"))))
def s11(t: Tables) -> DataFrame:
    """The job's logs for each choice of side, from raw exports: rows and users."""
    folder, parts = _exports(t.staged()), []
    for side in ("train", "test", "all"):
        logs = job.read_logs(t.spark, folder, side)
        for name, key in (("users", "id"), ("numbered", "user_id"), ("events", "user_id")):
            parts.append(logs[name].agg(F.count("*").alias("n"), F.count_distinct(key).alias("users")).select(
                F.lit(side).alias("side"), F.lit(name).alias("log"), "n", "users"))
    return reduce(DataFrame.unionByName, parts)
