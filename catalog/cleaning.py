"""Projection, cleaning, reshaping, filters, scalar expressions (P, F, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.adapter import DATA_THROUGH, OPENING_LEVELS, Tables
from catalog.base import AGES, COUNTRIES, LANGUAGES, bit, check, days, r6, us
from catalog.sources import EVENTS_SQL, LEVELS_SQL, TEXT_TIME
from stayline.functions import elapsed, labels, people
from stayline.operators import clean
from stayline.operators.lookup import one_user
from stayline.plans.profile import drop_unmodelled, user_profile, with_demographics, with_targets
from stayline.session import fresh_path

_COUNTRY_COLUMNS = [f"country_{c.replace('-', '_')}" for c in (*COUNTRIES, "other_country")]
_AGE_COLUMNS = [f"age_{a.replace('-', '_')}" for a in (*AGES, "other_age")]
_NAMES = ", ".join(f"'{n}'" for n in OPENING_LEVELS)


@check("p1_clean_events", EVENTS_SQL)
def p1(t: Tables) -> DataFrame:
    payload = [F.lit("x").alias(f"raw_event{i}") for i in range(1, 5)]
    raw = t.events.select(
        F.date_format("created", TEXT_TIME).alias("created"), "user_id", "event_name", "level", *payload
    )
    return clean.clean_events(raw)


@check("p2_clean_levels", LEVELS_SQL)
def p2(t: Tables) -> DataFrame:
    text = t.levels.withColumn("created", F.date_format("created", TEXT_TIME)).withColumn(
        "date_completed", F.date_format("date_completed", TEXT_TIME)
    )
    return clean.clean_levels(text.withColumn("Unnamed: 0", F.lit(1)))


@check("p3_repair_header", "SELECT id, country AS joined, age AS first, levels_completed AS second FROM us")
def p3(t: Tables) -> DataFrame:
    shifted = t.users.select(
        "id", F.col("country").alias("head"), F.col("age").alias(" tail"),
        F.col("levels_completed").alias("first"), F.lit(None).cast("int").alias("second"),
    )
    return clean.repair_split_header(shifted, "head", " tail", ["first", "second"], "joined")


@check("p4_select_rename", "SELECT user_id AS id, level AS last_level_played, playtime AS last_level_time_s FROM lv")
def p4(t: Tables) -> DataFrame:
    return t.levels.select("user_id", "level", "playtime").withColumnsRenamed(
        {"user_id": "id", "level": "last_level_played", "playtime": "last_level_time_s"}
    )


@check("p5_drop_unmodelled", f"""
SELECT id, {us('date_joined')}, levels_completed, {bit('signed_up')}, {bit('paid_subscription')},
       country, age FROM us""")
def p5(t: Tables) -> DataFrame:
    profile = user_profile(t.users, t.levels, t.events, DATA_THROUGH, ("event_id",))
    return drop_unmodelled(profile.withColumn("survey_gender", F.lit("x")))


@check("p6_drop_demographics", f"""
SELECT id, levels_completed, {bit('signed_up')}, {bit('paid_subscription')},
       {bit('english_speaking')} FROM demo""")
def p6(t: Tables) -> DataFrame:
    people_only = clean.drop_ages(clean.drop_countries(with_demographics(t.users)))
    return clean.drop_present(people_only, "date_joined", "no_such_column")


@check("p7_drop_id", "SELECT levels_completed, country FROM us")
def p7(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "without-id")
    t.users.select("id", "levels_completed", "country").drop("id").write.parquet(path)
    return t.spark.read.parquet(path)


@check("p8_split_target", f"""
SELECT id, levels_completed AS y, {bit('signed_up')}, country FROM targets""")
def p8(t: Tables) -> DataFrame:
    targets = with_targets(t.users, t.levels, t.campaigns).select(
        "id", "signed_up", "country", *clean.TARGETS
    )
    return clean.split_target(targets, "levels_completed")


@check("p12_fill_age", "SELECT id, coalesce(age, 'other_age') AS age FROM us")
def p12(t: Tables) -> DataFrame:
    return clean.with_age(t.users).select("id", "age")


@check("p13_one_hot", f"SELECT id, {', '.join(_COUNTRY_COLUMNS + _AGE_COLUMNS)} FROM demo")
def p13(t: Tables) -> DataFrame:
    lumped = clean.with_lumped_country(clean.with_age(t.users)).select("id", "country", "age")
    return clean.age_dummies(clean.country_dummies(lumped))


@check("p13_language_dummies", "SELECT user_id, level, " + ", ".join(
    f"CASE WHEN code_language = '{x}' THEN 1 ELSE 0 END AS code_language_{x}" for x in LANGUAGES) + " FROM lv")
def p13_languages(t: Tables) -> DataFrame:
    return clean.language_dummies(t.levels.select("user_id", "level", "code_language"))


@check("p14_english_speaking", f"SELECT id, {bit('english_speaking')} FROM demo")
def p14(t: Tables) -> DataFrame:
    return t.users.select("id", people.english_speaking(F.col("country")).alias("english_speaking"))


@check("p15_country_group", """
SELECT id, CAST(coalesce(country = 'united-states', false) AS INT) AS country_us,
       CASE WHEN country IN ('united-kingdom', 'australia', 'canada', 'new-zealand', 'ireland',
                             'singapore') THEN 1 ELSE 0 END AS country_english_ex_us,
       CASE WHEN country IN ('united-states', 'united-kingdom', 'australia', 'canada', 'new-zealand',
                             'ireland', 'singapore') THEN 0 ELSE 1 END AS country_non_english
FROM us""")
def p15(t: Tables) -> DataFrame:
    return t.users.select("id", *[c.alias(n) for n, c in people.country_groups(F.col("country")).items()])


_KNOWN = ", ".join(f"'{c}'" for c in COUNTRIES)


@check("p16_lump_countries", f"""
SELECT id, CASE WHEN country IN ({_KNOWN}) THEN country ELSE 'other_country' END AS country FROM us""")
def p16(t: Tables) -> DataFrame:
    return clean.with_lumped_country(t.users).select("id", "country")


@check("p17_frequent_countries", """
SELECT id, CASE WHEN n > 6 THEN u.country ELSE 'other_country' END AS country
FROM us u LEFT JOIN (SELECT country, count(*) AS n FROM us GROUP BY country) c ON u.country = c.country""")
def p17(t: Tables) -> DataFrame:
    return clean.with_frequent_country(t.users, over=6).select("id", "country")


@check("p18_drop_duplicates", "SELECT DISTINCT code_language, practice::INT AS practice, level FROM lv")
def p18(t: Tables) -> DataFrame:
    return t.levels.select("code_language", "practice", "level").dropDuplicates()


@check("p19_majority_flag", """
SELECT id, CAST(coalesce(share_python > 0.5, false) AS INT) AS mostly_python
FROM us LEFT JOIN lang ON lang.user_id = us.id AND chunk = 10""")
def p19(t: Tables) -> DataFrame:
    from stayline.operators import chunks as ch

    spans = ch.chunk_bounds(t.events, t.numbered)
    shares = ch.language_shares(spans, t.numbered).where(F.col("chunk") == 10).select(
        F.col("user_id").alias("id"), "share_python"
    )
    return t.users.select("id").join(shares, "id", "left").select(
        "id", clean.majority(F.col("share_python")).alias("mostly_python")
    )


@check("f1_min_levels", "SELECT id, levels_completed FROM us WHERE levels_completed >= 12")
def f1(t: Tables) -> DataFrame:
    return clean.at_least_levels(t.users, 12).select("id", "levels_completed")


@check("f2_complete_rows", f"{LEVELS_SQL} WHERE date_completed IS NOT NULL")
def f2(t: Tables) -> DataFrame:
    return clean.complete_rows(t.levels)


@check("f3_named_levels", f"SELECT user_id, level, playtime FROM lv WHERE level IN ({_NAMES})")
def f3(t: Tables) -> DataFrame:
    return clean.named_levels(t.levels, OPENING_LEVELS).select("user_id", "level", "playtime")


@check("f4_number_range", """
SELECT user_id, level, level_num, CAST(level_num >= 5 AND level_num < 10 AS INT) AS in_range
FROM lvn WHERE level_num <= 10""")
def f4(t: Tables) -> DataFrame:
    upto = clean.numbers_up_to(t.numbered, 10).select("user_id", "level", "level_num")
    inside = clean.number_range(upto, 5, 10).withColumn("in_range", F.lit(True))
    outside = upto.where((F.col("level_num") < 5) | (F.col("level_num") >= 10))
    return inside.unionByName(outside.withColumn("in_range", F.lit(False)))


@check("f5_event_name", f"SELECT event_id, user_id, {us('created')} FROM ev WHERE event_name = 'Saw Victory'")
def f5(t: Tables) -> DataFrame:
    return clean.named_events(t.events, "Saw Victory").select("event_id", "user_id", "created")


@check("f6_flags", """
SELECT 'practice' AS flag, count(*) AS n FROM lv WHERE practice
UNION ALL SELECT 'signed_up', count(*) FROM us WHERE signed_up
UNION ALL SELECT 'unpaid', count(*) FROM us WHERE NOT paid_subscription""")
def f6(t: Tables) -> DataFrame:
    parts = {
        "practice": clean.flagged(t.levels, "practice"),
        "signed_up": clean.flagged(t.users, "signed_up"),
        "unpaid": clean.flagged(t.users, "paid_subscription", False),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("flag"), "n") for k, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@check("f7_completed", "SELECT user_id, level FROM lv WHERE date_completed IS NOT NULL")
def f7(t: Tables) -> DataFrame:
    return clean.completed(t.levels).select("user_id", "level")


@check("f9_active_after", f"""
SELECT user_id, level, {us('created')} FROM lv WHERE created > TIMESTAMP '2024-01-20'""")
def f9(t: Tables) -> DataFrame:
    return clean.active_after(t.levels, "2024-01-20").select("user_id", "level", "created")


@check("f10_one_user", f"""
SELECT 'user' AS source, {us('date_joined', 'at')}, country AS detail FROM us WHERE id = 3
UNION ALL SELECT 'level', epoch_us(created), level FROM lv WHERE user_id = 3
UNION ALL SELECT 'event', epoch_us(created), event_name FROM ev WHERE user_id = 3""")
def f10(t: Tables) -> DataFrame:
    def part(df, source, key, at, detail):
        rows = one_user(df, F.lit(3), key, at)
        return rows.select(F.lit(source).alias("source"), F.col(at).alias("at"), F.col(detail).alias("detail"))

    return (
        part(t.users, "user", "id", "date_joined", "country")
        .unionByName(part(t.levels, "level", "user_id", "created", "level"))
        .unionByName(part(t.events, "event", "user_id", "created", "event_name"))
    )


@check("f11_over_levels", f"SELECT id, levels_completed, {bit('signed_up')} FROM us WHERE levels_completed > 10 AND signed_up")
def f11(t: Tables) -> DataFrame:
    return clean.over_levels(t.users, 10, signed_up_only=True).select("id", "levels_completed", "signed_up")


_LAST_EVENT = """
lastev AS (SELECT user_id, max(created) AS last_event_date FROM ev GROUP BY user_id),
joined AS (SELECT us.*, last_event_date FROM us JOIN lastev ON lastev.user_id = us.id)"""


def _joined(t: Tables) -> DataFrame:
    last = t.plain_events.groupBy(F.col("user_id").alias("id")).agg(F.max("created").alias("last_event_date"))
    return t.users.join(last, "id")


@check("x1_elapsed_days", f"SELECT id, {days('date_joined', 'last_event_date')} AS days FROM joined", _LAST_EVENT)
def x1(t: Tables) -> DataFrame:
    return _joined(t).select(
        "id", elapsed.elapsed_days(F.col("date_joined"), F.col("last_event_date")).alias("days")
    )


@check("x2_seconds_within_day", """
SELECT id, (epoch_us(last_event_date) - epoch_us(date_joined)) % 86400000000 // 1000000 AS seconds FROM joined""",
       _LAST_EVENT)
def x2(t: Tables) -> DataFrame:
    return _joined(t).select(
        "id", elapsed.seconds_within_day(F.col("date_joined"), F.col("last_event_date")).alias("seconds")
    )


@check("x3_elapsed_hours", f"""
SELECT id, {r6("((epoch_us(last_event_date) - epoch_us(date_joined)) // 1000000)::DOUBLE / 3600", 'hours')}
FROM joined""", _LAST_EVENT)
def x3(t: Tables) -> DataFrame:
    return _joined(t).select(
        "id", elapsed.elapsed_hours(F.col("date_joined"), F.col("last_event_date")).alias("hours")
    )


@check("x4_active_days", f"SELECT id, {days('date_joined', 'last_event_date')} + 1 AS days FROM joined", _LAST_EVENT)
def x4(t: Tables) -> DataFrame:
    return _joined(t).select(
        "id", elapsed.active_days(F.col("date_joined"), F.col("last_event_date")).alias("days")
    )


@check("x5_activity_gap", f"""
SELECT id, {days('last_event_date', f"TIMESTAMP '{DATA_THROUGH}'")} AS activity_gap_days FROM joined""", _LAST_EVENT)
def x5(t: Tables) -> DataFrame:
    from stayline.plans.profile import with_activity_gap

    return with_activity_gap(_joined(t), DATA_THROUGH).select("id", "activity_gap_days")


_PLAYED = _LAST_EVENT + """,
played AS (
  SELECT j.*, total_play_time FROM joined j
  LEFT JOIN (SELECT user_id, CAST(sum(playtime) AS BIGINT) AS total_play_time FROM lv GROUP BY user_id) p
  ON p.user_id = j.id)"""


@check("x6_x7_per_level", f"""
SELECT id, {r6('total_play_time::DOUBLE / nullif(levels_completed, 0)', 'avg_play_time_per_level_s')},
       {days('date_joined', 'last_event_date')} + 1 AS daygap,
       {r6(f"({days('date_joined', 'last_event_date')} + 1)::DOUBLE / nullif(levels_completed, 0)", 'avg_num_days_per_level')}
FROM played""", _PLAYED)
def x6(t: Tables) -> DataFrame:
    from stayline.plans.profile import with_play_time, with_rates_per_level

    return with_rates_per_level(with_play_time(_joined(t), t.levels)).select(
        "id", "avg_play_time_per_level_s", "daygap", "avg_num_days_per_level"
    )


@check("x9_was_completed", "SELECT user_id, level, CAST(date_completed IS NOT NULL AS INT) AS done FROM lv")
def x9(t: Tables) -> DataFrame:
    return t.levels.select("user_id", "level", F.col("date_completed").isNotNull().alias("done"))


@check("x10_digitize", """
SELECT id, CASE WHEN levels_completed < 5 THEN 0 WHEN levels_completed < 12 THEN 1
                WHEN levels_completed < 39 THEN 2 WHEN levels_completed < 100 THEN 3
                WHEN levels_completed < 999 THEN 4 ELSE 5 END AS bin FROM us""")
def x10(t: Tables) -> DataFrame:
    return t.users.select("id", labels.digitize(F.col("levels_completed"), labels.DRAFT_BINS_OF_4).alias("bin"))


@check("x11_round", "SELECT user_id, level, round(playtime::DOUBLE / 3600, 4) AS hours FROM lv")
def x11(t: Tables) -> DataFrame:
    return t.levels.select("user_id", "level", F.round(F.col("playtime") / F.lit(3600.0), 4).alias("hours"))


@check("x12_flags", """
SELECT id, CAST(signed_up OR paid_subscription AS INT) AS flag_either,
       CAST(NOT (signed_up OR paid_subscription) AS INT) AS flag_neither FROM us""")
def x12(t: Tables) -> DataFrame:
    either = clean.any_of(F.col("signed_up"), F.col("paid_subscription"))
    named = {"either": either, "neither": ~either}
    return t.users.select("id", *[c.alias(f"flag_{n}") for n, c in named.items()])
