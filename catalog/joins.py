"""Joins, aggregations, windows, ordering (J, F8, A, W, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.adapter import DATA_THROUGH, OPENING_LEVELS, Tables
from catalog.base import bit, check, days, r6, us
from stayline.functions.elapsed import elapsed_days, ratio
from stayline.operators import chunks as ch, clean, frequency as fq, lookup
from stayline.operators.levels import number_levels, tag_events
from stayline.operators.sessions import count_logins, event_gaps, login_starts
from stayline.plans import profile, reports, training

_NAMES = ", ".join(f"'{n}'" for n in OPENING_LEVELS)


@check("j1_attach_to_users", """
SELECT id, levels_completed, total_play_time FROM us
LEFT JOIN (SELECT user_id, CAST(sum(playtime) AS BIGINT) AS total_play_time
           FROM lv GROUP BY user_id) ON user_id = id""")
def j1(t: Tables) -> DataFrame:
    return lookup.attach(t.users.select("id", "levels_completed"), lookup.play_time(t.levels))


@check("j2_event_num", "SELECT event_id, user_id, level, level_num FROM evn", staged=True)
def j2(t: Tables) -> DataFrame:
    return tag_events(t.events, t.numbered).select("event_id", "user_id", "level", "level_num")


@check("j2_event_num_hot", "SELECT event_id, user_id, level, level_num FROM evn", staged=True)
def j2_hot(t: Tables) -> DataFrame:
    """With so low a limit that every level is hot, so all of the log is salted."""
    return tag_events(t.events, t.numbered, hot_rows=3).select("event_id", "user_id", "level", "level_num")


# Attempts of one fourteen-day stretch under one name repeat, as replayed levels do.
_REPLAYED = """
rep AS (SELECT user_id, created, 'replay-' || (level_num % 4) AS level, level_num FROM lvn),
revn AS (SELECT event_id, ev.user_id, rep.level_num FROM ev JOIN lvn ON lvn.user_id = ev.user_id
           AND lvn.level = ev.level JOIN rep ON rep.user_id = ev.user_id
           AND rep.level = 'replay-' || (lvn.level_num % 4))"""


@check("j2_event_num_fanout", """
SELECT event_id, user_id, level_num FROM revn""", _REPLAYED, staged=True)
def j2_fanout(t: Tables) -> DataFrame:
    replay = F.concat(F.lit("replay-"), (F.col("level_num") % 4).cast("string"))
    repeated = t.numbered.withColumn("level", replay)
    tagged = tag_events(t.events, t.numbered).where(F.col("level_num").isNotNull())
    events = tagged.withColumn("level", replay).drop("level_num")
    return tag_events(events, repeated, fanout=True).select("event_id", "user_id", "level_num")


@check("j3_campaign_lookup", """
SELECT lv.user_id, lv.level, coalesce(campaign, 'other') AS campaign FROM lv LEFT JOIN camp USING (level)""")
def j3(t: Tables) -> DataFrame:
    return lookup.with_campaign(t.levels.select("user_id", "level"), t.campaigns, "level")


@check("j4_latest_one", f"""
SELECT user_id, {us('created')}, event_name FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, event_id DESC) AS rn FROM ev)
WHERE rn = 1""")
def j4(t: Tables) -> DataFrame:
    return lookup.latest(t.events, ["event_name"], ["event_id"])


@check("j4_latest_packed", f"""
SELECT user_id, {us('created')}, event_name, level FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', created) DESC,
                               event_name DESC, level DESC NULLS LAST) AS rn
  FROM (SELECT user_id, date_trunc('day', created) AS created, event_name, level FROM ev))
WHERE rn = 1""", staged=True)
def j4_packed(t: Tables) -> DataFrame:
    """By whole days, so that many rows tie and the texts decide; packed at any size."""
    by_day = t.events.withColumn("created", F.date_trunc("day", "created"))
    return lookup.latest(by_day, ["event_name", "level"], ["event_name", "level"], pack=True)


@check("j4_latest_ties", f"""
SELECT DISTINCT user_id, {us('day', 'created')}, code_language FROM (
  SELECT *, rank() OVER (PARTITION BY user_id ORDER BY day DESC) AS rk
  FROM (SELECT *, date_trunc('day', created) AS day FROM lv))
WHERE rk = 1""")
def j4_ties(t: Tables) -> DataFrame:
    by_day = t.levels.withColumn("created", F.date_trunc("day", "created"))
    return lookup.latest(by_day, ["code_language"], ties="all")


@check("j5_of_unpaid_users", f"""
SELECT user_id, level, {us('created')} FROM lv WHERE user_id IN (
  SELECT id FROM us WHERE NOT paid_subscription AND levels_completed > 12)""")
def j5(t: Tables) -> DataFrame:
    return lookup.unpaid_over(t.users, t.levels, 12).select("user_id", "level", "created")


@check("j6_within_bounds", """
SELECT e.event_id, b.user_id, b.chunk FROM bounds b JOIN ev e ON e.user_id = b.user_id
 AND e.created >= b.date_started AND e.created <= b.date_completed""", staged=True)
def j6(t: Tables) -> DataFrame:
    bounds = ch.chunk_bounds(t.events, t.numbered)
    return ch.within_bounds(t.events, bounds).select("event_id", "user_id", "chunk")


@check("f8_between_user_dates", """
SELECT l.user_id, l.level FROM lv l JOIN us ON us.id = l.user_id
JOIN (SELECT user_id, max(created) AS last FROM lv WHERE practice GROUP BY user_id) p ON p.user_id = l.user_id
WHERE l.created >= us.date_joined AND l.created <= p.last""")
def f8(t: Tables) -> DataFrame:
    last = clean.flagged(t.levels, "practice").groupBy("user_id").agg(F.max("created").alias("last"))
    spans = t.users.select(F.col("id").alias("user_id"), "date_joined").join(last, "user_id")
    return ch.within_bounds(t.levels, spans, "date_joined", "last").select("user_id", "level")


@check("j7_inner_aggregates", f"""
SELECT a.user_id, total_play_time, {us('last_done')} FROM
 (SELECT user_id, CAST(sum(playtime) AS BIGINT) AS total_play_time FROM lv GROUP BY user_id) a
 JOIN (SELECT user_id, max(created) AS last_done FROM ev WHERE event_name = 'Saw Victory' GROUP BY user_id) b
 ON a.user_id = b.user_id""")
def j7(t: Tables) -> DataFrame:
    wins = clean.named_events(t.events, ch.VICTORY).withColumnRenamed("created", "last_done")
    return lookup.both(lookup.play_time(t.levels), lookup.last_of(wins, "last_done"))


@check("a1_play_time", """
SELECT id, CAST(sum(playtime) AS BIGINT) AS total_play_time FROM us LEFT JOIN lv ON user_id = id GROUP BY id""")
def a1(t: Tables) -> DataFrame:
    return profile.with_play_time(t.users.select("id"), t.levels)


@check("a2_a3_chunk_bounds", f"""
SELECT user_id, chunk, {us('date_started')}, {us('date_completed')}, victories FROM bounds""", staged=True)
def a2(t: Tables) -> DataFrame:
    return ch.chunk_bounds(t.events, t.numbered)


_BYNAME = f"""
named AS (
  SELECT user_id, 1 AS chunk, min(created) AS date_started, max(created) AS date_completed, count(*) AS victories
  FROM ev WHERE event_name = 'Saw Victory' AND level IN ({_NAMES}) GROUP BY user_id)"""


@check("a2_named_group_bounds", f"""
SELECT user_id, chunk, {us('date_started')}, {us('date_completed')}, victories FROM named""", _BYNAME)
def a2_named(t: Tables) -> DataFrame:
    return ch.chunk_bounds(t.events, t.numbered, [ch.Chunk(1, 0, 0, OPENING_LEVELS)])


@check("x8_average_time", f"""
SELECT user_id, chunk, {r6('avg_time_to_complete_level', 'wrapped')},
       {r6('((epoch_us(date_completed) - epoch_us(date_started)) // 1000000)::DOUBLE / victories', 'true_time')}
FROM uc""", staged=True)
def x8(t: Tables) -> DataFrame:
    bounds = ch.chunk_bounds(t.events, t.numbered)
    return bounds.select(
        "user_id", "chunk", ch.average_time().alias("wrapped"),
        ch.average_time(wrap_days=False).alias("true_time"),
    )


_RATES = [*ch.EVENT_RATES.values(), ch.PRACTICE_RATE]


@check("a4_event_rates", f"""
SELECT user_id, chunk, {', '.join(r6(x, x) for x in _RATES)} FROM uc""", staged=True)
def a4(t: Tables) -> DataFrame:
    return ch.chunk_features(t.events, t.numbered).select("user_id", "chunk", *_RATES)


@check("a4_single_rate", f"SELECT user_id, chunk, {r6('rate_show_problem_alerts', 'rate')} FROM uc", staged=True)
def a4_single(t: Tables) -> DataFrame:
    bounds = ch.chunk_bounds(t.events, t.numbered)
    alerts = clean.named_events(t.events, "Show problem alert")
    return ch.count_inside(bounds, alerts, "rate").select("user_id", "chunk", "rate")


@check("a5_language_shares", f"""
SELECT user_id, chunk, {', '.join(r6('share_' + x, 'share_' + x) for x in ch.LANGUAGES)} FROM lang""", staged=True)
def a5(t: Tables) -> DataFrame:
    spans = ch.chunk_bounds(t.events, t.numbered).select("user_id", "chunk", "victories")
    return ch.language_shares(spans, t.numbered).drop("victories")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@check("a6_level_frequency", "SELECT level, count(*) AS n FROM lv GROUP BY level")
def a6(t: Tables) -> DataFrame:
    return fq.frequencies(t.levels, "level")


@check("a6_language_frequency_orders", """
SELECT o_orderpriority AS code_language, count(*) AS n FROM orders GROUP BY 1""")
def a6_orders(t: Tables) -> DataFrame:
    return fq.frequencies(t.order_attempts, "code_language")


@check("a7_users_per_country", """
SELECT country, count(id) AS id, count(levels_completed) AS levels_completed, count(age) AS age
FROM us WHERE country IS NOT NULL GROUP BY country""")
def a7(t: Tables) -> DataFrame:
    return fq.filled_counts(t.users.select("country", "id", "levels_completed", "age"), "country")


@check("a8_users_by_outcome", """
SELECT levels_completed, last_campaign_started, count(*) AS n FROM targets GROUP BY ALL""")
def a8(t: Tables) -> DataFrame:
    targets = profile.with_targets(t.users, t.levels, t.campaigns)
    return reports.by_outcome(targets, "levels_completed", "last_campaign_started")


_LASTEV = """
lastev AS (SELECT user_id, event_name AS last_action, created AS last_event_date FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, event_id DESC) AS rn FROM ev)
  WHERE rn = 1)"""


@check("a8_users_by_last_action", """
SELECT last_action, epoch_us(date_trunc('day', last_event_date)) AS last_day, count(*) AS n
FROM lastev GROUP BY ALL""", _LASTEV)
def a8_action(t: Tables) -> DataFrame:
    last = profile.with_last_event(t.users, t.events, ["event_id"])
    return reports.by_outcome(last, "last_action", F.date_trunc("day", "last_event_date").alias("last_day"))


@check("a9_distinct_values", "SELECT DISTINCT event_name FROM ev")
def a9(t: Tables) -> DataFrame:
    return fq.distinct_values(t.events, "event_name")


@check("a10_share_of_total", f"""
SELECT country, n, {r6('n::DOUBLE / sum(n) OVER ()', 'share')} FROM (
  SELECT country, count(*) AS n FROM us WHERE country IS NOT NULL GROUP BY country)""")
def a10(t: Tables) -> DataFrame:
    return fq.shares(fq.frequencies(t.users, "country"))


@check("a11_column_maxima", f"""
SELECT user_id, epoch_us(max(created)) AS max_created, max(event_name) AS max_event_name FROM ev GROUP BY user_id""")
def a11(t: Tables) -> DataFrame:
    return lookup.column_maxima(t.events, ["created", "event_name"])


@check("a12_opening_levels", f"""
SELECT user_id, {r6('sum(playtime)::DOUBLE / 6', 'avg_first_playtime_s')},
       epoch_us(max(date_completed)) AS date_completed_first
FROM lv WHERE level IN ({_NAMES}) GROUP BY user_id""")
def a12(t: Tables) -> DataFrame:
    return lookup.opening_levels(t.levels, OPENING_LEVELS)


_AUDITED = ("id", "date_joined", "levels_completed", "signed_up", "paid_subscription", "country", "age")


@check("a13_null_audit", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count({c}) AS filled, "
    f"CAST(count(*) > count({c}) AS INT) AS any_null FROM us" for c in _AUDITED))
def a13(t: Tables) -> DataFrame:
    return clean.null_audit(t.users)


@check("a14_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS filled, {r6(f'avg({c})', 'mean')}, "
    f"{r6(f'stddev_samp({c})', 'std')}, {r6(f'min({c})', 'min')}, "
    + ", ".join(r6(f"quantile_cont({c}::DOUBLE, {q})", n)
                for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
    + f", {r6(f'max({c})', 'max')} FROM {table}"
    for c, table in (("playtime", "lvn"), ("user_id", "lvn"), ("level_num", "lvn"), ("id", "us"),
                     ("levels_completed", "us"))))
def a14(t: Tables) -> DataFrame:
    """All numeric columns of the attempts and of the users."""
    attempts = fq.profile(t.numbered, ["playtime", "user_id", "level_num"])
    return attempts.unionByName(fq.profile(t.users, ["id", "levels_completed"]))


@check("a14_shape", """
SELECT count(*) AS n_rows, 7 AS n_columns, """ + ", ".join(f"count({c}) AS filled_{c}" for c in _AUDITED) + """
FROM us""")
def a14_shape(t: Tables) -> DataFrame:
    return fq.table_shape(t.users)


@check("a15_histogram", f"""
SELECT bin, {r6('6 + 2.4::DOUBLE * (bin - 1)', 'bin_from')}, {r6('6 + 2.4::DOUBLE * bin', 'bin_to')}, n FROM (
  SELECT CAST(least(floor((levels_completed - 6)::DOUBLE * 10 / 24) + 1, 10) AS INT) AS bin, count(*) AS n
  FROM us WHERE levels_completed BETWEEN 6 AND 30 GROUP BY 1)""")
def a15(t: Tables) -> DataFrame:
    return fq.histogram(t.users, "levels_completed", 10, 6, 30)


@check("w1_level_number", "SELECT user_id, level, level_num FROM lvn")
def w1(t: Tables) -> DataFrame:
    return t.numbered.select("user_id", "level", "level_num")


@check("w1_level_number_orders", """
SELECT o_orderkey AS attempt_id, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS level_num FROM orders""")
def w1_orders(t: Tables) -> DataFrame:
    return number_levels(t.order_attempts, ["attempt_id"]).select("attempt_id", "level_num")


@check("w1_level_number_hot", """
SELECT o_orderkey AS attempt_id, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS level_num FROM orders""")
def w1_hot(t: Tables) -> DataFrame:
    """All users above the limit: numbers are carried from slot to slot."""
    return number_levels(t.order_attempts, ["attempt_id"], hot_rows=2).select("attempt_id", "level_num")


@check("w1_level_number_by_range", """
SELECT o_orderkey AS attempt_id, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS level_num FROM orders""")
def w1_by_range(t: Tables) -> DataFrame:
    return number_levels(t.order_attempts, ["attempt_id"], by_range=True).select("attempt_id", "level_num")


_BURST = """
bursts AS (
  SELECT o_orderkey AS attempt_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS user_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 1704067200000000 + CASE WHEN o_orderkey % 30 = 0 THEN 500000 ELSE o_orderkey * 7919 % 1000000 END
              ELSE epoch_us(CAST(o_orderdate AS TIMESTAMP)) END AS instant
  FROM orders)"""
#: So low that the burst is hot, and its one instant heavy, at every size of the tables.
_BURST_ROWS = 40


@check("w1_level_number_burst", """
SELECT attempt_id, row_number() OVER (PARTITION BY user_id ORDER BY instant, attempt_id) AS level_num FROM bursts""", _BURST)
def w1_burst(t: Tables) -> DataFrame:
    """A third of all attempts within one second of one user: slots follow the burst."""
    return number_levels(t.burst_attempts, ["attempt_id"], hot_rows=_BURST_ROWS).select("attempt_id", "level_num")


@check("w2_event_gaps_burst", f"""
SELECT attempt_id, {r6("((instant - lag(instant) OVER (PARTITION BY user_id ORDER BY instant, attempt_id)) // 1000000)::DOUBLE / 3600", 'gap_hours')}
FROM bursts""", _BURST)
def w2_burst(t: Tables) -> DataFrame:
    return event_gaps(t.burst_attempts, ["attempt_id"], hot_rows=_BURST_ROWS).select("attempt_id", "gap_hours")


_GAPS = f"""
SELECT event_id, {r6("((epoch_us(created) - epoch_us(prev)) // 1000000)::DOUBLE / 3600", 'gap_hours')} FROM (
  SELECT event_id, ts AS created, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"""


@check("w2_event_gaps_hot", _GAPS)
def w2_hot(t: Tables) -> DataFrame:
    return event_gaps(t.plain_events, ["event_id"], hot_rows=10).select("event_id", "gap_hours")


@check("w2_event_gaps_by_range", _GAPS)
def w2_by_range(t: Tables) -> DataFrame:
    return event_gaps(t.plain_events, ["event_id"], by_range=True).select("event_id", "gap_hours")


@check("w2_event_gaps", _GAPS)
def w2(t: Tables) -> DataFrame:
    return event_gaps(t.plain_events, ["event_id"]).select("event_id", "gap_hours")


@check("w3_logins", "SELECT user_id, chunk, coalesce(logins, 0) AS logins FROM bounds LEFT JOIN logins USING (user_id, chunk)", staged=True)
def w3(t: Tables) -> DataFrame:
    spans = ch.chunk_bounds(t.events, t.numbered).join(
        t.users.select(F.col("id").alias("user_id"), "date_joined"), "user_id"
    )
    return count_logins(spans, t.plain_events, ["user_id", "chunk"], "date_joined", "date_completed")


@check("w3_logins_in_chunk", """
SELECT b.user_id, b.chunk, count(*) FILTER (WHERE gap >= 2.5) AS logins FROM bounds b LEFT JOIN (
  SELECT user_id, chunk, ((epoch_us(created) - epoch_us(lag(created) OVER (
           PARTITION BY user_id, chunk ORDER BY created, event_id))) // 1000000)::DOUBLE / 3600 AS gap
  FROM (SELECT b.user_id, b.chunk, e.created, e.event_id FROM bounds b JOIN ev e ON e.user_id = b.user_id
        AND e.created >= b.date_started AND e.created <= b.date_completed)) g
ON g.user_id = b.user_id AND g.chunk = b.chunk GROUP BY b.user_id, b.chunk""", staged=True)
def w3_in_chunk(t: Tables) -> DataFrame:
    return count_logins(
        ch.chunk_bounds(t.events, t.numbered), t.plain_events, ["user_id", "chunk"],
        "date_started", "date_completed", threshold_hours=2.5,
    )


@check("w3_login_starts", """
SELECT user_id, epoch_us(created) AS "at", epoch_us(prev) AS previous FROM (
  SELECT user_id, ts AS created, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
WHERE (epoch_us(created) - epoch_us(prev)) // 1000000 >= 3600""")
def w3_starts(t: Tables) -> DataFrame:
    return login_starts(t.plain_events)


_COUNTS = """
counts AS (SELECT levels_completed AS num_levels_completed, count(*) AS final_num_users FROM us GROUP BY 1),
run AS (
  SELECT *, CAST(sum(final_num_users) OVER () AS BIGINT) AS total_users,
         CAST(sum(final_num_users) OVER (ORDER BY num_levels_completed) AS BIGINT) AS cumulative_balked FROM counts),
curve AS (
  SELECT *, total_users - cumulative_balked AS users_remaining,
         coalesce(lag(total_users - cumulative_balked) OVER (ORDER BY num_levels_completed), total_users)
           AS users_previous FROM run)"""


@check("w4_running_users", """
SELECT num_levels_completed, final_num_users, total_users, cumulative_balked FROM curve""", _COUNTS)
def w4(t: Tables) -> DataFrame:
    return reports.with_running_users(reports.final_level_counts(t.users)).select(
        "num_levels_completed", "final_num_users", "total_users", "cumulative_balked"
    )


@check("w5_previous_users", "SELECT num_levels_completed, users_remaining, users_previous FROM curve", _COUNTS)
def w5(t: Tables) -> DataFrame:
    return reports.with_running_users(reports.final_level_counts(t.users)).select(
        "num_levels_completed", "users_remaining", "users_previous"
    )


@check("o1_sorted_users", "SELECT id, levels_completed FROM us ORDER BY levels_completed DESC, id")
def o1(t: Tables) -> DataFrame:
    return t.users.select("id", "levels_completed").orderBy(F.col("levels_completed").desc(), "id")


@check("o2_first_rows", "SELECT id, levels_completed FROM us ORDER BY levels_completed DESC, id LIMIT 10")
def o2(t: Tables) -> DataFrame:
    return fq.first_rows(
        t.users.select("id", "levels_completed"), 10, F.col("levels_completed").desc(), "id"
    )


_RANKED = ("signed_up", "paid_subscription", "english_speaking")


@check("o3_rank_features", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg({f}::INT) - 0.5, 4) AS weight, "
    f"abs(round(avg({f}::INT) - 0.5, 4)) AS abs_weight FROM demo" for f in _RANKED))
def o3(t: Tables) -> DataFrame:
    flags = profile.with_demographics(t.users).select(*[F.col(f).cast("int").alias(f) for f in _RANKED])
    means = training.scaler_statistics(flags, _RANKED)
    return training.rank_features(means.select("feature", (F.col("mean") - 0.5).alias("weight")))
