"""Descriptive analyses (E, F12)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from catalog.adapter import DATA_THROUGH, OPENING_LEVELS, Tables
from catalog.base import check, days, r6, us
from catalog.joins import _COUNTS
from stayline.operators import frequency as fq
from stayline.plans import reports

_NAMES = ", ".join(f"'{n}'" for n in OPENING_LEVELS)
_POPULAR = "SELECT level, campaign, n FROM (SELECT level, count(*) AS n FROM lv {where} GROUP BY level) LEFT JOIN camp USING (level)"
_UNPAID = "WHERE user_id IN (SELECT id FROM us WHERE NOT paid_subscription AND levels_completed > 12)"
CAMPAIGNS = ("dungeon", "forest", "desert", "mountain", "glacier")


@check("e1_drop_off", f"""
SELECT num_levels_completed, final_num_users, total_users, cumulative_balked, users_remaining, users_previous,
       {r6('users_remaining::DOUBLE / users_previous', 'percent_retained')},
       {r6('1 - users_remaining::DOUBLE / users_previous', 'percent_balk')} FROM curve""", _COUNTS)
def e1(t: Tables) -> DataFrame:
    return reports.drop_off(t.users)


@check("e1_worst_drops", f"""
SELECT num_levels_completed, {r6('1 - users_remaining::DOUBLE / users_previous', 'percent_balk')} FROM curve""", _COUNTS)
def e1_worst(t: Tables) -> DataFrame:
    return reports.worst_drops(reports.drop_off(t.users))


@check("e2_level_popularity", _POPULAR.format(where=""))
def e2(t: Tables) -> DataFrame:
    return reports.level_popularity(t.levels, t.campaigns)


@check("e3_unpaid_popularity", _POPULAR.format(where=_UNPAID))
def e3(t: Tables) -> DataFrame:
    return reports.unpaid_popularity(t.users, t.levels, t.campaigns)


@check("f12_campaign_rows", _POPULAR.format(where=_UNPAID) + " WHERE campaign IS NOT NULL")
def f12(t: Tables) -> DataFrame:
    return reports.of_campaigns(reports.unpaid_popularity(t.users, t.levels, t.campaigns), *CAMPAIGNS)


@check("f12_last_campaign_other", "SELECT id, levels_completed FROM targets WHERE last_campaign_started = 'other'")
def f12_other(t: Tables) -> DataFrame:
    from stayline.plans.profile import with_targets

    targets = with_targets(t.users, t.levels, t.campaigns)
    return targets.where(targets["last_campaign_started"] == "other").select("id", "levels_completed")


_GAPS = f"""
gaps AS (SELECT user_id, max(created) AS last_created,
         {days('max(created)', f"TIMESTAMP '{DATA_THROUGH}'")} AS days_gap FROM lv GROUP BY user_id)"""


@check("e4_days_since_last", f"SELECT user_id, {us('last_created')}, days_gap FROM gaps", _GAPS)
def e4(t: Tables) -> DataFrame:
    return reports.days_since_last(t.levels, DATA_THROUGH)


def histogram_sql(table: str, column: str, bins: int, low: float, high: float, where: str = "true") -> str:
    """Same bins as the operator, by plain arithmetic."""
    width = f"({high} - {low})::DOUBLE / {bins}"
    return f"""
SELECT bin, {r6(f'{low} + ({width}) * (bin - 1)', 'bin_from')}, {r6(f'{low} + ({width}) * bin', 'bin_to')}, n FROM (
  SELECT CAST(least(floor(({column} - {low})::DOUBLE * {bins} / ({high} - {low})) + 1, {bins}) AS INT) AS bin,
         count(*) AS n
  FROM {table} WHERE {column} BETWEEN {low} AND {high} AND {where} GROUP BY 1)"""


@check("e4_inactivity", histogram_sql("gaps", "days_gap", 10, 0, 150), _GAPS)
def e4_histogram(t: Tables) -> DataFrame:
    return reports.inactivity(t.levels, DATA_THROUGH, 10, 0, 150)


def growing_sql(table: str, column: str, bins: int, fine: int) -> str:
    """The least power of two, not below the widest cell, that needs ``bins`` bins at most."""
    count = "floor(hi / pow(2, p)) - floor(lo / pow(2, p)) + 1"
    return f"""
SELECT CAST(floor(x / w) - floor(lo / w) + 1 AS INT) AS bin, {r6('floor(x / w) * w', 'bin_from')},
       {r6('floor(x / w) * w + w', 'bin_to')}, count(*) AS n
FROM (SELECT {column}::DOUBLE AS x FROM {table}) LEFT JOIN (
  SELECT lo, pow(2, min(p)) AS w FROM (
    SELECT lo, hi, unnest(range(-40, 60)) AS p,
           list_max(list_filter(range(-40, 60), lambda e: pow(2, e) <= greatest(abs(lo), abs(hi)))) AS octave
    FROM (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {table}))
  WHERE p >= octave - {fine} AND {count} <= {bins} GROUP BY lo) ON x IS NOT NULL
GROUP BY ALL"""


@check("e4_inactivity_growing", growing_sql("gaps", "days_gap", 12, 5), _GAPS)
def e4_growing(t: Tables) -> DataFrame:
    return reports.inactivity(t.levels, DATA_THROUGH, 12)


@check("e5_levels_growing", growing_sql("us", "levels_completed", 10, 5))
def e5_growing(t: Tables) -> DataFrame:
    return reports.levels_distribution(t.users, 10)


@check("e5_levels_outside", """
SELECT CASE WHEN levels_completed < 10 THEN 0 WHEN levels_completed > 15 THEN 6 ELSE least(levels_completed - 9, 5) END AS bin,
       CASE WHEN bin > 0 THEN (9 + bin)::DOUBLE END AS bin_from, CASE WHEN bin < 6 THEN (10 + bin)::DOUBLE END AS bin_to, count(*) AS n
FROM us GROUP BY ALL""")
def e5_outside(t: Tables) -> DataFrame:
    return reports.levels_distribution(t.users, 5, 10, 15, outside=True)


@check("a15_value_growing", growing_sql("events", "value", 40, 7))
def a15_growing(t: Tables) -> DataFrame:
    return fq.growing_histogram(t.raw("events"), "value", 40)


@check("e5_levels_all", histogram_sql("us", "levels_completed", 10, 6, 30))
def e5(t: Tables) -> DataFrame:
    return reports.levels_distribution(t.users, 10, 6, 30)


@check("e5_levels_over_10", histogram_sql("us", "levels_completed", 25, 11, 36, "levels_completed > 10"))
def e5_over(t: Tables) -> DataFrame:
    return reports.levels_distribution(t.users, 25, 11, 36, over=10)


@check("e5_levels_signed_up", histogram_sql("us", "levels_completed", 10, 10, 25, "levels_completed > 10 AND signed_up"))
def e5_signed(t: Tables) -> DataFrame:
    return reports.levels_distribution(t.users, 10, 10, 25, over=10, signed_up_only=True)


_ENGLISH = "'united-states', 'united-kingdom', 'australia', 'canada', 'new-zealand', 'ireland', 'singapore'"


@check("e6_country_shares", f"""
SELECT CAST(sum(n) AS BIGINT) AS total,
       {r6("sum(CASE WHEN country = 'united-states' THEN n ELSE 0 END)::DOUBLE / sum(n)", 'us_share')},
       {r6(f"sum(CASE WHEN country IN ({_ENGLISH}) THEN n ELSE 0 END)::DOUBLE / sum(n)", 'english_share')},
       {r6("sum(CASE WHEN country IS NOT NULL AND n > 6 THEN n ELSE 0 END)::DOUBLE / sum(n)", 'frequent_share')}
FROM (SELECT country, count(*) AS n FROM us GROUP BY country)""")
def e6(t: Tables) -> DataFrame:
    return reports.country_shares(t.users, over=6)


@check("e6_age_shares", f"""
SELECT age, n, {r6('n::DOUBLE / sum(n) OVER ()', 'share')} FROM (
  SELECT age, count(*) AS n FROM us WHERE age IS NOT NULL GROUP BY age)""")
def e6_age(t: Tables) -> DataFrame:
    return reports.age_shares(t.users)


@check("e7_level_mix", "SELECT level, count(*) AS n FROM lvn WHERE level_num = 14 GROUP BY level")
def e7(t: Tables) -> DataFrame:
    return reports.level_mix(t.numbered, 14)


@check("e8_language_mix", f"SELECT code_language, count(*) AS n FROM lv WHERE level IN ({_NAMES}) GROUP BY 1")
def e8(t: Tables) -> DataFrame:
    return reports.language_mix(t.levels, OPENING_LEVELS)


@check("e9_latest_activity", """
SELECT id, levels_completed, epoch_us(last_event_date) AS last_event_date, last_action FROM us LEFT JOIN (
  SELECT user_id, max(created) AS last_event_date, max(event_name) AS last_action FROM ev GROUP BY user_id)
ON user_id = id""")
def e9(t: Tables) -> DataFrame:
    return reports.latest_activity(t.users.select("id", "levels_completed"), t.events)
