"""Query registry and the SQL form of the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from catalog.adapter import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# One CTE per derived table; unused ones cost nothing.
_CTES = """
typed AS (
  SELECT event_id, ts AS created, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events),
ordinals AS (
  SELECT *, CAST(1 + coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY created, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ordinal
  FROM typed),
lg AS (
  SELECT *, 'level-' || ordinal || CASE WHEN ordinal <= 12 THEN '' ELSE '-' || (user_id % 3) END AS level
  FROM ordinals),
ev AS (
  SELECT event_id, created, user_id,
         CASE event_type WHEN 'purchase' THEN 'Saw Victory' WHEN 'view' THEN 'Started Level'
              WHEN 'error' THEN 'Show problem alert' WHEN 'signup' THEN 'Hint Used'
              ELSE CASE WHEN k < 50 THEN 'Hints Clicked' ELSE 'Hints Next Clicked' END END AS event_name,
         CASE WHEN event_type IN ('signup', 'click') THEN NULL ELSE level END AS level
  FROM lg),
lv AS (
  SELECT user_id, min(created) AS created, level,
         max(CASE WHEN event_type = 'purchase' THEN created END) AS date_completed,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS playtime,
         (['python', 'lua', 'javascript', 'coffeescript', 'java'])[
            CAST((user_id + ordinal // 6) % 5 + 1 AS INT)] AS code_language,
         (ordinal * 7 + user_id) % 4 = 0 AS practice
  FROM lg GROUP BY user_id, ordinal, level),
act AS (
  SELECT user_id, coalesce(min(CASE WHEN event_type = 'signup' THEN ts END), min(ts)) AS date_joined,
         CAST(count(*) FILTER (WHERE event_type = 'purchase') AS INT) AS levels_completed
  FROM events GROUP BY user_id),
us AS (
  SELECT c_custkey AS id, date_joined, levels_completed, c_acctbal > 0 AS signed_up,
         c_mktsegment = 'BUILDING' AS paid_subscription,
         CASE WHEN c_nationkey IN (0, 10, 20) THEN 'united-states'
              WHEN c_nationkey = 1 THEN 'united-kingdom' WHEN c_nationkey = 2 THEN 'australia'
              WHEN c_nationkey = 3 THEN 'canada' WHEN c_nationkey = 4 THEN 'germany'
              WHEN c_nationkey = 5 THEN 'russia' WHEN c_nationkey = 6 THEN 'new-zealand'
              WHEN c_nationkey = 7 THEN 'ireland' WHEN c_nationkey = 8 THEN 'singapore'
              WHEN c_nationkey = 9 THEN NULL ELSE 'country-' || c_nationkey END AS country,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '13-15' WHEN 'BUILDING' THEN '16-17'
              WHEN 'FURNITURE' THEN '18-24' WHEN 'MACHINERY' THEN '25-34' END AS age
  FROM customer JOIN act ON user_id = c_custkey),
camp AS (
  SELECT DISTINCT CASE WHEN ordinal <= 4 THEN 'dungeon' WHEN ordinal <= 9 THEN 'forest'
                       WHEN ordinal <= 14 THEN 'desert' ELSE 'mountain' END AS campaign, level
  FROM lg WHERE ordinal <= 19),
lvn AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created, level) AS level_num FROM lv),
fn AS (SELECT user_id, level, min(level_num) AS level_num FROM lvn GROUP BY user_id, level),
evn AS (SELECT ev.*, fn.level_num FROM ev LEFT JOIN fn ON ev.user_id = fn.user_id AND ev.level = fn.level),
spec(chunk, lo, hi) AS (VALUES (5, 0, 5), (10, 5, 10), (15, 10, 15), (30, 15, 30), (60, 30, 60)),
spec6(chunk, lo, hi) AS (VALUES (6, 0, 6)),
spec12(chunk, lo, hi) AS (VALUES (12, 0, 12)),
bounds AS (
  SELECT user_id, chunk, min(created) AS date_started, max(created) AS date_completed,
         count(*) AS victories
  FROM evn JOIN spec ON level_num >= lo AND level_num < hi
  WHERE event_name = 'Saw Victory' GROUP BY user_id, chunk),
bounds6 AS (
  SELECT user_id, chunk, min(created) AS date_started, max(created) AS date_completed,
         count(*) AS victories
  FROM evn JOIN spec6 ON level_num >= lo AND level_num < hi
  WHERE event_name = 'Saw Victory' GROUP BY user_id, chunk),
bounds12 AS (
  SELECT user_id, chunk, min(created) AS date_started, max(created) AS date_completed,
         count(*) AS victories
  FROM evn JOIN spec12 ON level_num >= lo AND level_num < hi
  WHERE event_name = 'Saw Victory' GROUP BY user_id, chunk),
"""

_CHUNK_CTES = """
cnt{s} AS (
  SELECT b.user_id, b.chunk,
         count(*) FILTER (WHERE event_name = 'Hint Used') AS hu,
         count(*) FILTER (WHERE event_name = 'Hints Clicked') AS hc,
         count(*) FILTER (WHERE event_name = 'Hints Next Clicked') AS hn,
         count(*) FILTER (WHERE event_name = 'Started Level') AS sl,
         count(*) FILTER (WHERE event_name = 'Show problem alert') AS pa
  FROM bounds{s} b LEFT JOIN ev e ON e.user_id = b.user_id
       AND e.created >= b.date_started AND e.created <= b.date_completed
  GROUP BY b.user_id, b.chunk),
prac{s} AS (
  SELECT b.user_id, b.chunk, count(l.user_id) AS pr
  FROM bounds{s} b LEFT JOIN (SELECT * FROM lv WHERE practice) l ON l.user_id = b.user_id
       AND l.created >= b.date_started AND l.created <= b.date_completed
  GROUP BY b.user_id, b.chunk),
uc{s} AS (
  SELECT b.*,
         CAST((epoch_us(date_completed) - epoch_us(date_started)) % 86400000000 // 1000000 AS DOUBLE)
           / victories AS avg_time_to_complete_level,
         CAST(hu AS DOUBLE) / victories AS rate_hint_used,
         CAST(hc AS DOUBLE) / victories AS rate_hints_clicked,
         CAST(hn AS DOUBLE) / victories AS rate_hints_next_clicked,
         CAST(sl AS DOUBLE) / victories AS rate_started_level,
         CAST(pa AS DOUBLE) / victories AS rate_show_problem_alerts,
         CAST(pr AS DOUBLE) / victories AS rate_practice_levels
  FROM bounds{s} b JOIN cnt{s} USING (user_id, chunk) JOIN prac{s} USING (user_id, chunk)),
lang{s} AS (
  SELECT b.user_id, b.chunk,
         {shares}
  FROM bounds{s} b LEFT JOIN lvn l ON l.user_id = b.user_id AND l.level_num <= b.chunk
       AND l.date_completed IS NOT NULL
  GROUP BY b.user_id, b.chunk, b.victories),
inspan{s} AS (
  SELECT b.user_id, b.chunk, e.created,
         lag(e.created) OVER (PARTITION BY b.user_id, b.chunk ORDER BY e.created, e.event_id) AS prev
  FROM bounds{s} b JOIN us ON us.id = b.user_id JOIN ev e ON e.user_id = b.user_id
       AND e.created >= us.date_joined AND e.created <= b.date_completed),
logins{s} AS (
  SELECT user_id, chunk,
         count(*) FILTER (WHERE (epoch_us(created) - epoch_us(prev)) // 1000000 >= 3600) AS logins
  FROM inspan{s} GROUP BY user_id, chunk),
feat{s} AS (
  SELECT uc{s}.*, lang{s}.* EXCLUDE (user_id, chunk), coalesce(logins, 0) AS logins
  FROM uc{s} JOIN us ON us.id = uc{s}.user_id JOIN lang{s} USING (user_id, chunk)
  LEFT JOIN logins{s} USING (user_id, chunk)),
"""

_PEOPLE_CTES = """
lastdone AS (
  SELECT user_id, level AS last_level_started FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, level DESC) AS rn
    FROM lv WHERE date_completed IS NOT NULL) WHERE rn = 1),
targets AS (
  SELECT us.*, last_level_started, coalesce(campaign, 'other') AS last_campaign_started
  FROM us LEFT JOIN lastdone ON lastdone.user_id = us.id
  LEFT JOIN camp ON camp.level = last_level_started),
demo AS (
  SELECT id, date_joined, levels_completed, signed_up, paid_subscription,
         last_level_started, last_campaign_started,
         coalesce(country IN ('united-states', 'united-kingdom', 'australia', 'canada',
                              'new-zealand', 'ireland', 'singapore'), false) AS english_speaking,
         {countries},
         {ages}
  FROM targets)
"""

LANGUAGES = ("python", "lua", "javascript", "coffeescript", "java")
COUNTRIES = ("united-states", "united-kingdom", "australia", "canada", "germany", "russia")
AGES = ("13-15", "16-17", "18-24", "25-34", "35-44", "45-100")


def _dummy(prefix: str, value: str) -> str:
    return f"{prefix}_{value.replace('-', '_')}"


def _prefix() -> str:
    shares = ",\n         ".join(
        f"CAST(count(*) FILTER (WHERE code_language = '{x}') AS DOUBLE) / victories AS share_{x}"
        for x in LANGUAGES
    )
    known = ", ".join(f"'{c}'" for c in COUNTRIES)
    countries = [
        f"CASE WHEN country = '{c}' THEN 1 ELSE 0 END AS {_dummy('country', c)}" for c in COUNTRIES
    ]
    countries.append(
        f"CASE WHEN country IN ({known}) THEN 0 ELSE 1 END AS country_other_country"
    )
    ages = [f"CASE WHEN age = '{a}' THEN 1 ELSE 0 END AS {_dummy('age', a)}" for a in AGES]
    ages.append("CASE WHEN age IS NULL THEN 1 ELSE 0 END AS age_other_age")
    chunk = "".join(
        _CHUNK_CTES.replace("{s}", s).replace("{shares}", shares) for s in ("", "6", "12")
    )
    people = _PEOPLE_CTES.replace("{countries}", ",\n         ".join(countries)).replace(
        "{ages}", ",\n         ".join(ages)
    )
    return "WITH " + _CTES.strip() + "\n" + chunk.strip() + "\n" + people.strip()


PREFIX = _prefix()
LONG_PREFIX = """WITH lines AS (
  SELECT l_orderkey, l_linenumber, min(l_shipdate) AS day, sum(l_quantity) AS value, min(l_partkey) AS part
  FROM lineitem GROUP BY ALL),
line_events AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 4 + i AS event_id,
         make_timestamp(epoch_us(day) + (l_linenumber * 3600 + l_orderkey % 60 * 60
                        + CASE i WHEN 0 THEN 0 WHEN 1 THEN CAST(value * 60 AS BIGINT) ELSE 60 END) * 1000000) AS ts,
         CASE WHEN o_custkey % 2 = 1 AND l_orderkey % 20 < 4 * (l_orderkey // 20 % 5 + 1)
              THEN 3 * (l_orderkey // 20 // 2) + 1 + l_orderkey // 20 % 2 ELSE 3 * (o_custkey // 3) END AS user_id,
         CASE i WHEN 0 THEN 'view' WHEN 1 THEN 'purchase' ELSE (['error', 'signup', 'click'])[l_orderkey % 3 + 1] END AS event_type,
         value, '{"k": ' || (part % 100) || '}' AS props
  FROM lines JOIN orders ON o_orderkey = l_orderkey CROSS JOIN (VALUES (0), (1), (2)) AS x(i)),
""" + PREFIX.removeprefix("WITH ").replace("FROM events", "FROM line_events")


def flat(df: DataFrame) -> DataFrame:
    """Comparable values: times as epoch microseconds, flags as 0/1, doubles at 6 places."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(kind, T.BooleanType):
            c = c.cast("int")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def check(name: str, sql: str | None = None, ctes: str = "", staged: bool = False, long: bool = False):
    """Register a query over the derived tables, with its oracle if it has one.

    ``ctes`` adds further tables to the shared ones. ``staged`` writes the derived logs
    once, for queries that read them several times. ``long`` takes the long histories.
    """

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tables = Tables(spark, folder, long)
            return flat(build(tables.staged() if staged else tables))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            extra = f",\n{ctes.strip()}" if ctes else ""
            ORACLES[name] = f"{LONG_PREFIX if long else PREFIX}{extra}\n{sql.strip()}"
        return build

    return register


def us(column: str, name: str | None = None) -> str:
    """SQL for a time as epoch microseconds."""
    return f"epoch_us({column}) AS {name or column.split('.')[-1]}"


def bit(column: str, name: str | None = None) -> str:
    """SQL for a flag as 0/1."""
    return f"CAST({column} AS INT) AS {name or column.split('.')[-1]}"


def r6(expression: str, name: str) -> str:
    """SQL for a double at 6 places."""
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


def days(start: str, end: str) -> str:
    """SQL for whole elapsed days."""
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / CAST(86400000000 AS DOUBLE)) AS BIGINT)"
