"""Composite user features and model matrices (C, J8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.adapter import DATA_THROUGH, Tables
from catalog.base import bit, check, days, r6, us
from stayline.operators import chunks as ch, clean
from stayline.plans import matrices as mx, profile
from stayline.sources import tables
from stayline.session import fresh_path, stage

_DUMMIES = [c for c in mx.BASE_FEATURES if c.startswith(("country_", "age_"))]
_FLAGS = [c for c in mx.BASE_FEATURES if c not in _DUMMIES]

LAST_CTES = """
lastev AS (SELECT user_id, event_name AS last_action, created AS last_event_date, level AS last_level_name FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, event_id DESC) AS rn FROM ev)
  WHERE rn = 1),
lasttry AS (SELECT user_id, level AS last_level_played, playtime AS last_level_time_s,
  practice AS last_level_was_practice, date_completed IS NOT NULL AS last_level_was_completed FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, level DESC) AS rn FROM lv)
  WHERE rn = 1)"""


@check("c1_last_play", f"""
SELECT id, {us('last_event_date')}, last_action, last_level_name FROM us LEFT JOIN lastev ON user_id = id""",
       LAST_CTES)
def c1(t: Tables) -> DataFrame:
    return profile.with_last_event(t.users.select("id"), t.events, ["event_id"])


@check("c2_last_attempt", f"""
SELECT id, last_level_played, last_level_time_s, {bit('last_level_was_practice')},
       {bit('last_level_was_completed')} FROM us LEFT JOIN lasttry ON user_id = id""", LAST_CTES)
def c2(t: Tables) -> DataFrame:
    return profile.with_last_attempt(t.users.select("id"), t.levels)


@check("c3_last_level_started", "SELECT id, last_level_started FROM targets")
def c3(t: Tables) -> DataFrame:
    return profile.with_last_level_started(t.users.select("id"), t.levels)


@check("c4_last_campaign", "SELECT id, last_level_started, last_campaign_started FROM targets")
def c4(t: Tables) -> DataFrame:
    return profile.with_targets(t.users.select("id"), t.levels, t.campaigns)


@check("c5_user_profile", f"""
SELECT id, total_play_time, {us('last_event_date')}, last_action, last_level_name,
       {days('date_joined', 'last_event_date')} + 1 AS active_time_days,
       {days('last_event_date', f"TIMESTAMP '{DATA_THROUGH}'")} AS activity_gap_days,
       last_level_played, last_level_time_s, {bit('last_level_was_practice')}, {bit('last_level_was_completed')},
       {r6('total_play_time::DOUBLE / nullif(levels_completed, 0)', 'avg_play_time_per_level_s')},
       {r6(f"({days('date_joined', 'last_event_date')} + 1)::DOUBLE / nullif(levels_completed, 0)",
           'avg_num_days_per_level')}
FROM us LEFT JOIN lastev e ON e.user_id = id LEFT JOIN lasttry l ON l.user_id = id
LEFT JOIN (SELECT user_id, CAST(sum(playtime) AS BIGINT) AS total_play_time FROM lv GROUP BY user_id) p
  ON p.user_id = id""", LAST_CTES, staged=True)
def c5(t: Tables) -> DataFrame:
    return profile.user_profile(t.users, t.levels, t.events, DATA_THROUGH, ["event_id"]).drop(
        "date_joined", "levels_completed", "signed_up", "paid_subscription", "country", "age",
        "data_through", "daygap",
    )


@check("p11_drop_draft_fields", f"""
SELECT levels_completed, {bit('signed_up')}, {bit('paid_subscription')}, country,
       {bit('last_level_was_practice')},
       {r6('total_play_time::DOUBLE / nullif(levels_completed, 0)', 'avg_play_time_per_level_s')},
       {r6(f"({days('date_joined', 'last_event_date')} + 1)::DOUBLE / nullif(levels_completed, 0)",
           'avg_num_days_per_level')}
FROM us LEFT JOIN lastev e ON e.user_id = id LEFT JOIN lasttry l ON l.user_id = id
LEFT JOIN (SELECT user_id, CAST(sum(playtime) AS BIGINT) AS total_play_time FROM lv GROUP BY user_id) p
  ON p.user_id = id""", LAST_CTES)
def p11(t: Tables) -> DataFrame:
    return profile.drop_draft_fields(
        profile.user_profile(t.users, t.levels, t.events, DATA_THROUGH, ["event_id"])
    )


_DEMO = f"""id, {us('date_joined')}, levels_completed, {bit('signed_up')}, {bit('paid_subscription')},
 {bit('english_speaking')}, {', '.join(_DUMMIES)}"""


@check("c6_demographics", f"SELECT {_DEMO} FROM demo")
def c6(t: Tables) -> DataFrame:
    return profile.with_demographics(t.users)


@check("c7_chunk_spec", """
SELECT chunk, lo, hi, count(level_num) AS n_levels FROM spec LEFT JOIN lvn ON level_num >= lo AND level_num < hi
GROUP BY chunk, lo, hi""")
def c7(t: Tables) -> DataFrame:
    return ch.chunk_spec(t.numbered)


_MODEL_ROWS = " UNION ALL ".join(
    f"SELECT {m.threshold} AS model, {m.after} AS lo, {m.upto} AS hi, count(*) AS n FROM us "
    f"WHERE levels_completed >= {m.upto}" for m in ch.MODELS
)


@check("c8_model_population", _MODEL_ROWS)
def c8(t: Tables) -> DataFrame:
    rows = None
    for m in ch.MODELS:
        part = mx.model_population(t.users, m).agg(F.count("*").alias("n")).select(
            F.lit(m.threshold).alias("model"), F.lit(m.after).alias("lo"), F.lit(m.upto).alias("hi"), "n"
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


@check("c9_chunk_block", f"""
SELECT user_id, chunk, {us('date_started')}, {us('date_completed')}, victories,
       {', '.join(r6(f, f) for f in ch.CHUNK_FEATURES)} FROM uc""", staged=True)
def c9(t: Tables) -> DataFrame:
    return ch.chunk_features(t.events, t.numbered)


@check("c9_chunk_block_hot", f"""
SELECT user_id, chunk, {us('date_started')}, {us('date_completed')}, victories,
       {', '.join(r6(f, f) for f in ch.CHUNK_FEATURES)} FROM uc""", staged=True)
def c9_hot(t: Tables) -> DataFrame:
    """With every user above the limit, so the whole log is salted."""
    return ch.chunk_features(t.events, t.numbered, hot_rows=20)


@check("c10_history_block", f"""
SELECT user_id, chunk, {', '.join(r6(s, s) for s in mx.LANGUAGE_SHARES)}, logins FROM feat""", staged=True)
def c10(t: Tables) -> DataFrame:
    return mx.history_rows(mx.wide_features(mx.chunk_facts(t.users, t.events, t.numbered), t.numbered))


def _columns_sql(uppers, newest: int, shares: bool) -> str:
    """Select list over pivoted chunk rows f<upper>."""
    parts = [bit(f) for f in _FLAGS] + list(_DUMMIES)
    for u in uppers:
        parts += [r6(f"f{u}.{f}", mx.chunk_column(f, u)) for f in ch.CHUNK_FEATURES]
    if shares:
        parts += [r6(f"coalesce(f{newest}.{s}, 0)", mx.chunk_column(s, newest)) for s in mx.LANGUAGE_SHARES]
    else:
        parts.append(bit(f"coalesce(f{newest}.share_python > 0.5, false)",
                         mx.chunk_column(mx.MAJORITY_PYTHON, newest)))
    parts.append(f"coalesce(f{newest}.logins, 0) AS {mx.chunk_column(mx.LOGINS, newest)}")
    return ",\n ".join(parts)


def matrix_sql(uppers, newest: int, shares: bool = False, feat: str = "feat", identity: bool = True) -> str:
    joins = "\n".join(
        f"LEFT JOIN (SELECT * FROM {feat} WHERE chunk = {u}) f{u} ON f{u}.user_id = demo.id" for u in uppers
    )
    meta = "id, " if identity else ""
    return f"""
SELECT {meta}levels_completed, last_level_started, last_campaign_started,
 {_columns_sql(uppers, newest, shares)}
FROM demo
{joins}
WHERE levels_completed >= {newest}"""


def wide(t: Tables, chunks=ch.CHUNKS) -> DataFrame:
    s = t.staged()
    return mx.wide_users(s.users, s.numbered, s.events, s.campaigns, chunks)


def _register_files() -> None:
    """c11: each model's own file. c12: the same, cleaned. c13: the cumulative matrix."""
    for model in ch.MODELS:
        own = model.chunks(ch.CHUNKS)
        upto = mx.upto_model(model)
        newest = max(c.upper for c in own)

        def file_query(t: Tables, model=model, own=own) -> DataFrame:
            return mx.model_file(wide(t, own), model, own)

        def clean_query(t: Tables, model=model, own=own, newest=newest) -> DataFrame:
            return mx.clean_model_file(mx.model_file(wide(t, own), model, own), newest)

        def matrix_query(t: Tables, model=model, upto=upto) -> DataFrame:
            return mx.model_matrix(wide(t, upto), model, upto)

        own, upto = [c.upper for c in own], [c.upper for c in upto]

        check(f"c11_user_file_{model.threshold}", matrix_sql(own, newest, shares=True))(file_query)
        check(f"c12_clean_file_{model.threshold}", matrix_sql(own, newest))(clean_query)
        check(f"c13_matrix_{model.threshold}", matrix_sql(upto, newest))(matrix_query)
        # Users of the event log are too short-lived for the late points.
        if model.upto > 15:
            check(f"c11_long_{model.threshold}", matrix_sql(own, newest, shares=True), long=True)(file_query)
            check(f"c12_long_{model.threshold}", matrix_sql(own, newest), long=True)(clean_query)
            check(f"c13_long_{model.threshold}", matrix_sql(upto, newest), long=True)(matrix_query)


_register_files()


@check("j8_matrix_by_joins", matrix_sql([5, 10, 15], 15))
def j8(t: Tables) -> DataFrame:
    models = ch.MODELS[:3]
    chunks = mx.upto_model(models[-1])
    source = stage(wide(t, chunks), "wide-users")
    files = {m.threshold: mx.model_file(source, m, chunks) for m in models}
    return mx.model_matrices_by_joins(files, models, chunks)[30]


@check("c13_written_matrix", matrix_sql([5, 10], 10, identity=False))
def c13_written(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "matrices")
    staged = stage(wide(t), "wide-users")
    tables.write_matrices(mx.model_matrices(staged), path, "train")
    return clean.drop_present(tables.read_matrix(t.spark, path, "train", 15), "id")


@check("c14_standalone_13", matrix_sql([6], 6, shares=True, feat="feat6"))
def c14(t: Tables) -> DataFrame:
    return mx.standalone_matrix(wide(t, (ch.CHUNK_6,)))
