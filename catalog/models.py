"""Labels, models, evaluation, explanation (M, P10).

Models are fitted with the library's defaults: full grids, folds, trees and iterations. A
fitted model has no SQL form, so its query returns what SQL can state: the rows scored, and
that the fit meets its optimality conditions, keeps probabilities in their range, tries every
setting, or predicts the same after it was saved.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from catalog.adapter import TEST_CHUNKS, TEST_MODELS, Tables
from catalog.base import check, r6
from catalog.features import matrix_sql, wide
from stayline.functions import labels
from stayline.operators import chunks as ch, evaluate
from stayline.plans import matrices as mx, path, profile, scoring, training, trees
from stayline.plans.scoring import Change
from stayline.session import fresh_path, stage
from stayline.sources.splits import TEST, TRAIN, with_class_folds, with_class_split, with_split

FIRST = TEST_MODELS[0]
FIRST_CHUNKS = TEST_CHUNKS[:1]
FIRST_FEATURES = mx.model_features(FIRST, FIRST_CHUNKS)
NUMERIC = [f for f in FIRST_FEATURES if "_chunk_5" in f and not f.startswith(mx.MAJORITY_PYTHON)]
# Complete rows of the first matrix with their label.
_DATA = f"""
mat AS ({matrix_sql([5], 5)}),

dat AS (SELECT *, CASE WHEN levels_completed >= 999 THEN 1 WHEN levels_completed >= 10 THEN 1 ELSE 0 END AS y
        FROM mat WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FIRST_FEATURES)})"""


def first_data(t: Tables) -> DataFrame:
    """Labelled complete rows of the first prediction point, written once."""
    matrix = mx.model_matrix(wide(t, FIRST_CHUNKS), FIRST, FIRST_CHUNKS)
    return stage(training.labelled(matrix, FIRST_FEATURES, FIRST.threshold), "labelled")


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = with_split(df)
    return (split.where(F.col("split") == TRAIN).drop("split"),
            split.where(F.col("split") == TEST).drop("split"))


@check("m1_level_classes", """
SELECT id, CASE WHEN levels_completed >= 999 THEN 2 WHEN levels_completed >= 13 THEN 1 ELSE 0 END AS y2,
       CASE WHEN levels_completed >= 999 THEN 4 WHEN levels_completed >= 21 THEN 3
            WHEN levels_completed >= 13 THEN 2 ELSE 1 END AS y3,
       CASE WHEN levels_completed >= 999 THEN 5 WHEN levels_completed >= 100 THEN 4
            WHEN levels_completed >= 30 THEN 3 WHEN levels_completed >= 13 THEN 2 ELSE 1 END AS y4,
       CASE WHEN levels_completed >= 999 THEN 3 WHEN levels_completed >= 20 THEN 2
            WHEN levels_completed >= 5 THEN 1 ELSE 0 END AS draft2,
       CASE WHEN levels_completed >= 10 THEN 1 ELSE 0 END AS continues FROM us""")
def m1(t: Tables) -> DataFrame:
    done = F.col("levels_completed")
    return t.users.select(
        "id", labels.level_class(done, 2).alias("y2"), labels.level_class(done, 3).alias("y3"),
        labels.level_class(done, 4).alias("y4"),
        labels.digitize(done, labels.DRAFT_BINS_OF_2).alias("draft2"),
        labels.continues(done, 10).alias("continues"),
    )


@check("m2_campaign_classes", """
SELECT id, CASE WHEN c = 'dungeon' THEN 'early_churn' ELSE 'later_churn' END AS y2,
       CASE WHEN c = 'dungeon' THEN 'early_churn'
            WHEN c IN ('campaign-web-dev-1', 'campaign-game-dev-1', 'forest') THEN 'mid_churn'
            ELSE 'later_churn' END AS y3,
       CASE WHEN c = 'dungeon' THEN 'early_churn'
            WHEN c IN ('campaign-web-dev-1', 'campaign-game-dev-1', 'forest') THEN 'mid_churn'
            WHEN c IN ('campaign-web-dev-2', 'campaign-game-dev-2', 'desert', 'mountain', 'glacier')
            THEN 'later_churn' ELSE 'other' END AS y4
FROM (SELECT id, last_campaign_started AS c FROM targets)""")
def m2(t: Tables) -> DataFrame:
    campaign = F.col("last_campaign_started")
    return profile.with_targets(t.users, t.levels, t.campaigns).select(
        "id", *[labels.campaign_class(campaign, n).alias(f"y{n}") for n in (2, 3, 4)]
    )


@check("p10_one_feature", f"SELECT id, y, {NUMERIC[0]} FROM dat", _DATA)
def p10(t: Tables) -> DataFrame:
    return training.one_feature(first_data(t), NUMERIC[0])


def _exact(f: str) -> str:
    """A feature before rounding: measured ones from their table, flags from the matrix."""
    return f"feat.{f.replace('_chunk_5', '')}::DOUBLE" if f in NUMERIC else f"CAST(dat.{f} AS INT)::DOUBLE"


@check("m3_scaler_statistics", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r6(f'avg({f})', 'mean')}, {r6(f'stddev_samp({f})', 'std')}, "
    f"{r6(f'stddev_pop({f})', 'std_pop')} FROM exact" for f in FIRST_FEATURES), _DATA + f""",
exact AS (
  SELECT {', '.join(f"{_exact(f)} AS {f}" for f in FIRST_FEATURES)}
  FROM dat JOIN feat ON feat.user_id = dat.id AND feat.chunk = 5)""")
def m3(t: Tables) -> DataFrame:
    return training.scaler_statistics(first_data(t), FIRST_FEATURES)


@check("m4_scale_by_self", f"""
SELECT user_id AS id, {', '.join(
    r6(f'(x_{i} - avg(x_{i}) OVER ()) / CASE WHEN stddev_pop(x_{i}) OVER () = 0 THEN 1 ELSE stddev_pop(x_{i}) OVER () END', f)
    for i, f in enumerate(FIRST_FEATURES))}
FROM (SELECT feat.user_id, {', '.join(f"{_exact(f)} AS x_{i}" for i, f in enumerate(FIRST_FEATURES))}
      FROM dat JOIN feat ON feat.user_id = dat.id AND feat.chunk = 5)""", _DATA)
def m4(t: Tables) -> DataFrame:
    return training.scale_by_self(first_data(t).select("id", *FIRST_FEATURES), FIRST_FEATURES)


@check("m5_class_weights", f"""
SELECT y, count(*) AS n, {r6('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 'weight')}
FROM dat GROUP BY y""", _DATA)
def m5_weights(t: Tables) -> DataFrame:
    return training.class_weights(first_data(t))


def _held_out(t: Tables, fit) -> tuple:
    data = first_data(t)
    train, test = train_test(data)
    model = fit(train, FIRST_FEATURES)
    return model, training.predict(model, test)


#: Greatest slope, per coefficient, that counts as a solved fit.
SOLVED = 2e-3
_HELD = "substr(md5(CAST(id AS VARCHAR)), 1, 2) >= 'c0'"
_HELD_ROWS = f"SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, %s FROM dat WHERE {_HELD}"


def _solved(model, train: DataFrame) -> bool:
    return training.steepest(model, train).first()["miss"] < SOLVED


@check("m5_multinomial", _HELD_ROWS % "1 AS solved", _DATA)
def m5(t: Tables) -> DataFrame:
    train, test = train_test(first_data(t))
    model = training.fit_weighted_logistic(train, FIRST_FEATURES)
    solved = _solved(model, training.with_class_weights(train))
    return training.predict(model, test).agg(
        F.count("*").alias("n"), F.sum("y").alias("positives"), F.lit(solved).alias("solved"))


@check("m6_lasso", _HELD_ROWS % "1 AS solved", _DATA)
def m6(t: Tables) -> DataFrame:
    train, test = train_test(first_data(t))
    model = training.tune_lasso(train, FIRST_FEATURES).model
    return training.predict(model, test).agg(
        F.count("*").alias("n"), F.sum("y").alias("positives"), F.lit(_solved(model, train)).alias("solved"))


_CLASS_FOLDS = f"""
tr AS (SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR)), id) - 1) % 5 AS fold
       FROM dat WHERE NOT ({_HELD}))"""


@check("m6_class_folds", "SELECT id, y, fold FROM tr", f"{_DATA},{_CLASS_FOLDS}")
def m6_folds(t: Tables) -> DataFrame:
    """The folds of the searches: every class dealt evenly."""
    return with_class_folds(train_test(first_data(t))[0].select("id", "y"), training.FOLDS)


@check("m6_lasso_path", "SELECT c, k AS fold, n, held, 1 AS solved FROM (" + " UNION ALL ".join(
    f"SELECT {k} AS k, count(*) FILTER (WHERE fold <> {k}) AS n, count(*) FILTER (WHERE fold = {k}) AS held, "
    f"count(DISTINCT y) FILTER (WHERE fold <> {k}) AS classes FROM tr" for k in range(training.FOLDS))
    + ") CROSS JOIN (VALUES " + ", ".join(f"({c}::DOUBLE)" for c in training.LASSO_C) + ") AS g(c) WHERE classes > 1",
    f"{_DATA},{_CLASS_FOLDS}")
def m6_path(t: Tables) -> DataFrame:
    """All 35 fits of the search, in shared passes: each meets its optimality conditions."""
    train = with_class_folds(train_test(first_data(t))[0], training.FOLDS)
    found = path.lasso_path(train, FIRST_FEATURES, training.LASSO_C, training.FOLDS)
    rows = [(f.c, f.fold, f.rows, f.held, f.solved) for f in found.fits]
    return t.spark.createDataFrame(rows, "c double, fold int, n long, held long, solved boolean")


@check("s8_class_split", """
SELECT id, y, CASE WHEN rk <= round(0.75 * n) THEN 'train' ELSE 'test' END AS split
FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR)), id) AS rk,
             count(*) OVER (PARTITION BY y) AS n FROM dat)""", _DATA)
def s8_class_split(t: Tables) -> DataFrame:
    return with_class_split(first_data(t).select("id", "y"))


def _recomputed(model, scored: DataFrame) -> DataFrame:
    """Rows, positives, and the rows whose class and score the nodes alone repeat."""
    nodes = stage(trees.nodes(scored.sparkSession, model), "nodes")
    again = trees.scored(scored.withColumnsRenamed({"prediction": "p", "score": "s"}), nodes, FIRST_FEATURES)
    same = (F.col("prediction") == F.col("p")) & (F.abs(F.col("score") - F.col("s")) < 1e-9)
    return again.agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.count_if(same).alias("same"))


@check("m7_forest_grid", _HELD_ROWS % "count(*) AS same", _DATA)
def m7(t: Tables) -> DataFrame:
    return _recomputed(*_held_out(t, lambda df, f: training.tune_forest(df, f).model))


@check("m8_forest", _HELD_ROWS % "count(*) AS same", _DATA)
def m8(t: Tables) -> DataFrame:
    return _recomputed(*_held_out(t, partial(training.fit_forest, balanced=True)))


@check("m9_grid_report", "SELECT * FROM (VALUES " + ", ".join(
    f"('C={c}', 1)" for c in training.LASSO_C) + ") AS tried(params, in_range)")
def m9(t: Tables) -> DataFrame:
    train, _ = train_test(first_data(t))
    report = training.tune_lasso(train, FIRST_FEATURES).report(t.spark)
    return report.select("params", F.col("score").between(0, 1).alias("in_range"))


@check("m9_forest_report", "SELECT params, 1 AS in_range FROM (VALUES " + ", ".join(
    f"('max_features={f}, min_samples_leaf={m}')" for f in training.FOREST_FEATURES for m in training.FOREST_LEAVES)
    + ") AS tried(params)")
def m9_forest(t: Tables) -> DataFrame:
    """Every setting of the forest grid, searched with few trees and two folds."""
    train, _ = train_test(first_data(t))
    tuned = training.tune_forest(train, FIRST_FEATURES, search_trees=10, final_trees=10, folds=2)
    return tuned.report(t.spark).select("params", F.col("score").between(0, 1).alias("in_range"))


# A fixed rule stands in for a model, so that every metric has a SQL form.
_RULE = """
rule AS (SELECT id, CASE WHEN levels_completed >= 13 THEN 1 ELSE 0 END AS y,
         CAST(signed_up AS INT) AS prediction,
         CAST((levels_completed * 7 + id * 13) % 60 AS DOUBLE) / 60 AS score FROM us),
cm AS (SELECT count(*) FILTER (WHERE y = 0 AND prediction = 0) AS tn,
              count(*) FILTER (WHERE y = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE y = 1 AND prediction = 0) AS fn,
              count(*) FILTER (WHERE y = 1 AND prediction = 1) AS tp FROM rule),
base AS (SELECT CASE WHEN p > n // 2 THEN 0 ELSE n - p END AS tn, CASE WHEN p > n // 2 THEN n - p ELSE 0 END AS fp,
                CASE WHEN p > n // 2 THEN 0 ELSE p END AS fn, CASE WHEN p > n // 2 THEN p ELSE 0 END AS tp
         FROM (SELECT CAST(sum(y) AS BIGINT) AS p, count(*) AS n FROM rule))"""
_METRICS = f"""tn, fp, fn, tp,
 {r6('(tn + tp)::DOUBLE / (tn + fp + fn + tp)', 'accuracy')},
 {r6('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)', 'precision')},
 {r6('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)', 'recall')},
 {r6('coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}"""


def rule_scores(t: Tables) -> DataFrame:
    done = F.col("levels_completed")
    return t.users.select(
        "id", labels.continues(done, 13).alias("y"), F.col("signed_up").cast("int").alias("prediction"),
        (((done * 7 + F.col("id") * 13) % 60).cast("double") / F.lit(60.0)).alias("score"),
    )


@check("m10_scores", f"SELECT {_METRICS} FROM cm", _RULE)
def m10(t: Tables) -> DataFrame:
    return evaluate.scores(rule_scores(t))


@check("m10_accuracy", f"""
SELECT count(*) AS n, {r6('avg(CASE WHEN y = prediction THEN 1.0 ELSE 0 END)', 'accuracy')} FROM rule""", _RULE)
def m10_accuracy(t: Tables) -> DataFrame:
    return evaluate.accuracy(rule_scores(t))


@check("m5_draft_four_classes", f"SELECT count(*) AS n, 1 AS solved FROM dat WHERE {_HELD}", _DATA)
def m5_draft(t: Tables) -> DataFrame:
    """The draft model: classes by level bins, unweighted."""
    matrix = mx.model_matrix(wide(t, FIRST_CHUNKS), FIRST, FIRST_CHUNKS)
    rows = training.complete_rows(matrix.select("id", "levels_completed", *FIRST_FEATURES))
    label = labels.digitize(F.col("levels_completed"), labels.DRAFT_BINS_OF_4)
    data = stage(rows.withColumn("y", label.cast("int")), "draft")
    train, test = train_test(data)
    model = training.fit_weighted_logistic(train, FIRST_FEATURES, balanced=False)
    return evaluate.accuracy(training.predict(model, test)).select(
        "n", F.lit(_solved(model, train)).alias("solved"))


@check("m11_confusion_shares", "SELECT tn, fp, fn, tp, " + ", ".join(
    f"round({c}::DOUBLE / (tn + fp + fn + tp), 2) AS {c}_share" for c in ("tn", "fp", "fn", "tp"))
    + " FROM cm", _RULE)
def m11(t: Tables) -> DataFrame:
    return evaluate.confusion_shares(evaluate.confusion(rule_scores(t)))


@check("m12_area_under_roc", f"""
SELECT CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives,
       {r6('(ranks - p * (p + 1) / 2.0) / (p::DOUBLE * n)', 'auc')}
FROM (SELECT sum(y) AS p, sum(1 - y) AS n, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS ranks FROM (
  SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM rule))""", _RULE)
def m12(t: Tables) -> DataFrame:
    return evaluate.area_under_roc(rule_scores(t))


@check("m13_majority_baseline", f"SELECT {_METRICS} FROM base", _RULE)
def m13(t: Tables) -> DataFrame:
    return evaluate.majority_scores(rule_scores(t))


@check("m14_ranked_features", "SELECT 1 AS class, 1 AS same, unnest([" + ", ".join(f"'{f}'" for f in FIRST_FEATURES) + "]) AS feature")
def m14(t: Tables) -> DataFrame:
    """Ranked importances, and whether the sums over the nodes give the same."""
    model, _ = _held_out(t, training.fit_forest)
    again = trees.importances(stage(trees.nodes(t.spark, model), "nodes"), FIRST_FEATURES)
    both = training.ranked_weights(t.spark, model).join(again.withColumnRenamed("weight", "recomputed"), "feature")
    same = (F.col("abs_weight") == F.abs("weight")) & (F.abs(F.col("weight") - F.col("recomputed")) <= 0.5001e-4)
    return both.select("class", "feature", same.alias("same"))


@check("m15_random_control", f"""
SELECT CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives,
       {r6('abs((ranks - p * (p + 1) / 2.0) / (p::DOUBLE * n) - 0.5)', 'off_half')}
FROM (SELECT sum(y) AS p, sum(1 - y) AS n, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS ranks FROM (
  SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk
  FROM (SELECT y, substr(md5(CAST(id AS VARCHAR) || ':{training.SEED}'), 1, 8) AS x FROM dat)))""", _DATA)
def m15(t: Tables) -> DataFrame:
    """A model of one random feature, on all rows. It can only turn the feature's order
    round or keep it, so its area is as far from a half as the feature's own."""
    rows = stage(training.random_control(first_data(t)), "control")
    model = training.fit_weighted_logistic(train_test(rows)[0], ["random"])
    return evaluate.area_under_roc(training.predict(model, rows)).select(
        "positives", "negatives", F.round(F.abs(F.col("auc") - 0.5), 6).alias("off_half"))


def _point_ctes() -> str:
    """Labelled complete rows of every prediction point with their side of the split."""
    parts = []
    for m in ch.MODELS:
        uppers = [c.upper for c in mx.upto_model(m)]
        parts.append((m.threshold, m.threshold, mx.model_features(m), matrix_sql(uppers, max(uppers))))
    for key, (m, chunk) in scoring.STANDALONE.items():
        sql = matrix_sql([chunk.upper], chunk.upper, shares=True, feat=f"feat{chunk.upper}")
        parts.append((key, m.threshold, mx.standalone_features(m, (chunk,)), sql))
    keys = [p[0] for p in parts]
    rows = [f"""SELECT {key} AS model, id, CASE WHEN levels_completed >= {threshold} THEN 1 ELSE 0 END AS y
  FROM ({sql}) WHERE {' AND '.join(f'{f} IS NOT NULL' for f in features)}""" for key, threshold, features, sql in parts]
    points = ', '.join(f'({k})' for k in keys)
    return f"""
labelled AS ({' UNION ALL '.join(rows)}),
sided AS (SELECT *, CASE WHEN substr(md5(CAST(id AS VARCHAR) || 'matrix'), 1, 2) < 'c0' THEN 'train' ELSE 'test' END AS side
          FROM labelled),
fits AS (SELECT m.model, count(DISTINCT y) FILTER (WHERE side = 'train') > 1 AS fitted
         FROM (VALUES {points}) AS m(model) LEFT JOIN sided ON sided.model = m.model
         GROUP BY m.model),
sides AS (SELECT m.model, s.side, fitted, count(y) AS n, coalesce(CAST(sum(y) AS BIGINT), 0) AS positives
          FROM fits m CROSS JOIN (VALUES ('train'), ('test')) AS s(side)
          LEFT JOIN sided ON sided.model = m.model AND sided.side = s.side GROUP BY m.model, s.side, fitted)"""


def _all_matrices(t: Tables) -> dict[int, DataFrame]:
    alone = scoring.STANDALONE
    staged = stage(wide(t, (*ch.CHUNKS, *[c for _, c in alone.values()])), "wide-users")
    matrices = mx.model_matrices(staged)
    for key, (model, chunk) in alone.items():
        matrices[key] = mx.standalone_matrix(staged, model, (chunk,))
    return matrices


def _all_points(matrices: dict[int, DataFrame], fit, folder: str | None = None, family: str = "model"):
    """All seven prediction points, fitted, and saved where a folder is given."""
    points = [*scoring.cumulative_points(), *scoring.standalone_points()]
    return scoring.train_points(matrices, fit, points, folder, family)


#: The forest search as in the job, with fewer settings, trees and folds.
_SMALL_SEARCH = dict(subset_grid=("sqrt",), leaf_grid=(1, 10), search_trees=5, final_trees=20, folds=2)


@check("m16_score_saved", """
SELECT family, model, n, CASE WHEN fitted THEN n ELSE 0 END AS same
FROM sides CROSS JOIN (VALUES ('forest'), ('lasso')) AS f(family) WHERE side = 'test'""", _point_ctes(), long=True)
def m16(t: Tables) -> DataFrame:
    """Held-out users whose prediction a saved model repeats: both tuned families, every
    prediction point."""
    folder, parts = fresh_path(t.spark, "models"), []
    families = {
        "forest": lambda df, f: training.tune_forest(df, f, **_SMALL_SEARCH).model,
        "lasso": lambda df, f: training.tune_lasso(df, f).model,
    }
    matrices = {k: stage(m, "matrix") for k, m in _all_matrices(t).items()}
    for family, fit in families.items():
        for key, fitted in _all_points(matrices, fit, folder, family).items():
            first = fitted.sides[TEST].select("id", "prediction", "score")
            if fitted.model is None:
                again = first
            else:
                again = scoring.score_saved(folder, key, family, fitted.sides[TEST].drop("prediction", "score"))
            both = first.join(again.select("id", F.col("prediction").alias("p"), F.col("score").alias("s")), "id")
            same = (F.col("prediction") == F.col("p")) & (F.abs(F.col("score") - F.col("s")) < 1e-9)
            parts.append(both.agg(F.count("*").alias("n"), F.count_if(same).alias("same")).select(
                F.lit(family).alias("family"), F.lit(key).alias("model"), "n", "same"))
    return reduce(DataFrame.unionByName, parts)


_TIME = mx.chunk_column(ch.AVERAGE_TIME, 5)
_STARTED = mx.chunk_column("rate_started_level", 5)
SCENARIOS = {
    "half_time": [Change(_TIME, "times", 0.5)],
    "double_starts": [Change(_STARTED, "times", 2.0)],
    "mean_time": [Change(_TIME, "mean")],
    "age_unknown": [Change("age_other_age", "set", 1.0),
                    *[Change(a, "set", 0.0) for a in mx.people.AGE_DUMMIES if a != "age_other_age"]],
}


def _scenario_sql(name: str, time: str = _TIME, started: str = _STARTED, other: str = "age_other_age",
                  young: str = "age_13_15") -> str:
    return (f"SELECT '{name}' AS scenario, id, {r6(time, _TIME)}, {r6(started, _STARTED)}, "
            f"{r6(other, 'age_other_age')}, {r6(young, 'age_13_15')} FROM exact")


@check("m17_scenarios", " UNION ALL ".join([
    _scenario_sql("unchanged"), _scenario_sql("half_time", time=f"{_TIME} * 0.5::DOUBLE"),
    _scenario_sql("double_starts", started=f"{_STARTED} * 2"),
    _scenario_sql("mean_time", time=f"avg({_TIME}) OVER ()"),
    _scenario_sql("age_unknown", other="1", young="0"),
]), _DATA + f""",
exact AS (SELECT dat.id, feat.{ch.AVERAGE_TIME} AS {_TIME}, feat.rate_started_level AS {_STARTED},
                 age_other_age, age_13_15
          FROM dat JOIN feat ON feat.user_id = dat.id AND feat.chunk = 5)""")
def m17(t: Tables) -> DataFrame:
    return scoring.with_scenarios(first_data(t), SCENARIOS).select(
        "scenario", "id", _TIME, _STARTED, "age_other_age", "age_13_15"
    )


@check("m17_scenario_counts", f"""
SELECT scenario, n, n AS same, 1 AS fewer FROM (VALUES ('unchanged'), {', '.join(f"('{n}')" for n in SCENARIOS)}) AS s(scenario)
CROSS JOIN (SELECT count(*) AS n FROM dat WHERE {_HELD})""", _DATA)
def m17_counts(t: Tables) -> DataFrame:
    """Scenarios by the trees they can move, against scoring every changed row anew."""
    train, test = train_test(first_data(t))
    model = training.fit_forest(train, FIRST_FEATURES)
    nodes = stage(trees.nodes(t.spark, model), "nodes")
    quick = trees.scored_scenarios(test, nodes, FIRST_FEATURES, SCENARIOS).select(
        "scenario", "id", F.col("prediction").alias("p"), F.col("score").alias("s"), "rescored")
    full = training.predict(model, scoring.with_scenarios(test, SCENARIOS)).select("scenario", "id", "prediction", "score")
    same = (F.col("prediction") == F.col("p")) & (F.abs(F.col("score") - F.col("s")) < 1e-9)
    fewer = (F.col("scenario") == scoring.UNCHANGED) | (F.max("rescored") < model.stages[-1].getNumTrees)
    return quick.join(full, ["scenario", "id"]).groupBy("scenario").agg(
        F.count("*").alias("n"), F.count_if(same).alias("same"), fewer.alias("fewer"))


@check("m18_all_points", f"""
SELECT model, side, fitted::INT AS fitted, n::DOUBLE AS n, positives::DOUBLE AS positives,
       {r6('coalesce((CASE WHEN positives > n // 2 THEN positives ELSE n - positives END)::DOUBLE / nullif(n, 0), 0)', 'baseline_accuracy')}
FROM sides""", _point_ctes(), long=True)
def m18(t: Tables) -> DataFrame:
    """The training report: both sides of every point, with or without a model."""
    report = scoring.training_report(_all_points(_all_matrices(t), training.fit_forest))
    return report.select("model", "side", "fitted", "n", "positives", "baseline_accuracy")
