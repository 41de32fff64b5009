"""Metrics from published counts, and models on a planted signal."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stayline.operators import evaluate
from stayline.plans import path, scoring, training, trees
from stayline.plans.scoring import Change
from stayline.session import stage
from stayline.sources import splits

# tn, fp, fn, tp and the published accuracy, precision, recall, F1.
PUBLISHED = [
    ((11064, 2312, 4406, 5086), (0.7062, 0.6875, 0.5358, 0.6022)),
    ((11265, 2111, 4698, 4794), (0.7022, 0.6943, 0.5051, 0.5847)),
    ((6163, 356, 2339, 634), (0.7161, 0.6404, 0.2133, 0.3200)),
    ((2472, 24, 357, 120), (0.8718, 0.8333, 0.2516, 0.3865)),
    ((305, 29, 54, 89), (0.8260, 0.7542, 0.6224, 0.6820)),
    ((70, 8, 36, 29), (0.6923, 0.7838, 0.4462, 0.5686)),
    ((13376, 0, 9492, 0), (0.5849, 0.0, 0.0, 0.0)),
]
FEATURES = ["signal", "noise"]


@pytest.mark.parametrize("counts,expected", PUBLISHED)
def test_metrics_follow_from_published_counts(spark, counts, expected):
    df = spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")
    row = evaluate.with_scores(df).collect()[0]
    assert [round(row[m], 4) for m in ("accuracy", "precision", "recall", "f1")] == list(expected)


def test_confusion_shares_of_published_counts(spark):
    df = spark.createDataFrame([PUBLISHED[0][0]], "tn long, fp long, fn long, tp long")
    row = evaluate.confusion_shares(df).collect()[0]
    assert [row[f"{c}_share"] for c in ("tn", "fp", "fn", "tp")] == [0.48, 0.1, 0.19, 0.22]


@pytest.fixture(scope="module")
def planted(spark):
    """A label that mostly follows one feature."""
    df = spark.range(600).select(
        "id", F.rand(1).alias("signal"), F.rand(2).alias("noise"), F.rand(3).alias("u")
    )
    y = (F.col("signal") + F.col("u") * 0.4 > 0.8).cast("int")
    return stage(df.select("id", y.alias("y"), *FEATURES), "planted")


def auc(model, df):
    return evaluate.area_under_roc(training.predict(model, df)).collect()[0]["auc"]


@pytest.fixture(scope="module")
def forest(planted):
    return training.fit_forest(planted, FEATURES, trees=10, max_depth=4)


def test_models_beat_the_random_control(planted, forest):
    control = stage(training.random_control(planted), "control")
    by_chance = auc(training.fit_weighted_logistic(control, ["random"]), control)
    assert abs(by_chance - 0.5) < 0.08
    assert auc(forest, planted) > 0.9
    assert auc(training.fit_weighted_logistic(planted, FEATURES), planted) > 0.9


def test_ranked_features_put_the_signal_first(spark, planted, forest):
    assert training.ranked_weights(spark, forest).first()["feature"] == "signal"
    logistic = training.fit_weighted_logistic(planted, FEATURES)
    ranked = training.ranked_weights(spark, logistic).collect()
    assert ranked[0]["feature"] == "signal" and ranked[0]["weight"] > 0


def test_ranking_is_numeric(spark):
    weights = spark.createDataFrame([("a", 0.0001), ("b", -0.3), ("c", 0.2)], "feature string, weight double")
    assert [r["feature"] for r in training.rank_features(weights).collect()] == ["b", "c", "a"]


def test_saved_model_scores_the_same(planted, forest, tmp_path):
    scoring.save_model(forest, str(tmp_path), 10, "forest")
    again = scoring.score_saved(str(tmp_path), 10, "forest", planted)
    assert again.exceptAll(training.predict(forest, planted)).count() == 0


def test_same_seed_same_model(planted, forest):
    second = training.fit_forest(planted, FEATURES, trees=10, max_depth=4)
    assert training.feature_weights(second) == training.feature_weights(forest)


def test_lasso_search_drops_the_noise(spark, planted):
    tuned = training.tune_lasso(planted, FEATURES, grid_c=(0.001, 0.05), folds=3)
    assert tuned.best == {"C": 0.05}
    weights = dict(training.feature_weights(tuned.model))
    assert weights["signal"] > 0 and abs(weights["noise"]) < weights["signal"] / 10
    assert tuned.report(spark).count() == 2


def test_forest_search_reports_every_setting(spark, planted):
    tuned = training.tune_forest(
        planted, FEATURES, ("sqrt", "0.5"), (1, 10), search_trees=4, final_trees=8, max_depth=3, folds=2)
    assert len(tuned.search) == 4 and tuned.best_score == max(s["score"] for s in tuned.search)
    assert isinstance(tuned.model, PipelineModel)
    assert tuned.model.stages[-1].getNumTrees == 8


def test_class_weights_balance(planted):
    weighted = training.with_class_weights(planted)
    sums = [r[0] for r in weighted.groupBy("y").agg(F.sum("weight")).select("sum(weight)").collect()]
    assert sums[0] == pytest.approx(sums[1])


def test_scaling_by_self(planted):
    scaled = training.scale_by_self(planted, FEATURES)
    row = scaled.agg(F.avg("signal"), F.stddev_pop("signal")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1)
    flat = training.scale_by_self(planted.withColumn("noise", F.lit(3.0)), FEATURES)
    assert flat.agg(F.max(F.abs("noise"))).first()[0] == 0


def test_scenarios_move_the_prediction(planted, forest):
    counts = scoring.scenario_counts(forest, planted, {
        "none": [Change("signal", "set", 0.0)], "all": [Change("signal", "set", 1.0)],
        "same": [Change("noise", "times", 1.0)], "mean": [Change("signal", "mean")],
    })
    n = {r["scenario"]: r["continuing"] for r in counts.collect()}
    assert n["none"] == 0 and n["all"] == planted.count() and n["same"] == n["unchanged"]


def test_folds_deal_every_class_evenly(planted):
    first = splits.with_class_folds(planted, 5)
    counts = [[r["count"] for r in first.where(F.col("y") == y).groupBy("fold").count().collect()] for y in (0, 1)]
    assert all(len(c) == 5 and max(c) - min(c) <= 1 for c in counts)
    assert first.exceptAll(splits.with_class_folds(planted, 5)).count() == 0
    assert first.exceptAll(splits.with_class_folds(planted.repartition(7), 5)).count() == 0


@pytest.mark.parametrize("slice_rows", [1, 7, 100_000])
def test_class_ranks_equal_a_window(spark, slice_rows):
    rows = [(k % 90, [None, 0, 1, 1][k % 4], f"r{k}") for k in range(300)] + [(None, 1, "a"), (None, 1, "b")]
    df = spark.createDataFrame(rows, "id int, y int, v string").repartition(4)
    order = "order by md5(concat(coalesce(string(id), ''), 's')), id, v"
    plain = df.selectExpr("*", f"row_number() over (partition by y {order}) - 1L r", "count(*) over (partition by y) n")
    got = splits.class_ranks(df, "y", salt="s", slice_rows=slice_rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, plain.collect())))
    assert splits.class_ranks(df.limit(0), "y").count() == 0


def test_split_takes_the_share_of_every_class(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, 1, 0) y")
    sides = {(r.y, r.split): r["count"] for r in splits.with_class_split(df).groupBy("y", "split").count().collect()}
    assert sides == {(0, "train"): 675, (0, "test"): 225, (1, "train"): 75, (1, "test"): 25}


def test_path_is_optimal_and_equals_single_fits(planted):
    folded = splits.with_class_folds(planted.withColumn("flat", F.lit(2.0)), 5)
    found = path.lasso_path(folded, [*FEATURES, "flat"], training.LASSO_C, 5)
    assert len(found.fits) == 35 and all(f.solved for f in found.fits)
    assert found.passes < 35
    assert all(f.coefficients[2] == 0 for f in found.fits)
    whole = path.lasso_path(folded, FEATURES, (0.05, 10.0), 5, held_out=False)
    for fit in whole.fits:
        single = training.Pipeline(stages=[*training.feature_stages(FEATURES, True), training._lasso(fit.c, fit.rows, 500)]).fit(planted)
        assert single.stages[-1].coefficients.toArray() == pytest.approx(fit.coefficients, rel=0.01, abs=1e-3)
        assert single.stages[-1].intercept == pytest.approx(fit.intercept, rel=0.01, abs=1e-3)
    one = found.fits[4]
    held = folded.where(F.col("fold") == one.fold)
    assert one.held == held.count() and one.right > 0.7 * one.held


def test_path_leaves_out_folds_of_one_class(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 1, 3.0), (1, 1, 4.0)], "y int, fold int, a double")
    found = path.lasso_path(df, ["a"], (1.0,), 2)
    assert found.fits == [] and found.accuracy(1.0) == 0.0


def test_nodes_repeat_scores_and_importances(spark, planted, forest):
    nodes = stage(trees.nodes(spark, forest), "nodes")
    assert nodes.select("tree").distinct().count() == 10 and trees.depth(nodes) <= 4
    ours = {r.id: (r.prediction, r.score) for r in trees.scored(planted, nodes, FEATURES).collect()}
    for r in training.predict(forest, planted).collect():
        assert ours[r.id][0] == r.prediction and ours[r.id][1] == pytest.approx(r.score, abs=1e-12)
    weights = {r.feature: r.weight for r in trees.importances(nodes, FEATURES).collect()}
    assert weights == pytest.approx(dict(training.feature_weights(forest)), abs=1e-12)


def test_a_forest_of_leaves(spark):
    flat = spark.range(20).selectExpr("id", "int(id % 4 = 0) y", "1.0D signal", "2.0D noise")
    model = training.fit_forest(flat, FEATURES, trees=3)
    nodes = trees.nodes(spark, model)
    assert trees.depth(nodes) == 0
    assert {r.weight for r in trees.importances(nodes, FEATURES).collect()} == {0.0}
    expected = [r.score for r in training.predict(model, flat).collect()]
    assert [r.score for r in trees.scored(flat, nodes, FEATURES).collect()] == pytest.approx(expected)


def test_scenarios_walk_only_trees_they_can_move(spark, planted):
    model = training.fit_forest(planted, FEATURES, trees=12, max_depth=1)
    nodes = stage(trees.nodes(spark, model), "nodes")
    scenarios = {"s": [Change("signal", "times", 0.7)], "n": [Change("noise", "set", 0.1)], "both": [
        Change("signal", "mean"), Change("noise", "times", 2.0)]}
    index = {f: {r.tree for r in trees.feature_trees(nodes).collect() if r.feature == f} for f in FEATURES}
    quick = trees.scored_scenarios(planted, nodes, FEATURES, scenarios)
    walked = {r.scenario: r.rescored for r in quick.select("scenario", "rescored").distinct().collect()}
    assert walked == {"unchanged": 12, "s": len(index["signal"]), "n": len(index["noise"]), "both": len(index["signal"] | index["noise"])}
    assert len(index["noise"]) < 12
    full = training.predict(model, scoring.with_scenarios(planted, scenarios))
    both = quick.select("scenario", "id", "prediction", "score").exceptAll(full.select("scenario", "id", "prediction", "score"))
    assert both.count() == 0
    counts = {r.scenario: r.continuing for r in trees.scenario_counts(planted, nodes, FEATURES, scenarios).collect()}
    assert counts == {r.scenario: r.continuing for r in scoring.scenario_counts(model, planted, scenarios).collect()}


def test_forest_search_deals_its_folds_once(spark, planted, monkeypatch):
    """Every fit read a plan that ranked the rows anew: one written frame, and the same scores."""
    read, fit = [], training.RandomForestClassifier.fit

    def watched(self, df, params=None):
        read.append(df._jdf.queryExecution().optimizedPlan().toString())
        return fit(self, df, params)

    monkeypatch.setattr(training.RandomForestClassifier, "fit", watched)
    tuned = training.tune_forest(planted, FEATURES, ("sqrt",), (1, 20), search_trees=3, final_trees=3, max_depth=3, folds=2)
    assert len(read) == 5 and not any("Window" in plan for plan in read)
    folded = splits.with_class_folds(planted, 2)
    for setting, found in zip((1, 20), tuned.search):
        right = []
        for fold in (0, 1):
            plain = training.RandomForestClassifier(
                labelCol="y", numTrees=3, maxDepth=3, seed=training.SEED, featureSubsetStrategy="sqrt", minInstancesPerNode=setting)
            model = training.Pipeline(stages=[*training.feature_stages(FEATURES, False), plain]).fit(folded.where(F.col("fold") != fold))
            right.append(evaluate.accuracy(training.predict(model, folded.where(F.col("fold") == fold))).first()["accuracy"])
        assert found["score"] == pytest.approx(sum(right) / 2, abs=0.03)


def test_node_ids_with_the_rows_give_the_same_trees(planted):
    ready = training.VectorAssembler(inputCols=FEATURES, outputCol="features").transform(planted)
    both = [training.RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=6, seed=1, cacheNodeIds=c, checkpointInterval=-1).fit(ready)
            for c in (False, True)]
    assert both[0].toDebugString.split("\n")[1:] == both[1].toDebugString.split("\n")[1:]


def test_the_report_predicts_once(spark, planted, forest):
    """Each measure scored every row anew."""
    calls = spark.sparkContext.accumulator(0)

    def counted(score):
        calls.add(1)
        return score

    score = F.udf(counted, "double")
    point = scoring.Point(10, 10, tuple(FEATURES))
    predicted = training.predict(forest, planted).withColumn("score", score("score"))
    report = scoring.training_report({10: scoring.Fitted(point, forest, {"train": predicted})}).collect()
    assert calls.value == planted.count()
    assert [(r.n, r.fitted) for r in report] == [(600.0, True)] and report[0].auc == pytest.approx(auc(forest, planted))
