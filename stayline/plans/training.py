"""Churn models: scaling, weights, tuning and fitting with pyspark.ml.

Training reads one matrix many times. Pass a frame read from a written table
(``session.stage`` or ``sources.tables``), so that passes do not repeat the feature job.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import fmean

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from stayline.functions.elapsed import ratio
from stayline.functions.labels import continues
from stayline.operators.clean import complete_rows
from stayline.plans.path import lasso_path
from stayline.session import stage
from stayline.sources.splits import with_class_folds

# Tuning grids.
LASSO_C = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
FOREST_FEATURES = ("sqrt", "0.3", "0.5", "0.7")
FOREST_LEAVES = (1, 3, 5, 10)
FOLDS = 5
SEED = 42


def labelled(matrix: DataFrame, features: Sequence[str], threshold: int) -> DataFrame:
    """Complete rows as (id, y, features as doubles)."""
    complete = complete_rows(matrix.select("id", "levels_completed", *features))
    return complete.select(
        "id", continues(F.col("levels_completed"), threshold).cast("int").alias("y"),
        *[F.col(f).cast("double").alias(f) for f in features],
    )


def with_class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Add ``weight`` = n / (classes * rows of the class)."""
    # One row per class, so the broadcast is bounded by the label bins.
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """One row per class: rows and balanced weight."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    classes = Window.partitionBy()
    total, number = F.sum("n").over(classes), F.count("*").over(classes)
    return counts.withColumn("weight", ratio(total, number * F.col("n")))


def feature_stages(features: Sequence[str], scale: bool) -> list:
    """Assembler, and a scaler whose statistics stay with the saved model."""
    target = "assembled" if scale else "features"
    stages = [VectorAssembler(inputCols=list(features), outputCol=target, handleInvalid="error")]
    if scale:
        stages.append(
            StandardScaler(inputCol=target, outputCol="features", withMean=True, withStd=True)
        )
    return stages


def scaler_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and both deviations per feature, one pass."""
    row = df.agg(*[
        F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"),
                 F.stddev_samp(f).alias("std"), F.stddev_pop(f).alias("std_pop")).alias(f"_{f}")
        for f in features
    ])
    return row.select(F.explode(F.array(*[F.col(f"_{f}") for f in features])).alias("s")).select("s.*")


def scale_by_self(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Standardise a scoring set by its own population statistics, one scalar subquery.

    A constant feature is only centred.
    """
    stats = df.agg(
        F.struct(
            *[F.avg(f).alias(f"m_{f}") for f in features],
            *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
        ).alias("stats")
    ).scalar()

    def scaled(f: str):
        spread = stats.getField(f"s_{f}")
        centred = F.col(f) - stats.getField(f"m_{f}")
        return (centred / F.when(spread == 0, F.lit(1.0)).otherwise(spread)).alias(f)

    return df.select(*[c for c in df.columns if c not in features], *[scaled(f) for f in features])


@dataclass
class Tuned:
    """A refitted model and its grid search."""

    model: PipelineModel
    best: dict
    best_score: float
    search: list[dict]

    def report(self, spark) -> DataFrame:
        """Grid settings with their mean score, best first; one row per setting tried."""
        rows = [(", ".join(f"{k}={v}" for k, v in s["params"].items()), float(s["score"]))
                for s in self.search]
        return spark.createDataFrame(rows, "params string, score double").orderBy(
            F.col("score").desc(), "params"
        )


def fit_weighted_logistic(
    train: DataFrame, features: Sequence[str], balanced: bool = True, max_iter: int = 1000
) -> PipelineModel:
    """Multinomial logistic regression with balanced class weights.

    The ridge term has the same strength as an inverse strength of 1 on summed losses.
    """
    n = train.count()
    model = LogisticRegression(
        labelCol="y", family="multinomial", elasticNetParam=0.0, regParam=1.0 / max(n, 1),
        standardization=False, maxIter=max_iter,
    )
    if balanced:
        train = with_class_weights(train)
        model = model.setWeightCol("weight")
    return Pipeline(stages=[*feature_stages(features, scale=True), model]).fit(train)


def _lasso(c: float, n: int, max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        labelCol="y", family="binomial", elasticNetParam=1.0, regParam=1.0 / (c * max(n, 1)),
        standardization=False, maxIter=max_iter,
    )


def _at_once(df: DataFrame, least: int) -> int:
    """Fits to run at once: ``least``, or as many as it takes to give every core two tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(least, -(-2 * cores // max(df.rdd.getNumPartitions(), 1)))


def _fold_scores(candidates: Sequence, df: DataFrame, folds: int, parallelism: int) -> list[float]:
    """Mean held-out accuracy of each estimator over the folds of (y, fold, features).

    The frame is written once, as every fit reads it several times, and nothing is refitted
    on all rows. A fold that leaves one class, or holds nobody, counts for none. At least
    ``parallelism`` fits run at once, of any fold.
    """
    evaluator = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    df = stage(df, "folds")
    # One row per fold and class.
    met = [tuple(r) for r in df.select("fold", "y").distinct().collect()]
    sides = []
    for fold in range(folds):
        if len({y for f, y in met if f != fold}) < 2 or all(f != fold for f, _ in met):
            continue
        sides.append([df.where(x).select("y", "features") for x in (F.col("fold") != fold, F.col("fold") == fold)])

    def score(job: tuple) -> float:
        (train, held), estimator = job
        return evaluator.copy().evaluate(estimator.copy().fit(train).transform(held))

    with ThreadPoolExecutor(_at_once(df, parallelism)) as pool:
        scores = list(pool.map(score, [(s, e) for s in sides for e in candidates]))
    return [fmean(own) if (own := scores[k::len(candidates)]) else 0.0 for k in range(len(candidates))]


def _best(metrics: Sequence[float]) -> int:
    return max(range(len(metrics)), key=lambda i: metrics[i])


def tune_lasso(
    train: DataFrame,
    features: Sequence[str],
    grid_c: Sequence[float] = LASSO_C,
    folds: int = FOLDS,
    max_iter: int = 100,
) -> Tuned:
    """L1 logistic regression, strength chosen by cross-validation over folds of even
    classes, all fits in shared passes, and refitted on all rows."""
    found = lasso_path(with_class_folds(train, folds), features, grid_c, folds)
    scores = [found.accuracy(c) for c in grid_c]
    best = _best(scores)
    final = Pipeline(
        stages=[*feature_stages(features, scale=True), _lasso(grid_c[best], train.count(), max_iter)]
    ).fit(train)
    search = [{"params": {"C": c}, "score": s} for c, s in zip(grid_c, scores, strict=True)]
    return Tuned(final, {"C": grid_c[best]}, scores[best], search)


def tune_forest(
    train: DataFrame,
    features: Sequence[str],
    subset_grid: Sequence[str] = FOREST_FEATURES,
    leaf_grid: Sequence[int] = FOREST_LEAVES,
    search_trees: int = 150,
    final_trees: int = 1000,
    max_depth: int = 12,
    folds: int = FOLDS,
    parallelism: int = 4,
) -> Tuned:
    """Random forest tuned on features per split and leaf size, refitted with more trees."""
    settings = [{"max_features": f, "min_samples_leaf": m} for f in subset_grid for m in leaf_grid]

    def forest(setting: dict, trees: int) -> RandomForestClassifier:
        return RandomForestClassifier(
            labelCol="y", numTrees=trees, maxDepth=max_depth, seed=SEED,
            featureSubsetStrategy=setting["max_features"], minInstancesPerNode=setting["min_samples_leaf"],
            # Rows know their nodes, so a job for a level need not carry all trees so far; same trees.
            cacheNodeIds=True, checkpointInterval=-1,
        )

    prepare = feature_stages(features, scale=False)
    candidates = [forest(s, search_trees) for s in settings]
    folded = Pipeline(stages=prepare).fit(train).transform(with_class_folds(train, folds))
    found = _fold_scores(candidates, folded.select("y", "fold", "features"), folds, parallelism)
    best = _best(found)
    model = Pipeline(stages=[*prepare, forest(settings[best], final_trees)]).fit(train)
    search = [{"params": p, "score": s} for p, s in zip(settings, found, strict=True)]
    return Tuned(model, settings[best], found[best], search)


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    trees: int = 100,
    balanced: bool = False,
    max_depth: int = 12,
) -> PipelineModel:
    """Random forest with fixed settings."""
    forest = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=max_depth, seed=SEED)
    if balanced:
        train = with_class_weights(train)
        forest = forest.setWeightCol("weight")
    return Pipeline(stages=[*feature_stages(features, scale=False), forest]).fit(train)


def random_control(df: DataFrame, seed: int = SEED) -> DataFrame:
    """The labels beside one random feature, for a control model. It is drawn from the id,
    so it does not depend on how rows are dealt to tasks."""
    digits = F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), 1, 8)
    return df.select("id", "y", (F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))).alias("random"))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add predicted class and positive-class score."""
    return model.transform(df).select(
        *df.columns,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


def steepest(model: PipelineModel, train: DataFrame) -> DataFrame:
    """One row: by how much the fitted logistic model misses its optimality conditions.

    For every coefficient the weighted loss, averaged, has a derivative that a ridge term
    must balance, and that under an L1 term is at most the penalty, with the sign that
    shrinks. One pass sums the derivatives; ``miss`` is the greatest that is left.
    """
    last = model.stages[-1]
    penalty, share = last.getRegParam(), last.getElasticNetParam()
    matrix = last.coefficientMatrix.toArray()
    weight = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    ready = PipelineModel(model.stages[:-1]).transform(train.withColumn("weight", weight))
    rows = last.transform(ready.select("y", "weight", "features")).select(
        "y", "weight", vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"))
    # The binomial form has one row of coefficients, for class 1.
    classes = range(len(matrix)) if len(matrix) > 1 else [1]
    cells = F.array(*[
        F.struct(F.lit(k).alias("k"), (F.col("weight") * (F.col("p")[c] - (F.col("y") == c).cast("double"))).alias("e"))
        for k, c in enumerate(classes)
    ])
    long = rows.select("weight", "x", F.explode(cells).alias("c")).select(
        "weight", "c.k", "c.e", F.posexplode("x").alias("j", "x"))
    slopes = long.groupBy("k", "j").agg((F.sum(F.col("e") * F.col("x")) / F.sum("weight")).alias("slope"))
    fitted = train.sparkSession.createDataFrame(
        [(k, j, float(v)) for k, row in enumerate(matrix) for j, v in enumerate(row)], "k int, j int, v double")
    ridge, lasso = penalty * (1 - share), penalty * share
    slope = F.col("slope") + ridge * F.col("v")
    miss = F.when(F.col("v") == 0, F.greatest(F.abs(slope) - lasso, F.lit(0.0))).otherwise(
        F.abs(slope + lasso * F.signum("v")))
    return slopes.join(fitted, ["k", "j"]).agg(F.max(miss).alias("miss"))


def class_weights_of_features(model: PipelineModel) -> list[tuple[int, str, float]]:
    """(class, feature, coefficient or importance). Two-class models and importances have
    one entry per feature, under class 1; others one per class and feature."""
    names = model.stages[0].getInputCols()
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        rows = {1: last.featureImportances.toArray()}
    else:
        matrix = last.coefficientMatrix.toArray()
        # Two symmetric rows in the multinomial form, one in the binomial.
        rows = {1: matrix[-1] - matrix[0]} if len(matrix) == 2 else (
            {1: matrix[0]} if len(matrix) == 1 else dict(enumerate(matrix)))
    return [(c, n, float(v)) for c, values in rows.items() for n, v in zip(names, values, strict=True)]


def feature_weights(model: PipelineModel) -> list[tuple[str, float]]:
    """Feature names with the coefficients of a two-class model, or with importances."""
    weights = class_weights_of_features(model)
    if len({c for c, _, _ in weights}) > 1:
        raise ValueError("more than two classes: see class_weights_of_features")
    return [(n, v) for _, n, v in weights]


def rank_features(weights: DataFrame) -> DataFrame:
    """Order (feature, weight), within each ``class`` if there is one, by absolute weight,
    as numbers, at 4 decimals."""
    rounded, by = F.round("weight", 4), [c for c in ("class",) if c in weights.columns]
    return weights.select(
        *by, "feature", rounded.alias("weight"), F.abs(rounded).alias("abs_weight")
    ).orderBy(*by, F.col("abs_weight").desc(), "feature")


def ranked_weights(spark, model: PipelineModel) -> DataFrame:
    """A model's ranked features; one row per class and feature, see above."""
    return rank_features(spark.createDataFrame(
        class_weights_of_features(model), "class int, feature string, weight double"))


def one_feature(df: DataFrame, feature: str) -> DataFrame:
    """Labels and a single feature, for a smoke model."""
    return df.select("id", "y", feature)
