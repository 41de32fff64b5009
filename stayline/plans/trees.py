"""Fitted tree ensembles as tables: their nodes, importances, scores and what-if scores.

A fitted forest is opaque to SQL. Here every node becomes a row, read from the model's own
saved data, so that what the model says can be recomputed from its nodes: importances by
grouping, scores by an expression that walks node arrays. The expression has the same size
for ten trees and for a thousand, as the trees are data and not part of the plan.

A change to one feature cannot move a tree that never splits on it. So a scenario walks
only the trees that an index from features to trees names, and takes the unchanged leaves
of all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayline.plans.scoring import UNCHANGED, Change, with_scenarios
from stayline.session import fresh_path


def nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(tree, node, feature, at, threshold, left, right, gain, stats) of every node.

    ``feature`` names and ``at`` numbers the feature that a node splits on; leaves have
    neither and no children. ``stats`` are the weighted rows of each class.
    """
    forest = model.stages[-1]
    path = fresh_path(spark, "forest")
    forest.write().save(path)
    names = F.array(*[F.lit(n) for n in model.stages[0].getInputCols()])
    inner = F.col("nodeData.leftChild") >= 0
    at = F.when(inner, F.col("nodeData.split.featureIndex"))
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.get(names, at).alias("feature"), at.alias("at"),
        F.when(inner, F.col("nodeData.split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("nodeData.leftChild")).alias("left"), F.when(inner, F.col("nodeData.rightChild")).alias("right"),
        F.when(inner, F.col("nodeData.gain")).alias("gain"), F.col("nodeData.impurityStats").alias("stats"))


def _rows(stats: Column) -> Column:
    return F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)


def importances(tree_nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, weight): impurity taken away by each feature, as a share, every tree alike.

    A tree without a split counts for none; features no tree splits on have weight 0.
    """
    taken = tree_nodes.where(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(
        F.sum(F.col("gain") * _rows(F.col("stats"))).alias("taken"))
    whole = taken.groupBy("tree").agg(F.sum("taken").alias("whole"))
    shares = taken.join(whole, "tree").where("whole > 0").groupBy("feature").agg(F.sum(F.col("taken") / F.col("whole")).alias("share"))
    total = shares.agg(F.sum("share")).scalar()
    named = tree_nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return named.join(shares, "feature", "left").select(
        "feature", F.coalesce(F.col("share") / total, F.lit(0.0)).alias("weight"))


def feature_trees(tree_nodes: DataFrame) -> DataFrame:
    """The index: (feature, tree) for every tree that splits on the feature."""
    return tree_nodes.where(F.col("feature").isNotNull()).select("feature", "tree").distinct()


def packed(tree_nodes: DataFrame) -> Column:
    """All trees as one array in tree order, each with its nodes as arrays; a scalar subquery.

    Its size is that of the model, which the driver and every task hold anyway.
    """
    share = F.transform("stats", lambda x: x / _rows(F.col("stats")))
    rows = tree_nodes.withColumns({"p0": share[0], "p1": share[1]})
    ordered = F.array_sort(F.collect_list(F.struct("node", "at", "threshold", "left", "right", "p0", "p1")))
    trees = rows.groupBy("tree").agg(ordered.alias("n"))
    columns = [F.col(f"n.{c}").alias(c) for c in ("at", "threshold", "left", "right", "p0", "p1")]
    arrays = trees.select(F.struct("tree", *columns).alias("t"))
    return arrays.agg(F.array_sort(F.collect_list("t")).alias("trees")).scalar()


def depth(tree_nodes: DataFrame) -> int:
    """Steps from a root to the deepest leaf. The links are as large as the model, which the
    driver holds anyway; children have greater numbers than their parents."""
    links = tree_nodes.where("left IS NOT NULL").select("tree", "node", "left", "right").collect()
    level: dict[tuple[int, int], int] = {}
    for tree, node, left, right in sorted(map(tuple, links)):
        level[tree, left] = level[tree, right] = level.get((tree, node), 0) + 1
    return max(level.values(), default=0)


def _leaf(tree: Column, x: Column, steps: int) -> Column:
    """(p0, p1) of the leaf that ``x`` falls into."""
    def step(node: Column, _: Column) -> Column:
        left = F.get(tree["left"], node)
        below = F.get(x, F.get(tree["at"], node)) <= F.get(tree["threshold"], node)
        return F.when(left.isNull(), node).when(below, left).otherwise(F.get(tree["right"], node))

    ways = F.sequence(F.lit(1), F.lit(steps)) if steps else F.array().cast("array<int>")
    node = F.aggregate(ways, F.lit(0), step)
    return F.struct(F.get(tree["p0"], node).alias("p0"), F.get(tree["p1"], node).alias("p1"))


def _summed(leaves: str) -> tuple[Column, Column]:
    """(prediction, score) from the leaves, summed in tree order as the model does."""
    against = F.aggregate(leaves, F.lit(0.0), lambda a, x: a + x["p0"])
    in_favour = F.aggregate(leaves, F.lit(0.0), lambda a, x: a + x["p1"])
    return (in_favour > against).cast("int"), in_favour / (in_favour + against)


def scored(df: DataFrame, tree_nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with ``prediction`` and ``score`` from the nodes alone, for two classes."""
    trees, steps = packed(tree_nodes), depth(tree_nodes)
    ready = df.withColumns({"_trees": trees, "_x": F.array(*[F.col(f).cast("double") for f in features])})
    walked = ready.withColumn("_leaves", F.transform("_trees", lambda t: _leaf(t, F.col("_x"), steps)))
    prediction, score = _summed("_leaves")
    return walked.withColumns({"prediction": prediction, "score": score}).drop("_trees", "_x", "_leaves")


def affected(tree_nodes: DataFrame, scenarios: dict[str, Sequence[Change]]) -> DataFrame:
    """(scenario, trees): the trees that a scenario's changes can move."""
    spark = tree_nodes.sparkSession
    changed = spark.createDataFrame(
        [(n, c.feature) for n, changes in scenarios.items() for c in changes], "scenario string, feature string").distinct()
    return changed.join(feature_trees(tree_nodes), "feature").groupBy("scenario").agg(F.collect_set("tree").alias("trees"))


def scored_scenarios(
    df: DataFrame, tree_nodes: DataFrame, features: Sequence[str], scenarios: dict[str, Sequence[Change]],
) -> DataFrame:
    """Every row of ``df`` unchanged and per scenario, with ``prediction``, ``score`` and
    ``rescored``, the trees walked for it. Unchanged rows walk all trees, once."""
    trees, steps = packed(tree_nodes), depth(tree_nodes)
    x = F.array(*[F.col(f).cast("double") for f in features])
    base = df.withColumns({"_trees": trees, "_x": x})
    walked = base.withColumn("_base", F.transform("_trees", lambda t: _leaf(t, F.col("_x"), steps))).drop("_x", "_trees")
    # One row per scenario, so the broadcast is bounded.
    marked = with_scenarios(walked, scenarios).join(F.broadcast(affected(tree_nodes, scenarios)), "scenario", "left")
    ready = marked.withColumns({
        "_trees": trees, "_x": x, "_moved": F.coalesce("trees", F.array().cast("array<int>"))}).drop("trees")
    leaves = F.transform("_trees", lambda t, i: F.when(
        F.array_contains("_moved", t["tree"]), _leaf(t, F.col("_x"), steps)).otherwise(F.get("_base", i)))
    done = ready.withColumn("_leaves", leaves)
    prediction, score = _summed("_leaves")
    rescored = F.when(F.col("scenario") == UNCHANGED, F.size("_trees")).otherwise(F.size("_moved"))
    return done.withColumns({"prediction": prediction, "score": score, "rescored": rescored}).drop(
        "_trees", "_x", "_moved", "_leaves", "_base")


def scenario_counts(
    df: DataFrame, tree_nodes: DataFrame, features: Sequence[str], scenarios: dict[str, Sequence[Change]],
) -> DataFrame:
    """Users predicted to continue, per scenario, and the trees walked for it."""
    return scored_scenarios(df, tree_nodes, features, scenarios).groupBy("scenario").agg(
        F.count("*").alias("n"), F.sum("prediction").alias("continuing"), F.max("rescored").alias("rescored"))
