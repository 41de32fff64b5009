"""Command line jobs: features, train, score, whatif and reports.

    spark-submit stayline/job.py features --data <data> --out <out> --split train
    spark-submit stayline/job.py train    --out <out> --family forest
    spark-submit stayline/job.py score    --out <out> --family forest --split test

``--data`` holds users.csv, levels.csv, events.csv (files or folders) and
campaign_list.csv; ``--out`` receives ``matrices/``, ``models/`` and ``reports/``.
Which data set and which side of the user split to use are arguments.
"""

from __future__ import annotations

import argparse
import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.operators import chunks as ch, evaluate, frequency as fq
from stayline.operators.clean import at_least_levels, clean_events, clean_levels, clean_users
from stayline.operators.levels import number_levels
from stayline.plans import matrices as mx, reports, scoring, training
from stayline.session import configure, stage
from stayline.sources import csv, tables
from stayline.sources.splits import TEST, TRAIN, with_split

FAMILIES = {
    "forest": lambda train, features: training.tune_forest(train, features).model,
    "lasso": lambda train, features: training.tune_lasso(train, features).model,
    "forest_fixed": training.fit_forest,
    "multinomial": training.fit_weighted_logistic,
}


def read_logs(spark: SparkSession, data: str, split: str, payload: int = 4) -> dict[str, DataFrame]:
    """The four tables, cleaned and cut to the users of one side of the split.

    The side is a hash of the user id, so every table is cut in its own scan. Rows of users
    that the users table does not have go with the later inner joins. Users and level
    attempts are written out typed, since later steps read them often.
    """
    users = clean_users(csv.read_users(spark, f"{data}/users.csv"))
    levels = clean_levels(csv.read_levels(spark, f"{data}/levels.csv"))
    events = clean_events(csv.read_events(spark, f"{data}/events.csv", payload))
    if split != "all":
        users, levels, events = (
            with_split(df, key).where(F.col("split") == split).drop("split")
            for df, key in ((users, "id"), (levels, "user_id"), (events, "user_id"))
        )
    return {
        "users": stage(at_least_levels(users, 1), "users"),
        "numbered": stage(number_levels(stage(levels, "levels")), "numbered"),
        "events": stage(events, "events"),
        "campaigns": csv.read_campaigns(spark, f"{data}/campaign_list.csv"),
    }


def build_features(spark: SparkSession, data: str, out: str, split: str, payload: int = 4) -> None:
    """Write the five cumulative matrices and the two stand-alone ones, from one wide frame.

    Rows that the readers could not take are written beside them.
    """
    logs = read_logs(spark, data, split, payload)
    alone = scoring.STANDALONE
    wide = stage(mx.wide_users(**logs, chunks=(*ch.CHUNKS, *[c for _, c in alone.values()])), "wide-users")
    matrices = mx.model_matrices(wide)
    for key, (model, chunk) in alone.items():
        matrices[key] = mx.standalone_matrix(wide, model, (chunk,))
    tables.write_matrices(matrices, f"{out}/matrices", split)
    rejected = {
        "users": csv.read_rejected_users(spark, f"{data}/users.csv"),
        "levels": csv.read_rejected_levels(spark, f"{data}/levels.csv"),
        "events": csv.read_rejected_events(spark, f"{data}/events.csv", payload),
    }
    for name, rows in rejected.items():
        plain = rows.toDF(*[re.sub(r"[ ,;{}()\n\t=]+", "_", c) for c in rows.columns])
        plain.write.mode("overwrite").parquet(f"{out}/rejected/{name}")


def all_points() -> list[scoring.Point]:
    return [*scoring.cumulative_points(ch.MODELS), *scoring.standalone_points()]


def train(spark: SparkSession, out: str, family: str) -> None:
    """Fit, save and score every prediction point; write the report and ranked features."""
    points = all_points()
    matrices = {p.key: tables.read_matrix(spark, f"{out}/matrices", TRAIN, p.key) for p in points}
    fitted = scoring.train_points(matrices, FAMILIES[family], points, f"{out}/models", family)
    scoring.training_report(fitted).write.mode("overwrite").parquet(f"{out}/reports/train_scores_{family}")
    for key, point in fitted.items():
        if point.model is not None:
            ranked = training.ranked_weights(spark, point.model)
            ranked.write.mode("overwrite").parquet(f"{out}/reports/features_{key}_{family}")


def _fitted_keys(spark: SparkSession, out: str, family: str) -> set[int]:
    report = spark.read.parquet(f"{out}/reports/train_scores_{family}")
    return {r["model"] for r in report.where("fitted").select("model").distinct().collect()}


def _labelled_point(spark: SparkSession, out: str, split: str, point: scoring.Point) -> DataFrame:
    return scoring.labelled_point(tables.read_matrix(spark, f"{out}/matrices", split, point.key), point)


def score(spark: SparkSession, out: str, families: list[str], split: str, keys: list[int]) -> None:
    """Predictions, scores, area under the curve and baseline per prediction point, for each
    family. A point without a model has null predictions, a baseline and no scores."""
    for family in families:
        fitted = _fitted_keys(spark, out, family)
        for point in all_points():
            if point.key not in keys:
                continue
            data = _labelled_point(spark, out, split, point)
            base = f"{out}/reports/{split}_{point.key}_{family}"
            if point.key in fitted:
                scored = scoring.score_saved(f"{out}/models", point.key, family, data)
            else:
                scored = scoring.unscored(data)
            scored.write.mode("overwrite").parquet(f"{base}/predictions")
            written = spark.read.parquet(f"{base}/predictions")
            if point.key not in fitted:
                evaluate.majority_scores(written).write.mode("overwrite").parquet(f"{base}/baseline")
                continue
            evaluate.confusion_shares(evaluate.scores(written)).write.mode("overwrite").parquet(f"{base}/scores")
            evaluate.area_under_roc(written).write.mode("overwrite").parquet(f"{base}/auc")
            evaluate.majority_scores(written).write.mode("overwrite").parquet(f"{base}/baseline")


def what_if(
    spark: SparkSession, out: str, family: str, split: str, keys: list[int], scenarios: dict
) -> DataFrame:
    """Write users predicted to continue, unchanged and per scenario, for each prediction
    point; one without a model has a row with its users alone."""
    changes = {name: [scoring.Change(**c) for c in rows] for name, rows in scenarios.items()}
    fitted, parts = _fitted_keys(spark, out, family), []
    for point in all_points():
        if point.key not in keys:
            continue
        data = _labelled_point(spark, out, split, point)
        if point.key in fitted:
            model = PipelineModel.load(scoring.model_path(f"{out}/models", point.key, family))
            counts = scoring.scenario_counts(model, data, changes)
        else:
            counts = data.agg(F.lit(scoring.UNCHANGED).alias("scenario"), F.count("*").alias("n"),
                              F.lit(None).cast("long").alias("continuing"))
        parts.append(counts.select(F.lit(point.key).alias("model"), "scenario", "n", "continuing"))
    path = f"{out}/reports/what_if_{split}_{family}"
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def describe(
    spark: SparkSession, data: str, out: str, payload: int = 4, through: str | None = None, bins: int = 50,
    mix_levels: Sequence[int] = (60,),
) -> None:
    """All descriptive reports; ``through`` is the day the data was pulled. Histograms cover
    all values, in at most ``bins`` bins; ``mix_levels`` are the ordinals whose mix is told."""
    users = stage(clean_users(csv.read_users(spark, f"{data}/users.csv")), "users")
    levels = stage(clean_levels(csv.read_levels(spark, f"{data}/levels.csv")), "levels")
    events = clean_events(csv.read_events(spark, f"{data}/events.csv", payload))
    campaigns = csv.read_campaigns(spark, f"{data}/campaign_list.csv")
    curve = stage(reports.drop_off(users), "drop-off")
    numbered = number_levels(levels)
    day = through or levels.agg(F.max("created").cast("string").alias("d")).first()["d"]
    opening = [f"{r['level']}" for r in fq.first_rows(reports.level_popularity(levels, campaigns), 6, F.col("n").desc(), "level").collect()]
    parts = {
        "drop_off": curve,
        "worst_drops": reports.worst_drops(curve),
        "level_popularity": reports.level_popularity(levels, campaigns),
        "unpaid_popularity": reports.unpaid_popularity(users, levels, campaigns),
        "days_since_last": reports.days_since_last(levels, day),
        "inactivity": reports.inactivity(levels, day, bins),
        "levels_distribution": reports.levels_distribution(users, bins),
        "country_shares": reports.country_shares(users),
        "age_shares": reports.age_shares(users),
        "level_mix": reduce(DataFrame.unionByName, [
            reports.level_mix(numbered, n).withColumn("level_num", F.lit(n)) for n in mix_levels]),
        "language_mix": reports.language_mix(levels, opening),
        "latest_activity": reports.latest_activity(users, events),
    }
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{out}/reports/{name}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("step", choices=["features", "train", "score", "whatif", "describe"])
    parser.add_argument("--data")
    parser.add_argument("--out", required=True)
    parser.add_argument("--split", choices=[TRAIN, TEST, "all"], default=TRAIN)
    parser.add_argument("--family", choices=sorted(FAMILIES), nargs="+", default=["forest"],
                        help="score takes several in one run")
    parser.add_argument("--payload", type=int, default=4, help="payload columns per event line")
    parser.add_argument("--thresholds", type=int, nargs="*", default=None, help="default: all points")
    parser.add_argument("--through", help="day of the data pull, for inactivity")
    parser.add_argument("--bins", type=int, default=50, help="most bins of a described histogram")
    parser.add_argument("--mix-levels", type=int, nargs="+", default=[60], help="ordinals whose level mix is described")
    parser.add_argument("--scenarios", help='JSON: {"name": [{"feature": .., "op": .., "value": ..}]}')
    args = parser.parse_args(argv)
    spark = configure(spark or SparkSession.builder.appName("stayline").getOrCreate())
    keys = [p.key for p in all_points()] if args.thresholds is None else args.thresholds
    steps = {
        "features": lambda: build_features(spark, args.data, args.out, args.split, args.payload),
        "train": lambda: [train(spark, args.out, family) for family in args.family],
        "score": lambda: score(spark, args.out, args.family, args.split, keys),
        "whatif": lambda: [
            what_if(spark, args.out, family, args.split, keys, json.loads(args.scenarios)) for family in args.family],
        "describe": lambda: describe(
            spark, args.data, args.out, args.payload, args.through, args.bins, args.mix_levels),
    }
    steps[args.step]()


if __name__ == "__main__":
    main()
