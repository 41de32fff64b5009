"""Feature counts, nested populations, skew, and the jobs end to end."""

import pytest
from pyspark.sql import functions as F

from catalog.adapter import TEST_CHUNKS, TEST_MODELS, Tables
from stayline import job
from stayline.operators import chunks as ch
from stayline.plans import matrices as mx, training
from stayline.session import stage
from stayline.sources import tables
from stayline.sources.schema import RAW_CAMPAIGNS, RAW_LEVELS, RAW_USERS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF).staged()


@pytest.fixture(scope="module")
def wide(t):
    return stage(mx.wide_users(t.users, t.numbered, t.events, t.campaigns), "wide-test")


def test_feature_counts():
    assert [len(mx.model_features(m)) for m in ch.MODELS] == [26, 33, 40, 47, 54]


def test_id_and_targets_are_no_features():
    for model in ch.MODELS:
        assert not set(mx.META) & set(mx.model_features(model))


def test_one_row_per_user(wide, t):
    assert wide.count() == wide.select("id").distinct().count() == t.users.count()


def test_adapter_counts(t):
    assert (t.users.count(), t.levels.count()) == (15, 212)
    assert t.levels.where("date_completed is null").count() == 10
    assert t.levels.where("practice").count() == 52


def test_positives_are_the_next_population(wide):
    matrices = mx.model_matrices(wide, TEST_MODELS, TEST_CHUNKS)
    for model, after in zip(TEST_MODELS, TEST_MODELS[1:]):
        positives = matrices[model.threshold].where(F.col("levels_completed") >= model.threshold).count()
        assert positives == matrices[after.threshold].count()


def test_written_matrices_read_back_equal(spark, wide, tmp_path):
    matrices = mx.model_matrices(wide)
    tables.write_matrices(matrices, str(tmp_path / "m"), "train")
    for threshold, matrix in matrices.items():
        back = tables.read_matrix(spark, str(tmp_path / "m"), "train", threshold)
        assert back.columns == matrix.columns
        assert back.exceptAll(matrix).count() == 0 and matrix.exceptAll(back).count() == 0


def test_users_without_victories_lose_their_rates_only(spark, t):
    silent = t.events.where(F.col("event_name") != ch.VICTORY)
    wide = mx.wide_users(t.users, t.numbered, silent, t.campaigns, TEST_CHUNKS)
    row = wide.select("rate_hint_used_chunk_5", "logins_chunk_5", "share_python_chunk_5").distinct().collect()
    assert [tuple(r) for r in row] == [(None, 0, 0.0)]
    matrix = mx.model_matrix(wide, TEST_MODELS[0], TEST_CHUNKS[:1])
    assert training.labelled(matrix, mx.model_features(TEST_MODELS[0], TEST_CHUNKS), 10).count() == 0


def test_a_hot_user_changes_no_other(spark, t):
    """Half of all events belong to one user; everyone's features equal those without skew."""
    user = t.users.agg(F.min("id")).first()[0]
    extra = t.events.where(F.col("event_name") != ch.VICTORY).select(
        "event_id", "created", F.lit(user).cast("long").alias("user_id"), "event_name",
        F.lit(None).cast("string").alias("level"),
    )
    hot = mx.chunk_facts(t.users, t.events.unionByName(extra), t.numbered)
    cold = mx.chunk_facts(t.users, t.events, t.numbered)
    others = F.col("user_id") != user
    assert hot.where(others).exceptAll(cold.where(others)).count() == 0
    assert hot.where(others).count() == cold.where(others).count()
    key = (F.col("user_id") == user) & F.col("rate_hint_used").isNotNull()
    assert hot.where(key).agg(F.sum("rate_hint_used")).first()[0] > cold.where(key).agg(
        F.sum("rate_hint_used")).first()[0]


def _as_csv(df, headers, path):
    kinds = dict(df.dtypes)
    df.select(*[
        (F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS") if kinds[name] == "timestamp" else F.col(name)).alias(h)
        for h, (name, _) in headers.items()
    ]).write.option("header", True).csv(path)


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """The middle scale factor as raw CSV exports."""
    folder = str(tmp_path_factory.mktemp("logs"))
    big = Tables(spark, "/root/testdata/sf0.01").staged()
    _as_csv(big.users, RAW_USERS, f"{folder}/users.csv")
    _as_csv(big.levels, RAW_LEVELS, f"{folder}/levels.csv")
    _as_csv(big.campaigns, RAW_CAMPAIGNS, f"{folder}/campaign_list.csv")
    events = {"Created": ("created", ""), "User Id": ("user_id", ""), "Event Name": ("event_name", ""),
              "Level": ("level", "")}
    payload = [F.lit("x").alias(f"p{i}") for i in range(4)]
    columns = big.events.select("created", "user_id", "event_name", "level", *payload)
    _as_csv(columns, {**events, **{f"p{i}": (f"p{i}", "") for i in range(4)}}, f"{folder}/events.csv")
    return folder


def test_jobs_end_to_end(spark, logs, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    for split in ("train", "test"):
        job.main(["features", "--data", logs, "--out", out, "--split", split], spark)
    monkeypatch.setattr(job.ch, "MODELS", ch.MODELS[:2])
    monkeypatch.setitem(job.FAMILIES, "forest", lambda df, f: training.fit_forest(df, f, trees=5, max_depth=3))
    job.main(["train", "--out", out, "--family", "forest"], spark)
    monkeypatch.setitem(job.FAMILIES, "lasso", lambda df, f: training.tune_lasso(df, f, (1.0,), folds=2).model)
    job.main(["train", "--out", out, "--family", "lasso"], spark)
    job.main(["score", "--out", out, "--family", "forest", "lasso", "--split", "test"], spark)
    job.main(["describe", "--data", logs, "--out", out], spark)
    report = spark.read.parquet(f"{out}/reports/train_scores_forest").collect()
    assert {(r["model"], r["side"], r["fitted"]) for r in report} == {
        (m, side, True) for m in (10, 15, 13, 1312) for side in ("train", "test")}
    # A side whose users are of one class has a baseline and no area.
    assert all(r["auc"] is None or 0 <= r["auc"] <= 1 for r in report)
    assert all(r["baseline_accuracy"] is not None for r in report)
    assert spark.read.parquet(f"{out}/reports/test_10_lasso/scores").count() == 1
    assert spark.read.parquet(f"{out}/rejected/levels").count() == 0
    scores = spark.read.parquet(f"{out}/reports/test_15_forest/scores").collect()[0]
    held_out = spark.read.parquet(f"{out}/matrices/split=test/model=15")
    assert scores["tn"] + scores["fp"] + scores["fn"] + scores["tp"] == held_out.dropna().count()
    train_ids = spark.read.parquet(f"{out}/matrices/split=train/model=15").select("id")
    assert train_ids.intersect(held_out.select("id")).count() == 0
    counts = job.what_if(spark, out, "forest", "test", [10, 15], {
        "double": [{"feature": "rate_started_level_chunk_5", "op": "times", "value": 2.0}]})
    assert {(r["model"], r["scenario"]) for r in counts.collect()} == {
        (m, s) for m in (10, 15) for s in ("unchanged", "double")}
    assert spark.read.parquet(f"{out}/reports/what_if_test_forest").count() == 4
    for name in ("drop_off", "worst_drops", "inactivity", "levels_distribution", "language_mix", "latest_activity"):
        assert spark.read.parquet(f"{out}/reports/{name}").count() > 0
    alone = spark.read.parquet(f"{out}/matrices/split=test/model=13")
    assert "share_lua_chunk_6" in alone.columns
    # A point without a model leaves its users, null predictions and a baseline.
    monkeypatch.setattr(job, "_fitted_keys", lambda *_: set())
    job.score(spark, out, ["none"], "test", [10])
    held_out = spark.read.parquet(f"{out}/matrices/split=test/model=10").dropna().count()
    unscored = spark.read.parquet(f"{out}/reports/test_10_none/predictions")
    assert unscored.where("prediction is null and score is null").count() == unscored.count() == held_out
    assert spark.read.parquet(f"{out}/reports/test_10_none/baseline").first()["tn"] is not None
