"""Hand-written rows for the rules where engines or readings differ."""

import random
from datetime import date, datetime as dt

import pytest
from pyspark.sql import functions as F

from stayline import session
from stayline.functions import labels, people
from stayline.functions.elapsed import active_days, elapsed_days
from stayline.operators import chunks as ch, clean, evaluate, frequency as fq, lookup, ordered, packed
from stayline.operators.levels import number_levels, tag_events
from stayline.operators.lookup import latest
from stayline.operators.ordered import previous_time, running_total
from stayline.operators.skew import hot_keys, spread_join
from stayline.operators.sessions import count_logins, event_gaps, login_starts
from stayline.plans import profile
from stayline.session import stage
from stayline.sources import csv, infer, splits

EVENTS = "user_id long, created timestamp, event_name string, level string"
LEVELS = ("user_id long, created timestamp, level string, date_completed timestamp, playtime long, "
          "code_language string, practice boolean")


def at(day, hour=0, minute=0, second=0):
    return dt(2024, 1, day, hour, minute, second)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_gap_of_exactly_one_hour_is_a_login(spark):
    events = spark.createDataFrame(
        [(1, at(1, 0), "a", None), (1, at(1, 1), "a", None), (1, at(1, 1, 59, 59), "a", None)], EVENTS
    )
    assert rows(login_starts(events)) == [(1, at(1, 1), at(1, 0))]
    gaps = event_gaps(events).orderBy("created").select("gap_hours").collect()
    assert [g[0] for g in gaps] == [None, 1.0, pytest.approx(3599 / 3600)]


def test_logins_need_both_ends_of_the_gap_in_the_span(spark):
    events = spark.createDataFrame(
        [(1, at(1, 0), "early", None), (1, at(1, 3), "a", None), (1, at(1, 5), "a", None),
         (1, at(1, 9), "late", None)], EVENTS
    )
    spans = spark.createDataFrame(
        [(1, "join", at(1, 1), at(1, 5)), (1, "all", at(1, 0), at(1, 9)), (1, "tail", at(1, 5), at(1, 8)),
         (2, "none", at(1, 0), at(1, 9))],
        "user_id long, span string, since timestamp, until timestamp",
    )
    counted = count_logins(spans, events, ["user_id", "span"], "since", "until")
    assert rows(counted) == [(1, "all", 3), (1, "join", 1), (1, "tail", 0), (2, "none", 0)]


def test_logins_equal_a_plain_window_at_odd_thresholds(spark):
    moments = [at(1 + i // 20, (i * 7) % 24, (i * 13) % 60, (i * 29) % 60) for i in range(200)]
    events = spark.createDataFrame([(i % 3, m, "a", None) for i, m in enumerate(moments)], EVENTS)
    for hours in (0.25, 1.0, 2.5):
        plain = events.selectExpr(
            "user_id", "created",
            "lag(created) over (partition by user_id order by created) as previous",
        ).where(f"floor((unix_micros(created) - unix_micros(previous)) / 1000000) / 3600 >= {hours}D")
        assert rows(login_starts(events, hours)) == rows(plain)


def test_elapsed_days_are_24_hour_units(spark):
    df = spark.createDataFrame([(at(1, 23), at(2, 1))], "a timestamp, b timestamp")
    assert rows(df.select(elapsed_days(F.col("a"), F.col("b")), active_days(F.col("a"), F.col("b")))) == [(0, 1)]
    assert rows(df.select(elapsed_days(F.col("b"), F.col("a")))) == [(-1,)]


def _one_chunk(spark, victories, others=(), practice=()):
    """Events and numbered levels of one user whose victories are on levels 1, 2, ..."""
    events = [(1, t, ch.VICTORY, f"l{i + 1}") for i, t in enumerate(victories)]
    events += [(1, t, name, None) for t, name in others]
    levels = [(1, at(1, 0, i), f"l{i + 1}", None, 1, "python", False) for i in range(4)]
    levels += [(1, t, f"p{i}", None, 1, "lua", True) for i, t in enumerate(practice)]
    frame = spark.createDataFrame(levels, LEVELS)
    return spark.createDataFrame(events, EVENTS), number_levels(frame)


def test_average_time_wraps_days(spark):
    events, numbered = _one_chunk(spark, [at(1), at(3, 0, 0, 10)])
    wrapped = ch.chunk_features(events, numbered).collect()[0]
    true = ch.chunk_features(events, numbered, wrap_days=False).collect()[0]
    assert wrapped[ch.AVERAGE_TIME] == 5.0
    assert true[ch.AVERAGE_TIME] == 86405.0
    assert wrapped["rate_hint_used"] == 0.0


def test_no_victory_leaves_the_chunk_out(spark):
    events = spark.createDataFrame([(1, at(1), "Hint Used", None)], EVENTS)
    _, numbered = _one_chunk(spark, [])
    assert ch.chunk_features(events, numbered).count() == 0


def test_single_victory_counts_the_same_instant(spark):
    events, numbered = _one_chunk(
        spark, [at(5)], others=[(at(5), "Hint Used"), (at(5, 0, 0, 1), "Hint Used")], practice=[at(5)]
    )
    row = ch.chunk_features(events, numbered).collect()[0]
    assert (row["rate_hint_used"], row["rate_practice_levels"], row[ch.AVERAGE_TIME]) == (1.0, 1.0, 0.0)


def test_shared_instant_counts_in_both_chunks(spark):
    levels = spark.createDataFrame(
        [(1, at(1, 0, i), f"l{i + 1}", None, 1, "python", False) for i in range(6)], LEVELS
    )
    events = spark.createDataFrame(
        [(1, at(2), ch.VICTORY, "l4"), (1, at(2), ch.VICTORY, "l5"), (1, at(2), "Hint Used", None)], EVENTS
    )
    features = ch.chunk_features(events, number_levels(levels))
    assert rows(features.select("chunk", "rate_hint_used")) == [(5, 1.0), (10, 1.0)]


def test_repeated_level_takes_the_first_number(spark):
    levels = spark.createDataFrame(
        [(1, at(1, 1), "a", None, 1, "python", False), (1, at(1, 2), "a", None, 1, "python", False)], LEVELS
    )
    events = spark.createDataFrame([(1, at(2), ch.VICTORY, "a"), (1, at(2), "x", None), (1, at(2), "y", "z")], EVENTS)
    numbered = number_levels(levels)
    assert rows(tag_events(events, numbered).select("event_name", "level_num").fillna(-1)) == [
        (ch.VICTORY, 1), ("x", -1), ("y", -1)
    ]
    fanned = tag_events(events, numbered, fanout=True).where("level_num is not null")
    assert rows(fanned.select("level_num")) == [(1,), (2,)]
    bounds = {f: ch.chunk_bounds(events, numbered, fanout=f).collect()[0]["victories"] for f in (False, True)}
    assert bounds == {False: 1, True: 2}


def test_language_share_may_exceed_one(spark):
    levels = spark.createDataFrame(
        [(1, at(1, 0, i), f"l{i + 1}", at(2), 1, "python", False) for i in range(4)], LEVELS
    )
    spans = spark.createDataFrame([(1, 5, 2)], "user_id long, chunk int, victories long")
    row = ch.language_shares(spans, number_levels(levels)).collect()[0]
    assert (row["share_python"], row["share_lua"]) == (2.0, 0.0)


def test_last_event_ties(spark):
    events = spark.createDataFrame(
        [(1, at(1), "a", None), (1, at(2), "a", "l"), (1, at(2), "b", None), (1, at(2), "b", None)], EVENTS
    )
    users = spark.createDataFrame([(1,), (2,)], "id long")
    one = profile.with_last_event(users, events).select("id", "last_action").fillna("-")
    assert rows(one) == [(1, "b"), (2, "-")]
    every = profile.with_last_event(users, events, ties="all").select("id", "last_action").fillna("-")
    assert rows(every) == [(1, "a"), (1, "b"), (2, "-")]


def test_ordered_slots_equal_a_plain_window(spark):
    data = [(i % 2, at(1 + (i * 7) % 9, (i * 5) % 24, i % 60), i) for i in range(300)]
    # A hot user, and many rows at one instant.
    data += [(0, at(4, 4), 1000 + i) for i in range(200)]
    df = spark.createDataFrame(data, "k long, t timestamp, i long")
    order = "over (partition by k order by t, i"
    plain = rows(df.selectExpr("i", f"count(*) {order} rows unbounded preceding)", f"lag(t) {order})"))
    for ways in ({}, {"hot_rows": 100}, {"hot_rows": 10}, {"hot_rows": 100, "slot": 3600}, {"by_range": True}):
        both = running_total(df, ["k"], "t", ["i"], "n", **ways).join(
            previous_time(df, ["k"], "t", ["i"], "p", **ways).select("i", "p"), "i"
        )
        assert rows(both.select("i", "n", "p")) == plain


def test_slots_follow_a_burst(spark):
    """One user with all rows within a second, a third of them at one instant."""
    second = spark.range(9000).selectExpr(
        "7L k", "timestamp_micros(1704067200000000 + if(id % 3 = 0, 250000, id * 7919 % 1000000)) t", "id i")
    cut, carried = ordered._cut(second, ["k"], "t", ["i"], None, False, hot_rows=500)
    sizes = [r["count"] for r in cut.groupBy("_slot").count().collect()]
    assert carried and sum(sizes) == 9000
    assert len(sizes) >= 18 and max(sizes) <= 1000
    _, carried = ordered._cut(second, ["k"], "t", ["i"], None, False, hot_rows=10_000)
    assert not carried


def test_slots_are_bounded_however_low_the_limit(spark, monkeypatch):
    """A burst with 900 times the limit of a slot, and an instant with 300 times it."""
    monkeypatch.setattr(ordered, "_MOST_WAYS", 16)
    second = spark.range(9000).selectExpr(
        "7L k", "timestamp_micros(1704067200000000 + if(id % 3 = 0, 250000, id * 7919 % 1000000)) t", "id i")
    cut, carried = ordered._cut(second, ["k"], "t", ["i"], None, False, hot_rows=10)
    sizes = [r["count"] for r in cut.groupBy("_slot").count().collect()]
    assert carried and sum(sizes) == 9000 and 16 <= len(sizes) <= 48
    plain = rows(second.selectExpr("i", "count(*) over (partition by k order by t, i rows unbounded preceding)"))
    assert rows(running_total(second, ["k"], "t", ["i"], "n", hot_rows=10).select("i", "n")) == plain


def test_gaps_of_a_burst_need_few_slots(spark, monkeypatch):
    monkeypatch.setattr(ordered, "_MOST_WAYS", 16)
    second = stage(spark.range(3000).selectExpr(
        "7L user_id", "timestamp_micros(1704067200000000 + if(id % 3 = 0, 9000000, id * 7919 % 30000000)) created", "id i"), "second")
    cut, _ = ordered._cut(second, ["user_id"], "created", ["i"], None, False, hot_rows=4)
    assert cut.select("_slot").distinct().count() <= 48
    got = event_gaps(second, ["i"], hot_rows=4).selectExpr("i", "cast(round(gap_hours * 3600) as int) s").fillna(-1)
    lag = "lag(created) over (partition by user_id order by created, i)"
    plain = second.selectExpr("i", f"cast(floor((unix_micros(created) - unix_micros({lag})) / 1000000) as int) s").fillna(-1)
    assert rows(got) == rows(plain)


def test_the_plan_does_not_grow_with_the_search(spark, monkeypatch):
    """19 steps, each naming the one before three times, were written into each other."""
    def stretches(df, keys, hot, slot_rows):
        cuts = spark.range(1).selectExpr("7L k", f"transform(sequence(1, {2**18}), x -> 1704067200000000 + 3 * x) {ordered._CUTS}")
        return stage(cuts, "cuts"), hot_keys(df.limit(0), [*keys, ordered._TIME], 1)

    monkeypatch.setattr(ordered, "stretches", stretches)
    df = stage(spark.range(500).selectExpr("7L k", "timestamp_micros(1704067200000000 + id * 1571) t", "id i"), "rows")
    assert rows(running_total(df, ["k"], "t", ["i"], "n", hot_rows=10).select("i", "n")) == [(i, i + 1) for i in range(500)]


def test_binary_search_counts_cuts(spark):
    df = spark.range(-2, 40).selectExpr("id v", "array(0L, 3L, 3L, 10L, 20L, 21L, 33L) cuts")
    got = ordered._counted_below(df, "cuts", "v", 7, "n").selectExpr("v", "n").collect()
    assert all(r.n == sum(c <= r.v for c in (0, 3, 3, 10, 20, 21, 33)) for r in got)


PACKED = "k int, created timestamp, t string, b boolean, n long, d date"


@pytest.mark.parametrize("columns", [["created", "t", "b", "n", "d"], ["n", "created", "d", "t"], ["t"], ["n", "wide"], ["x", "t"], ["wide", "n", "created", "wide2"]])
@pytest.mark.parametrize("size", [0, 1, 200])
def test_packed_rows_order_as_structs(spark, columns, size):
    r = random.Random(size)
    data = [(r.choice([None, 1, 2, 3]), r.choice([None, at(1, r.randint(0, 9))]), r.choice([None, "a", "b", "", "é"]),
             r.choice([None, True, False]), r.choice([None, -5, 2**40, 7]), r.choice([None, date(1960, 1, 1), date(2030, 1, 1)]))
            for _ in range(size)]
    df = spark.createDataFrame(data, PACKED).repartition(3).selectExpr("*", "n * 3000000 wide", "n * -2000000 wide2", "n / 2 x")
    got = packed.greatest(df, ["k"], columns, pack=True)
    plain = df.groupBy("k").agg(F.max(F.struct(*columns)).alias("s")).select("k", *[f"s.{c}" for c in columns])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_last_rows_neither_move_nor_sort_the_log(spark, tmp_path):
    spark.range(2000).selectExpr("id % 50 user_id", "timestamp_seconds(id) created", "concat('e', id % 7) event_name",
                                 "concat('l', id % 90) level").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plans = [latest(log, ["event_name", "level"], ["event_name", "level"], pack=p)._jdf.queryExecution().executedPlan()
                 .toString().splitlines() for p in (True, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in plans:
        moved = [k for k, line in enumerate(plan) if "Exchange hashpartitioning(user_id" in line]
        assert len(moved) == 1 and "partial_max" in plan[moved[0] + 1]
        assert not any("SortMergeJoin" in line for line in plan)
    assert not any("Sort" in line for line in plans[0] if "user_id" in line)


def test_hot_keys_are_those_over_the_limit(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(2,)] * 10 + [(None,)] * 50, "k long")
    assert rows(hot_keys(df, ["k"], 20)) == [(1, 30)]
    assert hot_keys(df, ["k"]).count() == 0


@pytest.mark.parametrize("ways", [{}, {"hot_rows": 0}, {"by_range": True}])
def test_rows_without_key_or_time_are_kept_unnumbered(spark, ways):
    df = spark.createDataFrame(
        [(1, at(1), "a"), (None, at(1), "b"), (1, None, "c"), (1, at(2), "d")],
        "k long, t timestamp, v string",
    )
    numbered = running_total(df, ["k"], "t", ["v"], "n", **ways)
    assert rows(numbered.select("v", "n").fillna(-1)) == [("a", 1), ("b", -1), ("c", -1), ("d", 2)]
    previous = previous_time(df, ["k"], "t", ["v"], "p", **ways)
    assert rows(previous.where("p is not null").select("v", "p")) == [("d", at(1))]


def test_named_chunk_needs_no_numbered_level(spark):
    events = spark.createDataFrame([(1, at(1), ch.VICTORY, "a"), (1, at(2), ch.VICTORY, "b")], EVENTS)
    nothing = spark.createDataFrame([], LEVELS).withColumn("level_num", F.lit(1).cast("long"))
    bounds = ch.chunk_bounds(events, nothing, [ch.Chunk(6, 0, 0, ("a", "c"))])
    assert rows(bounds) == [(1, 6, at(1), at(1), 1)]


def test_level_label_edges(spark):
    users = spark.createDataFrame([(n,) for n in (4, 5, 9, 10, 998, 999)], "n int")
    labelled = users.select("n", labels.level_class(F.col("n"), 2, 10), labels.continues(F.col("n"), 10))
    assert rows(labelled) == [(4, 0, 0), (5, 0, 0), (9, 0, 0), (10, 1, 1), (998, 1, 1), (999, 2, 1)]


def test_unknown_age_and_country(spark):
    users = spark.createDataFrame([(1, None, None)], "id long, age string, country string")
    c = F.col("country")
    groups = people.country_groups(c)
    row = users.select(
        people.age_or_other(F.col("age")), people.lumped_country(c), people.english_speaking(c),
        groups["country_non_english"],
    ).collect()[0]
    assert tuple(row) == ("other_age", "other_country", False, True)


def test_csv_short_and_long_lines(spark, tmp_path):
    (tmp_path / "events.csv").write_text(
        "h1,h2,h3,h4,h5,h6,h7,h8\n"
        '2024-01-01 00:00:00,1,ok,l,"x,y",b,c,d\n'
        "2024-01-01 00:00:01,2,short\n"
        "2024-01-01 00:00:02,3,long,l,a,b,c,d,e\n"
        "2024-01-01 00:00:03,4,blank end,l,a,b,c,d,\n"
    )
    path = str(tmp_path / "events.csv")
    kept = clean.clean_events(csv.read_events(spark, path))
    assert kept.columns == ["created", "user_id", "event_name", "level"]
    assert rows(kept.select("user_id", "event_name")) == [(1, "ok"), (2, "short")]
    assert rows(csv.read_rejected_events(spark, path).select("user_id")) == [(3,), (4,)]
    wide = csv.read_events(spark, path, payload=6)
    assert wide.count() == 4


def test_users_csv_with_a_cut_header(spark, tmp_path):
    (tmp_path / "users.csv").write_text(
        "Unnamed: 0,Id,Date Joined,Levels Completed,Signed Up,Paid Subscription,Country,How old are you?,"
        "Gender,After a while, do you like it?,Would you stay?,Would you tell?\n"
        "0,7,2024-01-01 10:00:00,12,True,False,russia,,f,much,likely,surely\n"
    )
    users = clean.clean_users(csv.read_users(spark, str(tmp_path / "users.csv")))
    row = users.collect()[0].asDict()
    assert (row["id"], row["date_joined"], row["signed_up"], row["age"]) == (7, at(1, 10), True, None)
    assert "Unnamed: 0" not in row
    assert (row["survey_do_you_like_it"], row["survey_would_you_stay"], row["survey_would_you_tell"]) == (
        "much", "likely", "surely")
    assert profile.drop_unmodelled(users).columns == [
        "id", "date_joined", "levels_completed", "signed_up", "paid_subscription", "country", "age"]


def test_bad_timestamps_become_null(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1, "a", None), ("n/a", 1, "b", None)],
                               "created string, user_id long, event_name string, level string")
    assert clean.clean_events(df).where("created is null").count() == 1


def _scored(spark, pairs):
    return spark.createDataFrame(pairs, "y int, score double")


def test_area_under_roc_ties_and_pairs(spark):
    tied = _scored(spark, [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)])
    assert evaluate.area_under_roc(tied).collect()[0]["auc"] == 0.5
    pairs = [((i * 7) % 3 % 2, ((i * 37) % 101) / 1000) for i in range(120)]
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.area_under_roc(_scored(spark, pairs)).collect()[0]["auc"] == pytest.approx(expected)


def test_one_class_has_no_area(spark):
    assert evaluate.area_under_roc(_scored(spark, [(1, 0.1), (1, 0.2)])).collect()[0]["auc"] is None


def test_all_negative_predictions_score_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "y int, prediction int")
    row = evaluate.scores(df).collect()[0]
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    assert evaluate.majority_scores(df).collect()[0].asDict() == row.asDict()


def test_majority_tie_predicts_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, prediction int")
    assert evaluate.majority_scores(df).collect()[0]["tp"] == 0


def test_equal_features_of_two_users_are_kept(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (2, 2.0)], "id long, x double")
    assert df.dropDuplicates().count() == 2


def test_histogram_top_edge_is_in_the_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 9, 10, 11)], "x int")
    assert rows(fq.histogram(df, "x", 5, 0, 10).select("bin", "n")) == [(1, 2), (5, 2)]


def test_profile_quartiles_and_nulls(spark):
    df = spark.createDataFrame([(float(x) if x else None,) for x in range(12)], "x double")
    row = fq.profile(df, ["x"]).collect()[0]
    assert (row["filled"], row["q25"], row["q50"], row["q75"]) == (11, 3.5, 6.0, 8.5)


def test_split_sides_and_audit(spark):
    users = spark.range(1000)
    split = splits.with_split(users)
    train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
    assert 700 < train.count() < 800
    audit = splits.split_audit(users, train, test).collect()[0]
    assert (audit["n_full"], audit["n_overlap"], audit["n_missing"], audit["n_stray"]) == (1000, 0, 0, 0)
    bad = splits.split_audit(users.where("id < 900"), train, train.union(test.where("id < 500"))).collect()[0]
    assert bad["n_overlap"] == train.count() and bad["n_stray"] > 0 and bad["n_missing"] > 0


def test_a_salted_split_is_independent(spark):
    train = splits.with_split(spark.range(1000)).where(F.col("split") == "train").drop("split")
    assert splits.with_split(train).where(F.col("split") == "test").count() == 0
    share = splits.with_split(train, salt="x").where(F.col("split") == "test").count() / train.count()
    assert 0.2 < share < 0.3


def test_halves_are_disjoint_and_complete(spark):
    df = spark.range(500).withColumn("k", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")))
    a, b = splits.halves(df, "k")
    assert a.count() + b.count() == 500
    assert a.intersect(b).count() == 0


def test_unpaid_users_semi_join_does_not_fan_out(spark):
    users = spark.createDataFrame([(1, False, 20), (1, False, 20), (2, True, 20), (3, False, 12)],
                                  "id long, paid_subscription boolean, levels_completed int")
    levels = spark.createDataFrame([(u, at(1), "l", None, 1, "lua", False) for u in (1, 2, 3)], LEVELS)
    assert rows(lookup.unpaid_over(users, levels, 12).select("user_id")) == [(1,)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_equals_a_plain_join(spark, how):
    facts = spark.createDataFrame(
        [(1, 1)] * 50 + [(1, i) for i in range(60)] + [(i % 9, i) for i in range(40)] + [(None, 5)] * 20,
        "k long, v long",
    ).repartition(4)
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (99, "d"), (None, "e")], "k long, x string")
    if how == "left_semi":
        small = small.dropDuplicates(["k"])
    plain = facts.join(small, "k", how).collect()
    for hot_rows in (1_000_000, 20, 1):
        spread = spread_join(facts, small, ["k"], how, hot_rows).collect()
        assert sorted(map(str, spread)) == sorted(map(str, plain))


def test_hot_user_is_dealt_to_many_partitions(spark):
    """Under a sort-merge join, no partition keeps the hot user's rows together."""
    facts = spark.range(4000).select(
        F.lit(7).cast("long").alias("user_id"), F.timestamp_micros(F.col("id") * 1000).alias("created")
    ).repartition(8)
    bounds = spark.createDataFrame(
        [(7, dt(1970, 1, 1), dt(1970, 1, 2))], "user_id long, date_started timestamp, date_completed timestamp"
    )
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = ch.within_bounds(facts, bounds, hot_rows=100)
        sizes = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000
    assert max(sizes) < 2000


def test_numbers_with_a_point_and_values_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "levels.csv").write_text(
        "User Id,Created,Level,Date Completed,Playtime (s),Code Language,Practice\n"
        "1,2024-01-01 00:00:00,a,,13.0,lua,True\n"
        "2,2024-01-01 00:00:00,a,2024-01-01 00:00:05,,lua,False\n"
        "3,2024-01-01 00:00:00,a,,13.5,lua,False\n"
        "4,soon,a,,1,lua,False\n"
        "9007199254740993,2024-01-01 00:00:00,a,,1,lua,maybe\n"
        "9007199254740993,2024-01-01 00:00:00,a,,1,lua,True\n"
    )
    path = str(tmp_path / "levels.csv")
    assert rows(csv.read_levels(spark, path).select("user_id", "playtime").fillna(-1)) == [
        (1, 13), (2, -1), (9007199254740993, 1)]
    assert rows(csv.read_rejected_levels(spark, path).select("User Id")) == [("3",), ("4",), ("9007199254740993",)]


def test_bad_event_times_and_users_are_quarantined(spark, tmp_path):
    (tmp_path / "events.csv").write_text(
        "h1,h2,h3,h4,h5,h6,h7,h8\n"
        "2024-01-01 00:00:00,1,ok,l,a,b,c,d\nnever,2,bad time,l,a,b,c,d\n2024-01-01 00:00:00,x,bad user,l,a,b,c,d\n")
    path = str(tmp_path / "events.csv")
    assert rows(csv.read_events(spark, path).select("user_id")) == [(1,)]
    assert csv.read_rejected_events(spark, path).count() == 2


def test_uncovered_keys_may_repeat(spark):
    full = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    part = spark.createDataFrame([(1,), (None,)], "id long")
    assert rows(splits.uncovered(full, part)) == [(2,)]


def test_only_the_country_block_goes(spark):
    df = spark.createDataFrame([(1, 0, 0, 0)], "id long, country_us int, country_russia int, country_other_country int")
    assert clean.drop_countries(df).columns == ["id", "country_us"]


def test_a_level_of_two_campaigns_doubles_nobody(spark):
    levels = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, level string")
    campaigns = spark.createDataFrame([("forest", "a"), ("dungeon", "a")], "campaign string, level string")
    assert rows(lookup.with_campaign(levels, campaigns, "level")) == [(1, "a", "dungeon"), (2, "b", "other")]


def test_a_burst_inside_one_slot(spark):
    """One user with all attempts in one second: slots cannot part them, ranges can."""
    burst = spark.range(0, 500, 1, 4).select(
        F.lit(1).cast("long").alias("user_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created"),
        F.format_string("l%04d", F.col("id")).alias("level"))
    for by_range in (False, True):
        numbered = number_levels(burst, by_range=by_range, hot_rows=10)
        assert rows(numbered.select("level_num")) == [(i,) for i in range(1, 501)]
        assert numbered.where(F.col("level") == "l0499").first()["level_num"] == 500


def test_language_dummies_have_a_fixed_vocabulary(spark):
    rows = spark.createDataFrame([(1, "python"), (2, "java"), (3, "perl"), (4, None)], "id long, code_language string")
    got = clean.language_dummies(rows)
    assert got.columns == ["id", *[f"code_language_{x}" for x in ch.LANGUAGES]]
    ones = {r.id: [c for c in got.columns[1:] if r[c]] for r in got.collect()}
    assert ones == {1: ["code_language_python"], 2: ["code_language_java"], 3: [], 4: []}


@pytest.mark.parametrize("values,bins,width", [
    ([0.0, 1, 2, 3, 400], 50, 16.0), ([5.0] * 9, 4, 0.5), ([-3.0, -1, 0, 8], 6, 4.0), ([0.0], 3, 1.0), ([8.0, 7.999999, 16, 4, 2], 9, 2.0),
    ([2.0**40, 1e-9], 10, 2.0**37), ([-1e300, 1e300, None, float("nan"), float("inf")], 10, None)])
def test_histograms_grow_to_the_values(spark, values, bins, width):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in [*values, None]], "v double").repartition(3)
    got = fq.growing_histogram(df, "v", bins).collect()
    assert sum(r.n for r in got) == len(values) + 1
    filled = [r for r in got if r.bin is not None]
    assert all(1 <= r.bin <= max(bins, 2) for r in filled) and len({r.bin for r in filled}) == len(filled)
    plain = [v for v in values if v is not None and abs(v) < float("inf")]
    for r in filled:
        assert r.n == sum(r.bin_from <= v < r.bin_to for v in plain)
        assert width is None or r.bin_to - r.bin_from == width
    assert fq.growing_histogram(df.limit(0), "v", bins).count() == 0


def test_histogram_counts_what_lies_outside(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 5.0, 10.0, 11.0, None, float("nan"))], "v double")
    got = fq.histogram(df, "v", 2, 0, 10, outside=True).collect()
    assert {r.bin: (r.bin_from, r.bin_to, r.n) for r in got} == {
        0: (None, 0.0, 1), 1: (0.0, 5.0, 1), 2: (5.0, 10.0, 2), 3: (10.0, None, 1), None: (None, None, 2)}


class _Settings:
    """A session that knows two settings."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_intermediate_tables_go_to_the_shared_folder():
    assert session.shared_dir(_Settings(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"
    for master in ("local", "local[4]"):
        assert session.shared_dir(_Settings(spark_master=master)) == session.shared_dir(_Settings(spark_master=master))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            session.shared_dir(_Settings(spark_master=master))


def test_types_are_the_least_that_all_values_share(spark):
    columns = {
        "int": ["1", " -20 ", None, ""], "double": ["1", "2.5", "1e3", ".5"], "flag": ["True", "false", None, "TRUE"],
        "time": ["2024-01-02", "2024-01-02 03:04:05.5", "2024-01-02T03:04", None], "text": ["1", "x", None, "true"],
        "mixed": ["true", "1", "0", None], "none": [None, "", " ", None], "code": ["007", "8", "9", None],
        "long": ["9" * 19, "1", None, None], "no_day": ["2024-02-30", "2024-01-01", None, None],
    }
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns)).repartition(3)
    found = infer.column_types(df, list(columns))
    assert found == {"int": "bigint", "double": "double", "flag": "boolean", "time": "timestamp", "text": "string",
                     "mixed": "string", "none": "string", "code": "string", "long": "double", "no_day": "string"}
    typed = infer.with_types(df, list(columns))
    assert {c: k for c, k in typed.dtypes if c in ("int", "double", "flag", "time", "none")} == {
        "int": "bigint", "double": "double", "flag": "boolean", "time": "timestamp", "none": "string"}
    assert sorted(r["int"] for r in typed.collect() if r["int"] is not None) == [-20, 1]
    later = infer.with_types(spark.createDataFrame([("x",), ("5",)], "int string"), ["int"], found)
    assert sorted((r["int"] for r in later.collect()), key=repr) == [5, None]
    assert infer.column_types(df.limit(0), ["int"]) == {"int": "string"} and infer.column_types(df, []) == {}
