"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import math
import os
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from stayline.llm import (
    balltree, bpe, brown, chat, components, kneser_ney, mixing, packing, quality_rules, queries, simhash, substrings,
)
from stayline.llm.common import keep
from stayline.session import shared_dir

_random = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LONG = " ".join(f"x{i % 7919}y{i}" for i in range(60_000))
PASSAGE = prose(60, 99)
TEXTS = [
    (1, prose(80, 1)), (2, prose(80, 1)), (2, prose(80, 1)), (None, prose(80, 1)), (None, prose(80, 1)),
    (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "one"), (7, "one two"), (8, "ONE TWO"),
    (9, LONG), (10, f"{prose(30, 2)} {PASSAGE} tail"), (11, f"{prose(40, 3)}\n{PASSAGE}\n"), (None, f"{PASSAGE} {prose(20, 4)}"),
    (12, "a b c d e " * 30), (13, "line of words\nline of words\n\nother # line $"), (14, "café   no break \U0001f600  x"),
    (-5, prose(200, 6)), (15, prose(199, 6) + " changed"), (16, "İstanbul ΣΣ <|endoftext|> it's"), (None, None),
]
NAMES = ["row", "unit", "id", "f", "g", "kept", "n_words", "copies", "ids", "class", "fingerprint", "copy", "domain",
         "rid", "x0", "t", "key", "weight", "part", "_id", "block", "level", "cut", "distance", "row_number", "text2"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (i, t, [None, "en", "de"][k % 3], [None, "src1", "src2"][k % 2 + (k % 5 == 0)], *[f"{n}{k}" for n in NAMES])
        for k, (i, t) in enumerate(TEXTS)
    ]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by(rows):
    return sorted(rows, key=repr)


def carried(df, docs):
    """The given rows come back whole under their own names."""
    back = df.select("row.*")
    wanted = [c for c in docs.columns if c in back.columns]
    assert by(map(tuple, back.select(*[f"`{c}`" for c in wanted]).collect())) == by(
        map(tuple, docs.select(*[f"`{c}`" for c in wanted]).collect()))
    assert len(wanted) >= len(docs.columns) - 1


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs)
    carried(got, docs)
    rows = got.select("row.doc_id", "fingerprint", "component_id").collect()
    assert by(map(tuple, rows)) == by(brute.components(TEXTS))
    assert simhash.near_duplicates(none).count() == 0


def test_long_posting_lists_give_the_same_components(spark):
    centre, prints = 0x0123456789ABCDEF, {0}
    for _ in range(500):
        prints.add(centre ^ sum(1 << b for b in _random.sample(range(64), _random.randint(0, 5))))
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "f long")
    listed = sorted(prints)
    expected = {a: {a} for a in listed}
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= 3 and expected[a] is not expected[b]:
                both = expected[a] | expected[b]
                for x in both:
                    expected[x] = both
    wanted = {frozenset(g) for g in expected.values() if len(g) > 1}
    for long, longest in ((1024, 8192), (20, 8192), (20, 10)):
        roots = components.component_roots(keep(simhash.links_between(rows, long, longest), "links")).collect()
        groups = {}
        for r in roots:
            groups.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
        assert {frozenset(g) for g in groups.values()} == wanted


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (70, 71)], "a long, b long")
    roots = {r.node: r.root for r in components.component_roots(chain).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 70: 70, 71: 70}
    assert components.component_roots(chain.limit(0)).count() == 0


def test_substrings(spark, docs, none):
    got = substrings.without_repeats(docs)
    carried(got, docs)
    rows = got.select("row.doc_id", "n_words", "n_removed", "kept").collect()
    assert by(map(tuple, rows)) == by(brute.without_repeats(TEXTS))
    assert substrings.without_repeats(none).count() == 0


def test_substrings_over_many_units_and_blocks(spark, docs, monkeypatch):
    """A crowded sketch overestimates more, which changes no result."""
    monkeypatch.setattr(substrings, "UNIT_BYTES", 4096)
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", 512)
    monkeypatch.setattr(substrings, "CELLS", 1 << 10)
    rows = substrings.without_repeats(docs).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    assert by(map(tuple, rows)) == by(brute.without_repeats(TEXTS))


def test_quality_rules(spark, docs, none):
    def judged(df):
        return quality_rules.judge(keep(quality_rules.with_points(quality_rules.with_statistics(df)), "points"))

    got = judged(docs)
    carried(got, docs)
    rows = got.select("row.text", *quality_rules.COUNTS, "base_failed", "kept").collect()
    for r in rows:
        assert tuple(r)[1:6] == brute.counts(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert any(r.kept for r in rows)
    assert judged(none).count() == 0


def test_outliers_go_and_equal_rows_stay(spark):
    """A group of ordinary texts with a few strange ones, and a group of one repeated row."""
    plain = [(i, prose(50 + i % 90, i), "en", "a") for i in range(120)]
    strange = [(200 + i, prose(60, i).replace(" ", " ### $$$ "), "en", "a") for i in range(6)]
    equal = [(300, prose(50, 7), None, "b")] * 40
    rows = spark.createDataFrame(plain + strange + equal, "doc_id long, text string, lang string, source string")
    points = keep(quality_rules.with_points(quality_rules.with_statistics(rows)), "points")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(points).select("row.doc_id", "kept").collect()}
    assert {i for i, k in kept.items() if not k} == {i for i, *_ in strange}


def test_small_groups_are_judged_by_language_and_corpus(spark):
    """Sources of five documents in a large language, and a language of five documents."""
    rows = [(i, prose(50 + i % 90, i), "en", f"s{i // 5}") for i in range(100)]
    rows += [(200 + i, prose(60 + i, i), "xx", None) for i in range(4)]
    junk = {17: "en", 203: "xx"}
    rows = [(i, t.replace(" ", " ### $$$ ") if i in junk else t, lang, source) for i, t, lang, source in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    points = keep(quality_rules.with_points(quality_rules.with_statistics(frame)), "points")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(points).select("row.doc_id", "kept").collect()}
    assert {i for i, k in kept.items() if not k} == set(junk)
    few = points.where(F.col("row.doc_id").isin(200, 201))
    assert all(r.kept for r in quality_rules.judge(keep(few, "few")).select("kept").collect())


def test_mixing(spark, docs, none):
    weights = {"domain": {}, "lang": {"en": 3}, "source": {"src1": 2}}
    for share, epochs in (((1, 2), 2), ((3, 1), 2), ((0, 1), 1), ((9, 10), 1)):
        domain = F.when(F.col("source").isNull(), F.lit("x")).otherwise(F.lit("y"))
        got = mixing.mixed(docs, domain, weights, share, epochs, seed=3)
        given = docs.collect()
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in given]
        taken = brute.copies(rows, weights, lambda s: "x" if s is None else "y", share, epochs, 3)
        expected = [(r.row, n) for r, n in zip(given, taken) if n]
        assert by((r.row, r.copies) for r in got.select("row.row", "copies").collect()) == by(expected)
    assert mixing.mixed(none, F.lit("x"), weights, (1, 2), 2, 3).count() == 0


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([
        ("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 5), ("b", "de", "s5", 0),
    ], "domain string, lang string, source string, tokens long")
    given = {r.source: r.given for r in mixing.budgets(leaves, {"domain": {"b": 3}}, 1, (1, 5)).collect()}
    # 403 tokens: b can take 5 of its three quarters, so a has 398, 199 for each language,
    # and what s1 lacks stays in its language.
    assert given == {"s1": 10, "s2": 189, "s3": 199, "s4": 5, "s5": 0}


@pytest.mark.parametrize("sizes,share,taken", [
    ((900, 100), (6, 10), {900, 500}), ((1000,), (6, 10), {1000}), ((1000,), (4, 10), set()), ((10,) * 50, (1, 2), {250})])
def test_a_leaf_misses_its_budget_by_half_a_document_at_most(spark, sizes, share, taken):
    rows = spark.createDataFrame([(i, " ".join(["w"] * n), "en", "s1") for i, n in enumerate(sizes)], "doc_id long, text string, lang string, source string")
    for seed in range(4):
        got = mixing.mixed(rows, F.lit("x"), {}, share, 1, seed).select("row.text").collect()
        words = sum(len(r.text.split()) for r in got)
        assert abs(words - sum(sizes) * share[0] // share[1]) <= max(sizes) / 2
        assert words in taken or (sizes == (900, 100) and words in (100, 900, 1000)) or (not words and not taken)


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    library, own = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), queries.tokenizer()
    got = bpe.there_and_back(docs, own)
    carried(got, docs)
    for r in got.select("row.text", "ids", "decoded").collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    back = bpe.decoded(bpe.encoded(docs, own).select("ids"), own)
    assert by(r.decoded for r in back.collect()) == by(r.decoded for r in got.collect())
    assert bpe.there_and_back(none, own).count() == 0
    assert own.decode([-1, 10**6, 0]) == own.decode([0])


def test_bpe_fragments_and_long_words():
    from tokenizers import Tokenizer
    import public_tokenizers

    library, own = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), queries.tokenizer()
    words = ["".join(_random.choice("theanü漢!#Ж") for _ in range(_random.randint(1, 200))) for _ in range(300)]
    cut = 0
    for w in words + ["ab" * 5000, "!" * 999]:
        assert own.encode(w) == library.encode(w, add_special_tokens=False).ids
        parts = own.fragments(w.encode())
        assert b"".join(p for p, _ in parts) == w.encode()
        cut += len(parts) > 1
    assert cut


def test_packing(spark, none):
    rows = [(1, list(range(25))), (None, [7] * 9), (2, []), (3, None), (4, [1]), (4, [1]), (5, [2] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    packed = keep(packing.packed(docs, 100, pad=99, length=10, held_tokens=40), "packed")
    found = by((r.doc_id, r.start, r.ids) for r in packing.unpacked(packed, 100).collect())
    expected = [(1, 0, list(range(10))), (1, 10, list(range(10, 20))), (1, 20, list(range(20, 25))), (None, 0, [7] * 9),
                (4, 0, [1]), (4, 0, [1]), (5, 0, [2] * 10)]
    assert found == by(expected)
    assert packing.packed(docs.limit(0), 100, 99).count() == 0


def test_best_fit_equals_a_plain_search():
    for _ in range(200):
        length = _random.randint(1, 40)
        sizes = [_random.randint(1, length) for _ in range(_random.randint(0, 60))]
        rows, left = packing.best_fit(sizes, length), []
        for size in sorted(sizes, reverse=True):
            fits = [r for r in left if r >= size]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - size)
            else:
                left.append(length - size)
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(left)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))


def test_brown(spark, docs, none):
    rows = brown.scores(docs).collect()
    expected = brute.unigrams(TEXTS)
    key = lambda r: (repr(r[0]), *map(float, r[1:4]), round(r[5], 6))
    assert sorted(map(key, rows)) == sorted(map(key, expected))
    assert all(r.train_tokens == expected[0][4] and math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert brown.scores(none).count() == 0


def test_held_out_texts_leave_training_scores_as_they_were(spark):
    rows = [(i, prose(40, i)) for i in range(60)]
    spoken = " ".join(f"new{k} w1 w2" for k in range(30))
    def trained(texts):
        got = brown.scores(spark.createDataFrame(texts, "doc_id long, text string")).where("not held_out").collect()
        return {r.doc_id: r for r in got}

    before = trained(rows)
    after = trained([(i, f"{spoken} " * 20 if brute.held_out(i) else t) for i, t in rows])
    assert 0 < len(before) < len(rows) and before.keys() == after.keys()
    assert all(math.isclose(before[i].score, after[i].score, rel_tol=1e-12) for i in before)


def test_exchange_finds_planted_classes():
    """Words of two kinds that only follow the other kind."""
    counts = np.zeros((22, 22))
    for i in range(20):
        for j in range(20):
            counts[i, j] = 5 * (i % 2 != j % 2)
    of = brown.exchange(counts, 2, classes=2, sweeps=20)
    assert len({of[i] for i in range(0, 20, 2)}) == 1 and len(set(of)) == 2


def test_words_beyond_those_that_tasks_know_score_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(60, i)) for i in range(80)], "doc_id long, text string")
    whole = {r.doc_id: r for r in brown.scores(docs).collect()}
    monkeypatch.setattr(brown, "FREQUENT", 5)
    few = {r.doc_id: r for r in brown.scores(docs).collect()}
    assert whole.keys() == few.keys()
    for i, r in whole.items():
        assert tuple(r)[1:5] == tuple(few[i])[1:5]
        assert math.isclose(r.base_score, few[i].base_score, rel_tol=1e-12) and math.isclose(r.score, few[i].score, rel_tol=1e-12)


def test_brown_deletes_what_no_later_step_reads(spark):
    docs = spark.createDataFrame([(i, prose(60, i)) for i in range(80)], "doc_id long, text string")
    before = set(os.listdir(shared_dir(spark)))
    got = brown.scores(docs)
    left = set(os.listdir(shared_dir(spark))) - before
    assert [x.split("-")[0] for x in left] == ["scored"] and got.count() == 80


def test_brown_scores_a_large_batch_in_slices():
    """Memory of a task follows the slice, not the batch."""
    texts = [np.arange(i % 5, dtype=np.int32) for i in range(2000)]
    n = np.array([len(t) for t in texts])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(2000)), pa.array([False] * 2000), *(pa.array(n) for _ in range(2)), *(pa.array(n * 0.5) for _ in range(2)),
         pa.array([t.tobytes() for t in texts], pa.binary())], ["doc_id", "held_out", "n_words", "known", "base", "model", "ids"])
    of = np.array([0, 1, 2, 3, brown.END, brown.RARE], np.uint8)
    step = np.full((brown._ALL,) * 3, -1.0)
    done = list(brown._scored(SimpleNamespace(value=(of, step)))(iter([batch])))
    assert max(b.num_rows for b in done) <= 512
    assert np.allclose(np.concatenate([b.column(5).to_numpy() for b in done]), n * 0.5 - (n + 1))


def test_words_that_do_not_start_the_exchange_find_planted_classes(spark):
    """Words of two kinds that only follow the other kind; four of them start the exchange."""
    r = random.Random(4)
    texts = [[2 * r.randrange(30) + k % 2 for k in range(400)] for _ in range(20)]
    rows = spark.createDataFrame([(bytearray(np.array(t, np.int32).tobytes()),) for t in texts], "ids binary")
    near = brown.neighbours(rows, 8000, 60)
    of = np.full(62, brown.RARE, np.uint8)
    of[:4], of[-2] = [0, 1, 0, 1], brown.END
    found, between = brown.exchange_all(near, of, 4)
    kinds = [set(found[k:60:2].tolist()) for k in (0, 1)]
    assert not kinds[0] & kinds[1] and max(kinds[0] | kinds[1]) < brown.CLASSES
    assert between.sum() == sum(len(t) + 1 for t in texts)


@pytest.mark.parametrize("parts", [1, 7])
def test_class_bigrams_equal_a_plain_count(spark, parts):
    """Words of first and later blocks, rare words, an empty text."""
    r = np.random.default_rng(3)
    texts = [r.choice([-1, 0, 1, 63, 64, 4095, 4096, 8191, 8192, 9999], n).astype(np.int32) for n in (0, 1, 500, 3000)]
    rows = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "ids binary")
    near = brown.neighbours(rows, brown._PART_TOKENS * parts, 10_000)
    of = np.concatenate([r.integers(0, brown.CLASSES, 10_000), [brown.END, brown.RARE]]).astype(np.uint8)
    shared = spark.sparkContext.broadcast(of)
    got = near.mapInArrow(brown._class_bigrams(shared), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()
    expected = Counter()
    for t in texts:
        g = [brown.END, *of[t].tolist(), brown.END]
        expected.update(a * brown._ALL + b for a, b in zip(g, g[1:]))
    assert {c: n for c, n in got} == expected


def test_transitions_are_probabilities():
    counts = np.array([[_random.randint(0, 3) for _ in range(27)]]).reshape(3, 3, 3)
    counts[1] = 0
    p = brown.transitions(counts)
    assert np.allclose(p.sum(axis=-1), 1) and (p > 0).all()


def test_kneser_ney(spark, docs, none):
    trusted = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 10, 11, 99)] + [(12, 1, 1), (13, 0, 0), (None, 1, 0), (14, None, None)],
                                    "doc_id long, quality int, toxic int")
    trusted = kneser_ney.trusted_ids(trusted)
    got = kneser_ney.perplexities(docs, trusted, carry=docs.columns)
    carried(got, docs)
    for r in got.select("row.text", "n_tokens", "perplexity", "log10_prob").collect():
        assert r.n_tokens == len(brute.words(r.text)) + 1 and r.log10_prob < 0 and math.isfinite(r.perplexity)
    judged = kneser_ney.judged(keep(got, "scored"), trusted).collect()
    assert len(judged) == len(TEXTS) and all(r.kept is not None for r in judged)
    empty = kneser_ney.perplexities(none, trusted)
    assert kneser_ney.judged(keep(empty, "scored"), trusted).count() == 0
    untrained = kneser_ney.judged(keep(kneser_ney.perplexities(docs, trusted.limit(0)), "scored"), trusted.limit(0))
    assert untrained.where("kept").count() == len(TEXTS)


def test_kneser_ney_weights_are_probabilities(spark):
    """By hand: P(w) of all words, and P(w | v) of those seen after v with the rest."""
    rows = spark.createDataFrame([("a b a c a b",), ("b a b",), ("c a",)], "text string")
    table, unknown, begin = kneser_ney.weights(rows.select(F.col("text").cast("binary").alias("text")))
    assert table.where("order = 1").count() == 4  # a, b, c and the end
    assert unknown < 0 and begin <= 0
    texts = spark.createDataFrame([(t,) for t in ("", "a", "b", "c", "zz")], "text string").withColumn("doc_id", F.lit(None).cast("long"))
    trained = spark.createDataFrame([(1, "a b a c a b"), (2, "b a b"), (3, "c a")], "doc_id long, text string")
    both = trained.union(texts.select("doc_id", "text"))
    got = kneser_ney.perplexities(both, trained.select("doc_id"), carry=["doc_id", "text"])
    p = {r.text: 10 ** r.log10_prob for r in got.where("row.doc_id is null").select("row.text", "log10_prob").collect()}
    assert 0 < sum(p.values()) < 1  # five of all possible texts
    assert p["zz"] < min(p["a"], p["b"], p["c"])


def test_long_texts_and_large_languages_leave_room_in_the_sample(spark, monkeypatch):
    def texts(rows):
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
        return sorted(bytes(r.text).decode() for r in kneser_ney.sample(docs, docs.select("doc_id"), "text", "doc_id").collect())

    ids = [r.id for r in spark.range(200).where(~kneser_ney._apart(F.col("id"))).collect()]
    long, short = [(i, "en", prose(300, i)) for i in ids[:20]], [(i, "en", prose(5, i)) for i in ids[20:40]]
    monkeypatch.setattr(kneser_ney, "TRAIN_TOKENS", 200)
    assert texts(long + short) == sorted(t for *_, t in short)
    assert texts(long[:1]) == [long[0][2]]
    monkeypatch.setattr(kneser_ney, "TRAIN_DOCS", 20)
    few = [(i, "de", f"wort {i}") for i in ids[40:43]]
    got = texts([(i, "en", f"word {i}") for i in ids[43:]] + few)
    assert len(got) == 20 and {t for *_, t in few} <= set(got)


def test_the_model_learns_from_every_trusted_text_not_set_apart(spark):
    ids = [r.id for r in spark.range(4000).where(~kneser_ney._apart(F.col("id"))).collect()]
    docs = spark.createDataFrame([(i, "en", f"{i} {LONG if k == 0 else ''}") for k, i in enumerate(ids)], "doc_id long, lang string, text string")
    learnt = kneser_ney.sample(docs, docs.select("doc_id"), "text", "doc_id").collect()
    assert len(ids) > 1500 and sorted(int(r.text.split()[0]) for r in learnt) == ids


def test_ngrams_beyond_those_that_tasks_know_weigh_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(60, i % 40)) for i in range(60)], "doc_id long, text string")
    def scored():
        return {r.doc_id: r.log10_prob for r in kneser_ney.perplexities(docs, docs.select("doc_id")).select("row.doc_id", "log10_prob").collect()}

    whole = scored()
    monkeypatch.setattr(kneser_ney, "SHARED", 30)
    few = scored()
    assert whole.keys() == few.keys() and all(math.isclose(whole[i], few[i], rel_tol=1e-9) for i in whole)


def test_kneser_ney_slices_change_no_result_and_are_deleted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(60, i % 40) if i % 7 else "") for i in range(60)], "doc_id long, text string")
    def scored(slices):
        for name in ("SLICES", "PORTIONS", "SHARES"):
            monkeypatch.setattr(kneser_ney, name, slices)
        before = set(os.listdir(shared_dir(spark)))
        got = kneser_ney.perplexities(docs, docs.select("doc_id"))
        left = {x.split("-")[0] for x in set(os.listdir(shared_dir(spark))) - before}
        assert not left & {"sample", "counts", "contexts", "scores", "sums"}
        return {r.doc_id: r.log10_prob for r in got.select("row.doc_id", "log10_prob").collect()}

    monkeypatch.setattr(kneser_ney, "SHARED", 30)
    whole, sliced = scored(1), scored(3)
    assert whole.keys() == sliced.keys() and all(math.isclose(whole[i], sliced[i], rel_tol=1e-9) for i in whole)


def test_kneser_ney_keeps_no_counts_beside_weights(spark, monkeypatch):
    """While the model is made, what is written stays small; groups and heavy words change no result."""
    docs = spark.createDataFrame([(i, prose(300, i)) for i in range(200)], "doc_id long, text string")
    most = []

    def size(df, label, before=kneser_ney.keep):
        out, top = before(df, label), shared_dir(spark).removeprefix("file://")
        most.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names))
        return out

    def scored():
        return {r.doc_id: r.log10_prob for r in kneser_ney.perplexities(docs, docs.select("doc_id")).select("row.doc_id", "log10_prob").collect()}

    for name, value in (("SLICES", 1), ("PORTIONS", 1), ("SHARES", 1)):
        monkeypatch.setattr(kneser_ney, name, value)
    whole = scored()
    start = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared_dir(spark).removeprefix("file://")) for f in names)
    monkeypatch.setattr(kneser_ney, "keep", size)
    monkeypatch.setattr(kneser_ney, "HEAVY", 20, raising=False)
    monkeypatch.setattr(kneser_ney, "GROUP_BYTES", 20_000, raising=False)
    many = scored()
    assert whole.keys() == many.keys() and all(math.isclose(whole[i], many[i], rel_tol=1e-9) for i in whole)
    assert max(most) - start < 30 * 200 * 300  # bytes per word


def test_thresholds_are_quantiles_of_texts_set_apart(spark):
    """A language of few texts is judged by all of them, one of many by its own."""
    ids = [r.id for r in spark.range(8000).where(kneser_ney._apart(F.col("id"))).collect()]
    rows = [((i, "en" if k % 10 else "de"), 10 * 1.003 ** k) for k, i in enumerate(ids)]
    scored = spark.createDataFrame(rows, "row struct<doc_id: long, lang: string>, perplexity double")
    trusted = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = kneser_ney.judged(keep(scored, "scored"), trusted).collect()
    by_lang = {r.row.lang: r.threshold for r in got}
    for lang, wanted in (("de", [p for _, p in rows]), ("en", [p for (_, x), p in rows if x == "en"])):
        assert math.isclose(by_lang[lang], np.quantile(wanted, kneser_ney.QUANTILE), rel_tol=0.003)
    assert 0 < sum(not r.kept for r in got) <= 0.002 * len(got)


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (1, None, "system", None),
        (None, 0, None, "x"), (None, 1, "assistant", ""), (2, 5, "tool", "</s>\\"),
    ]
    frame = spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, part string, spans string")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(frame)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (4, 4), None: (2, 0), 2: (1, 0)}
    assert got[1].turns_sha256 == brute.sha("system\n\nuser\nhi\nassistant\nyo\nassistant\nyo\n")
    assert got[2].turns_sha256 == brute.sha("tool\n</s>\\\n")
    assert chat.digests(chat.formatted(frame.limit(0))).count() == 0


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 7)
    rows = spark.range(0, 5000, 1, 8).select(
        F.lit(3).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    parts = keep(chat.formatted(rows), "parts")
    assert parts.count() > 5000 // 7
    (got,) = chat.digests(parts).collect()
    turns = "".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(5000))
    assert (got.n_turns, got.turns_sha256) == (5000, brute.sha(turns))
    assert got.loss_sha256 == brute.sha("".join(f"t{i}" for i in range(1, 5000, 2)))


def test_top_k(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randint(-3, 3)) / 256 for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [0.01, 0.01, 0.01, 0.01]) for i in range(80)]  # ties
    rows += [(500, None), (501, [1.0, None, 1.0, 1.0]), (502, [1.0, float("nan"), 1.0, 1.0]), (503, [float("inf"), 1.0, 1.0, 1.0]),
             (None, [9.0, 9.0, 9.0, 9.0]), (504, [5.0]), (550, [6.0]), (7, [0.5, 0.5, 0.5, 0.5]), (50, [0.3, 0.3, 0.3, -0.3]), (100, rows[100][1])]
    frame = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<double>, rank string")
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for k, (q, own) in enumerate(usable):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for n, (i, v) in enumerate(usable) if n != k and len(v) == len(own))
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    whole = balltree.whole_vectors(frame, "vec_id", "embedding")
    got = balltree.top_k(whole, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert balltree.top_k(balltree.whole_vectors(frame.limit(0), "vec_id", "embedding"), F.lit(True)).count() == 0


def test_top_k_of_repeated_ids_and_huge_numbers(spark):
    rows = [(1, [1.0, 1.0]), (1, [5.0, 5.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (2, [1e300, -1e300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, balltree.top_k(balltree.whole_vectors(frame, "vec_id", "embedding"), F.col("vec_id") == 50).collect()))
    top = (1 << 63) - 1
    each = [(50, 1, 2, top), (50, 2, 1, 1280 * 256), (50, 3, 1, 256 * 256), (50, 4, 50, 256 * 256)]
    assert got == sorted(each * 2)


def test_trees_prune_and_stay_exact(monkeypatch):
    r = np.random.default_rng(2)
    vectors = np.floor(r.normal(size=(1000, 6)) * 50)
    tree = balltree.build(np.arange(1000), vectors, leaf=16)
    queries_ = vectors[:40]
    found, scores, hit = balltree.search(tree, np.arange(40), queries_, 5, np.full(40, -np.inf))
    products = queries_ @ vectors.T
    products[np.arange(40), np.arange(40)] = -np.inf
    best = np.lexsort((np.broadcast_to(np.arange(1000), products.shape), -products), axis=1)[:, :5]
    assert (found == best).all() and hit.all()
    huge = np.floor(vectors[:50] * 2.0**40)
    found, scores, _ = balltree.search(balltree.build(np.arange(50), huge, 8), np.arange(50), huge, 3, np.full(50, -np.inf))
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in huge] for x in huge]
    for q in range(50):
        order = sorted((i for i in range(50) if i != q), key=lambda i: (-exact[q][i], i))[:3]
        assert found[q].tolist() == order and [int(s) for s in scores[q]] == [exact[q][i] for i in order]


def test_pipeline_stages(spark, docs, none, tmp_path):
    """Every stage takes such tables and hands on the columns it got."""
    for df in (docs, none):
        now = df
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = keep(stage(spark, now, ""), "stage")
            if k < 4:
                assert now.columns == docs.columns
        assert now.columns[:len(docs.columns)] == docs.columns and len(now.columns) == len(docs.columns) + 1


def test_one_of_each_group_stays(spark, docs):
    stayed = corpus_pipeline.near_copies(spark, docs, "").select("doc_id", "text").collect()
    rows = brute.components(TEXTS)
    groups = {(c, f if c is None else None) for _, f, c in rows}
    assert len(stayed) == len(groups)
    assert {r.doc_id for r in stayed if r.doc_id is not None} == {c for c, _ in groups if c is not None}
