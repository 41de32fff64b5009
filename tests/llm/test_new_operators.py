"""Licence scans, reversed search and whitening against plain versions, on whole tables and edge rows."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import licenses, queries, reversed_search, whitening
from test_llm_edges import NAMES, TEXTS, by, carried

SF = "/root/testdata/sf0.001"


# Licences


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if tuple(words[i:i + len(phrase)]) == tuple(phrase)]


def scanned(texts, templates):
    """(n_words, n_base, first, last, base labels, labels, score) per text, phrase by phrase."""
    every = licenses.with_phrases(templates, licenses.PHRASES)
    known = {w for t in every for w in t.words}
    files = [terms(t) for t in texts]
    df = Counter(w for f in files for w in set(f) & known)
    weight = {w: 1 + max(0, math.floor(1000 * math.log((2 * len(files) + 2) / (2 * df[w] + 1)))) for w in df}
    out = []
    for f in files:
        base = sorted(p for phrase in licenses.PHRASES for p in places(f, phrase.split()))
        base_labels = {label for phrase, label in licenses.PHRASES.items() if places(f, phrase.split())}
        labels, score = set(base_labels), 0.0
        for t in every:
            shifts = [[p - q for p in places(f, phrase)] for q, phrase in t.phrases]
            for at in shifts[0]:
                best = [at] + [min(((abs(s - at), s) for s in own), default=(licenses.SLACK + 1, 0)) for own in shifts[1:]]
                if all(b[0] <= licenses.SLACK for b in best[1:]):
                    moved = [at] + [b[1] for b in best[1:]]
                    met = sum(weight[w] for q, w in enumerate(t.words)
                              if 0 <= (p := q + moved[t.phrase_at(q)]) < len(f) and f[p] == w)
                    labels.add(t.label)
                    score = max(score, met / sum(weight.get(w, 0) for w in t.words))
        out.append((len(f), len(base), base[0] if base else None, base[-1] if base else None,
                    ",".join(sorted(base_labels)), ",".join(sorted(labels)), score))
    return out


MIT = licenses.TEMPLATES[0].text
LICENSED = [
    MIT, f"Copyright (c) 2020 A. Person\n\n{MIT.upper()}\n\nTHE END", MIT.replace("sublicense", "give away, lend, rent"),
    MIT.replace("substantial portions", "parts"), MIT.replace("free of charge", "for a fee"),
    MIT.replace("subject to the following conditions", " ".join(["x"] * 60)), f"{MIT} {MIT}",
    "CC BY", "cc by cc by-CC/BY", "cc  by nc 4.0", "all rights reserved" * 3, "All rights reserved. " * 900,
    "general public license, version 3", "GNU General\nPublic  License, Version 3 or GNU general public license version 2",
    "license public general", "rights reserved all", "under the MIT", "under the mit license", "Permission is hereby granted free of charge",
    " ".join(licenses.TEMPLATES[k].text for k in (9, 10)), "  ", ".", "..cc by..", "ccby", "ça cc byé", "all rights", None, None, "",
    " ".join(["the of to in software license copyright notice"] * 5000),
]


def digest(df):
    return df.select("n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("b"),
                     F.array_join("labels", ",").alias("l"), F.round("score", 9).alias("s"))


def rounded(rows):
    return by((*r[:6], round(r[6], 9)) for r in rows)


@pytest.fixture(scope="module")
def licensed(spark):
    texts = LICENSED + [t for _, t in TEXTS]
    rows = [(k % 7 or None, t, *[f"{n}{k}" for n in [*NAMES, "hits", "labels", "pos"]]) for k, t in enumerate(texts)]
    extra = ", ".join(f"`{n}` string" for n in [*NAMES, "hits", "labels", "pos"])
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


def test_licences_equal_a_plain_scan(licensed):
    done = licenses.scan(licensed)
    carried(done, licensed)
    assert by(map(tuple, digest(done).collect())) == rounded(scanned(LICENSED + [t for _, t in TEXTS], licenses.TEMPLATES))
    assert licenses.scan(licensed.limit(0)).count() == 0


def test_licences_find_every_match(spark):
    rows = spark.createDataFrame([(1, f"{MIT} and {MIT}"), (2, MIT.replace("free of charge", "gratis"))], "doc_id int, text string")
    got = {r.row.doc_id: r for r in licenses.scan(rows).collect()}
    width = len(licenses.TEMPLATES[0].words)
    assert [(f.start, f.label, f.score) for f in got[1].found] == [(0, "mit", 1.0), (width + 1, "mit", 1.0)]
    assert got[2].found == [] and got[2].labels == [] and got[2].score == 0


def test_own_templates(spark):
    own = [licenses.Template("öl", "das öl ist frei für alle", ("öl ist", "für alle"))]
    texts = ["Das öl ist frei für alle", "öl ist sehr frei für alle", "öl ist", "für alle " + "x " * 40 + "öl ist", "öl ist " * 50 + "für alle"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = licenses.scan(rows, own, {"für alle": "all"})
    assert [(r.row.doc_id, r.labels) for r in sorted(got.collect(), key=lambda r: r.row.doc_id)] == [
        (0, ["all", "öl"]), (1, ["all", "öl"]), (2, []), (3, ["all"]), (4, ["all", "öl"])]
    with pytest.raises(ValueError):
        licenses.Template("x", "a b c", ("c", "a")).phrases
    with pytest.raises(ValueError):
        licenses.Template("x", "a b c", ("d",)).phrases


def test_licences_of_documents(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = sorted(queries.QUERIES["op11_licenses"](spark, SF).collect())
    assert [r.doc_id for r in got] == [d.doc_id for d in docs]
    assert [(*tuple(r)[1:7], round(r.score, 9)) for r in got] == [
        (*r[:6], round(r[6], 9)) for r in scanned([d.text for d in docs], licenses.TEMPLATES)]


def test_licence_scan_runs_no_python(spark):
    plan = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


# Search


def best(docs, items, k=10):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in held if c)
    length = sum(c.total() for _, c in held)
    out = []
    for item, text in items:
        weights = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                   for w in set(terms(text)) if (df := sum(1 for _, c in held if w in c))}
        found = []
        for i, c in held:
            m = 10 + 90 * c.total() * n // max(length, 1)
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items())
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[:2], f[2] or "" if isinstance(f[2], (str, type(None))) else f[2]))[:k])]
    return by(out)


ITEMS = [(1, "one two"), (1, "W1 w2 W3 W3"), (2, None), (3, "."), (None, "passage changed café"), (4, "nowhere to be found zzz"),
         (5, " ".join(f"w{i}" for i in range(400))), (6, "İstanbul ΣΣ"), (7, "x1y1 x2y2 line")]


@pytest.mark.parametrize("block", [reversed_search.BLOCK, 5])
def test_search_equals_scoring_everything(spark, block):
    docs = TEXTS * 2
    given = spark.createDataFrame([(*d, "z", "z") for d in docs], "doc_id long, text string, score string, item string").repartition(5)
    items = spark.createDataFrame([(*i, "z") for i in ITEMS], "item_id long, text string, rank string")
    got = reversed_search.top_documents(given, items, k=4, block=block)
    assert by(map(tuple, got.collect())) == best(docs, ITEMS, 4)


def test_search_with_names_as_ids(spark):
    docs = [(None if i is None else f"d{i}", t) for i, t in TEXTS]
    given = spark.createDataFrame(docs, "doc_id string, text string").repartition(4)
    items = spark.createDataFrame([(f"i{i}", t) for i, t in ITEMS], "item_id string, text string")
    got = reversed_search.top_documents(given, items, k=5)
    assert by(map(tuple, got.collect())) == best(docs, [(f"i{i}", t) for i, t in ITEMS], 5)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)),
                 (docs.where("text is null"), items), (docs, items.where("item_id = 2"))):
        assert reversed_search.top_documents(d, i).collect() == []


def test_search_of_benchmark(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert by(map(tuple, queries.QUERIES["op12_reversed_search"](spark, SF).collect())) == best(docs, items)


# Whitening


def plain(vectors, count=32):
    """Exact deviations, eigenvalues, components and whitened values."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    moved = [[n * c - s for c, s in zip(r, sums)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in moved), n**3)) for j in range(len(sums))] for i in range(len(sums))])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    return [sum(c * c for c in r) for r in moved], values, (np.array(moved, float) / n) @ axes / np.sqrt(values), np.trace(cov)


def test_whitening_of_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    deviation, values, white, trace = plain([r.embedding for r in good])
    got = queries.QUERIES["op13_whitening"](spark, SF).collect()
    assert len(got) == len(good) * len(values)
    place = {r.vec_id: k for k, r in enumerate(good)}
    table = np.zeros_like(white)
    for r in got:
        table[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(good) and r.deviation == deviation[place[r.vec_id]]
        assert math.isclose(r.explained, values[r.component - 1] / trace, rel_tol=1e-9)
        assert r.identity_error < 1e-9
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table * signs - white).max() < 1e-8


def test_whitening_edges(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(c) for c in r.normal(size=4)]) for i in range(40)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (90, None), (91, [1.0, None, 1.0, 1.0]), (92, [1.0, float("nan"), 1.0, 1.0]),
             (93, [float("inf")] * 4), (94, [1.0, 2.0]), (95, []), (96, [1e300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*x, "z", "z") for x in rows], "vec_id long, v array<double>, x string, whitened string").repartition(6)
    done, fitted = whitening.whiten(frame, "v")
    used = [x for x in rows[:42]]
    deviation, values, white, _ = plain([v for _, v in used])
    assert by((a.row.vec_id, a.row.x, a.deviation) for a in done.collect()) == by((i, "z", d) for (i, _), d in zip(used, deviation))
    assert np.allclose(fitted.values, values, rtol=1e-12)
    assert whitening.by_component(done, fitted).count() == 42 * 4
    for few in (frame.limit(0), frame.where("vec_id = 95"), frame.where("vec_id = 1"), frame.where("vec_id = 7")):
        done, fitted = whitening.whiten(few, "v")
        assert fitted is None and whitening.by_component(done, fitted).collect() == []


def test_large_numbers_stay_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) * 2.0**31, float(c) * 2.0**31 + (i % 3), 1.0]) for i, c in enumerate(r.normal(size=300))]
    done, fitted = whitening.whiten(spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3), "v")
    _, values, _, _ = plain([v for _, v in rows], 2)
    deviation = plain([v for _, v in rows], 1)[0]
    assert len(fitted.values) == 1 or fitted.values[1] < 1e-12 * fitted.values[0]
    assert math.isclose(fitted.values[0], values[0], rel_tol=1e-12)
    assert {a.deviation for a in done.collect()} <= {None, *deviation}


def test_products_are_exact():
    r = np.random.default_rng(4)
    for bits in (5, 20, 30, 41):
        z = r.integers(-(1 << bits), 1 << bits, size=(700, 5))
        assert (whitening.gram(z) == z.astype(object).T @ z.astype(object)).all()


def _turned(values, seed=0):
    axes = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    axes = whitening._orthonormal(axes.astype(np.longdouble))
    m = (axes * np.asarray(values, np.longdouble)) @ axes.T
    return (m + m.T) / 2, axes.astype(float)


@pytest.mark.parametrize("values", [
    np.linspace(1, 100, 48)[::-1], np.r_[50 + 1e-7 * np.arange(20)[::-1], 20 + 1e-11 * np.arange(12)[::-1], np.linspace(9, 1, 8)],
    2.0 ** -np.arange(40), [3.0, 3.0, 3.0, 2.0, 2.0, 0.0], [1.0], [0.0, 0.0]])
def test_refined_vectors_are_right_to_double_precision(values):
    m, axes = _turned(values)
    found, x = whitening.refined(m)
    top = max(max(values), 1e-300)
    assert np.abs(found - values).max() <= 1e-15 * top
    assert np.abs((m @ x - x * found).astype(float)).max() <= 2e-16 * top
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 1e-14
    if len(set(values)) == len(values):
        assert np.abs(np.abs((axes * x).sum(axis=0)) - 1).max() < 1e-13


def test_clusters_that_plain_doubles_mix():
    """Eigenvalues 1e-11 apart at 20: a double eigensolver turns their vectors, this does not."""
    values = np.r_[100.0, 20 + 1e-11 * np.arange(10)[::-1], 1.0]
    m, axes = _turned(values, 3)
    plainly = np.linalg.eigh(m.astype(float))[1][:, ::-1]
    error = lambda x: np.abs(1 - np.abs((axes * x).sum(axis=0))).max()
    assert error(whitening.refined(m)[1]) < 1e-12 < error(plainly)
