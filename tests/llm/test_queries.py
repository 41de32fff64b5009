"""The registered queries on whole tables, against brute force or held-out accuracy."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from stayline.llm import chat, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return sorted(rows, key=lambda r: r.doc_id)


def result(spark, name):
    return sorted(queries.QUERIES[name](spark, SF).collect())


def domain(source):
    number = re.search("([0-9]{1,9})$", source or "")
    return f"group{int(number[1]) % 4}" if number else "other"


def test_mixing(spark, docs):
    rows = [(d.doc_id, d.text, d.lang, d.source) for d in docs]
    taken = brute.copies(rows, queries.WEIGHTS, domain, queries.SHARE, queries.EPOCHS, queries.SEED)
    expected = {r[0]: n for r, n in zip(rows, taken) if n}
    got = result(spark, "op1_mixing")
    assert {r.doc_id: r.copies for r in got} == expected
    assert len(got) == len(expected)


def test_simhash(spark, docs):
    got = [tuple(r) for r in result(spark, "op2_simhash")]
    assert got == sorted(brute.components([(d.doc_id, d.text) for d in docs]))


def test_brown(spark, docs):
    got = result(spark, "op3_brown")
    expected = sorted(brute.unigrams([(d.doc_id, d.text) for d in docs]))
    assert [tuple(r)[:5] for r in got] == [e[:5] for e in expected]
    assert np.allclose([r.base_score for r in got], [e[5] for e in expected])
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_chat(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-1] = [("user", said), ("assistant", said)]
    for r in result(spark, "op5_chat"):
        own = turns.pop(r.conv_id)
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.turns_sha256 == brute.sha("".join(f"{role}\n{t}\n" for role, t in own))
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(loss), brute.sha(loss))
        assert r.formatted_chars >= sum(len(x) for turn in own for x in turn)
    assert not turns


def test_substrings(spark, docs):
    expected = brute.without_repeats([(d.doc_id, d.text) for d in docs])
    got = [tuple(r) for r in result(spark, "op6_substring_dedup")]
    assert got == sorted((i, n, m, brute.sha(kept)) for i, n, m, kept in expected)
    assert any(m for _, _, m, _ in expected)


def test_quality_rules(spark, docs):
    got = result(spark, "op7_quality_rules")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r, d in zip(got, docs):
        n_words, chars, symbols, lines, repeated = brute.counts(d.text)
        assert tuple(r)[:6] == (d.doc_id, n_words, chars, symbols, lines, repeated)
        assert r.base_failed == (n_words < 10 or 100 * repeated > 20 * n_words)
        if r.base_failed:
            assert not r.kept
        elif labels.get(r.doc_id) == 1:
            assert r.kept


def test_kneser_ney_tells_trusted_text_from_junk(spark):
    folder = SF.replace("0.001", "0.01")
    got = queries.QUERIES["op8_kneser_ney"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").groupBy("quality").agg({"kept": "count"}).collect()
    kept = got.where("kept").join(labels, "doc_id").groupBy("quality").count().collect()
    total, kept = ({r.quality: r[1] for r in x} for x in (rows, kept))
    assert kept[1] >= 0.99 * total[1]
    assert kept.get(0, 0) <= 0.7 * total[0]
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_kneser_ney_leaves_little_junk(spark):
    folder = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 0").select("doc_id")
    junk = queries.QUERIES["op8_kneser_ney"](spark, folder).join(labels, "doc_id").select("kept").collect()
    assert sum(r.kept for r in junk) <= 0.2 * len(junk)


def test_packing_is_lossless(spark, docs):
    own, pieces, used = queries.tokenizer(), defaultdict(list), 0
    rows = result(spark, "op9_packing")
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 2048 and r.cu_seqlens[0] == 0 and r.position_resets == r.cu_seqlens[:-1]
        assert all(ids[r.cu_seqlens[-1]:] == len(own.tokens) - 1)
        used += r.cu_seqlens[-1]
        for doc, start, x, y in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces[doc].append((start, ids[x:y].tolist()))
    for d in docs:
        assert [i for _, part in sorted(pieces[d.doc_id]) for i in part] == own.encode(d.text or "")
    assert used > 0.95 * 2048 * len(rows)


def test_bpe(spark, docs):
    own = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    expected = []
    for d in docs:
        ids = own.encode(d.text or "", add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        expected.append((d.doc_id, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text)))
    assert [tuple(r) for r in result(spark, "op10_bpe")] == expected


def test_pipeline(spark, docs):
    """Each stage against brute force on what the one before it kept."""
    now = spark.read.parquet(f"{SF}/documents.parquet")
    like = now.columns
    stages, rows = dict(corpus_pipeline.STAGES), docs
    folder = corpus_pipeline.keep

    def step(name):
        out = folder(stages[name](spark, now, SF), "step")
        return out, sorted(out.collect(), key=lambda r: r.doc_id)

    now, after = step("quality rules")
    verdicts = {r.doc_id: r.kept for r in result(spark, "op7_quality_rules")}
    assert after == [d for d in rows if verdicts[d.doc_id]]
    rows = after
    now, after = step("near duplicates")
    assert after == [r for r, (i, _, c) in zip(rows, brute.components([(r.doc_id, r.text) for r in rows])) if i == c]
    rows = after
    now, after = step("repeated passages")
    for r, a, (_, _, gone, kept) in zip(rows, after, brute.without_repeats([(r.doc_id, r.text) for r in rows])):
        assert a.text == (kept if gone else r.text) and a.source == r.source
    assert len(after) == len(rows)
    rows = after
    now, after = step("mix")
    given = [(r.doc_id, r.text, r.lang, r.source) for r in rows]
    taken = brute.copies(given, queries.WEIGHTS, domain, queries.SHARE, queries.EPOCHS, queries.SEED)
    assert after == [r for r, n in zip(rows, taken) for _ in range(n)]
    assert now.columns == like
    rows = after
    now, after = step("token ids")
    own = queries.tokenizer()
    assert [(a.doc_id, a.ids) for a in after] == [(r.doc_id, own.encode(r.text)) for r in rows]


def test_template_language():
    render = chat.compiled("{% for m in messages %}{% if m.role == 'a' or not m.text %}<{{ m.text | upper }}>{% elif m.role in 'xyz' %}"
                           "{% set t = m.text + '!' %}{% generation %}{{ t }}{% endgeneration %}{% else %}-{% endif %}{% endfor %}")
    text, spans = render([{"role": "a", "text": "q"}, {"role": "x", "text": "r"}, {"role": "b", "text": "s"}])
    assert (text, spans) == ("<Q>r!-", [(3, 5)])
    folded = chat.fold(chat._Template("{% if 1 == 1 %}a{{ 'b' + 'c' }}{% else %}z{% endif %}{{ x }}").body()[0])
    assert folded == (chat.Write(chat.Constant("abc")), chat.Write(chat.Name("x")))
    for bad in ("{{ x() }}", "{{ x.__class__() }}", "{% import os %}", "{% for x in y %}", "{{ x | nothing }}", "{{ (x }}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)
    assert chat.compiled("{{ messages.__class__ }}")([])[0] == ""


def test_digest_of_turns_is_read_back():
    render = chat.compiled(chat.TEMPLATE)
    hostile = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "/s>", "[", "{{", "\n", "é", ""]
    messages = [{"role": a + b, "text": b + a + a} for a in hostile for b in hostile]
    text, spans = render(messages + [{"role": "assistant", "text": "".join(hostile)}])
    assert chat.parse(text)[:-1] == [(m["role"], m["text"]) for m in messages]
    assert [chat.unescape(text[x:y]) for x, y in spans] == ["".join(hostile)]
    assert hashlib.sha256(text.encode()).hexdigest()
