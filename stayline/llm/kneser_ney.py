"""A quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

The model learns from trusted text: labelled documents of good quality and without
toxicity, of which half, by a hash of the id, is set apart. It learns from every document of
the other half. Two parameters may bound it, ``TRAIN_DOCS`` documents, spread over the
languages, and ``TRAIN_TOKENS`` tokens of them (a text that does not fit is passed over); by
default neither does. Every document is scored, and the thresholds come from all trusted
documents of the half that was set apart, so not from texts the model has learnt.

With interpolated probabilities the log probability of a text is a sum of one weight per
unigram, bigram and trigram that the model knows. Texts look n-grams up in the weights of the
most frequent ones, about ``SHARED``, which every task has; all others stay dealt out, and a
text meets them only where a bitmap of fixed size says it may have one. Neither changes a
result.

N-grams travel as packed arrays and are counted in groups. All that is counted of a trigram
hangs on n-grams with its middle word, so a group has all trigrams of its middle words; those
of a word of more than ``HEAVY`` uses are dealt by middle and last word, over many groups.
What a group knows a part of only (words before a word, contexts that end in a heavy word) is
exchanged by key: summed, and handed back to the groups that asked. A first pass counts, a
second one counts again and turns counts into weights, so counts are never written. Each pass
goes over ``SLICES`` of the groups, one after the other, and texts are scored in ``PORTIONS``,
each of which meets one of ``SHARES`` of the model at a time; what one of these wrote is
deleted once nothing reads it. These bound the disk that is used at a time and change no
result.

Defined results: a null text is empty and has one token, its end; a language of
fewer than ``LEAST_TEXTS`` trusted documents set apart is judged by those of all languages,
and with no trusted document at all
every text is kept; a null language is a language of its own. Rows are scored one by one,
so repeated rows and ids do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from stayline.llm.common import add_bucketed, as_row, drop, keep, parts_for, small_batches, text_bytes

#: None: all trusted documents that are not set apart.
TRAIN_DOCS, TRAIN_TOKENS = None, None
#: N-grams whose weights tasks know by themselves.
SHARED = 1 << 20
#: Bytes of text per group, and uses of a word from which its trigrams go to many groups.
GROUP_BYTES, HEAVY = 3 << 20, 1 << 18
#: Slices of the groups in which n-grams are weighed, portions in which texts are scored, and
#: shares of the model's buckets that a portion meets, each one after the other.
SLICES, PORTIONS, SHARES = 4, 8, 2
#: A text is rejected above this quantile of its language's trusted texts, or of all trusted
#: texts where the language has too few to have such a quantile.
QUANTILE, LEAST_TEXTS = 0.999, 1000
UNIT = 1024
_SEED, _BEGIN, _END = 7, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_M1, _M2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Of the bitmap's size, of the chunks that it is put together from, and classes of counts.
_BITS, _CHUNK, _CLASSES = 28, 22, 1024
#: What is exchanged, by the key: of a word, the different words before it and its uses; of a
#: heavy word and of a context that ends in one, what follows; and contexts that are whole.
_STATS, _LAST, _FIRST, _CONTEXT, _WHOLE = range(5)
_WIDTH = {_LAST: 2, _FIRST: 5, _CONTEXT: 5, _WHOLE: 5}
_ROWS = "g int, kind int, a binary, b binary, c binary, n binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads neighbouring values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(32))


def _joined_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of an n-gram from the keys of its first part and its last word."""
    return _mixed(left * np.uint64(_M2) + (right ^ np.uint64(_SEED)))


def _word_keys(text: bytes | None) -> np.ndarray:
    """Keys of begin mark, words and end mark."""
    words = (text or b"").split()
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(_SEED)), np.uint64, len(words))
    return np.concatenate([np.array([_BEGIN], np.uint64), keys, np.array([_END], np.uint64)])


def _records(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return _records(rows, ["g", "kind", "a", "b", "c", "n"], [pa.int32()] * 2 + [pa.binary()] * 4)


def _unpacked(chunks: list[bytes], kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(chunks), kind)


def _split(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(destination, its rows of each column)."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
    for a, z in zip(starts, [*starts[1:], len(to)]):
        yield int(to[a]), *(c[a:z] for c in columns)


def _found(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among sorted known ones, and where."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def _group(first: np.ndarray, pair: np.ndarray, heavy: np.ndarray, bits: int) -> np.ndarray:
    """The group of a bigram, and of the trigrams that end with it."""
    return (np.where(_found(first, heavy)[0], pair, first) >> np.uint64(64 - bits)).astype(np.int32)


def _home(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32)


def _flat(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of texts one after the other, and how many each has."""
    keys = [_word_keys(t) for t in texts]
    return np.concatenate(keys), np.array([len(k) for k in keys])


def _dealt(part: int, slices: int, heavy: np.ndarray, bits: int):
    """Trigrams of one slice of the groups, packed by group: their words, and how often a
    batch has them. A bigram that begins a text is one whose first word is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, sizes = _flat(batch.column(0).to_pylist())
            ends = np.cumsum(sizes)
            pair = _joined_key(one[:-1], one[1:])
            # Place i has the bigram from i on; its trigram begins a word before.
            group = _group(one[:-1], pair, heavy, bits)
            mine = group % slices == part
            mine[ends[:-1] - 1] = False  # from one text to the next
            mine = np.flatnonzero(mine)
            begins = one[mine] == np.uint64(_BEGIN)
            before = np.maximum(mine - 1, 0)
            key = np.where(begins, pair[mine], _joined_key(pair[before], one[mine + 1]))
            _, at, c = np.unique(key, return_index=True, return_counts=True)
            mine, u = mine[at], np.where(begins, np.uint64(0), one[before])[at]
            yield _packed([
                (g, _STATS, *(x.tobytes() for x in columns))
                for g, *columns in _split(group[mine], u, one[mine], one[mine + 1], c.astype(np.int32))])

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic")
    ).where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def _apart(doc_id: Column) -> Column:
    """Trusted documents that set thresholds; the model may learn from the others."""
    return F.pmod(F.xxhash64(doc_id, F.lit(1)), F.lit(2)) == 1


def _within(sizes: list, tokens: int) -> list:
    """Ids of ``(id, tokens)`` pairs taken whole, in order, while they fit; one that does not
    is passed over. If none fits, the shortest is taken."""
    taken, used = [], 0
    for row in sizes:
        if used + row["n"] <= tokens:
            taken.append(row["chosen"])
            used += row["n"]
    return taken or [row["chosen"] for row in sorted(sizes, key=lambda r: r["n"])[:1]]


def sample(docs: DataFrame, trusted: DataFrame, text: str, doc_id: str, lang: str = "lang") -> DataFrame:
    """Trusted texts to learn from: all, or those within the bounds, spread over the languages.

    Under a bound documents go by the hash of their id times the documents of their language, so each
    language gives about as many as any other, until it has no more. Rows of one id are
    taken together. Only ids and sizes, TRAIN_DOCS of them, are put in order.
    """
    if TRAIN_DOCS is None and TRAIN_TOKENS is None:
        ids = trusted.where(~_apart(F.col("doc_id"))).select(F.col("doc_id").alias("chosen"))
        given = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
        return given.join(ids, F.col("id") == F.col("chosen"), "left_semi").select("text")
    ids = trusted.where(~_apart(F.col("doc_id"))).select(F.col("doc_id").alias("chosen"))
    spoken = F.col(f"`{lang}`") if lang in docs.columns else F.lit(None).cast("string")
    known = docs.select(F.col(f"`{doc_id}`").alias("id"), spoken.alias("l")).join(
        ids, F.col("id") == F.col("chosen")).groupBy("chosen").agg(F.min("l").alias("l"))
    known = keep(known, "trusted")
    many = known.groupBy(F.col("l").alias("of")).agg(F.count(F.lit(1)).alias("many"))
    part = F.pmod(F.xxhash64("chosen"), F.lit(1 << 40))
    chosen = known.join(many, F.col("l").eqNullSafe(F.col("of"))).select(
        "chosen", (part * F.col("many")).cast("decimal(38,0)").alias("place"))
    chosen = keep(chosen if TRAIN_DOCS is None else chosen.orderBy("place", "chosen").limit(TRAIN_DOCS), "trusted")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")).join(
        chosen, F.col("id") == F.col("chosen"))
    if TRAIN_TOKENS is None:
        return rows.select("text")
    tokens = F.size(F.split(F.decode("text", "UTF-8"), "[\\x20\\x09-\\x0D]+"))
    sizes = rows.groupBy("place", "chosen").agg(F.sum(F.coalesce(tokens, F.lit(0))).alias("n")).orderBy("place", "chosen").collect()
    return rows.where(F.col("id").isin(_within(sizes, TRAIN_TOKENS))).select("text")


def _discounts(counted: np.ndarray) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    n1, n2, n3, n4 = (float(n) for n in counted)
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]  # too few counts to estimate from
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.1), k - 0.05) for k, d in enumerate(found, 1)]


def _discounted(c: np.ndarray, discounts: list[float]) -> np.ndarray:
    return c - np.array(discounts)[np.minimum(c, 3) - 1]


def _sum(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, values, n).astype(np.int64)


def _following(of: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Per context its total, and how many of its n-grams were counted once, twice, more often."""
    return np.stack([_sum(of, x, n) for x in (c, c == 1, c == 2, c > 2)], 1)


def _gamma(following: np.ndarray, discounts: list[float]) -> np.ndarray:
    """The mass that discounts leave to lower orders."""
    return following[:, 1:4] @ np.array(discounts) / following[:, 0]


def _counted(c: np.ndarray) -> list[int]:
    """How many counts are one, two, three and four."""
    return [np.count_nonzero(c == k) for k in (1, 2, 3, 4)]


def _class(times: np.ndarray) -> np.ndarray:
    """Classes of about equal counts, sixteen an octave."""
    return np.minimum(np.floor(16 * np.log2(times)), _CLASSES - 1).astype(np.int64)


def _classes(times: np.ndarray) -> np.ndarray:
    return np.bincount(_class(times), minlength=_CLASSES)


def _counts(rows: list[dict]) -> SimpleNamespace:
    """The trigrams, bigrams, contexts and first words of bigrams of one group."""
    u, v, w = (_unpacked([r[x] for r in rows]) for x in "abc")
    begins, pair, context = v == np.uint64(_BEGIN), _joined_key(v, w), _joined_key(u, v)
    key, at, of = np.unique(np.where(begins, pair, _joined_key(context, w)), return_index=True, return_inverse=True)
    c = _sum(of, _unpacked([r["n"] for r in rows], np.int32), len(key))
    u, v, w, real, context = u[at], v[at], w[at], ~begins[at], context[at]
    two, first, pair = np.unique(pair[at], return_index=True, return_inverse=True)
    # Lower orders count the different words before an n-gram; at a text's begin, texts.
    two = SimpleNamespace(key=two, first=v[first], last=w[first], times=_sum(pair, c, len(two)), c=_sum(pair, np.where(real, 1, c), len(two)))
    words, two.word = np.unique(two.first, return_inverse=True)
    three = SimpleNamespace(key=key[real], c=c[real], pair=pair[real])
    contexts, first, three.context = np.unique(context[real], return_index=True, return_inverse=True)
    return SimpleNamespace(
        two=two, three=three,
        words=SimpleNamespace(key=words, times=_sum(two.word, two.times, len(words)), following=_following(two.word, two.c, len(words))),
        contexts=SimpleNamespace(
            key=contexts, first=u[real][first], last=v[real][first], following=_following(three.context, three.c, len(contexts))))


def _tallied(heavy: np.ndarray, bits: int) -> Callable[[pa.Table], pa.Table]:
    """What a group has to exchange: (g: where it is summed; n: the group that asks)."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found, asks, out = _counts(rows), np.int32(rows[0]["g"]).tobytes(), []
        two, three, words, contexts = found.two, found.three, found.words, found.contexts

        def put(kind: int, to: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> None:
            out.extend((g, kind, k.tobytes(), x.tobytes(), None, asks) for g, k, x in _split(to, keys, sums))

        last, of = np.unique(two.last, return_inverse=True)
        put(_LAST, _home(last, bits), last, np.stack([np.bincount(of, minlength=len(last)), _sum(of, two.times, len(last))], 1))
        some = _found(words.key, heavy)[0]
        put(_FIRST, _home(words.key[some], bits), words.key[some], np.column_stack([words.following, words.times])[some])
        some = _found(contexts.last, heavy)[0]
        sums = np.column_stack([contexts.following, _group(contexts.first, contexts.key, heavy, bits)])
        put(_CONTEXT, _home(contexts.key[some], bits), contexts.key[some], sums[some])
        # Of a context with one use there is nothing to tell: its bigram has one use as well.
        some = ~some & (sums[:, 0] > 1)
        put(_WHOLE, np.zeros(np.count_nonzero(some), np.int32), contexts.key[some], sums[some])
        stats = np.concatenate([_counted(two.c), _counted(three.c), _classes(two.times) + _classes(three.c)])
        out.append((-1, _STATS, None, stats.astype(np.int64).tobytes(), None, None))
        return pa.Table.from_batches([_packed(out)])

    return run


def _exchanged(table: pa.Table) -> pa.Table:
    """Sums by key, once for all (g: -1) and for each group that asked."""
    rows, out = table.to_pylist(), []
    for kind in (_LAST, _FIRST, _CONTEXT):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        given = _unpacked([r["b"] for r in own], np.int64).reshape(-1, _WIDTH[kind])
        keys, at, of = np.unique(_unpacked([r["a"] for r in own]), return_index=True, return_inverse=True)
        sums = np.stack([_sum(of, column, len(keys)) for column in given.T], 1)
        if kind == _CONTEXT:
            sums[:, 4] = given[at, 4]  # a group, the same for all
        if kind == _LAST:
            stats = np.concatenate([_counted(sums[:, 0]), [sums[:, 0].sum(), len(keys), 0, 0], _classes(sums[:, 1])])
            out.append((-1, _STATS, None, stats.astype(np.int64).tobytes(), None, None))
        out.append((-1, kind, keys.tobytes(), sums.tobytes(), None, None))
        answers = np.split(sums[of, :-1], np.cumsum([len(r["a"]) // 8 for r in own])[:-1])
        out += [(int(np.frombuffer(r["n"], np.int32)[0]), kind, r["a"], x.tobytes(), None, None) for r, x in zip(own, answers)]
    return pa.Table.from_batches([_packed(out)])


def _answers(rows: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys that a group asked for, and their sums."""
    own = [r for r in rows if r["kind"] == kind]
    keys = _unpacked([r["a"] for r in own])
    order = np.argsort(keys)
    return keys[order], _unpacked([r["b"] for r in own], np.int64).reshape(-1, _WIDTH[kind] - 1)[order]


_MODEL = "g int, order int, shared boolean, keys binary, weights binary"


def _pieces(g: int, order: int, keys: np.ndarray, times: np.ndarray, weights: np.ndarray, cut: int) -> list[tuple]:
    """Rows of the model: weights that tasks share, and others."""
    shared = _class(times) >= cut
    return [(g, order, is_shared, keys[some].tobytes(), weights[some].tobytes())
            for is_shared, some in ((True, shared), (False, ~shared)) if some.any()]


def _model_rows(rows: list[tuple]) -> pa.RecordBatch:
    return _records(rows, ["g", "order", "shared", "keys", "weights"], [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()])


def _order_of(words: np.ndarray) -> np.ndarray:
    return np.where(words == np.uint64(_BEGIN), 0, 1)


def _weighed(m: SimpleNamespace) -> Callable[[pa.Table], pa.Table]:
    """Weights of a group's n-grams over those of the lower order."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counted, answered, out = [r for r in rows if r["kind"] == _STATS], [r for r in rows if r["kind"] != _STATS], []
        found, g = _counts(counted), rows[0]["g"]
        two, three, words, contexts = found.two, found.three, found.words, found.contexts
        for own, kind in ((words, _FIRST), (contexts, _CONTEXT)):
            keys, sums = _answers(answered, kind)
            own.told, at = _found(own.key, keys)
            own.following[own.told] = sums[at[own.told]]
        keys, sums = _answers(answered, _LAST)
        p1 = _discounted(sums[_found(two.last, keys)[1], 0], m.d1) / m.total + m.unknown
        gamma2, gamma3 = _gamma(words.following, m.d2), _gamma(contexts.following, m.d3)
        lower = gamma2[two.word] * p1
        p2 = _discounted(two.c, m.d2) / words.following[two.word, 0] + lower
        # The context of one use that a bigram is; those of more uses come from their own group.
        alone = (two.times == 1) & (two.last != np.uint64(_END))
        out += _pieces(g, 2, two.key, two.times, np.log10(p2) - np.log10(lower) + np.where(alone, np.log10(m.d3[0]), 0.0), m.cut)
        lower = gamma3[three.context] * p2[three.pair]
        p3 = _discounted(three.c, m.d3) / contexts.following[three.context, 0] + lower
        out += _pieces(g, 3, three.key, three.c, np.log10(p3) - np.log10(lower), m.cut)
        for order, *columns in _split(_order_of(words.key)[~words.told], words.key[~words.told], words.times[~words.told], np.log10(gamma2)[~words.told]):
            out += _pieces(g, order, *columns, m.cut)
        return pa.Table.from_batches([_model_rows(out)])

    return run


def _told(m: SimpleNamespace):
    """Weights from what was exchanged: of words over unknown ones, and of contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                keys, kind = _unpacked([r["a"]]), r["kind"]
                sums = _unpacked([r["b"]], np.int64).reshape(-1, _WIDTH[kind])
                to, order = _home(keys, m.bits), np.ones(len(keys), np.int64)
                if kind == _LAST:
                    times, weight = sums[:, 1], np.log10(_discounted(sums[:, 0], m.d1) / m.total + m.unknown) - np.log10(m.unknown)
                elif kind == _FIRST:
                    times, weight, order = sums[:, 4], np.log10(_gamma(sums, m.d2)), _order_of(keys)
                else:
                    times, weight, to, order = sums[:, 0], np.log10(_gamma(sums, m.d3)), sums[:, 4], order * 2
                many = (times > 1) | (kind not in (_CONTEXT, _WHOLE))
                for place, *columns in _split((to * 4 + order)[many], keys[many], times[many], weight[many]):
                    out += _pieces(place // 4, place % 4, *columns, m.cut)
            yield _model_rows(out)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their uses in a batch, of sixteen or more."""
    for batch in batches:
        if batch.num_rows:
            keys, n = np.unique(_flat(batch.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 15].view(np.int64)), pa.array(n[n > 15])], ["key", "n"])


def _stats(table: DataFrame) -> np.ndarray:
    """Sums of the statistics, of which every group has a fixed size."""
    rows = table.where(F.col("kind") == _STATS).select("b").toArrow()["b"].to_pylist()
    return _unpacked(rows, np.int64).reshape(-1, 8 + _CLASSES).sum(0)


def _cut(classes: np.ndarray) -> int:
    """The least class of counts of n-grams that tasks know: at most SHARED n-grams reach it."""
    over = np.cumsum(classes[::-1]) > SHARED
    return _CLASSES - int(np.argmax(over)) if over.any() else 0


def _model(texts: DataFrame) -> tuple[DataFrame, SimpleNamespace]:
    """The model's weights, several groups to a bucket, and what its readers have to know."""
    spark = texts.sparkSession
    texts = keep(texts, "sample")
    bits = max(4, (parts_for(text_bytes(texts, "text"), GROUP_BYTES) - 1).bit_length())
    frequent = texts.mapInArrow(_frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    with small_batches(spark, "4m"):
        heavy = np.sort(frequent.where(F.col("n") >= HEAVY).select("key").toArrow()["key"].to_numpy().view(np.uint64))

    def dealt(part: int, slices: int) -> DataFrame:
        return texts.mapInArrow(_dealt(part, slices, heavy, bits), _ROWS)

    def kept(table: DataFrame, label: str) -> DataFrame:
        with small_batches(spark, "4m"):
            return keep(table, label)

    # No weights lie beside the first pass.
    slices = max(1, SLICES // 2)
    tallied = [kept(dealt(i, slices).groupBy("g").applyInArrow(_tallied(heavy, bits), _ROWS), "counts") for i in range(slices)]
    both = _union(tallied)
    sums = both.where(F.col("kind").isin(_LAST, _FIRST, _CONTEXT)).groupBy("g").applyInArrow(_exchanged, _ROWS)
    sums = keep(sums.withColumn("slice", F.pmod("g", F.lit(SLICES))), "contexts")
    of23, of1 = _stats(both), _stats(sums)

    m = SimpleNamespace(bits=bits, heavy=heavy, d1=_discounts(of1[:4]), d2=_discounts(of23[:4]), d3=_discounts(of23[4:8]))
    m.total, words, m.cut = float(of1[4] or 1), int(of1[5]), _cut(of23[8:] + of1[8:])
    n1, n2 = of1[:2]
    freed = float(np.dot([n1, n2, words - n1 - n2], m.d1)) / m.total if words else 1.0
    m.unknown = freed / (words + 1)

    own = sums.where(F.col("g") == -1).where(F.col("kind") != _STATS).drop("slice").union(both.where(F.col("kind") == _WHOLE))
    m.parts = max(8, 1 << (bits - 2))
    bucket = F.pmod("g", F.lit(m.parts)).cast("int")
    told = own.mapInArrow(_told(m), _MODEL).withColumn("g", bucket)
    with small_batches(spark, "4m"):
        table = add_bucketed(told.repartition(m.parts, "g"), m.parts, "g", "model")
    drop(*tallied)
    for part in range(SLICES):
        rows = dealt(part, SLICES).union(sums.where(F.col("slice") == part).where(F.col("g") >= 0).drop("slice"))
        with small_batches(spark, "4m"):
            weighed = rows.groupBy("g").applyInArrow(_weighed(m), _MODEL).withColumn("g", bucket)
            table = add_bucketed(weighed, m.parts, "g", "model", table)
    drop(texts, sums)
    return table, m


def _union(tables: list[DataFrame]) -> DataFrame:
    """One table of kept slices."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t._kept_at for t in tables))


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            keys = np.frombuffer(r["keys"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.full(len(keys), r["order"], np.int32)), pa.array(np.frombuffer(r["weights"], float))],
                ["key", "order", "weight"])


def weights(texts: DataFrame) -> tuple[DataFrame, float, float]:
    """(key, order, weight) of the model's n-grams; the log probability of an unknown
    word; and the context weight of a text's begin."""
    table, m = _model(texts)
    rows = table.mapInArrow(_by_row, "key long, order int, weight double").groupBy("key", "order").agg(F.sum("weight").alias("weight"))
    begin = rows.where("order = 0").first()
    return rows.where("order > 0"), float(np.log10(m.unknown)), begin["weight"] if begin else 0.0


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of keys, zero for unknown ones, and which are known; a bitmap turns most of the
    others away first."""
    out, there = np.zeros(len(keys)), np.zeros(len(keys), bool)
    hit = np.flatnonzero(_in_bitmap(keys, maybe))
    there[hit], at = _found(keys[hit], known)
    out[there] = values[at[there[hit]]]
    return out, there


def _bits_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that stand for a key in a bitmap."""
    return keys >> np.uint64(64 - bits), keys & np.uint64((1 << bits) - 1)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where keys are in the bitmap, by its chunks."""
    for batch in batches:
        place = np.unique(np.concatenate(_bits_of(_unpacked(batch.column(0).to_pylist()), _BITS)))
        rows = [(chunk, x.tobytes()) for chunk, x in _split(
            (place >> np.uint64(_CHUNK)).astype(np.int32), (place & np.uint64((1 << _CHUNK) - 1)).astype(np.uint32))]
        yield _records(rows, ["chunk", "bits"], [pa.int32(), pa.binary()])


def _chunk(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << _CHUNK, bool)
    bits[_unpacked(table["bits"].to_pylist(), np.uint32)] = True
    rows = [(table["chunk"][0].as_py(), np.packbits(bits, bitorder="little").tobytes())]
    return pa.Table.from_batches([_records(rows, ["chunk", "bits"], [pa.int32(), pa.binary()])])


def _bitmap_of(table: DataFrame) -> np.ndarray:
    """The bitmap of a table's keys, put together in the tasks; its size is fixed."""
    schema = "chunk int, bits binary"
    with small_batches(table.sparkSession, "4m"):
        chunks = keep(table.select("keys").mapInArrow(_places, schema).groupBy("chunk").applyInArrow(_chunk, schema), "bitmap")
    out = np.zeros((1 << (_BITS - _CHUNK), 1 << (_CHUNK - 3)), np.uint8)
    for r in chunks.toArrow().to_pylist():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    drop(chunks)
    return out.ravel()


def _bitmap(keys: np.ndarray, bits: int = 26) -> np.ndarray:
    out = np.zeros(1 << (bits - 3), np.uint8)
    for place in _bits_of(keys, bits):
        np.bitwise_or.at(out, place >> np.uint64(3), np.left_shift(1, place & np.uint64(7)).astype(np.uint8))
    return out


def _in_bitmap(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    out, left = np.zeros(len(keys), bool), np.arange(len(keys))
    for place in _bits_of(keys, (8 * len(bitmap)).bit_length() - 1):
        place = place[left]
        left = left[(bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    out[left] = True
    return out


def _scored(shared, unknown: float, m: SimpleNamespace):
    """Per row, by its block and place there: tokens, and log10 probability from the shared
    weights. And per block and bucket of the model, the n-grams that may be among those dealt out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values, dealt = shared.value
        maybe = _bitmap(known)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            tokens, score, rare = [], [], []
            for at in range(0, batch.num_rows, 256):
                one, sizes = _flat(batch.column(1).slice(at, 256).to_pylist())
                ends = np.cumsum(sizes)
                two = _joined_key(one[:-1], one[1:])
                three = _joined_key(two[:-1], one[2:])
                doc = np.repeat(np.arange(len(sizes)), sizes)
                # N-grams may not run over a text's end; one is known only if both of its parts are.
                w, may, rare_at = np.zeros(len(one)), np.ones(len(one) + 1, bool), []
                for n, keys in enumerate((one, two, three)):
                    spot = np.flatnonzero(may[:-1] & may[1:] & (doc[n:] == doc[:len(doc) - n]))
                    value, there = _looked_up(keys[spot], known, values, maybe)
                    w[spot + n] += value
                    some = spot[_in_bitmap(keys[spot], dealt)]
                    may = np.zeros(len(keys), bool)
                    may[spot[there]], may[some] = True, True
                    rare_at.append(some)
                one_at, two_at, three_at = rare_at
                # The begin mark is no token.
                tokens.append(sizes - 1)
                score.append(np.add.reduceat(w, ends - sizes) + unknown * (sizes - 1))
                for grams, group, place in (
                    (one[one_at], _home(one[one_at], m.bits), one_at),
                    (two[two_at], _group(one[two_at], two[two_at], m.heavy, m.bits), two_at),
                    (three[three_at], _group(one[three_at + 1], two[three_at + 1], m.heavy, m.bits), three_at),
                ):
                    rare.append((group % m.parts, grams, (doc[place] + at).astype(np.int32)))
            n = batch.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.concatenate(tokens)),
                    pa.array(np.concatenate(score)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], _SCORES)
                rows = [(None, block, None, None, None, g, x.tobytes(), d.tobytes())
                        for g, x, d in _split(*map(np.concatenate, zip(*rare)))]
                kinds = [batch.schema.types[0], pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
                yield _records(rows, _SCORES, kinds)
                block += 1

    return run


_SCORES = ["row", "block", "at", "n_tokens", "partial", "g", "grams", "places"]


def _met(uses: pa.Table, model: pa.Table) -> pa.Table:
    """Sums per block and row of the weights that one bucket has."""
    keys, weight, out = _unpacked(model["keys"].to_pylist()), _unpacked(model["weights"].to_pylist(), float), []
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    if len(keys):  # an n-gram's weight may come in two pieces
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, weight = keys[starts], np.add.reduceat(weight, starts)
    for r in uses.to_pylist() if len(keys) else ():
        hit, at = _found(np.frombuffer(r["grams"], np.uint64), keys)
        if hit.any():
            rows, of = np.unique(np.frombuffer(r["places"], np.int32)[hit], return_inverse=True)
            out.append((r["block"], rows.tobytes(), np.bincount(of, weight[at[hit]]).tobytes()))
    return pa.Table.from_batches([_records(out, ["block", "places", "sums"], [pa.int64(), pa.binary(), pa.binary()])])


def _added(table: pa.Table) -> pa.Table:
    """Sums per row of one block."""
    rows, of = np.unique(_unpacked(table["places"].to_pylist(), np.int32), return_inverse=True)
    more = np.bincount(of, _unpacked(table["sums"].to_pylist(), float))
    return pa.table({"b": pa.array(np.full(len(rows), table["block"][0].as_py())), "i": pa.array(rows), "more": pa.array(more)})


def perplexities(
    docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None
) -> DataFrame:
    """``row`` (the columns ``carry``, default all but ``text``), ``n_tokens``,
    ``log10_prob`` and ``perplexity``."""
    spark, (table, m) = docs.sparkSession, _model(sample(docs, trusted, text, doc_id))
    common = table.where("shared").select("keys", "weights").toArrow()
    known, of = np.unique(_unpacked(common["keys"].to_pylist()), return_inverse=True)
    values = np.bincount(of, _unpacked(common["weights"].to_pylist(), float), len(known))
    dealt = table.where("not shared")
    shared = spark.sparkContext.broadcast((known, values, _bitmap_of(dealt)))

    carry = [c for c in docs.columns if c != text] if carry is None else carry
    given = docs.select(as_row(docs, carry), F.col(f"`{text}`").cast("binary").alias("t"))
    out = StructType().add("row", given.schema["row"].dataType)  # null where a row holds n-grams
    for name, kind in zip(_SCORES[1:], ("long", "integer", "long", "double", "integer", "binary", "binary")):
        out = out.add(name, kind)
    done = []
    for portion in range(PORTIONS):
        own = given.where(F.pmod(F.xxhash64("t"), F.lit(PORTIONS)) == portion)
        with small_batches(spark, "4m"):
            scored = keep(own.mapInArrow(_scored(shared, float(np.log10(m.unknown)), m), out), "scores")
        uses = scored.where("g is not null").select("g", "block", "grams", "places")
        some = lambda table, share: table.where(F.pmod("g", F.lit(SHARES)) == share).groupBy("g")
        parts = [
            keep(some(uses, i).cogroup(some(dealt.select("g", "keys", "weights"), i)).applyInArrow(
                _met, "block long, places binary, sums binary"), "sums") for i in range(SHARES)]
        added = _union(parts).groupBy("block").applyInArrow(_added, "b long, i int, more double")
        whole = scored.where("g is null").join(added, (F.col("block") == F.col("b")) & (F.col("at") == F.col("i")), "left")
        done.append(keep(whole.select("row", "n_tokens", (F.col("partial") + F.coalesce("more", F.lit(0.0))).alias("log")), "scored"))
        drop(scored, *parts)
    drop(table)
    shared.destroy()
    log = F.col("log")
    return _union(done).select(
        "row", "n_tokens", log.alias("log10_prob"), F.pow(F.lit(10.0), -log / F.col("n_tokens")).alias("perplexity"))


def judged(scored: DataFrame, trusted: DataFrame, lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """A written table of ``perplexities`` with ``threshold`` and ``kept``."""
    level = F.round(F.log10("perplexity") * UNIT).cast("long")
    good = scored.join(trusted.where(_apart(F.col("doc_id"))), F.col("row")[doc_id] == F.col("doc_id")).select(
        F.col("row")[lang].alias("l"), level.alias("level"))
    good = keep(good, "trusted")
    cut = F.percentile("level", QUANTILE)
    overall = good.agg(cut.alias("c")).first()["c"]
    limits = keep(good.groupBy("l").agg(F.count(F.lit(1)).alias("n"), cut.alias("cut")).where(
        F.col("n") >= LEAST_TEXTS).drop("n"), "limits")
    joined = scored.join(limits, F.col("row")[lang].eqNullSafe(F.col("l")), "left").drop("l")
    limit = F.coalesce("cut", F.lit(overall).cast("double"))
    # Both sides in UNITs, so a text at the quantile itself is kept.
    return joined.withColumn("kept", F.coalesce(level <= limit, F.lit(True))).withColumn(
        "threshold", F.pow(F.lit(10.0), limit / UNIT)).drop("cut").select(*scored.columns, "threshold", "kept")
