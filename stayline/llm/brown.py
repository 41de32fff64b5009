"""Language-model scoring with a class-based n-gram model (Brown et al.).

Training counts every word of every training text; nothing is sampled. Every word of
``LEAST_COUNT`` or more uses has a class, in a corpus of any size; less frequent words share
one class, so do text ends. The most frequent words carry numbers in the tasks (``FREQUENT``
of them; this bounds memory and changes no result), all other words stay in a table and are
joined.

Classes come from exchange clustering. The start is made by the most frequent words, which
are exchanged one by one on their bigram counts (a bounded matrix). From there all classed
words are exchanged, in sweeps of two halves: Spark counts each word's neighbours by class,
each word of the half goes to the class that gains most, and the half stays where it was
unless the likelihood of the whole corpus rises. Sweeps end when one gains too little. A
sweep's tasks know the classes by word number, one byte a classed word.

P(text) is the product over tokens of P(class | two classes before) and P(word | class).
Transitions are interpolated from three to one class by Witten-Bell weights. Emissions are
relative frequencies; in the class of rare words an absolute discount makes room for
unknown words, which count as one token type.

Defined results: a null text is empty and has one token, its end; a null id is in the
training part; with no training text every word is unknown and classes are equally likely.
Repeated rows are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stayline.llm.common import drop, keep, small_batches

#: Most frequent words that tasks know by themselves, and that start the exchange on a full matrix.
FREQUENT, EXCHANGED = 200_000, 1500
#: Words that training texts use less often than this are rare in a corpus of any size.
LEAST_COUNT = 8
CLASSES, SWEEPS = 48, 12
#: Classes after the exchanged ones: rare words and ends of text.
RARE, END = CLASSES, CLASSES + 1
_ALL = CLASSES + 2
#: A sweep that gains less than this a token (in nats) is the last.
LEAST_GAIN = 1e-3
_FLUSH = 150_000
#: Words of a block; the first _WORD_BLOCK words, which have most neighbours, lie in blocks of
#: _HEAD_BLOCK. The neighbours of a block are dealt into parts of about _PART_TOKENS tokens.
_WORD_BLOCK, _HEAD_BLOCK, _PART_TOKENS = 4096, 64, 1 << 19
_HEADS = _WORD_BLOCK // _HEAD_BLOCK


def held_out(doc_id: Column) -> Column:
    """One document in seven, by its id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of all words; one that only held-out texts use has none."""
    train, rest = Counter(), set()

    def flush() -> pa.RecordBatch:
        keys = list(train.keys() | rest)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([train[w] for w in keys], pa.int64())], ["word", "train"])
        train.clear()
        rest.clear()
        return batch

    for batch in batches:
        for out, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            (rest if out else train).update(words(text.as_py()))
            if len(train) + len(rest) > _FLUSH:
                yield flush()
    yield flush()


def _numbered(counts: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """(word, train, number) of all classed words, the most frequent first, how many, and the
    table that is read for them."""
    order = counts.where(F.col("train") >= LEAST_COUNT).orderBy(F.desc("train"), "word")
    placed = keep(order.withColumn("place", F.monotonically_increasing_id()), "classed")
    part, shifts, total = F.shiftright("place", 33), [], 0
    for row in sorted(placed.groupBy(part.alias("part")).count().collect()):
        shifts.append((row["part"], total - (row["part"] << 33)))
        total += row["count"]
    shift = counts.sparkSession.createDataFrame(shifts, "part long, shift long")
    return placed.join(F.broadcast(shift), part == F.col("part")).select(
        "word", "train", (F.col("place") + F.col("shift")).alias("number")), total, placed


_TOKENS = "held_out boolean, n_words long, known long, base double, model double, ids binary"


def _slices(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _to_numbers(shared):
    """Texts as numbers of frequent words (another word is -1) with the sums of these, and
    the other words with their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, base, emission = shared.value
        for batch in _slices(batches):
            rows, others, places, sizes = [], [], [], []
            for text in batch.column(2):
                tokens = words(text.as_py())
                ids = np.fromiter((of.get(w, -1) for w in tokens), np.int32, len(tokens))
                other, own = np.flatnonzero(ids < 0), ids[ids >= 0]
                others += [tokens[i] for i in other.tolist()]
                places.append(other.astype(np.int32))
                sizes.append(len(other))
                rows.append((len(tokens), len(own), float(base[own].sum()), float(emission[own].sum()), ids.tobytes()))
            n, known, b, m, ids = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                pa.array(b, pa.float64()), pa.array(m, pa.float64()), pa.array(ids, pa.binary()),
                _lists(pa.array(others, pa.binary()), sizes), _lists(pa.array(np.concatenate(places)), sizes),
            ], ["doc_id", "held_out", "n_words", "known", "base", "model", "ids", "other", "places"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of joined words put at their places."""
    for batch in _slices(batches):
        given, found = batch.column(6).to_pylist(), batch.column(7)
        ends = np.cumsum([len(x) // 4 for x in given])
        ids = np.frombuffer(b"".join(given), np.int32).copy()
        starts = np.concatenate([[0], ends[:-1]])
        entries = found.flatten()
        rows = np.repeat(starts, found.value_lengths().to_numpy())
        ids[rows + entries.field(0).to_numpy()] = entries.field(1).to_numpy()
        texts = pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], texts], batch.schema.names[:7])


def _streams(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[np.ndarray]:
    """Texts' numbers one after the other, each text with an end (-2) behind and before."""
    held, total = [np.array([-2], np.int32)], 0
    for batch in batches:
        for ids in batch.column(0):
            held += [np.frombuffer(ids.as_py(), np.int32), held[0]]
            total += len(held[-2]) + 1
            if total > size:
                yield np.concatenate(held)
                held, total = held[:1], 0
    if total:
        yield np.concatenate(held)


def _bigrams(width: int):
    """Counts of pairs of exchanged words; two further rows are other words and ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 2) ** 2, np.int64)
        for stream in _streams(batches):
            rows = np.where(stream == -2, width + 1, np.where((stream < 0) | (stream >= width), width, stream))
            total += np.bincount(rows[:-1].astype(np.int64) * (width + 2) + rows[1:], minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, fixed: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word of a bigram count matrix whose last ``fixed`` rows are classes of
    their own. Words move, most frequent first, to the class that gains most likelihood."""
    count = len(bigrams) - fixed
    of = np.concatenate([np.arange(count) % classes, classes + np.arange(fixed)])
    total = classes + fixed
    member = np.zeros((len(bigrams), total))
    member[np.arange(len(bigrams)), of] = 1
    after = bigrams @ member       # from a word to a class
    before = (member.T @ bigrams).T  # from a class to a word
    between = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in range(count):
            here, own = of[w], float(bigrams[w, w])
            right, left = after[w].copy(), before[w].copy()
            right[here] -= own
            left[here] -= own
            between[here, :] -= right
            between[:, here] -= left
            between[here, here] -= own
            gain = (_xlogx(between + right[None, :]) - _xlogx(between)).sum(axis=1)
            gain += (_xlogx(between + left[:, None]) - _xlogx(between)).sum(axis=0)
            corner = np.diag(between)
            both, ends = corner + right + left + own, _xlogx(corner)
            gain += _xlogx(both) - _xlogx(corner + right) - _xlogx(corner + left) + ends
            # The word's own counts reach the totals of its neighbours wherever it goes.
            rows, columns = between.sum(axis=1) + left, between.sum(axis=0) + right
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows)
            gain -= _xlogx(columns + left.sum() + own) - _xlogx(columns)
            best = int(gain[:classes].argmax())
            if gain[best] <= gain[here] + 1e-9:
                best = here
            between[best, :] += right
            between[:, best] += left
            between[best, best] += own
            if best != here:
                moved += 1
                of[w] = best
                after[:, here] -= bigrams[:, w]
                after[:, best] += bigrams[:, w]
                before[:, here] -= bigrams[w, :]
                before[:, best] += bigrams[w, :]
        if not moved:
            break
    return of[:count]


_PACKED = "first long, part int, head binary, near binary, n binary"


def _parts(tokens: int, classed: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of blocks, and into how many parts each is dealt, if uses fall off as ranks do."""
    first = np.concatenate([
        np.arange(_HEADS) * _HEAD_BLOCK, np.arange(_WORD_BLOCK, max(classed, _WORD_BLOCK + 1), _WORD_BLOCK)])
    size = np.where(first < _WORD_BLOCK, _HEAD_BLOCK, _WORD_BLOCK)
    share = np.log((first + size + 1) / (first + 1)) / np.log(first[-1] + size[-1] + 1)
    return first, np.maximum(1, np.ceil(share * tokens / _PART_TOKENS)).astype(np.int64)


def _neighbours(first: np.ndarray, parts: np.ndarray):
    """Neighbours of each classed word by block, named by its first word, and part. ``head``
    is the place in the block times two, plus one for the word behind; ``near`` is the
    neighbour's number plus two, so 0 is an end and 1 a rare word. Block -1 counts pairs of
    those two: ``head`` is twice the one plus the other."""
    start = np.cumsum(parts) - parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _streams(batches):
            near = stream.astype(np.int64) + 2
            at = np.flatnonzero(stream >= 0)
            word = near[at] - 2
            block = np.where(word < _WORD_BLOCK, word // _HEAD_BLOCK, _HEADS - 1 + word // _WORD_BLOCK)
            place = (start[block] << 45) | ((word - first[block]) << 33)
            keys = [place + ((beside % parts[block] << 45) | (side << 32) | beside)
                    for side, beside in enumerate((near[at - 1], near[at + 1]))]
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            low = np.bincount((near[:-1] * 2 + near[1:])[(near[:-1] < 2) & (near[1:] < 2)], minlength=4)
            rows = [(-1, 0, np.arange(4, dtype="<u2").tobytes(), np.zeros(4, "<u4").tobytes(), low.astype("<u4").tobytes())]
            cuts = np.flatnonzero(np.diff(key >> 45)) + 1
            for begin, stop in zip([0, *cuts], [*cuts, len(key)]) if len(key) else ():
                pairs, group = key[begin:stop], int(key[begin] >> 45)
                of = int(np.searchsorted(start, group, "right")) - 1
                rows.append((
                    int(first[of]), group - int(start[of]), (pairs >> 32 & 0x1FFF).astype("<u2").tobytes(),
                    (pairs & 0xFFFFFFFF).astype("<u4").tobytes(), n[begin:stop].astype("<u4").tobytes()))
            named, part, *packed = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(named, pa.int64()), pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)],
                ["first", "part", "head", "near", "n"])

    return run


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in the least width that holds them."""
    return n.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if n.max(initial=0) < 256 ** w))


def _merged(rows: pa.Table) -> pa.Table:
    """The neighbours of one block and part, each pair once."""
    joined = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind).astype(np.int64)
    key = joined("head", "<u2") << 32 | joined("near", "<u4")
    order = np.argsort(key)
    key, n = key[order], joined("n", "<u4")[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pair, n = key[first], np.add.reduceat(n, first)
    packed = ((pair >> 32).astype("<u2"), (pair & 0xFFFFFFFF).astype("<u4"), _narrow(n))
    return pa.table([
        pa.array([rows["first"][0].as_py()], pa.int64()), pa.array([rows["part"][0].as_py()], pa.int32()),
        *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["first", "part", "head", "near", "n"])


def neighbours(ids: DataFrame, tokens: int, classed: int) -> DataFrame:
    """The table of ``_neighbours``, merged, for about ``tokens`` tokens of ``classed`` words."""
    found = ids.mapInArrow(_neighbours(*_parts(tokens, classed)), _PACKED)
    with small_batches(ids.sparkSession):
        return keep(found.groupBy("first", "part").applyInArrow(_merged, _PACKED), "near")


def _unpacked(batches: Iterator[pa.RecordBatch]):
    """(first, head, near, n) of merged rows."""
    for batch in batches:
        for i, first in enumerate(batch.column(0).to_pylist()):
            head, near, n = (batch.column(k)[i].as_buffer() for k in (2, 3, 4))
            head = np.frombuffer(head, "<u2")
            n = np.frombuffer(n, f"<u{n.size // len(head)}")
            yield first, head, np.frombuffer(near, "<u4"), n


def _class_bigrams(shared):
    """Counts of class pairs. A pair is counted at its first word, or, if that has no class of
    its own, at its second."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value.astype(np.int64), np.zeros(_ALL * _ALL)
        for first, head, near, n in _unpacked(batches):
            if first < 0:
                cell = of[(head >> 1).astype(np.int64) - 2] * _ALL + of[(head & 1).astype(np.int64) - 2]
            else:
                at = np.flatnonzero((head & 1 == 1) | (near < 2))
                head, n = head[at].astype(np.int64), n[at]
                own, beside = of[first + (head >> 1)], of[near[at].astype(np.int64) - 2]
                cell = np.where(head & 1 == 1, own * _ALL + beside, beside * _ALL + own)
            total += np.bincount(cell, weights=n, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell].astype(np.int64))], ["cell", "n"])

    return run


def _near_classes(shared, least: int, half: int | None):
    """By block, counts of neighbouring classes of words from ``least`` on, or of that half of
    them. Cell = (word in block * 2 + side) * classes + class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, rows = shared.value.astype(np.int64), []
        heads = np.zeros((_HEADS, _HEAD_BLOCK * 2 * _ALL), np.int64)

        def add(first: int, total: np.ndarray) -> None:
            cell = np.flatnonzero(total)
            rows.append((first, cell.astype("<u4").tobytes(), total[cell].astype("<u8").tobytes()))

        def flush() -> pa.RecordBatch:
            first, cells, n = zip(*rows) if rows else ((), (), ())
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(first, pa.int64()), pa.array(cells, pa.binary()), pa.array(n, pa.binary())], ["first", "cells", "n"])

        for first, head, near, n in _unpacked(batches):
            if first < 0:
                continue
            word = first + (head >> 1).astype(np.int64)
            at = np.flatnonzero(word >= least if half is None else (word >= least) & (word & 1 == half))
            cell, n = head[at].astype(np.int64) * _ALL + of[near[at].astype(np.int64) - 2], n[at]
            if first < _WORD_BLOCK:
                heads[first // _HEAD_BLOCK] += np.bincount(cell, weights=n, minlength=heads.shape[1]).astype(np.int64)
                continue
            add(first, np.bincount(cell, weights=n))
            if len(rows) == 16:
                yield flush()
        for i in np.flatnonzero(heads.any(axis=1)).tolist():
            add(i * _HEAD_BLOCK, heads[i])
        yield flush()

    return run


def _assign(between: np.ndarray):
    """The class of each word of a block: the greatest first-order gain of likelihood. One
    byte a word, 255 for words that are not given."""
    n = between + 1e-3
    fit = np.log(n * n.sum() / (n.sum(axis=1, keepdims=True) * n.sum(axis=0, keepdims=True)))

    def run(rows: pa.Table) -> pa.Table:
        first = rows["first"][0].as_py()
        size = _HEAD_BLOCK if first < _WORD_BLOCK else _WORD_BLOCK
        counts = np.zeros(size * 2 * _ALL)
        for cells, n in zip(rows["cells"].to_pylist(), rows["n"].to_pylist()):
            counts[np.frombuffer(cells, "<u4")] += np.frombuffer(n, "<u8")
        left, right = counts.reshape(size, 2, _ALL).transpose(1, 0, 2)
        gain = left @ fit[:, :CLASSES] + right @ fit[:CLASSES, :].T
        to = np.where(left.sum(axis=1) > 0, gain.argmax(axis=1), 255).astype(np.uint8)
        return pa.table({"first": pa.array([first], pa.int64()), "to": pa.array([to.tobytes()], pa.binary())})

    return run


def likelihood(between: np.ndarray) -> float:
    """What classes add to a corpus's log likelihood, from their bigram counts."""
    return float(_xlogx(between).sum() - _xlogx(between.sum(axis=0)).sum() - _xlogx(between.sum(axis=1)).sum())


def exchange_all(near: DataFrame, of: np.ndarray, started: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes by word number (closed by those of -2 and -1), and their bigram counts, after
    exchanging all words on their neighbours. The first ``started`` words have a class."""
    share = near.sparkSession.sparkContext.broadcast

    def counted(of: np.ndarray) -> np.ndarray:
        return _cells(near.mapInArrow(_class_bigrams(share(of)), "cell long, n long"), _ALL * _ALL).reshape(_ALL, _ALL).astype(float)

    def moved(of: np.ndarray, between: np.ndarray, least: int, half: int | None) -> np.ndarray:
        cells = near.mapInArrow(_near_classes(share(of), least, half), "first long, cells binary, n binary")
        moves = keep(cells.groupBy("first").applyInArrow(_assign(between), "first long, to binary"), "classes")
        rows = moves.toArrow()
        drop(moves)
        new = of.copy()
        for first, to in zip(rows["first"].to_pylist(), rows["to"].to_pylist()):
            to = np.frombuffer(to, np.uint8)
            at = first + np.flatnonzero(to != 255)
            new[at] = to[to != 255]
        return new

    between = counted(of)
    if started < len(of) - 2:
        of = moved(of, between, started, None)
        between = counted(of)
    while len(of) > 2:
        before = likelihood(between)
        for half in (0, 1):
            new = moved(of, between, 0, half)
            found = counted(new)
            if likelihood(found) > likelihood(between):
                of, between = new, found
        if likelihood(between) - before < LEAST_GAIN * between.sum():
            break
    return of, between


def _histories(stream: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class two before, class before, class) of every token but the leading end. A text
    begins after two ends. ``of`` closes with the classes of -2 and -1."""
    g = of[stream].astype(np.int64)
    two = np.where(stream[:-1] == -2, END, np.concatenate([[END], g[:-2]]))
    return two, g[:-1], g[1:]


def _trigrams(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_ALL ** 3, np.int64)
        for stream in _streams(batches):
            two, one, g = _histories(stream, shared.value)
            total += np.bincount((two * _ALL + one) * _ALL + g, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    return run


def _cells(counted: DataFrame, size: int) -> np.ndarray:
    """Summed counts by cell; there are ``size`` cells, whatever the corpus."""
    summed = counted.groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    written = size > _ALL * _ALL
    summed = keep(summed, "cells") if written else summed
    rows = summed.toArrow()
    if written:
        drop(summed)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def transitions(trigrams: np.ndarray) -> np.ndarray:
    """P(class | two classes before), interpolated by Witten-Bell."""
    def mixed(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        seen, kinds = counts.sum(axis=-1, keepdims=True), (counts > 0).sum(axis=-1, keepdims=True)
        return np.where(seen > 0, (counts + kinds * lower) / np.maximum(seen + kinds, 1), lower)

    single = trigrams.sum(axis=(0, 1))
    one = (single + 1) / (single.sum() + len(single))
    return mixed(trigrams, mixed(trigrams.sum(axis=0), one)[None, :, :])


def _scored(shared):
    """Rows with the model's part that hangs on classes added to each text's sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, transition = shared.value
        for batch in _slices(batches):
            end, parts = np.array([-2], np.int32), [np.array([-2], np.int32)]
            for ids in batch.column(6):
                parts += [np.frombuffer(ids.as_py(), np.int32), end]
            stream = np.concatenate(parts)
            first = np.concatenate([[0], np.flatnonzero(stream[1:] == -2)[:-1] + 1])
            model = batch.column(5).to_numpy() + np.add.reduceat(transition[_histories(stream, of)], first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(model)], batch.schema.names[:6])

    return run


def scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (add-one unigrams) and ``score`` (the class model),
    both log10 of the text's probability, and ``perplexity`` under the model."""
    with small_batches(docs.sparkSession):
        return _scores(docs, text, doc_id)


def _scores(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    given = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"),
        F.col(f"`{text}`").cast("binary").alias("text"),
    )
    partial = given.select("held_out", "text").mapInArrow(_count_words, "word binary, train long")
    counts = keep(partial.groupBy("word").agg(F.sum("train").alias("train")), "words")
    totals = counts.agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    ends = given.where(~F.col("held_out")).count()
    n_train, kinds = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    smooth = n_train + kinds + 1

    numbered, classed, placed = _numbered(counts)
    top = numbered.where(F.col("number") < FREQUENT).toArrow().sort_by("number")
    train = top["train"].to_numpy()
    own = {bytes(w): i for i, w in enumerate(top["word"].to_pylist())}

    unclassed = counts.where(F.col("train") < LEAST_COUNT)
    rare = unclassed.agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count_if(F.col("train") > 0).alias("v"),
        F.count_if(F.col("train") == 1).alias("n1"), F.count_if(F.col("train") == 2).alias("n2"),
    ).first()
    discount = rare["n1"] / (rare["n1"] + 2 * rare["n2"]) if rare["n1"] else 0.5
    unknown = discount * rare["v"] / rare["n"] if rare["n"] else 1.0

    doc_type = given.schema["doc_id"].dataType.simpleString()
    tokens = given.mapInArrow(
        _to_numbers(share((own, np.log10((train + 1) / smooth), np.log10(train)))),
        f"doc_id {doc_type}, {_TOKENS}, other array<binary>, places array<int>")
    tokens = keep(tokens.withColumn("rid", F.monotonically_increasing_id()), "tokens")
    uses = tokens.select("rid", F.explode(F.arrays_zip("other", "places")).alias("x")).select(
        "rid", F.col("x.other").alias("used"), F.col("x.places").alias("at"))
    # What is joined of a word: its number, and its share of a text's three sums.
    n = F.col("train")
    rest = numbered.where(F.col("number") >= FREQUENT).select("word", "train", F.col("number").cast("int").alias("number"))
    facts = rest.union(unclassed.select("word", "train", F.lit(None).cast("int"))).select(
        "word", "number", F.when(n > 0, 1).otherwise(0).alias("k"), F.log10((n + 1) / F.lit(float(smooth))).alias("b"),
        F.when(F.col("number").isNotNull(), F.log10(n)).when(
            n > 0, F.log10((n - discount) / F.lit(float(max(rare["n"], 1))))
        ).otherwise(F.lit(float(np.log10(unknown)))).alias("m"))
    added = uses.join(facts, F.col("used") == F.col("word")).groupBy(F.col("rid").alias("r")).agg(
        *[F.sum(c).alias(c) for c in ("k", "b", "m")],
        F.collect_list(F.when(F.col("number").isNotNull(), F.struct("at", "number"))).alias("found"))
    added = keep(added, "joined")  # its shuffles go before those of the next join come
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    none = F.lit([]).cast("array<struct<at: int, number: int>>")
    whole = tokens.join(added, F.col("rid") == F.col("r"), "left").select(
        "doc_id", "held_out", "n_words", plus("known", "k"), plus("base", "b"), plus("model", "m"), "ids",
        F.coalesce("found", none).alias("found"))
    texts = keep(whole.mapInArrow(_placed, f"doc_id {doc_type}, {_TOKENS}"), "texts")
    drop(tokens, added, counts, placed)

    trained = texts.where(~F.col("held_out")).select("ids")
    width = min(EXCHANGED, classed)
    size = width + 2
    bigrams = _cells(trained.mapInArrow(_bigrams(width), "cell long, n long"), size * size).reshape(size, size).astype(float)
    of = np.full(classed + 2, RARE, np.uint8)
    of[-2] = END
    of[:width] = exchange(bigrams, 2)
    near = neighbours(trained, n_train, classed)
    of, between = exchange_all(near, of, width)
    drop(near)

    trigrams = _cells(trained.mapInArrow(_trigrams(share(of)), "cell long, n long"), _ALL ** 3)
    # A word's emission is its count (in ``model``) over its class's.
    in_class = np.concatenate([np.maximum(between.sum(axis=0)[:CLASSES], 1), [1.0, 1.0]])
    transition = np.log10(transitions(trigrams.reshape(_ALL, _ALL, _ALL))) - np.log10(in_class)
    scored = keep(texts.mapInArrow(
        _scored(share((of, transition))),
        f"doc_id {doc_type}, held_out boolean, n_words long, known long, base double, model double"), "scored")
    drop(texts)
    end = float(np.log10((ends + 1) / smooth))
    named = scored.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.lit(end)).alias("base_score"),
        F.col("model").alias("score"),
    )
    return named.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
