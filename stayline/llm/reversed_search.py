"""Ranked lexical search, reversed: documents stream through an index of the questions.

The items to search for are few beside the documents. So their terms are inverted and
sent to every task, each document's term counts go once through that index, and every
task keeps one bounded heap per item; the heaps are merged by item.

Items are dealt into blocks of a bounded number of (term, item) postings, and the
documents are streamed once per block, so what is sent to the tasks does not grow with the
number of items (only with the longest single one). A first pass over the texts writes,
per document, its length and the counts of terms that any item of the block has; the
statistics (documents, lengths, document frequencies) are counted over all documents from
that table, and the second pass scores it. Scores are 64-bit integers, exact, so ties are
real ties and go to the smaller id.

Defined results: a null text has no terms; items without terms, and items that share no
weighty term with any document, have no rows. Every row of either table stands for
itself: repeated documents take ranks of their own, an item id that comes twice is ranked
twice. Documents without an id come after all others of their score. Empty tables give an
empty result. Items of any id type keep it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from stayline.llm.common import keep, numbered, parts_for

#: Postings of one block of items.
BLOCK = 1 << 18
#: Cells of the score matrix of one batch.
CELLS = 1 << 18
_NO_ID = np.iinfo(np.int64).max

#: Fixed value: ASCII digits and letters, and everything beyond ASCII, make up terms.
_INSIDE = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLDED = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _INSIDE else 0x20 for c in range(256))


def counted(text: bytes | None) -> tuple[int, Counter]:
    """How many terms a text (in UTF-8) has, and how often each."""
    found = (text or b"").translate(_FOLDED).split()
    return len(found), Counter(found)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [list(counted(t)[1]) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(own, pa.list_(pa.binary()))], ["item", "terms"])


def _counting(codes: dict[bytes, int]):
    """Per document its length and the counts of coded terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, times = [], [], []
            for text in batch.column("text"):
                n, own = counted(text.as_py())
                met = [(codes[t], c) for t, c in own.items() if t in codes]
                sizes.append(n)
                found.append([m[0] for m in met])
                times.append([m[1] for m in met])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "times"])

    return run


def weight(total: int, df: int) -> int:
    return floor(1000 * log((2 * total + 2) / (2 * df + 1)))


class Heaps:
    """The ``k`` best documents of every item, as arrays of one row per item."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.scores = np.zeros((items, k), np.int64)
        self.ids = np.full((items, k), _NO_ID, np.int64)

    def update(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in an (items x documents) matrix; only scores that reach the k-th count."""
        least = np.maximum(self.scores[:, -1], 1)
        item, doc = np.nonzero(scores >= least[:, None])
        if not len(item):
            return
        touched = np.unique(item)
        held = np.repeat(touched, self.k)
        rows = np.concatenate([held, item])
        points = np.concatenate([self.scores[touched].ravel(), scores[item, doc]])
        names = np.concatenate([self.ids[touched].ravel(), ids[doc]])
        order = np.lexsort((names, -points, rows))
        rows = rows[order]
        begin = np.searchsorted(rows, touched)
        take = order[(begin[:, None] + np.arange(self.k)).ravel()]
        self.scores[touched] = points[take].reshape(-1, self.k)
        self.ids[touched] = names[take].reshape(-1, self.k)


def _scored(batch: pa.RecordBatch, index: dict, total: int, length: int, heaps: Heaps) -> None:
    """Add one batch of counted documents to the heaps."""
    docs = batch.num_rows
    ids = batch.column("number").fill_null(_NO_ID).to_numpy()
    n = batch.column("n").to_numpy()
    lists, times = batch.column("terms"), batch.column("times").flatten().to_numpy()
    doc = np.repeat(np.arange(docs), np.diff(lists.offsets.to_numpy()))
    term = lists.flatten().to_numpy()
    m = 10 + 90 * n * total // max(length, 1)
    part = index["weights"][term] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
    # Every (document, term) meets all postings of the term.
    many = index["count"][term]
    doc, part = np.repeat(doc, many), np.repeat(part, many)
    first = np.repeat(index["start"][term] - np.cumsum(many) + many, many)
    item = index["items"][first + np.arange(len(doc))]
    scores = np.zeros((len(heaps.scores), docs), np.int64)
    np.add.at(scores.reshape(-1), item * docs + doc, part)
    heaps.update(scores, ids)


def _searching(index: dict, total: int, length: int, items: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, step = Heaps(len(items), k), max(16, CELLS // max(len(items), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                _scored(batch.slice(at, step), index, total, length, heaps)
        item, place = np.nonzero(heaps.scores > 0)
        ids = heaps.ids[item, place]
        yield pa.RecordBatch.from_arrays([
            pa.array(items[item]), pa.array(ids, mask=ids == _NO_ID), pa.array(heaps.scores[item, place])],
            ["item", "number", "score"])

    return run


def _index(postings: dict[int, list[int]], weights: list[int]) -> dict:
    """Postings of all terms as one array, with each term's start, count and weight."""
    count = np.array([len(postings[t]) for t in range(len(postings))], np.int64)
    return {
        "items": np.array([i for t in range(len(postings)) for i in postings[t]], np.int64),
        "count": count, "start": np.cumsum(count) - count, "weights": np.array(weights, np.int64),
    }


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of every task, for one block of items."""
    kind = docs.schema["doc_id"].dataType
    spark = docs.sparkSession
    postings: dict[bytes, list[int]] = defaultdict(list)
    for number, row in enumerate(items):
        for term in row["terms"]:
            postings[bytes(term)].append(number)
    codes = {t: c for c, t in enumerate(sorted(postings))}
    coded = {codes[t]: own for t, own in postings.items()}
    shared = spark.sparkContext.broadcast(codes)
    table = keep(docs.mapInArrow(
        lambda batches: _counting(shared.value)(batches), f"doc_id {kind.simpleString()}, n long, terms array<int>, times array<long>"), "counts")
    whole = table.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    held = dict(table.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    index = _index(coded, [weight(whole["n"], held.get(c, 0)) for c in range(len(codes))])
    sent = spark.sparkContext.broadcast((index, np.array([r["item"] for r in items], np.int64)))
    total, length = whole["n"], whole["l"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers = sent.value
        return _searching(own, total, length, numbers, k)(batches)

    hits = "item long, number long, score long"
    if isinstance(kind, T.IntegralType):
        asked = table.withColumn("number", F.col("doc_id").cast("long"))
        return _in_order(asked).mapInArrow(search, hits).withColumn("doc_id", F.col("number").cast(kind)).drop("number")
    # Ids that are no integers are numbered in their order, so that ties can go by number.
    asked = keep(numbered(table.orderBy(F.col("doc_id").asc_nulls_last()), "number"), "ordered")
    best = keep(_in_order(asked).mapInArrow(search, hits), "hits")
    return best.join(asked.select("number", "doc_id"), "number").select("item", "doc_id", "score")


def _in_order(table: DataFrame) -> DataFrame:
    return table.select("number", "n", "terms", "times")


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id", block: int = BLOCK,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    named = keep(numbered(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("binary").alias("text")), "item"), "items")
    split = named.select("item", "text").mapInArrow(_item_terms, "item long, terms array<binary>")
    ready = keep(split.where(F.size("terms") > 0), "item-terms")
    size = ready.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks = parts_for(size, block)
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    best: DataFrame | None = None
    for number in range(blocks):
        own = ready.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).orderBy("item").collect()
        if own:
            part = _block(given, own, k)
            best = part if best is None else best.unionByName(part)
    if best is None:
        best = named.join(given.select("doc_id"), F.lit(False)).select("item", "doc_id", F.lit(0).cast("long").alias("score"))
    # One row per task, item and rank at most; Spark cuts each task's rows before they move.
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
