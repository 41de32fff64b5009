"""Substring dedup over windows of words, with a count-min prefilter.

Documents are dealt into units of a few megabytes by their id. The first pass hashes every
window; each unit sends a sparse count-min sketch of its windows, one piece per block of
the hash space, and the pieces of a block are merged. Counts saturate at two documents and
only overestimate. Blocks are as many as the corpus needs, so the share of windows that
are wrongly estimated as repeated does not rise with its size. Each unit gets back which
of its cells count two or more.

The second pass groups only windows whose cells all do. A unit sends each such window once,
with the least document id it has for it, so a passage that a third of all documents hold
comes once per unit. Windows are compared by 96 bits of hash within their block. The last
pass removes, from whole texts, the words covered by windows that start in a document with
a smaller id. Texts move once, into buckets that all passes read in place.

Defined results: a null text has no words; texts shorter than a window keep all words; a
null id counts as larger than every id; rows with equal ids do not remove each other's
words. Repeated rows and empty tables go through; input columns are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stayline.llm.common import as_row, keep, keep_bucketed, parts_for, text_bytes

WINDOW = 13
UNIT_BYTES = 4 << 20
#: Windows per block of the sketch, and cells per row of a block.
BLOCK_WINDOWS, CELLS = 1 << 19, 1 << 22
_BYTES_PER_WORD = 6
_NO_ID = (1 << 63) - 1
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _rolled(h: np.ndarray, multiplier: int) -> np.ndarray:
    """Polynomial hash of every run of WINDOW word hashes, modulo 2^64."""
    count, power = len(h) - WINDOW + 1, 1
    total = np.zeros(count, np.uint64)
    for k in range(WINDOW):
        total += h[k:k + count] * np.uint64(power)
        power = power * multiplier % (1 << 64)
    return total


class _Unit:
    """The words and windows of some documents; windows are grouped by equal hash."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray):
        ids = [_NO_ID if i is None else i for i in ids.to_pylist()]
        self.ids = np.array(ids, np.int64)
        self.words = [(t or b"").split() for t in texts.to_pylist()]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(sizes)
        total = int(sizes.sum())
        h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(self.words)), np.uint64, total)
        if total < WINDOW:
            self.a = self.b = np.empty(0, np.uint64)
            self.start = self.own = self.first = self.least = self.most = self.group = np.empty(0, np.int64)
            return
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        whole = np.flatnonzero(doc[WINDOW - 1:] == doc[:total - WINDOW + 1])
        a = _rolled(h, _M1)[whole]
        order = np.argsort(a)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(_M2)
        b = _rolled(mixed ^ (mixed >> np.uint64(32)), _M2)
        self.start = whole[order]
        self.a, self.b, self.own = a[order], b[self.start], self.ids[doc[self.start]]
        first = np.ones(len(a), bool)
        first[1:] = (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1])
        self.first, self.group = np.flatnonzero(first), np.cumsum(first) - 1
        # Least and greatest id of the documents that have each window.
        self.least = np.minimum.reduceat(self.own, self.first) if len(a) else np.empty(0, np.int64)
        self.most = np.maximum.reduceat(self.own, self.first) if len(a) else np.empty(0, np.int64)

    def blocks(self, count: int) -> Iterator[tuple[int, np.ndarray]]:
        """(block, the windows in it) by the high half of the second hash."""
        block = ((self.b[self.first] >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        order = np.argsort(block, kind="stable")
        at = block[order]
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1 if len(at) else []
        for part in np.split(order, cuts) if len(at) else []:
            yield int(block[part[0]]), part

    def cells(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each window in the two rows of its block."""
        a, b = self.a[self.first[part]], self.b[self.first[part]]
        low = np.uint64(CELLS - 1)
        return (b & low).astype(np.uint32), ((a >> np.uint64(20)) & low).astype(np.uint32)


def _pack(cells: np.ndarray) -> bytes:
    """Ascending numbers as their gaps, two or four bytes each."""
    gaps = np.diff(np.sort(cells), prepend=np.uint32(0))
    small = not len(gaps) or gaps.max() < 1 << 16
    return (b"\x02" if small else b"\x04") + gaps.astype("<u2" if small else "<u4").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1)
    return np.cumsum(gaps, dtype=np.int64)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SKETCH = pa.schema([("block", pa.int32()), ("unit", pa.int32()), ("c0", pa.binary()), ("c1", pa.binary())])
_LISTS = pa.schema([("block", pa.int32()), ("unit", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("ids", pa.binary())])
_LOST = pa.schema([("unit", pa.int32()), ("a", pa.binary())])


def _sketch(blocks: int):
    def run(docs: pa.Table) -> pa.Table:
        unit, number = _Unit(docs["id"], docs["text"]), docs["unit"][0].as_py()
        many = unit.most > unit.least
        rows = []
        for block, part in unit.blocks(blocks):
            twice = np.where(many[part], 2, 1)  # two documents are as good as more
            rows.append((block, number, *[_pack(np.repeat(c, twice)) for c in unit.cells(part)]))
        return _table(_SKETCH, rows)

    return run


def _merge(pieces: pa.Table) -> pa.Table:
    """The merged counters of a block; each unit hears which of its cells count two or more."""
    replies = []
    for name in ("c0", "c1"):
        cells = [_unpack(x) for x in pieces[name].to_pylist()]
        counts = np.zeros(CELLS, np.uint8)
        for c in cells:  # saturating: two means two or more
            once, n = np.unique(c, return_counts=True)
            counts[once] = np.minimum(counts[once] + np.minimum(n, 2), 2)
        replies.append([np.unique(c[counts[c] > 1]).astype(np.uint32) for c in cells])
    rows = [
        (block, unit, _pack(x), _pack(y))
        for block, unit, x, y in zip(pieces["block"].to_pylist(), pieces["unit"].to_pylist(), *replies)
        if len(x) and len(y)
    ]
    return _table(_SKETCH, rows)


def _candidates(blocks: int):
    """Windows of a unit whose cells all count two or more, each with its least id."""
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and replies.num_rows:
            unit, number = _Unit(docs["id"], docs["text"]), docs["unit"][0].as_py()
            flagged = {b: (x, y) for b, x, y in zip(*(replies[c].to_pylist() for c in ("block", "c0", "c1")))}
            for block, part in unit.blocks(blocks):
                if block not in flagged:
                    continue
                good = np.ones(len(part), bool)
                for cells, data in zip(unit.cells(part), flagged[block]):
                    known = _unpack(data)
                    at = np.minimum(np.searchsorted(known, cells), len(known) - 1)
                    good &= known[at] == cells
                part = part[good]
                if len(part):
                    at, ids = unit.first[part], unit.least[part]
                    small = 0 <= ids.min() and ids.max() < 1 << 32
                    rows.append((
                        block, number, unit.a[at].astype("<u8").tobytes(),
                        (unit.b[at] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                        (b"\x04" if small else b"\x08") + ids.astype("<u4" if small else "<i8").tobytes(),
                    ))
        return _table(_LISTS, rows)

    return run


def _group(lists: pa.Table) -> pa.Table:
    """Windows of a block grouped exactly; each unit hears which it loses to a smaller id."""
    units = lists["unit"].to_pylist()
    a = [np.frombuffer(x, "<u8") for x in lists["a"].to_pylist()]
    ids = [np.frombuffer(x, "<u4" if x[0] == 4 else "<i8", offset=1).astype(np.int64) for x in lists["ids"].to_pylist()]
    sizes = [len(x) for x in a]
    a, ids = np.concatenate(a), np.concatenate(ids)
    b = np.concatenate([np.frombuffer(x, "<u4") for x in lists["b"].to_pylist()])
    order = np.lexsort((ids, b, a))
    x, y = a[order], b[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    least = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    lost = np.empty(len(a), bool)
    lost[order] = least < ids[order]
    rows, at = [], 0
    for unit, size in zip(units, sizes):
        gone = a[at:at + size][lost[at:at + size]]
        if len(gone):
            rows.append((unit, gone.tobytes()))
        at += size
    return _table(_LOST, rows)


def _remove(schema: pa.Schema, as_given: bool):
    def run(docs: pa.Table, lost: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        unit, texts = _Unit(docs["id"], docs["text"]), docs["text"].to_pylist()
        # Inside the unit: later documents lose what an earlier one has.
        gone = unit.own > unit.least[unit.group]
        if lost.num_rows and len(unit.a):
            lists = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in lost["a"].to_pylist()]))
            at = np.minimum(np.searchsorted(lists, unit.a), len(lists) - 1)
            gone = gone | (lists[at] == unit.a)
        total = int(unit.ends[-1])
        edges = np.zeros(total + 1, np.int64)
        np.add.at(edges, unit.start[gone], 1)
        np.subtract.at(edges, unit.start[gone] + WINDOW, 1)
        covered = np.cumsum(edges)[:total] > 0
        n_words, n_removed, kept = ([None] * docs.num_rows for _ in range(3))
        begin = 0
        for row, (words, end) in enumerate(zip(unit.words, unit.ends.tolist())):
            inside = covered[begin:end]
            n_words[row], n_removed[row] = len(words), int(inside.sum())
            if n_removed[row]:
                words = [words[i] for i in np.flatnonzero(~inside).tolist()]
            whole = as_given and not n_removed[row]
            kept[row], begin = texts[row] if whole else b" ".join(words), end
        return pa.table([
            docs["row"].combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(kept, pa.binary()),
        ], schema=schema)

    return run


def without_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None,
    as_given: bool = False,
) -> DataFrame:
    """``row`` (the columns ``carry``, default all but ``text``), ``n_words``,
    ``n_removed`` and ``kept`` (the kept words joined by one space, or, ``as_given``, the
    text itself where nothing is removed)."""
    size = text_bytes(docs, text)
    units, blocks = parts_for(size, UNIT_BYTES), parts_for(size, BLOCK_WINDOWS * _BYTES_PER_WORD)
    key = F.coalesce(F.col(f"`{doc_id}`"), F.xxhash64(f"`{text}`"))
    dealt = keep_bucketed(docs.select(
        F.pmod(F.xxhash64(key), F.lit(units)).cast("int").alias("unit"),
        F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"),
        as_row(docs, [c for c in docs.columns if c != text] if carry is None else carry),
    ), units, "unit", "units")
    texts = dealt.select("unit", "id", "text").groupBy("unit")
    ddl = "block int, unit int, c0 binary, c1 binary"
    pieces = texts.applyInArrow(_sketch(blocks), ddl)
    flagged = keep(pieces.groupBy("block").applyInArrow(_merge, ddl), "flagged")
    lists = texts.cogroup(flagged.groupBy("unit")).applyInArrow(
        _candidates(blocks), "block int, unit int, a binary, b binary, ids binary")
    lost = keep(lists.groupBy("block").applyInArrow(_group, "unit int, a binary"), "lost")
    out = dealt.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "binary")
    done = dealt.groupBy("unit").cogroup(lost.groupBy("unit")).applyInArrow(_remove(to_arrow_schema(out), as_given), out)
    return done.select("row", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
