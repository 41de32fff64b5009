"""SimHash near-duplicates by an inverted index of positional bytes.

A fingerprint has eight bytes. Two fingerprints that differ in at most three bits differ
in at most three bytes, so they share at least five positional bytes (the guaranteed
minimum). The index posts every distinct fingerprint under groups of three positional
bytes, chosen so that any five positions hold one whole group: no linked pair is missed,
and a posting list holds one in 2^24 of unrelated fingerprints. Within a posting list the
shared positional bytes are tallied per pair, pairs below the minimum are dropped, and
the rest are verified by their differing bits.

Documents with one fingerprint are one node, so copies never meet as pairs. A posting
list hands on a spanning forest of its links, not all of them, which leaves the connected
components the same. Long posting lists are posted anew under five positional bytes, and
those still too long are solved by masking: fingerprints that are equal outside three of
the remaining 24 bits are linked to the least of them. Nothing is capped.

Defined results: a null or wordless text has fingerprint zero and is linked like any
other; repeated rows give repeated results; a null id counts as no id, so it is never a
component's id unless all ids of the component are null. An empty table gives an empty
result. Input columns are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stayline.llm.common import as_row, keep
from stayline.llm.components import component_roots

SEED, SHINGLE, MAX_BITS, BYTES = 42, 3, 3, 8
MIN_SHARED = BYTES - MAX_BITS
#: Any five of eight positions hold three of one half.
TRIPLES = tuple(g for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for g in combinations(half, 3))
FIVES = tuple(combinations(range(BYTES), MIN_SHARED))
#: Longest posting lists that are compared pair by pair.
LONG_LIST, LONGEST_LIST = 1024, 8192
_BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a whole UTF-8 text, as an unsigned number."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    total, counts = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, total, _BLOCK):
        part = words[at:at + _BLOCK + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (see ``as_row``) and ``f``, the fingerprint as a signed long."""
    given = docs.select(as_row(docs, carry), F.col(f"`{text}`").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], ["row", "f"])

    schema = given.drop("t").schema.add("f", "long")
    return given.mapInArrow(run, schema)


def _posting(f: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(0xFF << (8 * p) for p in positions)
    return f.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _post(fingerprints: DataFrame, groups: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(g, k, f): every fingerprint under every group of positions."""
    keys = F.array(*[
        F.struct(F.lit(g).alias("g"), _posting(F.col("f"), p).alias("k")) for g, p in enumerate(groups)
    ])
    return fingerprints.select("f", F.explode(keys).alias("key")).select("key.g", "key.k", "f")


def _forest(f: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    parent = list(range(len(f)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    octets, links = f.view(np.uint8).reshape(-1, BYTES), []
    for lo in range(0, len(f) - 1, 256):
        rows, rest = slice(lo, lo + 256), slice(lo + 1, len(f))
        tally = np.zeros((min(256, len(f) - lo), len(f) - lo - 1), np.uint8)
        for p in range(BYTES):
            tally += octets[rows, p, None] == octets[None, rest, p]
        x, y = np.nonzero(tally >= MIN_SHARED)
        x, y = x + lo, y + lo + 1
        good = (np.bitwise_count(f[x] ^ f[y]) <= MAX_BITS) & (x < y)
        for i, j in zip(x[good].tolist(), y[good].tolist()):
            i, j = top(i), top(j)
            if i != j:
                parent[j] = i
                links.append((i, j))
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the posting lists of one partition, which come sorted by list."""
    held: list[np.ndarray] = []
    key = None

    def links() -> Iterator[pa.RecordBatch]:
        f = np.unique(np.concatenate(held)) if held else np.empty(0, np.uint64)
        if len(f) > 1 and (found := _forest(f)):
            ends = f.view(np.int64)[np.array(found)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        g, k, f = (batch.column(i).to_numpy() for i in range(3))
        f = f.astype(np.int64).view(np.uint64)
        cuts = np.flatnonzero((g[1:] != g[:-1]) | (k[1:] != k[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(f)]):
            if key != (g[lo], k[lo]):
                yield from links()
                held, key = [], (g[lo], k[lo])
            held.append(f[lo:hi])
    yield from links()


def _pair_links(postings: DataFrame) -> DataFrame:
    """Links of posting lists of bounded length, each compared in one place."""
    return postings.repartition("g", "k").sortWithinPartitions("g", "k").mapInArrow(_compare, "a long, b long")


def _split(postings: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """Postings of short and of long lists; lists of one fingerprint are dropped."""
    sizes = keep(postings.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("g").alias("lg"), F.col("k").alias("lk"), "n"), "lists")
    known = postings.join(sizes, (F.col("g") == F.col("lg")) & (F.col("k") == F.col("lk")))
    return known.where(F.col("n") <= longest).select("g", "k", "f"), known.where(F.col("n") > longest).select("g", "k", "f")


def _masked_links(postings: DataFrame) -> DataFrame:
    """Links of lists of any length under five equal bytes: stars of those that are equal
    outside three of the other 24 bits, which any two linked ones are for some three."""
    parts = []
    for g, five in enumerate(FIVES):
        bits = [8 * p + b for p in range(BYTES) if p not in five for b in range(8)]
        masks = [sum(1 << b for b in three) for three in combinations(bits, MAX_BITS)]
        masks = np.array(masks, np.uint64).view(np.int64).tolist()
        parts.append((g, masks))
    table = postings.sparkSession.createDataFrame(parts, "mg int, masks array<long>")
    masked = keep(
        postings.join(F.broadcast(table), F.col("g") == F.col("mg"))
        .select("f", F.explode("masks").alias("m"))
        .select("f", "m", F.col("f").bitwiseAND(F.bitwise_not("m")).alias("left")), "masked",
    )
    least = keep(masked.groupBy("m", "left").agg(F.min("f").alias("a"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1").select(F.col("m").alias("lm"), F.col("left").alias("ll"), "a"), "masked")
    return masked.join(least, (F.col("m") == F.col("lm")) & (F.col("left") == F.col("ll"))).select(
        "a", F.col("f").alias("b")).where("a <> b").distinct()


def links_between(fingerprints: DataFrame, long_list: int = LONG_LIST, longest_list: int = LONGEST_LIST) -> DataFrame:
    """Links (a, b) with the components of all pairs of distinct fingerprints (f: long)
    within three differing bits."""
    short, long = _split(_post(fingerprints, TRIPLES), long_list)
    links = _pair_links(short)
    long = keep(long.select("f").distinct(), "long")
    if long.isEmpty():
        return links
    # A pair of a long list is posted together under some five of its shared bytes.
    short, longest = _split(_post(long, FIVES), longest_list)
    links = links.union(_pair_links(short))
    longest = keep(longest, "longest")
    return links if longest.isEmpty() else links.union(_masked_links(longest))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None
) -> DataFrame:
    """``row`` (the columns ``carry``, default all but ``text``), ``fingerprint`` (16 hex
    digits) and ``component_id``, the least id that links reach."""
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    rows = keep(with_fingerprint(docs, text, carry), "fingerprints")
    nodes = keep(rows.groupBy("f").agg(F.min(F.col("row")[doc_id]).alias("least")), "nodes")
    roots = keep(component_roots(links_between(nodes.select("f"))), "roots")
    with_root = nodes.join(roots, F.col("f") == F.col("node"), "left").select(
        "f", F.coalesce("root", "f").alias("root"), "least")
    ids = keep(with_root.groupBy("root").agg(F.min("least").alias("component_id")).select(
        F.col("root").alias("r"), "component_id"), "ids")
    named = keep(with_root.join(ids, F.col("root") == F.col("r")).select(
        F.col("f").alias("node"), "component_id"), "named")
    hexed = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return rows.join(named, F.col("f") == F.col("node")).select("row", hexed.alias("fingerprint"), "component_id")
