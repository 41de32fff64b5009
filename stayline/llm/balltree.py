"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt into shards by id; each shard becomes a ball tree, packed in one row of
an index table. Queries are packed in blocks. A block meets one shard first, which gives
each query a k-th score that all other shards start from. In a shard, nodes are opened in
the order of their upper bound ``q . centre + |q| * radius``; a query leaves a node whose
bound is below its current k-th score. Scores are integers, computed exactly, and a node
whose bound equals the k-th score is opened too, so ties go to the smaller id.

Every block meets every shard, because the queries are a stated share of the rows; what
one task holds is one shard and one block, whatever the size of the table.

Rows are numbered in the order of their ids, and trees hold the numbers: so every row is
a candidate of its own, ties still go to the smaller id, and ids come back at the end.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no
part, nor do rows without an id. Rows with one id are rows like others: each is found, and
each asks if the id is asked for. A query never finds its own row. Vectors of different
lengths do not meet. Components and scores beyond 64 bits are held at the ends of the
range; scores are ranked before that. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stayline.llm.common import keep, parts_for

SHARD, BLOCK, LEAF = 4096, 256, 64
_EXACT = float(1 << 53)


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): usable vectors as floor(scale * component)."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x")).where(
        "vec_id is not null and x is not null").where(F.forall("x", good))
    most = F.lit(float(1 << 63))
    held = lambda c: F.greatest(F.least(F.floor(c * scale).cast("double"), most), -most)
    return rows.select("vec_id", F.transform("x", held).alias("v"))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        return {k: arrays[k] for k in arrays.files}


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows["vec_id"].to_numpy()
    flat = rows["v"].combine_chunks().flatten().to_numpy()
    order = np.argsort(ids)
    return ids[order], flat.reshape(len(ids), -1)[order]


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A ball tree as arrays. Node 0 is the root; rows of a node are contiguous."""
    order = np.arange(len(ids))
    begin, end, left, right = [0], [len(ids)], [-1], [-1]
    at = 0
    while at < len(begin):
        lo, hi = begin[at], end[at]
        if hi - lo > leaf:
            own = order[lo:hi]
            spread = np.ptp(vectors[own], axis=0) if vectors.shape[1] else np.zeros(1)
            if spread.max() > 0:
                middle = (hi - lo) // 2
                axis = int(spread.argmax())
                order[lo:hi] = own[np.argpartition(vectors[own, axis], middle)]
                left[at], right[at] = len(begin), len(begin) + 1
                begin += [lo, lo + middle]
                end += [lo + middle, hi]
                left += [-1, -1]
                right += [-1, -1]
        at += 1
    ids, vectors = ids[order], vectors[order]
    centres = np.array([vectors[lo:hi].mean(axis=0) for lo, hi in zip(begin, end)])
    radii = np.array([
        np.sqrt(((vectors[lo:hi] - c) ** 2).sum(axis=1).max()) for lo, hi, c in zip(begin, end, centres)
    ])
    return {
        "ids": ids, "vectors": vectors, "centres": centres, "radii": radii,
        "begin": np.array(begin), "end": np.array(end), "left": np.array(left), "right": np.array(right),
    }


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact in doubles or else in Python's integers."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if most < _EXACT:
        return queries @ vectors.T
    exact = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return exact(queries) @ exact(vectors).T


def search(tree: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and scores (queries x k, best first) of the best rows, and which of them are
    rows that score ``least`` or more."""
    count = len(query_ids)
    best = np.full((count, k), -np.inf, object if _scores(queries[:1], tree["vectors"]).dtype == object else float)
    found = np.full((count, k), -1, np.int64)
    kth = least.astype(float).copy()
    lengths = np.sqrt((queries ** 2).sum(axis=1))
    bounds = queries @ tree["centres"].T + lengths[:, None] * tree["radii"]
    # Rounding may not hide a node: the slack is far above it.
    bounds += 1e-9 * (lengths[:, None] * (np.sqrt((tree["centres"] ** 2).sum(axis=1)) + tree["radii"]) + 1)
    heap = [(-np.inf, 0, np.arange(count))]
    while heap:
        _, node, active = heapq.heappop(heap)
        active = active[bounds[active, node] >= kth[active]]
        if not len(active):
            continue
        if tree["left"][node] >= 0:
            for child in (int(tree["left"][node]), int(tree["right"][node])):
                heapq.heappush(heap, (-float(bounds[active, child].max()), child, active))
            continue
        rows = slice(int(tree["begin"][node]), int(tree["end"][node]))
        ids = tree["ids"][rows]
        scores = _scores(queries[active], tree["vectors"][rows])
        scores = np.where(ids[None, :] == query_ids[active, None], -np.inf, scores)
        all_ids = np.concatenate([found[active], np.broadcast_to(ids, scores.shape)], axis=1)
        all_scores = np.concatenate([best[active], scores], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k] if all_scores.dtype != object else np.array(
            [sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k] for s, i in zip(all_scores, all_ids)])
        found[active] = np.take_along_axis(all_ids, order, axis=1)
        best[active] = np.take_along_axis(all_scores, order, axis=1)
        kth[active] = np.maximum(kth[active], best[active, k - 1].astype(float))
    reached = best.astype(float)
    return found, best, (reached >= least[:, None]) & (reached > -np.inf)


_TREES = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("tree", pa.binary())])
_BLOCKS = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("queries", pa.binary())])


def _packed(schema: pa.Schema, make):
    def run(rows: pa.Table) -> pa.Table:
        ids, vectors = _matrix(rows)
        keys = [rows[n][0].as_py() for n in schema.names[:2]]
        return pa.table([[keys[0]], [keys[1]], [make(ids, vectors)]], schema=schema)

    return run


def _numbered(vectors: DataFrame, parts: int, name: str) -> DataFrame:
    return vectors.select(
        F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias(name), "vec_id", "v")


#: Scores of large components may leave 64 bits; 38 digits hold any within a few million
#: components of 64 bits.
_HITS = "query_id long, vec_id long, score string"


def _searched(k: int):
    """Hits of (tree, queries, least) rows; ``least`` is null where nothing is known."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, block, least = (batch.column(i)[row].as_py() for i in range(3))
                block = _unpack(block)
                ids = block["ids"]
                floor = np.frombuffer(least, "<f8") if least else np.full(len(ids), -np.inf)
                found, scores, hit = search(_unpack(tree), ids, block["vectors"], k, floor)
                q, place = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[q]), pa.array(found[q, place]),
                    pa.array([str(int(s)) for s in scores[q, place]]),
                ], ["query_id", "vec_id", "score"])

    return run


def _floors(k: int):
    """The k-th score of each query of a block in its first shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, number, tree, block = (batch.column(i)[row].as_py() for i in range(4))
                block = _unpack(block)
                _, scores, _ = search(_unpack(tree), block["ids"], block["vectors"], k, np.full(len(block["ids"]), -np.inf))
                yield pa.RecordBatch.from_arrays([
                    pa.array([dim], pa.int32()), pa.array([number], pa.int32()),
                    pa.array([scores[:, k - 1].astype("<f8").tobytes()], pa.binary()),
                ], ["d", "b", "least"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, v: whole numbers)."""
    asking = vectors.withColumn("asks", is_query).orderBy("vec_id")
    rows = keep(asking.withColumn("number", F.monotonically_increasing_id()), "vectors")
    vectors, is_query = rows.select(F.col("number").alias("vec_id"), "v", "asks"), F.coalesce("asks", F.lit(False))
    counts = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    shards, blocks = parts_for(counts["n"], SHARD), parts_for(counts["q"], BLOCK)
    trees = keep(_numbered(vectors, shards, "shard").groupBy("dim", "shard").applyInArrow(
        _packed(_TREES, lambda ids, v: _pack(**build(ids, v))), "dim int, shard int, tree binary"), "trees")
    asked = keep(_numbered(vectors.where(is_query), blocks, "block").groupBy("dim", "block").applyInArrow(
        _packed(_BLOCKS, lambda ids, v: _pack(ids=ids, vectors=v)), "dim int, block int, queries binary"), "queries")
    # Shards of a length may be fewer than the numbers: the first is the next there is.
    places = trees.select("dim", "shard")
    order = Window.partitionBy("dim").orderBy("shard")
    ranked = places.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "of", F.count(F.lit(1)).over(Window.partitionBy("dim")))
    first = asked.select("dim", "block").join(ranked, "dim").where(F.col("place") == F.pmod("block", "of"))
    firsts = first.select("dim", "block", "shard").join(asked, ["dim", "block"]).join(trees, ["dim", "shard"])
    floors = keep(firsts.select("dim", "block", "tree", "queries").mapInArrow(
        _floors(k), "d int, b int, least binary"), "floors")
    known = asked.join(floors, (F.col("dim") == F.col("d")) & (F.col("block") == F.col("b"))).drop("d", "b")
    spread = known.join(places, "dim")
    pairs = trees.join(spread.withColumnRenamed("dim", "qd").withColumnRenamed("shard", "qs"),
                       (F.col("dim") == F.col("qd")) & (F.col("shard") == F.col("qs")))
    hits = pairs.select("tree", "queries", "least").mapInArrow(_searched(k), _HITS)
    exact = hits.withColumn("score", F.col("score").cast("decimal(38,0)"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ids = rows.select("number", F.col("vec_id").alias("id"))
    named = ranked.join(ids.toDF("query_id", "asking"), "query_id").join(ids.toDF("vec_id", "found"), "vec_id")
    bound = F.greatest(F.least("score", F.lit((1 << 63) - 1)), F.lit(-(1 << 63))).cast("long")
    return named.select(F.col("asking").alias("query_id"), "rank", F.col("found").alias("vec_id"), bound.alias("score"))
