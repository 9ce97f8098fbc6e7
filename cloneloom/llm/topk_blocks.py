"""Exact top-k by inner product of integer vectors, with block-at-a-time pruning.

Candidates are dealt to segments by a hash of their id. In a segment they are put into blocks of BLOCK rows, rows of like
direction together, and each block keeps every term's (component's) maximum and minimum and its own forward index, a
matrix. For a query a block's bound is the sum over terms of the larger of weight * maximum and weight * minimum. Blocks
are taken in the order of their bounds and scored, until the next bound is below the k-th score found: an equal bound
is still scored, so ties come out right. The best k of each segment are merged by a window per query.

Queries travel to every segment in chunks, and a task holds one segment and one chunk. Sums are exact in float64 as long
as dim * max|x|**2 < 2**53. Where a table's may be larger, bounds are still summed in float64, raised by what rounding may
have taken, and the rows of the blocks that they leave are scored in whole numbers of any size.

Defined results: unusable vectors (null, empty, null or non-finite components) take no part; vectors of another length than
the query's are no candidates; rows that share an id count once, with the smallest vector; components and scores beyond a
long's range are given as its nearest end, though scores are ranked by their true values within a segment; extra columns
are left out; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ship
from .vectors import clean_vectors, matrix, segments

SEGMENT_ROWS = 8192
BLOCK = 128
CENTRES = 32


def build_blocks(ids: np.ndarray, m: np.ndarray):
    """Rows in an order that puts like directions together, and each block's term maxima and minima."""
    norms = np.sqrt((m * m).sum(1)) + 1e-9
    centres = m[:: max(1, len(m) // CENTRES)][:CENTRES]
    near = np.argmax((m / norms[:, None]) @ (centres / (np.sqrt((centres * centres).sum(1)) + 1e-9)[:, None]).T, axis=1)
    order = np.lexsort((ids, near))
    ids, m = ids[order], m[order]
    starts = np.arange(0, len(m), BLOCK)
    return ids, m, starts, np.maximum.reduceat(m, starts, axis=0), np.minimum.reduceat(m, starts, axis=0)


def exact_products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as Python's integers."""
    weights = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(r, weights, strict=True)) for r in rows.tolist()] + [None], dtype=object)[:-1]


def best_exactly(index, qid: int, q: np.ndarray, bounds: np.ndarray, k: int):
    """As best_of_segment, for products that float64 can't hold."""
    ids, m, starts, high, low = index
    # each of dim products and dim sums is off by 2**-53 of the absolute sum at most; twice that is added
    slack = (np.maximum(np.abs(high), np.abs(low)) @ np.abs(q)) * (4 * (len(q) + 1) * 2.0**-53)
    bounds = bounds + slack
    best: list[tuple[int, int]] = []
    order, at = np.argsort(-bounds, kind="stable"), 0
    while at < len(order) and (len(best) < k or bounds[order[at]] >= best[-1][0] * -1):
        rows = slice(starts[order[at]], starts[order[at]] + BLOCK)
        found = zip(exact_products(m[rows], q), ids[rows].tolist(), strict=True)
        best = sorted([*best, *((-s, i) for s, i in found if i != qid)])[:k]
        at += 1
    ends = np.iinfo(np.int64)
    return np.array([max(ends.min, min(ends.max, -s)) for s, _ in best], np.int64), np.array([i for _, i in best], np.int64), at


def best_of_segment(index, qid: int, q: np.ndarray, bounds: np.ndarray, k: int):
    """The k best (score, id) of one segment for one query, ids other than the query's own, and the blocks scored."""
    ids, m, starts, _, _ = index
    order = np.argsort(-bounds, kind="stable")
    scores, found = np.empty(0), np.empty(0, np.int64)
    kth, at = -np.inf, 0
    while at < len(order) and bounds[order[at]] >= kth:
        take = [b for b in order[at : at + 4] if bounds[b] >= kth]
        at += 4
        for b in take:
            rows = slice(starts[b], starts[b] + BLOCK)
            s, i = m[rows] @ q, ids[rows]
            keep = (i != qid) & (s >= kth)
            scores, found = np.concatenate([scores, s[keep]]), np.concatenate([found, i[keep]])
        if len(scores) > k:
            top = np.lexsort((found, -scores))[:k]
            scores, found = scores[top], found[top]
        if len(scores) >= k:
            kth = scores.min()
    top = np.lexsort((found, -scores))[:k]
    return scores[top], found[top], at


def top_k_products(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score long): the k candidates of largest inner product for each query, smaller ids first
    among equals. vectors and queries: vec_id, v array<double> of whole numbers."""
    ship(vectors.sparkSession)
    dealt = vectors.withColumn("dim", F.size("v"))
    n, big = dealt.agg(F.count("*"), F.max(F.expr("dim * array_max(transform(v, x -> x * x))"))).first()
    best = best_of_segment if (big or 0) < 2**53 else best_exactly
    parts = max(1, -(-n // SEGMENT_ROWS))
    cand = dealt.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("seg"), "dim", F.lit(False).alias("is_query"), "vec_id", "v")
    ask = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("seg"), F.size("v").alias("dim"), F.lit(True).alias("is_query"), "vec_id", "v")
    rows = cand.unionByName(ask).repartition(parts, "seg").sortWithinPartitions("seg", "dim", "is_query", "vec_id")

    def run(batches):
        built, index = None, None
        for key, held, waiting in segments(batches):
            if not held:
                continue
            if built != key:
                ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
                index = build_blocks(ids, np.concatenate([matrix(b.column("v"), b.num_rows) for b in held]))
                built = key
            for b in waiting:
                q = matrix(b.column("v"), b.num_rows)
                bounds = np.maximum(q, 0) @ index[3].T + np.minimum(q, 0) @ index[4].T
                out = [best(index, qid, q[i], bounds[i], k) for i, qid in enumerate(b.column("vec_id").to_pylist())]
                sizes = [len(o[0]) for o in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(b.column("vec_id").to_numpy(), sizes), pa.int64()), pa.array(np.concatenate([o[1] for o in out]), pa.int64()), pa.array(np.concatenate([o[0] for o in out]).astype(np.int64), pa.int64())],
                    names=["query_id", "vec_id", "score"],
                )

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_products(table: DataFrame, scale: int = 64, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Queries: rows whose id is divisible by `every`; candidates: all rows but the query's own; components are
    floor(scale * x)."""
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    vectors = cut(clean_vectors(table, id_col, vec_col, False).select("vec_id", whole.alias("v")))
    return top_k_products(vectors, vectors.where(F.col("vec_id") % every == 0), k)
