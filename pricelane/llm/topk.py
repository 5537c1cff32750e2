"""Exact top-k search by distributed histogram selection.

For each query the kth best score is located first: every pass scores all candidates, counts the scores
within the query's current interval in `bins` equal bins, adds the counts of all tasks, and narrows the
interval to the bin that holds the kth score, until that bin is one integer wide or holds few scores.
The last pass keeps the scores from the located value up. Scores are integers and computed exactly, so
the passes agree, and ties go to the smaller id.

A pass moves counts, never scores. A task sends only the top bins up to its own kth score, as the
global kth cannot lie below it, and of the final scores its own best k at most, which drops no row that
could be in the result. Queries are a stated set; they are taken in chunks of at most `chunk_rows`,
whose vectors are sent to all tasks, and each chunk meets all candidates in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

EXACT_FLOAT, EXACT_LONG = 2 ** 53, 2 ** 63
BLOCK = 1024
COUNTS = "query int, bin int, n long"
FOUND = "query_id long, vec_id long, score long, member int, own long, copies long"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the components as floor(scale * x). Rows with a null vec_id, a null vector or a
    null or non-finite component take no part."""
    x = F.col("embedding")
    valid = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(valid, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def by_size(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of components, ids, matrix) for each vector length of a batch."""
    lengths = np.diff(np.asarray(vectors.offsets))
    flat, ids = np.asarray(vectors.flatten()), np.asarray(ids)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield int(size), ids[rows], flat[starts[rows][:, None] + np.arange(size)]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of `q` with all rows of `c`; beyond the range of a long they
    are held at its ends."""
    top = lambda m: max((abs(int(m.max())), abs(int(m.min()))) if m.size else (0,))
    bound = top(q) * top(c) * max(1, q.shape[1])
    if bound < EXACT_FLOAT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < EXACT_LONG:
        return q @ c.T
    wide = q.astype(object) @ c.astype(object).T
    return np.clip(wide, -EXACT_LONG, EXACT_LONG - 1).astype(np.int64)


def own_score(row: np.ndarray) -> int:
    """The score of a row with itself."""
    return int(products(row[None, :], row[None, :])[0, 0])


def blocks(batches: Iterator[pa.RecordBatch], queries: dict) -> Iterator[tuple]:
    """(query numbers, candidate ids, scores, mask of the pairs that count) for blocks of candidates. Only
    queries that bring ids of their own never meet these."""
    for batch in batches:
        for size, ids, matrix in by_size(batch.column(0), batch.column(1)):
            if size not in queries:
                continue
            numbers, own, q = queries[size]
            for at in range(0, len(ids), BLOCK):
                part = ids[at:at + BLOCK]
                scores = products(q, matrix[at:at + BLOCK])
                yield numbers, part, scores, np.ones(scores.shape, bool) if own is None else own[:, None] != part[None, :]


def counting(queries: dict, low: np.ndarray, width: np.ndarray, k: int, bins: int, above: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(low), bins), np.int64)
        for numbers, _, scores, counted in blocks(batches, queries):
            # in floats for scores of any size: a bin may be off by rounding only where all are wide
            place = (scores - low[numbers][:, None]) // width[numbers][:, None]
            inside = counted & (place >= 0) & (place < bins) & (scores >= low[numbers][:, None])
            rows, columns = np.nonzero(inside)
            flat = np.bincount(rows * bins + place[rows, columns], minlength=len(numbers) * bins)
            counts[numbers] += flat.reshape(len(numbers), bins)
        # the bins from the top until this task alone has what is still looked for
        after = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (after < (k - above)[:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])],
            names=["query", "bin", "n"])
    return run


def selecting(queries: dict, ids: np.ndarray, own: np.ndarray, copies: np.ndarray, low: np.ndarray, k: int):
    def best(found: list) -> list:
        q, c, s = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((c, -s.astype(object) if len(s) and s.min() == -EXACT_LONG else -s, q))
        q, c, s = q[order], c[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        return [(q[rank < k], c[rank < k], s[rank < k])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [(np.zeros(0, np.int64),) * 3], 0
        for numbers, candidates, scores, counted in blocks(batches, queries):
            rows, columns = np.nonzero(counted & (scores >= low[numbers][:, None]))
            found.append((numbers[rows], candidates[columns], scores[rows, columns]))
            held += len(rows)
            if held > 4 * k * len(ids) + 100_000:
                found = best(found)
                held = len(found[0][0])
        q, c, s = best(found)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[q]), pa.array(c), pa.array(s), pa.array(q.astype(np.int32)), pa.array(own[q]),
             pa.array(copies[q])], names=["query_id", "vec_id", "score", "member", "own", "copies"])
    return run


def _chunk(candidates: DataFrame, wanted: DataFrame, k: int, bins: int, norm: float, by_row: bool) -> DataFrame:
    """The selected scores of one bounded chunk of queries, with the query's number in the chunk (member),
    its score with itself (own, only `by_row`) and how many equal rows it stands for (copies); final ranks are
    left to the caller."""
    table = wanted.toArrow().combine_chunks()  # at most chunk_rows rows, see top_k
    ids, copies = (np.asarray(table[c]).astype(np.int64) for c in ("vec_id", "copies"))
    queries, bound, selves = {}, np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    at = 0
    for batch in table.select(["vec_id", "v"]).to_batches():
        places = pa.array(np.arange(at, at + len(batch)))
        at += len(batch)
        for size, numbers, matrix in by_size(places, batch.column(1)):
            queries.setdefault(size, []).append((numbers, matrix))
            bound[numbers] = np.sqrt((matrix.astype(np.float64) ** 2).sum(1)) * norm
            if by_row:
                selves[numbers] = [own_score(row) for row in matrix]
    queries = {size: [np.concatenate(x) for x in zip(*parts)] for size, parts in queries.items()}
    queries = {size: (n, None if by_row else ids[n], m) for size, (n, m) in queries.items()}
    # |score| is at most the product of the norms; 1 and a millionth are for rounding
    most = np.minimum(bound * (1 + 1e-6) + 1, 2.0 ** 61).astype(np.int64)
    low, width = -most, np.maximum(1, -(-(2 * most + 1) // bins))
    above, open_ = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    if norm * (bound.max(initial=0) + 1) >= 2.0 ** 61:  # scores may be held at the ends of a long
        open_[:], low[:] = False, -EXACT_LONG
    while open_.any():
        parts = {size: (n[open_[n]], None if own is None else own[open_[n]], m[open_[n]])
                 for size, (n, own, m) in queries.items()}
        parts = {size: x for size, x in parts.items() if len(x[0])}
        sent = candidates.mapInArrow(counting(parts, low, width, k, bins, above), COUNTS)
        total = np.zeros((len(ids), bins), np.int64)
        for r in sent.groupBy("query", "bin").agg(F.sum("n").alias("n")).toArrow().to_batches():
            total[np.asarray(r["query"]), np.asarray(r["bin"])] = np.asarray(r["n"])
        from_top = above[:, None] + total[:, ::-1].cumsum(1)[:, ::-1]
        for i in np.flatnonzero(open_):
            hit = np.flatnonzero(from_top[i] >= k)
            if not len(hit):  # fewer than k candidates: all are in the result
                low[i], open_[i] = -EXACT_LONG, False
                continue
            b = int(hit[-1])
            above[i] = from_top[i, b] - total[i, b]
            low[i] += b * width[i]
            if width[i] == 1 or from_top[i, b] <= 2 * k:
                open_[i] = False
            else:
                width[i] = max(1, -(-int(width[i]) // bins))
    return candidates.mapInArrow(selecting(queries, ids, selves, copies, low, k), FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, bins: int = 512,
          chunk_rows: int = 8192, by_row: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the `k` rows of `vectors` (vec_id,
    embedding) with the highest inner product of their integer components, ties to smaller ids.

    is_query: a condition on vec_id. A query never meets rows of its own id. Rows without an id, and
    vectors that are null or hold a null or non-finite component, take no part; vectors of different
    lengths never meet. A query with fewer than k candidates gets all of them, an empty table gives no
    rows. If an id is repeated, its smallest vector is the query, and every row is a candidate.

    `by_row`: every row that fits is_query is a query of its own, which meets all rows but itself, those of
    its id too; queries of one id have equal query_id. Equal rows are searched once. One more than k is found
    for each, then one row with the query's id and its score with itself is taken out: that is the query, or
    a row that the result could not tell from it.
    """
    spark = vectors.sparkSession
    candidates = quantized(vectors, scale)
    wanted = candidates.filter(is_query)
    if by_row:
        queries, most = wanted.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")), k + 1
    else:
        queries, most = wanted.groupBy("vec_id").agg(F.min("v").alias("v"), F.lit(1).alias("copies")), k
    count = queries.count()
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    norm = float(candidates.agg(F.max(square)).first()[0] or 0.0) ** 0.5
    chunks = -(-2 * count // chunk_rows) if count > chunk_rows else 1
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks))
    parts = [_chunk(candidates, queries.filter(place == i), most, bins, norm, by_row).withColumn("chunk", F.lit(i))
             for i in range(chunks) if count]
    found = reduce(DataFrame.unionAll, parts, spark.createDataFrame([], FOUND).withColumn("chunk", F.lit(0)))
    best = Window.partitionBy("chunk", "member").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    if by_row:
        itself = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))
        first = F.min(itself).over(Window.partitionBy("chunk", "member"))
        ranked = (ranked.withColumn("first", first).filter(~F.col("rank").eqNullSafe(F.col("first")))
                  .withColumn("rank", F.when(F.col("rank") > F.col("first"), F.col("rank") - 1).otherwise(F.col("rank"))))
    return ranked.filter(F.col("rank") <= k).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))) \
        .select("query_id", "rank", "vec_id", "score")
