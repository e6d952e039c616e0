"""Exact top-k search by inner product with a uniform threshold in three phases.

The dimensions are cut into lists; a vector's entry in a list is its partial product with the query there.

1. Gather: every task reads the best entries of each list and reports the best whole scores among those vectors, and the smallest
   entry of each list. The k-th best whole score over all tasks is a safe lower bound ``tau`` of the k-th best overall.
2. Cut: what lies between the sum of the smallest entries and ``tau`` is shared evenly by the lists. A vector below its share in every
   list scores below ``tau``. The cutoffs are broadcast and tasks keep the vectors that reach one of them.
3. Resolve: only those get their whole scores, in integers; the best k per query remain.

Queries go in blocks of bounded size against all rows, so what is broadcast and collected never grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quire.llm.common import stored

#: Fixed value: components count in 256ths.
SCALE = 256.0
EXACT = 1 << 53


def read_vectors(ids: pa.Array, vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix of floor(256 * x)) of the rows that take part; shorter vectors end in zeros."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    lengths = np.nan_to_num(np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), dtype=np.float64)).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    good[row[~np.isfinite(flat)]] = False
    matrix = np.zeros((len(lengths), width))
    use = good[row] & (place < width)
    matrix[row[use], place[use]] = np.floor(SCALE * flat[use])
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[good].astype(np.int64), matrix[good]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact: float arithmetic below 2^53, Python integers (held to 64 bits at the end) above."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    whole = np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], dtype=object).reshape(b.shape).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1)


def _slices(width: int, lists: int) -> list[slice]:
    edges = [round(i * width / lists) for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            ids, matrix = read_vectors(part.column(0), part.column(1), width)
            if len(ids):
                yield ids, matrix


def _gather(shared, width: int, lists: int, k: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q = shared.value
        best: list[dict[int, int]] = [{} for _ in queries]
        least = np.full((len(queries), lists), math.inf)
        for ids, matrix in _rows(batches, width):
            own = ids[:, None] == queries[None, :]
            total = products(matrix, q)
            picked = np.zeros(total.shape, dtype=bool)
            for j, part in enumerate(_slices(width, lists)):
                local = products(matrix[:, part], q[:, part]).astype(np.float64)
                np.minimum(least[:, j], local.min(axis=0), out=least[:, j])
                local[own] = -math.inf
                n = min(depth, len(ids))
                picked[np.argpartition(-local, n - 1, axis=0)[:n], np.arange(len(queries))] = True
            picked &= ~own
            for c in range(len(queries)):
                mine = np.flatnonzero(picked[:, c])
                mine = mine[np.argsort(-total[mine, c].astype(np.float64), kind="stable")[:2 * k]]
                d = best[c]
                for i in mine:
                    v, s = int(ids[i]), int(total[i, c])
                    d[v] = max(d.get(v, s), s)
                if len(d) > 4 * k:
                    best[c] = dict(sorted(d.items(), key=lambda x: -x[1])[:k])
        rows = [(int(queries[c]), v, s, least[c].tolist()) for c, d in enumerate(best) for v, s in sorted(d.items(), key=lambda x: -x[1])[:k]]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                                              pa.array(columns[3], pa.list_(pa.float64()))], ["query_id", "vec_id", "score", "least"])
    return run


def _resolve(shared, cutoffs, width: int, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q = shared.value
        limits, tau = cutoffs.value
        for ids, matrix in _rows(batches, width):
            reached = np.zeros((len(ids), len(queries)), dtype=bool)
            for j, part in enumerate(_slices(width, lists)):
                reached |= products(matrix[:, part], q[:, part]).astype(np.float64) >= limits[None, :, j]
            reached &= ids[:, None] != queries[None, :]
            row, column = np.nonzero(reached)
            if not len(row):
                continue
            exact = np.concatenate([np.diagonal(products(matrix[row[i:i + 1]], q[column[i:i + 1]])) for i in range(len(row))]) if (
                np.abs(matrix).max() * np.abs(q).max() * width >= EXACT) else np.concatenate(
                [np.einsum("ij,ij->i", matrix[row[i:i + 65536]], q[column[i:i + 65536]]) for i in range(0, len(row), 65536)])
            exact = np.array([int(x) for x in exact], dtype=np.int64)
            keep = exact >= tau[column]
            yield pa.RecordBatch.from_arrays([pa.array(queries[column[keep]]), pa.array(ids[row[keep]]), pa.array(exact[keep])],
                                             ["query_id", "vec_id", "score"])
    return run


def search(vectors: DataFrame, k: int = 5, every: int = 50, lists: int = 2, depth: int = 64, block: int = 1024) -> DataFrame:
    """(vec_id, embedding) to (query_id, rank, vec_id, score): the k best other vectors of each query, ties to the smaller vec_id.

    Queries are the vectors whose vec_id is divisible by ``every``. Rows with a NULL vec_id, a NULL vector, or NULL or non-finite
    components take no part; rows with one vec_id are one vector with its best score, and several query rows of one id use the first
    in vector order. Vectors of different lengths are compared as if they ended in zeros. Fewer other vectors than k: all of them.
    An empty table gives none. At most ``block`` queries are broadcast at once; ``depth`` entries per list are gathered per slice of rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    size = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries")).first()
    width, blocks = max(1, size["width"]), -(-size["queries"] // block)
    schema = "query_id bigint, vec_id bigint, score bigint"
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").where(
        F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    asked = stored(asked.groupBy("query_id").agg(F.min("embedding").alias("embedding")).withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks)))), "topk-queries")
    found = None
    for b in range(blocks):
        mine = asked.where(F.col("block") == b).orderBy("query_id").toArrow()
        ids, matrix = read_vectors(mine.column(0).combine_chunks(), mine.column(1).combine_chunks(), width)
        for at in range(0, len(ids), 2 * block):  # a block is about ``block`` queries; hashing may overfill it
            shared = spark.sparkContext.broadcast((ids[at:at + 2 * block], matrix[at:at + 2 * block]))
            gathered = stored(rows.mapInArrow(_gather(shared, width, lists, k, depth), schema + ", least array<double>"), "topk-gathered")
            least = gathered.groupBy("query_id").agg(*[F.min(F.get("least", F.lit(j))).alias(f"l{j}") for j in range(lists)])
            order = W.partitionBy("query_id").orderBy(F.desc("score"))
            kth = gathered.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
            kth = kth.groupBy("query_id").agg(F.min("score").alias("tau"), F.count("*").alias("n"))
            tau = np.full(len(shared.value[0]), -(1 << 63), dtype=np.int64)
            limits = np.full((len(tau), lists), -math.inf)
            place = {int(v): i for i, v in enumerate(shared.value[0])}
            for r in kth.join(least, "query_id").collect():
                if r["n"] == k:
                    i = place[r["query_id"]]
                    low = [r[f"l{j}"] for j in range(lists)]
                    tau[i] = r["tau"]
                    # a little lower, so that rounding of the share never cuts
                    limits[i] = np.array(low) + (r["tau"] - sum(low)) / lists - 1e-6 * (1 + abs(r["tau"]))
            cutoffs = spark.sparkContext.broadcast((limits, tau))
            part = rows.mapInArrow(_resolve(shared, cutoffs, width, lists), schema)
            part = stored(part.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
                "rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k), "topk-block")
            found = part if found is None else found.unionByName(part)
            shared.unpersist()
            cutoffs.unpersist()
    if found is None:
        found = spark.createDataFrame([], schema + ", rank int")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
