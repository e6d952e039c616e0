"""Compression of vectors to short codes, with codebooks fitted by lexicographic tries over distinct parts.

Components become floor(256 * x). A vector is cut into equal consecutive parts; each part is replaced by the number of the nearest of its
position's entries (squared Euclidean distance, the lower index on ties). Entries start as the parts of the smallest vec_ids; a round assigns all
parts and moves every entry to the floor of its parts' mean, unused entries stay.

A task gathers up to ``BLOCK`` vectors. Per position their distinct parts, with multiplicities, are sorted and walked as a trie in depth-first
order: a node adds its component's squared distance to all entries to what its parent has accumulated, so parts with a common prefix share that
work. Leaves take the argmin, and weigh their part by its multiplicity for the sums. The walk goes in stretches of ``LEAVES`` leaves; the
accumulated distances on the path to the last leaf are carried on. Tasks emit sums per entry, never parts: nothing that grows with the table is
shuffled before the codes are there, and the driver sees entries x dimensions numbers a round.

Rows whose vector is NULL or holds NULL or non-finite components are dropped. The vector of the smallest vec_id that has components gives the number
of dimensions; vectors of another length, empty ones too, have no such parts and are dropped. Rows with equal vec_id each get a code; a NULL
vec_id comes last. Numbers of 2^24 or more (components of 65536 or more) are refused with an error, as sums could leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import stored

#: Fixed value: components count in 256ths.
SCALE = 256.0
BLOCK = 1 << 16
LEAVES = 1 << 12
LIMIT = 1 << 24


def whole(vector: Column) -> Column:
    """floor(256 * x) of every component; NULL for vectors that take no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    near = F.forall(vector, lambda x: F.abs(x.cast("double") * SCALE) < LIMIT)
    checked = F.when(near, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))).otherwise(
        F.raise_error(F.lit("a component is too large for 64-bit sums")).cast("array<int>"))
    return F.when(vector.isNotNull() & finite, checked)


def leaves(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, how often each occurs, and each row's place among them."""
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return rows[first], np.diff(np.append(first, len(rows))), place


def walk(distinct: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depth-first over the trie of sorted distinct parts: (nearest entry, squared distance) per leaf."""
    n, depth = distinct.shape
    nearest, distance = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    # fresh[i, d]: row i opens a node at depth d, that is, it differs from the row before in a component up to d
    fresh = np.ones((n, depth), dtype=bool)
    fresh[1:] = np.logical_or.accumulate(distinct[1:] != distinct[:-1], axis=1)
    path = np.zeros((depth, len(entries)), dtype=np.int64)
    for at in range(0, n, LEAVES):
        rows, opens = distinct[at:at + LEAVES], fresh[at:at + LEAVES]
        above, parent = np.zeros((1, len(entries)), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for d in range(depth):
            own = np.flatnonzero(opens[:, d])
            gap = rows[own, d].astype(np.int64)[:, None] - entries[None, :, d]
            # node 0 of a level is the open one that the stretch before ended in
            sums = np.concatenate([path[d][None, :], above[parent[own]] + gap * gap])
            parent, above = np.cumsum(opens[:, d]), sums
            path[d] = sums[parent[-1]]
        nearest[at:at + LEAVES] = np.argmin(above[parent], axis=1)
        distance[at:at + LEAVES] = above[parent, nearest[at:at + LEAVES]]
    return nearest, distance


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Batches in runs of about ``BLOCK`` rows, with their matrix."""
    held, n = [], 0

    def matrix():
        return np.concatenate([b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for b in held])

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(at, BLOCK))
            n += held[-1].num_rows
            if n >= BLOCK:
                yield held, matrix()
                held, n = [], 0
    if n:
        yield held, matrix()


def _sums(books: list[np.ndarray], dims: int):
    """vectors -> (part, entry, n, sums) of the task's parts that an entry is nearest to."""
    width = dims // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        sums = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for _, matrix in _blocks(batches, 0, dims):
            for j, book in enumerate(books):
                distinct, weight, _ = leaves(matrix[:, j * width:(j + 1) * width])
                nearest, _ = walk(distinct, book)
                np.add.at(counts[j], nearest, weight)
                np.add.at(sums[j], nearest, distinct.astype(np.int64) * weight[:, None])
        rows = [(j, e, int(counts[j][e]), sums[j][e].tolist()) for j in range(len(books)) for e in np.flatnonzero(counts[j])]
        if rows:
            part, entry, n, total = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.list_(pa.int64()))],
                                             ["part", "entry", "n", "sums"])
    return run


def _encode(books: list[np.ndarray], dims: int):
    """(vec_id, label, vector) -> (vec_id, label, code, error)."""
    width = dims // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, matrix in _blocks(batches, 2, dims):
            codes, error = np.empty((len(matrix), len(books)), dtype=np.uint8), np.zeros(len(matrix), dtype=np.int64)
            for j, book in enumerate(books):
                distinct, _, place = leaves(matrix[:, j * width:(j + 1) * width])
                nearest, distance = walk(distinct, book)
                codes[:, j] = nearest[place]
                error += distance[place]
            at = 0
            for batch in held:
                end = at + batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes[at:end]], pa.string()), pa.array(error[at:end])],
                                                 ["vec_id", "label", "code", "error"])
                at = end
    return run


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """The codebooks of a table (vec_id, vector) of equally long whole-number vectors: per part a matrix entries x components."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    matrix = np.array([r["vector"] for r in first], dtype=np.int64)
    if matrix.shape[1] % parts:
        raise ValueError(f"{matrix.shape[1]} dimensions cannot be cut into {parts} equal parts")
    books = [np.ascontiguousarray(b) for b in np.split(matrix, parts, axis=1)]
    for _ in range(rounds):
        found = vectors.select("vector").mapInArrow(_sums(books, matrix.shape[1]), "part int, entry int, n long, sums array<long>")
        moved = (
            found.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        )
        for r in moved:
            books[r["part"]][r["entry"], r["at"]] = r["s"] // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, embedding, label) -> (vec_id, code, error, label_error, codebooks_sha256), a row per vector that takes part; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("codes hold one byte a part: 1 to 256 entries")
    result = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    spark, all_rows = table.sparkSession, table.select("vec_id", "label", whole(F.col("embedding")).alias("vector"))
    some = all_rows.where("size(vector) > 0").orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.size("vector").alias("n")).limit(1).collect()
    if not some:
        return spark.createDataFrame([], result)
    dims = some[0]["n"]
    kept = all_rows.where(F.size("vector") == dims)
    books = fit(kept.select("vec_id", "vector"), parts, entries, rounds)
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    coded = stored(kept.mapInArrow(_encode(books, dims), f"vec_id {fields['vec_id']}, label {fields['label']}, code string, error long"), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
