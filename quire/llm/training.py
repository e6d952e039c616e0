"""Training-order materialisation: token sequences in a keyed global order, in fixed-stride binary shards.

Documents are encoded and packed, task by task, into sequences of exactly ``length`` token ids (two bytes each, little endian), a
separator after every document, and stored. Running sums of each task's sequences give every sequence its number. A keyed
Feistel permutation with cycle-walking maps the number to a global slot, and ranges of slots are shards. Every record of a shard has
the same stride (the ids and one line end), so a reader seeks straight to any slot and reads on from there.

Spark's text writer writes the records as they are and commits whole shards, so a lost executor leaves none half written.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm.common import release, shared_folder

ROUNDS = 4
#: Large pages let the compression see texts that repeat.
STORE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20), "parquet.enable.dictionary": "false"}
LAYOUT = "path string, sequences bigint, length int, per_shard int, key bigint, stride int"


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (_round(left, key, r) & mask), left
        else:
            left, right = right, left ^ (_round(right, key, r) & mask)
    return (left << bits) | right


def permute(numbers: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed bijection of 0..n-1 (``back``: its inverse). Values outside are permuted again until they fall inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _feistel(numbers.astype(np.uint64), half, key, back)
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = _feistel(out[outside], half, key, back)
    return out.astype(np.int64)


class Merged(dict):
    """Pieces and their packed ids, merged when first asked for."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        if len(self) > 400_000:  # bounds memory
            self.clear()
        packed = self[piece] = np.array(self.merge(piece), dtype="<u2").tobytes()
        return packed


class Encoder:
    """Byte-level BPE ids as little-endian pairs of bytes; distinct pieces of a task are merged once (a piece by itself is split no further).

    Texts are split by the standard library's expressions, which know letters, decimal digits and spaces. Texts with other
    number characters or with the separators that only the library counts as spaces go to the engine that reads the pattern as given.
    """

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.split = regex.compile(pattern).findall
        quick = pattern.replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d").replace(r"[^\s[^\W\d_]\d]", r"(?:_|[^\w\s])")
        self.quick = re.compile(quick).findall if r"\p" not in quick else None
        self.special = regex.compile(r"[\p{No}\p{Nl}\x1c-\x1f]").search
        self.cache = Merged(merge)

    def packed(self, text: str) -> bytes:
        split = self.split if self.quick is None or self.special(text) else self.quick
        return b"".join(map(self.cache.__getitem__, split(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u2").tolist()


def _packed(ranks: bytes, pattern: str, separator: int, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Full sequences of a task as matrices; the last is filled up with separators."""
    encoder, rest, end = Encoder(ranks, pattern), b"", separator.to_bytes(2, "little")
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            parts = [rest]
            for t in batch.column(0).slice(at, 256):
                if text := t.as_py():
                    parts += [encoder.packed(text), end]
            stream = b"".join(parts)
            full = len(stream) // (2 * length) * 2 * length
            if full:
                yield np.frombuffer(stream[:full], dtype="<u2").reshape(-1, length)
            rest = stream[full:]
    if rest:
        yield np.frombuffer(rest + end * (length - len(rest) // 2), dtype="<u2").reshape(1, length)


def _encoded(texts: DataFrame, ranks: bytes, pattern: str, separator: int, length: int) -> DataFrame:
    """(task, at, ids): the sequences of each task in order, encoded once and stored compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for m in _packed(ranks, pattern, separator, length, batches):
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), task, np.int32)), pa.array(np.arange(at, at + len(m))), rows.cast(pa.binary())], ["task", "at", "ids"])
            at += len(m)

    schema, path = "task int, at bigint, ids binary", shared_folder(texts.sparkSession, "sequences")
    texts.mapInArrow(run, schema).write.options(**STORE).parquet(path)
    return texts.sparkSession.read.schema(schema).parquet(path)


def write_shards(docs: DataFrame, path: str, ranks: bytes, pattern: str, separator: int = 50256, length: int = 256, per_shard: int = 16384,
                 key: int = 1, text: str = "text", tasks: int = 20_000) -> dict:
    """Write the sequences of all texts as shards below ``path``, then their layout, and return it.

    Texts are encoded once; the stored sequences are numbered, permuted and sent to the task of their range of slots: one shard, or, beyond ``tasks``
    shards, several that follow each other. The store is given back at the end. The layout is written last, so a folder with a layout is whole.
    NULL and empty texts give nothing; repeated rows are encoded each; no text at all gives no shard; other columns are not read. Ids are below 65536.
    """
    spark = docs.sparkSession
    kept = _encoded(docs.select(F.col(text).cast("string")), ranks, pattern, separator, length)
    sizes = {r["task"]: r["count"] for r in kept.groupBy("task").count().collect()}  # one row per task
    bases = dict(zip(sorted(sizes), accumulate([0] + [sizes[t] for t in sorted(sizes)])))
    total = sum(sizes.values())
    layout = {"path": path, "sequences": total, "length": length, "per_shard": per_shard, "key": key, "stride": 2 * length + 1}
    if total:
        shards = -(-total // per_shard)
        together = -(-shards // tasks)
        base = spark.sparkContext.broadcast(bases)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = base.value
            for batch in batches:
                task, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                names, inverse = np.unique(task, return_inverse=True)
                numbers = at + np.array([first[t] for t in names.tolist()], dtype=np.int64)[inverse] if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(permute(numbers, total, key)), batch.column(2)], ["slot", "ids"])

        placed = kept.mapInArrow(place, "slot bigint, ids binary")
        ranges = placed.repartitionById(-(-shards // together), F.floor(F.col("slot") / (per_shard * together)).cast("int"))
        ranges.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("shard", "slot").select("shard", F.col("ids").cast("string").alias("value")).write.partitionBy("shard").text(path)
    release(kept)
    spark.createDataFrame([layout], LAYOUT).coalesce(1).write.json(f"{path}/_layout")
    return layout


def read_layout(spark: SparkSession, path: str) -> dict:
    """The layout of shards that were written to ``path``, also by another session."""
    return spark.read.schema(LAYOUT).json(f"{path}/_layout").first().asDict() | {"path": path}


def locate(layout: dict, slot: int) -> tuple[int, int]:
    """(shard, byte offset) at which reading resumes."""
    return slot // layout["per_shard"], slot % layout["per_shard"] * layout["stride"]


def read_shards(spark: SparkSession, layout: dict, first: int = 0) -> DataFrame:
    """(slot, shard, offset, number, ids) from slot ``first`` on: records of all shards, with the number of their sequence."""
    schema = "slot bigint, shard int, offset bigint, number bigint, ids binary"
    if not layout["sequences"]:
        return spark.createDataFrame([], schema)
    stride, width, per_shard, n, key = layout["stride"], 2 * layout["length"], layout["per_shard"], layout["sequences"], layout["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                shard = int(name.as_py().split("/shard=")[1].split("/")[0])
                data = np.frombuffer(content.as_buffer(), dtype=np.uint8)
                if len(data) % stride:
                    raise ValueError(f"{name} has no whole number of records")
                data = data.reshape(-1, stride)
                slots = np.arange(len(data), dtype=np.int64) + shard * per_shard
                for at in range(max(0, first - shard * per_shard), len(data), 4096):
                    part, here = np.ascontiguousarray(data[at:at + 4096, :width]), slots[at:at + 4096]
                    rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(part), [None, pa.py_buffer(part)])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(here), pa.array(np.full(len(here), shard, np.int32)), pa.array((here - shard * per_shard) * stride),
                        pa.array(permute(here, n, key, back=True)), rows.cast(pa.binary())], ["slot", "shard", "offset", "number", "ids"])

    # the records of a shard are of one length, so its file is read whole by one task: about per_shard * stride bytes
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(layout["path"])
    return files.where(F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long") >= first // per_shard).select("path", "content").mapInArrow(run, schema)


def materialise(docs: DataFrame, ranks: bytes, pattern: str, **options) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and read them back."""
    return read_shards(docs.sparkSession, write_shards(docs, shared_folder(docs.sparkSession, "training"), ranks, pattern, **options))
