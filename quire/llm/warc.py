"""WARC archives with revisit records, and their global capture index.

Writing is plain Spark: every page becomes one record (a text with CRLF line ends; the record separator is the line separator of
Spark's text writer), files are gzip streams of a bounded number of records, committed by Spark's own protocol. Reading parses
whole files by Content-Length and checks every payload against its digest. Each archive gives one locally sorted run of captures;
runs are cut by ranges of (URL key, timestamp, page) and every range merges its runs with a loser tree, so the index is ordered over all
ranges and no task holds more than one range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.llm.common import shared_folder, stored

#: Fixed values of the format.
END = "\r\n\r\n"
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("urlkey string, timestamp string, page_id bigint, archive string, offset bigint, length bigint, payload_bytes bigint, "
           "payload_digest string, record_type string, refers_to bigint")
FIELDS = [p.strip().split(" ")[0] for p in CAPTURE.split(",")]


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a text's UTF-8 bytes: five hex digits are four base32 digits."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, LETTERS)


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds _payload, _bytes, _digest, _first: the largest page_id with an equal payload of at least ``least_bytes`` bytes.

    The digests are reduced before the shuffle, so any number of equal payloads is one row per task; the join back to the pages is
    a plain equi-join that Spark splits when a digest is hot.
    """
    df = pages.withColumn("_payload", F.coalesce(F.col("html"), F.lit(""))).withColumns(
        {"_bytes": F.octet_length("_payload").cast("long"), "_digest": base32_sha1(F.col("_payload"))})
    large = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).alias("_p")).where(F.octet_length("_p") >= least_bytes)
    firsts = large.groupBy(base32_sha1(F.col("_p")).alias("_d2")).agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(firsts, F.col("_digest") == F.col("_d2"), "left").drop("_d2")


def records(typed: DataFrame) -> DataFrame:
    """One column ``record``: the record of each page without its closing line ends. Dates are one second per page id from 2020."""
    revisit = F.coalesce(F.col("page_id") < F.col("_first"), F.lit(False)) | (F.col("page_id").isNull() & F.col("_first").isNotNull())
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    date = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(3_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes"), F.lit(END))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: <urn:page:"), page,
        F.lit(">\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Date: "), date, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("_first"), F.lit(f">\r\nWARC-Profile: {REVISIT_PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_bytes")), F.lit(END))
    return typed.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("_payload"))).alias("record"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = 4000) -> None:
    """Write pages (page_id, url, html) as gzip WARC files of at most ``records_per_file`` records.

    NULL html is an empty payload, NULL url an empty target; repeated rows are records of their own; an empty table writes no record.
    """
    records(with_types(pages, least_bytes)).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(path)


def url_key(uri: str) -> str:
    """Host labels reversed and joined by commas, then the path and query, in lower case."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/?#:]*)(?::\d+)?([^#]*)", uri.lower())
    return ",".join(reversed(m[1].split("."))) + ")" + (m[2] or "/")


def parse_archive(name: str, data: bytes) -> list[tuple]:
    """Captures of one archive, in order of (URL key, timestamp, page). Raises when a record or a payload is damaged."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    out, at = [], 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at} of {name}")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        begin, size = stop + 4, int(fields["Content-Length"])
        body = begin + data[begin:begin + size].index(b"\r\n\r\n") + 4
        full = int(re.search(rb"Content-Length: (\d+)", data[begin:body])[1])
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response":
            payload = data[body:begin + size]
            if len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"damaged payload at byte {at} of {name}")
        end = begin + size
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record without end at byte {at} of {name}")
        page = fields["WARC-Record-ID"][len("<urn:page:"):-1]
        refers = fields.get("WARC-Refers-To")
        out.append((url_key(fields.get("WARC-Target-URI", "")), re.sub(r"\D", "", fields["WARC-Date"]), None if page == "none" else int(page), name, at,
                    end + 4 - at, full, digest, kind, int(refers[len("<urn:page:"):-1]) if refers else None))
        at = end + 4
    out.sort(key=_order)
    return out


def _order(c: tuple) -> tuple:
    return (c[0], c[1], c[2] is not None, c[2] or 0, c[3], c[4])


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives below a folder; each archive's rows form a sorted run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = parse_archive(name.as_py().rsplit("/", 1)[-1], content.as_py())
                if rows:
                    yield _table(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, CAPTURE)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    types = [kinds[p.strip().split(" ")[1]] for p in CAPTURE.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], FIELDS)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so each row costs one match per level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = len(runs)
        self.losers = [-1] * k
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._before(b, a):
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (_order(x), a) < (_order(y), b))

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge_index(captures: DataFrame) -> DataFrame:
    """Captures in global order of (URL key, timestamp, page, archive, offset)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            names = batch.column(3).to_pylist()
            at = 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[at]:
                    runs.setdefault(names[at], []).append(batch.slice(at, i - at))
                    at = i

        def rows(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
            for p in parts:
                for i in range(0, p.num_rows, 512):
                    yield from zip(*[c.to_pylist() for c in p.slice(i, 512).columns])

        out: list[tuple] = []
        for row in LoserTree([rows(p) for p in runs.values()]):
            out.append(row)
            if len(out) == 8192:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    key = ["urlkey", "timestamp", "page_id"]
    return captures.repartitionByRange(*key).sortWithinPartitions("archive", *key, "offset").mapInArrow(run, CAPTURE)


def capture_history(pages: DataFrame, least_bytes: int = 0, records_per_file: int = 4000) -> DataFrame:
    """Archive pages in the shared folder, read the archives back and return their merged index."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes, records_per_file)
    return merge_index(stored(read_captures(pages.sparkSession, path), "warc-runs"))
