"""Pages of a document that hold a text (the search behind A-3, A-4 and A-18).

Pages and sought texts of a document meet in one sorted stream, so a text moves once and no posting list is written. Inside a document the tokens of its
pages are an index: a text looks only at the pages of its rarest inner token. The state of a task is the index of one document, which is a cell of the input.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a result batch.
BATCH = 4096


class Pages:
    """The texts of one document by page, and the pages of each token."""

    def __init__(self, numbers: list[int], texts: list[str]):
        self.numbers, self.texts = numbers, texts
        self.tokens = [set(x.split()) for x in texts]
        self.postings: dict[str, list[int]] = {}
        for i, tokens in enumerate(self.tokens):
            for token in tokens:
                self.postings.setdefault(token, []).append(i)
        self._vocabulary: tuple[str, list[int], list[str]] | None = None

    def _tokens_with(self, part: str) -> list[int]:
        """Places of the tokens with ``part``, in which a line break stands for the border of a token."""
        if self._vocabulary is None:
            known, starts, at = list(self.postings), [], 1
            for token in known:
                starts.append(at)
                at += len(token) + 1
            self._vocabulary = ("\n" + "\n".join(known) + "\n", starts, known)
        text, starts, known = self._vocabulary
        pages: set[int] = set()
        at = text.find(part)
        while at >= 0 and len(pages) < len(self.texts):
            k = bisect_right(starts, at + (part[0] == "\n")) - 1
            pages.update(self.postings[known[k]])
            # on from the border behind the token: it begins the next one
            at = text.find(part, starts[k] + len(known[k]))
        return sorted(pages)

    def candidates(self, needle: str) -> list[int]:
        """Pages that may contain ``needle``, none missing: inner tokens stand whole on such a page, the outer ones as ends of tokens."""
        parts = needle.split()
        if len(parts) > 2:
            held = [self.postings.get(token) for token in parts[1:-1]]
            return [] if None in held else min(held, key=len)
        if len(parts) == 2:
            return min(self._tokens_with(parts[0] + "\n"), self._tokens_with("\n" + parts[1]), key=len)
        return self._tokens_with(parts[0]) if parts else list(range(len(self.texts)))

    def holding(self, needle: str) -> Iterator[int]:
        """The pages that contain ``needle``, first ones first."""
        return (i for i in self.candidates(needle) if needle in self.texts[i])

    def overlapping(self, text: str, least: float) -> tuple[int, float] | None:
        """The page with the greatest share of the distinct tokens of ``text`` and that share, if it is ``least`` or more.

        A page that shares k of n tokens holds one of any n - k + 1 of them; the rarest are counted, and the others looked up only on pages that can
        still be the best.
        """
        tokens = sorted(dict.fromkeys(text.split()), key=lambda x: (len(self.postings.get(x, ())), x))
        n = len(tokens)
        k = max(int(n * least), 1)
        met: Counter[int] = Counter()
        for token in tokens[:n - k + 1]:
            met.update(self.postings.get(token, ()))
        best, place = 0, -1
        for i, c in sorted(met.items(), key=lambda x: (-x[1], x[0])):
            if c + k - 1 < best:
                break
            c += sum(token in self.tokens[i] for token in tokens[n - k + 1:])
            if c > best or (c == best and i < place):
                best, place = c, i
        return (place, best / n) if best else None


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, pages, texts) of a stream sorted by document, pages first; both are lists of rows."""
    doc, pages, texts = None, [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != doc:
                if texts:
                    yield doc, pages, texts
                doc, pages, texts = row[0], [], []
            (texts if row[1] else pages).append(row[2:])
    if texts:
        yield doc, pages, texts


def searched(pages: DataFrame, texts: DataFrame, ask: Callable[[object, list, list], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``ask`` tells of each document with texts: ``pages`` and ``texts`` begin with doc_id and have the same other columns, the first an order.

    A document's rows go to one task, in the order of the second column; ``ask`` gets (doc_id, rows of its pages, rows of its texts), without doc_id.
    A document without id has no pages.
    """
    names = texts.columns
    both = pages.where(F.col("doc_id").isNotNull()).select("doc_id", F.lit(0).alias("_kind"), *names[1:]).unionByName(
        texts.select("doc_id", F.lit(1).alias("_kind"), *names[1:]))
    ordered = both.repartition("doc_id").sortWithinPartitions("doc_id", "_kind", names[1])
    fields = _arrow_schema(ordered.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc, own, sought in _documents(batches):
            for row in ask(doc, own, sought):
                out.append(row)
                if len(out) == BATCH:
                    yield _batch(out, fields)
                    out = []
        if out:
            yield _batch(out, fields)

    return ordered.mapInArrow(run, schema)


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
