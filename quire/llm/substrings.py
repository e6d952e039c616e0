"""Removal of word passages that an earlier document holds, by suffix automata of reference shards.

Two passages of ``length`` words are equal only if they share an anchor: the smallest hash among the word n-grams inside (leftmost of
equals). Consecutive windows of a document with one anchor are one occurrence, whose words are its context.

1. Anchors of all documents are reduced to those that stand in two documents; only their occurrences go on.
2. Occurrences with one context are settled by the smallest document that has it: in every other one all windows are repeats.
3. What remains are contexts of one anchor that differ. Shards of such reference contexts become suffix automata, every state with the
   smallest document of its strings; contexts stream through their shard's automaton, and where the matching statistics reach
   ``length``, the state tells whether a smaller document has the window. An anchor with more than ``widest`` different contexts is
   not held by one task: its windows are compared by a grouped minimum instead, which gives the same.
4. Marks go back to their documents as maximal spans, and the covered words are cut.

An automaton of a shard is made where its contexts are, and not broadcast to all tasks: that would stream every document through
every shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import stored
from quire.llm.words import BASE, Hasher, grams, mix, powers, rows_of

#: Fixed value: words of a passage.
LENGTH = 13
GRAM = 5


def occurrences(hashes: np.ndarray, limits: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window in its row, windows, anchor, context) of the runs of windows that share an anchor, for all rows of a slice."""
    index, row = rows_of(limits, length)
    if not len(index):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    small = mix(grams(hashes, gram))
    # leftmost smallest of the n-grams of each window: (value, place) by doubling steps
    span, width = length - gram + 1, 1
    place = np.arange(len(small))
    value = small
    while width < span:
        step = min(width, span - width)
        n = len(value) - step
        later = value[step:] < value[:n]
        place = np.where(later, place[step:], place[:n])
        value = np.where(later, value[step:], value[:n])
        width += step
    chosen = place[index]
    first = np.ones(len(index), dtype=bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(index)))
    begin, stop = index[at], index[at] + count + length - 1
    with np.errstate(over="ignore"):
        # prefix sums over powers, scaled back to the start of the context
        up, down = powers(len(hashes), BASE), powers(len(hashes), pow(BASE, -1, 1 << 64))
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up, out=sums[1:])
        context = mix((sums[stop] - sums[begin]) * down[begin] + mix(count.astype(np.uint64) + np.uint64(1)))
    # equal anchors at different places of their contexts are different kinds of context
    inside = (chosen[at] - begin).astype(np.uint64)
    return row[at], begin - limits[row[at]], count, small[chosen[at]].view(np.int64), mix(context + inside).view(np.int64)


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, limits, hashes, *_ in hasher.slices(batch.column(1)):
                row, start, count, anchor, context = occurrences(hashes, limits, length, gram)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), pa.array(ids[first + row].astype(np.int64)), pa.array(
                        start.astype(np.int32)), pa.array(count.astype(np.int32))], ["anchor", "context", "doc_id", "start", "windows"])
    return run


def _context_words(length: int, gram: int):
    """Words of the asked contexts (parallel lists start, windows, anchor, context) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids, asked = batch.column(0), batch.column(2)
            for first, limits, hashes, *_ in hasher.slices(batch.column(1)):
                out: list[tuple] = []
                words = hashes.view(np.int64)
                row, start, count, _, context = occurrences(hashes, limits, length, gram)
                edge = np.searchsorted(row, np.arange(len(limits)))
                for r in range(len(limits) - 1):
                    there = {(s, c) for s, c in zip(start[edge[r]:edge[r + 1]].tolist(), context[edge[r]:edge[r + 1]].tolist())}
                    for a in asked[first + r].as_py():
                        if (a["start"], a["context"]) in there:  # another text of this doc_id may have asked
                            b = int(limits[r]) + a["start"]
                            out.append((a["anchor"], a["context"], ids[first + r].as_py(), a["wide"], words[b:b + a["windows"] + length - 1]))
                if out:
                    c = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.bool_()),
                                                      pa.array(c[4], pa.list_(pa.int64()))], ["anchor", "context", "lead", "wide", "words"])
    return run


class Automaton:
    """Generalised suffix automaton of word sequences; every state knows the smallest document that holds its strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [1 << 62]

    def add(self, words: list[int], document: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            if document < self.least[last]:
                self.least[last] = document

    def _extend(self, last: int, w: int) -> int:
        follow, link, size = self.next, self.link, self.size
        q = follow[last].get(w)
        if q is not None:
            return q if size[last] + 1 == size[q] else self._clone(last, q, w)
        new = len(size)
        follow.append({})
        link.append(0)
        size.append(size[last] + 1)
        self.least.append(1 << 62)
        p = last
        while p != -1 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p != -1:
            q = follow[p][w]
            link[new] = q if size[p] + 1 == size[q] else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = len(self.size)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.least.append(self.least[q])
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def finish(self) -> None:
        """Carry the smallest document from longer strings to their suffixes."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[v]
            if self.least[v] < self.least[up]:
                self.least[up] = self.least[v]

    def earliest(self, words: list[int], length: int) -> Iterator[tuple[int, int]]:
        """(window start, smallest document) of every window of ``length`` words that the automaton holds, from the matching statistics."""
        state = have = 0
        follow, link, size = self.next, self.link, self.size
        for i, w in enumerate(words):
            while state and w not in follow[state]:
                state = link[state]
                have = size[state]
            if w in follow[state]:
                state, have = follow[state][w], have + 1
            if have >= length:
                while size[link[state]] >= length:
                    state = link[state]
                have = min(have, size[state])
                yield i - length + 1, self.least[state]


def _sharded(length: int, shard: int = 2000):
    """Rows sorted by anchor: one automaton per run of whole anchors with about ``shard`` contexts."""
    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        machine = Automaton()
        for _, _, lead, words in rows:
            machine.add(words, lead)
        machine.finish()
        out = []
        for anchor, context, lead, words in rows:
            repeats = [j for j, least in machine.earliest(words, length) if least < lead]
            if repeats:
                out.append((anchor, context, repeats))
        if not out:
            return None
        c = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int32()))], ["anchor", "context", "repeats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if len(rows) >= shard and row[0] != rows[-1][0]:
                    if (made := settle(rows)) is not None:
                        yield made
                    rows = []
                rows.append(row)
        if rows and (made := settle(rows)) is not None:
            yield made
    return run


def _cut(length: int, gram: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            k = batch.num_columns - 2
            marks = batch.column(k + 1)
            for first, limits, hashes, begin, end, data, _ in hasher.slices(batch.column(k)):
                n = len(limits) - 1
                total, removed, kept = np.diff(limits), [], []
                asked = [marks[first + r].as_py() for r in range(n)]
                row, start, count, _, context = occurrences(hashes, limits, length, gram) if any(asked) else (None,) * 5
                for r in range(n):
                    a, b = int(limits[r]), int(limits[r + 1])
                    stay = np.ones(b - a, dtype=bool)
                    if asked[r]:
                        x, y = np.searchsorted(row, [r, r + 1])
                        there = dict(zip(start[x:y].tolist(), context[x:y].tolist()))
                        edges = np.zeros(b - a + 1, dtype=np.int64)
                        for m in asked[r]:
                            if there.get(m["start"]) == m["context"]:
                                for j in m["repeats"] if m["repeats"] is not None else range(m["windows"]):
                                    edges[m["start"] + j] += 1
                                    edges[m["start"] + j + length] -= 1
                        stay = np.cumsum(edges[:-1]) == 0
                    removed.append(int((~stay).sum()))
                    words = [data[p:q].tobytes() for p, q in zip(begin[a:b][stay].tolist(), end[a:b][stay].tolist())]
                    if digest:
                        kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    else:
                        # untouched texts stay as they are
                        kept.append(b" ".join(words).decode("utf-8") if removed[-1] else batch.column(k)[first + r].as_py())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, n) for i in range(k)], pa.array(total), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                                 [*batch.schema.names[:k], "n_words", "n_removed", "kept"])
    return run


def marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, widest: int = 256) -> DataFrame:
    """(doc_id, marks): for each document the occurrences whose windows (all, or those in ``repeats``) a smaller document has."""
    known = docs.where("doc_id is not null").select("doc_id", "text")
    made = known.mapInArrow(_anchors(length, gram), "anchor bigint, context bigint, doc_id bigint, start int, windows int")
    shared = made.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    met = stored(made.join(shared, "anchor"), "sub-met")
    lead = met.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "start", "windows")).alias("m")).select(
        "anchor", "context", F.col("m.doc_id").alias("lead"), F.col("m.start").alias("start"), F.col("m.windows").alias("windows"))
    lead = stored(lead, "sub-leads")
    several = lead.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1").select("anchor", (F.col("contexts") > widest).alias("wide"))
    asked = lead.join(several, "anchor").groupBy(F.col("lead").alias("doc_id")).agg(
        F.collect_list(F.struct("anchor", "context", "start", "windows", "wide")).alias("asked"))
    words = known.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(
        _context_words(length, gram), "anchor bigint, context bigint, lead bigint, wide boolean, words array<bigint>")
    words = stored(words.dropDuplicates(["anchor", "context"]), "sub-contexts")
    narrow = words.where("not wide").select("anchor", "context", "lead", "words").repartition("anchor").sortWithinPartitions("anchor", "lead", "context").mapInArrow(
        _sharded(length), "anchor bigint, context bigint, repeats array<int>")
    windows = words.where("wide").select("anchor", "context", "lead", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("words") - (length - 1)), lambda i: F.xxhash64(F.slice("words", i, length)))).alias("j", "window"))
    least = windows.groupBy("window").agg(F.min("lead").alias("least"))
    wide = windows.join(least, "window").where("least < lead").groupBy("anchor", "context").agg(F.collect_list("j").alias("repeats"))
    repeats = narrow.unionByName(wide)
    settled = lead.select("anchor", "context", "lead").join(repeats, ["anchor", "context"], "left")
    told = met.join(settled, ["anchor", "context"]).where("doc_id > lead or repeats is not null").select(
        "doc_id", F.struct("start", "windows", "context", F.when(F.col("doc_id") == F.col("lead"), F.col("repeats")).alias("repeats")).alias("m"))
    return stored(told.groupBy("doc_id").agg(F.collect_list("m").alias("marks")), "sub-marks")


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, widest: int = 256, digest: bool = False) -> DataFrame:
    """Adds n_words, n_removed and kept (the text without repeats; its SHA-256 with ``digest``) to (doc_id, text, others); text goes.

    A word goes when a window of ``length`` words that covers it also stands in a document with a smaller doc_id; windows are those of
    the input. Words are kept as they are and joined by one space; texts that lose nothing stay as they are (their words, joined, make
    the digest). NULL and empty texts have no words; documents with a NULL doc_id lose nothing and take nothing from others; rows with
    one doc_id do not take from each other. An empty table gives none.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept")]
    found = marks(docs, length, gram, widest).withColumnRenamed("doc_id", "_id").withColumnRenamed("marks", "_marks")
    df = docs.join(found, docs["doc_id"] == F.col("_id"), "left").select(*kept, F.col("text").cast("string").alias("text"), "_marks")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema.fields)
    return df.mapInArrow(_cut(length, gram, digest), schema + "n_words bigint, n_removed bigint, kept string")
