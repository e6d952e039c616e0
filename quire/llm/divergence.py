"""Divergence of the sources of a language: which other sources differ most, and by which terms.

1. Identical texts of a language are one text with a multiplicity per source; only one copy is moved and tokenized.
2. A task counts terms over its texts, weighted: an occurrence and a document count as often as the text stands in the source. Its tables are
   bounded; they are passed on when they reach ``TABLE`` entries. Spark adds the counts up.
3. A language keeps the terms of at least ``least`` of its documents. Shares are exact integers.
4. Pairs of sources are evaluated sparsely. A term that neither source holds adds the difference of the two shares of an absent term, so all terms
   together add V times that, and only terms that one of them holds are looked at. Blocks of terms and tiles of sources bound every group; a
   block costs its entries times the sources, and sums of blocks are added by Spark.

A term is a run of ASCII letters and characters beyond ASCII; only A-Z are lower-cased. NULL text, lang and source count as empty. Rows are
documents, repeated ones too; other columns are not read. The result holds every ordered pair of sources of a language, as it is asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.llm.common import bounded, stored

#: Fixed value: terms in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Fixed values of the shares.
SCALE, EXTRA = 1_000_000_000, 5
TABLE = 1 << 19
BLOCK = 1 << 16
CELLS = 1 << 20


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, copies): every different text of a language once, with (source, n) for the sources that hold it."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(c, empty).alias(c) for c in ("lang", "source", "text")]).withColumn("key", F.unhex(F.sha2("text", 256)))
    counts = rows.groupBy("lang", "key", "source").agg(F.count("*").alias("n"))
    copies = counts.groupBy("lang", "key").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    return rows.groupBy("lang", "key").agg(F.first("text").alias("text")).join(copies, ["lang", "key"]).select("lang", "text", "copies")


def _tables(counts: dict) -> pa.RecordBatch:
    """Counts and document frequencies of (lang, source) as rows."""
    lang, source, term, n, docs = [], [], [], [], []
    for (a, b), (found, held) in counts.items():
        lang += [a] * len(found)
        source += [b] * len(found)
        term += [t.decode() for t in found]
        n += found.values()
        docs += [held[t] for t in found]
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                      ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        for lang, text, copies in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist()):
            words = TERM.findall(text.as_py().lower())
            own = Counter(words) if len(copies) > 1 or copies[0]["n"] > 1 else None
            for copy in copies:
                found, held = counts.setdefault((lang, copy["source"]), (Counter(), Counter()))
                if own is None:
                    found.update(words)
                    held.update(set(words))
                else:
                    for t, k in own.items():
                        found[t] += k * copy["n"]
                        held[t] += copy["n"]
            if sum(len(found) for found, _ in counts.values()) > TABLE:
                yield _tables(counts)
                counts = {}
    if counts:
        yield _tables(counts)


def term_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, total, entries): the kept terms with their count and (source, n) for the sources that hold them."""
    partial = collapsed(docs).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # dealt by term, both sums below stay in their task; a term brings at most a row per source and table of a task, already added up
    entries = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = entries.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return whole.where(F.col("docs") >= least).select("lang", "term", "total", "entries")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + EXTRA) / (total + EXTRA * terms)), exact; 0 without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + EXTRA)
    whole = F.call_function("div", top, wide(total) + wide(terms) * EXTRA)
    return F.when(terms > 0, whole + 1).otherwise(0).cast("long")


def _evaluate(block: int, tile: int, wide: int, terms: int, names: list[str], absent: np.ndarray, term: np.ndarray, holder: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Twice the sum of differences per (source of the tile, source), each term that both hold counted once on either side."""
    lo, hi = tile * wide, min((tile + 1) * wide, len(names))
    level = np.abs(absent[lo:hi, None] - absent[None, :])
    total = level * terms if block == 0 else np.zeros_like(level)
    order = np.argsort(term, kind="stable")
    term, holder, p = term[order], holder[order], p[order]
    count = int(term[-1]) + 1 if len(term) else 0
    step = max(1, CELLS // len(names))
    for at in range(0, count, step):
        some = slice(*np.searchsorted(term, [at, at + step]))
        row, column = term[some] - at, holder[some]
        shares = np.tile(absent, (min(step, count - at), 1))
        weight = np.full(shares.shape, 2, dtype=np.int64)
        shares[row, column], weight[row, column] = p[some], 1
        for a in range(lo, hi):
            mine = row[column == a]
            if len(mine):
                held = shares[mine]
                total[a - lo] += ((np.abs(held - held[:, a:a + 1]) - level[a - lo]) * weight[mine]).sum(axis=0)
    return total


def _pairs(entries: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    sources = sources.sort_values("at")
    names, absent, first = sources["source"].tolist(), sources["absent"].to_numpy(np.int64), sources.iloc[0]
    term = pd.factorize(entries["term"])[0].astype(np.int64)
    total = _evaluate(int(first["block"]), int(first["tile"]), int(first["wide"]), int(first["terms"]), names, absent, term,
                      entries["at"].to_numpy(np.int64), entries["p"].to_numpy(np.int64))
    lo = int(first["tile"]) * int(first["wide"])
    a, b = np.nonzero(total if first["block"] else np.ones_like(total))
    other = (a + lo) != b
    a, b = a[other], b[other]
    names = np.array(names, dtype=object)
    return pd.DataFrame({"lang": first["lang"], "source": names[a + lo], "item": names[b], "value": total[a, b]})


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources, part ``term`` the terms a source has more of than its language."""
    kept = stored(term_counts(docs, least), "terms")
    held = kept.select("lang", "term", "total", F.inline("entries"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.size("entries")).alias("entries"), F.sum("total").alias("lang_total"))
    by_source = held.groupBy("lang", "source").agg(F.sum("n").alias("source_total"))
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    sources = stored(
        every.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
        .select("lang", "source", zero("source_total"), zero("terms"), zero("entries"), zero("lang_total"))
        .withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("wide", F.expr(f"cast(greatest(1, {CELLS} div count(*) over (partition by lang)) as int)"))
        .withColumn("tiles", F.expr("cast(ceil(count(*) over (partition by lang) / wide) as int)"))
        .withColumn("blocks", (F.expr(f"entries div {BLOCK}") + 1).cast("int"))
        .withColumn("absent", share(F.lit(0), F.col("source_total"), F.col("terms"))), "sources")
    by_group = bounded(sources)
    shares = held.join(by_group, ["lang", "source"]).select(
        "lang", "source", "term", "at", "tiles", "blocks", share(F.col("n"), F.col("source_total"), F.col("terms")).alias("p"),
        share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    )
    per_tile = lambda df: df.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = per_tile(shares.withColumn("block", F.expr("cast(pmod(xxhash64(term), blocks) as int)"))).select("lang", "block", "tile", "term", "at", "p")
    beside = per_tile(sources.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).select(
        *[F.col(c).alias(c) for c in ("lang", "block", "tile", "source", "at", "wide", "terms", "absent")])
    key = ["lang", "block", "tile"]
    dealt = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])
    sums = dealt.groupBy(*key).cogroup(beside.groupBy(*key)).applyInPandas(_pairs, "lang string, source string, item string, value long")
    both = sums.groupBy("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")).agg(F.expr("sum(value) div 2").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = both.select("lang", "value", F.inline(ways)).withColumn("rank", F.row_number().over(ranked))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
