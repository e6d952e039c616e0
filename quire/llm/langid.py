"""Language identification by known words first and character n-grams behind them.

A word that the model knows scores by its log frequency in each language. A word it does not know is cut, from its start, into the
longest known character n-grams (word edges marked); each scores by the log frequency of its order, and an unknown character counts
nothing. A text takes the language with the highest mean over its words.

The model is learned by Spark from a bounded sample of labelled documents: words and n-grams are counted by shuffles with map-side
sums, the most frequent per language are kept, and only that bounded table reaches the driver and the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.llm.common import stored

#: Fixed value: the language of a text without letters.
NONE = "und"
ORDERS = 4
#: Letters as in learning: number characters are none.
TOKEN = regex.compile(r"\p{L}+")


def learnable(text: Column, lang: Column) -> Column:
    return text.isNotNull() & lang.isNotNull()


def sample_documents(docs: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` documents of each language, taken by a hash of the text; all of a language that has fewer.

    Counts come from one aggregation over all rows; a language with a third of all rows is thinned where it is read.
    """
    known = docs.where(learnable(F.col("text"), F.col("lang"))).select("lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("rows")).withColumnRenamed("lang", "_lang")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    return known.join(F.broadcast(counts.orderBy(F.desc("rows"), "_lang").limit(1000)), known["lang"] == F.col("_lang")).where(
        place < F.lit(per_lang) / F.col("rows") * (1 << 20)).select("lang", "text")


def learn(docs: DataFrame, per_lang: int = 3000, words_kept: int = 20000, grams_kept: int = 20000) -> dict:
    """Log frequencies from (text, lang) rows.

    Bounds: about ``per_lang`` documents, ``words_kept`` words and ``grams_kept`` n-grams of each order per language, 1000 languages
    (the most frequent). No labelled text gives a model without languages.
    """
    words = stored(sample_documents(docs, per_lang).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
                   .groupBy("lang", "word").agg(F.count("*").alias("n")), "langid-words")

    def top(counted: DataFrame, by: list[str], kept: int) -> list:
        ranked = counted.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "word"))).where(F.col("r") <= kept)
        return ranked.drop("r").collect()

    edged = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    pieces = [words.select("lang", "n", F.lit(k).alias("k"), F.explode(F.when(F.length(edged) >= k, F.transform(
        F.sequence(F.lit(1), F.length(edged) - k + 1), lambda i: F.substring(edged, i, F.lit(k))))).alias("word")) for k in range(1, ORDERS + 1)]
    grams = pieces[0]
    for p in pieces[1:]:
        grams = grams.unionByName(p)
    sums = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sums)
    at = {x: i for i, x in enumerate(langs)}

    def table(rows: list, totals: list[float]) -> dict[str, list[float]]:
        floor = [math.log(0.5 / max(t, 1.0)) for t in totals]
        out: dict[str, list[float]] = {}
        for r in rows:
            i = at[r["lang"]]
            out.setdefault(r["word"], floor.copy())[i] = math.log(r["n"] / totals[i])
        return out

    known = table(top(words, ["lang"], words_kept), [float(sums[x]) for x in langs])
    rows = top(grams.groupBy("lang", "k", "word").agg(F.sum("n").alias("n")), ["lang", "k"], grams_kept)
    parts: dict[str, list[float]] = {}
    for k in range(1, ORDERS + 1):
        mine = [r for r in rows if r["k"] == k]
        totals = [0.0] * len(langs)
        for r in mine:
            totals[at[r["lang"]]] += r["n"]
        parts.update(table(mine, totals))
    return {"langs": langs, "words": known, "grams": parts}


def word_scores(model: dict, word: str) -> list[float]:
    """Log frequency of a lower-case word per language, backing off to shorter and shorter n-grams."""
    got = model["words"].get(word)
    if got is not None:
        return got
    grams, marked = model["grams"], f"<{word}>"
    out = [0.0] * len(model["langs"])
    at, used = 0, 0
    while at < len(marked):
        for k in range(min(ORDERS, len(marked) - at), 0, -1):
            part = grams.get(marked[at:at + k])
            if part is not None:
                out = [a + b for a, b in zip(out, part)]
                used += 1
                at += k
                break
        else:
            at += 1
    return out


def classify(model: dict, text: str | None, cache: dict[str, list[float]]) -> tuple[str, float]:
    """(language, score): the score is the share of the best language when mean log frequencies are turned into shares."""
    counts = Counter(TOKEN.findall(text.lower())) if text else Counter()
    langs = model["langs"]
    if not counts or not langs:
        return NONE, 0.0
    if len(cache) > 200_000:  # bounds memory
        cache.clear()
    sums = [0.0] * len(langs)
    for word, n in counts.items():
        scores = cache.get(word)
        if scores is None:
            scores = cache[word] = word_scores(model, word)
        for i, s in enumerate(scores):
            sums[i] += n * s
    total = sum(counts.values())
    best = max(range(len(langs)), key=lambda i: (sums[i], -i))
    shares = [math.exp((s - sums[best]) / total) for s in sums]
    return langs[best], 1.0 / sum(shares)


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row, from the whole text alone; equally named columns and the text go.

    NULL texts and texts without a letter are ``und`` with score 0, and so are all texts when the model has no language; equal
    scores take the first language in code point order.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", text)]
    df = docs.select(*kept, F.col(text).cast("string").alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[:-1]) + "lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[float]] = {}
        for batch in batches:
            found = [classify(shared.value, t.as_py(), cache) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"])

    return df.mapInArrow(run, schema)
