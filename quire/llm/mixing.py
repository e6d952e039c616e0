"""Mixing sources to target weights with a low-discrepancy schedule, DataFrame operations only.

Every source is a stream of words: its documents in shuffled (hash) order, repeated once when the stream ends. The stream is cut
into blocks of equally many words. A schedule walks the golden-ratio points ``frac(n * phi)`` through the cumulative target
shares; the r-th slot that falls to a source takes that source's r-th block, so every prefix of the mix is close to the target
shares, whatever its length. Slots that the points still owe a source at the end are appended.

Nothing is gathered per source: positions in a source's stream come from prefix sums over hash buckets (one small row per source
and bucket, then a window inside a bucket), slot ranks from prefix sums over chunks of the schedule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.llm.common import stored

#: Weights of the sources in code point order, repeating; share of all words to take; most passes over a source.
WEIGHTS = [3.0, 1.0, 2.0]
SHARE = 1.5
PASSES = 2
PHI = 0.6180339887498949


def text_words(text: Column) -> Column:
    """Words of a text (NULL: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target): weighted shares, none above ``passes`` times its size.

    With r = passes * size / weight, sources stop in ascending r. If those before a source in that order stop, the rest share what
    is left at one rate per weight. The rate rises while sources stop and falls afterwards, so the right one is the largest.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_stop = W.orderBy("r", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    rest = by_stop.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    cap = F.col("source_size") * float(passes)
    rates = ranked.withColumn("r", cap / F.col("weight")).withColumn(
        "rate", (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.when(F.max((F.col("rate") <= F.col("r"))).over(everything), F.max("rate").over(everything))
    return rates.withColumn("level", level).select(
        "source", "source_size", "weight", F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight"))).alias("target"))


def _places(docs: DataFrame, bits: int) -> DataFrame:
    """Adds ``start``: the words of the source before this document in its shuffled order."""
    hashed = docs.withColumn("h", F.xxhash64("doc_id", "tie")).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    base = sums.withColumn("base", F.coalesce(F.sum("words").over(
        W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = base.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "base")
    inside = F.coalesce(F.sum("size").over(
        W.partitionBy("source", "bucket").orderBy("h", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return hashed.withColumn("inside", inside).join(
        base, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).withColumn("start", F.col("base") + F.col("inside"))


def schedule(targets: DataFrame, block: int, total: int, chunk: int = 1 << 14, cells: int = 1024) -> DataFrame:
    """The slots of the mix: (slot, source, rank). ``targets`` has one row per source, ``total`` the words of the whole mix."""
    spark = targets.sparkSession
    slots = -(-total // block)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    whole = F.sum("target").over(W.partitionBy(F.lit(1)))
    high = F.sum("target").over(by_name.rowsBetween(W.unboundedPreceding, 0)) / whole
    low = F.coalesce(F.sum("target").over(by_name.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / whole
    shares = targets.where("target > 0").select("source", F.ceil(F.col("target") / block).alias("owed"), low.alias("low"), high.alias("high"))
    spread = shares.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * cells).cast("int"), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)).cast("int"))))
    u = (F.col("slot") + 0.5) * PHI
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("u", u - F.floor(u)).withColumn(
        "cell", F.floor(F.col("u") * cells).cast("int")).withColumn("chunk", F.floor(F.col("slot") / chunk))
    # a point above the last rounded limit belongs to the last source
    hits = points.join(spread, "cell").where((F.col("low") <= F.col("u")) & ((F.col("u") < F.col("high")) | (F.col("high") > 1 - 1e-9)))
    counts = hits.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(
        W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = base.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"), "base")
    ranked = hits.withColumn("inside", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1).join(
        base, F.col("source").eqNullSafe(F.col("s2")) & (F.col("chunk") == F.col("c2")))
    walked = ranked.withColumn("rank", F.col("base") + F.col("inside")).where("rank < owed").select("slot", "source", "rank")
    given = counts.groupBy("source").agg(F.sum("n").alias("given")).withColumnRenamed("source", "s2")
    owed = shares.join(given, F.col("source").eqNullSafe(F.col("s2")), "left").withColumn("given", F.coalesce("given", F.lit(0)))
    late = owed.where("given < owed").withColumn("rank", F.explode(F.sequence(F.col("given"), F.col("owed") - 1))).select(
        (F.lit(slots) + F.col("rank")).alias("slot"), "source", "rank")
    return walked.unionByName(late)


def _runs(docs: DataFrame, block: int, weights: list[float], share: float, passes: int) -> DataFrame:
    """One row per distinct (doc_id, source, text): its copies, the words of one, and the words the mix takes of all of them.

    Equal rows cannot be told apart, so they lie side by side in their source's stream as one run of words.
    """
    narrow = docs.select("doc_id", "source", text_words(F.col("text")).alias("one"), F.xxhash64("text").alias("tie"))
    counted = stored(narrow.groupBy("doc_id", "source", "one", "tie").agg(F.count("*").alias("copies"))
                     .withColumn("size", F.col("one") * F.col("copies")), "mix-sizes")
    totals = counted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count("*").alias("rows")).first()
    sizes = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, passes), "mix-targets")
    near = targets.select(F.col("source").alias("s3"), "source_size", "target")
    bits = max(1, min(40, (int(totals["rows"]) // 2048).bit_length()))
    placed = _places(counted.where("size > 0"), bits).join(near, F.col("source").eqNullSafe(F.col("s3")))
    placed = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn(
        "first", F.col("start") + F.col("pass") * F.col("source_size"))
    placed = placed.withColumn("last", F.least(F.col("first") + F.col("size"), F.round("target").cast("long"))).where("first < last")
    pieces = placed.withColumn("rank", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block)))).withColumn(
        "words", F.least(F.col("last"), (F.col("rank") + 1) * block) - F.greatest(F.col("first"), F.col("rank") * block))
    slots = schedule(targets, block, math.ceil(totals["words"] * share)).select(F.col("source").alias("s4"), F.col("rank").alias("r4"))
    taken = pieces.join(slots, F.col("source").eqNullSafe(F.col("s4")) & (F.col("rank") == F.col("r4"))).groupBy(
        F.col("doc_id").alias("d5"), F.col("source").alias("s5"), F.col("tie").alias("t5")).agg(F.sum("words").alias("run_words"))
    return counted.join(taken, F.col("doc_id").eqNullSafe(F.col("d5")) & F.col("source").eqNullSafe(F.col("s5")) & (F.col("tie") == F.col("t5")), "left").join(
        near, F.col("source").eqNullSafe(F.col("s3"))).select(
        "doc_id", "source", "tie", "one", "copies", "source_size", "target", F.coalesce("run_words", F.lit(0)).alias("run_words"))


def mix(docs: DataFrame, block: int = 512, weights: list[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """What the mix takes of each document (doc_id, source, text): doc_id, source, size, source_size, target, taken.

    NULL texts have size 0 and take nothing; NULL sources form one source, the last; repeated rows are documents of their own;
    an empty table gives none; other columns play no part. ``taken`` counts words with repeats; a source's sum is its target up to
    one word, and no document passes ``passes`` times its size. Reruns agree: order and points depend on the rows alone.
    """
    runs = _runs(docs, block, weights, share, passes)
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    each = F.floor(F.col("run_words") / F.col("copies")) + (F.col("copy") <= F.pmod("run_words", "copies")).cast("long")
    return runs.select("*", copy).select("doc_id", "source", F.col("one").alias("size"), "source_size", "target", each.alias("taken"))


def mixed_documents(docs: DataFrame, block: int = 512, weights: list[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The mix itself: every document as many times as it is taken (part of a document counts from a half), columns unchanged.

    A document without words is in no block and stays once.
    """
    runs = _runs(docs, block, weights, share, passes)
    times = F.when(F.col("one") == 0, F.lit(1)).otherwise(F.floor(F.col("run_words") / (F.col("one") * F.col("copies")) + 0.5).cast("int"))
    runs = runs.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("tie").alias("_t"), times.alias("_times")).where("_times > 0")
    hashed = docs.withColumn("_tie", F.xxhash64("text"))
    return hashed.join(runs, hashed["doc_id"].eqNullSafe(F.col("_d")) & hashed["source"].eqNullSafe(F.col("_s")) & (F.col("_tie") == F.col("_t"))).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
