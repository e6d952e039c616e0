"""Quality rules learned as an ordered decision list, DataFrame operations only.

Sequential covering: a rule is a conjunction of thresholds on text statistics. It grows by the threshold that gains most, is
pruned back on rows held out from growing, and takes the rows it covers away; growth goes on until no rule passes. All counts come
from one aggregation per growth step over a bounded labelled sample, so only numbers of candidates reach the driver. The list is
emitted as one conditional Column, first match first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import SPACES, stored, word_list

#: Limits of the base rule, words of a repeated window, symbols that are counted.
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = r"[^#*$%&|<>]+"


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Base statistics and the further ones that rules may use of the column ``text``, beside the columns in ``keep``.

    NULL and empty texts have none of anything. Whole texts count. A window is repeated when another place of the text has its
    64-bit hash; hashes are sorted with their places only in texts where some hash comes twice. Each step is a projection of its
    own, so no array is built twice.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*keep, body.alias("_body"), word_list(F.col("text")).alias("_words"))
    lines = F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumns({"_lines": lines, "_coded": F.transform("_words", lambda w: F.xxhash64(w))})
    # hashes of 2, 4 and 8 words, each from two of the last
    step = step.withColumn("_two", F.when(F.size("_coded") > WINDOW, F.transform("_coded", lambda x, i: F.xxhash64(x, F.get("_coded", i + 1)))))
    step = step.withColumn("_four", F.transform("_two", lambda x, i: F.xxhash64(x, F.get("_two", i + 2))))
    step = step.withColumn("_hashes", F.slice(F.transform("_four", lambda x, i: F.xxhash64(x, F.get("_four", i + 4))), F.lit(1), F.size("_four") - (WINDOW - 1)))
    step = step.withColumn("_placed", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(
        F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    step = step.withColumn("_twice", F.sort_array(F.transform(F.filter(
        "_placed", lambda x, j: F.coalesce(x["h"] == F.get("_placed", j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_placed", j + 1)["h"], F.lit(False))),
        lambda x: x["i"])))
    covered = F.aggregate("_twice", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return step.select(
        *keep, F.size("_words").cast("long").alias("n_words"), F.length(F.regexp_replace("_body", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_body", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("_coded")).cast("long").alias("n_distinct_words"), F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_body", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_body", r"[^!]+", "")).cast("long").alias("n_shouts"))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


#: Columns that ``judged`` adds; equally named columns of its input give way.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_upper", "n_shouts",
            "base_failed", "kept"]

#: What rules test, from the counts of ``statistics``.
FEATURES = {
    "words": lambda: F.col("n_words").cast("double"), "word_length": lambda: _ratio("word_chars", "n_words"),
    "symbols": lambda: _ratio("n_symbols", "n_words"), "dup_lines": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeats": lambda: _ratio("n_repeat_words", "n_words"), "distinct": lambda: _ratio("n_distinct_words", "n_words"),
    "line_words": lambda: _ratio("n_words", "n_lines"), "upper": lambda: _ratio("n_upper", "word_chars"),
    "shouts": lambda: _ratio("n_shouts", "n_words"),
}


@dataclass(frozen=True)
class Test:
    """One threshold: the feature is at most (or above) the limit."""

    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        c = FEATURES[self.feature]()
        return c > self.limit if self.above else c <= self.limit


def _all(tests: list[Test]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained by narrowing (p0, n0) bad and good rows to (p, n)."""
    return p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2))) if p else 0.0


def learn(labelled: DataFrame, bins: int = 16, max_rules: int = 8, max_tests: int = 3,
          min_precision: float = 0.95, min_covered: int = 8) -> list[list[Test]]:
    """Rules for bad rows from (statistics..., bad 0/1, ``key``), as an ordered list of conjunctions.

    ``labelled`` is the bounded sample that ``judged`` takes. Two rows in three grow rules, the third prunes them; a rule is kept when it covers ``min_covered`` bad rows of the sample with
    ``min_precision``. No labelled rows, or only one kind, give no rules. Limits are quantiles of the bad and of the good rows;
    what reaches the driver is one count per feature and bin.
    """
    names = list(FEATURES)
    sample = stored(labelled.select(*[f().alias(k) for k, f in FEATURES.items()], F.col("bad").cast("int").alias("bad"),
                                    F.pmod(F.xxhash64("key"), F.lit(3)).alias("fold")), "quality-labels")
    steps = [i / bins for i in range(bins)]
    marks = sample.groupBy("bad").agg(*[F.percentile_approx(k, steps, 1000).alias(k) for k in names]).collect()
    limits = {k: sorted({float(v) for m in marks for v in m[k] or []}) for k in names}
    binned = F.array(*[sum(((F.col(k) > v).cast("int") for v in limits[k]), F.lit(0)) for k in names])
    sample = stored(sample.select("bad", "fold", *names, binned.alias("bins")), "quality-bins")

    def test(t: Test) -> Column:
        place = F.get("bins", F.lit(names.index(t.feature)))
        edge = limits[t.feature].index(t.limit)
        return place > edge if t.above else place <= edge

    def all_of(tests: list[Test]) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & test(t)
        return out

    def total(rows: DataFrame, tests: list[Test]) -> tuple[int, int]:
        found = rows.where(all_of(tests)).agg(F.sum("bad"), F.count("*")).first()
        return found[0] or 0, found[1] - (found[0] or 0)

    def histogram(rows: DataFrame) -> dict[Test, tuple[int, int]]:
        """(bad, good) rows under every possible test, from one count per feature and bin."""
        cells = rows.select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
        out = {}
        for j, k in enumerate(names):
            mine = [(c["bin"], c["p"], c["n"] - c["p"]) for c in cells if c["f"] == j]
            for edge, v in enumerate(limits[k]):
                for above in (True, False):
                    side = [(p, n) for b, p, n in mine if (b > edge) == above]
                    out[Test(k, above, v)] = (sum(p for p, _ in side), sum(n for _, n in side))
        return out

    def centred(tests: list[Test]) -> list[Test]:
        """The same rule on the sample, each limit moved to the middle of the gap it lies in."""
        out = []
        for t in tests:
            low, high = sample.agg(F.max(F.when(F.col(t.feature) <= t.limit, F.col(t.feature))), F.min(F.when(F.col(t.feature) > t.limit, F.col(t.feature)))).first()
            out.append(t if low is None or high is None else Test(t.feature, t.above, (low + high) / 2))
        return out

    rules: list[list[Test]] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: list[Test] = []
        grow = sample.where(left & (F.col("fold") != 0))
        p0, n0 = total(grow, [])
        if p0 < min_covered:
            break
        while len(rule) < max_tests and n0 > 0:
            counts = histogram(grow.where(all_of(rule)))
            best = max(counts, key=lambda t: (_gain(*counts[t], p0, n0), t.feature, t.above, t.limit), default=None)
            if best is None or _gain(*counts[best], p0, n0) <= 1e-9:
                break
            rule.append(best)
            p0, n0 = counts[best]
        if not rule:
            break
        heads = [rule[:i] for i in range(1, len(rule) + 1)]
        held = [total(sample.where(left & (F.col("fold") == 0)), h) for h in heads]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in held]
        rule = heads[max(range(len(heads)), key=lambda i: (worth[i], -i))]
        p, n = total(sample.where(left), rule)
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(centred(rule))
        left = left & ~all_of(rule)
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The list as one conditional: false for rows that a rule takes, in order; true for the rest."""
    out = None
    for rule in rules:
        out = F.when(_all(rule), F.lit(False)) if out is None else out.when(_all(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = 20000) -> DataFrame:
    """Documents with statistics, ``base_failed`` and ``kept``.

    ``max_rows`` bounds the labelled documents that teach (taken by a hash of their id; all when there are fewer).
    ``labels``: (doc_id, quality 1 good / 0 bad); rows whose quality is NULL, and labels of no document, teach nothing. NULL
    doc_ids are judged like others. An empty table gives an empty result.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).select(
        F.col("doc_id").alias("_label_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    total = known.count()
    share = min(1.0, max_rows / total) if total else 0.0
    known = known.where(F.pmod(F.xxhash64("_label_id", F.lit(17)), F.lit(1 << 30)) <= int((1 << 30) * share))
    teach = docs.select("doc_id", "text").join(known, docs["doc_id"] == F.col("_label_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    teach = stored(statistics(teach, keep=["doc_id"]).withColumnRenamed("doc_id", "key"), "quality-teach").where(~base_failed())
    rules = learn(teach.join(known, F.col("key") == F.col("_label_id")))
    measured = statistics(docs, keep=[c for c in docs.columns if c not in MEASURES])
    failed = measured.withColumn("base_failed", base_failed())
    return failed.withColumn("kept", ~F.col("base_failed") & verdict(rules))
