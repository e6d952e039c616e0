"""Similarity join on sets of word n-grams: token-combination prefixes, then exact verification.

Texts with one shingle set are one set from the start. Tokens (shingle hashes) have one global order: rare ones by hash, then
frequent ones by hash. The prefix of a set is just long enough that two similar sets must share one of its signatures:

* a rare token is a signature by itself;
* frequent tokens are spread over classes, and pairs within a class are signatures. A class of n prefix tokens stands ``n - 1``
  losses, so the prefix is extended until the rare tokens and the classes together outlast every loss that similarity allows.

Pairs are never listed within a group of equals: first every set meets the smallest set of each of its signatures, then one set per
signature chosen by hash; what is linked then is one component, and only sets of different components that share a signature are compared in a last step. There the
signatures of each set stand in one global order, rare ones first by exact counts: a similar pair meets at the first one it shares, which must
leave enough of both lists, and a pair that shares one of the few before is not met again. Before texts are
moved, pairs pass exact filters: sizes, shared signatures and parity bits must still allow the similarity. All steps verify on whole
texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.common import release, stored
from quire.llm.words import BASE, ODD, Hasher, grams, mix, rows_of

#: Words in a shingle, similarity in percent.
SIZE = 5
PERCENT = 75
BITS = 1024
#: Signatures before each one that the last step looks back at.
BACK = 4


def shingle_sets(hasher: Hasher, column: pa.Array, size: int = SIZE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, limits, tokens): sorted distinct shingle hashes of whole texts. A text with fewer words is one shingle."""
    for row, limits, hashes, *_ in hasher.slices(column):
        index, owner = rows_of(limits, size)
        tokens = grams(hashes, size)[index] if len(index) else np.zeros(0, np.uint64)
        counts = np.diff(limits)
        for k in range(1, size):
            short = np.flatnonzero(counts == k)
            if len(short):
                tokens = np.concatenate([tokens, grams(hashes, k)[limits[:-1][short]]])
                owner = np.concatenate([owner, short])
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        if len(tokens):
            fresh = np.ones(len(tokens), dtype=bool)
            fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
            tokens, owner = tokens[fresh], owner[fresh]
        yield row, np.searchsorted(owner, np.arange(len(counts) + 1)), tokens


def set_keys(limits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """One 64-bit key per set, from all its tokens."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(BASE)), dtype=np.uint64)])
        return mix(sums[limits[1:]] - sums[limits[:-1]] + np.diff(limits).astype(np.uint64)).view(np.int64)


def parity_bits(limits: np.ndarray, tokens: np.ndarray) -> list[list[int]]:
    """``BITS`` parities per set, as 64-bit integers: a bit counts the tokens that hash to it, modulo two.

    Sets that differ in d tokens differ in d bits at most, so the bits that differ bound the tokens that do.
    """
    n = len(limits) - 1
    place = np.repeat(np.arange(n), np.diff(limits)) * BITS + (mix(tokens ^ np.uint64(ODD)) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(odd, axis=1).view(np.int64).tolist()


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        often: dict[int, int] = {}

        def report() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.nulls(len(often), pa.int64()), pa.array(often.values(), pa.int64()), pa.array(often.keys(), pa.int64()),
                pa.array([True] * len(often), pa.bool_()), pa.nulls(len(often), pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "token", "bits"])
            often.clear()
            return out

        for batch in batches:
            for row, limits, tokens in shingle_sets(hasher, batch.column(1), size):
                keys = set_keys(limits, tokens)
                _, first = np.unique(keys, return_index=True)
                keep = np.zeros(len(keys), dtype=bool)
                keep[first] = True
                value, count = np.unique(tokens[np.repeat(keep, np.diff(limits))], return_counts=True)
                for v, c in zip(value[count > 1].view(np.int64).tolist(), count[count > 1].tolist()):
                    often[v] = often.get(v, 0) + c
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(keys)), pa.array(np.diff(limits)), pa.array(keys), pa.array(np.zeros(len(keys), dtype=bool)),
                    pa.array(parity_bits(limits, tokens), pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "token", "bits"])
                if len(often) > 200_000:
                    yield report()
        yield report()
    return run


def allowed_losses(n: np.ndarray | int, percent: int = PERCENT):
    """Most tokens a set of n may have that a similar one lacks."""
    return n - -(-percent * n // 100)


def _combinations(tokens: np.ndarray, level: int, need: int) -> np.ndarray:
    """Pair signatures of the shortest prefix of frequent tokens whose classes stand ``need`` losses."""
    classes = max(1, (1 << level) // 8)
    kind = (tokens >> np.uint64(7)) % np.uint64(classes)
    seen: dict[int, list[int]] = {}
    out: list[int] = []
    stands = 0
    for t, c in zip(tokens.tolist(), kind.tolist()):
        mine = seen.setdefault(c, [])
        out += [(u * 0x9E3779B97F4A7C15 + t * 0xD1342543DE82EF95 + level) & 0xFFFFFFFFFFFFFFFF for u in mine]
        stands += bool(mine)
        mine.append(t)
        if stands >= need:
            break
    return mix(np.array(out, dtype=np.uint64))


def _signatures(size: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, common = Hasher(lower=True), frequent.value
        done: set[int] = set()
        for batch in batches:
            for _, limits, tokens in shingle_sets(hasher, batch.column(0), size):
                keys, n = set_keys(limits, tokens), np.diff(limits)
                new = np.array([k not in done for k in keys.tolist()], dtype=bool)
                if len(done) < 1_000_000:  # only saves work: sets met again give equal rows
                    done.update(keys.tolist())
                _, first = np.unique(keys, return_index=True)
                once = np.zeros(len(keys), dtype=bool)
                once[first] = True
                new &= once & (n > 0)
                owner = np.repeat(np.arange(len(keys)), n)
                place = np.searchsorted(common, tokens)
                hot = common[np.minimum(place, len(common) - 1)] == tokens if len(common) else np.zeros(len(tokens), dtype=bool)
                prefix = allowed_losses(n, percent) + 1
                rare = np.bincount(owner[~hot], minlength=len(keys))
                # place of each rare token among its set's rare tokens, in hash order
                cold = np.flatnonzero(~hot & new[owner])
                start = np.concatenate([[0], np.cumsum(np.bincount(owner[cold], minlength=len(keys)))])[:-1]
                rank = np.arange(len(cold)) - start[owner[cold]]
                take = cold[rank < prefix[owner[cold]]]
                parts = [(tokens[take], owner[take])]
                for i in np.flatnonzero(new & (rare < prefix) & (n > rare)):
                    mine = tokens[limits[i]:limits[i + 1]][hot[limits[i]:limits[i + 1]]]
                    level = int(n[i]).bit_length() - 1
                    low, high = -(-percent * int(n[i]) // 100), 100 * int(n[i]) // percent
                    for at in range(low.bit_length() - 1, high.bit_length()):
                        made = _combinations(mine, at, int(prefix[i] - rare[i]))
                        parts.append((made, np.full(len(made), i)))
                signature, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                # a prefix with pairs says nothing about how many tokens two sets share
                rest = np.where(rare >= prefix, n - prefix, n)
                yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(keys[owner]), pa.array(n[owner].astype(np.int32)),
                                                  pa.array(rest[owner].astype(np.int32))], ["sig", "key", "n", "rest"])
    return run


def _keyed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            for row, limits, tokens in shingle_sets(hasher, batch.column(0), size):
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(limits, tokens)), batch.column(0).slice(row, len(limits) - 1)], ["key", "text"])
    return run


def _verified(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = []
                for column in (part.column(2), part.column(3)):
                    both.append([t[x:y] for _, limits, t in shingle_sets(hasher, column, size) for x, y in zip(limits[:-1], limits[1:])])
                for i, (a, b) in enumerate(zip(*both)):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    keep[at + i] = 100 * common >= percent * (len(a) + len(b) - common)
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])
    return run


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int, small: int = 1 << 20) -> DataFrame:
    """The pairs (a, b) of set keys whose texts are similar, as a stored table.

    Texts of sets that stand in no pair are not moved: up to ``small`` needed ids go to the tasks, more are joined.
    """
    pairs = stored(pairs, "near-pairs")
    ids = stored(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct().join(reps, "key"), "near-needed")
    narrow = ids.select("doc_id")
    if ids.count() <= small:
        narrow = F.broadcast(narrow)
    # rows of one doc_id may differ, so each text goes by its own key
    texts = docs.join(narrow, "doc_id", "left_semi").select("text").mapInArrow(_keyed(size), "key bigint, text string").join(
        ids.select("key"), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(_verified(size, percent), "a bigint, b bigint"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in links (a, b): the smallest node reachable. Roots are exchanged and followed until none changes."""
    edges = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "near-edges")
    roots = stored(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "near-roots")
    while True:
        seen = edges.join(roots.withColumnRenamed("node", "y").withColumnRenamed("root", "other"), "y").groupBy(F.col("x").alias("node")).agg(F.min("other").alias("other"))
        nearer = roots.join(seen, "node").select("node", F.least("root", "other").alias("root"), F.col("root").alias("was"))
        nearer = stored(nearer, "near-step")
        ahead = nearer.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(nearer.join(ahead, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "was"), "near-roots")
        if not new.where("root <> was").limit(1).count():
            return new.select("node", "root")
        roots = new.select("node", "root")


def possible(x: str, y: str, shared: Column, percent: int) -> Column:
    """Sizes, and shared signatures plus what lies behind the prefixes, allow the similarity."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    most = shared + F.greatest(f"{x}.rest", f"{y}.rest")
    return (100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")) & ((100 + percent) * most >= percent * n)


def close(x: str, y: str, columns: list[str], percent: int) -> Column:
    """The bits that differ leave room for the similarity; an exact filter, since they are no more than the tokens that differ."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in columns])
    return (100 + percent) * (n - apart) >= 2 * percent * n


def ranked(rows: DataFrame, back: int = BACK) -> DataFrame:
    """Adds later, the signatures of the set from this one on, and earlier, the ``back`` before it, to (sig, key, k): by rising k, then sig."""
    order = Window.partitionBy("key").orderBy(F.desc("k"), F.desc("sig"))
    return rows.withColumns({"later": F.row_number().over(order), "earlier": F.collect_list("sig").over(order.rowsBetween(1, back))})


def meetings(left: DataFrame, percent: int, folded: list[str]) -> DataFrame:
    """(a, b): pairs of sets of different components that share a signature of ``left``, most of them once or a few times.

    ``left`` has every signature that such sets share. At the first one in order a similar pair has all it shares still to come, and none
    of those before in common; other places are left out where that shows.
    """
    x, y = left.alias("x"), left.alias("y")
    return x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
                  & possible("x", "y", F.least("x.later", "y.later"), percent) & close("x", "y", folded, percent)
                  & ~F.arrays_overlap("x.earlier", "y.earlier")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, often: int = 64, classes: int = 200_000) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id), one row per input row.

    Texts are lower-cased in A-Z and cut in words; sets are compared by 64-bit hashes of their shingles. Two documents link when
    their Jaccard similarity is at least ``percent``; component_id is the smallest doc_id reachable. NULL and empty texts have no
    shingles and link with nothing; texts of fewer than ``size`` words are one shingle; repeated rows are rows of their own in one
    component, rows of one doc_id with different texts are documents of their own; a set that only rows without doc_id hold links
    nothing. An empty table gives none.

    Frequent are the ``classes`` tokens (a bound on what is broadcast) that slices of texts report most, ``often`` times or more; a slice
    reports what it has in two texts. This only steers the order of tokens: any choice gives the same result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = stored(docs.mapInArrow(_profile(size), "doc_id bigint, n_shingles bigint, key bigint, token boolean, bits array<bigint>"), "near-profile")
    counts = profile.where("token").groupBy("key").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= often)
    common = counts.orderBy(F.desc("n"), "key").limit(classes).select("key").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(common))
    rows = profile.where("not token").select("doc_id", "n_shingles", "key")
    reps = stored(profile.where("not token and n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("bits").alias("bits")), "near-sets")
    bits = reps.select("key", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(BITS // 64)])
    reps = reps.select("key", "doc_id")

    made = docs.select("text").mapInArrow(_signatures(size, percent, frequent), "sig bigint, key bigint, n int, rest int")
    alike = Window.partitionBy("sig")
    met = made.repartition("sig").distinct().withColumns({"least": F.min("key").over(alike), "most": F.max("key").over(alike)})
    met = stored(met.where("least < most").drop("most"), "near-met")
    owner = met.groupBy("key").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("rest").alias("rest"))
    owner = stored(owner.join(bits, "key"), "near-owners")
    whole = [f"b{i}" for i in range(BITS // 64)]
    folded = [f"f{i}" for i in range(4)]

    def filtered(pairs: DataFrame) -> DataFrame:
        return pairs.join(owner.alias("p"), F.col("a") == F.col("p.key")).join(owner.alias("q"), F.col("b") == F.col("q.key"))

    first = met.where("key <> least").groupBy(F.col("least").alias("a"), F.col("key").alias("b")).agg(F.lit(0).alias("z"))
    first = filtered(first).where(possible("p", "q", F.least("p.shared", "q.shared"), percent) & close("p", "q", whole, percent)).select("a", "b")
    links = verify(first, docs, reps, size, percent)
    roots = components(links)

    known = owner.select("key", "n", "rest", *[
        reduce(lambda a, b: a.bitwiseXOR(b), [F.col(f"b{i}") for i in range(j, BITS // 64, 4)]).alias(f"f{j}") for j in range(4)])

    def across(rows: DataFrame, roots: DataFrame, order: bool = False) -> DataFrame:
        """Of (sig, key) rows those of signatures that sets of several components share, with what is known of the sets."""
        rooted = stored(rows.join(roots.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", F.coalesce("root", "key").alias("root")), "near-rooted")
        apart = rooted.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("sig", "k")
        several = rooted.join(apart, "sig")
        several = ranked(several) if order else several
        wide = stored(several.drop("k").join(known, "key"), "near-apart")
        release(rooted)
        return wide

    # every signature lets its sets meet another one of them, so a set meets as many others as it has signatures
    left = across(met.select("sig", "key"), roots)
    release(met)
    other = left.groupBy("sig").agg(F.min_by(F.struct("key", "n", "root", *folded), F.xxhash64("key", "sig")).alias("y")).select("sig", "y.*")
    x, y = left.alias("x"), other.alias("y")
    between = x.join(y, F.col("x.sig") == F.col("y.sig")).where((F.col("x.root") != F.col("y.root")) & close("x", "y", folded, percent)).select(
        F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    links = links.unionByName(verify(filtered(between).where(possible("p", "q", F.least("p.shared", "q.shared"), percent) & close("p", "q", whole, percent)).select("a", "b"), docs, reps, size, percent))
    roots = components(links)

    wider, left = left, across(left.select("sig", "key"), roots, order=True)
    release(wider)
    second = filtered(meetings(left, percent, folded).distinct()).where(close("p", "q", whole, percent)).select("a", "b")
    more = verify(second, docs, reps, size, percent)
    if more.limit(1).count():
        roots = components(links.unionByName(more))
    release(left, owner)

    named = reps.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = stored(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-names")
    final = stored(named.join(names, "root").select(F.col("key").alias("k"), "component_id"), "near-final")
    return rows.join(final, (F.col("key") == F.col("k")) & (F.col("n_shingles") > 0), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
