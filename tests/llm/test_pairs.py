"""Near-duplicate join, substring removal and exact search against brute force."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import nearjoin, substrings, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = "doc_id long, text string, extra string, kept string, key long"


def corpus(seed, n=60, vocabulary=9, words=60):
    """Documents from few words, with copies, near copies and shared passages."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        if rows and kind < 0.2:
            text = rows[rnd.randrange(len(rows))][1]
        elif rows and kind < 0.5:
            w = (rows[rnd.randrange(len(rows))][1] or "").split(" ")
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
            text = " ".join(w)
        else:
            w = [rnd.choice("abcdefghij"[:vocabulary]) + str(rnd.randrange(vocabulary)) for _ in range(rnd.randint(0, words))]
            if kind < 0.7:
                at = rnd.randint(0, len(w))
                w[at:at] = passage[rnd.randint(0, 5):]
            text = rnd.choice([" ", "  ", "\n"]).join(w)
        rows.append((1000 - i if i % 2 else i, text))
    return rows + [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "One"), (2004, "oNE"), (2005, "É a"), (2006, "é a"), (None, "a b c d e f g h i j k l m n o"), rows[3], rows[3], (rows[4][0], rows[5][1]), (rows[4][0], "another text " * 9)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "e", "k", 1) for i, t in rows], TEXTS)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted(((d, len(s), names.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("seed,often", [(1, 64), (2, 2), (3, 1)])
def test_near_join(spark, seed, often):
    rows = corpus(seed)
    got = nearjoin.join(frame(spark, rows), often=often).collect()
    assert sorted(map(tuple, got), key=str) == linked(rows)


def test_pair_signatures_meet_for_every_similar_pair():
    """Frequent tokens only: each pair of similar sets shares a signature at a common level."""
    import numpy as np

    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(1, 90)
        x = {rnd.getrandbits(64) for _ in range(n)}
        y = set(x)
        for t in rnd.sample(sorted(x), rnd.randint(0, n // 6)):
            y.discard(t)
        y |= {rnd.getrandbits(64) for _ in range(rnd.randint(0, n // 8))}
        if x == y or not y or 100 * len(x & y) < 75 * len(x | y):
            continue
        made = []
        for s in (x, y):
            need = nearjoin.allowed_losses(len(s)) + 1
            low, high = -(-75 * len(s) // 100), 100 * len(s) // 75
            made.append({v for at in range(low.bit_length() - 1, high.bit_length())
                         for v in nearjoin._combinations(np.array(sorted(s), dtype=np.uint64), at, need).tolist()})
        assert made[0] & made[1], (len(x), len(y))


def test_near_join_empty(spark):
    assert nearjoin.join(frame(spark, [])).count() == 0


def cut(rows):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            if d is not None:
                first[tuple(w[j:j + 13])] = min(d, first.get(tuple(w[j:j + 13]), d))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        stay = [True] * len(w)
        for j in range(len(w) - 12):
            if d is not None and first[tuple(w[j:j + 13])] < d:
                stay[j:j + 13] = [False] * 13
        out.append((d, len(w), stay.count(False), hashlib.sha256(" ".join(x for x, s in zip(w, stay) if s).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,widest,vocabulary", [(1, 4096, 9), (2, 1, 9), (3, 4096, 1)])
def test_substrings(spark, seed, widest, vocabulary):
    rows = corpus(seed, vocabulary=vocabulary)
    got = substrings.deduplicate(frame(spark, rows), widest=widest, digest=True).select("doc_id", "n_words", "n_removed", "kept", "extra").collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == cut(rows) and {r.extra for r in got} == {"e"}


def test_substrings_texts_and_empty(spark):
    rows = [(1, "k  l"), (2, " ".join(map(str, range(20)))), (3, "a  " + " ".join(map(str, range(20))) + "\nb")]
    got = {r.doc_id: r.kept for r in substrings.deduplicate(frame(spark, rows)).collect()}
    assert got == {1: "k  l", 2: rows[1][1], 3: "a b"}
    assert substrings.deduplicate(frame(spark, [])).count() == 0


def test_automaton_finds_the_smallest_document():
    rnd = random.Random(3)
    for _ in range(50):
        texts = [([rnd.randrange(3) for _ in range(rnd.randint(0, 25))], rnd.randrange(20)) for _ in range(6)]
        machine = substrings.Automaton()
        for w, d in texts:
            machine.add(w, d)
        machine.finish()
        for w, _ in texts:
            least = {}
            for v, d in texts:
                for j in range(len(v) - 3):
                    least[tuple(v[j:j + 4])] = min(d, least.get(tuple(v[j:j + 4]), d))
            assert list(machine.earliest(w, 4)) == [(j, least[tuple(w[j:j + 4])]) for j in range(len(w) - 3)]


def best(rows, k):
    good = {}
    for v, e in rows:
        if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.setdefault(v, []).append([math.floor(256 * x) for x in e])
    out = []
    for q in good:
        if q % 50 == 0:
            a = min(good[q])
            scores = sorted((-max(sum(x * y for x, y in zip(a, b)) for b in bs), v) for v, bs in good.items() if v != q)[:k]
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("n,spread,block", [(400, 3, 1024), (130, 1, 1), (3, 5, 1024)])
def test_top_k(spark, n, spread, block):
    rnd = random.Random(n)
    rows = [(i, [rnd.randint(-spread, spread) / 256 + rnd.choice([0, 0.001]) for _ in range(6)]) for i in range(n)]
    rows += [(None, [1.0] * 6), (100000, None), (100050, [1.0, None]), (7, [float("nan")] * 6), (8, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    flat = [(v, None if e is None else [None if x is None else float(__import__("numpy").float32(x)) for x in e]) for v, e in rows]
    got = topk.search(df, depth=2, block=block).collect()
    assert sorted(map(tuple, got)) == best(flat, 5)


def test_top_k_empty_and_huge(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty).count() == 0
    df = spark.createDataFrame([(0, [3e9, 1.0]), (1, [3e9, -1.0]), (2, [-3e9, 0.0])], "vec_id long, embedding array<float>")
    got = topk.search(df).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2)]


def test_last_meetings_list_a_pair_about_once(spark):
    """Sets that share a long run of signatures meet where the run begins; a similar pair is never left out."""
    rnd = random.Random(4)
    sigs = {key: [s for s in range(60) if rnd.random() < 0.8] for key in range(12)}
    n, rest = 100, 60
    rows = spark.createDataFrame([(s, key, sum(s in other for other in sigs.values()), key, n, rest, 0) for key, mine in sigs.items() for s in mine],
                                 "sig long, key long, k long, root long, n int, rest int, f0 long")
    got = [tuple(r) for r in nearjoin.meetings(nearjoin.ranked(rows), 75, ["f0"]).collect()]
    shared = {(a, b): len(set(sigs[a]) & set(sigs[b])) for a in sigs for b in sigs if a < b}
    assert {p for p, c in shared.items() if 175 * (c + rest) >= 75 * 2 * n} <= set(got)
    assert len(got) < 4 * len(shared) < sum(shared.values()) / 8
