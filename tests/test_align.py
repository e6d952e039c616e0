"""Alignment on a small fixture against plain Python, and the shape of its plans."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quire.operators import align as A

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(k, n=12):
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + str(k) for i in range(n))


def pages_frame(spark, docs):
    rows = []
    for doc, pages in docs.items():
        for p, texts in enumerate(pages):
            rows.append((doc, p, [(i, [10.0 * i, 10.0 * p, 10.0 * i + 5, 10.0 * p + 5], t, t.lower(), "text") for i, t in enumerate(texts)]))
    raw = spark.createDataFrame(rows, "doc_id long, page_number int, boxes array<struct<block_index:int,bbox:array<double>,text:string,norm:string,class:string>>")
    return A.index_pages(raw)


DOCS = {1: [[sentence(p * 4 + b) for b in range(4)] for p in range(6)], 2: [[sentence(100 + b) for b in range(3)]]}


def overlap(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a) if a and b else 0.0


def brute_page(target, pages):
    best, place = 0.0, None
    for number, texts in enumerate(pages):
        stream = " ".join(texts)
        score = 1.0 if target in stream else 0.92 if len(target) > 50 and target[:220] in stream else 0.88 if len(target) > 50 and target[-220:] in stream else overlap(target, stream) * 0.55
        if score > best:
            best, place = score, number
    return place if best >= 0.20 else None


TARGETS = {
    1: [sentence(5), sentence(3) + " " + sentence(4), sentence(9)[:40], sentence(9)[3:30].strip(), "unknown words only here and there", "alpha5", sentence(2).replace("a", "o"),
        " ".join(sentence(7).split()[:6]) + " " + " ".join(sentence(21).split()[:3]), sentence(23) + " tail words"],
    2: [sentence(101), sentence(5)],
}


def test_best_page_equals_brute_force(spark):
    rows = [(d, t) for d, ts in TARGETS.items() for t in ts]
    targets = A.targets_of(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.t): r.best_page for r in A.best_page(targets, pages_frame(spark, DOCS)).collect()}
    assert got == {(d, t): brute_page(t, DOCS[d]) for d, t in rows}


def test_match_paragraphs(spark):
    rows = [(d, i, t) for d, ts in TARGETS.items() for i, t in enumerate(ts)]
    elements = spark.createDataFrame(rows, "doc_id long, element_index int, text string")
    got = {(r.doc_id, r.element_index): r.match for r in A.match_paragraphs(elements, pages_frame(spark, DOCS)).collect()}
    assert len(got) == len(rows)
    assert got[(1, 0)].page_number == 1 and got[(1, 0)].match_confidence == "high" and got[(1, 0)].pdf_rects == [[10.0, 10.0, 15.0, 15.0]]
    # Two boxes on two pages: collected across the page border.
    assert [x.page for x in got[(1, 1)].pdf_locations] == [0, 1] and got[(1, 1)].match_confidence == "high"
    assert got[(1, 4)].page_number is None and got[(1, 4)].match_confidence == "low"
    # The respelt text is found by similarity only, so it is at most medium.
    target = TARGETS[1][6]
    ratios = {(p, b): SequenceMatcher(None, target, t).ratio() for p, page in enumerate(DOCS[1]) for b, t in enumerate(page)}
    assert max(ratios.values()) >= 0.35
    assert got[(1, 6)].match_confidence == "medium" and got[(1, 6)].page_number == max(ratios, key=ratios.get)[0]


def test_match_headings_in_order(spark):
    pages = pages_frame(spark, {1: [["INTRODUCTION", sentence(1)], ["RESULTS", sentence(2)], ["INTRODUCTION", "RESULTS"]]})
    heads = spark.createDataFrame([(1, 0, "Introduction"), (1, 4, "Results"), (1, 6, "Introduction"), (1, 8, "Introduction")], "doc_id long, element_index int, text string")
    got = {r.element_index: r.match.page_number for r in A.match_headings(heads, pages).collect()}
    assert got == {0: 0, 4: 1, 6: 2}


def test_match_headings_reads_the_headings_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    pages = pages_frame(spark, {1: [["INTRODUCTION", sentence(1)], ["RESULTS", sentence(2)]]})
    heads = spark.createDataFrame([(1, 0, "Introduction"), (1, 4, "Results")], "doc_id long, element_index int, text string")
    assert A.match_headings(heads.withColumn("text", F.udf(told, "string")("text")), pages).count() == 2
    assert seen.value == 2


def test_bullet_list_takes_the_weakest_confidence(spark):
    lists = spark.createDataFrame([(1, 0, [sentence(5), sentence(6)]), (1, 1, [sentence(5), "nothing like it at all"])], "doc_id long, element_index int, items array<string>")
    got = {r.element_index: r.match for r in A.match_bullet_lists(lists, pages_frame(spark, DOCS)).collect()}
    assert got[0].match_confidence == "high" and len(got[0].pdf_rects) == 2
    assert got[1].match_confidence in ("low", "medium")


def test_no_pairing_plans(spark):
    targets = A.targets_of(spark.createDataFrame([(1, "x y")], "doc_id long, text string"))
    plan = A.best_page(targets, pages_frame(spark, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rows_grow_with_the_document(spark, monkeypatch):
    """Twice the pages and twice the texts of one document give about twice the rows between the steps, never four times; short texts take part."""
    sizes = []
    plain = A.stored

    def counted(df, name):
        out = plain(df, name)
        sizes[-1][name] = sizes[-1].get(name, 0) + out.count()
        return out

    monkeypatch.setattr(A, "stored", counted)
    for n in (20, 40):
        sizes.append({})
        pages = [[sentence(p * 3 + b) + " with the usual words" for b in range(3)] for p in range(n)]
        rows = [(1, t) for p in range(n) for t in (pages[p][1], " ".join(pages[p][2].split()[2:4]), "the other " + pages[p][0].replace("a", "o"))]
        targets = A.targets_of(spark.createDataFrame(rows, "doc_id long, text string"))
        got = {r.t: r.best_page for r in A.best_page(targets, pages_frame(spark, {1: pages})).collect()}
        assert got == {t: brute_page(t, pages) for _, t in rows}
    assert all(sizes[1][k] <= 2.7 * v for k, v in sizes[0].items() if v > 20), sizes


def brute_window(target, pages):
    """The best run over all pages, by comparing every one of them."""
    best = (0.0, None)
    for number, texts in enumerate(pages):
        for first in range(len(texts)):
            for last in range(first, min(first + 4, len(texts))):
                ratio = SequenceMatcher(None, target, " ".join(texts[first:last + 1])).ratio()
                if ratio > best[0]:
                    best = (ratio, (number, first, last))
    return best if best[0] >= 0.35 else None


def test_windows_equal_brute_force(spark, monkeypatch):
    """Every text against every run of its document, with and without a page estimate; few runs are compared in Python."""
    import random

    rnd = random.Random(3)
    sizes = {}
    plain = A.stored

    def counted(df, name):
        out = plain(df, name)
        if name in ("windows", "open-windows"):
            sizes[name] = out.select(F.sum(F.size("windows"))).first()[0] or 0
        return out

    monkeypatch.setattr(A, "stored", counted)
    docs = {d: [[" ".join(rnd.choices(WORDS, k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 6))] for _ in range(3)] for d in range(3)}
    rows = []
    for d, pages in docs.items():
        for _ in range(25):
            words = " ".join(rnd.choice(pages)).split()
            rnd.shuffle(words[:4])
            text = " ".join(w if rnd.random() < 0.7 else rnd.choice(WORDS) for w in words[rnd.randint(0, 3):] or ["zz"])
            rows.append((d, text))
    rows += [(0, "qqq"), (1, docs[1][0][0]), (2, docs[2][0][0] + "x")]
    targets = A.targets_of(spark.createDataFrame(rows, "doc_id long, text string"))
    lost = targets.select("doc_id", "tkey", "t", F.lit(None).cast("int").alias("best_page"), F.lit(5).alias("target_words"))
    found, names = {}, {(r.doc_id, bytes(r.tkey)): r.t for r in targets.collect()}
    for r in A.best_windows(lost, pages_frame(spark, docs)).collect():
        key, place = (r.doc_id, names[r.doc_id, bytes(r.tkey)]), (r.page_number, r["first"], r["last"])
        rank = (r.score, *[-x for x in place])
        if r.score >= 0.35 and (key not in found or rank > found[key][0]):
            found[key] = (rank, place)
    bodies = {d: [[b.norm for b in r.body] for r in sorted(pages_frame(spark, {d: p}).collect(), key=lambda r: r.page_number)] for d, p in docs.items()}
    want = {}
    for d, t in set(rows):
        best = brute_window(t, bodies[d])
        if best:
            want[d, t] = ((best[0], *[-x for x in best[1]]), best[1])
    assert found == want
    assert sizes["open-windows"] < 0.6 * sizes["windows"]
