"""The search inside a document against plain Python, and what it moves and writes."""

import random

from pyspark.sql import functions as F

from quire.operators import align as A
from quire.operators.pagesearch import Pages
from test_align import DOCS, pages_frame, sentence


def test_pages_hold_exactly_what_they_contain():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abé", k=rnd.randint(1, 3)))
    for _ in range(60):
        texts = [" ".join(word() for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 6))]
        index = Pages(list(range(len(texts))), texts)
        needles = [t[a:a + rnd.randint(1, 9)] for t in texts for a in range(0, len(t), 2)] + [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4)]
        for needle in needles:
            assert list(index.holding(needle)) == [i for i, t in enumerate(texts) if needle in t], (needle, texts)


def test_greatest_overlap_is_exact():
    rnd = random.Random(7)
    for _ in range(200):
        texts = [" ".join(rnd.choices("abcdefghij", k=rnd.randint(1, 8))) for _ in range(rnd.randint(1, 7))]
        sought = " ".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(1, 10)))
        tokens = set(sought.split())
        shares = [len(tokens & set(t.split())) / len(tokens) for t in texts]
        found = Pages(list(range(len(texts))), texts).overlapping(sought, 0.36)
        if max(shares) >= 0.36:
            assert found == (shares.index(max(shares)), max(shares))
        else:
            assert found is None or found[1] < 0.36


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_page_search_writes_no_lists_and_moves_each_text_once(spark, monkeypatch):
    written = []
    plain = A.stored
    monkeypatch.setattr(A, "stored", lambda df, name: written.append(name) or plain(df, name))
    targets = A.targets_of(spark.createDataFrame([(1, sentence(5)), (2, "unknown words")], "doc_id long, text string"))
    found = A.best_page(targets, pages_frame(spark, DOCS))
    assert exchanges(found) <= 3 and not written
    located = A.locate(targets, pages_frame(spark, DOCS)).localCheckpoint()
    near = A.candidate_pages(located, pages_frame(spark, DOCS), "body", "body_text", "next1", "next2", headed=True)
    assert exchanges(near) == 2
    assert {(r.page_number, len(r.next1 or []), len(r.next2 or [])) for r in near.collect()} == {(1, 4, 4)}


def test_next_boxes_are_those_of_the_next_numbers(spark):
    pages = pages_frame(spark, {1: [[sentence(p * 2 + b) for b in range(2)] for p in range(5)]}).where("page_number <> 2")
    located = spark.createDataFrame([(1, b"k", "x", None)], "doc_id long, tkey binary, t string, best_page int")
    rows = A.candidate_pages(located, pages.union(pages), "body", "next1", "next2", max_boxes=1).collect()
    after = lambda boxes: [b.page for b in boxes or []]
    assert sorted((r.page_number, after(r.next1), after(r.next2)) for r in rows) == [(0, [1], []), (1, [], [3]), (3, [4], []), (4, [], [])]


def test_pages_are_written_as_boxes_alone(spark):
    written = []
    pages = pages_frame(spark, DOCS)
    kept = A.kept_pages(pages, lambda df, name: written.append(df.columns) or df)
    assert written == [["doc_id", "page_number", "boxes"]]
    assert kept.select(sorted(kept.columns)).exceptAll(pages.select(sorted(kept.columns))).count() == 0


def test_headings_meet_their_boxes_without_a_broadcast(spark):
    heads = spark.createDataFrame([(1, 0, "Introduction")], "doc_id long, element_index int, text string")
    found = A.match_headings(heads, pages_frame(spark, {1: [["INTRODUCTION", sentence(1)]]}))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.select(F.col("match.page_number")).first()[0] == 0
