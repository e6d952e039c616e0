"""Edit batches against serving them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import edits as E
from quire.operators import scan

ELEMENT = ("doc_id long, element_id long, element_index int, type string, section_title string, text string, intro_text string, items array<string>, "
           "summary string, key_points array<string>, text_zh string, summary_zh string, key_points_zh array<string>, items_zh array<string>, level string")
EDIT = "edit_seq long, doc_id long, element_id long, op string, text string, intro_text string, items array<string>"


def documents(n_docs, n):
    kinds = ["heading", "paragraph", "paragraph", "bullet_list"]
    return [(d, d * 100000 + i, i, kinds[i % 4], f"S{i // 4}", f"text {i}", None, None, "s", None, "z", "z", None, None, None) for d in range(n_docs) for i in range(n)]


def served(elements, edits):
    """The plain programme: one edit after another on lists."""
    docs, home, kind, text, reasons, section = {}, {}, {}, {}, {}, {}
    for r in elements:
        docs.setdefault(r[0], []).append(r[1])
        home[r[1]], kind[r[1]], text[r[1]], section[r[1]] = r[0], r[3], r[5], r[4]
    gone = set()
    for seq, _, target, op, new, _, _ in sorted(edits):
        if target not in home:
            reasons[seq] = "missing_element"
        elif op == "update" and kind[target] != "paragraph":
            reasons[seq] = "not_a_paragraph"
        elif op == "bullets" and kind[target] != "bullet_list":
            reasons[seq] = "not_a_bullet_list"
        elif op in ("insert", "delete") and kind[target] == "heading":
            reasons[seq] = "not_editable"
        elif op == "insert" and not (new or "").strip():
            reasons[seq] = "blank_text"
        elif target in gone:
            reasons[seq] = "deleted_before"
        elif op == "update":
            text[target] = new
        elif op == "delete":
            gone.add(target)
        elif op == "insert":
            order = docs[home[target]]
            order.insert(order.index(target) + 1, -seq)
            home[-seq], kind[-seq], text[-seq], section[-seq] = home[target], "paragraph", new.strip(), section[target]
    rows = [(d, e, i, text[e], section[e]) for d, order in docs.items() for i, e in enumerate([e for e in order if e not in gone])]
    return sorted(rows), reasons


def compare(spark, elements, edits):
    table, log = spark.createDataFrame(elements, ELEMENT), spark.createDataFrame(edits, EDIT).repartition(5)
    want, reasons = served(elements, edits)
    got = E.apply_edits(table, log).select("doc_id", "element_id", "element_index", "text", "section_title").collect()
    assert sorted(map(tuple, got)) == want
    assert {r["edit_seq"]: r["reason"] for r in E.rejected(log, table).collect()} == reasons


@pytest.mark.parametrize("seed", range(3))
def test_random_batches(spark, seed):
    """Edits on stored, inserted, deleted, not yet inserted and unknown rows, in an order of their own."""
    rnd = random.Random(seed)
    elements = documents(3, 9)
    ids, edits = [r[1] for r in elements] + [777], []
    for seq in range(1, 160):
        op = rnd.choice(["insert", "insert", "insert", "update", "delete", "bullets"])
        target = rnd.choice(ids[-12:] if rnd.random() < 0.6 else ids) if rnd.random() < 0.95 else -rnd.randint(1, 160)
        edits.append((seq, target // 100000, target, op, rnd.choice(["new %d" % seq, " padded %d " % seq, " ", None]), None, ["a"]))
        if op == "insert":
            ids.append(-seq)
    rnd.shuffle(edits)
    compare(spark, elements, edits)


def test_chain_of_a_thousand(spark):
    elements = documents(1, 4)
    edits = [(1, 0, 1, "insert", "t1", None, None)] + [(k, 0, -(k - 1), "insert", f"t{k}", None, None) for k in range(2, 1001)]
    compare(spark, elements, edits + [(2000, 0, -500, "delete", None, None, None), (2001, 0, -500, "insert", "late", None, None), (2002, 0, -501, "insert", "kept", None, None)])


def test_broken_chain(spark):
    """A rejected insertion takes all edits on what would stand behind it with it."""
    edits = [(1, 0, 1, "insert", " ", None, None), (2, 0, -1, "insert", "a", None, None), (3, 0, -2, "insert", "b", None, None), (4, 0, -3, "update", "c", None, None), (5, 0, 1, "insert", "d", None, None)]
    compare(spark, documents(1, 4), edits)


def test_hot_anchor(spark, monkeypatch):
    """20 000 insertions behind one row; no window tile holds more than its bound."""
    tiles = []
    plain = scan.running

    def watched(df, keys, order, tile, **more):
        tiles.append(df.select(*keys, tile.alias("_t")).groupBy(*keys, "_t").count().agg(F.max("count")).first()[0] or 0)
        return plain(df, keys, order, tile, **more)

    monkeypatch.setattr("quire.operators.forest.running", watched)
    monkeypatch.setattr("quire.operators.edits.running", watched)
    elements = documents(1, 4)
    edits = [(k, 0, 1 if k < 10001 else -5000, "insert", f"t{k}", None, None) for k in range(1, 20002)]
    table, log = spark.createDataFrame(elements, ELEMENT), spark.createDataFrame(edits, EDIT)
    got = E.apply_edits(table, log).select("doc_id", "element_id", "element_index").collect()
    behind = [-k for k in range(20001, 10000, -1)]
    order = [0, 1, *[-k for k in range(10000, 4999, -1)], *behind, *[-k for k in range(4999, 0, -1)], 2, 3]
    assert [r["element_id"] for r in sorted(got, key=lambda r: r["element_index"])] == order
    assert tiles and max(tiles) <= scan.TILE_ROWS
