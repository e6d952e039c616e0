"""Answer store and change propagation."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.operators.answers import ask
from quire.plans.jobs import edit_job
from quire.plans.q_jobs import ruled_model

from test_edits import EDIT, ELEMENT, documents

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import test modules


class Counting:
    """A model that notes every prompt in a file and refuses some."""

    def __init__(self, path, refuse=""):
        self.path, self.refuse = str(path), refuse

    def __call__(self, prompts):
        if self.refuse and any(self.refuse in p for p in prompts):
            raise ValueError("refused")
        with open(self.path, "a") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        return ruled_model(prompts)

    def asked(self):
        try:
            with open(self.path) as f:
                return [json.loads(line) for line in f]
        except FileNotFoundError:
            return []


def test_answers_are_stored(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad c")], "k long, prompt string").repartition(3)
    model, store = Counting(tmp_path / "log", "bad"), str(tmp_path / "store")
    first = {r["k"]: (r["content"], r["error"]) for r in ask(prompts, model, store, pause=0.0).collect()}
    assert sorted(model.asked()) == ["a", "b"] and first[1] == first[3] and first[4] == ("", "ValueError: refused")
    model.refuse = ""
    second = {r["k"]: (r["content"], r["error"]) for r in ask(prompts, model, store, pause=0.0).collect()}
    assert sorted(model.asked()) == ["a", "b", "bad c"] and second[1] == first[1] and second[4][1] is None


def job(spark, model, store, edits):
    elements = spark.createDataFrame(documents(2, 8), ELEMENT)
    overviews = spark.createDataFrame([(d, [("s0", "S0", "old"), ("s1", "S1", "old")], [("s0", "Z0", "alt")]) for d in (0, 1)],
                                      "doc_id long, sections array<struct<section_key:string,section_title:string,summary:string>>, sections_zh array<struct<section_key:string,section_title:string,summary:string>>")
    texts = spark.createDataFrame([(1, 0, 1, "paragraph", "text", None), (2, 0, 2, "paragraph", "text", None), (3, 0, None, "overview", "section_summary", 0), (4, 0, None, "overview", "section_summary", 1)],
                                  "highlight_id long, doc_id long, element_id long, scope string, field_name string, item_index int")
    marks = spark.createDataFrame([(1, 0, 1), (2, 0, 2)], "highlight_id long, doc_id long, element_id long")
    return edit_job(elements, overviews, texts, marks, spark.createDataFrame(edits, EDIT), model, store)


def test_levels_change_only_where_their_input_did(spark, tmp_path):
    model = Counting(tmp_path / "log")
    edits = [(1, 0, 1, "update", "new", None, None), (2, 0, 5, "update", "text 5", None, None), (3, 100000, 100003, "bullets", None, " ", ["x", " "])]
    done = job(spark, model, str(tmp_path / "store"), edits)
    state = {(r["level"], r["key"]): r["state"] for r in done.changes.collect()}
    assert state == {("element", "1"): "regenerated", ("element", "5"): "kept", ("element", "100003"): "regenerated", ("section", "S0"): "regenerated", ("section", "S1"): "kept",
                     ("overview", "0"): "updated", ("overview", "1"): "updated", ("text_highlight", "1"): "removed", ("text_highlight", "3"): "removed", ("text_highlight", "4"): "removed"}
    rows = {r["element_id"]: r for r in done.elements.collect()}
    assert rows[5]["summary"] == "s" and rows[5]["text_zh"] == "z" and rows[1]["text_zh"] == "zh new" and rows[100003]["items"] == ["x"] and rows[100003]["items_zh"] == ["zh x"]
    assert rows[1]["items_zh"] is None and not any(r["dirty"] for r in rows.values())
    sections = {r["doc_id"]: [s["summary"] for s in r["sections"]] for r in done.overviews.collect()}
    assert sections[0][0].startswith("sum ") and sections[0][1] == "old"
    n = len(model.asked())
    # two elements, their translations, two sections in two languages; a repeated run asks for nothing
    assert n == 2 + 2 + 4
    again = job(spark, model, str(tmp_path / "store"), edits)
    assert len(model.asked()) == n and sorted(map(str, again.elements.collect())) == sorted(map(str, rows.values()))


def test_failed_rows_wait(spark, tmp_path):
    model = Counting(tmp_path / "log", "will fail")
    done = job(spark, model, None, [(1, 0, 1, "update", "will fail", None, None), (2, 0, 2, "update", "fine", None, None)])
    rows = {r["element_id"]: r for r in done.elements.where(F.col("element_id").isin(1, 2)).collect()}
    assert rows[1]["dirty"] and rows[1]["summary"] is None and not rows[2]["dirty"] and rows[2]["summary"].startswith("sum ")
    assert {r["key"]: r["state"] for r in done.changes.where("level = 'element'").collect()} == {"1": "waiting", "2": "regenerated"}


def test_failed_batches_are_halved(spark, tmp_path):
    """One bad element of eleven: nobody else loses an answer, and only open rows are asked for again."""
    from quire.plans.jobs import translate_batches

    model, store = Counting(tmp_path / "log", "text 5"), str(tmp_path / "store")
    elements = spark.createDataFrame(documents(1, 11), ELEMENT)
    found, work = translate_batches(elements, model, store, attempts=1, pause=0.0)
    state = {r["element_index"]: (r["batch_size"], r["state"]) for r in work.collect()}
    assert state == {**{i: (4, "answered") for i in range(4)}, 4: (1, "answered"), 5: (1, "source kept"), 6: (2, "answered"), 7: (2, "answered"), **{i: (8, "answered") for i in range(8, 11)}}
    zh = {r["element_index"]: r["text_zh"] for r in found.collect()}
    assert zh == {i: "text 5" if i == 5 else f"zh text {i}" for i in range(11)}
    n = len(model.asked())
    assert n == 4
    model.refuse = ""
    again = {r["element_index"]: r["text_zh"] for r in translate_batches(elements, model, store, attempts=1, pause=0.0)[0].collect()}
    assert again[5] == "zh text 5" and len(model.asked()) == n + 1  # the batch of the bad element; the other one is known
