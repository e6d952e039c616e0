"""Rules read each text once, and the patterns that make them quick mean what the plain ones meant."""

import re

import pytest
from pyspark.sql import functions as F

from quire.functions import blocks as R, boxes as B, text as X
from quire.plans import derived


def plan_of(spark, rule) -> str:
    df = spark.range(1).select(F.concat(F.lit("x"), F.col("id")).alias("block"))
    return df.repartition(2).select(rule(F.col("block")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rule, most", [
    (R.section_title, 1), (lambda c: R.is_intro_title(R.section_title(c)), 2), (R.should_remove, 1), (R.is_running_header, 1),
    (lambda c: R.should_merge(c, F.concat(c, F.lit("y"))), 5), (R.is_license, 1), (R.is_affiliation, 1),
])
def test_block_rules_squeeze_each_text_once(spark, rule, most):
    assert plan_of(spark, rule).count("regexp_replace(CASE") <= most


@pytest.mark.parametrize("rule", [B.is_heading_box, B.is_metadata_box])
def test_box_rules_normalise_each_text_once(spark, rule):
    assert plan_of(spark, rule).count("[–—]") == 1


def test_white_space_class_holds_exactly_the_spaces(spark):
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string")
    got = {r.c for r in chars.where(F.col("c").rlike(X.WS)).collect()}
    assert got == set(X.SPACES)
    breaks = {r.c for r in chars.where(X.first_line(F.concat(F.lit("a"), F.col("c"), F.lit("b"))) == "a").collect()}
    assert breaks == set(X.BREAKS)


TEXTS = ["a  b\t\tc", " a   b ", "x -\ny", "x-\ny-\nz", "a — b–c  –  d", "　a\x85\x85b\n", "ab", "", "é-\né  \t", "a \x1c b", "a- \n b", "\t \ta \t"]


def test_squeeze_and_dashes_as_defined(spark):
    spaces = "[" + re.escape(X.SPACES) + "]"
    word = r"[^\W]"
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", X.squeeze(F.col("t")).alias("s"), X.normalize_for_match(F.col("t")).alias("m")).collect()
    for r in rows:
        assert r.s == re.sub(f"{spaces}+", " ", r.t).strip(" ")
        plain = re.sub(f"(?<={word})-\n(?={word})", "", r.t.replace(" ", " ").replace("\r", "\n"))
        plain = re.sub(f"{spaces}*[–—]{spaces}*", "-", re.sub(f"{spaces}+", " ", plain).strip(" "))
        assert r.m == plain.lower().strip(X.SPACES)


@pytest.mark.parametrize("rule", [X.squeeze, X.strip_md, X.normalize_for_match, X.normalize_markdown, X.first_line])
def test_replacements_run_only_where_something_is_to_replace(spark, rule):
    plan = plan_of(spark, rule)
    assert "CASE WHEN" in plan and not re.search(r"trim\(regexp_", plan)


def test_every_white_space_is_squeezed_and_broken_at(spark):
    spaces, breaks = "[" + re.escape(X.SPACES) + "]", "[" + re.escape(X.BREAKS) + "]"
    texts = [f"{a}x{c}y{c}{d}z é" for c in X.SPACES + "–•" for d in ("", " ", "\n") for a in ("", c, "• ")] + ["plain words", "3. x", "٣. x", "IV. LATE"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.squeeze(F.col("t")).alias("s"), X.first_line(F.col("t")).alias("l")).collect()
    for r in rows:
        assert r.s == re.sub(f"{spaces}+", " ", r.t).strip(" ")
        assert r.l == re.split(breaks, r.t)[0].strip(X.SPACES)


def test_markdown_breaks_and_blanks(value):
    for text, expected in [("a\r\nb\rc", "a\nb\nc"), ("a\t b  c\td", "a b c d"), ("a\n\n\n\nb\n\nc\n", "a\n\nb\n\nc"), ("a\u00a0\u00a0b", "a b"), ("a\r\n\r\n\r\nb", "a\n\nb"), (None, None), ("", "")]:
        assert value(X.normalize_markdown, text) == expected, text


def test_table_and_title_marks(value):
    for text, expected in [("a|:b", True), ("a | - b", True), ("a|b", False), ("|||||x|", True), ("|a|b\n|c|", True), ("a:-b", False), ("", False)]:
        assert value(R.is_table_like, text) is expected, text
    for text, expected in [("3.", "3."), ("٣.", "٣."), ("IV. LATE", "IV. LATE"), ("2.1 Results", "2.1 Results"), ("*_`Abstract`_*", "ABSTRACT"), ("References", "REFERENCES"), ("words", None), ("", None), (None, None)]:
        assert value(R.section_title, text) == expected, text


def test_back_matter_words_among_other_signs(value):
    for text, expected in [("references", True), ("— references —", True), ("r-e-f-erences.", True), ("r e ferences", False),
                           ("references 2", False), ("xappendix", False), ("* appendix", True), ("acknowledgements", True), ("appendixes", False)]:
        assert value(B.is_metadata_box, text) is expected, text


def test_documents_are_dealt_in_several_parts_a_core(spark, tmp_path):
    spark.createDataFrame([(i, "x") for i in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = derived.documents(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert int(re.search(r"RepartitionByExpression \[doc_id#\d+L\], (\d+)", plan).group(1)) >= 4 * spark.sparkContext.defaultParallelism


def test_windows_sum_up_their_boxes(spark):
    from quire.operators import align as A

    norms = ["the 12 cats", "é é", "a", "sat on 3 mats.", "end"]
    body = spark.createDataFrame([([{"norm": n} for n in norms],)], "body array<struct<norm:string>>")
    got = body.select(F.inline(A._windows(F.col("body")))).collect()
    assert {(w["first"], w["last"]) for w in got} == {(i, j) for i in range(5) for j in range(i, min(i + A.WINDOW_BOXES, 5))}
    for w in got:
        text = " ".join(norms[w["first"]:w["last"] + 1])
        counts = [sum(text.count(x) for x in c) for c in A.COUNTED]
        assert (w["n"], w["profile"]) == (len(text), [*counts, len(text) - sum(counts)])


def test_each_box_is_counted_once(spark):
    from quire.operators import align as A

    plan = spark.createDataFrame([([{"norm": "x"}],)], "body array<struct<norm:string>>").select(A._windows(F.col("body")))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and "array_join" not in plan


@pytest.mark.parametrize("name", ["_near", "_bullet_items", "_windows"])
def test_page_estimates_are_written_before_they_are_read_again(spark, name, monkeypatch):
    from quire.plans import q_align

    written = []
    keep = q_align.stored
    monkeypatch.setattr(q_align, "stored", lambda df, label: written.append(label) or keep(df, label))
    getattr(q_align, name)(spark, "/root/testdata/sf0.001")
    assert written == ["pages", "located"]



def body(spark):
    rows = [(d, i, d * 100 + i, "heading" if i % 3 == 0 else "paragraph", "section" if i % 3 == 0 else None, f"T{i}" if i % 3 == 0 else f"text {i}", f"s{i}") for d in range(2) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, element_index int, element_id long, type string, level string, text string, summary string").withColumns({
        "section_title": F.lit("T0"), "key_points": F.array("summary"), "intro_text": F.lit(None).cast("string"), "items": F.lit(None).cast("array<string>"),
        "text_zh": F.lit(None).cast("string"), "summary_zh": F.lit(None).cast("string"), "key_points_zh": F.lit(None).cast("array<string>"), "items_zh": F.lit(None).cast("array<string>")})


def calls(spark):
    """A counter of evaluations and a column that adds to it and stays 0."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def touch(_):
        seen.add(1)
        return 0

    return seen, touch.asNondeterministic()


def test_roll_ups_evaluate_the_elements_once(spark):
    from quire.operators import overview as O

    seen, touch = calls(spark)
    rows = body(spark).repartition(2).withColumn("summary", F.concat("summary", F.repeat(F.lit("x"), touch("element_index"))))
    out = O.regenerate_overviews(rows, spark.createDataFrame([(0, '{"overall_summary": "a"}')], "doc_id long, content string"))
    got = {r.doc_id: [(s.section_title, s.summary) for s in r.sections] for r in out.collect()}
    assert got == {d: [("T0", "s1 s2"), ("T3", "s4 s5")] for d in (0, 1)}
    assert seen.value == 12


def test_displayed_texts_read_the_overviews_once_for_all_languages(spark):
    from quire.sources.views import displayed_texts

    seen, touch = calls(spark)
    one = spark.createDataFrame([(1, "A", "O", ["p"], "zA", None, None)], "doc_id long, abstract_summary string, overall_summary string, overall_key_points array<string>, "
                                "abstract_summary_zh string, overall_summary_zh string, overall_key_points_zh array<string>")
    more = {c: F.lit(None).cast(k) for c, k in (("highlights", "array<struct<element_id:int,title:string,summary:string>>"), ("highlights_zh", "array<struct<element_id:int,title:string,summary:string>>"),
            ("sections", "array<struct<section_key:string,section_title:string,summary:string>>"), ("sections_zh", "array<struct<section_key:string,section_title:string,summary:string>>"))}
    panels = one.withColumns(more).repartition(2).withColumn("doc_id", F.col("doc_id") + touch("doc_id"))
    got = {(r.field_name, r.item_index, r.language, r.text) for r in displayed_texts(body(spark).limit(0), panels).collect()}
    assert got == {("abstract_summary", None, "en", "A"), ("abstract_summary", None, "zh", "zA"), ("overall_summary", None, "en", "O"), ("overall_summary", None, "zh", "O"),
                   ("overall_key_points", 0, "en", "p"), ("overall_key_points", 0, "zh", "p")}
    assert seen.value == 1


def test_edit_job_evaluates_its_inputs_once(spark):
    import json

    from quire.plans.jobs import edit_job
    from quire.plans.q_highlights import pdf_highlights, text_highlights

    seen, touch = calls(spark)
    rows = body(spark).repartition(2).withColumn("element_index", F.col("element_index") + touch("element_id"))
    seen_edits, touch_edit = calls(spark)
    edits = spark.createDataFrame([(1, 0, 1, "update", "new", None, None), (2, 0, 99, "update", "lost", None, None)],
                                  "edit_seq long, doc_id long, element_id long, op string, text string, intro_text string, items array<string>")
    edits = edits.repartition(2).withColumn("edit_seq", F.col("edit_seq") + touch_edit("edit_seq"))
    shape = "array<struct<section_key:string,section_title:string,summary:string>>"
    overviews = spark.createDataFrame([(0,), (1,)], "doc_id long").withColumns({"sections": F.array().cast(shape), "sections_zh": F.array().cast(shape)})
    texts, marks = (f(spark, "/root/testdata/sf0.001").limit(0) for f in (text_highlights, pdf_highlights))
    job = edit_job(rows, overviews, texts, marks, edits, lambda ps: [(json.dumps({"summary": "S", "key_points": []}), 1, 1) for _ in ps])
    assert {(r.element_id, r.text) for r in job.elements.where("summary = 'S'").collect()} == {(1, "new")}
    assert [(r.edit_seq, r.reason) for r in job.rejected.collect()] == [(2, "missing_element")]
    assert (seen.value, seen_edits.value) == (12, 2)


def test_intake_cuts_each_document_once(spark):
    from quire.streaming import intake

    seen, touch = calls(spark)
    docs = spark.createDataFrame([(1, "## I. INTRODUCTION\n\n" + "Some words of a longer text here. " * 9)], "doc_id long, markdown string").repartition(2)
    docs = docs.withColumn("markdown", F.concat("markdown", F.repeat(F.lit("x"), touch("doc_id"))))
    tables = intake._tables(docs, None, None)
    assert tables["chunks"].count() == 1 and tables["elements"].count() > 0 and tables["papers"].count() == 1
    assert seen.value == 1


def test_translation_sends_no_table_through_the_driver(spark):
    import json

    from quire.operators import overview as O, translate as X
    from quire.operators.answers import ask
    from quire.session import stored

    rows = stored(body(spark), "rows")
    own = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")
    given = stored(rows.select("doc_id", "element_index", F.lit("t").alias("text_zh"), F.lit("s").alias("summary_zh"), "key_points_zh", "items_zh"), "given")
    answered = ask(X.translation_prompts(X.translation_batches(rows)), lambda ps: [(json.dumps({"elements": []}), 1, 1) for _ in ps])
    frames = [X.number_batches(rows), X.translation_batches(rows), X.merge_translations(rows, given), X.translation_fallback(rows, given), X.apply_translations(rows, given), answered,
              O.regenerate_overviews(rows, stored(rows.select("doc_id", F.lit("{}").alias("content")).distinct(), "answers"))]
    assert [own(df) for df in frames] == [0] * len(frames)
    assert answered.count() == 2 and X.apply_translations(rows, given).where("text_zh = 't'").count() == 12
