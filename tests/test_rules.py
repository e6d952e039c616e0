"""Golden rows for single rules, on both sides of the limits."""

import pytest
from pyspark.sql import functions as F

from quire.functions import blocks as R
from quire.functions import boxes as B
from quire.functions import elements as E
from quire.functions import jsontext as J
from quire.functions import quality as Q
from quire.functions import text as X


@pytest.mark.parametrize("block, title", [
    ("## I. INTRODUCTION", "I. INTRODUCTION"), ("_**Abstract**_ text", "ABSTRACT"), ("## _A. Multi-link Flavors_", None),
    ("C. Mitigation strategies", "C. M"), ("3.", "3."), ("7. References", "7. References"), ("REFERENCES", "REFERENCES"), ("plain words", None),
    ("1. A b c d e f g h i j k l m n", "1. A b c d e f g h i j k"),
])
def test_section_title(value, block, title):
    assert value(R.section_title, block) == title


@pytest.mark.parametrize("rule, text, expected", [
    (R.is_intro_title, "1 Introduction", True), (R.is_intro_title, "I. INTRODUCTION", True), (R.is_intro_title, "Introductions", False),
    (R.is_jel, "JEL classification: C 72; C 73; D 83", True), (R.is_jel, "C 72; C 73; D 83", True), (R.is_jel, "C 72", False),
    (R.is_caption, "FIGURE 3 x", True), (R.is_caption, "Fig. 2. x", True), (R.is_caption, "Table 4: x", True), (R.is_caption, "(a) x", True),
    (R.is_caption, "Figure 5 shows x", False), (R.is_page_number, "1234", True), (R.is_page_number, "12345", False),
    (R.is_table_like, "a|b|c\nd|e|f", True), (R.is_table_like, "a|b|c\nd", False), (R.is_table_like, "a | :--", True),
    (R.is_footnote, "> 3 note", True), (R.is_running_header, "Smith et al. on things", True), (R.is_running_header, "a plain sentence.", False),
    (E.is_main_heading, "ABSTRACT", True), (E.is_main_heading, "3. SYSTEM MODEL", True), (E.is_main_heading, "CONCLUSION", True),
    (E.is_main_heading, "3.1 Channel Assignment", False), (E.is_main_heading, "Mitigation strategies:", False), (E.is_main_heading, "I. INTRODUCTION", False),
    (E.is_formula_noise, "x" * 19, True), (E.is_formula_noise, "x" * 20, False), (E.is_formula_noise, "x" * 11 + "+" * 9, False), (E.is_formula_noise, "x" * 10 + "+" * 10, True),
    (Q.heading_body_merged, "VI. RECAP AND CONCLUDING REMARKS Our study confirmed", True), (Q.has_hyphenation, "exam- ple", True), (Q.has_hyphenation, "ends with exam-", True),
    (Q.is_metadata_like, "arXiv:2210.1 [cs.NI] 14 Oct 2022", True),
    (B.is_metadata_box, "42", True), (B.is_metadata_box, "supported in part by someone", True), (B.is_heading_box, "ii. methods", True), (B.is_heading_box, "METHODS USED", True),
])
def test_flags(value, rule, text, expected):
    assert value(rule, text) is expected


def test_metadata_score(value):
    assert value(Q.metadata_score, "arXiv:2210.1 [cs.NI] 14 Oct 2022") == 12


@pytest.mark.parametrize("n, expected", [(34, False), (35, True)])
def test_natural_body_limit(spark, n, expected):
    df = spark.createDataFrame([(" ".join(["word"] * n) + ".",)], "block string")
    assert R.classify_blocks(df).first()["is_natural_body"] is expected


@pytest.mark.parametrize("prev, cur, merge", [("foo bar", "which is", True), ("foo.", "which", False), ("foo", "- x", False), ("foo", "(a", True), ("foo", "However it", True), ("foo", "Other it", False)])
def test_should_merge(value, prev, cur, merge):
    assert value(R.should_merge, prev, cur) is merge


def test_text_forms(value):
    assert value(X.normalize_for_match, "exam-\nple  **A** – ﬁt • WiFi") == "example a-fit  wi-fi"
    assert value(X.normalize_box_text, "a – b") == "a - b"
    assert value(X.strip_emphasis, "**x** and _y_ snake_case_z") == "x and y snakecasez"
    assert value(X.strip_md, " ## A   _b_\n`c` ") == "A b c"
    assert value(X.section_key, " II. Methods & Data ") == "ii_methods_data"
    assert value(X.first_line, "a  b") == "a"
    assert value(X.sanitize_text, None) == ""


@pytest.mark.parametrize("n, heads", [(100, (40, 40)), (99, (25, 25)), (60, (25, 25)), (59, (15, 15)), (30, (15, 15)), (29, (29, 0)), (5, (8, 0))])
def test_anchor_lengths(spark, n, heads):
    assert tuple(spark.range(1).select(B.head_length(F.lit(n)), B.tail_length(F.lit(n))).first()) == heads


@pytest.mark.parametrize("words, expected", [(69, "medium"), (70, "high"), (200, "high"), (201, "medium"), (39, "low"), (40, "medium"), (300, "medium"), (301, "low")])
def test_confidence(spark, words, expected):
    assert spark.range(1).select(B.confidence(F.lit(words), F.lit(100))).first()[0] == expected


@pytest.mark.parametrize("n, points", [(120, 1), (121, 2), (240, 2), (300, 2)])
def test_fallback_key_points(value, n, points):
    assert len(value(E.fallback_key_points, "x" * n)) == points


def test_fallback_summary(value):
    assert value(E.fallback_summary, "One. Two.") == "One."
    assert len(value(E.fallback_summary, "y" * 200)) == 180


@pytest.mark.parametrize("answer, expected", [
    ('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('Sure {"a":1} done', '{"a":1}'), ("nothing", "{}"), ("[1]", "{}"), ("", "{}")])
def test_extract_json(value, answer, expected):
    assert value(J.extract_json, answer) == expected


def test_rects_and_positions(spark):
    row = spark.range(1).select(
        B.dedupe_rects(F.array(F.array(F.lit(1.0001), F.lit(2.0)), F.array(F.lit(1.00011), F.lit(2.0)), F.array(F.lit(1.5), F.lit(2.0)))).alias("r"),
        B.occurrences(F.lit("aaaa"), F.lit("aa")).alias("p"), B.page_column(F.lit(148.0), F.lit(350.0)).alias("left"), B.page_column(F.lit(200.0), F.lit(300.0)).alias("mid")).first()
    assert len(row.r) == 2 and row.p == [0, 1, 2] and row.left == "left" and row.mid == "center"


def test_occurrences_equal_plain_search_across_stretches(spark):
    rows = [("ab" * 300, "aba"), ("é" * 129 + "x", "éé"), ("x" * 127 + "abc" + "y" * 125 + "abc", "abc"), ("abc", "abcd"), ("abc", ""), (None, "a"), ("abc", None), ("", "a")]
    got = [r.p for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, q string").coalesce(1).orderBy("i").select(B.occurrences(F.col("t"), F.col("q")).alias("p")).collect()]
    assert got == [[i for i in range(len(t or "") - len(q or "") + 1) if q and t and t.startswith(q, i)] for t, q in rows]


def test_places_are_compared_in_short_stretches(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("é" * n + "abc",)], "t string").select(F.size(B.occurrences(F.col("t"), F.lit("abc"))).alias("n"))
        start = time.time()
        assert df.first()["n"] == 1
        return time.time() - start

    seconds(100)
    assert seconds(300_000) < 20
