"""Corpora derived from the given tables so that every rule meets matching text.

The driver tables hold plain prose: no headings, captions, bullets or page boxes. Each
recipe here adds them by arithmetic on ids over the whole table, and is stated twice, once
as DataFrame code and once as SQL for the check engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.plans.duck import LINES, q, sub
from quire.sources.tables import table

# Blocks placed after line i of a document.
INJECTED = [
    None,
    "Fig. 1. A caption.",
    "42",
    "| a | b |\n|---|---|\n| 1 | 2 |",
    "## II. METHODS",
    "- first item of a list",
    "Keywords: alpha, beta",
    "2.1\n\nHowever the parts\n\nand the rest",
    "REFERENCES",
    "see www.example.org and 10.1145/12345.678 for more",
    "**Bold** and _em_ WiFi – Fi “quoted” ﬁt • snake_case exam-\nple ends here",
    "J. Doe is with the University of Somewhere, e-mail: a@b.org",
    "## III. LITERATURE REVIEW",
    "JEL classification: C 72; D 83",
    "> 3 a footnote",
    "==> picture [10 x 20] intentionally omitted <==",
    "© 2024 The Authors. Published by Elsevier Science",
    "Some Author et al. Frontiers of things",
    "C. Mitigation strategies",
    "3.",
]
# The block after the first line, by doc_id % 4.
OPENERS = [None, "_**Abstract**_ of the work", "## I. INTRODUCTION", "1. Introduction"]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The texts, dealt out by id: the test files have one row group each, which one task would read and derive from alone.

    Several parts to a core, so that one long document or a slow core does not hold up the rest.
    """
    return table(spark, folder, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")


def paper_docs(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, markdown)"""
    injected = F.array(*[F.lit(x).cast("string") for x in INJECTED])
    openers = F.array(*[F.lit(x).cast("string") for x in OPENERS])

    def pieces(line, i):
        n = F.col("doc_id") + i
        shaped = (
            F.when(n % 5 == 0, F.regexp_replace(line, "[.!?]$", ""))
            .when(n % 5 == 1, F.concat(F.lower(F.substring(line, 1, 1)), F.substring(line, 2, 1 << 30)))
            .otherwise(line)
        )
        extra = F.when(i == 0, F.get(openers, (F.col("doc_id") % 4).cast("int"))).when(
            (i == 8) & (F.col("doc_id") % 3 != 0), F.lit(None)).otherwise(F.get(injected, i))
        return F.filter(F.array(shaped, extra), lambda p: p.isNotNull())

    lines = F.split("text", "\n")
    return documents(spark, folder).select("doc_id", F.array_join(F.flatten(F.transform(lines, pieces)), "\n\n").alias("markdown"))


def _cases(column: str, values: list[str | None]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values) if v is not None) + " END"


PAPER_DOCS = LINES + f""",
pieces AS (
  SELECT doc_id, i, 0 AS j,
         CASE (doc_id + i) % 5 WHEN 0 THEN {sub('line', '[.!?]$', '')}
                               WHEN 1 THEN lower(substr(line, 1, 1)) || substr(line, 2) ELSE line END AS piece FROM lines
  UNION ALL
  SELECT doc_id, i, 1, CASE WHEN i = 0 THEN {_cases('doc_id % 4', OPENERS)}
                            WHEN i = 8 AND doc_id % 3 <> 0 THEN NULL ELSE {_cases('i', INJECTED)} END FROM lines),
paper_docs AS (SELECT doc_id, string_agg(piece, chr(10) || chr(10) ORDER BY i, j) AS markdown
               FROM pieces WHERE piece IS NOT NULL GROUP BY doc_id)"""


# Headings placed before every third line, with their levels.
HEADINGS = [
    ("ABSTRACT", "section"), ("I. INTRODUCTION", "section"), ("II. METHODS", "section"),
    ("A. Details of the setup", "subsection"), ("3. RESULTS", "section"), ("3.1 First results", "subsection"),
    ("CONCLUSION", "section"), ("Mitigation strategies:", "subsection"), ("(a) part one", "subsection"),
    ("IV. LITERATURE REVIEW", "section"), ("Plain words here", "subsection"), ("x", "section"),
]
# Section titles of chunks, by (chunk_index + doc_id) % 7 after halving the chunk index.
CHUNK_TITLES = ["UNKNOWN", "ABSTRACT", "I. INTRODUCTION", "II. METHODS", "II. METHODS", " ", "3. Results"]
CHUNK_LINES = 4


def paper_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, chunk_index, section_title, first, second, text): four lines to a chunk."""
    titles = F.array(*[F.lit(t) for t in CHUNK_TITLES])
    lines = documents(spark, folder).select("doc_id", F.split("text", "\n").alias("ls"))
    chunk = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / CHUNK_LINES).cast("int")), lambda k: F.struct(
        k.alias("chunk_index"), F.slice("ls", k * CHUNK_LINES + 1, CHUNK_LINES).alias("part")))
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), '["\\\\\\x00-\\x1f]', "")
    half = (F.floor(F.col("chunk_index") / 2) + F.col("doc_id")) % 7
    return lines.select("doc_id", F.inline_outer(chunk)).select(
        "doc_id", "chunk_index", F.get(titles, half.cast("int")).alias("section_title"),
        safe(F.get("part", F.lit(0))).alias("first"), safe(F.get("part", F.lit(1))).alias("second"),
        F.array_join("part", "\n\n").alias("text"))


PAPER_CHUNKS = LINES + f""",
paper_chunks AS (SELECT doc_id, i // {CHUNK_LINES} AS chunk_index,
  {_cases(f'((i // {CHUNK_LINES}) // 2 + doc_id) % 7', CHUNK_TITLES)} AS section_title,
  coalesce(max(regexp_replace(line, '["\\\\\\x00-\\x1f]', '', 'g')) FILTER (WHERE i % {CHUNK_LINES} = 0), '') AS first,
  coalesce(max(regexp_replace(line, '["\\\\\\x00-\\x1f]', '', 'g')) FILTER (WHERE i % {CHUNK_LINES} = 1), '') AS second,
  string_agg(line, chr(10) || chr(10) ORDER BY i) AS text FROM lines GROUP BY 1, 2, 3)"""

# Pieces of a model answer around two lines of the chunk.
ANSWER = [
    '{"elements":[{"type":"Paragraph ","text":"**', '**","summary":"',
    '","key_points":["a",""," b","c","d","e"]},{"type":"heading","text":"X"},7,{"type":"bullet_list","intro_text":"_Intro_:","items":["- ',
    '","• ', '","short",null],"summary":"","key_points":"none"},{"type":"figure"},{"type":"paragraph","text":"', '","summary":null}]}',
]


def model_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Answers in every shape: plain, fenced, inside prose, broken, a list, a wrong type."""
    first, second = F.col("first"), F.col("second")
    a = [F.lit(x) for x in ANSWER]
    good = F.concat(a[0], first, a[1], F.substring(first, 1, 30), a[2], first, a[3], second, a[4], second, a[5])
    kind = F.col("chunk_index") % 6
    content = (
        F.when(kind == 0, good).when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Sure: "), good, F.lit(" hope it helps"))).when(kind == 3, "no json here {")
        .when(kind == 4, "[1, 2]").otherwise('{"elements": "none"}'))
    return paper_chunks(spark, folder).select(
        "doc_id", "chunk_index", content.alias("content"), F.length("text").alias("tokens_in"), F.length(content).alias("tokens_out"))


_GOOD = " || ".join([q(ANSWER[0]), "first", q(ANSWER[1]), "substr(first, 1, 30)", q(ANSWER[2]), "first", q(ANSWER[3]), "second",
                     q(ANSWER[4]), "second", q(ANSWER[5])])
RESPONSES = PAPER_CHUNKS + f""",
model_responses AS (SELECT doc_id, chunk_index, text, section_title, length(text) AS tokens_in, CASE chunk_index % 6
  WHEN 0 THEN {_GOOD} WHEN 1 THEN '```json' || chr(10) || {_GOOD} || chr(10) || '```' WHEN 2 THEN 'Sure: ' || {_GOOD} || ' hope it helps'
  WHEN 3 THEN 'no json here {{' WHEN 4 THEN '[1, 2]' ELSE '{{"elements": "none"}}' END AS content FROM paper_chunks)"""


def paper_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered elements: a heading before every third line, every fourth line a bullet list."""
    from quire.functions.arrays import inline_rows
    from quire.functions.elements import fallback_key_points, fallback_summary

    headings = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(v).alias("level")) for t, v in HEADINGS])
    none = F.lit(None)
    texts = none.cast("array<string>")

    def zh(i, value):
        return F.when(i % 3 == 0, F.concat(F.lit("zh "), value)).when(i % 3 == 1, "")

    def zh_list(i, items):
        return F.when(i % 3 == 0, F.transform(items, lambda x: F.concat(F.lit("zh "), x)))

    def rows(line, i):
        head = F.get(headings, ((F.floor(i / 3) + F.col("doc_id")) % len(HEADINGS)).cast("int"))
        bullet = i % 4 == 2
        items = F.filter(F.split(line, r"\. "), lambda x: x != "")
        points = fallback_key_points(line)
        summary = F.when(i % 5 == 4, "").otherwise(fallback_summary(line))

        def row(kind, text, level, summary, points, intro, items, text_zh, summary_zh, points_zh, items_zh):
            return F.struct(
                kind.alias("type"), head["title"].alias("section_title"), text.cast("string").alias("text"), level.cast("string").alias("level"),
                summary.cast("string").alias("summary"), points.alias("key_points"), intro.cast("string").alias("intro_text"), items.alias("items"),
                text_zh.cast("string").alias("text_zh"), summary_zh.cast("string").alias("summary_zh"), points_zh.alias("key_points_zh"), items_zh.alias("items_zh"))

        heading = row(F.lit("heading"), head["title"], head["level"], none, texts, none, texts, none, none, texts, texts)
        body = row(
            F.when(bullet, "bullet_list").otherwise("paragraph"), F.when(~bullet, line), none, summary, points,
            F.when(bullet & (i % 8 == 2), "Main points:").when(bullet, ""), F.when(bullet, items),
            F.when(~bullet, zh(i, line)), zh(i, summary), zh_list(i, points), F.when(bullet, zh_list(i, items)))
        return F.filter(F.array(F.when(i % 3 == 0, heading), body), lambda x: x.isNotNull())

    flat = F.flatten(F.transform(F.split("text", "\n"), rows))
    numbered = F.transform(flat, lambda x, i: F.struct(i.cast("int").alias("element_index"), x.alias("e")))
    return inline_rows(documents(spark, folder), numbered, "doc_id", key="element_index").select(
        "doc_id", "element_index", (F.col("doc_id") * 1000000 + F.col("element_index")).alias("element_id"), "e.*")


def sql_summary(x: str) -> str:
    from quire.plans.duck import WS, strip

    first = f"regexp_extract({x}, {q('(?s)^(.*?[.!?])' + WS)}, 1)"
    return f"substr({strip(f'coalesce(nullif({first}, {q("")}), {x})')}, 1, 180)"


def sql_key_points(x: str) -> str:
    from quire.plans.duck import strip

    t = strip(x)
    second = strip(f"substr({t}, 121, 120)")
    return (f"CASE WHEN length({t}) <= 120 THEN [{t}] WHEN {second} = '' THEN [{strip(f'substr({t}, 1, 120)')}] "
            f"ELSE [{strip(f'substr({t}, 1, 120)')}, {second}] END")


def _zh(value: str) -> str:
    return f"CASE i % 3 WHEN 0 THEN 'zh ' || {value} WHEN 1 THEN '' END"


_N = len(HEADINGS)
PAPER_ELEMENTS = LINES + f""",
shaped AS (SELECT *, {_cases(f'(i // 3 + doc_id) % {_N}', [t for t, _ in HEADINGS])} AS section_title,
  {_cases(f'(i // 3 + doc_id) % {_N}', [v for _, v in HEADINGS])} AS hlevel, i % 4 = 2 AS bullet,
  list_filter(string_split(line, '. '), lambda x: x <> '') AS parts, {sql_key_points('line')} AS points,
  CASE WHEN i % 5 = 4 THEN '' ELSE {sql_summary('line')} END AS short FROM lines),
unnumbered AS (
  SELECT doc_id, i, 0 AS j, 'heading' AS type, section_title, section_title AS text, hlevel AS level, NULL::VARCHAR AS summary, NULL::VARCHAR[] AS key_points,
    NULL::VARCHAR AS intro_text, NULL::VARCHAR[] AS items, NULL::VARCHAR AS text_zh, NULL::VARCHAR AS summary_zh, NULL::VARCHAR[] AS key_points_zh, NULL::VARCHAR[] AS items_zh
  FROM shaped WHERE i % 3 = 0
  UNION ALL
  SELECT doc_id, i, 1, CASE WHEN bullet THEN 'bullet_list' ELSE 'paragraph' END, section_title, CASE WHEN NOT bullet THEN line END, NULL, short, points,
    CASE WHEN bullet AND i % 8 = 2 THEN 'Main points:' WHEN bullet THEN '' END, CASE WHEN bullet THEN parts END,
    CASE WHEN NOT bullet THEN {_zh('line')} END, {_zh('short')}, CASE WHEN i % 3 = 0 THEN list_transform(points, lambda x: 'zh ' || x) END,
    CASE WHEN bullet AND i % 3 = 0 THEN list_transform(parts, lambda x: 'zh ' || x) END FROM shaped),
paper_elements AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS element_index,
  doc_id * 1000000 + row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS element_id FROM unnumbered)"""


PAGE_BLOCKS = 6


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of six blocks as an extractor delivers them, with some unsound boxes."""
    from quire.functions.arrays import inline_rows
    from quire.functions.text import block_array

    frame = paper_docs(spark, folder).select("doc_id", block_array(F.col("markdown")).alias("bs"))
    count = F.floor((F.size("bs") + PAGE_BLOCKS - 1) / PAGE_BLOCKS).cast("int")
    pages = F.transform(F.filter(F.sequence(F.lit(0), count), lambda p: p < count), lambda p: F.struct(
        p.alias("page_number"), F.slice("bs", p * PAGE_BLOCKS + 1, PAGE_BLOCKS).alias("part")))

    def box(b, o):
        n = F.col("doc_id") + F.col("page_number") * PAGE_BLOCKS + o
        before = F.array_join(F.slice("part", F.lit(1), o), "\n\n")
        start = F.when(o == 0, 0).otherwise(F.length(before) + 2)
        stop = F.when(n % 31 == 0, start + 1000000).otherwise(start + F.length(b))
        x0, y0 = F.when(o % 2 == 0, 50.0).otherwise(310.0), (60 + 100 * o).cast("double")
        kind = F.when(b.startswith("- "), "list-item").when(b.startswith("==>"), "picture").otherwise("text")
        return F.struct(o.alias("index"), kind.alias("class"), F.when(n % 29 != 0, F.array(x0, y0, x0 + 200, y0 + 80)).alias("bbox"), F.array(start, stop).alias("pos"))

    return inline_rows(frame, pages, "doc_id", key="page_number").select(
        "doc_id", "page_number", F.array_join("part", "\n\n").alias("page_text"), F.transform("part", box).alias("boxes"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    from quire.operators.align import index_pages
    from quire.sources.tables import load_pages

    return index_pages(load_pages(raw_pages(spark, folder)))


def align_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, element_index, text): two blocks each, some cut and some respelt."""
    from quire.functions.arrays import numbered_rows
    from quire.functions.text import block_array

    frame = paper_docs(spark, folder).select("doc_id", block_array(F.col("markdown")).alias("bs"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("bs") - 1) / 2).cast("int")), lambda j: F.array_join(F.slice("bs", j * 2 + 1, 2), " "))
    rows = numbered_rows(frame.where(F.size("bs") > 0), pairs, "doc_id", names=("element_index", "text"))
    j = F.col("element_index")
    return rows.withColumn("text", F.when(j % 7 == 3, F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
                           .when(j % 9 == 4, F.replace("text", F.lit("e"), F.lit("a"))).otherwise(F.col("text")))
