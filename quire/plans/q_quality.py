"""Queries for quality validation (V-1..V-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import quality as R
from quire.functions.arrays import inline_rows, numbered_rows
from quire.operators import quality as O
from quire.operators.segment import block_frame
from quire.plans import duck as D
from quire.plans.derived import paper_docs
from quire.plans.q_text import BLOCKS

PER_PAGE = 6


def paragraphs(spark, folder):
    """Blocks laid out six to a page, the first in the top margin and the last in the bottom one."""
    rows = numbered_rows(block_frame(paper_docs(spark, folder)), "blocks", "doc_id", names=("i", "paragraph"))
    place = F.col("i") % PER_PAGE
    return rows.select(
        "doc_id", F.floor(F.col("i") / PER_PAGE).cast("int").alias("page_number"), place.alias("ord"), "paragraph",
        (F.when(place == 0, 40).otherwise(60 + 100 * place)).cast("double").alias("y0"),
        (F.when(place == 5, 660).otherwise(120 + 100 * place)).cast("double").alias("y1"), F.lit(700.0).alias("page_height"))


def pages(spark, folder):
    """Page features; every document gets one empty page at its end."""
    frame = block_frame(paper_docs(spark, folder))
    last = F.floor((F.size("blocks") + PER_PAGE - 1) / PER_PAGE).cast("int")
    rows = F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(p.alias("page_number")))
    page, doc = F.col("page_number"), F.col("doc_id")
    return inline_rows(frame, rows, "doc_id", key="page_number").select(
        "doc_id", "page_number", F.when(doc % 5 == 0, "complex").otherwise("single").alias("layout_type"),
        F.when(page % 2 == 0, "blocks").otherwise("lines").alias("strategy"), ((doc * 7 + page) % 40).alias("block_count"),
        F.when(page % 4 == 1, F.array(F.lit("many_blocks"), F.lit("tilted_scan"))).alias("parser_warnings"))


PARAGRAPHS = BLOCKS + f""",
paragraphs AS (SELECT doc_id, block_index // {PER_PAGE} AS page_number, block_index % {PER_PAGE} AS ord, block AS paragraph, {D.strip('block')} AS t,
  CASE WHEN block_index % 6 = 0 THEN 40.0 ELSE 60.0 + 100 * (block_index % 6) END AS y0,
  CASE WHEN block_index % 6 = 5 THEN 660.0 ELSE 120.0 + 100 * (block_index % 6) END AS y1, 700.0 AS h FROM blocks)"""
NWS = f"[^{D.SPACES}]"
HEADING = (f"(t <> '' AND ({D.match('t', '^[IVXLC]+[.]' + D.WS + '+[A-Z]')} OR ({D.n_words('t')} <= 10 AND upper(t) = t AND length(t) < 120)))")
CAPTION = "(" + " OR ".join(D.match("lower(t)", p) for p in [
    r"^(fig\.?|figure)" + D.WS + r"*\p{Nd}+", "^(table)" + D.WS + r"*\p{Nd}+", r"^(fig\.?|figure)" + D.WS + r"*[:\-]",
    "^(table)" + D.WS + r"*[:\-]", r"^\([a-z]\)" + D.WS]) + ")"
DOI = D.BEFORE + r"10\.\p{Nd}{4,9}/[-._;()/:A-Za-z0-9]*(?:[A-Za-z0-9_]" + D.AFTER + r"|[-.;()/:][\p{L}\p{N}_])"
MONTHS = D.BEFORE + "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*" + D.WS + r"+\p{Nd}{4}" + D.AFTER


def score(positional: bool) -> str:
    tests = [
        (D.has("lower(t)", *R.PLATFORM_WORDS), 2), (D.has("lower(t)", *R.STATUS_WORDS), 2), (D.match("lower(t)", "arxiv:" + NWS), 3),
        (D.match("t", r"\[[A-Za-z0-9.\-]+\]"), 1), (D.match("t", DOI), 2),
        (D.match("t", D.BEFORE + r"\p{Nd}{1,2}" + D.WS + "+[A-Z][a-z]{2,8}" + D.WS + r"+\p{Nd}{4}" + D.AFTER), 1),
        (D.match("lower(t)", MONTHS), 1), (D.match("t", D.BEFORE + r"20\p{Nd}{2}" + D.AFTER), 1), ("length(t) < 100", 1), ("length(t) < 50", 1),
        ("right(t, 1) NOT IN ('.', '!', '?') AND length(t) < 120", 1)]
    if positional:
        tests += [("y0 < h * 0.08", 2), ("y1 > h * 0.92", 2)]
    return "CASE WHEN t = '' THEN 0 ELSE " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in tests) + " END"


HYPHEN = f"({D.match('t', '[A-Za-z]{3,}-$')} OR {D.match('t', '[A-Za-z]{3,}-' + D.WS + '+[a-z]{2,}')})"
MERGED = D.match("t", "^[IVXLC]+[.]" + D.WS + r"+[A-Z][A-Z\-&," + D.SPACES + "]{4,}" + D.WS + "+[A-Z][a-z]")
SHORT = f"(length(t) < 20 AND NOT {HEADING})"
WARN = [
    ("too_short", SHORT), ("too_long", "length(t) > 2500"), ("caption_like", CAPTION), ("metadata_like", f"({score(True)}) >= 4"),
    ("hyphenation_artifact", HYPHEN), ("heading_body_merged", MERGED), ("no_sentence_ending", "length(t) > 300 AND right(t, 1) NOT IN ('.', '!', '?')"),
    ("fragmented_tokens_possible", D.match("t", D.BEFORE + "[a-zA-Z]{1,2}" + D.WS + "+[a-zA-Z]{1,2}" + D.WS + "+[a-zA-Z]{1,2}" + D.AFTER)),
]
WARNINGS = ("CASE WHEN t = '' THEN 'empty_paragraph' ELSE array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in WARN)
            + "], lambda w: w IS NOT NULL), ',') END")
COUNT_SQL = {
    "heading_like_count": HEADING, "caption_like_count": CAPTION, "metadata_like_count": f"({score(False)}) >= 4", "too_short_count": SHORT,
    "too_long_count": "length(t) > 2500", "hyphenation_artifact_count": HYPHEN, "heading_body_merged_count": MERGED,
    "reference_heading_count": "upper(t) = 'REFERENCES'", "biography_heading_count": "upper(t) IN ('BIOGRAPHIES', 'BIOGRAPHY')",
}
STATS = PARAGRAPHS + ",\nstats AS (SELECT doc_id, page_number, count(*) AS count, round(avg(length(t)), 2) AS avg_length, min(length(t)) AS min_length, " \
    "max(length(t)) AS max_length, " + ", ".join(f"count_if({c}) AS {n}" for n, c in COUNT_SQL.items()) + " FROM paragraphs GROUP BY 1, 2)"
_ZEROS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in O.STATS)
PAGE_TESTS = [
    ("no_paragraphs", "count = 0"), ("only_one_paragraph", "count = 1"), ("average_paragraph_too_long", "avg_length > 1800"),
    ("contains_very_long_paragraphs", "too_long_count >= 1"), ("too_many_short_paragraphs", "too_short_count >= greatest(3, count // 3)"),
    ("too_many_caption_like_paragraphs", "caption_like_count >= greatest(2, count // 4)"), ("contains_metadata_like_text", "metadata_like_count >= 1"),
    ("contains_hyphenation_artifacts", "hyphenation_artifact_count >= 1"), ("contains_heading_body_merged_paragraphs", "heading_body_merged_count >= 1"),
    ("contains_references_section", "reference_heading_count >= 1"), ("contains_biographies_section", "biography_heading_count >= 1"),
    ("complex_layout_page", "layout_type = 'complex'"), ("many_blocks_page", "strategy = 'blocks' AND block_count > 25"),
]
_WEIGHT = "CASE w " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.WEIGHTS.items()) + " ELSE 6 END"
REPORTS = STATS + f""",
page_counts AS (SELECT d.doc_id, coalesce(max(block_index) + 1, 0) AS n FROM documents d LEFT JOIN blocks b ON b.doc_id = d.doc_id GROUP BY 1),
page_list AS (SELECT doc_id, unnest(range(0, (n + 5) // 6 + 1)) AS page_number FROM page_counts),
pages_ AS (SELECT doc_id, page_number, CASE WHEN doc_id % 5 = 0 THEN 'complex' ELSE 'single' END AS layout_type,
  CASE WHEN page_number % 2 = 0 THEN 'blocks' ELSE 'lines' END AS strategy, (doc_id * 7 + page_number) % 40 AS block_count,
  CASE WHEN page_number % 4 = 1 THEN ['many_blocks', 'tilted_scan'] ELSE [] END AS given FROM page_list),
filled AS (SELECT p.*, {_ZEROS} FROM pages_ p LEFT JOIN stats s ON p.doc_id = s.doc_id AND p.page_number = s.page_number),
warned AS (SELECT *, list_concat(given, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in PAGE_TESTS)}], lambda w: w IS NOT NULL)) AS ws FROM filled),
flagged AS (SELECT *, list_sum(list_transform(ws, lambda w: {_WEIGHT})) AS base,
  len(list_filter(list_distinct(ws), lambda w: w IN ({', '.join(f"'{c}'" for c in O.COMPOUND)}))) AS compound FROM warned),
scored AS (SELECT *, least(100, coalesce(base, 0) + CASE WHEN compound >= 3 THEN 20 WHEN compound >= 2 THEN 10 ELSE 0 END)::INT AS risk_score FROM flagged),
reports AS (SELECT *, round(1 - risk_score / 100.0, 2)::DOUBLE AS confidence, CASE WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium' ELSE 'low' END AS risk_level FROM scored)"""


def _flag(rule, name="flag"):
    return lambda spark, folder: paragraphs(spark, folder).select("doc_id", "page_number", "ord", rule(F.col("paragraph")).alias(name))


def _placed(rule, name):
    return lambda spark, folder: paragraphs(spark, folder).select(
        "doc_id", "page_number", "ord", rule(F.col("paragraph"), F.col("y0"), F.col("y1"), F.col("page_height")).alias(name))


def _reports(spark, folder):
    return O.validate_pages(pages(spark, folder), paragraphs(spark, folder))


def _documents(spark, folder):
    report = O.validate_documents(_reports(spark, folder))
    return report.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("high_risk_pages", "medium_risk_pages", "summary_warnings")})


FLAGS = {
    "v_heading_like": (R.v_heading_like, HEADING), "v_caption_like": (R.v_caption_like, CAPTION),
    "is_reference_heading": (R.is_reference_heading, "upper(t) = 'REFERENCES'"),
    "is_biography_heading": (R.is_biography_heading, "upper(t) IN ('BIOGRAPHIES', 'BIOGRAPHY')"),
    "has_hyphenation": (R.has_hyphenation, HYPHEN), "heading_body_merged": (R.heading_body_merged, MERGED),
}
QUERIES = {name: _flag(rule) for name, (rule, _) in FLAGS.items()}
QUERIES |= {
    "metadata_score": _placed(R.metadata_score, "score"),
    "is_metadata_like": _placed(R.is_metadata_like, "flag"),
    "paragraph_warnings": _placed(lambda c, a, b, h: F.array_join(R.paragraph_warnings(c, a, b, h), ","), "warnings"),
    "paragraph_stats": lambda spark, folder: O.paragraph_stats(paragraphs(spark, folder)),
    "validate_pages": lambda spark, folder: _reports(spark, folder).select(
        "doc_id", "page_number", F.array_join("warnings", ",").alias("warnings"), "risk_score", "confidence", "risk_level"),
    "validate_documents": _documents,
}
ORACLES = {name: f"{PARAGRAPHS} SELECT doc_id, page_number, ord, {sql} AS flag FROM paragraphs" for name, (_, sql) in FLAGS.items()}
ORACLES |= {
    "metadata_score": f"{PARAGRAPHS} SELECT doc_id, page_number, ord, {score(True)} AS score FROM paragraphs",
    "is_metadata_like": f"{PARAGRAPHS} SELECT doc_id, page_number, ord, ({score(True)}) >= 4 AS flag FROM paragraphs",
    "paragraph_warnings": f"{PARAGRAPHS} SELECT doc_id, page_number, ord, {WARNINGS} AS warnings FROM paragraphs",
    "paragraph_stats": f"{STATS} SELECT * FROM stats",
    "validate_pages": f"{REPORTS} SELECT doc_id, page_number, array_to_string(ws, ',') AS warnings, risk_score, confidence, risk_level FROM reports",
    "validate_documents": f"""{REPORTS},
      rolled AS (SELECT doc_id, ((2 * sum(100 - risk_score) + count(*)) // (2 * count(*)))::DOUBLE / 100 AS overall_confidence, count(*) AS n, count_if(risk_level = 'high') AS hi, count_if(risk_level = 'medium') AS mid,
        coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (WHERE risk_level = 'high'), '') AS high_risk_pages,
        coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (WHERE risk_level = 'medium'), '') AS medium_risk_pages FROM reports GROUP BY 1)
      SELECT doc_id, overall_confidence, high_risk_pages, medium_risk_pages, array_to_string(list_filter([CASE WHEN hi > 0 THEN 'contains_high_risk_pages' END,
        CASE WHEN mid >= greatest(2, n // 3) THEN 'many_medium_risk_pages' END], lambda w: w IS NOT NULL), ',') AS summary_warnings,
        hi > 0 OR overall_confidence < 0.85 AS needs_manual_review FROM rolled""",
}
