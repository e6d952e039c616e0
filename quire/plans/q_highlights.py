"""Queries for highlight resolution (H-1..H-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import highlights as H
from quire.plans import derived as V
from quire.plans.q_overview import OVERVIEWS, overviews
from quire.sources.tables import table
from quire.sources.views import displayed_texts

HIGHLIGHTS_CTE = """,
text_highlights AS (SELECT event_id AS highlight_id, event_id // 10 AS doc_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id // 10) * 1000000 + 1 + 5 * (event_id % 2) END AS element_id,
  CASE WHEN event_id % 5 = 0 THEN 'overview' ELSE 'paragraph' END AS scope,
  CASE WHEN event_id % 5 = 0 THEN 'section_summary' WHEN event_id % 4 = 1 THEN 'summary' WHEN event_id % 11 = 7 THEN 'key_points' ELSE 'text' END AS field_name,
  CASE WHEN event_id % 5 = 0 OR (event_id % 4 <> 1 AND event_id % 11 = 7) THEN event_id % 3 END AS item_index,
  CASE WHEN event_id % 13 = 0 THEN 'fr' WHEN event_id % 3 = 0 THEN 'zh' ELSE 'en' END AS language,
  CASE WHEN event_id % 17 = 0 THEN -1 ELSE (event_id * 37) % 60 END AS start_offset, CASE WHEN event_id % 17 = 0 THEN -1 ELSE (event_id * 37) % 60 END + event_id % 25 AS end_offset FROM events)"""
PDF_CTE = """,
pdf_highlights AS (SELECT event_id AS highlight_id, event_id // 10 AS doc_id, (event_id // 10) * 1000000 + event_id % 10 AS element_id, 1 + event_id % 3 AS page_number,
  (event_id % 10) / 20.0 AS x0, event_id % 7 = 0 AS blank FROM events)"""
VALID = HIGHLIGHTS_CTE + """,
valid AS (SELECT * FROM text_highlights WHERE start_offset >= 0 AND end_offset > start_offset AND language IN ('en', 'zh')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, element_id, scope, field_name, item_index, language ORDER BY start_offset, highlight_id) AS pos FROM valid),
walk AS (SELECT *, true AS keep, end_offset AS last FROM ranked WHERE pos = 1
  UNION ALL SELECT r.*, r.start_offset >= w.last, CASE WHEN r.start_offset >= w.last THEN r.end_offset ELSE w.last END FROM walk w JOIN ranked r
  ON r.doc_id = w.doc_id AND r.element_id IS NOT DISTINCT FROM w.element_id AND r.scope = w.scope AND r.field_name = w.field_name AND r.item_index IS NOT DISTINCT FROM w.item_index AND r.language = w.language AND r.pos = w.pos + 1),
kept AS (SELECT * FROM walk WHERE keep),
zh_overviews AS (SELECT *, doc_id % 2 = 0 AS even FROM overviews),
langs AS (SELECT doc_id, element_id, type, intro_text, 'en' AS language, text, summary, key_points, items FROM paper_elements WHERE type <> 'heading'
  UNION ALL SELECT doc_id, element_id, type, intro_text, 'zh', coalesce(nullif(text_zh, ''), text), coalesce(nullif(summary_zh, ''), summary), coalesce(key_points_zh, key_points), coalesce(items_zh, items) FROM paper_elements WHERE type <> 'heading'),
panels AS (SELECT doc_id, 'en' AS language, coalesce(abstract_summary, '') AS abstract_summary, coalesce(overall_summary, '') AS overall_summary, coalesce(overall_key_points, []) AS points,
    list_transform(sections, lambda s: s.summary) AS sums, list_transform(highlights, lambda s: s.summary) AS marks FROM zh_overviews
  UNION ALL SELECT doc_id, 'zh', CASE WHEN even AND abstract_summary <> '' THEN 'zh ' || abstract_summary ELSE coalesce(abstract_summary, '') END, coalesce(overall_summary, ''), CASE WHEN even THEN ['zh'] ELSE coalesce(overall_key_points, []) END,
    list_transform(sections, lambda s: s.summary), list_transform(highlights, lambda s: s.summary) FROM zh_overviews),
texts AS (SELECT doc_id, element_id, 'paragraph' AS scope, 'key_points' AS field_name, (generate_subscripts(key_points, 1) - 1)::BIGINT AS item_index, language, unnest(key_points) AS text FROM langs
  UNION ALL SELECT doc_id, element_id, 'paragraph', 'item', generate_subscripts(items, 1) - 1, language, unnest(items) FROM langs WHERE type = 'bullet_list'
  UNION ALL SELECT doc_id, element_id, 'paragraph', 'summary', NULL, language, summary FROM langs WHERE summary <> ''
  UNION ALL SELECT doc_id, element_id, 'paragraph', 'text', NULL, language, coalesce(nullif(text, ''), '—') FROM langs WHERE type = 'paragraph'
  UNION ALL SELECT doc_id, element_id, 'paragraph', 'intro_text', NULL, language, intro_text FROM langs WHERE type = 'bullet_list' AND intro_text <> ''
  UNION ALL SELECT doc_id, NULL, 'overview', 'abstract_summary', NULL, language, abstract_summary FROM panels WHERE abstract_summary <> ''
  UNION ALL SELECT doc_id, NULL, 'overview', 'overall_summary', NULL, language, overall_summary FROM panels
  UNION ALL SELECT doc_id, NULL, 'overview', 'overall_key_points', generate_subscripts(points, 1) - 1, language, unnest(points) FROM panels
  UNION ALL SELECT doc_id, NULL, 'overview', 'section_summary', generate_subscripts(sums, 1) - 1, language, unnest(sums) FROM panels
  UNION ALL SELECT doc_id, NULL, 'overview', 'highlight_summary', generate_subscripts(marks, 1) - 1, language, unnest(marks) FROM panels)"""
BASE = OVERVIEWS.replace("WITH ", "WITH RECURSIVE ", 1)
KEY = "coalesce(element_id, -1) AS element_id, scope, field_name, coalesce(item_index, -1) AS item_index, language"
SAME = ("h.doc_id = t.doc_id AND h.element_id IS NOT DISTINCT FROM t.element_id AND h.scope = t.scope AND h.field_name = t.field_name "
        "AND h.item_index IS NOT DISTINCT FROM t.item_index AND h.language = t.language")


def text_highlights(spark, folder):
    n = F.col("event_id")
    over, doc = n % 5 == 0, F.floor(n / 10)
    field = F.when(over, "section_summary").when(n % 4 == 1, "summary").when(n % 11 == 7, "key_points").otherwise("text")
    start = F.when(n % 17 == 0, -1).otherwise((n * 37 % 60).cast("int"))
    return table(spark, folder, "events").select(
        n.alias("highlight_id"), doc.alias("doc_id"), F.when(~over, doc * 1000000 + 1 + n % 2 * 5).alias("element_id"), F.when(over, "overview").otherwise("paragraph").alias("scope"),
        field.alias("field_name"), F.when(over | ((n % 4 != 1) & (n % 11 == 7)), (n % 3).cast("int")).alias("item_index"),
        F.when(n % 13 == 0, "fr").when(n % 3 == 0, "zh").otherwise("en").alias("language"), start.alias("start_offset"), (start + n % 25).cast("int").alias("end_offset"))


def pdf_highlights(spark, folder):
    n = F.col("event_id")
    doc, x0 = F.floor(n / 10), n % 10 / 20
    return table(spark, folder, "events").select(
        n.alias("highlight_id"), doc.alias("doc_id"), (doc * 1000000 + n % 10).alias("element_id"), (1 + n % 3).cast("int").alias("page_number"),
        F.when(n % 7 != 0, F.array(F.array(x0, x0, x0 + 0.25, x0 + 0.125))).alias("rects"))


def valid(spark, folder):
    return H.validate_text_highlights(text_highlights(spark, folder))


def texts(spark, folder):
    own = overviews(spark, folder)
    even = F.col("doc_id") % 2 == 0
    zh = own.withColumns({
        "abstract_summary_zh": F.when(even & (F.col("abstract_summary") != ""), F.concat(F.lit("zh "), F.col("abstract_summary"))), "overall_summary_zh": F.lit(None).cast("string"),
        "overall_key_points_zh": F.when(even, F.array(F.lit("zh"))), "highlights_zh": F.col("highlights"), "sections_zh": F.when(even, F.col("sections"))})
    return displayed_texts(V.paper_elements(spark, folder), zh)


def _shown(df):
    return df.withColumns({"element_id": F.coalesce("element_id", F.lit(-1)), "item_index": F.coalesce("item_index", F.lit(-1))})


def _kept_rows(spark, folder):
    kept = H.non_overlapping(valid(spark, folder))
    return _shown(kept.select(*H.TARGET, F.inline("kept"))).select("doc_id", "element_id", "scope", "field_name", "item_index", "language", "highlight_id")


def _toggle(spark, folder):
    moved = valid(spark, folder).withColumn("end_offset", F.when(F.col("highlight_id") % 2 == 0, F.col("end_offset")).otherwise(F.col("start_offset") + 2)).withColumnRenamed("highlight_id", "selection_id")
    return H.toggle(H.non_overlapping(valid(spark, folder)), moved).select("selection_id", "action", F.coalesce("exact_id", F.lit(-1)).alias("exact_id"))


def _boxes(spark, folder):
    from quire.sources.tables import load_page_boxes

    return load_page_boxes(V.raw_pages(spark, folder)).select("doc_id", F.col("page_number").alias("page"), "bbox")


def _unified(spark, folder):
    sizes = V.raw_pages(spark, folder).select("doc_id", F.col("page_number").alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    rects = H.validate_pdf_highlights(pdf_highlights(spark, folder)).select("doc_id", (F.col("page_number") - 1).alias("page"), F.explode("rects").alias("rect"))
    out = H.unify_coordinates(_boxes(spark, folder), rects, sizes, scale=1.5)
    return out.select("doc_id", "page", "source", *[F.round(c, 4).alias(f"rect_{c}") for c in ("left", "top", "width", "height")])


def _by_page(spark, folder):
    located = _boxes(spark, folder).select("doc_id", F.array(F.struct("page", "bbox")).alias("pdf_locations"))
    return H.locations_by_page(located)


QUERIES = {
    "validate_text_highlights": lambda spark, folder: H.judge_text_highlights(text_highlights(spark, folder)).select("highlight_id", F.coalesce("reason", F.lit("ok")).alias("reason")),
    "validate_pdf_highlights": lambda spark, folder: H.validate_pdf_highlights(pdf_highlights(spark, folder)).select("highlight_id", "page_number"),
    "delete_highlights": lambda spark, folder: H.delete_highlights(text_highlights(spark, folder), V.documents(spark, folder).select((F.col("doc_id") * 3).alias("highlight_id"))).select("highlight_id", "doc_id"),
    "missing_highlights": lambda spark, folder: H.missing_highlights(valid(spark, folder), V.documents(spark, folder).select((F.col("doc_id") * 3).alias("highlight_id"))).select("highlight_id"),
    "relevant_highlights": lambda spark, folder: H.relevant_highlights(valid(spark, folder), texts(spark, folder)).select("highlight_id", "doc_id", "field_name", "start_offset"),
    "non_overlapping": _kept_rows,
    "displayed_texts": lambda spark, folder: _shown(texts(spark, folder)),
    "segments": lambda spark, folder: _shown(H.segments(texts(spark, folder), H.non_overlapping(valid(spark, folder)))).select(
        "doc_id", "element_id", "scope", "field_name", "item_index", "language", "segment", "kind", "piece", F.coalesce("highlight_id", F.lit(-1)).alias("highlight_id")),
    "toggle_highlights": _toggle,
    "locations_by_page": _by_page,
    "user_rects_by_page": lambda spark, folder: H.user_rects_by_page(H.validate_pdf_highlights(pdf_highlights(spark, folder))),
    "unify_coordinates": _unified,
}

from quire.plans.q_align import BOXES  # noqa: E402

ORACLES = {
    "validate_text_highlights": f"""{BASE}{HIGHLIGHTS_CTE} SELECT highlight_id, CASE WHEN start_offset < 0 OR end_offset <= start_offset THEN 'invalid_range'
      WHEN language NOT IN ('en', 'zh') THEN 'invalid_language' ELSE 'ok' END AS reason FROM text_highlights""",
    "validate_pdf_highlights": f"{BASE}{PDF_CTE} SELECT highlight_id, page_number FROM pdf_highlights WHERE NOT blank",
    "delete_highlights": f"{BASE}{HIGHLIGHTS_CTE} SELECT highlight_id, doc_id FROM text_highlights WHERE highlight_id NOT IN (SELECT doc_id * 3 FROM documents)",
    "missing_highlights": f"{BASE}{VALID} SELECT doc_id * 3 AS highlight_id FROM documents WHERE doc_id * 3 NOT IN (SELECT highlight_id FROM valid)",
    "relevant_highlights": f"{BASE}{VALID} SELECT h.highlight_id, h.doc_id, h.field_name, h.start_offset FROM valid h WHERE EXISTS (SELECT 1 FROM texts t WHERE {SAME})",
    "non_overlapping": f"{BASE}{VALID} SELECT doc_id, {KEY}, highlight_id FROM kept",
    "displayed_texts": f"{BASE}{VALID} SELECT doc_id, {KEY}, text FROM texts",
    "segments": f"""{BASE}{VALID},
      addressed AS (SELECT row_number() OVER () AS tid, * FROM texts),
      hl AS (SELECT t.tid, t.text, h.highlight_id, h.start_offset AS s, h.end_offset AS e, coalesce(lag(h.end_offset) OVER (PARTITION BY t.tid ORDER BY h.start_offset), 0) AS c FROM addressed t JOIN kept h ON {SAME}),
      pieces AS (
        SELECT tid, s AS o, 0 AS z, 'plain' AS kind, substr(text, c + 1, s - c) AS piece, -1 AS highlight_id FROM hl WHERE s > c
        UNION ALL SELECT tid, s, 1, 'highlight', substr(text, s + 1, e - s), highlight_id FROM hl
        UNION ALL SELECT t.tid, 1000000000, 2, 'plain', substr(t.text, coalesce(m, 0) + 1), -1 FROM addressed t
          LEFT JOIN (SELECT tid, max(e) AS m FROM hl GROUP BY 1) x ON x.tid = t.tid WHERE m IS NULL OR m < length(t.text))
      SELECT doc_id, {KEY}, row_number() OVER (PARTITION BY p.tid ORDER BY o, z) - 1 AS segment, kind, piece, highlight_id FROM pieces p JOIN addressed t ON t.tid = p.tid""",
    "toggle_highlights": f"""{BASE}{VALID},
      sel AS (SELECT highlight_id AS selection_id, doc_id, element_id, scope, field_name, item_index, language, start_offset AS s, CASE WHEN highlight_id % 2 = 0 THEN end_offset ELSE start_offset + 2 END AS e FROM valid),
      hit AS (SELECT t.selection_id, max(CASE WHEN h.start_offset = t.s AND h.end_offset = t.e THEN h.highlight_id END) AS exact_id, bool_or(t.e > h.start_offset AND t.s < h.end_offset) AS over FROM sel t LEFT JOIN kept h ON {SAME} GROUP BY 1)
      SELECT selection_id, CASE WHEN exact_id IS NOT NULL THEN 'delete' WHEN over THEN 'ignore' ELSE 'create' END AS action, coalesce(exact_id, -1) AS exact_id FROM hit""",
    "locations_by_page": f"{BOXES} SELECT doc_id, page_number AS page, count(*) AS n_locations FROM page_boxes GROUP BY 1, 2",
    "user_rects_by_page": f"{BASE}{PDF_CTE} SELECT doc_id, page_number - 1 AS page, count(*) AS n_highlights, count(*) AS n_rects FROM pdf_highlights WHERE NOT blank GROUP BY 1, 2",
    "unify_coordinates": f"""{BOXES}{PDF_CTE}
      SELECT doc_id, page_number AS page, 'element' AS source, x0 * 1.5 AS rect_left, y0 * 1.5 AS rect_top, 300.0::DOUBLE AS rect_width, 120.0::DOUBLE AS rect_height FROM page_boxes
      UNION ALL SELECT h.doc_id, h.page_number - 1, 'user', round(x0 * 612, 4)::DOUBLE, round(x0 * 792, 4)::DOUBLE, 153.0::DOUBLE, 99.0::DOUBLE FROM pdf_highlights h
        JOIN (SELECT DISTINCT doc_id, page_number AS page FROM raw_boxes) p ON p.doc_id = h.doc_id AND p.page = h.page_number - 1 WHERE NOT blank""",
}
