"""Queries for edit-log application (E-1..E-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import edits as E
from quire.operators import overview as O
from quire.plans import derived as V
from quire.plans import duck as D
from quire.plans.q_highlights import HIGHLIGHTS_CTE, PDF_CTE, pdf_highlights, text_highlights
from quire.plans.q_overview import SECTIONS
from quire.session import stored
from quire.sources.tables import table

BASE = f"WITH {V.PAPER_ELEMENTS}"
LOG = f""",
edit_log AS (SELECT event_id + 1 AS edit_seq, event_id // 10 AS doc_id, (event_id // 10) * 1000000 + ((event_id % 10) // 2) * 3 AS element_id,
  CASE event_type WHEN 'click' THEN 'update' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'bullets' ELSE 'insert' END AS op,
  CASE event_type WHEN 'click' THEN 'New text ' || event_id WHEN 'purchase' THEN ' Added ' || event_id || ' ' ELSE '  ' END AS text,
  CASE WHEN event_id % 2 = 0 THEN 'Intro ' ELSE ' ' END AS intro_text, ['one ', ' ', 'two ' || event_id] AS items FROM events),
judged0 AS (SELECT l.*, e.type AS etype, e.section_title, e.element_index AS anchor_index, CASE WHEN e.type IS NULL THEN 'missing_element'
  WHEN op = 'update' AND e.type <> 'paragraph' THEN 'not_a_paragraph' WHEN op = 'bullets' AND e.type <> 'bullet_list' THEN 'not_a_bullet_list'
  WHEN op IN ('insert', 'delete') AND e.type NOT IN ('paragraph', 'bullet_list') THEN 'not_editable' WHEN op = 'insert' AND trim(l.text) = '' THEN 'blank_text' END AS r0
  FROM edit_log l LEFT JOIN paper_elements e ON e.element_id = l.element_id),
gone AS (SELECT element_id, min(edit_seq) AS g FROM judged0 WHERE r0 IS NULL AND op = 'delete' GROUP BY 1),
judged AS (SELECT j.*, CASE WHEN r0 IS NULL AND edit_seq > g THEN 'deleted_before' ELSE r0 END AS reason FROM judged0 j LEFT JOIN gone ON gone.element_id = j.element_id),
good AS (SELECT * FROM judged WHERE reason IS NULL),
upd AS (SELECT element_id, arg_max(text, edit_seq) AS text FROM good WHERE op = 'update' GROUP BY 1),
bul AS (SELECT element_id, arg_max(intro_text, edit_seq) AS intro, arg_max(items, edit_seq) AS items FROM good WHERE op = 'bullets' GROUP BY 1),
del AS (SELECT DISTINCT element_id FROM good WHERE op = 'delete'),
ins AS (SELECT edit_seq, doc_id, anchor_index, trim(text) AS text, section_title FROM good WHERE op = 'insert'),
based AS (SELECT *, CASE WHEN type = 'bullet_list' THEN array_to_string(list_concat(CASE WHEN coalesce(intro_text, '') <> '' THEN [intro_text] ELSE [] END, items), chr(10)) ELSE coalesce(text, '') END AS content FROM paper_elements),
edited AS (SELECT e.doc_id, e.element_id, e.element_index, e.type, e.section_title, coalesce(u.text, e.text) AS text,
  CASE WHEN b.element_id IS NOT NULL THEN nullif(trim(b.intro), '') ELSE e.intro_text END AS intro_text,
  CASE WHEN b.element_id IS NOT NULL THEN list_filter(list_transform(b.items, lambda x: trim(x)), lambda x: x <> '') ELSE e.items END AS items,
  CASE WHEN u.element_id IS NOT NULL THEN u.text WHEN b.element_id IS NOT NULL THEN concat_ws(chr(10), nullif(trim(b.intro), ''), array_to_string(list_filter(list_transform(b.items, lambda x: trim(x)), lambda x: x <> ''), chr(10))) ELSE content END AS content,
  CASE WHEN u.element_id IS NULL AND b.element_id IS NULL THEN e.summary END AS summary, CASE WHEN u.element_id IS NULL AND b.element_id IS NULL THEN e.summary_zh END AS summary_zh,
  u.element_id IS NOT NULL OR b.element_id IS NOT NULL AS dirty, u.element_id IS NOT NULL AS was_updated, b.element_id IS NOT NULL AS was_bullets
  FROM based e LEFT JOIN upd u ON u.element_id = e.element_id LEFT JOIN bul b ON b.element_id = e.element_id),
snapshot AS (SELECT doc_id, element_id, type, section_title, text, intro_text, content, summary, summary_zh, dirty, row_number() OVER (PARTITION BY doc_id ORDER BY old, is_new, rev) - 1 AS element_index FROM (
  SELECT doc_id, element_id, type, section_title, text, intro_text, content, summary, summary_zh, dirty, element_index AS old, 0 AS is_new, 0 AS rev FROM edited WHERE element_id NOT IN (SELECT element_id FROM del)
  UNION ALL SELECT doc_id, -edit_seq, 'paragraph', section_title, text, NULL, text, NULL, NULL, true, anchor_index, 1, -edit_seq FROM ins)),
touched AS (SELECT DISTINCT doc_id, section_title FROM good WHERE trim(coalesce(section_title, '')) <> ''),
refresh AS (SELECT e.doc_id, e.section_title, list({D.strip('summary')} ORDER BY element_index) FILTER (WHERE {D.strip('summary')} <> '') AS en, list({D.strip('summary_zh')} ORDER BY element_index) FILTER (WHERE {D.strip('summary_zh')} <> '') AS zh0
  FROM snapshot e JOIN touched t ON t.doc_id = e.doc_id AND t.section_title = e.section_title WHERE type <> 'heading' GROUP BY 1, 2),
refreshed AS (SELECT doc_id, section_title, en, CASE WHEN len(coalesce(zh0, [])) > 0 THEN zh0 ELSE en END AS zh FROM refresh WHERE len(coalesce(en, [])) > 0)"""


def elements(spark, folder):
    return V.paper_elements(spark, folder)


def edit_log(spark, folder):
    n, kind = F.col("event_id"), F.col("event_type")
    doc = F.floor(n / 10)
    return table(spark, folder, "events").select(
        (n + 1).alias("edit_seq"), doc.alias("doc_id"), (doc * 1000000 + F.floor(n % 10 / 2) * 3).alias("element_id"),
        F.when(kind == "click", "update").when(kind == "error", "delete").when(kind == "view", "bullets").otherwise("insert").alias("op"),
        F.when(kind == "click", F.concat(F.lit("New text "), n.cast("string"))).when(kind == "purchase", F.concat(F.lit(" Added "), n.cast("string"), F.lit(" "))).otherwise("  ").alias("text"),
        F.when(n % 2 == 0, "Intro ").otherwise(" ").alias("intro_text"), F.array(F.lit("one "), F.lit(" "), F.concat(F.lit("two "), n.cast("string"))).alias("items"))


def good(spark, folder):
    return E.accepted(edit_log(spark, folder), elements(spark, folder))


def _refresh(spark, folder):
    judged = stored(good(spark, folder), "accepted-edits")
    return E.section_refresh_source(E.apply_accepted(elements(spark, folder), judged), E.touched_sections(judged))


def section_lists(spark, folder):
    """Overviews with their section lists only."""
    rows = O.section_summaries(elements(spark, folder)).groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("section_no", "section_key", "section_title", "summary"))),
        lambda s: F.struct(s["section_key"].alias("section_key"), s["section_title"].alias("section_title"), s["summary"].alias("summary"))).alias("sections"))
    return rows.withColumn("sections_zh", F.slice("sections", F.lit(2), F.size("sections")))


def _upserted(spark, folder):
    new = _refresh(spark, folder).select("doc_id", "section_title", F.array_join("summaries", " ").alias("summary"), F.concat(F.lit("zh "), F.get("summaries", F.lit(0))).alias("summary_zh"))
    out = E.upsert_section_summaries(section_lists(spark, folder), new)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["section_key"], s["section_title"], s["summary"])), "|").alias(c)
    return out.select("doc_id", text("sections"), text("sections_zh"))


def _ids(df):
    return df.select("highlight_id", "doc_id")


QUERIES = {
    "reject_edits": lambda spark, folder: E.rejected(edit_log(spark, folder), elements(spark, folder)),
    "update_paragraphs": lambda spark, folder: E.update_paragraphs(elements(spark, folder), good(spark, folder)).where("dirty").select("element_id", "text", "content"),
    "update_bullets": lambda spark, folder: E.update_bullets(elements(spark, folder), good(spark, folder)).where("dirty").select(
        "element_id", "intro_text", F.array_join("items", "|").alias("items"), "content"),
    "insert_after": lambda spark, folder: E.inserted_rows(good(spark, folder), E.with_content(elements(spark, folder))).select(
        "element_id", "doc_id", F.col("element_index").alias("anchor_index"), "section_title", "text"),
    "delete_elements": lambda spark, folder: E.delete_elements(elements(spark, folder), good(spark, folder)).select("element_id", "type"),
    "reindex": lambda spark, folder: E.apply_edits(elements(spark, folder), edit_log(spark, folder)).select("doc_id", "element_id", "element_index"),
    "apply_edits": lambda spark, folder: E.apply_edits(elements(spark, folder), edit_log(spark, folder)).select(
        "doc_id", "element_id", "element_index", "type", "section_title", "text", "intro_text", "content", "summary", "dirty"),
    "section_refresh_source": lambda spark, folder: _refresh(spark, folder).select(
        "doc_id", "section_title", F.array_join("summaries", "|").alias("summaries"), F.array_join("summaries_zh", "|").alias("summaries_zh")),
    "section_refresh_prompts": lambda spark, folder: E.section_refresh_prompts(_refresh(spark, folder)),
    "upsert_section_summary": _upserted,
    "invalidate_paragraph_highlights": lambda spark, folder: _ids(E.invalidate_paragraph_highlights(text_highlights(spark, folder), good(spark, folder))),
    "invalidate_pdf_highlights": lambda spark, folder: _ids(E.invalidate_pdf_highlights(pdf_highlights(spark, folder), good(spark, folder))),
    "invalidate_section_highlights": lambda spark, folder: _ids(E.invalidate_section_highlights(
        text_highlights(spark, folder), good(spark, folder), section_lists(spark, folder))),
    "invalidate_overview_highlights": lambda spark, folder: _ids(E.invalidate_overview_highlights(
        text_highlights(spark, folder), good(spark, folder).where(F.col("op") == "delete"))),
}
_PROMPT = "' || chr(10) || chr(10) || 'Section: ' || section_title || chr(10) || chr(10) || 'Summaries:' || chr(10) || array_to_string(list_transform({}, lambda s: '- ' || s), chr(10))"
_KEYSQL = f"trim({D.sub(D.sub('lower(trim(section_title))', rf'[^\p{{L}}\p{{N}}_{D.SPACES}]', ' '), D.WS + '+', '_')}, '_')"
ORACLES = {
    "reject_edits": f"{BASE}{LOG} SELECT edit_seq, doc_id, element_id, op, reason FROM judged WHERE reason IS NOT NULL",
    "update_paragraphs": f"{BASE}{LOG} SELECT element_id, text, content FROM edited WHERE was_updated",
    "update_bullets": f"{BASE}{LOG} SELECT element_id, intro_text, array_to_string(items, '|') AS items, content FROM edited WHERE was_bullets",
    "insert_after": f"{BASE}{LOG} SELECT -edit_seq AS element_id, doc_id, anchor_index, section_title, text FROM ins",
    "delete_elements": f"{BASE}{LOG} SELECT element_id, type FROM paper_elements WHERE element_id NOT IN (SELECT element_id FROM del)",
    "reindex": f"{BASE}{LOG} SELECT doc_id, element_id, element_index FROM snapshot",
    "apply_edits": f"{BASE}{LOG} SELECT doc_id, element_id, element_index, type, section_title, text, intro_text, content, summary, dirty FROM snapshot",
    "section_refresh_source": f"{BASE}{LOG} SELECT doc_id, section_title, array_to_string(en, '|') AS summaries, array_to_string(zh, '|') AS summaries_zh FROM refreshed",
    "section_refresh_prompts": f"""{BASE}{LOG} SELECT doc_id, section_title, 'en' AS lang, '{E.SECTION_INSTRUCTION}{_PROMPT.format('en')} AS prompt FROM refreshed
      UNION ALL SELECT doc_id, section_title, 'zh', '{E.SECTION_INSTRUCTION_ZH}{_PROMPT.format('zh')} FROM refreshed""",
    "upsert_section_summary": f"""{SECTIONS}{LOG},
      listed AS (SELECT doc_id, section_title, {_KEYSQL} AS k, fallback AS summary, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS pos FROM sec WHERE coalesce(fallback, '') <> ''),
      new AS (SELECT doc_id, section_title, {_KEYSQL} AS k, array_to_string(en, ' ') AS summary, 'zh ' || en[1] AS summary_zh FROM refreshed),
      firsts AS (SELECT doc_id, k, min(pos) AS p, min(pos) FILTER (WHERE pos > 1) AS pz FROM listed GROUP BY 1, 2),
      en_rows AS (
        SELECT l.doc_id, pos, 0 AS z, CASE WHEN pos = f.p AND n.k IS NOT NULL THEN n.section_title ELSE l.section_title END AS title, l.k, CASE WHEN pos = f.p AND n.k IS NOT NULL THEN n.summary ELSE l.summary END AS summary
        FROM listed l JOIN firsts f ON f.doc_id = l.doc_id AND f.k = l.k LEFT JOIN new n ON n.doc_id = l.doc_id AND n.k = l.k
        UNION ALL SELECT n.doc_id, 1000000, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.section_title), n.section_title, n.k, n.summary FROM new n LEFT JOIN firsts f ON f.doc_id = n.doc_id AND f.k = n.k WHERE f.p IS NULL),
      zh_rows AS (
        SELECT l.doc_id, pos, 0 AS z, l.section_title AS title, l.k, CASE WHEN pos = f.pz AND n.k IS NOT NULL THEN n.summary_zh ELSE l.summary END AS summary
        FROM listed l JOIN firsts f ON f.doc_id = l.doc_id AND f.k = l.k LEFT JOIN new n ON n.doc_id = l.doc_id AND n.k = l.k WHERE pos > 1
        UNION ALL SELECT n.doc_id, 1000000, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.section_title), n.section_title, n.k, n.summary_zh FROM new n LEFT JOIN firsts f ON f.doc_id = n.doc_id AND f.k = n.k WHERE f.pz IS NULL)
      SELECT d.doc_id, (SELECT string_agg(concat_ws(':', k, title, summary), '|' ORDER BY pos, z) FROM en_rows r WHERE r.doc_id = d.doc_id) AS sections,
        coalesce((SELECT string_agg(concat_ws(':', k, title, summary), '|' ORDER BY pos, z) FROM zh_rows r WHERE r.doc_id = d.doc_id), '') AS sections_zh FROM (SELECT DISTINCT doc_id FROM listed) d""",
    "invalidate_paragraph_highlights": f"""{BASE}{LOG}{HIGHLIGHTS_CTE} SELECT highlight_id, doc_id FROM text_highlights h WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.element_id = h.element_id AND h.scope = 'paragraph' AND (
      (op = 'update' AND field_name IN ('text', 'summary', 'key_points')) OR (op = 'bullets' AND field_name IN ('intro_text', 'item', 'summary', 'key_points'))
      OR (op = 'delete' AND field_name IN ('text', 'summary', 'key_points', 'intro_text', 'item'))))""",
    "invalidate_pdf_highlights": f"{BASE}{LOG}{PDF_CTE} SELECT highlight_id, doc_id FROM pdf_highlights WHERE element_id NOT IN (SELECT element_id FROM del)",
    "invalidate_section_highlights": f"""{SECTIONS}{LOG}{HIGHLIGHTS_CTE},
      listed AS (SELECT doc_id, lower(trim(section_title)) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) - 1 AS pos FROM sec WHERE coalesce(fallback, '') <> ''),
      firsts AS (SELECT doc_id, k, min(pos) AS pos FROM listed GROUP BY 1, 2),
      stale AS (SELECT f.doc_id, pos FROM firsts f WHERE EXISTS (SELECT 1 FROM good g WHERE op IN ('update', 'bullets') AND g.doc_id = f.doc_id AND lower(trim(g.section_title)) = f.k))
      SELECT highlight_id, doc_id FROM text_highlights h WHERE NOT (scope = 'overview' AND field_name = 'section_summary' AND EXISTS (SELECT 1 FROM stale s WHERE s.doc_id = h.doc_id AND s.pos = h.item_index))""",
    "invalidate_overview_highlights": f"""{BASE}{LOG}{HIGHLIGHTS_CTE} SELECT highlight_id, doc_id FROM text_highlights h
      WHERE NOT (scope = 'overview' AND doc_id IN (SELECT doc_id FROM good WHERE op = 'delete'))""",
}
