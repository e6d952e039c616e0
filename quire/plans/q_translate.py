"""Queries for translation merging (X-1..X-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import translate as X
from quire.plans import derived as V
from quire.plans.q_overview import OVERVIEWS, overviews
from quire.sources.tables import table

BASE = f"WITH {V.PAPER_ELEMENTS}"
NOW = "2024-01-15 00:00:00"
_T = """,
translations AS (SELECT doc_id, element_index, 'T' || chr(1) || text AS text_zh, 'S ' || summary AS summary_zh,
  CASE WHEN element_index % 4 = 0 THEN key_points[2:] ELSE list_transform(key_points, lambda k: 'k' || k) END AS key_points_zh,
  list_transform(items, lambda k: 'i' || k) AS items_zh FROM paper_elements WHERE element_index % 7 <> 0),
merged AS (SELECT e.doc_id, e.element_index, coalesce('T' || text, '') AS text_zh, coalesce('S ' || summary, '') AS summary_zh,
  CASE WHEN len(t.key_points_zh) = len(coalesce(key_points, [])) THEN t.key_points_zh ELSE coalesce(key_points, []) END AS key_points_zh,
  CASE WHEN len(t.items_zh) = len(coalesce(items, [])) THEN t.items_zh ELSE coalesce(items, []) END AS items_zh
  FROM paper_elements e JOIN translations t ON e.doc_id = t.doc_id AND e.element_index = t.element_index)"""
_FLAT = "array_to_string(key_points_zh, '|') AS key_points_zh, array_to_string(items_zh, '|') AS items_zh"
PAPERS = f"""papers_status AS (SELECT event_id AS doc_id, CASE event_id % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' WHEN 2 THEN 'processing' ELSE 'not_started' END AS zh_status,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 10 = 2 THEN TIMESTAMP '2024-01-14 23:50:00' WHEN event_id % 10 = 4 THEN TIMESTAMP '2024-01-14 23:49:59' ELSE ts END AS zh_started_at FROM events),
refreshed AS (SELECT doc_id, CASE WHEN zh_status = 'processing' AND (zh_started_at IS NULL OR TIMESTAMP '{NOW}' - zh_started_at > INTERVAL 10 MINUTE) THEN 'failed' ELSE zh_status END AS zh_status FROM papers_status)"""


def elements(spark, folder):
    return V.paper_elements(spark, folder)


def translations(spark, folder):
    rows = elements(spark, folder).where(F.col("element_index") % 7 != 0)
    points = F.when(F.col("element_index") % 4 == 0, F.slice("key_points", F.lit(2), F.greatest(F.size("key_points"), F.lit(0)))).otherwise(
        F.transform("key_points", lambda k: F.concat(F.lit("k"), k)))
    return rows.select("doc_id", "element_index", F.concat(F.lit("T\x01"), F.col("text")).alias("text_zh"), F.concat(F.lit("S "), F.col("summary")).alias("summary_zh"),
                       points.alias("key_points_zh"), F.transform("items", lambda k: F.concat(F.lit("i"), k)).alias("items_zh"))


def papers_status(spark, folder):
    n = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("processing", "completed", "processing", "not_started")]), (n % 4 + 1).cast("int"))
    started = F.when(n % 9 == 0, None).when(n % 10 == 2, F.lit("2024-01-14 23:50:00").cast("timestamp")).when(
        n % 10 == 4, F.lit("2024-01-14 23:49:59").cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select(n.alias("doc_id"), status.alias("zh_status"), started.alias("zh_started_at"))


def _flat(df):
    return df.select("doc_id", "element_index", "text_zh", "summary_zh", F.array_join("key_points_zh", "|").alias("key_points_zh"), F.array_join("items_zh", "|").alias("items_zh"))


def _parsed(spark, folder):
    batches = X.number_batches(elements(spark, folder)).groupBy("doc_id", "batch_no").agg(F.min("element_index").alias("m"))
    m = F.col("m").cast("string")
    content = F.concat(F.lit('```json\n{"elements":[{"id":'), m, F.lit(',"text_zh":"old"},{"id":"'), m, F.lit('","text_zh":"t","key_points_zh":["a","b"]},{"id":"x"},9,{"id":'),
                       m, F.lit('000000,"summary_zh":"far"}]}\n```'))
    return X.parse_translations(batches.select("doc_id", "batch_no", content.alias("content"))).select(
        "doc_id", "batch_no", "element_index", F.coalesce("text_zh", F.lit("-")).alias("text_zh"), F.size(F.coalesce("key_points_zh", F.array())).alias("n_points"))


def _overview_zh(spark, folder):
    base = overviews(spark, folder)
    shouted = base.select("doc_id", F.concat(F.lit("zh "), F.col("abstract_summary")).alias("abstract_summary"), F.upper("overall_summary").alias("overall_summary"),
                          F.when(F.col("doc_id") % 2 == 0, F.slice("overall_key_points", F.lit(2), F.size("overall_key_points"))).otherwise(F.transform("overall_key_points", lambda x: F.concat(F.lit("zh "), x))).alias("overall_key_points"),
                          "highlights", F.transform("sections", lambda s: s.withField("summary", F.concat(F.lit("zh "), s["summary"]))).alias("sections"))
    return X.merge_overview_translation(base, shouted).select(
        "doc_id", F.length("abstract_summary_zh").alias("n_abstract"), "overall_summary_zh", F.array_join("overall_key_points_zh", "|").alias("points"),
        F.coalesce(F.array_join(F.transform("sections_zh", lambda s: s["summary"]), "|"), F.lit("")).alias("sections"))


def _fallback(spark, folder):
    failed = elements(spark, folder).where(F.col("element_index") % 3 == 1)
    return _flat(X.translation_fallback(elements(spark, folder), failed))


def _now():
    return F.lit(NOW).cast("timestamp")


QUERIES = {
    "translation_batches": lambda spark, folder: X.translation_batches(elements(spark, folder)),
    "parse_translations": _parsed,
    "merge_translations": lambda spark, folder: _flat(X.merge_translations(elements(spark, folder), translations(spark, folder))),
    "translation_fallback": _fallback,
    "apply_translations": lambda spark, folder: _flat(X.apply_translations(
        elements(spark, folder), X.merge_translations(elements(spark, folder), translations(spark, folder)))),
    "merge_overview_translation": _overview_zh,
    "expire_stale": lambda spark, folder: X.expire_stale(papers_status(spark, folder), _now()).select("doc_id", "zh_status"),
    "translation_decision": lambda spark, folder: X.translation_decision(
        papers_status(spark, folder), V.documents(spark, folder), _now()).select("doc_id", "zh_status", "decision"),
}
ORACLES = {
    "translation_batches": f"""{BASE} SELECT doc_id, element_index // 8 AS batch_no, count(*) AS n_elements, to_json(list({{'id': element_index::VARCHAR, 'type': type, 'level': level, 'text': text,
      'summary': summary, 'key_points': key_points, 'items': items}} ORDER BY element_index))::VARCHAR AS payload FROM paper_elements GROUP BY 1, 2""",
    "parse_translations": f"""{BASE}, b AS (SELECT DISTINCT doc_id, element_index // 8 AS batch_no FROM paper_elements)
      SELECT doc_id, batch_no, batch_no * 8 AS element_index, 't' AS text_zh, 2 AS n_points FROM b WHERE batch_no > 0
      UNION ALL SELECT doc_id, batch_no, batch_no * 8 * 1000000, '-', 0 FROM b WHERE batch_no BETWEEN 1 AND 268""",
    "merge_translations": f"{BASE}{_T} SELECT doc_id, element_index, text_zh, summary_zh, {_FLAT} FROM merged",
    "translation_fallback": f"""{BASE} SELECT doc_id, element_index, text AS text_zh, summary AS summary_zh, array_to_string(coalesce(key_points, []), '|') AS key_points_zh,
      array_to_string(coalesce(items, []), '|') AS items_zh FROM paper_elements WHERE element_index % 3 = 1""",
    "apply_translations": f"""{BASE}{_T}, applied AS (SELECT e.doc_id, e.element_index, coalesce(m.text_zh, e.text_zh) AS text_zh, coalesce(m.summary_zh, e.summary_zh) AS summary_zh,
      coalesce(m.key_points_zh, e.key_points_zh) AS key_points_zh, coalesce(m.items_zh, e.items_zh) AS items_zh FROM paper_elements e LEFT JOIN merged m ON e.doc_id = m.doc_id AND e.element_index = m.element_index)
      SELECT doc_id, element_index, text_zh, summary_zh, {_FLAT} FROM applied""",
    "merge_overview_translation": f"""{OVERVIEWS} SELECT doc_id, length('zh ' || abstract_summary) AS n_abstract, upper(overall_summary) AS overall_summary_zh,
      CASE WHEN doc_id % 2 = 0 THEN array_to_string(overall_key_points, '|') ELSE array_to_string(list_transform(overall_key_points, lambda x: 'zh ' || x), '|') END AS points,
      array_to_string(list_transform(sections, lambda s: 'zh ' || s.summary), '|') AS sections FROM overviews""",
    "expire_stale": f"WITH {PAPERS} SELECT doc_id, zh_status FROM refreshed",
    "translation_decision": f"""WITH {PAPERS} SELECT r.doc_id, zh_status, CASE WHEN d.doc_id IS NULL THEN 'no_overview' WHEN zh_status = 'completed' THEN 'already_exists'
      WHEN zh_status = 'processing' THEN 'processing' ELSE 'run' END AS decision FROM refreshed r LEFT JOIN documents d ON d.doc_id = r.doc_id""",
}
