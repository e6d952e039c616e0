"""Queries for sources, sinks and read views (IO-1..IO-16) and the composed job (A-24)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from quire.plans import derived as V
from quire.plans.corpus import process_corpus
from quire.plans.q_elements import building_ctes, fallback_ctes
from quire.plans.q_highlights import HIGHLIGHTS_CTE, PDF_CTE, pdf_highlights, text_highlights
from quire.plans.q_overview import OVERVIEWS, overviews
from quire.plans.q_segment import CHUNKS, structured
from quire.operators.segment import chunk_rows
from quire.session import shared_dir
from quire.sources import snapshots as S
from quire.sources import tables as T
from quire.sources import views as W

BASE = f"WITH {V.PAPER_ELEMENTS}"
PAPERS = """papers AS (SELECT page_id AS doc_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Paper ' || page_id END AS title, 'store/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.PDF' ELSE '.pdf' END AS source_path,
  'processing' AS parse_status, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS zh_started_at FROM pages)"""


def papers(spark, folder):
    n = F.col("page_id")
    return T.table(spark, folder, "pages").select(
        n.alias("doc_id"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("Paper "), n.cast("string"))).alias("title"),
        F.concat(F.lit("store/"), n.cast("string"), F.when(n % 2 == 0, ".PDF").otherwise(".pdf")).alias("source_path"), F.lit("processing").alias("parse_status"),
        F.lit("done").alias("zh_status"), F.timestamp_seconds(F.lit(1704067200) + n).alias("zh_started_at"), F.lit(None).cast("timestamp").alias("zh_finished_at"))


def files(spark, folder):
    url = F.col("url")
    return T.table(spark, folder, "pages").select(
        F.col("page_id").alias("file_id"), F.concat(F.lit("f"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".Pdf").when(F.col("page_id") % 3 == 1, ".txt").otherwise(".pdf")).alias("name"),
        url.alias("source_path"), F.lit(None).cast("timestamp").alias("created_at"))


def _flat_elements(df):
    return df.select("doc_id", "element_index", "type", "text", "summary", F.array_join("key_points", "|").alias("key_points"), F.array_join("items", "|").alias("items"))


def _zh_overviews(spark, folder):
    base = overviews(spark, folder)
    even = F.col("doc_id") % 2 == 0
    return base.withColumns({
        "abstract_summary_zh": F.when(even, F.concat(F.lit("zh "), F.col("abstract_summary"))).otherwise(""), "overall_summary_zh": F.lit(None).cast("string"),
        "overall_key_points_zh": F.when(even, F.array(F.lit("zh"))), "highlights_zh": F.col("highlights"), "sections_zh": F.when(even, F.col("sections"))})


def _deleted(spark, folder):
    kept = W.delete_papers({"elements": V.paper_elements(spark, folder).select("doc_id"), "text_highlights": text_highlights(spark, folder).select("doc_id"),
                            "pdf_highlights": pdf_highlights(spark, folder).select("doc_id")}, T.table(spark, folder, "labels").where("toxic = 1"))
    counts = [df.groupBy(F.lit(name).alias("table_name")).agg(F.count("*").alias("n")) for name, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _status(spark, folder):
    failures = T.table(spark, folder, "events").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "error", "align").otherwise("overview").alias("stage"))
    return W.parse_status(papers(spark, folder), failures).select("doc_id", "parse_status")


def _processed(spark, folder):
    return process_corpus(V.paper_docs(spark, folder)).select("doc_id", "element_index", "type", "section_title", "text", "summary")


def echo_model(prompts):
    """Every passage comes back as one paragraph and, where it is long, its halves as a list."""
    out = []
    for prompt in prompts:
        text = prompt.split("Passage:\n", 1)[1]
        half = len(text) // 2
        elements = [{"type": "paragraph", "text": text, "summary": text[:40], "key_points": [text[:20]]}]
        if len(text) > 400:
            elements.append({"type": "bullet_list", "intro_text": "", "items": [text[:half], text[half:]], "summary": "", "key_points": []})
        out.append((json.dumps({"elements": elements}), len(prompt), 1))
    return out


def _aligned(spark, folder):
    """The whole job: model answers, elements, and their places on the derived pages."""
    rows = process_corpus(V.paper_docs(spark, folder), V.pages(spark, folder), echo_model)
    return rows.select("doc_id", "element_index", "type", "text", "page_number", F.to_json("pdf_rects").alias("pdf_rects"), "match_confidence")


def _upserted(spark, folder):
    base = V.documents(spark, folder).select("doc_id", F.lit("old").alias("overall_summary"))
    new = T.table(spark, folder, "labels").where("quality = 1").select("doc_id", F.lit("new").alias("overall_summary"))
    return W.upsert_overview(base, new)


def _written(spark, folder):
    """All documents, then every third again with other texts and without its headings, then some whose elements are all gone; the table is read back."""
    path = f"{shared_dir(spark)}/elements-{uuid.uuid4().hex}"
    elements = V.paper_elements(spark, folder)
    S.write_elements(elements, path, buckets=16)
    again = elements.where((F.col("doc_id") % 3 == 0) & (F.col("type") != "heading")).withColumn("text", F.concat(F.lit("again "), F.coalesce("text", F.lit(""))))
    S.write_elements(again, path)
    S.write_elements(elements.limit(0), path, documents=T.table(spark, folder, "documents").where("doc_id % 7 = 0"))
    return S.read_elements(spark, path).select("doc_id", "element_index", "content")


def _stages(spark, folder):
    path = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
    W.write_stages(structured(spark, folder), path, "parquet")
    return spark.read.parquet(path).select("doc_id", "stage", "ord", "text")


QUERIES = {
    "intake": lambda spark, folder: T.intake(files(spark, folder)).select("doc_id", "title", "parse_status", "zh_status"),
    "read_markdown": lambda spark, folder: T.read_markdown(T.table(spark, folder, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.col("text")).alias("markdown"))),
    "render_chunk_dump": lambda spark, folder: W.render_chunk_dump(chunk_rows(structured(spark, folder))),
    "write_elements": _written,
    "write_stages": _stages,
    "upsert_overview": _upserted,
    "list_papers": lambda spark, folder: W.list_papers(papers(spark, folder)).select("doc_id", "title", "zh_started_at"),
    "paper_detail": lambda spark, folder: W.paper_detail(papers(spark, folder), V.paper_elements(spark, folder), "zh", hide_subheadings=True).select(
        "doc_id", "paper_title", "element_index", "type", "text", "summary", F.size("pdf_rects").alias("n_rects")),
    "overview_view": lambda spark, folder: W.overview_view(_zh_overviews(spark, folder), "zh").select(
        "doc_id", "abstract_summary", "overall_summary", F.array_join("overall_key_points", "|").alias("points"), F.size("highlights").alias("n_highlights"), F.size("sections").alias("n_sections")),
    "elements_for_lang": lambda spark, folder: _flat_elements(W.elements_for_lang(V.paper_elements(spark, folder), "zh")),
    "highlights_view": lambda spark, folder: W.highlights_view(text_highlights(spark, folder), pdf_highlights(spark, folder), "zh").select("doc_id", "kind", "highlight_id"),
    "delete_papers": _deleted,
    "parse_status": _status,
    "process_corpus": _processed,
    "process_and_align": _aligned,
}
ORACLES = {
    "intake": "SELECT page_id AS doc_id, 'f' || page_id || CASE page_id % 3 WHEN 0 THEN '.Pdf' ELSE '.pdf' END AS title, 'processing' AS parse_status, 'not_started' AS zh_status FROM pages WHERE page_id % 3 <> 1",
    "read_markdown": "SELECT doc_id, CASE WHEN lang = 'fr' THEN '' ELSE text END AS markdown FROM documents",
    "render_chunk_dump": f"""{CHUNKS} SELECT doc_id, chunk_index, '[Chunk ' || chunk_index || ']' || chr(10) || 'section_title: ' || section_title || chr(10) || 'source_block_indices_in_section: [' ||
      replace(source_block_indices, ',', ', ') || ']' || chr(10) || chr(10) || '<<< TEXT >>>' || chr(10) || text || chr(10) || chr(10) || repeat('-', 80) || chr(10) AS dump FROM chunks""",
    "write_elements": f"""{BASE} SELECT doc_id, element_index, CASE WHEN type = 'bullet_list' THEN array_to_string(list_concat(CASE WHEN coalesce(intro_text, '') <> '' THEN [intro_text] ELSE [] END, items), chr(10))
      WHEN doc_id % 3 = 0 THEN 'again ' || coalesce(text, '') ELSE coalesce(text, '') END AS content FROM paper_elements WHERE doc_id % 7 <> 0 AND (doc_id % 3 <> 0 OR type <> 'heading')""",
    "write_stages": f"""{CHUNKS} SELECT doc_id, 'raw_blocks' AS stage, block_index AS ord, block AS text FROM blocks
      UNION ALL SELECT doc_id, role, row_number() OVER (PARTITION BY doc_id, role ORDER BY block_index) - 1, block FROM roles WHERE role IN ('front', 'caption', 'removed')
      UNION ALL SELECT doc_id, 'body_before_merge', pos - 1, block FROM body
      UNION ALL SELECT doc_id, 'body_after_merge', merged_index, block FROM merged
      UNION ALL SELECT doc_id, 'sections', section_id, section_title FROM sections
      UNION ALL SELECT doc_id, 'chunks', chunk_index, text FROM chunks""",
    "upsert_overview": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS overall_summary FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id",
    "list_papers": f"WITH {PAPERS} SELECT doc_id, title, strftime(zh_started_at, '%Y-%m-%dT%H:%M:%S') AS zh_started_at FROM papers ORDER BY doc_id DESC",
    "paper_detail": f"""{BASE}, {PAPERS} SELECT p.doc_id, CASE WHEN title = '' THEN string_split(source_path, '/')[2] ELSE title END AS paper_title, element_index, type,
      coalesce(nullif(text_zh, ''), text) AS text, coalesce(nullif(summary_zh, ''), summary) AS summary, 0 AS n_rects
      FROM papers p JOIN paper_elements e ON e.doc_id = p.doc_id WHERE NOT (type = 'heading' AND level <> 'section')""",
    "overview_view": f"""{OVERVIEWS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'zh ' || abstract_summary ELSE abstract_summary END AS abstract_summary, overall_summary,
      CASE WHEN doc_id % 2 = 0 THEN 'zh' ELSE array_to_string(overall_key_points, '|') END AS points, len(highlights) AS n_highlights, len(sections) AS n_sections FROM overviews""",
    "elements_for_lang": f"""{BASE} SELECT doc_id, element_index, type, coalesce(nullif(text_zh, ''), text) AS text, coalesce(nullif(summary_zh, ''), summary) AS summary,
      array_to_string(coalesce(key_points_zh, key_points), '|') AS key_points, array_to_string(coalesce(items_zh, items), '|') AS items FROM paper_elements""",
    "highlights_view": f"{BASE}{HIGHLIGHTS_CTE}{PDF_CTE} SELECT doc_id, 'text' AS kind, highlight_id FROM text_highlights WHERE language = 'zh' UNION ALL SELECT doc_id, 'pdf', highlight_id FROM pdf_highlights",
    "delete_papers": f"""{BASE}{HIGHLIGHTS_CTE}{PDF_CTE}, ids AS (SELECT doc_id FROM labels WHERE toxic = 1)
      SELECT 'elements' AS table_name, count(*) AS n FROM paper_elements WHERE doc_id NOT IN (SELECT doc_id FROM ids)
      UNION ALL SELECT 'text_highlights', count(*) FROM text_highlights WHERE doc_id NOT IN (SELECT doc_id FROM ids)
      UNION ALL SELECT 'pdf_highlights', count(*) FROM pdf_highlights WHERE doc_id NOT IN (SELECT doc_id FROM ids)""",
    "parse_status": f"WITH {PAPERS} SELECT doc_id, CASE WHEN doc_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'failed' ELSE 'processed' END AS parse_status FROM papers",
    "process_corpus": f"""{CHUNKS}{fallback_ctes('chunks', '')}, drafts AS (SELECT * FROM fallback_rows){building_ctes('chunks')}
      SELECT doc_id, element_index, type, section_title, text, summary FROM built""",
}
