"""Queries for segmentation and packing (S-1..S-7, IO-14, IO-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.blocks import INTRO_TITLE
from quire.operators import segment as S
from quire.plans import duck as D
from quire.plans.derived import paper_docs
from quire.plans.q_blocks import CONTINUES, FACTS, title_sql

ROLES = FACTS + """,
starts AS (SELECT doc_id, min(block_index) AS s FROM facts WHERE NOT should_remove AND NOT is_caption
  AND (section_title = 'ABSTRACT' OR (NOT is_natural_body AND (is_major_heading OR contains(substr(low, 1, 80), 'abstract')))) GROUP BY 1),
tails AS (SELECT f.doc_id, min(block_index) AS t FROM facts f JOIN starts USING (doc_id)
  WHERE block_index > s AND NOT should_remove AND NOT is_caption AND is_tail_heading GROUP BY 1),
flushes AS (SELECT f.doc_id, is_major_heading AND section_title <> 'ABSTRACT' AS flush FROM facts f JOIN starts ON f.doc_id = starts.doc_id AND block_index = s),
fallbacks AS (SELECT doc_id, bool_or(is_natural_body) AS has_candidate,
  min(CASE WHEN NOT should_remove AND NOT is_caption AND n_words >= 20 AND NOT is_keywords_loose THEN block_index END) AS fb FROM facts GROUP BY 1),
roles AS (SELECT f.*, CASE
  WHEN s IS NOT NULL AND block_index > t THEN 'after_tail' WHEN s IS NOT NULL AND block_index = t THEN 'removed'
  WHEN should_remove THEN 'removed' WHEN is_caption THEN 'caption'
  WHEN s IS NOT NULL AND block_index >= s THEN 'body'
  WHEN s IS NOT NULL AND is_natural_body THEN CASE WHEN flush THEN 'body' ELSE 'dropped_candidate' END
  WHEN s IS NOT NULL THEN 'front'
  WHEN has_candidate THEN CASE WHEN is_natural_body THEN 'body' ELSE 'front' END
  WHEN block_index >= fb THEN 'body' ELSE 'front' END AS role
  FROM facts f JOIN fallbacks USING (doc_id) LEFT JOIN starts USING (doc_id) LEFT JOIN tails USING (doc_id) LEFT JOIN flushes USING (doc_id))"""

_ACC = D.first_line("r.acc")
MERGED = ROLES.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
body AS (SELECT doc_id, block_index, block, clean, is_md_heading, is_major_heading, is_bullet, {CONTINUES} AS continues,
  row_number() OVER (PARTITION BY doc_id ORDER BY block_index) AS pos FROM roles WHERE role = 'body'),
fold AS (
  SELECT doc_id, pos, block_index AS first_block_index, block AS acc FROM body WHERE pos = 1
  UNION ALL
  SELECT doc_id, pos, CASE WHEN m THEN first_block_index ELSE block_index END, CASE WHEN m THEN acc || ' ' || block ELSE block END
  FROM (SELECT b.doc_id, b.pos, b.block_index, b.block, r.first_block_index, r.acc,
    {D.strip_md('r.acc')} <> '' AND b.clean <> '' AND NOT starts_with({_ACC}, '## ') AND NOT b.is_md_heading AND NOT b.is_major_heading
    AND NOT b.is_bullet AND coalesce(({title_sql(_ACC, D.strip_md(_ACC))}) IN (SELECT unnest(string_split('REFERENCES REFERENCE BIBLIOGRAPHY ACKNOWLEDGMENT ACKNOWLEDGMENTS ACKNOWLEDGEMENT ACKNOWLEDGEMENTS APPENDIX APPENDICES BIOGRAPHY BIOGRAPHIES', ' '))), true)
    AND NOT {D.match(D.strip_md('r.acc'), '[.!?:;]$')} AND b.continues AS m
    FROM fold r JOIN body b ON b.doc_id = r.doc_id AND b.pos = r.pos + 1)),
islands AS (SELECT doc_id, first_block_index, arg_max(acc, pos) AS block, count(*) AS n_blocks FROM fold GROUP BY 1, 2),
merged AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_block_index) - 1 AS merged_index,
  length(block) AS n_chars, {title_sql(D.first_line('block'), D.strip_md(D.first_line('block')))} AS title FROM islands),
opened AS (SELECT *, merged_index = 0 OR title IS NOT NULL AS opens_section FROM merged),
numbered AS (SELECT *, sum(CASE WHEN opens_section THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY merged_index) - 1 AS section_id FROM opened),
plain_sections AS (SELECT doc_id, section_id, coalesce(arg_min(title, merged_index) FILTER (WHERE opens_section), 'UNKNOWN') AS section_title,
  min(merged_index) AS first_merged_index, count(*) AS n_merged, string_agg(block, chr(10) || chr(10) ORDER BY merged_index) AS joined FROM numbered GROUP BY 1, 2),
clean_sections AS (SELECT *, {D.strip_md('joined')} AS sc, {D.strip_md('section_title')} AS tc FROM plain_sections),
judged AS (SELECT *, sc <> '' AND NOT {D.starts('lower(sc)', 'keywords:', 'keywords ', 'index terms', 'key words')}
  AND NOT {D.match('sc', '(?i)^jel +classification' + D.AFTER)} AND NOT {D.match('sc', r'^[A-Z] *\p{Nd}{1,3}(?: *; *[A-Z] *\p{Nd}{1,3}){1,10}$')}
  AND length(sc) - length(replace(sc, ' ', '')) + 1 >= 60 AND len(regexp_extract_all(sc, '[.!?]')) >= 2 AS is_abstract_candidate,
  lead({D.match('lower(tc)', INTRO_TITLE)}) OVER (PARTITION BY doc_id ORDER BY section_id) AS before_intro FROM clean_sections),
sections AS (SELECT doc_id, section_id, first_merged_index, n_merged, is_abstract_candidate,
  CASE WHEN section_id = 0 AND section_title = 'UNKNOWN' AND before_intro AND is_abstract_candidate THEN 'ABSTRACT' ELSE section_title END AS section_title FROM judged)"""
CHUNKS = MERGED + """,
walk AS (
  SELECT doc_id, merged_index, n_chars AS size, 0 AS chunk_index FROM numbered WHERE merged_index = 0
  UNION ALL
  SELECT n.doc_id, n.merged_index,
    CASE WHEN n.opens_section OR w.size + 2 + n.n_chars > 2200 THEN n.n_chars ELSE w.size + 2 + n.n_chars END,
    CASE WHEN n.opens_section OR w.size + 2 + n.n_chars > 2200 THEN w.chunk_index + 1 ELSE w.chunk_index END
  FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.merged_index = w.merged_index + 1),
chunks AS (SELECT w.doc_id, chunk_index, min(n.section_id) AS section_id, min(s.section_title) AS section_title,
  string_agg(CAST(w.merged_index - s.first_merged_index AS VARCHAR), ',' ORDER BY w.merged_index) AS source_block_indices,
  string_agg(n.block, chr(10) || chr(10) ORDER BY w.merged_index) AS text
  FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.merged_index = w.merged_index
  JOIN sections s ON s.doc_id = n.doc_id AND s.section_id = n.section_id GROUP BY 1, 2)"""

_CHUNK_COLUMNS = "doc_id, chunk_index, section_id, section_title, source_block_indices, text"


def structured(spark, folder):
    return S.structure(paper_docs(spark, folder))


def _chunks(spark, folder):
    return S.chunk_rows(structured(spark, folder)).withColumn("source_block_indices", F.array_join("source_block_indices", ","))


QUERIES = {
    "assign_roles": lambda spark, folder: S.block_rows(structured(spark, folder)).select("doc_id", "block_index", "role"),
    "merge_continuations": lambda spark, folder: S.merged_rows(structured(spark, folder)).select(
        "doc_id", "merged_index", "first_block_index", "n_blocks", "block"),
    "assign_sections": lambda spark, folder: S.sectioned_block_rows(structured(spark, folder)).select(
        "doc_id", "section_id", "block_in_section", "merged_index", "block"),
    "relabel_abstract": lambda spark, folder: S.section_rows(structured(spark, folder)),
    "pack_chunks": _chunks,
    "structure": lambda spark, folder: S.chunk_rows(structured(spark, folder)).groupBy("section_title").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("doc_id").alias("n_docs")),
    "stage_counts": lambda spark, folder: S.stage_counts(structured(spark, folder)),
    "chunk_preview": lambda spark, folder: S.chunk_preview(structured(spark, folder)),
}

ORACLES = {
    "assign_roles": f"{ROLES} SELECT doc_id, block_index, role FROM roles",
    "merge_continuations": f"{MERGED} SELECT doc_id, merged_index, first_block_index, n_blocks, block FROM merged",
    "assign_sections": f"{MERGED} SELECT n.doc_id, n.section_id, merged_index - first_merged_index AS block_in_section, merged_index, block "
                       "FROM numbered n JOIN sections s ON n.doc_id = s.doc_id AND n.section_id = s.section_id",
    "relabel_abstract": f"{MERGED} SELECT doc_id, section_id, section_title, first_merged_index, n_merged FROM sections",
    "is_abstract_candidate": f"{MERGED} SELECT doc_id, section_id, is_abstract_candidate FROM sections",
    "pack_chunks": f"{CHUNKS} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "structure": f"{CHUNKS} SELECT section_title, count(*) AS n_chunks, sum(length(text)) AS n_chars, count(DISTINCT doc_id) AS n_docs FROM chunks GROUP BY 1",
    "stage_counts": f"""{CHUNKS}
      SELECT doc_id, count(block_index) AS raw_block_count, count_if(role = 'front') AS front_matter_block_count,
        count_if(role = 'body') AS body_block_count_before_merge, coalesce(any_value(m), 0) AS body_block_count_after_merge,
        count_if(role = 'caption') AS caption_block_count, count_if(role = 'removed') AS removed_block_count,
        coalesce(any_value(sn), 0) AS section_count, coalesce(any_value(cn), 0) AS chunk_count
      FROM documents d LEFT JOIN roles USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS m FROM merged GROUP BY 1) USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS sn FROM sections GROUP BY 1) USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS cn FROM chunks GROUP BY 1) USING (doc_id) GROUP BY doc_id""",
    "chunk_preview": f"{CHUNKS} SELECT doc_id, chunk_index, section_title, substr(text, 1, 500) AS preview FROM chunks WHERE chunk_index < 3",
}
