"""Queries for overview roll-ups (O-1..O-8, O-10, O-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import overview as O
from quire.operators.evidence import parts
from quire.plans import derived as V
from quire.plans import duck as D

BASE = f"WITH {V.PAPER_ELEMENTS}"
TT = D.strip("coalesce(text, '')")
SUM, KP = D.strip("summary"), "list_filter(list_transform(coalesce(key_points, []), lambda k: trim(k)), lambda k: k <> '')"


def _evidence(summary_tag: str, point_tag: str) -> str:
    return f"list_concat(CASE WHEN {SUM} <> '' THEN [{summary_tag} || {SUM}] ELSE [] END, list_transform({KP}, lambda k: {point_tag} || k))"


_LINES = (f"CASE WHEN type = 'heading' THEN CASE WHEN {TT} <> '' THEN ['[HEADING|' || level || '] ' || {TT}] ELSE [] END ELSE "
          + _evidence("'[ELEMENT ' || element_index || ' SUMMARY] '", "'[ELEMENT ' || element_index || ' KEYPOINT] '") + " END")
SOURCE = BASE + f""",
evidence AS (SELECT doc_id, element_index, {_LINES} AS ls FROM paper_elements),
sources AS (SELECT doc_id, coalesce(string_agg(array_to_string(ls, chr(10)), chr(10) ORDER BY element_index) FILTER (WHERE len(ls) > 0), '') AS source FROM evidence GROUP BY 1)"""
SECTIONS = BASE + f""",
counted AS (SELECT *, count_if(type = 'heading' AND level = 'section') OVER w - 1 AS section_no,
  last_value(CASE WHEN type = 'heading' AND level = 'section' THEN {TT} END IGNORE NULLS) OVER w AS title
  FROM paper_elements WINDOW w AS (PARTITION BY doc_id ORDER BY element_index)),
grouped AS (SELECT doc_id, section_no, title AS section_title, element_index, summary, key_points FROM counted WHERE type <> 'heading' AND title <> ''),
sec AS (SELECT doc_id, section_no, section_title,
  coalesce(string_agg(array_to_string(ls, chr(10)), chr(10) ORDER BY element_index) FILTER (WHERE len(ls) > 0), '') AS source,
  array_to_string((list(trim(summary) ORDER BY element_index) FILTER (WHERE {SUM} <> ''))[1:2], ' ') AS fallback
  FROM (SELECT *, {_evidence("'[SUMMARY] '", "'[KEYPOINT] '")} AS ls FROM grouped) GROUP BY 1, 2, 3),
abs_first AS (SELECT doc_id, min(element_index) AS a FROM paper_elements WHERE type = 'heading' AND upper({TT}) = 'ABSTRACT' GROUP BY 1),
abs_span AS (SELECT f.doc_id, a, min(element_index) FILTER (WHERE type = 'heading' AND level = 'section' AND upper({TT}) <> 'ABSTRACT' AND element_index > a) AS b
  FROM abs_first f JOIN paper_elements e ON f.doc_id = e.doc_id GROUP BY 1, 2),
abs AS (SELECT d.doc_id, coalesce(array_to_string((list({SUM} ORDER BY element_index) FILTER (WHERE {SUM} <> '' AND type <> 'heading' AND element_index > a AND (b IS NULL OR element_index < b)))[1:2], ' '), '') AS abstract_summary
  FROM paper_elements d LEFT JOIN abs_span s ON s.doc_id = d.doc_id GROUP BY 1)"""
KEY = f"trim({D.sub(D.sub('lower(section_title)', rf'[^\p{{L}}\p{{N}}_{D.SPACES}]', ' '), D.WS + '+', '_')}, '_')"


def elements(spark, folder):
    return V.paper_elements(spark, folder)


def overview_answers(spark, folder):
    """One answer per document, the third of each three being no JSON."""
    doc = F.col("doc_id").cast("string")
    good = F.concat(F.lit('{"overall_summary":" All '), doc, F.lit('. ","overall_key_points":["1. a"," ","b"],"highlight_element_ids":[1,"2","x"],'
                    '"highlight_summaries":[{"element_id":"3","title":"T '), doc, F.lit('","summary":" s "},{"element_id":"q","title":"t"},5,{"element_id":7,"title":"","summary":" "}]}'))
    return V.documents(spark, folder).select("doc_id", F.when(F.col("doc_id") % 3 == 2, "nothing").otherwise(good).alias("content"))


def overviews(spark, folder):
    return O.regenerate_overviews(elements(spark, folder), overview_answers(spark, folder))


OVERVIEWS = SECTIONS + f""",
overviews AS (SELECT a.doc_id, abstract_summary, CASE WHEN a.doc_id % 3 = 2 THEN '' ELSE 'All ' || a.doc_id || '.' END AS overall_summary,
  CASE WHEN a.doc_id % 3 = 2 THEN [] ELSE ['1. a', 'b'] END AS overall_key_points, CASE WHEN a.doc_id % 3 = 2 THEN [] ELSE [1, 2] END AS highlight_ids,
  CASE WHEN a.doc_id % 3 = 2 THEN [] ELSE [{{'element_id': 3, 'title': 'T ' || a.doc_id, 'summary': 's'}}] END AS highlights, coalesce(ss, []) AS sections
  FROM abs a LEFT JOIN (SELECT doc_id, list({{'section_key': {KEY}, 'section_title': section_title, 'summary': fallback}} ORDER BY section_no) AS ss FROM sec WHERE coalesce(fallback, '') <> '' GROUP BY 1) s ON s.doc_id = a.doc_id)"""


def _flat(df):
    return df.select(
        "doc_id", "abstract_summary", "overall_summary", F.array_join("overall_key_points", "|").alias("points"), F.array_join(F.col("highlight_ids").cast("array<string>"), ",").alias("ids"),
        F.array_join(F.transform("highlights", lambda h: F.concat_ws(":", h["element_id"].cast("string"), h["title"], h["summary"])), "|").alias("highlights"),
        F.coalesce(F.array_join(F.transform("sections", lambda s: F.concat_ws(":", s["section_key"], s["section_title"], s["summary"])), "|"), F.lit("")).alias("sections"))


def _jump(spark, folder):
    summaries = O.section_summaries(elements(spark, folder)).select("doc_id", F.col("section_no").alias("position"), F.concat(F.lit(" "), F.col("section_title")).alias("section_title"))
    return O.section_jump(summaries, elements(spark, folder)).select("doc_id", "position", "section_title", F.coalesce("target_index", F.lit(-1)).alias("target_index"))


#: Evidence per part in the queries, short enough that documents and sections are cut.
PART = 600


def _parts_sql(keys: str) -> str:
    """Parts of ``placed`` (keys, place, line) by running lengths."""
    half = PART // 2
    return f"""sized AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY {keys} ORDER BY place) - length(line) - 1 AS start, sum(length(line) + 1) OVER (PARTITION BY {keys}) - 1 AS total FROM placed),
pieces AS (SELECT *, unnest(range(0, CASE WHEN total > {PART} THEN (greatest(length(line), 1) + {half} - 1) // {half} ELSE 1 END)) AS i FROM sized),
dealt AS (SELECT {keys}, place, i, CASE WHEN total > {PART} THEN (start + i * {half}) // {half} ELSE 0 END AS part, CASE WHEN total > {PART} THEN substr(line, i * {half} + 1, {half}) ELSE line END AS text FROM pieces),
joined AS (SELECT {keys}, part, string_agg(CASE WHEN i = 0 THEN chr(10) ELSE '' END || text, '' ORDER BY place, i) AS source, first(i ORDER BY place, i) AS i0 FROM dealt GROUP BY {keys}, part)
SELECT {keys}, CAST(part AS BIGINT) AS part, CASE WHEN i0 = 0 THEN substr(source, 2) ELSE source END AS source FROM joined"""


_PROMPT = D.q(f"{O.SECTION_INSTRUCTION}\n\nSection: ")
QUERIES = {
    "overview_source": lambda spark, folder: O.overview_source(elements(spark, folder)),
    "overview_prompts": lambda spark, folder: O.overview_prompts(elements(spark, folder)),
    "overview_parts": lambda spark, folder: parts(O.overview_lines(elements(spark, folder)), ["doc_id"], PART),
    "section_parts": lambda spark, folder: parts(O.section_lines(O.group_sections(elements(spark, folder))), O.SECTION_KEYS, PART),
    "parse_overview": lambda spark, folder: O.parse_overview(overview_answers(spark, folder)).select(
        "doc_id", "overall_summary", F.array_join("overall_key_points", "|").alias("points"), F.size("highlight_ids").alias("n_ids"), F.size("highlights").alias("n_highlights")),
    "group_sections": lambda spark, folder: O.group_sections(elements(spark, folder)).select("doc_id", "section_no", "section_title", "element_index"),
    "section_prompts": lambda spark, folder: O.section_prompts(elements(spark, folder)),
    "section_summaries": lambda spark, folder: O.section_summaries(elements(spark, folder)),
    "abstract_summary": lambda spark, folder: O.abstract_summary(elements(spark, folder)),
    "regenerate_overviews": lambda spark, folder: _flat(overviews(spark, folder)),
    "narration_segments": lambda spark, folder: O.narration_segments(overviews(spark, folder), "zh"),
    "section_jump": _jump,
}
ORACLES = {
    "overview_source": f"{SOURCE} SELECT doc_id, source FROM sources",
    "overview_prompts": f"{SOURCE} SELECT doc_id, {D.q(O.OVERVIEW_INSTRUCTION + chr(10) * 2 + 'Evidence:' + chr(10))} || source AS prompt FROM sources",
    "overview_parts": f"{SOURCE}, placed AS (SELECT doc_id, element_index AS place, array_to_string(ls, chr(10)) AS line FROM evidence WHERE len(ls) > 0), {_parts_sql('doc_id')}",
    "section_parts": f"""{SECTIONS}, placed AS (SELECT doc_id, section_no, section_title, element_index AS place, array_to_string(ls, chr(10)) AS line
      FROM (SELECT *, {_evidence("'[SUMMARY] '", "'[KEYPOINT] '")} AS ls FROM grouped) WHERE len(ls) > 0), {_parts_sql('doc_id, section_no, section_title')}""",
    "parse_overview": f"{OVERVIEWS} SELECT doc_id, overall_summary, array_to_string(overall_key_points, '|') AS points, len(highlight_ids) AS n_ids, len(highlights) AS n_highlights FROM overviews",
    "group_sections": f"{SECTIONS} SELECT doc_id, section_no, section_title, element_index FROM grouped",
    "section_prompts": f"{SECTIONS} SELECT doc_id, section_no, section_title, {_PROMPT} || section_title || {D.q(chr(10) * 2 + 'Evidence:' + chr(10))} || source AS prompt FROM sec",
    "section_summaries": f"{SECTIONS} SELECT doc_id, section_no, section_title, {KEY} AS section_key, fallback AS summary FROM sec WHERE coalesce(fallback, '') <> ''",
    "abstract_summary": f"{SECTIONS} SELECT doc_id, abstract_summary FROM abs",
    "regenerate_overviews": f"""{OVERVIEWS} SELECT doc_id, abstract_summary, overall_summary, array_to_string(overall_key_points, '|') AS points, array_to_string(highlight_ids, ',') AS ids,
      array_to_string(list_transform(highlights, lambda h: concat_ws(':', h.element_id, h.title, h.summary)), '|') AS highlights,
      array_to_string(list_transform(sections, lambda s: concat_ws(':', s.section_key, s.section_title, s.summary)), '|') AS sections FROM overviews""",
    "narration_segments": f"""{OVERVIEWS},
      said AS (SELECT doc_id, list_filter(list_transform(list_concat([abstract_summary, overall_summary], overall_key_points,
        flatten(list_transform(highlights, lambda h: [h.title, h.summary])), flatten(list_transform(sections, lambda s: [s.section_title, s.summary]))), lambda x: {D.strip('x')}), lambda x: x <> '') AS xs FROM overviews),
      rows_ AS (SELECT doc_id, generate_subscripts(xs, 1) - 1 AS segment, unnest(xs) AS x FROM said)
      SELECT doc_id, segment, {D.sub(D.sub(D.sub(D.sub('x', r'(^|[^A-Za-z0-9_])1[.]', r'\1第一點，'), r'(^|[^A-Za-z0-9_])2[.]', r'\1第二點，'), r'(^|[^A-Za-z0-9_])3[.]', r'\1第三點，'), r'(^|[^A-Za-z0-9_])4[.]', r'\1第四點，')} AS text FROM rows_""",
    "section_jump": f"""{SECTIONS},
      ssum AS (SELECT doc_id, section_no AS position, ' ' || section_title AS section_title FROM sec WHERE coalesce(fallback, '') <> ''),
      heads AS (SELECT doc_id, element_index, row_number() OVER (PARTITION BY doc_id ORDER BY element_index) - 1 AS k, lower({TT}) AS key FROM paper_elements WHERE type = 'heading' AND level = 'section'),
      firsts AS (SELECT doc_id, section_title, min(position) AS p FROM ssum GROUP BY 1, 2)
      SELECT s.doc_id, s.position, s.section_title, coalesce(h.element_index, (SELECT min(element_index) FROM heads g WHERE g.doc_id = s.doc_id AND g.key = lower(trim(s.section_title))), -1) AS target_index
      FROM ssum s JOIN firsts f ON s.doc_id = f.doc_id AND s.section_title = f.section_title LEFT JOIN heads h ON h.doc_id = f.doc_id AND h.k = f.p""",
}
