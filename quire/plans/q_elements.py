"""Queries for the generated-text stage and element building (C-21..C-29, L-1..L-9, O-9, A-23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import elements as E
from quire.functions.jsontext import extract_json, parse_json_list
from quire.operators import building, drafting
from quire.plans import derived as V
from quire.plans import duck as D
from quire.plans.q_blocks import CAPTION_NUMBERED
from quire.plans.q_text import BLOCKS, blocks
from quire.session import stored

NOT_WS = f"[^{D.SPACES}]"
ALPHA = rf"^(?:[A-Z]\.|\([a-zA-Z]\)){D.WS}+{NOT_WS}"
DECIMAL = rf"^\p{{Nd}}+\.\p{{Nd}}+(?:\.\p{{Nd}}+)*{D.WS}+{NOT_WS}"
T = D.strip("block")


def header(x: str) -> str:
    return (f"({D.has(f'lower({x})', 'ieee transactions on', 'authorized licensed use limited to')} OR "
            f"(contains(lower({x}), 'downloaded on') AND contains(lower({x}), 'ieee xplore')))")


def noise(x: str) -> str:
    t = D.strip(x)
    symbols = D.sub(t, rf"[\p{{L}}\p{{N}}{D.SPACES}]", "")
    return f"(length({t}) < 20 OR length({symbols})::DOUBLE / length({t}) > 0.45)"


def caption(x: str) -> str:
    return CAPTION_NUMBERED.replace("(raw, ", f"({D.strip(x)}, ")


def good(x: str) -> str:
    return f"({D.strip(x)} <> '' AND NOT {caption(x)} AND NOT {header(x)} AND NOT {noise(x)})"


def short_upper(t: str) -> str:
    return f"({D.n_words(t)} BETWEEN 1 AND 8 AND {t} = upper({t}))"


def family(t: str) -> str:
    return (f"CASE WHEN upper({t}) = 'ABSTRACT' THEN 'abstract' WHEN {D.match(t, rf'^[IVXLCM]+\.{D.WS}+{NOT_WS}')} THEN 'roman' "
            f"WHEN {D.match(t, rf'^\p{{Nd}}+\.{D.WS}+{NOT_WS}')} THEN 'integer' WHEN {short_upper(t)} THEN 'all_caps' ELSE 'other' END")


SUB = f"({D.match(T, ALPHA)} OR {D.match(T, DECIMAL)})"
LABEL = f"(ends_with({T}, ':') OR length({T}) > 120)"
FLAG_SQL = {
    "is_caption_llm": caption("block"), "is_header_llm": header("block"), "is_formula_noise": noise("block"), "is_good_text": good("block"),
    "is_inline_label": LABEL, "is_fake_heading": f"({T} = '' OR {LABEL})",
}
HEADING_SQL = {
    "is_subsection_heading": SUB, "heading_family": family(T),
    "is_main_heading": f"CASE WHEN {T} = '' THEN false WHEN upper({T}) = 'ABSTRACT' THEN true WHEN {SUB} OR {LABEL} THEN false "
                       f"ELSE {family(T)} IN ('roman', 'integer', 'all_caps') END",
}

# Model answers: the first candidate text that parses, its elements, then the fallbacks.
FENCED = D.strip(f"regexp_replace(regexp_replace({D.strip('content')}, {D.q('(?i)^```(?:json)?' + D.WS + '*')}, ''), {D.q(D.WS + '*```$')}, '')")


def member(e: str, name: str) -> str:
    return f"CASE WHEN json_type({e}, '$.{name}') = 'NULL' THEN 'None' ELSE coalesce(json_extract_string({e}, '$.{name}'), '') END"


def clean(x: str) -> str:
    return D.normalize_markdown(x)


def no_emphasis(x: str) -> str:
    return D.strip(D.sub(D.sub(x, r"\*\*(.*?)\*\*", r"\1"), "_(.*?)_", r"\1"))


def texts(e: str, name: str) -> str:
    return (f"CASE WHEN json_type({e}, '$.{name}') = 'ARRAY' THEN list_transform(CAST(json_extract({e}, '$.{name}') AS JSON[]), "
            f"lambda x: CASE WHEN json_type(x) = 'NULL' THEN 'None' ELSE json_extract_string(x, '$') END) ELSE [] END")


ITEM = D.strip(f"regexp_replace({no_emphasis(clean('x'))}, {D.q('^[-•]' + D.WS + '*')}, '')")
ANSWERED = "WITH " + V.RESPONSES + f""",
picked AS (SELECT *, CASE WHEN json_valid({D.strip('content')}) THEN {D.strip('content')} WHEN json_valid({FENCED}) THEN {FENCED}
  WHEN json_valid(regexp_extract({FENCED}, '(?s)\\{{.*\\}}')) THEN regexp_extract({FENCED}, '(?s)\\{{.*\\}}') END AS found FROM model_responses),
objects AS (SELECT *, CASE WHEN starts_with(found, '{{') THEN found ELSE '{{}}' END AS json_text FROM picked),
listed AS (SELECT doc_id, chunk_index, CAST(json_extract(json_text, '$.elements') AS JSON[]) AS es FROM objects WHERE json_type(json_text, '$.elements') = 'ARRAY'),
answers AS (SELECT doc_id, chunk_index, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS idx FROM listed),
read AS (SELECT doc_id, chunk_index, idx, lower({D.strip(member('e', 'type'))}) AS type, {no_emphasis(clean(member('e', 'text')))} AS text,
  {no_emphasis(clean(member('e', 'intro_text')))} AS intro, list_filter(list_transform({texts('e', 'items')}, lambda x: {ITEM}), lambda x: {good('x')}) AS items,
  {clean(member('e', 'summary'))} AS summary, list_filter(list_transform({texts('e', 'key_points')}, lambda x: {clean('x')}), lambda x: x <> '') AS points
  FROM answers WHERE json_type(e) = 'OBJECT'),
usable AS (SELECT *, CASE WHEN type = 'bullet_list' THEN array_to_string(items, ' ') ELSE text END AS bodytext FROM read
  WHERE (type = 'bullet_list' AND len(items) > 0) OR (type = 'paragraph' AND {good('text')})),
from_answers AS (SELECT doc_id, chunk_index, idx AS idx_in_chunk, type, CASE WHEN type <> 'bullet_list' THEN text END AS text,
  CASE WHEN type = 'bullet_list' THEN intro END AS intro_text, CASE WHEN type = 'bullet_list' THEN items END AS items,
  CASE WHEN summary <> '' THEN summary ELSE {V.sql_summary('bodytext')} END AS summary,
  CASE WHEN len(points) > 0 THEN points[1:4] ELSE {V.sql_key_points('bodytext')} END AS key_points FROM usable)"""
SPLIT = f"list_filter(list_transform(string_split({clean('text')}, chr(10) || chr(10)), lambda p: {D.strip('p')}), lambda p: {good('p')})"


def fallback_ctes(source: str, where: str) -> str:
    return f""",
parts AS (SELECT doc_id, chunk_index, {SPLIT} AS ps FROM {source} {where}),
numbered_parts AS (SELECT doc_id, chunk_index, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS idx_in_chunk FROM parts),
fallback_rows AS (SELECT doc_id, chunk_index, idx_in_chunk, 'paragraph' AS type, {no_emphasis('p')} AS text, NULL AS intro_text, NULL::VARCHAR[] AS items,
  {V.sql_summary('p')} AS summary, {V.sql_key_points('p')} AS key_points FROM numbered_parts)"""


def building_ctes(chunks: str) -> str:
    """Headings where the title changes, then dense numbers, over a ``drafts`` table."""
    return f""",
titled AS (SELECT d.*, nullif(nullif(trim(c.section_title), ''), 'UNKNOWN') AS title FROM drafts d JOIN {chunks} c USING (doc_id, chunk_index)),
carried AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index, idx_in_chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM titled),
with_headings AS (
  SELECT doc_id, chunk_index, idx_in_chunk, type, coalesce(title, prev) AS section_title, text, intro_text, items, summary, key_points, NULL AS level FROM carried
  UNION ALL
  SELECT doc_id, chunk_index, -1, 'heading', title, title, NULL, NULL, NULL, NULL, 'section' FROM carried WHERE title IS NOT NULL AND (prev IS NULL OR prev <> title)),
built AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, idx_in_chunk) - 1 AS element_index FROM with_headings)"""


DRAFTS = ANSWERED + fallback_ctes("model_responses", "WHERE (doc_id, chunk_index) NOT IN (SELECT (doc_id, chunk_index) FROM from_answers)") + """,
drafts AS (SELECT * FROM from_answers UNION ALL SELECT * FROM fallback_rows)""" + building_ctes("paper_chunks")
_FLAT = "array_to_string(items, '|') AS items, array_to_string(key_points, '|') AS key_points"


def _flat(df):
    return df.withColumns({"items": F.array_join("items", "|"), "key_points": F.array_join("key_points", "|")})


def drafts(spark, folder):
    chunks = V.paper_chunks(spark, folder).drop("first", "second")
    return drafting.draft_elements(drafting.attach_responses(chunks, V.model_responses(spark, folder)))


def _built(spark, folder):
    """Drafts are written out once, as model answers would be, because building reads them more than once."""
    return _flat(building.build_elements(stored(drafts(spark, folder), "drafts")))


def _flag(rule):
    return lambda spark, folder: blocks(spark, folder).select("doc_id", "block_index", rule(F.col("block")).alias("flag"))


def _heading(rule):
    """Over every block, and over the headings of elements under negative numbers."""
    def run(spark, folder):
        heads = V.paper_elements(spark, folder).where("type = 'heading'").select("doc_id", (-1 - F.col("element_index")).alias("block_index"), F.col("text").alias("block"))
        return blocks(spark, folder).select("doc_id", "block_index", "block").unionByName(heads).select("doc_id", "block_index", rule(F.col("block")).alias("value"))
    return run


def measuring_model(prompts: list[str]) -> list[tuple[str, int, int]]:
    """A deterministic stand-in for a model: answers with the prompt's length, refuses every fifth length, whatever batch it is in."""
    for p in prompts:
        if len(p) % 5 == 0:
            raise ValueError(f"refused {len(p)}" if len(prompts) == 1 else "refused a batch")
    return [('{"summary": "' + str(len(p)) + '"}', len(p), 7) for p in prompts]


def _inferred(spark, folder):
    prompts = drafting.chunk_prompts(V.paper_chunks(spark, folder))
    return drafting.infer(prompts, measuring_model, pause=0.0).select("doc_id", "chunk_index", "content", "tokens_in", "tokens_out", "error")


def _prompts(make, kind):
    return lambda spark, folder: make(V.paper_elements(spark, folder).where(F.col("type") == kind), ["doc_id", "element_index"])


def _fields(spark, folder):
    answers = V.model_responses(spark, folder).select("doc_id", "chunk_index", F.regexp_replace("content", '"elements":', '"summary":" s ","elements":').alias("content"))
    return drafting.parse_fields(answers).select("doc_id", "chunk_index", "summary", F.size("key_points").alias("n_points"))


QUERIES = {n: _flag(getattr(E, n)) for n in FLAG_SQL} | {n: _heading(getattr(E, n)) for n in HEADING_SQL}
QUERIES |= {
    "fallback_summary": lambda spark, folder: blocks(spark, folder).select("doc_id", "block_index", E.fallback_summary(F.col("block")).alias("value")),
    "fallback_key_points": lambda spark, folder: blocks(spark, folder).select("doc_id", "block_index", F.array_join(E.fallback_key_points(F.col("block")), "|").alias("value")),
    "chunk_prompts": lambda spark, folder: drafting.chunk_prompts(V.paper_chunks(spark, folder)),
    "infer": _inferred,
    "extract_json": lambda spark, folder: V.model_responses(spark, folder).select("doc_id", "chunk_index", extract_json(F.col("content")).alias("json_text")),
    "parse_json_list": lambda spark, folder: V.model_responses(spark, folder).select(
        "doc_id", "chunk_index", F.array_join(parse_json_list(F.col("content")), "|").alias("value")),
    "elements_from_json": lambda spark, folder: _flat(drafting.answered_elements(V.model_responses(spark, folder))),
    "fallback_elements": lambda spark, folder: _flat(drafting.element_rows(drafting.draft_elements(V.paper_chunks(spark, folder)))).drop("section_title"),
    "draft_elements": lambda spark, folder: _flat(drafting.element_rows(drafts(spark, folder))).drop("section_title"),
    "token_usage": lambda spark, folder: drafting.token_usage(V.model_responses(spark, folder)),
    "paragraph_prompts": _prompts(drafting.paragraph_prompts, "paragraph"),
    "bullet_prompts": _prompts(drafting.bullet_prompts, "bullet_list"),
    "parse_fields": _fields,
    "build_elements": _built,
    "normalize_heading_levels": lambda spark, folder: building.normalize_heading_levels(V.paper_elements(spark, folder)).select(
        "doc_id", "element_index", "type", "level"),
}

_ELEMENTS = f"WITH {V.PAPER_ELEMENTS}"
_HT = D.strip("text")
_HSUB = f"({D.match(_HT, ALPHA)} OR {D.match(_HT, DECIMAL)})"
ORACLES = {n: f"{BLOCKS} SELECT doc_id, block_index, {s} AS flag FROM blocks" for n, s in FLAG_SQL.items()}
_ALL_TEXTS = f"""{BLOCKS}{V.PAPER_ELEMENTS.removeprefix(D.LINES)}, texts AS (SELECT doc_id, block_index, block FROM blocks
  UNION ALL SELECT doc_id, -1 - element_index, text FROM paper_elements WHERE type = 'heading')"""
ORACLES |= {n: f"{_ALL_TEXTS} SELECT doc_id, block_index, {s} AS value FROM texts" for n, s in HEADING_SQL.items()}
_INSTR = D.q(f"{drafting.INSTRUCTION}\n\nSection: ")
_FIELDS_INSTR = D.q(f"{drafting.FIELDS_INSTRUCTION}\n\nPassage:\n")
ORACLES |= {
    "fallback_summary": f"{BLOCKS} SELECT doc_id, block_index, {V.sql_summary('block')} AS value FROM blocks",
    "fallback_key_points": f"{BLOCKS} SELECT doc_id, block_index, array_to_string({V.sql_key_points('block')}, '|') AS value FROM blocks",
    "chunk_prompts": f"WITH {V.PAPER_CHUNKS} SELECT doc_id, chunk_index, section_title, {_INSTR} || section_title || {D.q(chr(10) * 2 + 'Passage:' + chr(10))} || "
                     f"{clean('text')} AS prompt FROM paper_chunks WHERE {clean('text')} <> ''",
    "extract_json": f"{ANSWERED} SELECT doc_id, chunk_index, json_text FROM objects",
    "parse_json_list": f"WITH {V.RESPONSES} SELECT doc_id, chunk_index, CASE WHEN chunk_index % 6 = 4 THEN '1|2' ELSE '' END AS value FROM model_responses",
    "elements_from_json": f"{ANSWERED} SELECT doc_id, chunk_index, idx_in_chunk, type, text, intro_text, summary, {_FLAT} FROM from_answers",
    "fallback_elements": f"WITH {V.PAPER_CHUNKS}{fallback_ctes('paper_chunks', '')} SELECT doc_id, chunk_index, idx_in_chunk, type, text, intro_text, summary, {_FLAT} FROM fallback_rows",
    "draft_elements": f"{DRAFTS} SELECT doc_id, chunk_index, idx_in_chunk, type, text, intro_text, summary, {_FLAT} FROM drafts",
    "token_usage": f"WITH {V.RESPONSES} SELECT doc_id, sum(tokens_in) AS input, sum(length(content)) AS output, sum(tokens_in + length(content)) AS total FROM model_responses GROUP BY 1",
    "paragraph_prompts": f"{_ELEMENTS} SELECT doc_id, element_index, {_FIELDS_INSTR} || text AS prompt FROM paper_elements WHERE type = 'paragraph'",
    "bullet_prompts": f"""{_ELEMENTS} SELECT doc_id, element_index, {_FIELDS_INSTR} || array_to_string(list_concat(
      CASE WHEN {D.strip('intro_text')} <> '' THEN ['Intro text: ' || {D.strip('intro_text')}] ELSE [] END,
      list_transform(list_filter(list_transform(items, lambda x: {D.strip('x')}), lambda x: x <> ''), lambda x, k: 'Item ' || k || ': ' || x)), chr(10)) AS prompt
      FROM paper_elements WHERE type = 'bullet_list'""",
    "parse_fields": f"WITH {V.RESPONSES} SELECT doc_id, chunk_index, CASE WHEN chunk_index % 6 IN (3, 4) THEN '' ELSE 's' END AS summary, 0 AS n_points FROM model_responses",
    "build_elements": f"{DRAFTS} SELECT doc_id, element_index, chunk_index, section_title, idx_in_chunk, type, text, intro_text, summary, level, {_FLAT} FROM built",
    "normalize_heading_levels": f"""{_ELEMENTS},
      heads AS (SELECT doc_id, element_index, upper({_HT}) = 'ABSTRACT' AS is_abs, {_HSUB} AS is_sub, {family(_HT)} AS fam FROM paper_elements WHERE type = 'heading' AND {_HT} <> ''),
      leads AS (SELECT doc_id, coalesce(arg_min(fam, element_index) FILTER (WHERE fam <> 'other'), 'other') AS lead_fam FROM heads WHERE NOT is_abs AND NOT is_sub GROUP BY 1)
      SELECT e.doc_id, e.element_index, type, CASE WHEN h.fam IS NULL THEN level WHEN is_abs THEN 'section' WHEN is_sub THEN 'subsection'
        WHEN fam = lead_fam THEN 'section' ELSE 'subsection' END AS level
      FROM paper_elements e LEFT JOIN heads h ON e.doc_id = h.doc_id AND e.element_index = h.element_index LEFT JOIN leads l ON l.doc_id = e.doc_id""",
    "infer": f"""WITH {V.PAPER_CHUNKS}, prompts AS (SELECT doc_id, chunk_index, length({_INSTR} || section_title || {D.q(chr(10) * 2 + 'Passage:' + chr(10))} || {clean('text')}) AS n
      FROM paper_chunks WHERE {clean('text')} <> '') SELECT doc_id, chunk_index, CASE WHEN n % 5 = 0 THEN '' ELSE '{{"summary": "' || n || '"}}' END AS content,
      CASE WHEN n % 5 = 0 THEN 0 ELSE n END AS tokens_in, CASE WHEN n % 5 = 0 THEN 0 ELSE 7 END AS tokens_out, CASE WHEN n % 5 = 0 THEN 'ValueError: refused ' || n END AS error FROM prompts""",
}
