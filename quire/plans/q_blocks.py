"""Queries for block classification (C-1..C-20)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions import blocks as R
from quire.functions.text import strip_md
from quire.operators.segment import sectioned_block_rows, structure
from quire.plans import duck as D
from quire.plans.derived import paper_docs
from quire.plans.q_text import BLOCKS, blocks

DOMAIN = D.BEFORE + r"(?:[a-z0-9-]+\.)+(?:org|com|net|edu|gov|io|ai|co)" + D.AFTER
DOI = (D.BEFORE + r"10\.\p{Nd}{4,9}/[-._;()/:A-Za-z0-9]*(?:[A-Za-z0-9_]" + D.AFTER + r"|[-.;()/:][\p{L}\p{N}_])")
TAILS = ", ".join(D.q(t) for t in R.TAIL_HEADINGS)
HEADER = f"""(
  {D.has('low', 'ieee transactions on', 'authorized licensed use limited to')}
  OR (contains(low, 'journal of ') AND contains(low, 'vol.'))
  OR (contains(low, 'downloaded on') AND contains(low, 'ieee xplore'))
  OR {D.match('low', D.BEFORE + r'vol\.' + D.WS + r'*\p{Nd}')}
  OR ((length(clean) < 160 OR n_words <= 12) AND ({D.match('lower(clean)', DOMAIN)} OR contains(low, 'et al.')))
  OR ((length(clean) < 180 OR n_words <= 12) AND {D.match('clean', DOI)})
  OR (length(clean) < 180 AND {D.has('low', *R.JOURNAL_WORDS)} AND right(clean, 1) NOT IN ('.', '!', '?')))"""
LICENSE = f"""(
  {D.has('low', 'personal use is permitted', 'republication/redistribution requires ieee permission', 'rights/index.html',
         'see front matter', 'digital object identifier', 'creative commons attribution license')}
  OR (contains(low, 'copyright') AND n_words <= 40) OR (contains(low, 'doi') AND contains(low, '10.') AND n_words <= 25)
  OR (contains(low, '© 20') AND n_words <= 20) OR (contains(low, 'published by elsevier science') AND n_words <= 30))"""
AFFILIATION = f"""(
  {D.has('low', 'manuscript received', 'corresponding author', 'e-mail:', 'email:', ' is with ', 'institute of ', 'school of ',
         'university', 'national natural science foundation', 'fundamental research fund', 'reviewed by', 'edited by')}
  OR (contains(low, 'supported by') AND contains(low, 'grant')) OR (contains(low, 'received ') AND contains(low, 'accepted '))
  OR (contains(low, 'published ') AND length(raw) < 200) OR (contains(low, 'open access') AND length(raw) < 120)
  OR (contains(low, 'citation') AND length(raw) < 150) OR low = 'keywords' OR (contains(raw, '@') AND length(raw) < 250))"""
TABLE = f"""(
  len(list_filter(regexp_split_to_array(raw, {D.q('[' + D.BREAKS + ']+')}), lambda l: length(l) - length(replace(l, '|', '')) >= 2)) >= 2
  OR len(list_filter(regexp_split_to_array(raw, {D.q('[' + D.BREAKS + ']+')}), lambda l: regexp_matches(l, {D.q(r'\|' + D.WS + '*[:-]')}))) >= 1
  OR {D.count('raw', '|')} >= 6)"""
CAPTION_NUMBERED = (
    f"({D.match('raw', '^(?:FIGURE|TABLE)' + D.WS + r'+\p{Nd}+' + D.AFTER)} OR "
    f"{D.match('raw', '(?i)^(?:fig|fig\\.|figure|table)' + D.WS + r'*\p{Nd}+[.:](?:' + D.WS + '|$)')})")
CAPTION = f"({CAPTION_NUMBERED} OR {D.match('raw', r'^\([a-z]\)' + D.WS)})"
ROMAN = r"^([IVXLC]+\. +[A-Z][A-Z0-9 \-–—,:()']{0,120})"
NUMBERED = r"^(\p{Nd}+(?:\.\p{Nd}+)*\.? +[A-Z][A-Za-z0-9 \-–—,:()']{0,120})"


def title_sql(line: str, clean: str) -> str:
    def first_words(pattern: str) -> str:
        return f"nullif(array_to_string(string_split(trim(regexp_extract({clean}, {D.q(pattern)}, 1)), ' ')[1:12], ' '), '')"

    bare = D.strip(f"translate({line}, '*_`', '')")
    return f"""CASE WHEN {line} = '' THEN NULL
      WHEN {D.match(f'upper({bare})', '^ABSTRACT' + D.AFTER)} OR {D.match(f'upper({clean})', '^ABSTRACT' + D.AFTER)} THEN 'ABSTRACT'
      WHEN upper({clean}) IN ({TAILS}) THEN upper({clean})
      ELSE coalesce({first_words(ROMAN)}, {first_words(NUMBERED)}, CASE WHEN {D.match(clean, '^[0-9]+[.]$')} THEN {clean} END) END"""


REMOVED_BY = " ".join(f"WHEN {r} THEN '{r}'" for r in R.REMOVAL_RULES)
FACTS = BLOCKS + f""",
f1 AS (SELECT doc_id, block_index, block, {D.strip('block')} AS raw, {D.strip_md('block')} AS clean, {D.first_line('block')} AS line FROM blocks),
f2 AS (SELECT *, lower(clean) AS low, len(list_filter(string_split(clean, ' '), lambda w: w <> '')) AS n_words, {D.strip_md('line')} AS lclean FROM f1),
f3 AS (SELECT *, {title_sql('line', 'lclean')} AS section_title,
  {D.match('clean', '^[0-9]{1,4}$')} AS is_page_number, {HEADER} AS is_running_header, {LICENSE} AS is_license,
  {D.match('raw', '^>' + D.WS + r'*[\p{Nd}∗*]')} AS is_footnote,
  ((contains(low, 'picture') AND contains(low, 'omitted')) OR {D.has('low', 'start of picture text', 'end of picture text')}) AS is_image_placeholder,
  {AFFILIATION} AS is_affiliation, {TABLE} AS is_table_like, {CAPTION} AS is_caption, {D.starts('clean', '-', '•')} AS is_bullet,
  {D.starts('low', 'keywords:', 'keywords ', 'index terms', 'key words')} AS is_keywords_meta,
  {D.starts('low', 'keywords', 'index terms')} AS is_keywords_loose,
  ({D.match('clean', '(?i)^jel +classification' + D.AFTER)} OR {D.match('clean', r'^[A-Z] *\p{Nd}{1,3}(?: *; *[A-Z] *\p{Nd}{1,3}){1,10}$')}) AS is_jel,
  starts_with(line, '## ') AS is_md_heading, {D.match('clean', r'^[^\p{L}]*\p{Ll}')} AS starts_lower FROM f2),
f4 AS (SELECT *, CASE {REMOVED_BY} END AS removed_by, coalesce(section_title IN ({TAILS}), false) AS is_tail_heading,
  coalesce(section_title NOT IN ({TAILS}), false) AS is_major_heading,
  coalesce({D.match(f"lower({D.strip_md('section_title')})", R.INTRO_TITLE)}, false) AS is_intro_title FROM f3),
facts AS (SELECT *, removed_by IS NOT NULL AS should_remove,
  (removed_by IS NULL AND NOT is_caption AND NOT is_bullet AND NOT is_keywords_loose AND n_words >= 35 AND {D.match('clean', '[.!?]')}) AS is_natural_body
  FROM f4)"""
CONTINUES = (
    f"(starts_lower OR lower(string_split(clean, ' ')[1]) IN ({', '.join(D.q(w) for w in R.CONNECTIVES)}) "
    f"OR {D.match('clean', r'^[(\[{_\-–—=≤≥+\p{Nd}.]')})")
PAIR = f"""pairs AS (SELECT *,
  lag(clean) OVER w <> '' AND clean <> '' AND NOT lag(is_md_heading) OVER w AND NOT is_md_heading
  AND NOT lag(is_major_heading) OVER w AND NOT is_major_heading AND NOT is_bullet AND NOT is_caption AND NOT should_remove
  AND NOT {D.match('lag(clean) OVER w', '[.!?:;]$')} AND {CONTINUES} AS joins
  FROM facts WINDOW w AS (PARTITION BY doc_id ORDER BY block_index))"""


def _pairs(spark, folder):
    """S-2 on neighbouring blocks, paired inside the document row."""
    from quire.operators.segment import block_frame
    from quire.functions.arrays import inline_rows

    frame = block_frame(paper_docs(spark, folder))
    pair = F.transform("blocks", lambda b, i: F.struct(i.cast("int").alias("block_index"), F.get(F.col("blocks"), i - 1).alias("prev"), b.alias("cur")))
    return inline_rows(frame, pair, "doc_id", key="block_index").select(
        "doc_id", "block_index", F.coalesce(R.should_merge(F.col("prev"), F.col("cur")), F.lit(False)).alias("should_merge"))


def _abstract_candidates(spark, folder):
    structured = structure(paper_docs(spark, folder))
    from quire.functions.arrays import inline_rows

    sections = inline_rows(structured, "sections", "doc_id", "merged", key="section_id")
    texts = F.transform(F.slice("merged", F.col("first_merged_index") + 1, F.col("n_merged")), lambda m: m["block"])
    return sections.select("doc_id", "section_id", R.is_abstract_candidate(texts).alias("is_abstract_candidate"))


def _flag(rule) -> object:
    return lambda spark, folder: blocks(spark, folder).select("doc_id", "block_index", rule(F.col("block")).alias("flag"))


def _tail(c: Column) -> Column:
    return F.coalesce(R.section_title(c).isin(R.TAIL_HEADINGS), F.lit(False))


def _major(c: Column) -> Column:
    return F.coalesce(~R.section_title(c).isin(R.TAIL_HEADINGS), F.lit(False))


RULES = {
    "is_page_number": R.is_page_number, "is_running_header": R.is_running_header, "is_license": R.is_license,
    "is_footnote": R.is_footnote, "is_image_placeholder": R.is_image_placeholder, "is_affiliation": R.is_affiliation,
    "is_table_like": R.is_table_like, "is_caption": R.is_caption, "is_bullet": R.is_bullet,
    "is_keywords_meta": R.is_keywords_meta, "is_keywords_loose": R.is_keywords_loose, "is_jel": R.is_jel,
    "should_remove": R.should_remove, "is_tail_heading": _tail, "is_major_heading": _major,
    "is_md_heading": R.is_md_heading, "starts_lower": lambda c: R.starts_lower(strip_md(c)),
    "is_intro_title": lambda c: R.is_intro_title(R.section_title(c)),
}
CLASSIFIED = ["section_title", "removed_by", *R.FLAGS]

QUERIES = {name: _flag(rule) for name, rule in RULES.items()}
QUERIES |= {
    "classify_blocks": lambda spark, folder: R.classify_blocks(blocks(spark, folder)).select("doc_id", "block_index", *CLASSIFIED),
    "section_title": lambda spark, folder: blocks(spark, folder).select("doc_id", "block_index", R.section_title(F.col("block")).alias("section_title")),
    "is_natural_body": lambda spark, folder: R.classify_blocks(blocks(spark, folder)).select("doc_id", "block_index", F.col("is_natural_body").alias("flag")),
    "removal_reasons": lambda spark, folder: R.classify_blocks(blocks(spark, folder)).groupBy(
        F.coalesce("removed_by", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_blocks"), F.countDistinct("doc_id").alias("n_docs")),
    "is_abstract_candidate": _abstract_candidates,
    "should_merge": _pairs,
}

ORACLES = {name: f"{FACTS} SELECT doc_id, block_index, {name} AS flag FROM facts" for name in [*RULES, "is_natural_body"]}
ORACLES |= {
    "classify_blocks": f"{FACTS} SELECT doc_id, block_index, {', '.join(CLASSIFIED)} FROM facts",
    "section_title": f"{FACTS} SELECT doc_id, block_index, section_title FROM facts",
    "removal_reasons": f"{FACTS} SELECT coalesce(removed_by, 'kept') AS reason, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_docs FROM facts GROUP BY 1",
    "should_merge": f"{FACTS}, {PAIR} SELECT doc_id, block_index, coalesce(joins, false) AS should_merge FROM pairs",
}
