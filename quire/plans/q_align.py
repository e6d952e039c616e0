"""Queries for page boxes and alignment (IO-3, C-30..C-33, A-1..A-22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import boxes as B
from quire.functions.blocks import section_title
from quire.functions.arrays import inline_rows
from quire.functions.text import normalize_for_match
from quire.operators import align as A
from quire.plans import derived as V
from quire.plans import duck as D
from quire.plans.q_blocks import FACTS
from quire.plans.q_text import BLOCKS, blocks
from quire.session import stored
from quire.sources.tables import load_page_boxes

NORM = D.normalize_for_match("block")
ROMAN = r"^(i|ii|iii|iv|v|vi|vii|viii|ix|x)\."
BOXES = BLOCKS + f""",
raw_boxes AS (SELECT doc_id, block_index // 6 AS page_number, block_index % 6 AS o, block, (doc_id + block_index) AS n,
  coalesce(sum(length(block) + 2) OVER (PARTITION BY doc_id, block_index // 6 ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_,
  CASE WHEN starts_with(block, '- ') THEN 'list-item' WHEN starts_with(block, '==>') THEN 'picture' ELSE 'text' END AS class FROM blocks),
page_boxes AS (SELECT doc_id, page_number, o AS block_index, class, block AS text, {D.normalize_box_text('block')} AS norm, start_ AS pos_start, start_ + length(block) AS pos_stop,
  CASE WHEN o % 2 = 0 THEN 50.0 ELSE 310.0 END::DOUBLE AS x0, (60 + 100 * o)::DOUBLE AS y0,
  row_number() OVER (PARTITION BY doc_id, page_number ORDER BY o) - 1 AS box_ord
  FROM raw_boxes WHERE n % 29 <> 0 AND n % 31 <> 0 AND class IN ('text', 'list-item'))"""
N20 = f"{D.n_words('m')} <= 20"
META = (f"(m = '' OR {D.has('m', 'arxiv:', 'intentionally omitted', *B.METADATA_PHRASES)} OR ({D.count('text', ',')} >= 3 AND contains(m, ' and ') AND {N20}) "
        f"OR ({D.match('m', '^(-' + D.WS + r'+)?(fig\.?|figure|table)' + D.WS + r'*\p{Nd}+')} AND {N20}) OR ({D.match('m', r'^\(?[a-z0-9]\)' + D.WS)} AND {D.n_words('m')} <= 8) "
        f"OR {D.match('m', '^[0-9]{1,4}$')} OR {D.strip(D.sub('m', '[^a-z0-9 ]+', ''))} IN ('references', 'appendix', 'acknowledgment', 'acknowledgements'))")
HEADING = (f"(m <> '' AND ({D.match('m', ROMAN)} OR (len(regexp_extract_all(text, '\\p{{L}}')) > 0 AND {D.n_words('m')} <= 10 AND "
           f"len(regexp_extract_all(text, '\\p{{Lu}}'))::DOUBLE / greatest(len(regexp_extract_all(text, '\\p{{L}}')), 1) > 0.8)))")
BULLET = D.starts(D.strip("text"), "- ", "•")
INDEXED = BOXES + f""",
normed AS (SELECT *, {D.normalize_for_match('text')} AS m, {D.n_words(D.normalize_for_match('norm'))} AS n_words FROM page_boxes),
kept AS (SELECT *, {HEADING} AS is_heading, {BULLET} AS is_bullet FROM normed WHERE norm <> '' AND NOT {META}),
indexed AS (SELECT *, coalesce(sum(length(norm) + 1) OVER w, 0)::INT AS start_, coalesce(sum(length(norm) + 1) OVER w, 0)::INT + length(norm) AS stop_,
  row_number() OVER (PARTITION BY doc_id, page_number ORDER BY box_ord) - 1 AS kept_ord
  FROM kept WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY box_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
body AS (SELECT * EXCLUDE (start_, stop_), coalesce(sum(length(norm) + 1) OVER w, 0)::INT AS start_, coalesce(sum(length(norm) + 1) OVER w, 0)::INT + length(norm) AS stop_,
  row_number() OVER (PARTITION BY doc_id, page_number ORDER BY box_ord) - 1 AS bi
  FROM indexed WHERE NOT is_heading WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY box_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
all_pages AS (SELECT DISTINCT doc_id, page_number FROM raw_boxes),
streams AS (SELECT p.doc_id, p.page_number, coalesce(string_agg(norm, ' ' ORDER BY box_ord), '') AS stream,
  coalesce(string_agg(norm, ' ' ORDER BY box_ord) FILTER (WHERE NOT is_heading), '') AS body_text
  FROM all_pages p LEFT JOIN indexed i ON p.doc_id = i.doc_id AND p.page_number = i.page_number GROUP BY 1, 2)"""
TARGETS = INDEXED + f""",
texts AS (SELECT doc_id, block_index // 2 AS j, string_agg(block, ' ' ORDER BY block_index) AS raw FROM blocks GROUP BY 1, 2),
align_texts AS (SELECT doc_id, j AS element_index, CASE WHEN j % 7 = 3 THEN substr(raw, 1, length(raw) // 2) WHEN j % 9 = 4 THEN replace(raw, 'e', 'a') ELSE raw END AS text FROM texts),
targets AS (SELECT DISTINCT doc_id, {D.normalize_for_match('text')} AS t FROM align_texts WHERE {D.normalize_for_match('text')} <> ''),
toks AS (SELECT *, {D.distinct_tokens('t')} AS tt, {D.n_words('t')} AS target_words FROM targets),
page_toks AS (SELECT *, {D.distinct_tokens('stream')} AS pt FROM streams),
rated AS (SELECT k.doc_id, k.t, page_number, CASE WHEN stream = '' THEN 0.0 WHEN contains(stream, t) THEN 1.0 WHEN length(t) > 50 AND contains(stream, substr(t, 1, 220)) THEN 0.92
  WHEN length(t) > 50 AND contains(stream, right(t, 220)) THEN 0.88 ELSE {D.overlap('tt', 'pt')} * 0.55 END AS score FROM toks k JOIN page_toks p ON k.doc_id = p.doc_id),
best AS (SELECT doc_id, t, max(score) AS score, min(page_number) FILTER (WHERE score = top) AS page FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, t) AS top FROM rated) GROUP BY 1, 2),
located AS (SELECT k.*, CASE WHEN b.score >= 0.20 THEN b.page END AS best_page, CASE WHEN b.score >= 0.20 THEN b.score END AS page_score
  FROM toks k LEFT JOIN best b ON b.doc_id = k.doc_id AND b.t = k.t),
near AS (SELECT l.*, p.page_number, p.stream, p.body_text FROM located l JOIN streams p ON l.doc_id = p.doc_id
  WHERE l.best_page IS NULL OR p.page_number BETWEEN l.best_page - 1 AND l.best_page + 2)"""


def match_score(t: str, c: str) -> str:
    return (f"CASE WHEN {t} = '' OR {c} = '' THEN 0.0 WHEN {t} = {c} THEN 1.0 WHEN contains({c}, {t}) THEN 0.97 WHEN contains({t}, {c}) AND length({c}) > 60 THEN 0.85 "
            f"WHEN length({t}) > 40 AND contains({c}, substr({t}, 1, 180)) THEN 0.92 WHEN length({t}) > 40 AND contains({c}, right({t}, 180)) THEN 0.88 "
            f"ELSE {D.overlap(D.distinct_tokens(t), D.distinct_tokens(c))} * 0.72 END")


def ratio_score(cw: str, pw: str, n: str) -> str:
    r = f"({cw}::DOUBLE / greatest({pw}, 1))"
    return f"(CASE WHEN {r} >= 0.7 AND {r} <= 1.6 THEN 1.0 WHEN {r} >= 0.5 AND {r} <= 2.2 THEN 0.5 ELSE 0.0 END - least({n}, 8) * 0.08)::DOUBLE"


def conf(cw: str, pw: str) -> str:
    r = f"({cw}::DOUBLE / greatest({pw}, 1))"
    return f"CASE WHEN {pw} <= 0 THEN 'low' WHEN {r} >= 0.7 AND {r} <= 2.0 THEN 'high' WHEN {r} >= 0.4 AND {r} <= 3.0 THEN 'medium' ELSE 'low' END"


HEAD_LEN = "CASE WHEN length(t) >= 100 THEN 40 WHEN length(t) >= 60 THEN 25 WHEN length(t) >= 30 THEN 15 ELSE greatest(8, length(t)) END"
TAIL_LEN = "CASE WHEN length(t) >= 100 THEN 40 WHEN length(t) >= 60 THEN 25 WHEN length(t) >= 30 THEN 15 ELSE 0 END"


def hits(needle: str) -> str:
    """All positions at which the needle begins on a page, by comparing at every place."""
    return (f"list_filter(range(0, greatest(length(body_text) - length({needle}) + 1, 0)), "
            f"lambda p: body_text[p + 1:p + length({needle})] = {needle})")


ANCHORS = TARGETS + f""",
anchored AS (SELECT *, substr(t, 1, {HEAD_LEN}) AS head, right(t, {TAIL_LEN}) AS tail, {TAIL_LEN} AS tail_len FROM near),
head_hits AS (SELECT * EXCLUDE (hp), unnest(hp) AS hpos FROM (SELECT *, {hits('head')} AS hp FROM anchored WHERE contains(body_text, head)))"""
HEAD_TAIL = ANCHORS + f""",
head_boxes AS (SELECT h.doc_id, h.t, h.page_number, any_value(h.target_words) AS target_words, any_value(body_text) AS body_text, s.bi AS i, any_value(s.start_) AS from_, min(hpos) AS hpos
  FROM head_hits h JOIN body s ON s.doc_id = h.doc_id AND s.page_number = h.page_number AND hpos >= s.start_ AND hpos < s.stop_ WHERE tail_len > 0 GROUP BY h.doc_id, h.t, h.page_number, s.bi),
tail_hits AS (SELECT doc_id, t, page_number, unnest(tp) AS tpos FROM (SELECT doc_id, t, page_number, {hits('tail')} AS tp FROM anchored
  WHERE tail_len > 0 AND contains(body_text, tail) AND contains(body_text, head))),
tail_boxes AS (SELECT h.doc_id, h.t, h.page_number, e.bi AS j, any_value(e.stop_) AS to_, max(tpos) AS tpos
  FROM tail_hits h JOIN body e ON e.doc_id = h.doc_id AND e.page_number = h.page_number AND tpos >= e.start_ AND tpos < e.stop_ GROUP BY h.doc_id, h.t, h.page_number, e.bi),
runs AS (SELECT h.doc_id, h.t, h.page_number, h.target_words, i, j, substr(body_text, from_ + 1, to_ - from_) AS cand
  FROM head_boxes h JOIN tail_boxes e ON h.doc_id = e.doc_id AND h.t = e.t AND h.page_number = e.page_number WHERE j > i OR (j = i AND tpos >= hpos)),
sized AS (SELECT r.doc_id, r.t, r.page_number, i, j, any_value(cand) AS cand, any_value(r.target_words) AS pw, sum(x.n_words) AS cw, count(*) AS nb
  FROM runs r JOIN body x ON x.doc_id = r.doc_id AND x.page_number = r.page_number AND x.bi BETWEEN r.i AND r.j GROUP BY 1, 2, 3, 4, 5),
scored AS (SELECT *, {match_score('t', 'cand')} + {ratio_score('cw', 'pw', 'nb')} AS score FROM sized),
picked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t, page_number ORDER BY score DESC, i, j) AS rn FROM scored),
head_tail AS (SELECT *, {conf('cw', 'pw')} AS confidence FROM picked WHERE rn = 1)"""
# Head hits followed box by box, then over the next two candidate pages.
HEAD_ONLY = ANCHORS + f""",
starts_ AS (SELECT DISTINCT h.doc_id, h.t, h.page_number, h.target_words, h.best_page, s.bi AS i FROM head_hits h JOIN body s
  ON s.doc_id = h.doc_id AND s.page_number = h.page_number AND h.hpos >= s.start_ AND h.hpos < s.stop_),
first_boxes AS (SELECT s.*, b.page_number AS bp, b.bi, b.norm, b.n_words, sum(b.n_words) OVER (PARTITION BY s.doc_id, s.t, s.page_number, s.i ORDER BY b.bi) AS cum
  FROM starts_ s JOIN body b ON b.doc_id = s.doc_id AND b.page_number = s.page_number AND b.bi BETWEEN s.i AND s.i + 7),
own AS (SELECT * FROM first_boxes WHERE cum - n_words < target_words * 0.8),
own_sum AS (SELECT doc_id, t, page_number, i, any_value(target_words) AS target_words, any_value(best_page) AS best_page, sum(n_words) AS w FROM own GROUP BY 1, 2, 3, 4),
more AS (SELECT o.*, b.page_number AS bp, b.bi, b.norm, b.n_words, o.w + sum(b.n_words) OVER (PARTITION BY o.doc_id, o.t, o.page_number, o.i ORDER BY b.page_number, b.bi) AS cum
  FROM own_sum o JOIN body b ON b.doc_id = o.doc_id AND b.page_number BETWEEN o.page_number + 1 AND o.page_number + 2 AND b.bi < 8
  WHERE o.w < o.target_words * 0.85 AND (o.best_page IS NULL OR b.page_number <= o.best_page + 2)),
collected AS (SELECT doc_id, t, page_number, i, target_words, bp, bi, norm, n_words FROM own UNION ALL
  SELECT doc_id, t, page_number, i, target_words, bp, bi, norm, n_words FROM more WHERE cum - n_words < target_words * 0.85),
rolled AS (SELECT doc_id, t, page_number, i, any_value(target_words) AS pw, sum(n_words) AS cw, count(*) AS nb, string_agg(norm, ' ' ORDER BY bp, bi) AS cand FROM collected GROUP BY 1, 2, 3, 4),
scored AS (SELECT *, {match_score('t', 'cand')} + {ratio_score('cw', 'pw', 'nb')} AS score FROM rolled),
picked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t, page_number ORDER BY score DESC, i) AS rn FROM scored),
head_only AS (SELECT *, {conf('cw', 'pw')} AS confidence FROM picked WHERE rn = 1)"""


def _pages(spark, folder):
    return A.kept_pages(V.pages(spark, folder), stored)


def _targets(spark, folder):
    return A.targets_of(V.align_texts(spark, folder))


def _near(spark, folder, *more, headed=True):
    pages = _pages(spark, folder)
    located = stored(A.locate(_targets(spark, folder), pages), "located")
    return A.candidate_pages(located, pages, *(("body", "body_text", *more) if headed else ()), headed=headed)


def _match_columns(df):
    return df.select("doc_id", "t", "page_number", F.round("score", 6).alias("score"), F.col("match.match_confidence").alias("confidence"),
                     F.size("match.pdf_locations").alias("n_locations"), _places().alias("places"))


def _places():
    """Page and corner of every location, in order."""
    return F.array_join(F.transform("match.pdf_locations", lambda x: F.format_string("%d:%.4f:%.4f", x["page"], F.get(x["bbox"], F.lit(0)), F.get(x["bbox"], F.lit(1)))), ",")


def _bullet_items(spark, folder):
    pages, targets = _pages(spark, folder), _targets(spark, folder)
    found = A.match_bullet_boxes(stored(A.locate(targets, pages), "located"), pages)
    return found.join(targets, ["doc_id", "tkey"]).select("doc_id", "t", F.col("match.page_number").alias("page_number"), F.col("match.match_confidence").alias("confidence"), _places().alias("places"))


def _windows(spark, folder):
    pages = _pages(spark, folder)
    located = stored(A.locate(_targets(spark, folder), pages), "located")
    return A.fuzzy_window_match(located, pages).select("doc_id", "t", "match.match_confidence", "match.page_number")


def _indexed(spark, folder):
    numbered = F.transform("boxes", lambda b, i: F.struct(i.cast("int").alias("kept_ord"), b.alias("b")))
    return inline_rows(_pages(spark, folder), numbered, "doc_id", "page_number", key="kept_ord").select(
        "doc_id", "page_number", "kept_ord", "b.block_index", F.col("b.start").alias("start_"), F.col("b.stop").alias("stop_"),
        F.col("b.column").alias("page_column"), "b.is_heading", "b.is_bullet", "b.n_words")


def _box_rule(rule, name="value"):
    return lambda spark, folder: load_page_boxes(V.raw_pages(spark, folder)).select("doc_id", "page_number", "box_ord", rule(F.col("text")).alias(name))


def _pairs(spark, folder):
    """Neighbouring blocks as (target, candidate) of the score columns."""
    from quire.operators.segment import block_frame

    frame = block_frame(V.paper_docs(spark, folder))
    pair = F.transform("blocks", lambda b, i: F.struct(i.cast("int").alias("block_index"), F.concat_ws(" ", b, F.get(F.col("blocks"), i + 1)).alias("a"), b.alias("b")))
    rows = inline_rows(frame, pair, "doc_id", key="block_index")
    return rows.withColumns({"t": normalize_for_match(F.when(F.col("block_index") % 2 == 0, F.col("a")).otherwise(F.col("b"))),
                             "c": normalize_for_match(F.when(F.col("block_index") % 2 == 0, F.col("b")).otherwise(F.col("a")))}).withColumns(
        {"tw": F.size(A.words(F.col("t"))), "cw": F.size(A.words(F.col("c")))})


_PAIR_SQL = BLOCKS + f""",
nexts AS (SELECT doc_id, block_index, block AS b, concat_ws(' ', block, lead(block) OVER (PARTITION BY doc_id ORDER BY block_index)) AS a FROM blocks),
pairs0 AS (SELECT doc_id, block_index, {D.normalize_for_match('CASE WHEN block_index % 2 = 0 THEN a ELSE b END')} AS t,
  {D.normalize_for_match('CASE WHEN block_index % 2 = 0 THEN b ELSE a END')} AS c FROM nexts),
pairs AS (SELECT *, {D.n_words('t')} AS tw, {D.n_words('c')} AS cw FROM pairs0)"""


def _located_boxes(spark, folder):
    """Per document: its boxes shifted by less and more than the rounding step, as one list."""
    boxes = F.transform("boxes", lambda b: F.struct(F.col("page_number").cast("int").alias("page"), F.transform(
        b["bbox"], lambda v: v + F.when(b["block_index"] % 3 == 0, 0.0001).otherwise(0.25)).alias("bbox")))
    page = _pages(spark, folder).select("doc_id", "page_number", boxes.alias("moved"), F.transform("boxes", lambda b: F.struct(
        F.col("page_number").cast("int").alias("page"), b["bbox"].alias("bbox"))).alias("plain"), "boxes")
    return page.withColumn("all", F.concat("plain", "moved"))


_MOVED = INDEXED + """,
moved AS (SELECT doc_id, page_number, kept_ord AS k, x0, y0 FROM indexed UNION ALL
  SELECT doc_id, page_number, 100 + kept_ord, x0 + CASE WHEN block_index % 3 = 0 THEN 0.0001 ELSE 0.25 END, y0 + CASE WHEN block_index % 3 = 0 THEN 0.0001 ELSE 0.25 END FROM indexed),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, round(x0, 3), round(y0, 3) ORDER BY k) AS rn FROM moved)"""


def _rect_text(rects):
    return F.array_join(F.transform(rects, lambda r: F.format_string("%.4f:%.4f", F.get(r, F.lit(0)), F.get(r, F.lit(1)))), ",")


def _matched(spark, folder):
    rows = A.match_paragraphs(V.align_texts(spark, folder), V.pages(spark, folder))
    return rows.select("doc_id", "element_index", F.coalesce("match.page_number", F.lit(-1)).alias("page_number"),
                       F.size("match.pdf_rects").alias("n_rects"), "match.match_confidence")


def _lists(spark, folder):
    items = V.align_texts(spark, folder).select("doc_id", (F.col("element_index") / 3).cast("int").alias("element_index"), F.col("element_index").alias("k"), "text")
    lists = items.groupBy("doc_id", "element_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("items"))
    return A.match_bullet_lists(lists, V.pages(spark, folder)).select("doc_id", "element_index", "match.match_confidence", F.size("match.pdf_rects").alias("n_rects"))


def _headings(spark, folder):
    """Every block with a section title."""
    headings = blocks(spark, folder).where(section_title(F.col("block")).isNotNull()).select(
        "doc_id", F.col("block_index").alias("element_index"), F.col("block").alias("text"))
    return A.match_headings(headings, V.pages(spark, folder)).select(
        "doc_id", "element_index", "match.page_number", F.get(F.get("match.pdf_rects", F.lit(0)), F.lit(0)).alias("x0"), F.get(F.get("match.pdf_rects", F.lit(0)), F.lit(1)).alias("y0"))


# Headings walk in reading order: a list of candidates each, the last page and the boxes used on it.
_HEADINGS = FACTS.replace("WITH ", "WITH RECURSIVE ", 1) + INDEXED[len(BLOCKS):] + f""",
titles AS (SELECT doc_id, block_index AS element_index, {D.normalize_for_match('block')} AS t FROM facts WHERE section_title IS NOT NULL),
rivals AS (SELECT h.doc_id, h.element_index, h.t, b.page_number AS page, b.block_index AS block, b.x0, b.y0, {match_score('h.t', 'b.norm')} AS score,
  nullif(regexp_extract(h.t, {D.q(ROMAN)}, 1), '') AS rt, regexp_extract(b.norm, {D.q(ROMAN)}, 1) AS rb FROM titles h JOIN indexed b ON b.doc_id = h.doc_id AND b.is_heading WHERE h.t <> ''),
chosen AS (SELECT doc_id, element_index, list({{'page': page, 'block': block, 'x0': x0, 'y0': y0, 'score': score}}) AS cs FROM rivals WHERE score >= 0.72 AND (rt IS NULL OR rt = rb) GROUP BY 1, 2),
queue AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY element_index) AS k FROM chosen),
stepped AS (
  SELECT doc_id, 0::BIGINT AS k, NULL::BIGINT AS element_index, -1::BIGINT AS page, []::BIGINT[] AS used, NULL::DOUBLE AS x0, NULL::DOUBLE AS y0, false AS hit FROM (SELECT DISTINCT doc_id FROM queue)
  UNION ALL
  SELECT doc_id, k, element_index, CASE WHEN hit THEN pick.page ELSE page END, CASE WHEN NOT hit THEN used WHEN pick.page = page THEN list_append(used, pick.block) ELSE [pick.block] END, pick.x0, pick.y0, hit
  FROM (SELECT *, coalesce(-pick.s >= 0.75, false) AS hit FROM (
    SELECT q.doc_id, q.k, q.element_index, w.page, w.used, (list_sort(list_transform(list_filter(q.cs, lambda c: c.page >= w.page AND NOT (c.page = w.page AND list_contains(w.used, c.block))),
      lambda c: {{'s': -(c.score + CASE WHEN w.page >= 0 AND c.page = w.page THEN 0.03 WHEN w.page >= 0 AND c.page = w.page + 1 THEN 0.02 ELSE 0.0 END), 'page': c.page, 'block': c.block, 'x0': c.x0, 'y0': c.y0}})))[1] AS pick
    FROM stepped w JOIN queue q ON q.doc_id = w.doc_id AND q.k = w.k + 1)))"""


QUERIES = {
    "load_page_boxes": lambda spark, folder: load_page_boxes(V.raw_pages(spark, folder)).select(
        "doc_id", "page_number", "box_ord", "block_index", "class", "pos_start", "pos_stop", "text", "norm", F.get("bbox", F.lit(0)).alias("x0")),
    "roman_prefix": _box_rule(B.roman_prefix), "is_heading_box": _box_rule(B.is_heading_box), "is_bullet_box": _box_rule(B.is_bullet_box),
    "is_metadata_box": _box_rule(B.is_metadata_box),
    "index_boxes": _indexed,
    "page_column": lambda spark, folder: _indexed(spark, folder).select("doc_id", "page_number", "kept_ord", "page_column"),
    "page_streams": lambda spark, folder: _pages(spark, folder).select("doc_id", "page_number", "stream", "body_text"),
    "best_page": lambda spark, folder: A.best_page(_targets(spark, folder), V.pages(spark, folder)).select(
        "doc_id", "t", F.coalesce("best_page", F.lit(-1)).alias("best_page"), F.round(F.coalesce("page_score", F.lit(0.0)), 6).alias("score")),
    "candidate_pages": lambda spark, folder: _near(spark, folder, headed=False).select("doc_id", "t", "page_number"),
    "text_match_score": lambda spark, folder: _pairs(spark, folder).select("doc_id", "block_index", F.round(B.text_match_score(F.col("t"), F.col("c")), 6).alias("score")),
    "ratio_size_score": lambda spark, folder: _pairs(spark, folder).select(
        "doc_id", "block_index", F.round(B.ratio_size_score(F.col("cw"), F.col("tw"), F.col("block_index") % 10), 6).alias("score")),
    "match_confidence": lambda spark, folder: _pairs(spark, folder).select("doc_id", "block_index", B.confidence(F.col("cw"), F.col("tw")).alias("confidence")),
    "anchor_lengths": lambda spark, folder: _pairs(spark, folder).select(
        "doc_id", "block_index", B.head_length(F.length("t")).alias("head_len"), B.tail_length(F.length("t")).alias("tail_len")),
    "positions": lambda spark, folder: _pairs(spark, folder).select(
        "doc_id", "block_index", F.array_join(B.occurrences(F.col("t"), F.substring("t", 2, 3)).cast("array<string>"), ",").alias("places")),
    "box_at": lambda spark, folder: _near(spark, folder).select("doc_id", "t", "page_number", F.array_join(F.transform(
        A._boxes_starting(F.col("body"), F.col("body_text"), F.col("head")), lambda x: x["i"].cast("string")), ",").alias("boxes")),
    "head_tail_match": lambda spark, folder: _match_columns(A.head_tail_match(_near(spark, folder))),
    "head_only_match": lambda spark, folder: _match_columns(A.head_only_match(_near(spark, folder, "next1", "next2"))),
    "extend_across_pages": lambda spark, folder: A.head_only_match(_near(spark, folder, "next1", "next2")).select(
        "doc_id", "t", "page_number", F.size(F.array_distinct(F.transform("match.pdf_locations", lambda x: x["page"]))).alias("n_pages")),
    "dedupe_rects": lambda spark, folder: _located_boxes(spark, folder).select(
        "doc_id", "page_number", _rect_text(B.dedupe_rects(F.transform("all", lambda b: b["bbox"]))).alias("rects")),
    "locations": lambda spark, folder: _located_boxes(spark, folder).select(
        "doc_id", "page_number", _rect_text(F.transform(B.dedupe_locations(F.col("all")), lambda x: x["bbox"])).alias("rects")),
    "primary_page": lambda spark, folder: A.head_only_match(_near(spark, folder, "next1", "next2")).select(
        "doc_id", "t", "page_number", F.col("match.page_number").alias("primary_page")),
    "match_summary": lambda spark, folder: A.head_tail_match(_near(spark, folder)).select(
        "doc_id", "t", "page_number", F.col("match.match_confidence").alias("confidence"), F.size("match.pdf_rects").alias("n_rects")),
    "match_paragraphs": _matched,
    "fuzzy_window_match": _windows,
    "match_bullet_item": _bullet_items,
    "match_bullet_list": _lists,
    "match_headings": _headings,
}

_PLACE = "printf('%d:%.4f:%.4f', {}, x.x0, x.y0)"
_MATCH = "doc_id, t, page_number, round(score, 6) AS score, confidence, nb AS n_locations"
ORACLES = {
    "load_page_boxes": f"{BOXES} SELECT doc_id, page_number, box_ord, block_index, class, pos_start, pos_stop, text, norm, x0 FROM page_boxes",
    "roman_prefix": f"{INDEXED} SELECT doc_id, page_number, box_ord, nullif(regexp_extract(m, {D.q(ROMAN)}, 1), '') AS value FROM normed",
    "is_heading_box": f"{INDEXED} SELECT doc_id, page_number, box_ord, {HEADING} AS value FROM normed",
    "is_bullet_box": f"{INDEXED} SELECT doc_id, page_number, box_ord, {BULLET} AS value FROM normed",
    "is_metadata_box": f"{INDEXED} SELECT doc_id, page_number, box_ord, {META} AS value FROM normed",
    "index_boxes": f"{INDEXED} SELECT doc_id, page_number, kept_ord, block_index, start_, stop_, CASE WHEN x0 = 50 THEN 'left' ELSE 'right' END AS page_column, is_heading, is_bullet, n_words FROM indexed",
    "page_column": f"{INDEXED} SELECT doc_id, page_number, kept_ord, CASE WHEN x0 + 100 < 250 THEN 'left' WHEN x0 + 100 > 300 THEN 'right' ELSE 'center' END AS page_column FROM indexed",
    "page_streams": f"{INDEXED} SELECT doc_id, page_number, stream, body_text FROM streams",
    "best_page": f"{TARGETS} SELECT doc_id, t, coalesce(best_page, -1) AS best_page, round(coalesce(page_score, 0), 6) AS score FROM located",
    "candidate_pages": f"{TARGETS} SELECT doc_id, t, page_number FROM near",
    "text_match_score": f"{_PAIR_SQL} SELECT doc_id, block_index, round({match_score('t', 'c')}, 6) AS score FROM pairs",
    "ratio_size_score": f"{_PAIR_SQL} SELECT doc_id, block_index, round({ratio_score('cw', 'tw', '(block_index % 10)')}, 6) AS score FROM pairs",
    "match_confidence": f"{_PAIR_SQL} SELECT doc_id, block_index, {conf('cw', 'tw')} AS confidence FROM pairs",
    "anchor_lengths": f"{_PAIR_SQL} SELECT doc_id, block_index, {HEAD_LEN} AS head_len, {TAIL_LEN} AS tail_len FROM pairs",
    "positions": f"{_PAIR_SQL} SELECT doc_id, block_index, array_to_string(list_filter(range(0, greatest(length(t) - length(substr(t, 2, 3)) + 1, 0)), "
                 "lambda p: length(substr(t, 2, 3)) > 0 AND t[p + 1:p + length(substr(t, 2, 3))] = substr(t, 2, 3)), ',') AS places FROM pairs",
    "box_at": f"""{ANCHORS}, held AS (SELECT DISTINCT h.doc_id, h.t, h.page_number, b.bi FROM head_hits h JOIN body b ON b.doc_id = h.doc_id AND b.page_number = h.page_number AND h.hpos >= b.start_ AND h.hpos < b.stop_)
      SELECT doc_id, t, page_number, string_agg(bi::VARCHAR, ',' ORDER BY bi) AS boxes FROM held GROUP BY 1, 2, 3""",
    "head_tail_match": f"""{HEAD_TAIL} SELECT {_MATCH}, (SELECT string_agg({_PLACE.format('x.page_number')}, ',' ORDER BY x.bi) FROM body x WHERE x.doc_id = h.doc_id AND x.page_number = h.page_number AND x.bi BETWEEN h.i AND h.j) AS places FROM head_tail h""",
    "head_only_match": f"""{HEAD_ONLY}, spots AS (SELECT c.doc_id, c.t, c.page_number, c.i, string_agg({_PLACE.format('c.bp')}, ',' ORDER BY c.bp, c.bi) AS places
      FROM collected c JOIN body x ON x.doc_id = c.doc_id AND x.page_number = c.bp AND x.bi = c.bi GROUP BY 1, 2, 3, 4) SELECT {_MATCH}, places FROM head_only JOIN spots USING (doc_id, t, page_number, i)""",
    "match_bullet_item": f"""{TARGETS},
      bullet_rows AS (SELECT doc_id, page_number, norm, n_words, x0, y0, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY box_ord) - 1 AS i FROM indexed WHERE is_bullet),
      bullet_runs AS (SELECT doc_id, page_number, i, 1 AS n, norm AS c, n_words AS cw, {_PLACE.format('page_number').replace('x.', '')} AS places FROM bullet_rows
        UNION ALL SELECT a.doc_id, a.page_number, a.i, 2, a.norm || ' ' || b.norm, a.n_words + b.n_words, {_PLACE.format('a.page_number').replace('x.', 'a.')} || ',' || {_PLACE.format('b.page_number').replace('x.', 'b.')}
        FROM bullet_rows a JOIN bullet_rows b ON b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.i = a.i + 1),
      bullet_grades AS (SELECT k.doc_id, k.t, k.target_words, p.*  EXCLUDE (doc_id), greatest({match_score('k.t', 'p.c')}, {D.overlap(D.distinct_tokens('k.t'), D.distinct_tokens('p.c'))} * 0.85) AS score
        FROM near k JOIN bullet_runs p ON p.doc_id = k.doc_id AND p.page_number = k.page_number),
      bullet_top AS (SELECT * FROM bullet_grades WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY score DESC, page_number, i, n) = 1)
      SELECT doc_id, t, page_number, replace({conf('cw', 'target_words')}, 'high', 'medium') AS confidence, places FROM bullet_top""",
    "extend_across_pages": f"{HEAD_ONLY} SELECT c.doc_id, c.t, c.page_number, count(DISTINCT bp) AS n_pages FROM collected c JOIN head_only h USING (doc_id, t, page_number, i) GROUP BY 1, 2, 3",
    "dedupe_rects": f"{_MOVED} SELECT p.doc_id, p.page_number, coalesce(string_agg(printf('%.4f:%.4f', x0, y0), ',' ORDER BY k) FILTER (WHERE rn = 1), '') AS rects FROM all_pages p LEFT JOIN firsts f ON f.doc_id = p.doc_id AND f.page_number = p.page_number GROUP BY 1, 2",
    "locations": f"{_MOVED} SELECT p.doc_id, p.page_number, coalesce(string_agg(printf('%.4f:%.4f', x0, y0), ',' ORDER BY k) FILTER (WHERE rn = 1), '') AS rects FROM all_pages p LEFT JOIN firsts f ON f.doc_id = p.doc_id AND f.page_number = p.page_number GROUP BY 1, 2",
    "primary_page": f"""{HEAD_ONLY}, per AS (SELECT c.doc_id, c.t, c.page_number, bp, count(*) AS n FROM collected c JOIN head_only h USING (doc_id, t, page_number, i) GROUP BY 1, 2, 3, 4)
      SELECT doc_id, t, page_number, arg_min(bp, (-n, bp)) AS primary_page FROM per GROUP BY 1, 2, 3""",
    "match_headings": f"{_HEADINGS} SELECT doc_id, element_index, page AS page_number, x0, y0 FROM stepped WHERE hit",
    "match_summary": f"{HEAD_TAIL} SELECT doc_id, t, page_number, confidence, nb AS n_rects FROM head_tail",
}
