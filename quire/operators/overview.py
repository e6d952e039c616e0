"""Section and document roll-ups (O-1..O-8, O-10, O-11).

Section membership is a running count over a document's elements, done with tiled scans.
Evidence is a relation of lines; ``evidence.answer_whole`` asks for it in parts of bounded length. ``overview_source``, ``overview_prompts`` and
``section_prompts`` show it as one text, whose size is the size of the result cell itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.arrays import inline_rows, numbered_rows
from quire.functions.jsontext import extract_json, item_texts, member_list, member_text
from quire.functions.text import filled, section_key, section_key_ui, strip
from quire.operators.evidence import TAG
from quire.operators.scan import running, tile_of
from quire.session import by_key, stored

OVERVIEW_INSTRUCTION = (
    "Summarise the document from the evidence lines below. Answer with one JSON object: \"overall_summary\", "
    "\"overall_key_points\" (3 to 5), \"highlight_element_ids\" (3 to 6 of the given ids) and \"highlight_summaries\" "
    "(element_id, title, summary for each of them). Use nothing but the evidence."
)
SECTION_INSTRUCTION = "Summarise one section from the evidence lines below. Answer with one JSON object holding \"summary\"."
SECTION_KEYS = ["doc_id", "section_no", "section_title"]
OVERVIEW_HEAD = f"{OVERVIEW_INSTRUCTION}\n\nEvidence:\n"


def section_head(title: Column) -> Column:
    """What stands before the evidence in a section's prompt."""
    return F.concat(F.lit(f"{SECTION_INSTRUCTION}\n\nSection: "), title, F.lit("\n\nEvidence:\n"))


def _line(c: Column, prefix: Column | str) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    text = filled(c)
    return F.when(text.isNotNull(), F.concat(head, text))


def _present(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.isNotNull())


def _evidence(summary: Column | str, points: Column | str) -> Column:
    """Evidence lines of one element: its summary, then its key points."""
    own = F.array(_line(F.col("summary"), summary))
    kps = F.transform(F.coalesce("key_points", F.array().cast("array<string>")), lambda k: _line(k, points))
    return _present(F.concat(own, kps))


def _placed_lines(rows: DataFrame, keys: list[str], lines: Column) -> DataFrame:
    """(keys, place, line) with the lines of an element as one; elements without lines add nothing."""
    return rows.select(*keys, F.col("element_index").alias("place"), F.array_join(lines, "\n").alias("line"), F.size(lines).alias("_n")).where(F.col("_n") > 0).drop("_n")


def _joined_lines(lines: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Concatenate the lines of each key in order."""
    return lines.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias(out))


def overview_lines(elements: DataFrame) -> DataFrame:
    """O-1: the evidence of each document as (doc_id, place, line)."""
    tag = F.concat(F.lit("[ELEMENT "), F.col("element_index").cast("string"))
    heading = _present(F.array(_line(F.col("text"), F.concat(F.lit("[HEADING|"), F.coalesce(strip(F.col("level")), F.lit("")), F.lit("] ")))))
    body = _evidence(F.concat(tag, F.lit(" SUMMARY] ")), F.concat(tag, F.lit(" KEYPOINT] ")))
    lines = F.when(F.col("type") == "heading", heading).otherwise(body)
    return _placed_lines(elements, ["doc_id"], lines)


def overview_source(elements: DataFrame) -> DataFrame:
    """O-1: the evidence text of each document."""
    source = _joined_lines(overview_lines(elements), ["doc_id"], "source")
    return elements.select("doc_id").distinct().join(source, "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))


def overview_prompts(elements: DataFrame) -> DataFrame:
    """O-2."""
    return overview_source(elements).select("doc_id", F.concat(F.lit(OVERVIEW_HEAD), F.col("source")).alias("prompt"))


def parse_overview(responses: DataFrame) -> DataFrame:
    """O-3: usable fields of an overview answer."""
    v = F.col("_v")

    def read(x: Column) -> Column:
        return F.struct(
            F.try_variant_get(x, "$.element_id", "int").alias("element_id"), strip(member_text(x, "title")).alias("title"),
            strip(member_text(x, "summary")).alias("summary"))

    highlights = F.filter(F.transform(F.coalesce(member_list(v, "highlight_summaries"), F.array().cast("array<variant>")), read),
                          lambda h: h["element_id"].isNotNull() & ((h["title"] != "") | (h["summary"] != "")))
    ids = F.transform(F.coalesce(member_list(v, "highlight_element_ids"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$", "int"))
    # a column of its own, or every field would parse the answer anew
    return responses.select("doc_id", F.parse_json(extract_json(F.col("content"))).alias("_v")).select(
        "doc_id", strip(member_text(v, "overall_summary")).alias("overall_summary"),
        F.filter(F.transform(item_texts(member_list(v, "overall_key_points")), strip), lambda x: x != "").alias("overall_key_points"),
        F.filter(ids, lambda x: x.isNotNull()).alias("highlight_ids"), highlights.alias("highlights"))


def group_sections(elements: DataFrame) -> DataFrame:
    """O-4: body elements with the section heading they stand under.

    Elements before the first section heading, and those under an untitled one, drop out.
    """
    opens = (F.col("type") == "heading") & (F.col("level") == "section")
    mark = F.when(opens, F.struct(F.col("element_index").alias("start"), strip(F.coalesce("text", F.lit(""))).alias("title")))
    spine = elements.select("doc_id", "element_index", "type", "level", "text", "summary", "key_points")
    placed = running(spine, ["doc_id"], ["element_index"], tile_of("element_index"), lasts={"section": mark}, sums={"section_no": opens.cast("int")})
    return placed.where(F.col("type").isin("paragraph", "bullet_list") & (F.col("section.title") != "")).select(
        "doc_id", (F.col("section_no") - 1).cast("int").alias("section_no"), F.col("section.title").alias("section_title"), "element_index", "summary", "key_points")


def _first_two(keys: list[str], rows: DataFrame, out: str) -> DataFrame:
    """The first two non-blank summaries in order, joined.

    Each tile of elements keeps its own first two, so no group ever gathers a whole section.
    """
    text = filled(F.col("summary"))
    two = lambda c: F.slice(F.array_sort(c), 1, 2)
    short = rows.where(text.isNotNull()).groupBy(*keys, tile_of("element_index").alias("_tile")).agg(
        two(F.collect_list(F.struct("element_index", text.alias("s")))).alias("top"))
    return short.groupBy(*keys).agg(F.array_join(F.transform(
        two(F.flatten(F.collect_list("top"))), lambda x: x["s"]), " ").alias(out))


def section_lines(sections: DataFrame) -> DataFrame:
    """O-5: the evidence of ``group_sections`` rows."""
    return _placed_lines(sections, SECTION_KEYS, _evidence(TAG, "[KEYPOINT] "))


def section_prompts(elements: DataFrame) -> DataFrame:
    """O-5."""
    rows = group_sections(elements)
    source = _joined_lines(section_lines(rows), SECTION_KEYS, "source")
    return rows.select(*SECTION_KEYS).distinct().join(source, SECTION_KEYS, "left").select(
        *SECTION_KEYS, F.concat(section_head(F.col("section_title")), F.coalesce("source", F.lit(""))).alias("prompt"))


def abstract_lines(abstracts: DataFrame) -> DataFrame:
    """O-7: the evidence of ``abstract_elements`` rows, in the form of a section's."""
    return _placed_lines(abstracts, ["doc_id"], _evidence(TAG, "[KEYPOINT] "))


def section_summaries(elements: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """O-6: the model's summary, else the section's first two summaries; empty ones drop out."""
    keys = ["doc_id", "section_no", "section_title"]
    rows = group_sections(elements)
    base = rows.select(*keys).distinct().join(by_key(_first_two(keys, rows, "fallback")), keys, "left")
    if responses is not None:
        answers = responses.select("doc_id", "section_no", filled(member_text(F.parse_json(extract_json(F.col("content"))), "summary")).alias("answer"))
        base = base.join(by_key(answers), ["doc_id", "section_no"], "left")
    else:
        base = base.withColumn("answer", F.lit(None).cast("string"))
    return base.select(*keys, section_key(F.col("section_title")).alias("section_key"), F.coalesce("answer", "fallback").alias("summary")).where(
        F.coalesce("summary", F.lit("")) != "")


def abstract_elements(elements: DataFrame) -> DataFrame:
    """Body elements from the first ABSTRACT heading up to the next section heading."""
    heading = F.col("type") == "heading"
    is_abstract = heading & (F.upper(strip(F.coalesce("text", F.lit("")))) == "ABSTRACT")
    first = elements.where(is_abstract).groupBy("doc_id").agg(F.min("element_index").alias("a"))
    stops = elements.where(heading & (F.col("level") == "section") & ~is_abstract).select("doc_id", F.col("element_index").alias("s"))
    ends = stops.join(by_key(first), "doc_id").where(F.col("s") > F.col("a")).groupBy("doc_id").agg(F.min("s").alias("b"))
    span = first.join(by_key(ends), "doc_id", "left")
    return elements.join(by_key(span), "doc_id").where(
        F.col("type").isin("paragraph", "bullet_list") & (F.col("element_index") > F.col("a")) & (F.col("b").isNull() | (F.col("element_index") < F.col("b"))))


def abstract_summary(elements: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """O-7: one row per document; the empty text when it has no abstract."""
    fallback = _first_two(["doc_id"], abstract_elements(elements), "fallback")
    base = elements.select("doc_id").distinct().join(by_key(fallback), "doc_id", "left")
    if responses is not None:
        base = base.join(responses.select("doc_id", filled(member_text(F.parse_json(extract_json(F.col("content"))), "summary")).alias("answer")), "doc_id", "left")
        # A document without abstract elements asks no question, so an answer without them is ignored.
        own = abstract_elements(elements).select("doc_id").distinct().withColumn("has_abstract", F.lit(True))
        base = base.join(by_key(own), "doc_id", "left")
        return base.select("doc_id", F.coalesce(F.when(F.col("has_abstract"), F.col("answer")), "fallback", F.lit("")).alias("abstract_summary"))
    return base.select("doc_id", F.coalesce("fallback", F.lit("")).alias("abstract_summary"))


def regenerate_overviews(elements: DataFrame, overview_answers: DataFrame, section_answers: DataFrame | None = None,
                         abstract_answers: DataFrame | None = None) -> DataFrame:
    """O-8: the new overview rows of all documents that have elements.

    The roll-ups read the rows several times, so they are evaluated once and stored; they need the texts of headings alone and no key points.
    """
    own = stored(elements.select(
        "doc_id", "element_index", "type", "level", F.when(F.col("type") == "heading", F.col("text")).alias("text"), "summary",
        F.lit(None).cast("array<string>").alias("key_points")), "overview-rows")
    sections = section_summaries(own, section_answers).groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("section_no", "section_key", "section_title", "summary"))),
        lambda s: F.struct(s["section_key"].alias("section_key"), s["section_title"].alias("section_title"), s["summary"].alias("summary"))).alias("sections"))
    return abstract_summary(own, abstract_answers).join(by_key(parse_overview(overview_answers)), "doc_id", "left").join(by_key(sections), "doc_id", "left")


def _speaker(digit: str, spoken: str):
    return lambda x: F.regexp_replace(x, rf"(?<![A-Za-z0-9_]){digit}\.", spoken)


def narration_segments(overviews: DataFrame, lang: str = "en") -> DataFrame:
    """O-10: the non-blank texts of an overview in reading order."""
    none = F.array().cast("array<string>")
    pairs = lambda c, a, b: F.flatten(F.transform(c, lambda x: F.array(x[a], x[b])))
    texts = F.concat(
        F.array("abstract_summary", "overall_summary"), F.coalesce("overall_key_points", none),
        F.coalesce(pairs(F.col("highlights"), "title", "summary"), none), F.coalesce(pairs(F.col("sections"), "section_title", "summary"), none))
    said = F.filter(F.transform(texts, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    if lang == "zh":
        # Spoken forms of the numbered points.
        for digit, spoken in (("1", "第一點，"), ("2", "第二點，"), ("3", "第三點，"), ("4", "第四點，")):
            said = F.transform(said, _speaker(digit, spoken))
    return numbered_rows(overviews, said, "doc_id", names=("segment", "text"))


def section_jump(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """O-11: the heading each section summary leads to.

    ``sections`` holds (doc_id, position, section_title). A title jumps to the heading at the
    place of its first occurrence in the summaries, else to the first heading with the same key.
    """
    opens = (F.col("type") == "heading") & (F.col("level") == "section")
    heads = running(elements.where(opens).select("doc_id", "element_index", "text"), ["doc_id"], ["element_index"], tile_of("element_index"), sums={"k": F.lit(1)})
    heads = heads.select("doc_id", "element_index", (F.col("k") - 1).cast("int").alias("first_position"), section_key_ui(F.col("text")).alias("key"))
    firsts = sections.groupBy("doc_id", "section_title").agg(F.min("position").alias("first_position"))
    by_place = firsts.join(heads.select("doc_id", "first_position", F.col("element_index").alias("placed")), ["doc_id", "first_position"], "left")
    by_key = heads.groupBy("doc_id", "key").agg(F.min("element_index").alias("keyed"))
    targets = by_place.withColumn("key", section_key_ui(F.col("section_title"))).join(by_key, ["doc_id", "key"], "left")
    return sections.join(targets.select("doc_id", "section_title", F.coalesce("placed", "keyed").alias("target_index")), ["doc_id", "section_title"], "left")
