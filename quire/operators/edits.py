"""Application of edit logs (E-1..E-13).

An edit is a row (edit_seq, doc_id, element_id, op, text, intro_text, items) with op one of
``update``, ``bullets``, ``insert`` and ``delete``. One job applies a batch: within it the
latest update of an element wins, and edits on an element after its deletion are rejected.
Edits are reduced to one row per element before they meet the element table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import bullet_content, filled, section_key, strip
from quire.operators.forest import linearise, resolve
from quire.operators.scan import running, tile_of
from quire.session import stored

BODY = ("paragraph", "bullet_list")
# Text-highlight fields that an edit makes stale.
STALE_FIELDS = {
    "update": ["text", "summary", "key_points"],
    "bullets": ["intro_text", "item", "summary", "key_points"],
    "delete": ["text", "summary", "key_points", "intro_text", "item"],
}
SECTION_INSTRUCTION = "Summarise one section from the paragraph summaries below. Answer with one JSON object holding \"summary\"."
SECTION_INSTRUCTION_ZH = "Summarise one section in Traditional Chinese from the paragraph summaries below. Answer with one JSON object holding \"summary\"."


def _targets(edits: DataFrame, elements: DataFrame) -> DataFrame:
    """What an edit may name: stored elements, born before the batch, and the rows that its insertions make."""
    known = elements.select("element_id", F.col("doc_id").alias("_doc"), F.col("type").alias("_type"), "section_title", F.col("element_index").alias("anchor_index"), F.lit(0).cast("long").alias("_born"))
    made = edits.where(F.col("op") == "insert").select(
        (-F.col("edit_seq")).alias("element_id"), F.lit("paragraph").alias("_type"), F.col("edit_seq").cast("long").alias("_born"))
    return known.unionByName(made, allowMissingColumns=True)


def _judged(edits: DataFrame, targets: DataFrame) -> DataFrame:
    """Reasons as far as an edit and its own target tell."""
    joined = edits.join(targets, "element_id", "left")
    op, kind = F.col("op"), F.col("_type")
    reason = (
        F.when(kind.isNull() | (F.col("_born") >= F.col("edit_seq")), "missing_element")
        .when((op == "update") & (kind != "paragraph"), "not_a_paragraph").when((op == "bullets") & (kind != "bullet_list"), "not_a_bullet_list")
        .when(op.isin("insert", "delete") & ~kind.isin(*BODY), "not_editable").when((op == "insert") & filled(F.col("text")).isNull(), "blank_text")
    )
    judged = joined.withColumn("reason", reason).drop("_type")
    gone = judged.where(F.col("reason").isNull() & (op == "delete")).groupBy("element_id").agg(F.min("edit_seq").alias("_gone"))
    return judged.join(gone, "element_id", "left").withColumn(
        "reason", F.when(F.col("reason").isNull() & (F.col("edit_seq") > F.col("_gone")), "deleted_before").otherwise(F.col("reason"))).drop("_gone")


def _names_insertions(edits: DataFrame) -> bool:
    """Whether an edit names a row that the batch itself inserts; reads the log alone."""
    made = edits.where(F.col("op") == "insert").select((-F.col("edit_seq")).alias("element_id"))
    return not edits.where("element_id < 0").join(made, "element_id", "left_semi").isEmpty()


def judge_edits(edits: DataFrame, elements: DataFrame) -> DataFrame:
    """E-13: every edit with the reason it is rejected, or NULL, and the stored element ``root_id`` that its row stands behind (or is).

    ``doc_id`` is that of the stored element where there is one.
    Edits are judged as if they were served one by one: those on a row that the batch inserted count where the insertion comes earlier and was
    itself accepted, along the whole chain of insertions.
    """
    root = F.col("element_id").alias("root_id")
    finish = lambda df: df.withColumn("doc_id", F.coalesce("_doc", "doc_id")).drop("_born", "_doc")
    if not _names_insertions(edits):
        return _judged(edits, _targets(edits.limit(0), elements)).select("*", root).transform(finish)
    judged = stored(_judged(edits, _targets(edits, elements)), "judged-edits")
    on_insert = F.col("_born") > 0
    inserts = judged.where((F.col("op") == "insert") & (F.coalesce("_born", F.lit(0)) < F.col("edit_seq")))
    chains = resolve(inserts.select("edit_seq", F.when(on_insert, -F.col("element_id")).alias("parent"), F.col("reason").isNull().alias("ok")))
    tops = inserts.where(~on_insert).select(F.col("edit_seq").alias("top"), root, F.col("section_title").alias("_title"), F.col("anchor_index").alias("_index"), F.col("_doc").alias("_home"))
    made = chains.join(tops, "top", "left").select((-F.col("edit_seq")).alias("element_id"), "whole", F.col("root_id").alias("_root"), "_title", "_index", "_home")
    direct, chained = judged.where(~F.coalesce(on_insert, F.lit(False))), judged.where(on_insert)
    reason = F.when(F.coalesce("whole", F.lit(False)), F.col("reason")).otherwise("missing_element")
    settled = chained.drop("section_title", "anchor_index", "_doc").join(made, "element_id", "left").withColumn("reason", reason)
    settled = settled.withColumnsRenamed({"_title": "section_title", "_index": "anchor_index", "_root": "root_id", "_home": "_doc"}).drop("whole")
    return direct.select("*", root).unionByName(settled).transform(finish)


def accepted(edits: DataFrame, elements: DataFrame) -> DataFrame:
    return judge_edits(edits, elements).where(F.col("reason").isNull()).drop("reason")


def rejected(edits: DataFrame, elements: DataFrame) -> DataFrame:
    return refused(judge_edits(edits, elements))


def refused(judged: DataFrame) -> DataFrame:
    """The rejected ones of ``judge_edits``."""
    return judged.where(F.col("reason").isNotNull()).select("edit_seq", "doc_id", "element_id", "op", "reason")


def _latest(edits: DataFrame, op: str) -> DataFrame:
    return edits.where(F.col("op") == op).groupBy("element_id").agg(F.max_by(F.struct("text", "intro_text", "items"), "edit_seq").alias("_e"))


def _rewritten(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Set ``values`` where an edit hit and clear the fields that must be generated anew."""
    hit = F.col("_e").isNotNull()
    clear = {c: F.when(~hit, F.col(c)) for c in ("summary", "key_points", "summary_zh", "key_points_zh")}
    out = rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()} | clear)
    return out.withColumn("dirty", F.col("dirty") | hit).drop("_e")


def with_content(elements: DataFrame) -> DataFrame:
    """The stored reading text: the text, or intro and items of a list."""
    lists = F.array_join(F.concat(F.filter(F.array("intro_text"), lambda x: x != ""), F.coalesce("items", F.array().cast("array<string>"))), "\n")
    return elements.withColumn("content", F.when(F.col("type") == "bullet_list", lists).otherwise(F.coalesce("text", F.lit(""))))


def _with_dirty(elements: DataFrame) -> DataFrame:
    out = elements if "content" in elements.columns else with_content(elements)
    return out if "dirty" in out.columns else out.withColumn("dirty", F.lit(False))


def update_paragraphs(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """E-1: new text; summary, key points and translations wait for regeneration."""
    rows = _with_dirty(elements).join(_latest(edits, "update"), "element_id", "left")
    hit = F.col("_e").isNotNull()
    rows = rows.withColumn("text_zh", F.when(~hit, F.col("text_zh")))
    return _rewritten(rows, {"content": F.col("_e.text"), "text": F.col("_e.text")})


def update_bullets(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """E-2: trimmed intro (blank becomes NULL), non-blank items, rebuilt content."""
    rows = _with_dirty(elements).join(_latest(edits, "bullets"), "element_id", "left")
    hit = F.col("_e").isNotNull()
    items = F.filter(F.transform(F.coalesce("_e.items", F.array().cast("array<string>")), strip), lambda x: x != "")
    rows = rows.withColumn("items_zh", F.when(~hit, F.col("items_zh")))
    return _rewritten(rows, {"content": bullet_content(F.col("_e.intro_text"), items), "intro_text": filled(F.col("_e.intro_text")), "items": items})


def delete_elements(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """E-4."""
    gone = edits.where(F.col("op") == "delete").select("element_id").distinct()
    return _with_dirty(elements).join(gone, "element_id", "left_anti")


def inserted_rows(edits: DataFrame, like: DataFrame) -> DataFrame:
    """E-3: the new paragraphs, with the section of the stored element above them and its index until ``places`` numbers them.

    The id of a new element is the negated edit number (edits count from 1), which no stored element has.
    """
    new = edits.where(F.col("op") == "insert").select(
        "doc_id", (-F.col("edit_seq")).alias("element_id"), F.col("anchor_index").alias("element_index"), F.lit("paragraph").alias("type"), "section_title",
        strip(F.col("text")).alias("text"), strip(F.col("text")).alias("content"), F.lit(True).alias("dirty"))
    missing = [f for f in like.schema.fields if f.name not in new.columns]
    return new.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def places(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """E-5: (element_id, element_index), the dense numbering after accepted edits; later insertions behind an anchor come first.

    The stored elements are the only rows that are counted through; what stands behind one of them adds its size there, and inserted rows find
    their place from it. Deleted rows weigh nothing but keep the place of what was inserted behind them.
    """
    gone = edits.where(F.col("op") == "delete").select("element_id", F.lit(0).alias("_w")).distinct()
    weight = F.coalesce("_w", F.lit(1)).alias("weight")
    nodes = edits.where(F.col("op") == "insert").select("edit_seq", F.col("element_id").alias("anchor"), "root_id", (-F.col("edit_seq")).alias("_id")).join(
        gone.withColumnRenamed("element_id", "_id"), "_id", "left")
    parent = F.when(F.col("anchor") != F.col("root_id"), -F.col("anchor")).alias("parent")
    nodes = linearise(stored(nodes.select("edit_seq", "anchor", parent, "root_id", weight), "inserts"))
    behind = nodes.groupBy(F.col("root_id").alias("element_id")).agg(F.sum("weight").alias("_behind"))
    spine = elements.select("doc_id", "element_id", "element_index").join(gone, "element_id", "left").join(behind, "element_id", "left").select(
        "doc_id", "element_id", "element_index", weight, (F.coalesce("_w", F.lit(1)) + F.coalesce("_behind", F.lit(0))).alias("_n"))
    counted = stored(running(spine, ["doc_id"], ["element_index", "element_id"], tile_of("element_index"), sums={"_base": F.col("_n")}, inclusive=False).select(
        "element_id", "weight", "_base"), "element-places")
    number = lambda c: c.cast("int").alias("element_index")
    old = counted.where("weight = 1").select("element_id", number(F.col("_base")))
    above = counted.select(F.col("element_id").alias("root_id"), (F.col("_base") + F.col("weight")).alias("_first"))
    new = nodes.where("weight = 1").join(above, "root_id").select((-F.col("edit_seq")).alias("element_id"), number(F.col("_first") + F.col("place")))
    return old.unionByName(new)


def apply_edits(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """E-1..E-5 in one pass: the next snapshot of the element table."""
    return apply_accepted(elements, stored(accepted(edits, elements), "accepted-edits"))


def apply_accepted(elements: DataFrame, good: DataFrame) -> DataFrame:
    """``apply_edits`` for edits that are judged already."""
    base = _with_dirty(elements)
    rows = base.unionByName(inserted_rows(good, base))
    kept = delete_elements(update_bullets(update_paragraphs(rows, good), good), good)
    return kept.drop("element_index").join(places(elements, good), "element_id")


def touched_sections(edits: DataFrame) -> DataFrame:
    """Sections whose summary must be written anew."""
    return edits.where(filled(F.col("section_title")).isNotNull()).select("doc_id", "section_title").distinct()


def section_refresh_lines(elements: DataFrame, touched: DataFrame) -> DataFrame:
    """E-6 as evidence lines (doc_id, section_title, lang, place, line); sections without a summary have none."""
    key = ["doc_id", "section_title"]
    rows = elements.where(F.col("type").isin(*BODY)).join(touched, key, "left_semi").select(
        *key, F.col("element_index").alias("place"), filled(F.col("summary")).alias("en"), filled(F.col("summary_zh")).alias("zh"))
    counts = rows.groupBy(*key).agg(F.count("en").alias("_en"), F.count("zh").alias("_zh")).where("_en > 0")
    zh = F.when(F.col("_zh") > 0, F.col("zh")).otherwise(F.col("en"))
    both = F.array(F.struct(F.lit("en").alias("lang"), F.col("en").alias("s")), F.struct(F.lit("zh").alias("lang"), zh.alias("s")))
    return rows.join(counts, key).select(*key, "place", F.inline(both)).where("s IS NOT NULL").select(*key, "lang", "place", F.concat(F.lit("- "), F.col("s")).alias("line"))


def section_refresh_head(title: Column, lang: Column) -> Column:
    """What stands before the lines in a request of E-7."""
    return F.concat(F.when(lang == "en", SECTION_INSTRUCTION).otherwise(SECTION_INSTRUCTION_ZH), F.lit("\n\nSection: "), title, F.lit("\n\nSummaries:\n"))


def section_refresh_source(elements: DataFrame, touched: DataFrame) -> DataFrame:
    """E-6: the ordered summaries of the touched sections; zh falls back to en, none is skipped."""
    rows = elements.where(F.col("type").isin(*BODY)).join(touched, ["doc_id", "section_title"], "left_semi")
    gather = lambda c: F.transform(F.array_sort(F.collect_list(F.when(filled(F.col(c)).isNotNull(), F.struct("element_index", filled(F.col(c)).alias("s"))))), lambda x: x["s"])
    lists = rows.groupBy("doc_id", "section_title").agg(gather("summary").alias("summaries"), gather("summary_zh").alias("summaries_zh"))
    return lists.where(F.size("summaries") > 0).withColumn("summaries_zh", F.when(F.size("summaries_zh") > 0, F.col("summaries_zh")).otherwise(F.col("summaries")))


def section_refresh_prompts(source: DataFrame) -> DataFrame:
    """E-7: one English and one Chinese request per touched section."""
    def prompt(lang: str, lines: str) -> Column:
        listed = F.array_join(F.transform(lines, lambda s: F.concat(F.lit("- "), s)), "\n")
        return F.concat(section_refresh_head(F.col("section_title"), F.lit(lang)), listed)

    both = F.array(*[F.struct(F.lit(lang).alias("lang"), prompt(lang, lines).alias("prompt")) for lang, lines in (("en", "summaries"), ("zh", "summaries_zh"))])
    return source.select("doc_id", "section_title", F.inline(both))


def upsert_section(sections: Column, title: Column, summary: Column, keep_title: bool = False) -> Column:
    """E-8 on one section list: replace the first entry with the same key, else append."""
    key = section_key(title)
    keys = F.transform(sections, lambda s: F.coalesce(F.nullif(s["section_key"], F.lit("")), section_key(s["section_title"])))
    place = F.array_position(keys, key)
    name = (lambda s: F.coalesce(F.nullif(s["section_title"], F.lit("")), title)) if keep_title else (lambda s: title)
    entry = F.struct(key.alias("section_key"), title.alias("section_title"), summary.alias("summary"))
    replaced = F.transform(sections, lambda s, i: F.when(i + 1 == place, F.struct(key.alias("section_key"), name(s).alias("section_title"), summary.alias("summary"))).otherwise(s))
    return F.when(place > 0, replaced).otherwise(F.concat(sections, F.array(entry)))


def upsert_section_summaries(overviews: DataFrame, new: DataFrame) -> DataFrame:
    """E-8: fold the refreshed (doc_id, section_title, summary, summary_zh) into the overviews.

    Every entry of a document is folded, in title order; documents without an overview are left alone.
    """
    shape = "array<struct<section_key:string,section_title:string,summary:string>>"
    fresh = new.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_title", "summary", "summary_zh"))).alias("_new"))
    joined = overviews.join(fresh, "doc_id", "left")

    def folded(column: str, summary: str, keep_title: bool) -> Column:
        start = F.coalesce(F.col(column), F.array()).cast(shape)
        return F.when(F.col("_new").isNull(), F.col(column)).otherwise(
            F.aggregate("_new", start, lambda acc, n: upsert_section(acc, n["section_title"], n[summary], keep_title).cast(shape)))

    return joined.withColumns({"sections": folded("sections", "summary", False), "sections_zh": folded("sections_zh", "summary_zh", True)}).drop("_new")


def invalidate_paragraph_highlights(highlights: DataFrame, edits: DataFrame) -> DataFrame:
    """E-9: drop text highlights on fields an edit rewrote."""
    fields = F.create_map(*[x for op, names in STALE_FIELDS.items() for x in (F.lit(op), F.array(*[F.lit(n) for n in names]))])
    stale = edits.where(F.col("op").isin(*STALE_FIELDS)).select("element_id", F.explode(F.try_element_at(fields, F.col("op"))).alias("field_name")).distinct().withColumn("scope", F.lit("paragraph"))
    return highlights.join(stale, ["element_id", "field_name", "scope"], "left_anti")


def invalidate_pdf_highlights(highlights: DataFrame, edits: DataFrame) -> DataFrame:
    """E-10: drop page highlights of deleted elements."""
    return highlights.join(edits.where(F.col("op") == "delete").select("element_id").distinct(), "element_id", "left_anti")


def invalidate_section_highlights(highlights: DataFrame, edits: DataFrame, overviews: DataFrame) -> DataFrame:
    """E-11: drop section-summary highlights of the sections that updates touched."""
    same = lambda c: F.lower(strip(c))
    updated = edits.where(F.col("op").isin("update", "bullets")).select("doc_id", same(F.col("section_title")).alias("key")).distinct()
    listed = overviews.select("doc_id", F.posexplode("sections").alias("item_index", "s")).select("doc_id", "item_index", same(F.col("s.section_title")).alias("key"))
    stale = listed.groupBy("doc_id", "key").agg(F.min("item_index").alias("item_index")).join(updated, ["doc_id", "key"], "left_semi").select(
        "doc_id", "item_index", F.lit("overview").alias("scope"), F.lit("section_summary").alias("field_name"))
    return highlights.join(stale, ["doc_id", "item_index", "scope", "field_name"], "left_anti")


def invalidate_overview_highlights(highlights: DataFrame, regenerated: DataFrame) -> DataFrame:
    """E-12: drop all overview highlights of regenerated documents."""
    stale = regenerated.select("doc_id").distinct().withColumn("scope", F.lit("overview"))
    return highlights.join(stale, ["doc_id", "scope"], "left_anti")
