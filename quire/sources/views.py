"""Stored tables: stage writer, upserts, cascades and read views (IO-4, IO-5, IO-7..IO-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import filled

LIST_OF_TEXT = "array<string>"
SECTION_LIST = "array<struct<section_key:string,section_title:string,summary:string>>"
HIGHLIGHT_LIST = "array<struct<element_id:int,title:string,summary:string>>"


def write_stages(structured: DataFrame, path: str, fmt: str = "json") -> None:
    """IO-4: every intermediate stage of a structured corpus, partitioned by stage."""
    entry = lambda stage, text: F.struct(F.lit(stage).alias("stage"), text.alias("text"))
    block_text = lambda role: F.transform(F.filter(F.arrays_zip("facts", "roles"), lambda x: x["roles"] == role), lambda x: entry(role, x["facts"]["block"]))
    plain = lambda stage, column, field: F.transform(column, lambda x: entry(stage, x[field]))
    stages = [
        plain("raw_blocks", F.col("facts"), "block"), block_text("front"), block_text("caption"), block_text("removed"), plain("body_before_merge", F.col("body"), "block"),
        plain("body_after_merge", F.col("merged"), "block"), plain("sections", F.col("sections"), "section_title"), plain("chunks", F.col("chunks"), "text"),
    ]
    numbered = [F.transform(s, lambda x, i: F.struct(i.cast("int").alias("ord"), x["stage"].alias("stage"), x["text"].alias("text"))) for s in stages]
    rows = structured.select("doc_id", F.inline_outer(F.concat(*numbered))).where("stage is not null")
    rows.write.mode("overwrite").partitionBy("stage").format(fmt).save(path)


def render_chunk_dump(chunks: DataFrame) -> DataFrame:
    """IO-5: one readable text per chunk."""
    rule = "-" * 80
    return chunks.select("doc_id", "chunk_index", F.concat(
        F.lit("[Chunk "), F.col("chunk_index").cast("string"), F.lit("]\nsection_title: "), F.coalesce("section_title", F.lit("")), F.lit("\nsource_block_indices_in_section: ["),
        F.array_join(F.col("source_block_indices").cast(LIST_OF_TEXT), ", "), F.lit("]\n\n<<< TEXT >>>\n"), F.col("text"), F.lit(f"\n\n{rule}\n")).alias("dump"))


def upsert_overview(overviews: DataFrame, new: DataFrame) -> DataFrame:
    """IO-7: the new row of a document replaces its old one."""
    return overviews.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def list_papers(papers: DataFrame) -> DataFrame:
    """IO-8: newest id first, times in ISO form."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    return papers.select("doc_id", "title", "parse_status", "zh_status", iso("zh_started_at"), iso("zh_finished_at")).orderBy(F.desc("doc_id"))


def _or_else(zh: str, base: str) -> Column:
    """A blank or missing translation falls back to the source text."""
    return F.coalesce(F.nullif(F.col(zh), F.lit("")), F.col(base))


def elements_for_lang(elements: DataFrame, lang: str = "en") -> DataFrame:
    """IO-11: element rows in one language; lists fall back only when there is no translated list."""
    if lang != "zh":
        return elements
    return elements.withColumns({
        "text": _or_else("text_zh", "text"), "summary": _or_else("summary_zh", "summary"),
        "key_points": F.coalesce("key_points_zh", "key_points"), "items": F.coalesce("items_zh", "items")})


def paper_detail(papers: DataFrame, elements: DataFrame, lang: str = "en", hide_subheadings: bool = False) -> DataFrame:
    """IO-9: papers with their elements; rows carry ``element_index`` for the reading order."""
    rows = elements_for_lang(elements, lang).withColumn("type", F.coalesce("type", F.lit("paragraph")))
    for c, kind in (("pdf_rects", "array<array<double>>"), ("pdf_locations", "array<struct<page:int,bbox:array<double>>>")):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.array().cast(kind)) if c in rows.columns else F.array().cast(kind))
    if hide_subheadings:
        rows = rows.where(~((F.col("type") == "heading") & (F.coalesce("level", F.lit("")) != "section")))
    heads = papers.select("doc_id", F.coalesce(filled(F.col("title")), F.element_at(F.split("source_path", "/"), -1)).alias("paper_title"), "parse_status")
    return heads.join(rows, "doc_id")


def _overview_parts(lang: str) -> dict[str, Column]:
    """The parts of an overview in one language; missing ones are empty."""
    zh = lang == "zh"
    text = lambda c: F.coalesce(_or_else(f"{c}_zh", c) if zh else F.col(c), F.lit(""))
    listed = lambda c, kind: F.coalesce(*([F.col(f"{c}_zh")] if zh else []), F.col(c), F.array().cast(kind))
    return {"abstract_summary": text("abstract_summary"), "overall_summary": text("overall_summary"), "overall_key_points": listed("overall_key_points", LIST_OF_TEXT),
            "highlights": listed("highlights", HIGHLIGHT_LIST), "sections": listed("sections", SECTION_LIST)}


def overview_view(overviews: DataFrame, lang: str = "en") -> DataFrame:
    """IO-10: an overview in one language; missing parts come out empty."""
    part = _overview_parts(lang)
    own = lambda *names: [part[n].alias(n) for n in names]
    return overviews.select("doc_id", F.lit(lang).alias("language"), *own("abstract_summary", "overall_summary", "overall_key_points"),
                            F.coalesce("highlight_ids", F.array().cast("array<int>")).alias("highlight_ids"), *own("highlights", "sections"))


#: Fixed value: what stands for a paragraph without text.
NO_TEXT = "—"


def displayed_texts(elements: DataFrame, overviews: DataFrame, langs: tuple[str, ...] = ("en", "zh")) -> DataFrame:
    """Every text on display under its address (doc_id, element_id, scope, field_name, item_index, language): what H-4, H-6 and narration share.

    Paragraphs and lists show their fields in each language with the fall-backs of ``elements_for_lang``, overviews those of ``overview_view``. Parts of
    a list carry their place in ``item_index``. Headings, blank summaries, intros and abstracts are not shown as texts.
    """
    none = F.array().cast("array<struct<field_name:string,item_index:int,language:string,text:string>>")

    def entry(field: str, lang: str, text: Column, index: Column | None = None) -> Column:
        return F.struct(F.lit(field).alias("field_name"), (F.lit(None) if index is None else index).cast("int").alias("item_index"), F.lit(lang).alias("language"), text.alias("text"))

    one = lambda field, lang, text, shown: F.when(shown, F.array(entry(field, lang, text))).otherwise(none)
    each = lambda field, lang, texts: F.coalesce(F.transform(texts, lambda x, i: entry(field, lang, x, i)), none)
    there = lambda c: F.coalesce(c, F.lit("")) != ""

    def of_element(lang: str) -> list[Column]:
        zh = lang == "zh"
        text, summary = (_or_else(f"{c}_zh", c) if zh else F.col(c) for c in ("text", "summary"))
        points, items = (F.coalesce(f"{c}_zh", c) if zh else F.col(c) for c in ("key_points", "items"))
        bullets = F.col("type") == "bullet_list"
        return [each("key_points", lang, points), one("summary", lang, summary, there(summary)), one("text", lang, F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_TEXT)), F.col("type") == "paragraph"),
                one("intro_text", lang, F.col("intro_text"), bullets & there(F.col("intro_text"))), each("item", lang, F.when(bullets, items))]

    def of_overview(lang: str) -> list[Column]:
        part = _overview_parts(lang)
        summaries = lambda name: F.transform(part[name], lambda x: x["summary"])
        return [one("abstract_summary", lang, part["abstract_summary"], there(part["abstract_summary"])), F.array(entry("overall_summary", lang, part["overall_summary"])),
                each("overall_key_points", lang, part["overall_key_points"]), each("section_summary", lang, summaries("sections")), each("highlight_summary", lang, summaries("highlights"))]

    body = elements.where(F.col("type").isin("paragraph", "bullet_list"))
    texts = body.select("doc_id", "element_id", F.lit("paragraph").alias("scope"), F.inline(F.concat(*[c for lang in langs for c in of_element(lang)])))
    # all languages from one reading of the overviews
    panels = overviews.select("doc_id", F.lit(None).cast("long").alias("element_id"), F.lit("overview").alias("scope"), F.inline(F.concat(*[c for lang in langs for c in of_overview(lang)])))
    return texts.unionByName(panels).where(F.col("text").isNotNull())


def highlights_view(text_highlights: DataFrame, pdf_highlights: DataFrame, lang: str = "en") -> DataFrame:
    """IO-12: text highlights of one language and all page highlights, in one long view."""
    texts = text_highlights.where(F.col("language") == lang).select("doc_id", F.lit("text").alias("kind"), "highlight_id", "element_id", "field_name", "start_offset", "end_offset",
                                                                   F.lit(None).cast("int").alias("page_number"))
    marks = pdf_highlights.select("doc_id", F.lit("pdf").alias("kind"), "highlight_id", "element_id", F.lit(None).cast("string").alias("field_name"),
                                  F.lit(None).cast("int").alias("start_offset"), F.lit(None).cast("int").alias("end_offset"), "page_number")
    return texts.unionByName(marks)


def delete_papers(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """IO-13: remove documents from every table."""
    gone = ids.select("doc_id").distinct()
    return {name: df.join(gone, "doc_id", "left_anti") for name, df in tables.items()}


def parse_status(papers: DataFrame, failures: DataFrame) -> DataFrame:
    """IO-16: ``failures`` holds (doc_id, stage); a failed overview alone does not fail a paper."""
    broken = failures.where(F.col("stage") != "overview").select("doc_id").distinct().withColumn("_broken", F.lit(True))
    return papers.join(broken, "doc_id", "left").withColumn("parse_status", F.when(F.col("_broken"), "failed").otherwise("processed")).drop("_broken")
