"""Element building without page positions (A-23) and heading levels (C-29)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.arrays import inline_rows
from quire.functions.elements import heading_family, is_subsection_heading
from quire.functions.text import filled, strip
from quire.operators.scan import running, tile_of

CHUNKS_PER_TILE = 1024


def chunk_spine(drafts: DataFrame) -> DataFrame:
    """One narrow row per chunk with elements: its title, whether it opens a heading, its offset.

    Only ids, titles and counts are scanned; the element texts never enter a window.
    """
    title = F.nullif(filled(F.coalesce("section_title", F.lit(""))), F.lit("UNKNOWN"))
    spine = drafts.select("doc_id", "chunk_index", title.alias("title"), F.size("elements").alias("n")).where(F.col("n") > 0)
    tile = tile_of("chunk_index", CHUNKS_PER_TILE)
    seen = running(spine, ["doc_id"], ["chunk_index"], tile, lasts={"prev_title": F.col("title")}, inclusive=False)
    opens = F.col("title").isNotNull() & (F.col("prev_title").isNull() | (F.col("title") != F.col("prev_title")))
    flagged = seen.withColumn("opens", opens).withColumn("rows", F.col("n") + F.col("opens").cast("int"))
    return running(flagged, ["doc_id"], ["chunk_index"], tile, sums={"offset": F.col("rows")}, inclusive=False).select(
        "doc_id", "chunk_index", "opens", F.coalesce("title", "prev_title").alias("heading"), "offset")


def build_elements(drafts: DataFrame) -> DataFrame:
    """A-23: insert a heading where the section title changes and number the elements densely."""
    spine = chunk_spine(drafts)
    rows = drafts.join(spine, ["doc_id", "chunk_index"])
    none = F.lit(None)
    heading = F.struct(
        F.lit(-1).alias("idx_in_chunk"), F.lit("heading").alias("type"), F.col("heading").alias("text"), none.cast("string").alias("intro_text"),
        none.cast("array<string>").alias("items"), none.cast("string").alias("summary"), none.cast("array<string>").alias("key_points"))
    elements = F.concat(F.filter(F.array(heading), lambda _: F.col("opens")), F.col("elements"))
    numbered = F.transform(elements, lambda e, i: F.struct((F.col("offset") + i).cast("int").alias("element_index"), e.alias("e")))
    return inline_rows(rows, numbered, "doc_id", "chunk_index", F.col("heading").alias("section_title"), key="element_index").select(
        "doc_id", "element_index", "chunk_index", "section_title", "e.*",
        F.when(F.col("e.type") == "heading", "section").alias("level"))


def normalize_heading_levels(elements: DataFrame) -> DataFrame:
    """C-29: headings of the document's leading style are sections, all others subsections.

    The leading style is one associative aggregate per document, joined back to the rows.
    """
    text = strip(F.coalesce("text", F.lit("")))
    heading = (F.col("type") == "heading") & (text != "")
    family = F.when(heading & (F.upper(text) != "ABSTRACT") & ~is_subsection_heading(text), heading_family(text))
    lead = elements.where(heading).select("doc_id", "element_index", family.alias("family")).where(
        F.col("family") != "other").groupBy("doc_id").agg(F.min_by("family", "element_index").alias("lead_family"))
    level = F.when(F.upper(text) == "ABSTRACT", "section").when(is_subsection_heading(text), "subsection").when(
        heading_family(text) == F.coalesce("lead_family", F.lit("other")), "section").otherwise("subsection")
    return elements.join(lead, "doc_id", "left").withColumn("level", F.when(heading, level).otherwise(F.col("level"))).drop("lead_family")
