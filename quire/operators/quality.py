"""Page and document quality reports (V-9..V-11).

All three are plain associative aggregations: Spark combines them before the shuffle, so a
document or page with very many paragraphs adds one partial row per task, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import quality as R
from quire.functions.text import strip

PAGE = ["doc_id", "page_number"]
COUNTS = {
    "heading_like_count": R.v_heading_like, "caption_like_count": R.v_caption_like,
    "metadata_like_count": lambda c: R.is_metadata_like(c), "too_short_count": R.too_short,
    "too_long_count": lambda c: F.length(strip(c)) > 2500, "hyphenation_artifact_count": R.has_hyphenation,
    "heading_body_merged_count": R.heading_body_merged, "reference_heading_count": R.is_reference_heading,
    "biography_heading_count": R.is_biography_heading,
}
STATS = ["count", "avg_length", "min_length", "max_length", *COUNTS]
# Risk weights of page warnings; any other warning weighs 6.
WEIGHTS = {
    "no_paragraphs": 45, "only_one_paragraph": 25, "average_paragraph_too_long": 20, "contains_very_long_paragraphs": 20,
    "too_many_short_paragraphs": 15, "too_many_caption_like_paragraphs": 18, "contains_metadata_like_text": 20,
    "contains_hyphenation_artifacts": 25, "contains_heading_body_merged_paragraphs": 18, "contains_references_section": 15,
    "contains_biographies_section": 15, "complex_layout_page": 20, "many_blocks_page": 10, "many_short_blocks": 10,
    "many_blocks": 10, "no_text_blocks": 30,
}
OTHER_WEIGHT = 6
COMPOUND = [
    "contains_metadata_like_text", "contains_hyphenation_artifacts", "contains_heading_body_merged_paragraphs",
    "too_many_caption_like_paragraphs", "contains_references_section", "contains_biographies_section",
]


def paragraph_stats(paragraphs: DataFrame, text: str = "paragraph") -> DataFrame:
    """V-9: length statistics and rule counts per page."""
    c = F.col(text)
    flags = paragraphs.select(*PAGE, F.length(strip(c)).alias("_size"), *[rule(c).alias(n) for n, rule in COUNTS.items()])
    return flags.groupBy(*PAGE).agg(
        F.count("*").alias("count"), F.round(F.avg("_size"), 2).alias("avg_length"), F.min("_size").alias("min_length"),
        F.max("_size").alias("max_length"), *[F.count_if(n).alias(n) for n in COUNTS])


def page_warnings() -> Column:
    """The ordered warnings of a page from its statistics and features."""
    count = F.col("count")
    checks = [
        ("no_paragraphs", count == 0), ("only_one_paragraph", count == 1),
        ("average_paragraph_too_long", F.col("avg_length") > 1800), ("contains_very_long_paragraphs", F.col("too_long_count") >= 1),
        ("too_many_short_paragraphs", F.col("too_short_count") >= F.greatest(F.lit(3), F.floor(count / 3))),
        ("too_many_caption_like_paragraphs", F.col("caption_like_count") >= F.greatest(F.lit(2), F.floor(count / 4))),
        ("contains_metadata_like_text", F.col("metadata_like_count") >= 1),
        ("contains_hyphenation_artifacts", F.col("hyphenation_artifact_count") >= 1),
        ("contains_heading_body_merged_paragraphs", F.col("heading_body_merged_count") >= 1),
        ("contains_references_section", F.col("reference_heading_count") >= 1),
        ("contains_biographies_section", F.col("biography_heading_count") >= 1),
        ("complex_layout_page", F.col("layout_type") == "complex"),
        ("many_blocks_page", (F.col("strategy") == "blocks") & (F.coalesce("block_count", F.lit(0)) > 25)),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks]), lambda w: w.isNotNull())
    return F.concat(F.coalesce("parser_warnings", F.array().cast("array<string>")), found)


def validate_pages(pages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """V-10: one report per page; pages without paragraphs count as empty."""
    joined = pages.join(paragraph_stats(paragraphs), PAGE, "left").fillna(0, STATS)
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    warned = joined.withColumn("warnings", page_warnings())
    base = F.aggregate("warnings", F.lit(0), lambda total, w: total + F.coalesce(F.try_element_at(weights, w), F.lit(OTHER_WEIGHT)))
    compound = F.size(F.array_intersect(F.array(*[F.lit(w) for w in COMPOUND]), F.col("warnings")))
    extra = F.when(compound >= 3, 20).when(compound >= 2, 10).otherwise(0)
    scored = warned.withColumn("risk_score", F.least(F.lit(100), base + extra))
    return scored.withColumn("confidence", F.round(1 - F.col("risk_score") / 100, 2)).withColumn(
        "risk_level", F.when(F.col("risk_score") >= 60, "high").when(F.col("risk_score") >= 30, "medium").otherwise("low"))


def validate_documents(page_reports: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """V-11: mean confidence, risky pages and the review flag per document.

    With ``documents`` given, documents without any page are reported too.
    """
    def pages(level: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("risk_level") == level, F.col("page_number"))))

    # Confidences are whole hundredths, so the mean is taken on integers and rounds exactly.
    hundredths, n = F.sum(F.round(F.col("confidence") * 100).cast("long")), F.count("*")
    report = page_reports.groupBy("doc_id").agg(
        (F.floor((2 * hundredths + n) / (2 * n)) / 100).alias("overall_confidence"), pages("high").alias("high_risk_pages"),
        pages("medium").alias("medium_risk_pages"), F.count("*").alias("_pages"))
    if documents is not None:
        none = F.array().cast("array<int>")
        report = documents.select("doc_id").join(report, "doc_id", "left").fillna(0, ["_pages", "overall_confidence"]).withColumns(
            {c: F.coalesce(c, none) for c in ("high_risk_pages", "medium_risk_pages")})
    high, medium = F.size("high_risk_pages"), F.size("medium_risk_pages")
    notes = F.filter(F.array(
        F.when(F.col("_pages") == 0, "no_pages"), F.when(high > 0, "contains_high_risk_pages"),
        F.when((F.col("_pages") > 0) & (medium >= F.greatest(F.lit(2), F.floor(F.col("_pages") / 3))), "many_medium_risk_pages")),
        lambda w: w.isNotNull())
    return report.withColumn("summary_warnings", notes).withColumn(
        "needs_manual_review", (high > 0) | (F.col("overall_confidence") < 0.85)).drop("_pages")
