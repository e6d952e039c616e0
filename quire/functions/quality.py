"""Rules that judge extracted paragraphs (V-1..V-8)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions.text import SPACE_CLASS, WS, any_of, has, strip, words

# Words that mark publication metadata.
PLATFORM_WORDS = [
    "arxiv", "openreview", "ieee", "acm", "springer", "elsevier", "neurips", "iclr", "icml", "cvpr", "aaai", "ijcai",
    "acl", "proceedings", "journal", "doi",
]
STATUS_WORDS = ["preprint", "submitted", "accepted", "under review", "to appear", "camera-ready", "published", "copyright"]
# Patterns of identifiers and dates.
ARXIV_ID = rf"arxiv:[^{SPACE_CLASS}]"
BRACKET_TAG = r"\[[A-Za-z0-9.\-]+\]"
DOI = r"(?U)\b10\.\p{Nd}{4,9}/[-._;()/:A-Za-z0-9]+\b"
FULL_DATE = rf"(?U)\b\p{{Nd}}{{1,2}}{WS}+[A-Z][a-z]{{2,8}}{WS}+\p{{Nd}}{{4}}\b"
MONTH_YEAR = rf"(?U)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*{WS}+\p{{Nd}}{{4}}\b"
YEAR = r"(?U)\b20\p{Nd}{2}\b"
CAPTION_STARTS = [
    rf"^(?:fig\.?|figure|table){WS}*\p{{Nd}}", rf"^(?:fig\.?|figure|table){WS}*[:\-]", rf"^\([a-z]\){WS}",
]
METADATA_LIMIT = 4


def ends_sentence(t: Column) -> Column:
    return F.right(t, F.lit(1)).isin(".", "!", "?")


def v_heading_like(c: Column) -> Column:
    t = strip(c)
    upper_short = (F.size(words(t)) <= 10) & (F.upper(t) == t) & (F.length(t) < 120)
    return (t != "") & (t.rlike(rf"^[IVXLC]+\.{WS}+[A-Z]") | upper_short)


def v_caption_like(c: Column) -> Column:
    low = F.lower(strip(c))
    return any_of(*[low.rlike(p) for p in CAPTION_STARTS])


def metadata_score(c: Column, y0: Column | None = None, y1: Column | None = None, height: Column | None = None) -> Column:
    t = strip(c)
    low = F.lower(t)
    size = F.length(t)

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    score = (
        points(has(low, *PLATFORM_WORDS), 2) + points(has(low, *STATUS_WORDS), 2) + points(low.rlike(ARXIV_ID), 3)
        + points(t.rlike(BRACKET_TAG), 1) + points(t.rlike(DOI), 2) + points(t.rlike(FULL_DATE), 1)
        + points(low.rlike(MONTH_YEAR), 1) + points(t.rlike(YEAR), 1) + points(size < 100, 1) + points(size < 50, 1)
        + points(~ends_sentence(t) & (size < 120), 1)
    )
    if y0 is not None:
        score = score + points(y0 < height * 0.08, 2)
    if y1 is not None:
        score = score + points(y1 > height * 0.92, 2)
    return F.when(t == "", 0).otherwise(score)


# Headings of back matter, and patterns of damaged paragraphs.
REFERENCE_HEADING = "REFERENCES"
BIOGRAPHY_HEADINGS = ["BIOGRAPHIES", "BIOGRAPHY"]
HYPHEN_AT_END = r"[A-Za-z]{3}-\z"
HYPHEN_INSIDE = rf"[A-Za-z]{{3}}-{WS}+[a-z]{{2}}"
HEADING_THEN_BODY = rf"^[IVXLC]+\.{WS}+[A-Z][A-Z\-&,{SPACE_CLASS}]{{4,}}{WS}+[A-Z][a-z]"
FRAGMENTED = rf"(?U)\b[a-zA-Z]{{1,2}}{WS}+[a-zA-Z]{{1,2}}{WS}+[a-zA-Z]{{1,2}}\b"


def is_metadata_like(c: Column, y0: Column | None = None, y1: Column | None = None, height: Column | None = None) -> Column:
    return metadata_score(c, y0, y1, height) >= METADATA_LIMIT


def is_reference_heading(c: Column) -> Column:
    return F.upper(strip(c)) == REFERENCE_HEADING


def is_biography_heading(c: Column) -> Column:
    return F.upper(strip(c)).isin(*BIOGRAPHY_HEADINGS)


def has_hyphenation(c: Column) -> Column:
    t = strip(c)
    return t.rlike(HYPHEN_AT_END) | t.rlike(HYPHEN_INSIDE)


def heading_body_merged(c: Column) -> Column:
    return strip(c).rlike(HEADING_THEN_BODY)


def too_short(c: Column) -> Column:
    return (F.length(strip(c)) < 20) & ~v_heading_like(c)


def paragraph_warnings(c: Column, y0: Column | None = None, y1: Column | None = None, height: Column | None = None) -> Column:
    t = strip(c)
    size = F.length(t)
    # The warning names and length limits, in this order.
    checks = [
        ("too_short", too_short(t)), ("too_long", size > 2500), ("caption_like", v_caption_like(t)),
        ("metadata_like", is_metadata_like(t, y0, y1, height)), ("hyphenation_artifact", has_hyphenation(t)),
        ("heading_body_merged", heading_body_merged(t)), ("no_sentence_ending", (size > 300) & ~ends_sentence(t)),
        ("fragmented_tokens_possible", t.rlike(FRAGMENTED)),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks]), lambda w: w.isNotNull())
    return F.when(t == "", F.array(F.lit("empty_paragraph"))).otherwise(found)
