"""Rules on generated elements and headings (C-21..C-28) and text fallbacks (L-6, L-7)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions.blocks import is_numbered_caption
from quire.functions.text import SPACE_CLASS, WS, all_of, any_of, has, normalize_markdown, strip, words

ALPHA_SUBSECTION = rf"^(?:[A-Z]\.|\([a-zA-Z]\)){WS}+[^{SPACE_CLASS}]"
DECIMAL_SUBSECTION = rf"^\p{{Nd}}+\.\p{{Nd}}+(?:\.\p{{Nd}}+)*{WS}+[^{SPACE_CLASS}]"
ROMAN = rf"^[IVXLCM]+\.{WS}+[^{SPACE_CLASS}]"
INTEGER = rf"^\p{{Nd}}+\.{WS}+[^{SPACE_CLASS}]"


def is_caption_llm(c: Column) -> Column:
    return is_numbered_caption(c)


def is_header_llm(c: Column) -> Column:
    low = F.lower(c)
    return has(low, "ieee transactions on", "authorized licensed use limited to") | (
        has(low, "downloaded on") & has(low, "ieee xplore"))


def is_formula_noise(c: Column) -> Column:
    t = strip(c)
    symbols = F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{N}}{SPACE_CLASS}]", ""))
    return (F.length(t) < 20) | (symbols / F.length(t) > 0.45)


def is_good_text(c: Column) -> Column:
    return all_of(strip(c) != "", ~is_caption_llm(c), ~is_header_llm(c), ~is_formula_noise(c))


def is_decimal_subsection(c: Column) -> Column:
    return strip(c).rlike(DECIMAL_SUBSECTION)


def is_alpha_subsection(c: Column) -> Column:
    return strip(c).rlike(ALPHA_SUBSECTION)


def is_subsection_heading(c: Column) -> Column:
    return is_alpha_subsection(c) | is_decimal_subsection(c)


def is_inline_label(c: Column) -> Column:
    t = strip(c)
    return t.endswith(":") | (F.length(t) > 120)


def is_fake_heading(c: Column) -> Column:
    return (strip(c) == "") | is_inline_label(c)


def _short_upper(t: Column) -> Column:
    return (F.size(words(t)).between(1, 8)) & (t == F.upper(t))


def is_main_heading(c: Column) -> Column:
    t = strip(c)
    return (
        F.when(t == "", False).when(F.upper(t) == "ABSTRACT", True)
        .when(is_subsection_heading(t) | is_inline_label(t), False)
        .otherwise(any_of(t.rlike(ROMAN), t.rlike(INTEGER), _short_upper(t)))
    )


def heading_family(c: Column) -> Column:
    t = strip(c)
    return (
        F.when(F.upper(t) == "ABSTRACT", "abstract").when(t.rlike(ROMAN), "roman").when(t.rlike(INTEGER), "integer")
        .when(_short_upper(t), "all_caps").otherwise("other")
    )


def fallback_summary(c: Column) -> Column:
    """L-6: the first sentence, at most 180 characters."""
    return F.substring(strip(F.get(F.split(c, rf"(?<=[.!?]){WS}+", 2), F.lit(0))), 1, 180)


def fallback_key_points(c: Column) -> Column:
    """L-7: the text itself when short, else its first two 120-character pieces."""
    t = strip(c)
    pieces = F.array(strip(F.substring(t, 1, 120)), strip(F.substring(t, 121, 120)))
    return F.when(F.length(t) <= 120, F.array(t)).otherwise(
        F.concat(F.slice(pieces, 1, 1), F.filter(F.slice(pieces, 2, 1), lambda p: p != "")))


def good_paragraphs(c: Column) -> Column:
    """L-5: the readable paragraphs of a chunk text."""
    parts = F.transform(F.split(normalize_markdown(F.coalesce(c, F.lit(""))), "\n\n"), strip)
    return F.filter(parts, is_good_text)
