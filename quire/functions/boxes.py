"""Rules on page boxes and match scores (C-30..C-33, A-2, A-5..A-9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from quire.functions.arrays import let
from quire.functions.text import (
    WS, any_of, count_char, form_words, has, normalize_for_match, spaced_words, starts, strip, token_overlap,
)

# Phrases of author and funding notes.
METADATA_PHRASES = [
    "supported in part by", "is with ", "are with ", "univ.", "university", "bell labs", "program.", "supported by grant",
    "nsf grant", "funded by grant", "under grant", "ramon y", "ram´on y", "ramon y cajal", "ram´on y cajal",
]
# Back-matter headings.
BACK_MATTER = ["references", "appendix", "acknowledgment", "acknowledgements"]
# Nothing but one of these words, whatever other signs stand around or inside it.
BACK_MATTER_LINE = "^[^a-z0-9]*+(?:" + "|".join("[^a-z0-9 ]*+".join(word) for word in BACK_MATTER) + r")[^a-z0-9]*+\z"
ROMAN_PREFIX = r"^(i|ii|iii|iv|v|vi|vii|viii|ix|x)\."


def roman_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(normalize_for_match(c), ROMAN_PREFIX, 1), F.lit(""))


def heading_box(text: Column, norm: Column, n_words: Column) -> Column:
    """C-31 on a box text whose comparable form and word count are at hand."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    shouted = (n_words <= 10) & (letters > 0) & (capitals / F.greatest(letters, F.lit(1)) > 0.8)
    return (norm != "") & (norm.rlike(ROMAN_PREFIX) | shouted)


def metadata_box(text: Column, norm: Column, n_words: Column) -> Column:
    """C-33 on a box text whose comparable form and word count are at hand."""
    return any_of(
        norm == "", has(norm, "arxiv:", "intentionally omitted", *METADATA_PHRASES),
        (n_words <= 20) & (count_char(text, ",") >= 3) & has(norm, " and "),
        (n_words <= 20) & norm.rlike(rf"^(?:-{WS}+)?(?:fig\.?|figure|table){WS}*\p{{Nd}}"),
        (n_words <= 8) & norm.rlike(rf"^\(?[a-z0-9]\){WS}"),
        norm.rlike(r"^\p{Nd}{1,4}$"),
        norm.rlike(BACK_MATTER_LINE),
    )


def _counted(c: Column, rule: Callable[[Column, Column, Column], Column]) -> Column:
    """A box rule on a text whose comparable form and words are made once."""
    return let(c, lambda text: let(normalize_for_match(text), lambda norm: let(form_words(norm), lambda n: rule(text, norm, n))))


def is_heading_box(c: Column) -> Column:
    return _counted(c, heading_box)


def is_bullet_box(c: Column) -> Column:
    return starts(strip(c), "- ", "•")


def is_metadata_box(c: Column) -> Column:
    return _counted(c, metadata_box)


def page_column(x0: Column, x1: Column) -> Column:
    centre = (x0 + x1) / 2
    return F.when(centre < 250, "left").when(centre > 300, "right").otherwise("center")


def text_match_score(target: Column, candidate: Column) -> Column:
    """A-5 on normalised texts; the first rule that fits decides. The scores and lengths."""
    prefix, suffix = F.substring(target, 1, 180), F.right(target, F.lit(180))
    long_enough = F.length(target) > 40
    return (
        F.when((target == "") | (candidate == ""), 0.0).when(target == candidate, 1.0)
        .when(F.contains(candidate, target), 0.97)
        .when((F.length(candidate) > 60) & F.contains(target, candidate), 0.85)
        .when(long_enough & F.contains(candidate, prefix), 0.92)
        .when(long_enough & F.contains(candidate, suffix), 0.88)
        .otherwise(token_overlap(target, candidate) * 0.72)
    )


def ratio_size_score(candidate_words: Column, target_words: Column, n_boxes: Column) -> Column:
    """A-6. The ranges of the ratio and the cost of a box."""
    ratio = candidate_words / F.greatest(target_words, F.lit(1))
    fit = F.when(ratio.between(0.7, 1.6), 1.0).when(ratio.between(0.5, 2.2), 0.5).otherwise(0.0)
    return fit - F.least(n_boxes, F.lit(8)) * 0.08


def confidence(collected_words: Column, target_words: Column) -> Column:
    """A-7. The ranges of the ratio."""
    ratio = collected_words / F.greatest(target_words, F.lit(1))
    return F.when(target_words <= 0, "low").when(ratio.between(0.7, 2.0), "high").when(ratio.between(0.4, 3.0), "medium").otherwise("low")


CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


# Words of the head and the tail of a text of n words.
def head_length(n: Column) -> Column:
    return F.when(n >= 100, 40).when(n >= 60, 25).when(n >= 30, 15).otherwise(F.greatest(F.lit(8), n))


def tail_length(n: Column) -> Column:
    return F.when(n >= 100, 40).when(n >= 60, 25).when(n >= 30, 15).otherwise(0)


#: Places of a text that are looked at together.
STRETCH = 128


def occurrences(text: Column, pattern: Column) -> Column:
    """A-9: 0-based positions of all, also overlapping, occurrences.

    A substring is sought from the start of its text, so the text is cut into stretches first and places are compared only inside those with an occurrence.
    """
    def places(t: Column, p: Column, size: Column) -> Column:
        def inside(w: Column, start: Column) -> Column:
            hits = F.filter(F.sequence(F.lit(0), F.length(w) - size), lambda i: F.substring(w, i + 1, size) == p)
            return F.when(F.contains(w, p), F.transform(hits, lambda i: start + i)).otherwise(F.array().cast("array<int>"))

        last = F.length(t) - size
        starts = F.when((size > 0) & (last >= 0), F.sequence(F.lit(0), last, F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda s: let(F.substring(t, s + 1, size + (STRETCH - 1)), lambda w: inside(w, s))))

    return let(text, lambda t: let(pattern, lambda p: let(F.length(p), lambda size: places(t, p, size))))


def rounded_key(bbox: Column) -> Column:
    """Identity of a rectangle: coordinates at three decimals."""
    return F.transform(bbox, lambda v: F.round(v, 3))


def dedupe_rects(rects: Column) -> Column:
    """A-19: rectangles with equal rounded coordinates collapse onto the first."""
    keyed = F.transform(rects, lambda r, i: F.struct(F.to_json(rounded_key(r)).alias("key"), i.alias("i"), r.alias("rect")))
    return _first_of_each(keyed, "rect")


def dedupe_locations(boxes: Column) -> Column:
    """A-20: (page, bbox) pairs without repeats, in order."""
    sound = F.filter(boxes, lambda b: b["page"].isNotNull() & b["bbox"].isNotNull())
    keyed = F.transform(sound, lambda b, i: F.struct(
        F.concat(b["page"].cast("string"), F.to_json(rounded_key(b["bbox"]))).alias("key"), i.alias("i"),
        F.struct(b["page"].alias("page"), b["bbox"].alias("bbox")).alias("rect")))
    return _first_of_each(keyed, "rect")


def _first_of_each(keyed: Column, field: str) -> Column:
    seen = F.transform(keyed, lambda x: x["key"])
    fresh = F.filter(keyed, lambda x: F.array_position(seen, x["key"]) == x["i"] + 1)
    return F.transform(fresh, lambda x: x[field])


def primary_page(locations: Column) -> Column:
    """A-21: the most frequent page, the lowest one on ties."""
    pages = F.transform(locations, lambda x: x["page"])
    counted = F.transform(F.array_distinct(pages), lambda p: F.struct(F.size(F.filter(pages, lambda o: o == p)).alias("n"), (-p).alias("rev")))
    return -F.array_max(counted)["rev"]
