"""Rules that classify one markdown block (C-1..C-20).

Each public rule takes the raw block. ``block_facts`` evaluates all of them from shared
intermediate texts so that a job computes every regex once per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from quire.functions.arrays import let
from quire.functions.text import (
    BREAK_CLASS, BREAKS, DIGIT, NOT_AFTER, SPACES, WS, all_of, any_of, count_char, first_line, has, spaced_words, starts, strip, strip_md,
)

# Headings that end the readable part of a document.
TAIL_HEADINGS = [
    "REFERENCES", "REFERENCE", "BIBLIOGRAPHY", "ACKNOWLEDGMENT", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENT",
    "ACKNOWLEDGEMENTS", "APPENDIX", "APPENDICES", "BIOGRAPHY", "BIOGRAPHIES",
]
# Words of journal running heads.
JOURNAL_WORDS = ["frontiers", "journal", "proceedings", "transactions", "review", "letters"]
# Words that open the continuation of a broken sentence.
CONNECTIVES = [
    "which", "that", "where", "when", "and", "or", "but", "while", "because", "however", "thus", "therefore",
    "then", "also", "meanwhile",
]
# Patterns for web domains, DOIs and heading numbers.
DOMAIN = r"(?iU)\b(?:[a-z0-9-]+\.)+(?:org|com|net|edu|gov|io|ai|co)\b"
DOI = r"(?U)\b10\.\p{Nd}{4,9}/[-._;()/:A-Za-z0-9]+\b"
VOLUME = rf"(?U)\bvol\.{WS}*\p{{Nd}}+"
ROMAN_HEADING = r"^([IVXLC]+\. +[A-Z][A-Z0-9 \-–—,:()']{0,120})"
NUMBERED_HEADING = r"^(\p{Nd}+(?:\.\p{Nd}+)*\.? +[A-Z][A-Za-z0-9 \-–—,:()']{0,120})"
INTRO_TITLE = r"^(?:\p{Nd}+\.? +|[ivxlcdm]+\. +)?introduction$"
TITLE_WORDS = 12


def _ends_sentence(t: Column) -> Column:
    return F.right(t, F.lit(1)).isin(".", "!", "?")


# Rules on the cleaned text t (and its lower-case form low).
def _page_number(t: Column) -> Column:
    return t.rlike(r"^\p{Nd}{1,4}$")


def _running_header(t: Column, low: Column, n_words: Column | None = None) -> Column:
    size = F.length(t)
    short = (spaced_words(t) if n_words is None else n_words) <= 12
    domain, doi, et_al = t.rlike(DOMAIN), t.rlike(DOI), has(low, "et al.")
    return any_of(
        has(low, "ieee transactions on", "authorized licensed use limited to"),
        has(low, "journal of ") & has(low, "vol."),
        has(low, "downloaded on") & has(low, "ieee xplore"),
        has(low, "vol.") & low.rlike(VOLUME),
        ((size < 160) | short) & (et_al | domain),
        ((size < 180) | short) & doi,
        (size < 180) & has(low, *JOURNAL_WORDS) & ~_ends_sentence(t),
    )


def _license(low: Column) -> Column:
    n = spaced_words(low)
    return any_of(
        has(low, "personal use is permitted", "republication/redistribution requires ieee permission",
            "rights/index.html", "see front matter", "digital object identifier", "creative commons attribution license"),
        has(low, "copyright") & (n <= 40),
        has(low, "doi") & has(low, "10.") & (n <= 25),
        has(low, "© 20") & (n <= 20),
        has(low, "published by elsevier science") & (n <= 30),
    )


def _footnote(raw: Column) -> Column:
    return raw.rlike(rf"^>{WS}*[\p{{Nd}}∗*]")


def _image_placeholder(low: Column) -> Column:
    return (has(low, "picture") & has(low, "omitted")) | has(low, "start of picture text", "end of picture text")


def _affiliation(raw: Column, low: Column) -> Column:
    size = F.length(raw)
    return any_of(
        has(low, "manuscript received", "corresponding author", "e-mail:", "email:", " is with ", "institute of ",
            "school of ", "university", "national natural science foundation", "fundamental research fund",
            "reviewed by", "edited by"),
        has(low, "supported by") & has(low, "grant"),
        has(low, "received ") & has(low, "accepted "),
        (size < 200) & has(low, "published "),
        (size < 120) & has(low, "open access"),
        (size < 150) & has(low, "citation"),
        low == "keywords",
        (size < 250) & has(raw, "@"),
    )


def _table_like(raw: Column) -> Column:
    # Six pipes decide alone, so the two-line search only ever sees four or five of them.
    pipes = count_char(raw, "|")
    inline_space = "[" + "".join(ch for ch in SPACES if ch not in BREAKS) + "]"
    line = f"[^{BREAK_CLASS}]*"
    two_lines = rf"\|{line}\|{line}[{BREAK_CLASS}](?s:.*)\|{line}\|"
    return has(raw, "|") & any_of(
        pipes >= 6,
        raw.rlike(rf"\|{inline_space}*[:-]"),
        (pipes >= 4) & (pipes < 6) & raw.rlike(two_lines),
    )


def _caption_numbered(raw: Column) -> Column:
    return raw.rlike(rf"^(?:FIGURE|TABLE){WS}+{DIGIT}+{NOT_AFTER}") | raw.rlike(
        rf"(?i)^(?:fig|fig\.|figure|table){WS}*{DIGIT}+[.:](?:{WS}|\z)"
    )


def _caption(raw: Column) -> Column:
    return _caption_numbered(raw) | raw.rlike(rf"^\([a-z]\){WS}")


def _keywords_meta(low: Column) -> Column:
    return starts(low, "keywords:", "keywords ", "index terms", "key words")


def _keywords_loose(low: Column) -> Column:
    return starts(low, "keywords", "index terms")


def _jel(t: Column) -> Column:
    return t.rlike(rf"(?i)^jel +classification{NOT_AFTER}") | t.rlike(
        r"^[A-Z] *\p{Nd}{1,3}(?: *; *[A-Z] *\p{Nd}{1,3}){1,10}$"
    )


def _title(line: Column, line_clean: Column) -> Column:
    """Section title of a block from its first line; NULL when the line is no heading.

    The words tested in upper case are short, so a prefix of the line decides.
    """
    unmarked = F.when(has(line, "*", "_", "`"), F.translate(line, "*_`", "")).otherwise(line)
    bare = F.upper(F.substring(strip(unmarked), 1, 20))
    upper = F.upper(F.substring(line_clean, 1, 20))
    abstract = f"^ABSTRACT{NOT_AFTER}"
    numbered = F.array(*[
        F.substring_index(strip(F.regexp_extract(line_clean, pattern, 1)), " ", TITLE_WORDS)
        for pattern in (ROMAN_HEADING, NUMBERED_HEADING, r"^(\p{Nd}+\.)$")
    ])
    return (
        F.when(line == "", F.lit(None).cast("string"))
        .when(bare.rlike(abstract) | upper.rlike(abstract), F.lit("ABSTRACT"))
        .when(upper.isin(TAIL_HEADINGS), upper)
        .when(F.substring(line_clean, 1, 1).rlike(r"[IVXLC\p{Nd}]"), F.get(F.filter(numbered, lambda t: t != ""), F.lit(0)))
    )


# Public rules on a raw block. A text that a rule reads more than once is bound first: the rule would be evaluated over
# a copy of its whole expression at each mention.
def _low(c: Column, rule: Callable[[Column], Column]) -> Column:
    return let(F.lower(strip_md(c)), rule)


def is_page_number(c: Column) -> Column:
    return _page_number(strip_md(c))


def is_running_header(c: Column) -> Column:
    return let(strip_md(c), lambda t: let(F.lower(t), lambda low: _running_header(t, low)))


def is_license(c: Column) -> Column:
    return _low(c, _license)


def is_footnote(c: Column) -> Column:
    return _footnote(strip(c))


def is_image_placeholder(c: Column) -> Column:
    return _low(c, _image_placeholder)


def is_affiliation(c: Column) -> Column:
    return let(strip(c), lambda raw: _low(c, lambda low: _affiliation(raw, low)))


def is_table_like(c: Column) -> Column:
    return let(strip(c), _table_like)


def is_caption(c: Column) -> Column:
    return let(strip(c), _caption)


def is_numbered_caption(c: Column) -> Column:
    """The caption rule for generated elements: sub-figure marks do not count."""
    return let(strip(c), _caption_numbered)


def is_bullet(c: Column) -> Column:
    return let(strip_md(c), lambda t: starts(t, "-", "•"))


def is_keywords_meta(c: Column) -> Column:
    return _low(c, _keywords_meta)


def is_keywords_loose(c: Column) -> Column:
    return _low(c, _keywords_loose)


def is_jel(c: Column) -> Column:
    return let(strip_md(c), _jel)


def section_title(c: Column) -> Column:
    return let(first_line(c), lambda line: let(strip_md(line), lambda clean: _title(line, clean)))


def is_md_heading(c: Column) -> Column:
    return first_line(strip(c)).startswith("## ")


def starts_lower(c: Column) -> Column:
    return c.rlike(r"^[^\p{L}]*\p{Ll}")


def is_intro_title(c: Column) -> Column:
    return F.coalesce(F.lower(let(c, strip_md)).rlike(INTRO_TITLE), F.lit(False))


def is_abstract_candidate(blocks: Column) -> Column:
    """The joined blocks read like an unlabelled abstract."""
    joined = strip(F.array_join(blocks, "\n\n"))
    return let(let(joined, strip_md), lambda clean: all_of(
        clean != "",
        ~_keywords_meta(F.lower(clean)),
        ~_jel(clean),
        spaced_words(clean) >= 60,
        count_char(clean, ".") + count_char(clean, "!") + count_char(clean, "?") >= 2,
    ))


# The removal rules in the order in which they claim a block.
REMOVAL_RULES = [
    "is_page_number", "is_running_header", "is_license", "is_footnote", "is_image_placeholder", "is_affiliation",
    "is_table_like", "is_keywords_meta", "is_jel",
]
FLAGS = REMOVAL_RULES + [
    "is_caption", "is_bullet", "is_keywords_loose", "should_remove", "is_natural_body", "is_tail_heading",
    "is_major_heading", "is_md_heading", "starts_lower", "is_intro_title",
]


class Facts:
    """Stepwise evaluation of every block rule.

    Each step is a list of (name, builder) pairs; a builder reads earlier values through
    a getter. ``classify`` runs the steps as column projections, ``fact_array`` as nested
    structs inside an array, so both share one definition and recompute nothing.
    """

    texts = [
        ("raw", lambda g: strip(g("block"))),
        ("clean", lambda g: strip_md(g("block"))),
        ("line", lambda g: F.when(has(g("block"), *BREAKS), first_line(g("block"))).otherwise(strip(g("block")))),
    ]
    derived = [
        ("low", lambda g: F.lower(g("clean"))),
        ("line_clean", lambda g: F.when(g("line") == g("raw"), g("clean")).otherwise(strip_md(g("line")))),
        ("n_words", lambda g: spaced_words(g("clean"))),
        ("is_md_heading", lambda g: g("line").startswith("## ")),
        ("starts_lower", lambda g: starts_lower(g("clean"))),
        ("is_footnote", lambda g: _footnote(g("raw"))),
        ("is_table_like", lambda g: _table_like(g("raw"))),
        ("is_caption", lambda g: _caption(g("raw"))),
        ("is_bullet", lambda g: starts(g("clean"), "-", "•")),
        ("is_page_number", lambda g: _page_number(g("clean"))),
        ("is_jel", lambda g: _jel(g("clean"))),
    ]
    titles = [("section_title", lambda g: _title(g("line"), g("line_clean")))]
    flags = [
        ("is_running_header", lambda g: _running_header(g("clean"), g("low"), g("n_words"))),
        ("is_license", lambda g: _license(g("low"))),
        ("is_image_placeholder", lambda g: _image_placeholder(g("low"))),
        ("is_affiliation", lambda g: _affiliation(g("raw"), g("low"))),
        ("is_keywords_meta", lambda g: _keywords_meta(g("low"))),
        ("is_keywords_loose", lambda g: _keywords_loose(g("low"))),
        ("is_tail_heading", lambda g: F.coalesce(g("section_title").isin(TAIL_HEADINGS), F.lit(False))),
        ("is_major_heading", lambda g: F.coalesce(~g("section_title").isin(TAIL_HEADINGS), F.lit(False))),
        ("is_intro_title", lambda g: is_intro_title(g("section_title"))),
    ]
    verdict = [
        ("removed_by", lambda g: F.coalesce(*[F.when(g(r), F.lit(r)) for r in REMOVAL_RULES])),
    ]
    outcome = [
        ("should_remove", lambda g: g("removed_by").isNotNull()),
        ("is_natural_body", lambda g: all_of(
            g("removed_by").isNull(), ~g("is_caption"), ~g("is_bullet"), ~g("is_keywords_loose"),
            g("n_words") >= 35, g("clean").rlike("[.!?]"),
        )),
        ("is_body_start", lambda g: _body_start(g)),
        ("joins_next", lambda g: all_of(
            g("clean") != "", ~g("is_md_heading"), ~g("is_major_heading"), ~g("clean").rlike("[.!?:;]$"),
        )),
        ("joins_prev", lambda g: all_of(
            g("clean") != "", ~g("is_md_heading"), ~g("is_major_heading"), ~g("is_bullet"), ~g("is_caption"),
            g("removed_by").isNull(), opens_continuation(g("clean")),
        )),
        ("is_bare_number", lambda g: g("clean").rlike(r"^\p{Nd}+(?:\.\p{Nd}+)*$") & ~g("raw").rlike(f"[{BREAK_CLASS}]")),
        ("opens_capital", lambda g: g("line_clean").rlike("^[A-Z]")),
    ]
    steps = [texts, derived, titles, flags, verdict, outcome]


def _body_start(g) -> Column:
    natural = all_of(
        ~g("is_caption"), ~g("is_bullet"), ~g("is_keywords_loose"), g("n_words") >= 35, g("clean").rlike("[.!?]"),
    )
    opens = g("is_major_heading") | F.substring(g("low"), 1, 80).contains("abstract")
    is_abstract = F.coalesce(g("section_title") == "ABSTRACT", F.lit(False))
    return all_of(g("removed_by").isNull(), ~g("is_caption"), is_abstract | (~natural & opens))


def opens_continuation(clean: Column) -> Column:
    """The cleaned block reads like the rest of a broken sentence."""
    return any_of(
        starts_lower(clean),
        F.lower(F.substring_index(clean, " ", 1)).isin(CONNECTIVES),
        clean.rlike(r"^[(\[{_\-–—=≤≥+\p{Nd}.]"),
    )


def should_merge(prev: Column, cur: Column) -> Column:
    """Whether ``cur`` continues ``prev``; a pairwise rule on raw blocks."""
    title_p, title_c = section_title(prev), section_title(cur)
    return let(strip_md(prev), lambda p: let(strip_md(cur), lambda c: all_of(
        p != "", c != "", ~is_md_heading(prev), ~is_md_heading(cur), ~p.rlike("[.!?:;]$"), opens_continuation(c),
        F.coalesce(title_p.isin(TAIL_HEADINGS), F.lit(True)), F.coalesce(title_c.isin(TAIL_HEADINGS), F.lit(True)),
        ~starts(c, "-", "•"), ~is_caption(cur), ~_removed(strip(cur), c),
    )))


def should_remove(c: Column) -> Column:
    return let(strip_md(c), lambda t: _removed(strip(c), t))


def _removed(raw: Column, t: Column) -> Column:
    return let(raw, lambda r: let(F.lower(t), lambda low: any_of(
        _page_number(t), _running_header(t, low), _license(low), _footnote(r), _image_placeholder(low),
        _affiliation(r, low), _table_like(r), _keywords_meta(low), _jel(t),
    )))


def classify_blocks(df, block: str = "block"):
    """Add every block flag to a long block table; a narrow job without a shuffle."""
    out = df.withColumn("block", F.col(block)) if block != "block" else df
    for step in Facts.steps:
        out = out.select("*", *[build(F.col).alias(name) for name, build in step])
    return out


# Intermediate texts; dropped from fact arrays so that rows carry each block's text once.
SCRATCH = {"raw", "clean", "line", "low", "line_clean"}


def fact_array(blocks: Column) -> Column:
    """The same facts for an array of blocks, as an array of structs."""
    facts = F.transform(blocks, lambda b, i: F.struct(i.alias("block_index"), b.alias("block")))
    names = ["block_index", "block"]
    for step in Facts.steps:
        final = step is Facts.steps[-1]
        keep, add = [n for n in names if not (final and n in SCRATCH)], list(step)
        facts = F.transform(facts, lambda x: F.struct(
            *[x[n].alias(n) for n in keep], *[build(lambda n: x[n]).alias(name) for name, build in add]))
        names += [name for name, _ in add]
    return facts
