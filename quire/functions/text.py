"""Text normalisation as Spark Columns.

Spark's ``\\s``, ``\\w``, ``\\d`` and ``\\b`` are ASCII unless told otherwise, while the
rules are defined on Unicode text, so the character classes are spelled out here once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quire.functions.arrays import let

# Unicode white space, line breaks, word characters and digits.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
# The same sets as ranges for regex classes: fewer tests per character.
SPACE_CLASS = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BREAK_CLASS = "\n-\r\x1c-\x1e\x85\u2028\u2029"
# The intersection settles printable ASCII first, before the members of the class are tried one by one.
WS = f"[\\x00- \\x7f-\\x{{10ffff}}&&[{SPACE_CLASS}]]"
WORD = r"[\p{L}\p{N}_]"
NOT_BEFORE = r"(?<![\p{L}\p{N}_])"
NOT_AFTER = r"(?![\p{L}\p{N}_])"
DIGIT = r"\p{Nd}"


def _where(c: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` where ``test`` finds something to change: a search is much cheaper than a replacement that tries every place."""
    return let(c, lambda x: F.when(test(x), change(x)).otherwise(x))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """NULL when the text is NULL or blank, else the trimmed text."""
    return F.nullif(strip(c), F.lit(""))


def has(c: Column, *needles: str) -> Column:
    """Any of the plain substrings occurs."""
    return any_of(*[c.contains(n) for n in needles])


def starts(c: Column, *prefixes: str) -> Column:
    return any_of(*[c.startswith(p) for p in prefixes])


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and trim; a lone blank needs no replacement.

    The look-ahead settles printable ASCII with one comparison.
    """
    odd = "\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return F.trim(_where(c, lambda x: x.contains("  ") | x.rlike(f"[\t-\x1f\x7f-\u3000&&[{odd}]]"),
                         lambda x: F.regexp_replace(x, f"(?=[^!-~])(?: {WS}+|(?! )[{odd}]{WS}*)", " ")))


def count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def spaced_words(c: Column) -> Column:
    """Number of words of a text that is already squeezed."""
    return F.when(c == "", F.lit(0)).otherwise(count_char(c, " ") + 1)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[!-~[^{SPACE_CLASS}]]+"), F.lit(0))


def form_words(m: Column) -> Column:
    """Number of words of a text in comparable form, which has blanks as its only white space; ``m`` must be bound."""
    return F.when(m.contains("  "), F.size(words(m))).otherwise(spaced_words(m))


def strip_md(c: Column) -> Column:
    """Drop markdown marks, then squeeze."""
    return squeeze(F.when(has(c, "*", "_", "#", "`"), F.regexp_replace(c, "[*_#`]+", "")).otherwise(c))


def normalize_markdown(c: Column) -> Column:
    """One kind of line break, no runs of blanks, at most one empty line."""
    c = _where(F.replace(c, F.lit("\u00a0"), F.lit(" ")), lambda x: x.contains("\r"), lambda x: F.regexp_replace(x, "\r\n?", "\n"))
    c = _where(c, lambda x: has(x, "\t", "  "), lambda x: F.regexp_replace(x, "\t[ \t]*| [ \t]+", " "))
    return strip(_where(c, lambda x: x.contains("\n\n\n"), lambda x: F.regexp_replace(x, "\n{3,}", "\n\n")))


def block_array(c: Column, sep: str = "\n\n") -> Column:
    """The non-empty trimmed blocks of a markdown text, in order."""
    pieces = F.split(normalize_markdown(F.coalesce(c, F.lit(""))), sep)
    return F.filter(F.transform(pieces, strip), lambda b: b != "")


def _match_form(c: Column, dash_pattern: str) -> Column:
    # translate makes a string of every character and a pattern tries every place; both are spared where nothing is to be replaced
    def where(c: Column, needles: str | tuple[str, ...], change: Callable[[Column], Column]) -> Column:
        return let(c, lambda x: F.when(has(x, *needles), change(x)).otherwise(x))

    c = where(c, ("-\n", "-\r"), lambda x: F.regexp_replace(x, f"-(?<={WORD}-)[\n\r](?={WORD})", ""))
    c = where(squeeze(c), "*_`", lambda x: F.regexp_replace(x, "[*_`]", ""))

    def signs(c: Column) -> Column:
        for old, new in (("ﬁ", "fi"), ("ﬂ", "fl"), ("WiFi", "Wi-Fi")):
            c = F.replace(c, F.lit(old), F.lit(new))
        c = where(c, "–—", lambda x: F.regexp_replace(x, dash_pattern, "-"))
        for old, new in (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("•", "")):
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    return strip(F.lower(_where(c, lambda x: x.rlike("[\u2013-\ufb02&&[ﬁﬂ–—‘’“”•]]") | x.contains("WiFi"), signs)))


def normalize_for_match(c: Column) -> Column:
    """The form in which texts are compared; long dashes swallow the blanks around them."""
    return _match_form(F.coalesce(c, F.lit("")), f"(?=[^!-~]){WS}*[–—]{WS}*")


def normalize_box_text(c: Column) -> Column:
    """The form of page-box texts; long dashes keep the blanks around them."""
    return _match_form(F.coalesce(c, F.lit("")), "[–—]")


def strip_emphasis(c: Column) -> Column:
    c = F.regexp_replace(c, r"\*\*([^\n]*?)\*\*", "$1")
    return strip(F.regexp_replace(c, r"_([^\n]*?)_", "$1"))


def strip_bullet_marker(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"^[-•]{WS}*", ""))


def sanitize_text(c: Column) -> Column:
    """Without control characters; NULL becomes the empty text."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def sanitize_nested(c: Column, dtype: T.DataType) -> Column:
    """Sanitise arrays and structs member by member; every other value becomes text."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: sanitize_nested(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        parts = [sanitize_nested(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    return F.when(c.isNotNull(), sanitize_text(c))


def sanitize_struct(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sanitise the named columns of a frame, whatever their nesting."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({n: sanitize_nested(F.col(n), types[n]) for n in columns})


def section_key(c: Column) -> Column:
    c = F.lower(strip(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_{SPACE_CLASS}]", " ")
    return F.btrim(F.regexp_replace(c, f"{WS}+", "_"), F.lit("_"))


def section_key_ui(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def word_count(c: Column) -> Column:
    return F.size(words(normalize_for_match(c)))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of ``a`` that also occur in ``b`` (one-sided)."""
    return token_share(F.array_distinct(words(a)), F.array_distinct(words(b)))


def token_share(left: Column, right: Column) -> Column:
    """``token_overlap`` on ready-made distinct token arrays, each evaluated once."""
    return let(F.struct(left.alias("a"), right.alias("b")), lambda p: F.when(
        (F.size(p["a"]) > 0) & (F.size(p["b"]) > 0),
        F.size(F.array_intersect(p["a"], p["b"])) / F.size(p["a"]),
    ).otherwise(F.lit(0.0)))


def first_line(c: Column) -> Column:
    return strip(_where(c, lambda x: x.rlike(f"[\n-\u2029&&[{BREAK_CLASS}]]"), lambda x: F.regexp_extract(x, f"^[ -~[^{BREAK_CLASS}]]*", 0)))


def bullet_content(intro: Column, items: Column) -> Column:
    parts = F.concat(F.array(F.coalesce(intro, F.lit(""))), F.coalesce(items, F.array().cast("array<string>")))
    return F.array_join(F.filter(F.transform(parts, strip), lambda p: p != ""), "\n")
