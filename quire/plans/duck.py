"""Building blocks of the check SQL, written for DuckDB.

These texts restate the rules independently of the Spark code: DuckDB's regex engine has no
look-around and its ``\\w`` and ``\\b`` are ASCII, so word borders are written as groups.
"""

from __future__ import annotations

from quire.functions.text import BREAKS, SPACES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = f"[{SPACES}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
BEFORE = rf"(?:^|{NOT_WORD})"
AFTER = rf"(?:{NOT_WORD}|$)"


def strip(x: str) -> str:
    return f"trim({x}, {q(SPACES)})"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"


def match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def squeeze(x: str) -> str:
    return strip(sub(x, f"{WS}+", " "))


def strip_md(x: str) -> str:
    return squeeze(sub(x, "[*_#`]+", ""))


def has(x: str, *needles: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def starts(x: str, *prefixes: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in prefixes) + ")"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def count(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {q(ch)}, '')))"


def normalize_markdown(x: str) -> str:
    x = sub(f"replace({x}, chr(160), ' ')", "\r\n?", "\n")
    return strip(sub(sub(x, "[ \t]+", " "), "\n{3,}", "\n\n"))


def _match_form(x: str, dash: str) -> str:
    x = f"replace(replace({x}, chr(160), ' '), chr(13), chr(10))"
    for _ in range(2):
        x = sub(x, r"([\p{L}\p{N}_])-" + "\n" + r"([\p{L}\p{N}_])", r"\1\2")
    x = sub(squeeze(x), "[*_`]", "")
    x = f"replace(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'WiFi', 'Wi-Fi')"
    x = sub(x, dash, "-")
    x = f"replace(translate({x}, '‘’“”', '''''\"\"'), '•', '')"
    return strip(f"lower({x})")


def normalize_for_match(x: str) -> str:
    return _match_form(x, f"{WS}*[–—]{WS}*")


def normalize_box_text(x: str) -> str:
    return _match_form(x, "[–—]")


def first_line(x: str) -> str:
    return strip(f"regexp_extract({x}, {q(f'^[^{BREAKS}]*')}, 0)")


def distinct_tokens(x: str) -> str:
    return f"list_distinct({words(x)})"


def overlap(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0.0 END")


def pad(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


# Derived corpora, one text per engine; see derived.py for the Spark side.
LINES = """
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""
