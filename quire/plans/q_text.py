"""Queries for the text normalisation columns (T-1..T-15)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions import text as X
from quire.operators.segment import split_blocks
from quire.plans import duck as D
from quire.plans.derived import PAPER_DOCS, paper_docs

BLOCKS = "WITH " + PAPER_DOCS + f""",
block_lists AS (SELECT doc_id, list_filter(list_transform(string_split({D.normalize_markdown('markdown')}, chr(10) || chr(10)),
                lambda b: {D.strip('b')}), lambda b: b <> '') AS bs FROM paper_docs),
blocks AS (SELECT doc_id, generate_subscripts(bs, 1) - 1 AS block_index, unnest(bs) AS block FROM block_lists)"""


def blocks(spark, folder):
    return split_blocks(paper_docs(spark, folder))


def _per_block(build, name="value"):
    return lambda spark, folder: blocks(spark, folder).select("doc_id", "block_index", build(F.col("block")).alias(name))


def _sql(expression: str, name: str = "value") -> str:
    return f"{BLOCKS} SELECT doc_id, block_index, {expression} AS {name} FROM blocks"


CTRL = "\x01"


def _sanitized(spark, folder):
    rows = blocks(spark, folder).select("doc_id", "block_index", F.struct(
        F.array(F.concat(F.lit(CTRL), F.col("block")), F.lit("b" + CTRL)).alias("parts"), F.col("block_index").alias("n")).alias("s"))
    return X.sanitize_struct(rows, ["s"]).select("doc_id", "block_index", F.array_join("s.parts", "/").alias("parts"), F.col("s.n").alias("n"))


def _items(c: Column) -> Column:
    return F.split(c, " ")


QUERIES = {
    "split_blocks": lambda spark, folder: blocks(spark, folder),
    "strip_md": _per_block(X.strip_md),
    "normalize_markdown": lambda spark, folder: paper_docs(spark, folder).select("doc_id", X.normalize_markdown(F.col("markdown")).alias("value")),
    "normalize_for_match": _per_block(X.normalize_for_match),
    "normalize_box_text": _per_block(X.normalize_box_text),
    "strip_emphasis": _per_block(X.strip_emphasis),
    "strip_bullet_marker": _per_block(X.strip_bullet_marker),
    "sanitize_text": _per_block(lambda c: X.sanitize_text(F.concat(F.lit("a" + CTRL), c))),
    "sanitize_struct": _sanitized,
    "section_key": _per_block(X.section_key),
    "section_key_ui": _per_block(X.section_key_ui),
    "word_count": _per_block(X.word_count),
    "token_overlap": _per_block(lambda c: F.round(X.token_overlap(X.first_line(c), c), 6)),
    "first_line": _per_block(X.first_line),
    "bullet_content": _per_block(lambda c: X.bullet_content(F.substring(c, 1, 5), _items(c))),
}

_A, _B = D.distinct_tokens(D.first_line("block")), D.distinct_tokens("block")
ORACLES = {
    "split_blocks": f"{BLOCKS} SELECT doc_id, block_index, block FROM blocks",
    "strip_md": _sql(D.strip_md("block")),
    "normalize_markdown": f"WITH {PAPER_DOCS} SELECT doc_id, {D.normalize_markdown('markdown')} AS value FROM paper_docs",
    "normalize_for_match": _sql(D.normalize_for_match("block")),
    "normalize_box_text": _sql(D.normalize_box_text("block")),
    "strip_emphasis": _sql(D.strip(D.sub(D.sub("block", r"\*\*(.*?)\*\*", r"\1"), "_(.*?)_", r"\1"))),
    "strip_bullet_marker": _sql(D.strip(f"regexp_replace(block, {D.q('^[-•]' + D.WS + '*')}, '')")),
    "sanitize_text": _sql(D.sub("'a' || chr(1) || block", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")),
    "sanitize_struct": f"{BLOCKS} SELECT doc_id, block_index, {D.sub('block', '[\x01-\x08\x0B\x0C\x0E-\x1F]', '')} || '/b' AS parts, "
                       "block_index::VARCHAR AS n FROM blocks",
    "section_key": _sql(f"trim({D.sub(D.sub(f'lower({D.strip("block")})', rf'[^\p{{L}}\p{{N}}_{D.SPACES}]', ' '), D.WS + '+', '_')}, '_')"),
    "section_key_ui": _sql(f"lower({D.strip('block')})"),
    "word_count": _sql(D.n_words(D.normalize_for_match("block"))),
    "token_overlap": _sql(f"round({D.overlap(_A, _B)}, 6)"),
    "first_line": _sql(D.first_line("block")),
    "bullet_content": _sql(f"array_to_string(list_filter(list_transform(list_concat([substr(block, 1, 5)], string_split(block, ' ')), "
                           f"lambda p: {D.strip('p')}), lambda p: p <> ''), chr(10))"),
}
