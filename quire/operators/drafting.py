"""Generated-text stage (L-1..L-9): prompts out, answers in, native fallbacks.

The model is a caller-supplied batch function. Every step works on one chunk row, so the
stage has no shuffle; only ``attach_responses`` joins, on the unique (doc_id, chunk_index).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.arrays import inline_rows, let
from quire.functions.elements import fallback_key_points, fallback_summary, good_paragraphs, is_good_text
from quire.functions.jsontext import extract_json, item_texts, member_list, member_text
from quire.functions.text import filled, normalize_markdown, strip, strip_bullet_marker, strip_emphasis

BatchFn = Callable[[list[str]], list[tuple[str, int, int]]]

INSTRUCTION = (
    "Rewrite the passage below as clean reading elements. Answer with one JSON object holding the list \"elements\"; "
    "each entry has \"type\" (paragraph or bullet_list), its text (\"text\", or \"intro_text\" and \"items\"), one "
    "\"summary\" sentence and two to four \"key_points\". Stay with the wording of the passage and add nothing."
)
FIELDS_INSTRUCTION = (
    "Summarise the passage below. Answer with one JSON object holding \"summary\" (one sentence) and \"key_points\" "
    "(two to four short points), using nothing but the passage."
)
ELEMENT_FIELDS = "idx_in_chunk:int,type:string,text:string,intro_text:string,items:array<string>,summary:string,key_points:array<string>"
MAX_KEY_POINTS = 4


def chunk_prompts(chunks: DataFrame) -> DataFrame:
    """L-1: one prompt per non-empty chunk."""
    text = normalize_markdown(F.coalesce(F.col("text"), F.lit("")))
    return chunks.withColumn("_text", text).where(F.col("_text") != "").select(
        "doc_id", "chunk_index", "section_title",
        F.concat(F.lit(f"{INSTRUCTION}\n\nSection: "), F.coalesce("section_title", F.lit("")), F.lit("\n\nPassage:\n"), F.col("_text")).alias("prompt"))


def infer(prompts: DataFrame, fn: BatchFn, *, attempts: int = 3, pause: float = 1.0, batch: int = 16) -> DataFrame:
    """L-2: call ``fn`` on batches of prompts; failures become an empty answer with an error text.

    Every prompt has ``attempts`` calls at most, besides one for its batch where that is all there are. A failed batch is the first call of each of its
    prompts; the others are made prompt by prompt with a growing pause, so one bad prompt costs no other its answer. Prompts with an
    answer are not asked again.
    """
    keys = [c for c in prompts.columns if c != "prompt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields if f.name != "prompt")

    def call(texts: list[str], used: int = 0) -> list[tuple[str, int, int, str | None]]:
        try:
            answers = fn(texts)
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers for {len(texts)} prompts")
            return [(content or "", int(used_in), int(used_out), None) for content, used_in, used_out in answers]
        except Exception as error:  # the caller's function may raise anything
            if used + 1 >= attempts and len(texts) == 1:
                return [("", 0, 0, f"{type(error).__name__}: {error}")] * len(texts)
        time.sleep(pause * (used + 1))
        return [call([text], min(used + 1, attempts - 1))[0] for text in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                rows = call(part["prompt"].tolist())
                yield part[keys].assign(
                    content=[r[0] for r in rows], tokens_in=[r[1] for r in rows],
                    tokens_out=[r[2] for r in rows], error=[r[3] for r in rows])

    return prompts.mapInPandas(run, f"{schema}, content string, tokens_in long, tokens_out long, error string")


def _clean(c: Column) -> Column:
    return normalize_markdown(strip(c))


def _answer_elements(content: Column) -> Column:
    """L-4 on one answer: the usable elements with their place in the answer's list."""
    def read(e: Column, i: Column) -> Column:
        is_object = F.schema_of_variant(e).startswith("OBJECT")
        items = F.filter(F.transform(item_texts(member_list(e, "items")), lambda x: strip_bullet_marker(
            strip_emphasis(normalize_markdown(x)))), is_good_text)
        points = F.filter(F.transform(item_texts(member_list(e, "key_points")), normalize_markdown), lambda x: x != "")
        return F.struct(
            i.cast("int").alias("idx"), F.when(is_object, F.lower(strip(member_text(e, "type")))).alias("type"),
            strip_emphasis(_clean(member_text(e, "text"))).alias("text"),
            strip_emphasis(_clean(member_text(e, "intro_text"))).alias("intro"), items.alias("items"),
            _clean(member_text(e, "summary")).alias("summary"), points.alias("points"))

    def finish(x: Column) -> Column:
        bullet = x["type"] == "bullet_list"
        body = F.when(bullet, F.array_join(x["items"], " ")).otherwise(x["text"])
        return F.struct(
            x["idx"].alias("idx_in_chunk"), x["type"].alias("type"), F.when(~bullet, x["text"]).alias("text"),
            F.when(bullet, x["intro"]).alias("intro_text"), F.when(bullet, x["items"]).alias("items"),
            F.when(x["summary"] != "", x["summary"]).otherwise(fallback_summary(body)).alias("summary"),
            F.when(F.size(x["points"]) > 0, F.slice(x["points"], 1, MAX_KEY_POINTS)).otherwise(fallback_key_points(body)).alias("key_points"))

    raw = member_list(F.parse_json(extract_json(content)), "elements")
    usable = F.filter(F.transform(raw, read), lambda x: ((x["type"] == "bullet_list") & (F.size(x["items"]) > 0)) | (
        (x["type"] == "paragraph") & is_good_text(x["text"])))
    return F.coalesce(F.transform(usable, finish), F.array().cast(f"array<struct<{ELEMENT_FIELDS}>>"))


def _fallback_elements(text: Column) -> Column:
    """L-5 on one chunk: its readable paragraphs."""
    none = F.lit(None)
    return F.transform(good_paragraphs(text), lambda p, i: F.struct(
        i.cast("int").alias("idx_in_chunk"), F.lit("paragraph").alias("type"), strip_emphasis(p).alias("text"),
        none.cast("string").alias("intro_text"), none.cast("array<string>").alias("items"),
        fallback_summary(p).alias("summary"), fallback_key_points(p).alias("key_points")))


def attach_responses(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Chunks with the answer to each, NULL where none came back."""
    return chunks.join(responses.select("doc_id", "chunk_index", "content"), ["doc_id", "chunk_index"], "left")


def draft_elements(chunks: DataFrame) -> DataFrame:
    """L-4 with L-5: one row per chunk with its element array.

    ``chunks`` may carry a ``content`` column with the model's answer.
    """
    text = F.col("text")
    if "content" not in chunks.columns:
        elements = _fallback_elements(text)
    else:
        answered = F.when(normalize_markdown(F.coalesce(text, F.lit(""))) != "", _answer_elements(F.col("content")))
        elements = let(answered, lambda a: F.when(F.size(a) > 0, a).otherwise(_fallback_elements(text)))
    return chunks.select("doc_id", "chunk_index", "section_title", elements.alias("elements"))


def answered_elements(responses: DataFrame) -> DataFrame:
    """L-4 alone, in long form."""
    rows = responses.select("doc_id", "chunk_index", _answer_elements(F.col("content")).alias("elements"))
    return inline_rows(rows, "elements", "doc_id", "chunk_index", key="idx_in_chunk")


def element_rows(drafts: DataFrame) -> DataFrame:
    return inline_rows(drafts, "elements", "doc_id", "chunk_index", "section_title", key="idx_in_chunk")


def token_usage(responses: DataFrame) -> DataFrame:
    """L-8: token sums per document; partial sums are combined before the shuffle."""
    used_in, used_out = F.coalesce("tokens_in", F.lit(0)), F.coalesce("tokens_out", F.lit(0))
    return responses.groupBy("doc_id").agg(
        F.sum(used_in).alias("input"), F.sum(used_out).alias("output"), F.sum(used_in + used_out).alias("total"))


def paragraph_prompts(elements: DataFrame, keys: list[str]) -> DataFrame:
    """L-9: request for one paragraph's summary and key points."""
    return elements.select(*keys, F.concat(F.lit(f"{FIELDS_INSTRUCTION}\n\nPassage:\n"), F.coalesce("text", F.lit(""))).alias("prompt"))


def bullet_source(intro: Column, items: Column) -> Column:
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: x != "")
    lines = F.transform(kept, lambda x, i: F.concat(F.lit("Item "), (i + 1).cast("string"), F.lit(": "), x))
    head = filled(intro)
    lead = F.when(head.isNotNull(), F.array(F.concat(F.lit("Intro text: "), head))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lead, lines), "\n")


def bullet_prompts(elements: DataFrame, keys: list[str]) -> DataFrame:
    """L-9: request for one bullet list's summary and key points."""
    return elements.select(*keys, F.concat(
        F.lit(f"{FIELDS_INSTRUCTION}\n\nPassage:\n"), bullet_source(F.col("intro_text"), F.col("items"))).alias("prompt"))


def parse_fields(responses: DataFrame) -> DataFrame:
    """L-9: summary and non-blank key points of an answer; no limit on the points here."""
    keep = [c for c in responses.columns if c != "content"]
    v = F.parse_json(extract_json(F.col("content")))
    points = F.filter(F.transform(item_texts(member_list(v, "key_points")), strip), lambda x: x != "")
    return responses.select(*keep, strip(member_text(v, "summary")).alias("summary"), points.alias("key_points"))
