"""Translation merge (X-1..X-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.jsontext import extract_json, item_texts, member_list
from quire.functions.text import sanitize_text
from quire.operators.scan import running, tile_of
from quire.session import by_key

BATCH = 8
STALE = "10 minutes"
INSTRUCTION = (
    "Translate the elements below from English to Traditional Chinese, item by item. Answer with one JSON object holding "
    "\"elements\"; each entry has the given \"id\" and \"text_zh\", \"summary_zh\", \"key_points_zh\", \"items_zh\" with the "
    "same number of list entries as the input."
)
FIELDS = ["text_zh", "summary_zh", "key_points_zh", "items_zh"]


def _texts(c: str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _sanitized_list(c: Column) -> Column:
    return F.transform(c, sanitize_text)


def number_batches(elements: DataFrame, size: int = BATCH) -> DataFrame:
    """(doc_id, element_index, batch_no): consecutive runs of ``size`` elements."""
    spine = running(elements.select("doc_id", "element_index"), ["doc_id"], ["element_index"], tile_of("element_index"), sums={"n": F.lit(1)})
    return spine.select("doc_id", "element_index", F.floor((F.col("n") - 1) / size).cast("int").alias("batch_no"))


def _entry() -> Column:
    """One element as it is sent."""
    clean = lambda c: F.when(F.col(c).isNotNull(), sanitize_text(F.col(c))).alias(c)
    listed = lambda c: _sanitized_list(F.col(c)).alias(c)
    return F.struct(F.col("element_index").cast("string").alias("id"), clean("type"), clean("level"), clean("text"), clean("summary"), listed("key_points"), listed("items"))


def single_batches(elements: DataFrame) -> DataFrame:
    """X-1 for elements that are sent one by one: ``batch_no`` is the element's index."""
    return elements.select("doc_id", F.col("element_index").alias("batch_no"), F.lit(1).alias("n_elements"), F.to_json(F.array(_entry()), {"ignoreNullFields": "false"}).alias("payload"))


def translation_batches(elements: DataFrame, size: int = BATCH) -> DataFrame:
    """X-1: one payload per batch, its elements in order."""
    return batch_payloads(elements.join(by_key(number_batches(elements, size)), ["doc_id", "element_index"]))


def batch_payloads(numbered: DataFrame) -> DataFrame:
    """One payload per (doc_id, batch_no) of the given rows."""
    rows = numbered.select("doc_id", "batch_no", "element_index", _entry().alias("entry"))
    return rows.groupBy("doc_id", "batch_no").agg(
        F.count("*").cast("int").alias("n_elements"),
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("element_index", "entry"))), lambda x: x["entry"]), {"ignoreNullFields": "false"}).alias("payload"))


def translation_prompts(batches: DataFrame) -> DataFrame:
    return batches.select("doc_id", "batch_no", F.concat(F.lit(f"{INSTRUCTION}\n\nElements:\n"), F.col("payload")).alias("prompt"))


OVERVIEW_INSTRUCTION = (
    "Translate the overview below from English to Traditional Chinese. Answer with one JSON object of the same shape; keep every list as long as "
    "it is, every element_id and every section_key."
)
OVERVIEW_FIELDS = ("abstract_summary string, overall_summary string, overall_key_points array<string>, "
                   "highlights array<struct<element_id:int,title:string,summary:string>>, sections array<struct<section_key:string,section_title:string,summary:string>>")


def overview_translation_prompts(overviews: DataFrame) -> DataFrame:
    """X-5: one request per overview."""
    payload = F.to_json(F.struct("abstract_summary", "overall_summary", "overall_key_points", "highlights", "sections"), {"ignoreNullFields": "false"})
    return overviews.select("doc_id", F.concat(F.lit(f"{OVERVIEW_INSTRUCTION}\n\nOverview:\n"), payload).alias("prompt"))


def parse_overview_translations(responses: DataFrame) -> DataFrame:
    """X-5: the fields of an answer; what is missing or of another kind is NULL."""
    return responses.select("doc_id", F.from_json(extract_json(F.col("content")), OVERVIEW_FIELDS).alias("t")).select("doc_id", "t.*")


def parse_translations(responses: DataFrame) -> DataFrame:
    """Answers to long rows; entries without a usable id drop out, the last one wins on repeats."""
    found = member_list(F.parse_json(extract_json(F.col("content"))), "elements")
    rows = responses.select("doc_id", "batch_no", F.posexplode(found).alias("pos", "v"))
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string").alias(name)
    items = lambda name: F.when(member_list(F.col("v"), name).isNotNull(), item_texts(member_list(F.col("v"), name))).alias(name)
    parsed = rows.select("doc_id", "batch_no", "pos", F.try_variant_get("v", "$.id", "int").alias("element_index"), text("text_zh"), text("summary_zh"), items("key_points_zh"), items("items_zh"))
    keys = ["doc_id", "batch_no", "element_index"]
    return parsed.where(F.col("element_index").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*FIELDS), "pos").alias("t")).select(*keys, "t.*")


def merge_translations(elements: DataFrame, translations: DataFrame) -> DataFrame:
    """X-2: translations of known elements; a list of the wrong length is replaced by its source."""
    keep = [c for c in ("batch_no",) if c in translations.columns]
    source = elements.select("doc_id", "element_index", _texts("key_points").alias("_kp"), _texts("items").alias("_it"))
    if keep:
        source = source.join(by_key(number_batches(elements)), ["doc_id", "element_index"])
    joined = translations.join(by_key(source), ["doc_id", *keep, "element_index"])
    same = lambda new, old: _sanitized_list(F.when(F.size(new) == F.size(old), F.col(new)).otherwise(F.col(old)))
    return joined.select("doc_id", "element_index", sanitize_text(F.col("text_zh")).alias("text_zh"), sanitize_text(F.col("summary_zh")).alias("summary_zh"),
                         same("key_points_zh", "_kp").alias("key_points_zh"), same("items_zh", "_it").alias("items_zh"))


def translation_fallback(elements: DataFrame, failed: DataFrame) -> DataFrame:
    """X-3: elements whose own retry failed keep their source fields as translation."""
    return elements.join(by_key(failed.select("doc_id", "element_index").distinct()), ["doc_id", "element_index"], "left_semi").select(
        "doc_id", "element_index", F.col("text").alias("text_zh"), F.col("summary").alias("summary_zh"), _texts("key_points").alias("key_points_zh"), _texts("items").alias("items_zh"))


def apply_translations(elements: DataFrame, translations: DataFrame) -> DataFrame:
    """X-4: overwrite with the translated fields that are not NULL."""
    new = translations.select("doc_id", "element_index", *[F.col(f).alias(f"_{f}") for f in FIELDS])
    return elements.join(by_key(new), ["doc_id", "element_index"], "left").withColumns({f: F.coalesce(f"_{f}", f) for f in FIELDS}).drop(*[f"_{f}" for f in FIELDS])


def merge_overview_translation(overviews: DataFrame, translated: DataFrame) -> DataFrame:
    """X-5: ``_zh`` twins of an overview; lists of the wrong length fall back to the source."""
    t = translated.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("abstract_summary", "overall_summary", "overall_key_points", "highlights", "sections")])
    joined = overviews.join(by_key(t), "doc_id", "left")

    def same(name: str, clean) -> Column:
        return F.transform(F.when(F.size(f"_{name}") == F.size(name), F.col(f"_{name}")).otherwise(F.col(name)), clean)

    section = lambda s: F.struct(*[sanitize_text(s[n]).alias(n) for n in ("section_key", "section_title", "summary")])
    highlight = lambda h: F.struct(h["element_id"].cast("int").alias("element_id"), sanitize_text(h["title"]).alias("title"), sanitize_text(h["summary"]).alias("summary"))
    return joined.select(
        *overviews.columns, sanitize_text(F.col("_abstract_summary")).alias("abstract_summary_zh"), sanitize_text(F.col("_overall_summary")).alias("overall_summary_zh"),
        same("overall_key_points", sanitize_text).alias("overall_key_points_zh"), same("highlights", highlight).alias("highlights_zh"), same("sections", section).alias("sections_zh"))


def expire_stale(papers: DataFrame, now: Column, limit: str = STALE) -> DataFrame:
    """X-7: a run without a start, or older than the limit, counts as failed."""
    stale = F.col("zh_started_at").isNull() | (now - F.col("zh_started_at") > F.expr(f"INTERVAL {limit}"))
    return papers.withColumn("zh_status", F.when((F.col("zh_status") == "processing") & stale, "failed").otherwise(F.col("zh_status")))


def translation_decision(papers: DataFrame, overviews: DataFrame, now: Column) -> DataFrame:
    """X-6: what a translation request does for each paper."""
    known = overviews.select("doc_id").distinct().withColumn("_has", F.lit(True))
    fresh = expire_stale(papers, now).join(by_key(known), "doc_id", "left")
    return fresh.withColumn("decision", F.when(F.col("_has").isNull(), "no_overview").when(F.col("zh_status") == "completed", "already_exists")
                            .when(F.col("zh_status") == "processing", "processing").otherwise("run")).drop("_has")
