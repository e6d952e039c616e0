"""Composed jobs: edits with all that follows from them, overviews, and translation of whole documents (E-1..E-13, L-9, O-1..O-8, X-1..X-7)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.jsontext import extract_json, member_text
from quire.functions.text import strip
from quire.operators import edits as E
from quire.operators import overview as O
from quire.operators import translate as X
from quire.operators.answers import ask
from quire.operators.drafting import BatchFn, bullet_prompts, bullet_source, paragraph_prompts, parse_fields
from quire.operators.evidence import LIMIT, answer_whole, parts
from quire.session import by_key, stored


class Edited(NamedTuple):
    elements: DataFrame
    overviews: DataFrame
    text_highlights: DataFrame
    pdf_highlights: DataFrame
    rejected: DataFrame
    changes: DataFrame


def _field_source() -> Column:
    """What an element's summary and key points are made from."""
    return F.when(F.col("type") == "bullet_list", bullet_source(F.col("intro_text"), F.col("items"))).otherwise(F.coalesce("text", F.lit("")))


def _unchanged(snapshot: DataFrame, elements: DataFrame) -> DataFrame:
    """Dirty rows that read as before get their generated fields back and are clean again."""
    fields = ["summary", "key_points", *X.FIELDS]
    old = elements.where(F.col("summary").isNotNull()).select(
        "element_id", F.sha2(_field_source(), 256).alias("_hash"), F.struct(*fields).alias("_old"))
    met = snapshot.where("dirty").join(old, "element_id", "left").withColumn("_same", F.coalesce(F.sha2(_field_source(), 256) == F.col("_hash"), F.lit(False)))
    kept = {c: F.when(F.col("_same"), F.col(f"_old.{c}")).otherwise(F.col(c)) for c in fields}
    return met.withColumns(kept | {"dirty": ~F.col("_same")}).drop("_hash", "_old", "_same").unionByName(snapshot.where("NOT dirty"))


def regenerate_fields(elements: DataFrame, fn: BatchFn, store: str | None = None) -> DataFrame:
    """L-9 over dirty rows: (element_id, summary, key_points) of those that got an answer."""
    asked = lambda make, kind: make(elements.where(F.col("dirty") & (F.col("type") == kind)), ["element_id"])
    answers = ask(asked(paragraph_prompts, "paragraph").unionByName(asked(bullet_prompts, "bullet_list")), fn, store)
    return parse_fields(answers.where("error IS NULL").select("element_id", "content")).select("element_id", "summary", "key_points")


def retranslate(elements: DataFrame, fn: BatchFn, store: str | None = None) -> DataFrame:
    """X-1..X-4 for single elements: the rows with their ``_zh`` fields; where no usable answer comes, the source stands in (X-3).

    A paragraph has no list of items and a bullet list no text of its own, so those fields stay as they are.
    """
    source = elements.withColumn("text", F.when(F.col("type") != "bullet_list", F.col("text"))).withColumn("items", F.when(F.col("type") == "bullet_list", F.col("items")))
    answers = ask(X.translation_prompts(X.single_batches(source)), fn, store)
    found = X.merge_translations(source, X.parse_translations(answers).drop("batch_no"))
    lost = source.join(found.select("doc_id", "element_index"), ["doc_id", "element_index"], "left_anti")
    every = stored(found.unionByName(X.translation_fallback(source, lost)), "translations")
    kinds = elements.select("doc_id", "element_index", (F.col("type") == "bullet_list").alias("_list"))
    fitting = every.join(kinds, ["doc_id", "element_index"]).withColumn("text_zh", F.when(~F.col("_list"), F.col("text_zh"))).withColumn("items_zh", F.when(F.col("_list"), F.col("items_zh")))
    return X.apply_translations(elements, fitting.drop("_list"))


def refresh_sections(before: DataFrame, after: DataFrame, touched: DataFrame, fn: BatchFn, store: str | None = None) -> DataFrame:
    """E-6, E-7: (doc_id, section_title, summary, summary_zh) of touched sections whose summaries are no longer what they were."""
    key = ["doc_id", "section_title"]

    def fingerprint(lines: DataFrame) -> DataFrame:
        # part numbers follow from the text alone, so equal evidence has equal parts
        return parts(lines, [*key, "lang"]).groupBy(*key).agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("lang", "part", "source")).alias("_hash"))

    now = stored(E.section_refresh_lines(after, touched), "section-lines")
    then = stored(E.section_refresh_lines(before, touched), "old-section-lines")
    changed = stored(fingerprint(now).join(fingerprint(then), [*key, "_n", "_hash"], "left_anti").select(*key), "changed-sections")
    lines = now.join(changed, key, "left_semi")
    head = E.section_refresh_head(F.col("section_title"), F.col("lang"))
    answers = answer_whole(lines.select(*key, "lang").distinct(), lines, head, fn, store).where("error IS NULL")
    text = strip(F.coalesce(member_text(F.parse_json(extract_json(F.col("content"))), "summary"), F.lit("")))
    both = answers.withColumn("_s", text).groupBy(*key).agg(
        F.max(F.when(F.col("lang") == "en", F.col("_s"))).alias("summary"), F.max(F.when(F.col("lang") == "zh", F.col("_s"))).alias("summary_zh"))
    return both.where("summary IS NOT NULL AND summary_zh IS NOT NULL")


def edit_job(elements: DataFrame, overviews: DataFrame, text_highlights: DataFrame, pdf_highlights: DataFrame, edits: DataFrame, fn: BatchFn,
             store: str | None = None) -> Edited:
    """A batch of edits with all that follows from it: element, section, overview, highlight.

    Each level is regenerated only where what it is made from has changed: an element whose text reads as before keeps its summary and
    translations, a section is summarised anew only if the summaries in it differ, and overviews without such a section keep their row. Rows whose
    model call failed stay ``dirty``, keep NULL fields and are taken up by the next run with ``regenerate_fields``; sections wait likewise with their
    old summary. ``changes`` lists what was done as (level, doc_id, key, state). ``store`` is a folder of answers, so that a repeated run
    asks for nothing twice.
    """
    # read at every level, so each input is evaluated once, and the edits are judged once for both kinds of verdict
    elements, overviews, edits = stored(elements, "job-elements"), stored(overviews, "job-overviews"), stored(edits, "job-edits")
    judged = stored(E.judge_edits(edits, elements), "judged")
    good = judged.where(F.col("reason").isNull()).drop("reason")
    snapshot = stored(_unchanged(stored(E.apply_accepted(elements, good), "applied"), elements), "edited")
    fresh = stored(regenerate_fields(snapshot, fn, store), "fields")
    named = fresh.withColumnsRenamed({"summary": "_summary", "key_points": "_points"})
    written = snapshot.where("dirty").join(named, "element_id").withColumns({"summary": F.col("_summary"), "key_points": F.col("_points"), "dirty": F.lit(False)}).drop("_summary", "_points")
    translated = stored(retranslate(stored(written, "regenerated"), fn, store), "retranslated")
    after = stored(snapshot.join(translated.select("element_id"), "element_id", "left_anti").unionByName(translated), "snapshot")

    touched = E.touched_sections(good)
    sections = stored(refresh_sections(elements, after, touched, fn, store), "sections")
    next_overviews = E.upsert_section_summaries(overviews, sections)

    texts = E.invalidate_paragraph_highlights(E.invalidate_section_highlights(text_highlights, good, overviews), good)
    marks = E.invalidate_pdf_highlights(pdf_highlights, good)
    entry = lambda df, level, key, state: df.select(F.lit(level).alias("level"), "doc_id", F.col(key).cast("string").alias("key"), (F.lit(state) if isinstance(state, str) else state).alias("state"))
    hit = good.where(F.col("op") != "delete").select(F.when(F.col("op") == "insert", -F.col("edit_seq")).otherwise(F.col("element_id")).alias("element_id")).distinct()
    state = F.when(F.col("_new").isNotNull(), "regenerated").when(F.col("dirty"), "waiting").otherwise("kept")
    rows = after.join(hit, "element_id", "left_semi").join(fresh.select("element_id", F.lit(1).alias("_new")), "element_id", "left")
    renewed = touched.join(sections.select("doc_id", "section_title", F.lit(1).alias("_new")), ["doc_id", "section_title"], "left")
    changes = (
        entry(rows, "element", "element_id", state)
        .unionByName(entry(good.where(F.col("op") == "delete"), "element", "element_id", "deleted"))
        .unionByName(entry(renewed, "section", "section_title", F.when(F.col("_new").isNotNull(), "regenerated").otherwise("kept")))
        .unionByName(entry(overviews.join(sections.select("doc_id").distinct(), "doc_id", "left_semi"), "overview", "doc_id", "updated"))
        .unionByName(entry(text_highlights.join(texts, "highlight_id", "left_anti"), "text_highlight", "highlight_id", "removed"))
        .unionByName(entry(pdf_highlights.join(marks, "highlight_id", "left_anti"), "pdf_highlight", "highlight_id", "removed"))
    )
    return Edited(after, next_overviews, texts, marks, E.refused(judged), changes)


class Translated(NamedTuple):
    elements: DataFrame
    overviews: DataFrame
    papers: DataFrame
    work: DataFrame


def translate_batches(elements: DataFrame, fn: BatchFn, store: str | None = None, size: int = X.BATCH, **how) -> tuple[DataFrame, DataFrame]:
    """X-1..X-3: (translations, work) of elements in batches; a failed batch is halved until the bad element stands alone.

    Every round is one job over the rows that are still open: those of failed batches, in batches of half the size. An element whose own call
    fails keeps its source. ``work`` holds (doc_id, element_index, batch_size, state) with the size of the batch that settled the element.
    """
    numbered = stored(elements.join(by_key(X.number_batches(elements, 1)), ["doc_id", "element_index"]).withColumnRenamed("batch_no", "_n"), "translation-work")
    rows, found, states = numbered, [], []
    key = ["doc_id", "batch_no"]
    while True:
        batched = rows.withColumn("batch_no", F.floor(F.col("_n") / size).cast("int"))
        answers = stored(ask(X.translation_prompts(X.batch_payloads(batched)), fn, store, **how), "translation-answers")
        given = X.parse_translations(answers.where("error IS NULL")).join(by_key(batched.select(*key, "element_index")), [*key, "element_index"], "left_semi")
        found.append(X.merge_translations(rows, given.drop("batch_no")))
        failed = by_key(answers.where("error IS NOT NULL").select(*key))
        settled = batched.join(failed, key, "left_anti").select("doc_id", "element_index", F.lit(size).alias("batch_size"), F.lit("answered").alias("state"))
        states.append(settled)
        lost = batched.join(failed, key, "left_semi").drop("batch_no")
        if size == 1:
            found.append(X.translation_fallback(rows, lost))
            states.append(lost.select("doc_id", "element_index", F.lit(1).alias("batch_size"), F.lit("source kept").alias("state")))
            break
        rows, size = stored(lost, "translation-work"), max(size // 2, 1)
        if rows.isEmpty():
            break
    both = []
    for parts in (found, states):
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        both.append(stored(out, "translated"))
    return both[0], both[1]


def translation_job(papers: DataFrame, elements: DataFrame, overviews: DataFrame, now: Column, fn: BatchFn, store: str | None = None, **how) -> Translated:
    """Translate the papers whose status allows it (X-6, X-7): their elements in batches, their overviews whole.

    A paper whose overview call fails is ``failed`` and keeps all its rows as they were; the others are ``completed``. Papers that are completed or
    under way, or have no overview, stay as they are. Answers lie in ``store``, so a repeated run asks only for what failed.
    """
    judged = stored(X.translation_decision(papers, overviews, now), "translation-decisions")
    due = judged.where("decision = 'run'").select("doc_id")
    texts = ask(X.overview_translation_prompts(overviews.join(by_key(due), "doc_id", "left_semi")), fn, store, **how)
    answers = stored(texts, "overview-answers")
    good = stored(answers.where("error IS NULL").select("doc_id").distinct(), "translated-papers")
    translations, work = translate_batches(elements.join(by_key(good), "doc_id", "left_semi"), fn, store, **how)
    own = overviews.join(by_key(good), "doc_id", "left_semi")
    zh = [c for c in overviews.columns if c.endswith("_zh")]
    merged = X.merge_overview_translation(own.drop(*zh), X.parse_overview_translations(answers.where("error IS NULL")))
    status = F.when(F.col("decision") != "run", F.col("zh_status")).when(F.col("_ok"), "completed").otherwise("failed")
    ran = F.col("decision") == "run"
    next_papers = judged.join(by_key(good.withColumn("_ok", F.lit(True))), "doc_id", "left").withColumn("zh_status", status).withColumn(
        "zh_started_at", F.when(ran, now).otherwise(F.col("zh_started_at"))).withColumn(
        "zh_finished_at", F.when(ran & F.col("_ok"), now).when(~ran, F.col("zh_finished_at"))).drop("_ok", "decision")
    return Translated(X.apply_translations(elements, translations), overviews.join(by_key(good), "doc_id", "left_anti").unionByName(merged, allowMissingColumns=True), next_papers, work)


def overview_job(elements: DataFrame, documents: DataFrame, fn: BatchFn, store: str | None = None, limit: int = LIMIT, **how) -> tuple[DataFrame, DataFrame]:
    """O-8: (overviews, failures) of ``documents`` (``doc_id``): section, abstract and document summaries, then their translation.

    Every level asks through the answer store: a repeated run, or one after a lost one, asks only for what has no answer yet. ``failures`` holds
    (doc_id, reason): ``no_elements``, ``overview_failed`` or ``translation_failed``; such documents get no new row. A section or abstract whose own
    call failed falls back to its first summaries. Evidence of more than ``limit`` characters is asked for in parts.
    """
    wanted = stored(documents.select("doc_id").where("doc_id IS NOT NULL").distinct(), "overview-documents")
    own = stored(elements.join(wanted, "doc_id", "left_semi"), "overview-elements")
    asked = lambda base, lines, head, name: stored(answer_whole(base.distinct(), lines, head, fn, store, limit, **how), name)
    overall = asked(own.select("doc_id"), O.overview_lines(own), F.lit(O.OVERVIEW_HEAD), "overview-answers")
    grouped = stored(O.group_sections(own), "overview-sections")
    sections = asked(grouped.select(*O.SECTION_KEYS), O.section_lines(grouped), O.section_head(F.col("section_title")), "section-answers")
    first = stored(O.abstract_elements(own), "overview-abstracts")
    abstracts = asked(first.select("doc_id"), O.abstract_lines(first), O.section_head(F.lit("ABSTRACT")), "abstract-answers")
    answered = overall.where("error IS NULL").select("doc_id", "content")
    good = own.join(answered.select("doc_id"), "doc_id", "left_semi")
    fresh = stored(O.regenerate_overviews(good, answered, sections.select("doc_id", "section_no", "content"), abstracts.select("doc_id", "content")), "overviews")
    texts = stored(ask(X.overview_translation_prompts(fresh), fn, store, **how), "overview-translations")
    done = texts.where("error IS NULL").select("doc_id", "content")
    overviews = X.merge_overview_translation(fresh.join(done.select("doc_id"), "doc_id", "left_semi"), X.parse_overview_translations(done))
    reason = lambda df, text: df.select("doc_id", F.lit(text).alias("reason"))
    failures = (
        reason(wanted.join(own.select("doc_id").distinct(), "doc_id", "left_anti"), "no_elements")
        .unionByName(reason(overall.where("error IS NOT NULL"), "overview_failed"))
        .unionByName(reason(texts.where("error IS NOT NULL"), "translation_failed"))
    )
    return overviews, failures
