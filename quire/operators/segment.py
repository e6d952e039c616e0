"""Segmentation and packing (S-1..S-7).

A document reaches Spark as one row whose text is one cell, so its block array is already
inside one task and is bounded by the cell. All order-dependent steps therefore run as
array expressions on that row: the stage is a narrow map without any shuffle, however many
documents there are and however uneven their sizes. The folds keep their state in scalars
and append only when a new chunk opens, so they stay linear in the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.arrays import first_position, inline_rows, let, numbered_rows, positions, runs
from quire.functions.blocks import _title, fact_array, is_abstract_candidate, is_intro_title
from quire.functions.text import block_array, first_line, strip_md

CHUNK_MAX_CHARS = 2200
UNKNOWN = "UNKNOWN"


def block_frame(raw_docs: DataFrame, sep: str = "\n\n", text: str = "markdown") -> DataFrame:
    """(doc_id, blocks): the document with its block array."""
    return raw_docs.select("doc_id", block_array(F.col(text), sep).alias("blocks"))


def split_blocks(raw_docs: DataFrame, sep: str = "\n\n", text: str = "markdown") -> DataFrame:
    """T-3 in long form: one row per block."""
    return numbered_rows(block_frame(raw_docs, sep, text), "blocks", "doc_id", names=("block_index", "block"))


def role_array(facts: Column) -> Column:
    """S-1: the role of every block, aligned with the fact array."""
    def live(x: Column) -> Column:
        return ~x["should_remove"] & ~x["is_caption"]

    def roles(m: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            pos = i + 1
            noise = F.when(x["should_remove"], "removed").when(x["is_caption"], "caption")
            started = (
                F.when((m["tail"] > 0) & (pos > m["tail"]), "after_tail")
                .when(pos == m["tail"], "removed")
                .otherwise(F.coalesce(noise, F.when(pos >= m["start"], "body")
                           .when(x["is_natural_body"], F.when(m["flush"], "body").otherwise("dropped_candidate"))
                           .otherwise("front")))
            )
            unstarted = F.coalesce(noise, F.when(m["candidates"], F.when(x["is_natural_body"], "body").otherwise("front"))
                                   .when((m["fallback"] > 0) & (pos >= m["fallback"]), "body").otherwise("front"))
            return F.when(m["start"] > 0, started).otherwise(unstarted)
        return F.transform(facts, one)

    def with_start(start: Column) -> Column:
        opener = F.get(facts, start - 1)
        marks = F.struct(
            start.alias("start"),
            first_position(facts, lambda x, i: (start > 0) & (i + 1 > start) & live(x) & x["is_tail_heading"]).alias("tail"),
            F.coalesce(opener["is_major_heading"] & (opener["section_title"] != "ABSTRACT"), F.lit(False)).alias("flush"),
            F.exists(facts, lambda x: x["is_natural_body"]).alias("candidates"),
            first_position(facts, lambda x: live(x) & (x["n_words"] >= 20) & ~x["is_keywords_loose"]).alias("fallback"),
        )
        return let(marks, roles)

    return let(first_position(facts, lambda x: x["is_body_start"]), with_start)


def assign_roles(docs: DataFrame) -> DataFrame:
    """Document frame (doc_id, blocks) → (doc_id, facts, roles)."""
    return docs.select("doc_id", fact_array(F.col("blocks")).alias("facts")).select(
        "doc_id", "facts", role_array(F.col("facts")).alias("roles"))


def merge_marks(body: Column) -> Column:
    """S-3: for each body block whether it continues the block before it.

    The pairwise rule equals the sequential fold except after a bare number such as
    ``2.1`` followed by a capitalised connective: their joint first line is a heading and
    takes no continuation. ``caught`` marks these places; the exact fold runs only for
    documents that have one.
    """
    pair = F.transform(body, lambda x, i: F.coalesce(F.get(body, i - 1)["joins_next"] & x["joins_prev"], F.lit(False)))

    def resolve(pairs: Column) -> Column:
        def caught_at(i: Column) -> Column:
            return F.coalesce(
                F.get(pairs, i) & F.get(pairs, i - 1)
                & F.get(body, i - 2)["is_bare_number"] & F.get(body, i - 1)["opens_capital"], F.lit(False))

        caught = F.transform(pairs, lambda p, i: F.struct(p.alias("pair"), caught_at(i).alias("caught")))
        # One letter per block; a caught block repeats the decision made two blocks earlier.
        folded = F.aggregate(
            caught, F.lit(""),
            lambda out, x: F.concat(out, F.when(x["caught"], F.substring(out, -2, 1)).otherwise(
                F.when(x["pair"], "m").otherwise("s"))),
            lambda out: F.transform(F.sequence(F.lit(1), F.length(out)), lambda i: F.substring(out, i, F.lit(1)) == "m"),
        )
        return F.when(F.exists(caught, lambda x: x["caught"]), folded).otherwise(pairs)

    return let(pair, resolve)


def merged_array(body: Column) -> Column:
    """S-3 and S-4: the merged blocks with their section titles."""
    def joined(marks: Column) -> Column:
        starts = positions(marks, lambda m: ~m)
        return runs(body, starts, lambda s, n, k: F.struct(
            k.cast("int").alias("merged_index"),
            F.get(body, s)["block_index"].cast("int").alias("first_block_index"),
            n.cast("int").alias("n_blocks"),
            F.array_join(F.transform(F.sequence(s, s + n - 1), lambda i: F.get(body, i)["block"]), " ").alias("block"),
        ))

    merged = F.when(F.size(body) > 0, let(merge_marks(body), joined))
    lined = F.transform(merged, lambda x: F.struct(x.alias("m"), first_line(x["block"]).alias("line")))
    lined = F.transform(lined, lambda x: x.withField("clean", strip_md(x["line"])))
    titled = F.transform(lined, lambda x: F.struct(
        x["m"]["merged_index"].alias("merged_index"), x["m"]["first_block_index"].alias("first_block_index"),
        x["m"]["n_blocks"].alias("n_blocks"), x["m"]["block"].alias("block"),
        F.length(x["m"]["block"]).alias("n_chars"), _title(x["line"], x["clean"]).alias("title")))
    return F.transform(titled, lambda x, i: x.withField("opens_section", (i == 0) | x["title"].isNotNull()))


def section_array(merged: Column) -> Column:
    """S-4 and S-5: sections in order, the leading untitled one relabelled when it is an abstract."""
    starts = positions(merged, lambda x: x["opens_section"])
    plain = runs(merged, starts, lambda s, n, k: F.struct(
        k.cast("int").alias("section_id"), F.coalesce(F.get(merged, s)["title"], F.lit(UNKNOWN)).alias("section_title"),
        s.cast("int").alias("first_merged_index"), n.cast("int").alias("n_merged")))

    def relabel(sections: Column) -> Column:
        lead, second = F.get(sections, F.lit(0)), F.get(sections, F.lit(1))
        lead_blocks = F.transform(F.slice(merged, F.lit(1), lead["n_merged"]), lambda m: m["block"])
        hit = (F.size(sections) >= 2) & (lead["section_title"] == UNKNOWN) & is_intro_title(second["section_title"])
        is_abstract = F.when(F.coalesce(hit, F.lit(False)), is_abstract_candidate(lead_blocks)).otherwise(False)
        return let(is_abstract, lambda flag: F.transform(sections, lambda s: s.withField(
            "section_title", F.when(flag & (s["section_id"] == 0), "ABSTRACT").otherwise(s["section_title"]))))

    return let(plain, relabel)


def chunk_array(merged: Column, sections: Column, max_chars: int = CHUNK_MAX_CHARS) -> Column:
    """S-6: greedy packing inside each section; an oversize block stands alone."""
    none = F.array().cast("array<struct<pos:int,section:int,origin:int>>")
    zero = F.struct(F.lit(0).alias("size"), F.lit(-1).alias("section"), F.lit(0).alias("origin"), none.alias("marks"))

    def step(acc: Column, x: Column) -> Column:
        opens = x["opens_section"]
        fresh = opens | (acc["size"] + 2 + x["n_chars"] > max_chars)
        section = acc["section"] + F.when(opens, 1).otherwise(0)
        origin = F.when(opens, x["merged_index"]).otherwise(acc["origin"])
        mark = F.struct(x["merged_index"].alias("pos"), section.alias("section"), origin.alias("origin"))
        return F.struct(
            F.when(fresh, x["n_chars"]).otherwise(acc["size"] + 2 + x["n_chars"]).alias("size"),
            section.alias("section"), origin.alias("origin"),
            F.when(fresh, F.concat(acc["marks"], F.array(mark))).otherwise(acc["marks"]).alias("marks"),
        )

    def cut(marks: Column) -> Column:
        return let(F.size(merged), lambda total: F.transform(marks, lambda m, k: let(
            F.coalesce(F.get(marks, k + 1)["pos"], total), lambda end: F.struct(
                k.cast("int").alias("chunk_index"), m["section"].alias("section_id"),
                F.get(sections, m["section"])["section_title"].alias("section_title"),
                F.sequence(m["pos"] - m["origin"], end - 1 - m["origin"]).alias("source_block_indices"),
                F.array_join(F.transform(F.sequence(m["pos"], end - 1), lambda i: F.get(merged, i)["block"]), "\n\n").alias("text"),
            ))))

    return let(F.aggregate(merged, zero, step, lambda acc: acc["marks"]), cut)


def structure(raw_docs: DataFrame, max_chars: int = CHUNK_MAX_CHARS, sep: str = "\n\n", text: str = "markdown") -> DataFrame:
    """S-7: one row per document with its blocks, merged body, sections and chunks."""
    roles = assign_roles(block_frame(raw_docs, sep, text))
    needed = ("block_index", "block", "joins_next", "joins_prev", "is_bare_number", "opens_capital")
    body = let(F.col("roles"), lambda r: F.filter(F.col("facts"), lambda x, i: F.get(r, i) == "body"))
    slim = F.transform(body, lambda x: F.struct(*[x[n].alias(n) for n in needed]))
    marked = roles.select("doc_id", "facts", "roles", slim.alias("body"))
    merged = marked.withColumn("merged", F.coalesce(merged_array(F.col("body")), empty_merged()))
    sections = merged.withColumn("sections", section_array(F.col("merged")))
    return sections.withColumn("chunks", chunk_array(F.col("merged"), F.col("sections"), max_chars))


def empty_merged() -> Column:
    return F.array().cast(
        "array<struct<merged_index:int,first_block_index:int,n_blocks:int,block:string,n_chars:int,title:string,opens_section:boolean>>")


def block_rows(structured: DataFrame) -> DataFrame:
    """Long form of the block roles."""
    rows = F.transform(F.col("facts"), lambda x, i: F.struct(
        i.cast("int").alias("block_index"), x["block"].alias("block"), F.get(F.col("roles"), i).alias("role"),
        x["removed_by"].alias("removed_by"), x["section_title"].alias("section_title")))
    return inline_rows(structured, rows, "doc_id", key="block_index")


def merged_rows(structured: DataFrame) -> DataFrame:
    return inline_rows(structured, "merged", "doc_id", key="merged_index")


def section_rows(structured: DataFrame) -> DataFrame:
    return inline_rows(structured, "sections", "doc_id", key="section_id")


def sectioned_block_rows(structured: DataFrame) -> DataFrame:
    """Merged blocks with the section they belong to."""
    sections = inline_rows(structured, "sections", "doc_id", "merged", key="section_id")
    blocks = F.slice("merged", F.col("first_merged_index") + 1, F.col("n_merged"))
    return numbered_rows(sections, blocks, "doc_id", "section_id", "section_title", names=("block_in_section", "m")).select(
        "doc_id", "section_id", "section_title", "block_in_section", "m.merged_index", "m.block")


def chunk_rows(structured: DataFrame) -> DataFrame:
    return inline_rows(structured, "chunks", "doc_id", key="chunk_index")


def stage_counts(structured: DataFrame) -> DataFrame:
    """IO-14: block, section and chunk counts per document, read off the arrays."""
    def n(role: str) -> Column:
        return F.size(F.filter("roles", lambda r: r == role))

    return structured.select(
        "doc_id", F.size("facts").alias("raw_block_count"), n("front").alias("front_matter_block_count"),
        F.size("body").alias("body_block_count_before_merge"), F.size("merged").alias("body_block_count_after_merge"),
        n("caption").alias("caption_block_count"), n("removed").alias("removed_block_count"),
        F.size("sections").alias("section_count"), F.size("chunks").alias("chunk_count"))


def chunk_preview(structured: DataFrame, n: int = 3, chars: int = 500) -> DataFrame:
    """IO-15: the first chunks of each document, shortened."""
    return inline_rows(structured, F.slice("chunks", 1, n), "doc_id", key="chunk_index").select(
        "doc_id", "chunk_index", "section_title", F.substring("text", 1, chars).alias("preview"))
