"""Readers for markdown documents and page boxes (IO-2, IO-3) and intake listings (IO-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.arrays import inline_rows
from quire.functions.text import normalize_box_text, strip

READABLE_CLASSES = ["text", "list-item"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_markdown(df: DataFrame, text: str = "markdown") -> DataFrame:
    """IO-2: whole documents as one text cell; NULL becomes the empty text."""
    return df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("markdown"))


def read_markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """IO-2 for a folder of markdown files; the id is a stable hash of the path."""
    files = spark.read.text(path, wholetext=True).withColumn("source_path", F.input_file_name())
    return files.select(F.xxhash64("source_path").alias("doc_id"), "source_path", F.col("value").alias("markdown"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File listing for ``intake``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"),
                        F.col("path").alias("source_path"), F.col("modificationTime").alias("created_at"))


def intake(files: DataFrame) -> DataFrame:
    """IO-1: listed PDF files become papers in state ``processing``."""
    return files.where(F.lower("name").endswith(".pdf")).select(
        F.col("file_id").alias("doc_id"), F.col("name").alias("title"), "source_path",
        F.lit("processing").alias("parse_status"), F.lit("not_started").alias("zh_status"), "created_at")


def kept_boxes(page_text: Column, boxes: Column) -> Column:
    """The boxes of one page that carry readable text, with their text cut from the page."""
    def sound(b: Column) -> Column:
        start, stop = F.get(b["pos"], F.lit(0)), F.get(b["pos"], F.lit(1))
        return F.coalesce(
            (F.size(b["bbox"]) > 0) & (F.size(b["pos"]) == 2) & (start >= 0) & (stop > start) & (stop <= F.length(page_text))
            & b["class"].isin(READABLE_CLASSES), F.lit(False))

    def cut(b: Column) -> Column:
        start, stop = F.get(b["pos"], F.lit(0)), F.get(b["pos"], F.lit(1))
        return strip(F.substring(page_text, start + 1, stop - start))

    numbered = F.transform(boxes, lambda b, i: F.struct(i.alias("ordinal"), b.alias("b")))
    texts = F.transform(F.filter(numbered, lambda x: sound(x["b"])), lambda x: F.struct(x.alias("x"), cut(x["b"]).alias("text")))
    return F.transform(F.filter(texts, lambda t: t["text"] != ""), lambda t: F.struct(
        F.coalesce(t["x"]["b"]["index"], t["x"]["ordinal"]).cast("int").alias("block_index"),
        t["x"]["b"]["class"].alias("class"), t["x"]["b"]["bbox"].alias("bbox"),
        F.get(t["x"]["b"]["pos"], F.lit(0)).alias("pos_start"), F.get(t["x"]["b"]["pos"], F.lit(1)).alias("pos_stop"),
        t["text"].alias("text"), normalize_box_text(t["text"]).alias("norm")))


def load_pages(raw_pages: DataFrame) -> DataFrame:
    """IO-3 in page form: one row per page with its readable boxes in order.

    A page arrives as one row, so its boxes never need to be gathered by a shuffle.
    """
    text = F.coalesce(F.col("page_text"), F.lit(""))
    return raw_pages.select("doc_id", "page_number", kept_boxes(text, F.col("boxes")).alias("boxes"))


def load_page_boxes(raw_pages: DataFrame) -> DataFrame:
    """IO-3 in long form: one row per readable box."""
    numbered = F.transform(F.col("boxes"), lambda b, i: F.struct(i.cast("int").alias("box_ord"), b.alias("b")))
    return inline_rows(load_pages(raw_pages), numbered, "doc_id", "page_number", key="box_ord").select(
        "doc_id", "page_number", "box_ord", "b.*")
