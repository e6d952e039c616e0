"""A training corpus from raw documents, in five stages; each reads what the last one kept and is stored before the next.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. Input columns travel as one struct beside what an operator
reads, so extra columns, also ones named like an operator's results, come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import mixing, nearjoin, pieces, quality, substrings
from quire.llm.common import stored, table
from quire.llm.queries import tokenizer_path


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned list. NULL and short texts fail the base rule."""
    judged = quality.judged(_carried(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    # pushed below the statistics, the filter would compute them once for every use in the rules; an id holds it above
    kept = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return judged.select("_row", kept.alias("kept")).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest doc_id, once.

    Documents without doc_id cannot be named; one per text stays.
    """
    stay = nearjoin.join(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias("_stay"))
    whole = docs.join(stay, docs["doc_id"] == F.col("_stay"), "left_semi").dropDuplicates(["doc_id"])
    return whole.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; n_chars follows the text."""
    cut = substrings.deduplicate(_carried(docs, "doc_id", "text"))
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[columns.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(_carried(docs, "doc_id", "source", "text")).select("_row.*")


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts; repeated documents give repeated rows."""
    return pieces.round_trip(docs.select("doc_id", "source", "lang", "text"), tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing_weights", mixing_weights),
    ("piece_encoding", piece_encoding),
]

#: Learned rules and the tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
