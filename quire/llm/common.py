"""Shared folders and small Column helpers of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: what separates words in every operator here.
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share; a session without it (tests) gets a local one set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="quire-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quire-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: later steps never recompute it, and a lost executor costs no earlier work."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Give back the room of stored tables that nothing reads any more: each is overwritten by an empty one."""
    for df in tables:
        files = df.inputFiles()
        if files:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def bounded(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """``df`` marked for broadcast where its measured size, as JSON, is at most ``limit`` bytes; else as it is, for a shuffled join."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def word_list(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
