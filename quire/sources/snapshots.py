"""Versioned element table (IO-6): immutable bucket files, a manifest per version, one atomic step between versions.

A table is a folder with

* ``data/<write>/doc_bucket=<k>`` - the element rows of a bucket of documents as one write left them; never changed afterwards;
* ``docs/<write>/doc_bucket=<k>`` - the documents that have been written to the bucket, also those without elements;
* ``manifests/version=<n>`` - one small file that names the write that holds each bucket.

The newest manifest is the table. A write reads only the buckets it touches, writes them anew under a name of its own and then adds the manifest,
which is a single file and so appears whole or not at all. Whatever breaks off before leaves the old version as it was and some files that no
manifest names (``vacuum`` removes them); doing the write again starts from the same version. One writer at a time: if two have added the same
version, the next use of the table reports it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quire.operators.edits import with_content

MANIFEST = "version int, write string, buckets int, bucket int, holder string"
#: Rows of a document that one task writes at most, in elements.
SLICE = 1 << 20


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The rows of the newest (or given) manifest; one row per bucket, so their number is bounded by the number of buckets."""
    try:
        every = spark.read.schema(MANIFEST).parquet(f"{path}/manifests")
    except AnalysisException:
        return []
    newest = every.where(F.col("version") == version) if version is not None else every.join(every.select(F.max("version").alias("version")), "version")
    rows = newest.collect()
    if len({r["write"] for r in rows}) > 1:
        raise RuntimeError(f"{path}: two writers have added version {rows[0]['version']}")
    return rows


def bucket_of(doc: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")


def _folders(rows: list, path: str, part: str, touched: set[int] | None = None) -> list[str]:
    return [f"{path}/{part}/{r['holder']}/doc_bucket={r['bucket']}" for r in rows if r["bucket"] is not None and (touched is None or r["bucket"] in touched)]


def _read(spark: SparkSession, rows: list, path: str, part: str, touched: set[int] | None = None) -> DataFrame | None:
    """Buckets that hold no row of a part have no folder there."""
    holders = {r["holder"] for r in rows if r["bucket"] is not None and (touched is None or r["bucket"] in touched)}
    wanted = set(_folders(rows, path, part, touched))
    found = []
    for holder in sorted(holders):
        try:
            base = spark.read.option("mergeSchema", "true").parquet(f"{path}/{part}/{holder}")
        except AnalysisException:
            continue
        own = [r["bucket"] for r in rows if r["holder"] == holder and f"{path}/{part}/{holder}/doc_bucket={r['bucket']}" in wanted]
        found.append(base.where(F.col("doc_bucket").isin(own)))
    out = None
    for df in found:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_elements(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The element rows of the newest (or a given) version."""
    rows = _manifest(spark, path, version)
    found = _read(spark, rows, path, "data")
    if found is None:
        raise ValueError(f"{path} holds no elements" + ("" if version is None else f" of version {version}"))
    return found.drop("doc_bucket")


def written_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id) of all documents that have been written, also of those without elements."""
    found = _read(spark, _manifest(spark, path), path, "docs")
    return spark.createDataFrame([], "doc_id long") if found is None else found.select("doc_id")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a bucket together, in parts of a size that a task writes without spilling; a long document goes to several."""
    return rows.withColumn("_slice", F.floor(F.col("element_index") / SLICE)).hint("rebalance", "doc_bucket", "_slice").drop("_slice")


def _put(rows: DataFrame, path: str, write: str) -> None:
    rows.write.mode("append").option("compression", "zstd").partitionBy("doc_bucket").parquet(f"{path}/data/{write}")


def _stage(elements: DataFrame, documents: DataFrame | None, old: list, path: str, write: str, buckets: int) -> tuple[StructType, DataFrame]:
    """Evaluate the input once: its rows to where they will stay, under the name of this write, and the documents it replaces beside them.

    Columns that old rows have in another type get the type both fit in, which is returned with the others.
    """
    spark = elements.sparkSession
    rows = with_content(elements)
    before = _read(spark, old, path, "data")
    schema = (rows if before is None else rows.limit(0).unionByName(before.drop("doc_bucket").limit(0), allowMissingColumns=True)).schema
    rows = rows.select(*[F.col(f"`{c}`").cast(schema[c].dataType).alias(c) for c in rows.columns])
    _put(_dealt(rows.withColumn("doc_bucket", bucket_of(F.col("doc_id"), buckets))), path, write)
    ids = spark.read.schema(StructType([schema["doc_id"]])).parquet(f"{path}/data/{write}").distinct()
    if documents is not None:
        ids = ids.unionByName(documents.select("doc_id").where("doc_id IS NOT NULL")).distinct()
    ids.withColumn("doc_bucket", bucket_of(F.col("doc_id"), buckets)).write.parquet(f"{path}/staged/{write}/docs")
    return schema, spark.read.parquet(f"{path}/staged/{write}/docs")


def _merge(schema: StructType, ids: DataFrame, old: list, touched: set[int], path: str, write: str, small: int = 1 << 21) -> None:
    """What stays in the touched buckets, beside the new rows. Up to ``small`` replaced ids go to the tasks, and old rows are not shuffled."""
    spark = ids.sparkSession
    known = _read(spark, old, path, "docs", touched)
    every = ids if known is None else ids.unionByName(known.join(ids.select("doc_id"), "doc_id", "left_anti"), allowMissingColumns=True)
    every.repartition(max(len(touched), 1), "doc_bucket").write.partitionBy("doc_bucket").parquet(f"{path}/docs/{write}")
    stay = _read(spark, old, path, "data", touched)
    if stay is not None:
        narrow = ids.count() <= small
        gone = ids.select("doc_id")
        stay = stay.join(F.broadcast(gone) if narrow else gone, "doc_id", "left_anti")
        stay = spark.createDataFrame([], schema).withColumn("doc_bucket", F.lit(0)).unionByName(stay, allowMissingColumns=True)
        _put(stay if narrow else _dealt(stay), path, write)


def _commit(spark: SparkSession, old: list, touched: set[int], path: str, write: str, buckets: int) -> int:
    """Add the next manifest."""
    version = old[0]["version"] + 1 if old else 0
    kept = [(write, buckets, r["bucket"], r["holder"]) for r in old if r["bucket"] is not None and r["bucket"] not in touched]
    rows = kept + [(write, buckets, b, write) for b in sorted(touched)] or [(write, buckets, None, None)]
    table = spark.createDataFrame(rows, "write string, buckets int, bucket int, holder string")
    table.coalesce(1).write.mode("append").parquet(f"{path}/manifests/version={version}")
    return version


def write_elements(elements: DataFrame, path: str, documents: DataFrame | None = None, buckets: int = 256) -> int:
    """IO-6: replace the rows of the documents in ``elements``, and of all in ``documents`` (``doc_id``), which may have none left; returns the version.

    All other documents stay. The number of buckets is set by the first write (about one file of useful size per bucket).
    """
    spark = elements.sparkSession
    old, write = _manifest(spark, path), uuid.uuid4().hex
    buckets = old[0]["buckets"] if old else buckets
    schema, ids = _stage(elements, documents, old, path, write, buckets)
    touched = {r["doc_bucket"] for r in ids.select("doc_bucket").distinct().collect()}
    _merge(schema, ids, old, touched, path, write)
    return _commit(spark, old, touched, path, write, buckets)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove what the newest ``keep`` versions do not name, older manifests first; returns the removed folders. Not while a write is running."""
    try:
        every = spark.read.schema(MANIFEST).parquet(f"{path}/manifests")
    except AnalysisException:
        return []
    versions = sorted(r["version"] for r in every.select("version").distinct().collect())
    named = {r["holder"] for r in every.where(F.col("version").isin(versions[-keep:])).select("holder").distinct().collect()}
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *names]))
    old = [at("manifests", f"version={v}") for v in versions[:-keep]]
    for part in ("staged", "data", "docs"):
        if files.exists(at(part)):
            old += [s.getPath() for s in files.listStatus(at(part)) if part == "staged" or s.getPath().getName() not in named]
    for folder in old:
        files.delete(folder, True)
    return [folder.toString() for folder in old]
