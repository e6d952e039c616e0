"""Incremental intake is idempotent; the model stage survives failures."""

import tempfile

import pytest
from pyspark.sql import functions as F

from quire.operators.drafting import infer
from quire.operators.segment import structure
from quire.plans.corpus import process_corpus
from quire.plans.derived import paper_docs
from quire.sources import snapshots
from quire.sources.snapshots import read_elements, vacuum, write_elements, written_documents
from quire.sources.views import write_stages
from quire.operators.building import normalize_heading_levels
from quire.streaming.intake import ingest_stream, read_intake

from conftest import DATA


def test_ingest_runs_once_per_document(spark, tmp_path):
    base = str(tmp_path)
    docs = paper_docs(spark, DATA)
    odd = spark.createDataFrame([(1000, None), (1001, " \n "), (None, "text"), (1002, "Some plain words that stand alone. " * 5)], "doc_id long, markdown string")
    docs.where("doc_id < 40").unionByName(odd).coalesce(2).write.parquet(f"{base}/in")
    for _ in range(2):
        ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/cp", files_per_batch=1).awaitTermination()
    docs.where("doc_id >= 20 and doc_id < 60").coalesce(1).write.mode("append").parquet(f"{base}/in")
    ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/cp").awaitTermination()
    papers = {r.doc_id: r.parse_status for r in read_intake(spark, f"{base}/out", "papers").collect()}
    assert read_intake(spark, f"{base}/out", "papers").count() == len(papers) == 63
    assert papers[1000] == papers[1001] == "failed" and papers[1002] == "processed"
    batch = normalize_heading_levels(process_corpus(docs.where("doc_id < 60").unionByName(odd.where("doc_id = 1002"))))
    rows = lambda df: sorted(map(str, df.select("doc_id", "element_index", "type", "level", "section_title", "text", "summary").collect()))
    assert rows(read_intake(spark, f"{base}/out", "elements")) == rows(batch)
    assert read_intake(spark, f"{base}/out", "overviews").count() == batch.select("doc_id").distinct().count()


def test_a_broken_batch_is_not_seen(spark, tmp_path, monkeypatch):
    """A batch that stops before its commit shows nothing, and the next run of the stream does it once."""
    from quire.streaming import intake

    base, plain = str(tmp_path), intake._tables
    paper_docs(spark, DATA).where("doc_id < 4").coalesce(1).write.parquet(f"{base}/in")

    def broken(*args):
        tables = plain(*args)
        tables["overviews"] = tables["overviews"].select(F.raise_error(F.lit("lost")).alias("x"))
        return tables

    monkeypatch.setattr(intake, "_tables", broken)
    with pytest.raises(Exception):
        ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/cp").awaitTermination()
    with pytest.raises(ValueError):
        read_intake(spark, f"{base}/out", "elements")
    monkeypatch.setattr(intake, "_tables", plain)
    ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/cp").awaitTermination()
    assert read_intake(spark, f"{base}/out", "papers").count() == 4


def test_infer_isolates_a_bad_prompt(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [("{}", 1, 1) for _ in prompts]

    rows = infer(spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "doc_id long, prompt string").coalesce(1), model, attempts=2, pause=0.0).collect()
    assert {r.doc_id: r.error is None for r in rows} == {1: True, 2: False, 3: True}


def test_process_corpus_numbers_densely(spark):
    elements = process_corpus(paper_docs(spark, DATA))
    bounds = elements.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("element_index").alias("m"), F.countDistinct("element_index").alias("d"))
    assert bounds.where("n <> m + 1 or n <> d").count() == 0


def test_writers(spark):
    base = tempfile.mkdtemp(prefix="quire-write-")
    st = structure(paper_docs(spark, DATA).where("doc_id < 10"))
    write_stages(st, f"{base}/stages")
    assert {r.stage for r in spark.read.json(f"{base}/stages").select("stage").distinct().collect()} >= {"raw_blocks", "chunks", "sections"}
    rows = spark.createDataFrame([(1, 0, "paragraph", "t", None, None)], "doc_id long, element_index int, type string, text string, intro_text string, items array<string>")
    for text in ("a", "b"):
        write_elements(rows.withColumn("text", F.lit(text)), f"{base}/elements")
    assert [r.content for r in read_elements(spark, f"{base}/elements").collect()] == ["b"]


def small_elements(spark):
    return spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("element_index"), F.lit("paragraph").alias("type"), F.lit("old").alias("text"),
                                   F.lit(None).cast("string").alias("intro_text"), F.lit(None).cast("array<string>").alias("items"))


def test_writing_one_document_leaves_the_others(spark, tmp_path):
    path, rows = f"{tmp_path}/elements", small_elements(spark)
    assert write_elements(rows, path, buckets=4) == 0
    assert write_elements(rows.where("doc_id = 7").withColumn("text", F.lit("new")).withColumn("more", F.lit(1)), path, buckets=9) == 1
    assert write_elements(rows.limit(0), path, documents=spark.createDataFrame([(8,), (500,), (None,)], "doc_id long")) == 2
    read = lambda v=None: {r.doc_id: r.content for r in read_elements(spark, path, v).collect()}
    assert read() == {i: "new" if i == 7 else "old" for i in range(100) if i != 8}
    assert read(0) == dict.fromkeys(range(100), "old") and read(1)[8] == "old"
    assert sorted(r.doc_id for r in written_documents(spark, path).collect()) == [*range(100), 500]
    assert any("staged" in f for f in vacuum(spark, path, keep=1)) and vacuum(spark, path, keep=1) == []
    assert read() == {i: "new" if i == 7 else "old" for i in range(100) if i != 8}


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("step", ["_stage", "_merge", "_commit"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_broken_write_loses_nothing(spark, tmp_path, monkeypatch, first, step, when):
    """A write that stops between any two steps leaves the version before it, and doing it again ends it."""
    path, rows = f"{tmp_path}/elements", small_elements(spark)
    if not first:
        write_elements(rows, path, buckets=3)
    plain = getattr(snapshots, step)

    def broken(*args):
        if when == "after":
            plain(*args)
        raise KeyboardInterrupt

    new = rows.where("doc_id % 10 = 7").withColumn("text", F.lit("new"))
    monkeypatch.setattr(snapshots, step, broken)
    with pytest.raises(KeyboardInterrupt):
        write_elements(new, path, buckets=3)
    monkeypatch.setattr(snapshots, step, plain)
    done = step == "_commit" and when == "after"
    old = {} if first else dict.fromkeys(range(100), "old")
    want = old | {i: "new" for i in range(7, 100, 10)}
    if first and not done:
        with pytest.raises(ValueError):
            read_elements(spark, path)
    else:
        assert {r.doc_id: r.content for r in read_elements(spark, path).collect()} == (want if done else old)
    write_elements(new, path, buckets=3)
    assert {r.doc_id: r.content for r in read_elements(spark, path).collect()} == want


def test_two_writers_are_noticed(spark, tmp_path):
    path, rows = f"{tmp_path}/elements", small_elements(spark)
    write_elements(rows, path, buckets=2)
    for write in ("a", "b"):
        snapshots._commit(spark, snapshots._manifest(spark, path, 0), set(), path, write, 2)
    with pytest.raises(RuntimeError):
        read_elements(spark, path)


def test_new_rows_are_written_once_and_old_ones_not_shuffled(spark, tmp_path):
    """New rows go straight to their place; old ones, also of another type, are carried beside them."""
    path, rows = f"{tmp_path}/elements", small_elements(spark)
    write_elements(rows, path, buckets=2)
    assert write_elements(rows.where("doc_id = 7").withColumn("element_index", F.lit(1 << 40)), path) == 1
    staged = [f.name for f in (tmp_path / "elements" / "staged").glob("*/*")]
    assert staged == ["docs", "docs"]
    got = {r.doc_id: r.element_index for r in read_elements(spark, path).collect()}
    assert got == {i: 1 << 40 if i == 7 else 0 for i in range(100)}
