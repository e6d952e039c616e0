"""Insertions behind insertions: a forest over the inserts of one batch (E-3, E-5).

A node is an insert; its parent is the insert whose row it stands behind, or none where it stands behind a stored element. Serving inserts one
by one puts each directly behind its anchor, so the final order is the forest's pre-order with later siblings first. Ancestors are followed by
pointer doubling, sizes of subtrees are added up along the same pointers, and siblings are summed in tiles: the number of jobs grows with the
logarithm of the depth, and no task holds a whole chain or all rows behind one anchor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.operators.scan import running, tile_of
from quire.session import stored


def _doubled(state: DataFrame, merge, name: str) -> DataFrame:
    """Repeat ``merge(open rows joined with the row their ``up`` names)`` until no row has an ``up``. Each round doubles the distance."""
    state = stored(state, name)
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(*[F.col(c).alias(f"_{c}") for c in state.columns])
        state = stored(merge(state, state.join(above, F.col("up") == F.col("_edit_seq"), "left")), name)
    return state


def resolve(inserts: DataFrame) -> DataFrame:
    """(edit_seq, parent, ok) -> (edit_seq, top, depth, whole): the outermost ancestor, the nodes down from there, and whether all of them are ok."""
    start = inserts.select("edit_seq", F.col("parent").alias("up"), F.col("edit_seq").alias("top"), F.lit(1).cast("long").alias("depth"), F.col("ok").alias("whole"))

    def merge(_, met):
        return met.select(
            "edit_seq", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            (F.col("whole") & F.coalesce("_whole", F.lit(True))).alias("whole"))

    return _doubled(start, merge, "forest").drop("up")


def _subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(edit_seq, size): the kept rows of a node and all below it."""
    def merge(state, met):
        # what the rows that point at a node have gathered so far, summed on the map side first, is new to that node
        gathered = state.where("up IS NOT NULL").groupBy(F.col("up").alias("_at")).agg(F.sum("size").alias("_more"))
        return met.join(gathered, F.col("edit_seq") == F.col("_at"), "left").select(
            "edit_seq", F.col("_up").alias("up"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))

    return _doubled(nodes.select("edit_seq", F.col("parent").alias("up"), F.col("weight").cast("long").alias("size")), merge, "forest-size").select("edit_seq", "size")


def linearise(nodes: DataFrame) -> DataFrame:
    """(edit_seq, anchor, parent, root_id, weight) -> (edit_seq, root_id, weight, place): kept rows of the same root that come before a node.

    ``anchor`` is the id of the row it stands behind, ``root_id`` that of the stored element above it, ``weight`` 0 for deleted rows and 1 for others.
    """
    sized = nodes.join(_subtree_sizes(nodes), "edit_seq")
    before = running(sized.select("edit_seq", "anchor", "size", (-F.col("edit_seq")).alias("_rev")), ["anchor"], ["_rev"], tile_of("_rev"),
                     sums={"before": F.col("size")}, inclusive=False)
    above = nodes.select(F.col("edit_seq").alias("parent"), F.col("weight").alias("_own"))
    steps = nodes.join(before.select("edit_seq", "before"), "edit_seq").join(above, "parent", "left").select(
        "edit_seq", F.col("parent").alias("up"), (F.col("before") + F.coalesce("_own", F.lit(0))).cast("long").alias("place"))

    def merge(_, met):
        return met.select("edit_seq", F.col("_up").alias("up"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"))

    return nodes.select("edit_seq", "root_id", "weight").join(_doubled(steps, merge, "forest-place").select("edit_seq", "place"), "edit_seq")
