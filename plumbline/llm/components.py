"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed

#: Rows of a task in a round.
ROWS_A_TASK = 200_000


def _in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """Few rows need few tasks and files a round."""
    return df.coalesce(max(1, rows // ROWS_A_TASK))


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """The labels (``node``, ``component``) of ``first``, relabelled by ``then``, and those of nodes that only ``then`` has."""
    after = then.select(F.col("node").alias("component"), F.col("component").alias("later"))
    moved = first.join(after, "component", "left").select("node", F.coalesce("later", "component").alias("component"))
    return moved.unionByName(then.join(first.select("node"), "node", "left_anti").select("node", "component"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node.

    ``edges`` has long columns ``a`` and ``b``; self-loops, repeats and either
    direction are fine. Returns ``node``, ``component``. In a round every node
    takes the smallest of itself and its neighbours as its parent, and jumps to
    its grandparent until it stands at a root. Edges move with their ends, and
    those inside one tree and repeats are dropped; at most half of the nodes are
    roots, so a round reads at most half of the nodes of the last. The smallest
    node of a component is always a root and names the component in the end.
    Labels never leave the executors; the driver sees one count a round.
    """
    left = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    rounds = []
    while rows := left.count():
        left = _in_few_tasks(left, rows)
        near = left.union(left.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        moved = checkpointed(_in_few_tasks(near.select("node", F.least("node", "near").alias("component")), rows))
        deep = True
        while deep:
            above = moved.select(F.col("node").alias("component"), F.col("component").alias("above"))
            jumped = moved.join(above, "component").select("node", F.col("above").alias("component"), (F.col("above") < F.col("component")).alias("deep"))
            jumped = checkpointed(_in_few_tasks(jumped, rows))
            deep = jumped.where("deep").limit(1).count() > 0
            moved = jumped.drop("deep")
        rounds.append(moved)
        ends = [moved.select(F.col("node").alias(x), F.col("component").alias(f"{x}_now")) for x in "ab"]
        left = left.join(ends[0], "a").join(ends[1], "b").where("a_now <> b_now")
        left = left.select(F.least("a_now", "b_now").alias("a"), F.greatest("a_now", "b_now").alias("b")).distinct()
        left = checkpointed(_in_few_tasks(left, rows))
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds.pop()
    while rounds:
        labels = composed(rounds.pop(), labels)
    return checkpointed(labels)
