"""Reachability over edge tables and parent links that are too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.session import cut, stored


def impact(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything downstream of ``roots``: ``node`` and ``depth``, the length of the shortest way.

    ``edges`` has ``src`` and ``dst``, ``roots`` has ``node``. Only the newest layer is
    joined in each round, each node is kept once, and the pairs of a full closure
    are never formed. Layers lie in the shared folder, so a lost executor costs no
    earlier round. Cycles end by themselves; the roots are not part of the result
    unless an edge leads back to them.
    """
    # Every round reads the edges again, so what they are made of is computed once.
    links = stored(edges.select("src", "dst").distinct(), "edges")
    frontier = roots.select("node").distinct()
    seen: DataFrame | None = None
    depth = 0
    while True:
        depth += 1
        reached = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        if seen is not None:
            reached = reached.join(seen.select("node"), "node", "left_anti")
        layer = cut(reached.withColumn("depth", F.lit(depth).cast("bigint")))
        if layer.isEmpty():
            return layer if seen is None else seen
        seen = layer if seen is None else seen.unionByName(layer)
        frontier = layer.select("node")


def ancestors(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """The commits behind each ref: ``ref``, ``commit_id`` and ``distance`` from the head (0).

    ``commits`` has ``commit_id`` and ``parent`` (null at a root), ``heads`` has ``ref``
    and ``commit_id``. The parent links double their reach in every round, so a
    history of n commits takes log2(n) joins. Links that lead in a circle end, too: a commit is reached once.
    """
    jump = commits.select("commit_id", "parent").filter(F.col("parent").isNotNull())
    reach = heads.select("ref", "commit_id", F.lit(0).cast("bigint").alias("distance"))
    step = 1
    while True:
        further = reach.join(jump, "commit_id").select("ref", F.col("parent").alias("commit_id"), (F.col("distance") + step).alias("distance"))
        further = cut(further.join(reach.select("ref", "commit_id"), ["ref", "commit_id"], "left_anti"))
        if further.isEmpty():
            return reach
        reach = reach.unionByName(further)
        if jump.isEmpty():
            return reach
        onward = jump.select(F.col("commit_id").alias("parent"), F.col("parent").alias("_next"))
        jump = cut(jump.join(onward, "parent").select("commit_id", F.col("_next").alias("parent")))
        step *= 2
