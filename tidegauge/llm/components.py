"""Connected components of a link table by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs); the root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows one more hook,
    and links the merged nodes instead of the old ones. A node that is not smaller
    than all its neighbours disappears, so the rounds are logarithmic in the longest
    path. Minima are combined map-side, so a node with many links is no large group.
    Nothing is collected; the loop only asks whether links are left. Loops and
    repeated links are ignored; an empty table gives an empty table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = stored(both.where("a <> b").distinct(), "links")
    merged: DataFrame | None = None
    while not left.isEmpty():
        hook = left.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("parent"))
        hook = stored(hook, "hook")
        above = hook.select(F.col("a").alias("parent"), F.col("parent").alias("above"))
        step = stored(hook.join(above, "parent").select("a", F.col("above").alias("parent")), "step")
        ends = step.select(F.col("a").alias("b"), F.col("parent").alias("parent_b"))
        left = stored(
            left.join(step, "a")
            .join(ends, "b")
            .where("parent <> parent_b")
            .select(F.col("parent").alias("a"), F.col("parent_b").alias("b"))
            .distinct(),
            "links",
        )
        if merged is None:
            merged = step.select(F.col("a").alias("node"), F.col("parent").alias("root"))
        else:
            later = step.select(F.col("a").alias("root"), F.col("parent").alias("later"))
            merged = stored(
                merged.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")), "merged"
            )
    if merged is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return merged
