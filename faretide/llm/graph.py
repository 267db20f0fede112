"""Connected components of a link table, without moving links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretide.llm.frames import free, keep


def _roots(hooks: DataFrame, label: str) -> DataFrame:
    """Follow ``node -> parent`` (parents are smaller) to the root by doubling the steps."""
    while True:
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        stepped = keep(
            hooks.join(up, "parent", "left").select(
                "node",
                F.coalesce("above", "parent").alias("parent"),
                F.col("above").isNotNull().alias("moved"),
            ),
            label,
        )
        moved = stepped.filter("moved").limit(1).count()
        free(hooks.sparkSession, hooks)
        hooks = stepped.select("node", "parent")
        hooks._kept_path = stepped._kept_path
        if not moved:
            return hooks


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; component is its smallest node.

    Each round hooks every node to its smallest neighbour if that is smaller, contracts the
    trees that arise, and goes on with the links between different trees until there are none.
    Null ends and self-links are ignored.
    """
    left = keep(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    labels = None
    while left.limit(1).count():
        hooks = keep(
            left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "hooks"
        )
        hooks = _roots(hooks, "hooks")
        if labels is None:
            ends = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
            joined = ends.join(hooks, "node", "left").select(
                "node", F.coalesce("parent", "node").alias("component")
            )
        else:
            to = hooks.select(F.col("node").alias("component"), "parent")
            joined = labels.join(to, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            )
        fresh = keep(joined, "labels")
        a = hooks.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        b = hooks.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        ends = left.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")
        )
        after = keep(
            ends.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(),
            "links",
        )
        free(links.sparkSession, left, hooks, *([labels] if labels is not None else []))
        left, labels = after, fresh
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
