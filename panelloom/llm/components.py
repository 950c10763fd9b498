"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import Steps


def components(links: DataFrame, steps: Steps, label: str) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``: the smallest node reachable.

    Each round points every node at its smallest neighbour (or itself) and moves the links'
    ends along the pointers; loops go. The smallest node of a component points at itself, so
    it remains. Distances shrink by half or more per round, and a star is done in one. The
    pointers of all rounds, composed, give the labels. All of it stays in stored tables.
    """
    edges = links.filter("a <> b")
    pointers: list[DataFrame] = []
    for number in range(64):
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        point = steps.keep(
            both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")),
            f"{label}-point{number}",
            free=False,
        )
        pointers.append(point)
        left = point.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = point.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = (
            edges.join(left, "a").join(right, "b").select(
                F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")
            ).filter("a <> b").distinct()
        )
        edges = steps.keep(moved, f"{label}-edges{number}", free=False)
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("links are left after 64 rounds of contraction")
    found = pointers[0].select("node", F.col("to").alias("component"))
    for point in pointers[1:]:
        step = point.select(F.col("node").alias("component"), "to")
        found = found.join(step, "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
    return found
