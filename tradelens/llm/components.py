"""Connected components of a table of links, by hooking to smaller labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.shared import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each end of links (a, b), the smallest end that links reach from it.

    Every round hooks labels to the smallest label beside them and halves the paths that arise, so rounds grow with the
    logarithm of a component's width. Each round is cut; only the number of changes comes to the driver.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    edges = cut(both.filter("node <> other").distinct())
    labels = edges.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label"))
    labels = cut(labels)
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        # the smallest label beside a node is offered to the node and to the label that it has now
        offers = edges.join(theirs, "other").groupBy("node").agg(F.min("near").alias("near")).join(labels, "node")
        offered = offers.select("node", "near").unionByName(offers.filter("near < label").select(F.col("label").alias("node"), "near"))
        best = offered.groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(best, "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jumped = cut(hooked.join(jump, "next", "left").select("node", "label", F.least("next", "far").alias("next")))
        changed = jumped.filter("next < label").limit(1).count()
        labels = jumped.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
