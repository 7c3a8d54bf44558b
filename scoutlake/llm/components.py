"""Connected components of a table of links, by least labels, in Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutlake.llm import shared


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that the node can reach over links (a, b), for every node in a link.

    Each round a node takes the least label beside it, then its label's own label, so long chains halve. Each round ends
    in a written table; only the number of changed labels comes to the driver.
    """
    links = links.select("a", "b").filter("a <> b")
    both = shared.written(links.union(links.select("b", "a")).distinct(), "links")
    labels = shared.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        sent = shared.checked_broadcast(labels)  # while few, labels go to the links; else both are shuffled
        near = both.join(sent, both["b"] == sent["node"]).groupBy(F.col("a").alias("near_node")).agg(F.min("root").alias("near"))
        took = labels.join(near, F.col("node") == F.col("near_node"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("new"))
        up = sent.select(F.col("node").alias("up_node"), F.col("root").alias("up"))
        after = took.join(up, F.col("new") == F.col("up_node"), "left").select("node", F.least("new", F.coalesce("up", "new")).alias("root"), "old")
        after = shared.written(after, "labels")
        if not after.filter("root <> old").limit(1).count():
            return after.select("node", "root")
        labels = after.select("node", "root")
