"""Connected components of a table of links, by label propagation with
pointer jumping: every step is a join and a partial minimum, written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, write_table


def components(links: DataFrame) -> DataFrame:
    """``links``: ``x, y`` (long).  ``row, label``: the smallest row of the
    component, for every row with a link."""
    both = links.select(F.col("x").alias("row"), F.col("y").alias("other")).unionByName(
        links.select(F.col("y").alias("row"), F.col("x").alias("other")))
    edges = write_table(both.distinct(), "links")
    labels = write_table(
        edges.groupBy("row").agg(F.min("other").alias("m")).select("row", F.least("row", "m").alias("label")), "labels")
    while True:
        near = (
            edges.join(labels.withColumnsRenamed({"row": "other", "label": "seen"}), "other")
            .groupBy("row").agg(F.min("seen").alias("seen")))
        lower = labels.join(near, "row").select("row", "label", F.least("label", "seen").alias("new"))
        lower = write_table(lower, "labels")
        # Jump: take over the label that one's label has now.
        jump = lower.select(F.col("row").alias("new"), F.col("new").alias("far"))
        after = write_table(
            lower.join(jump, "new", "left").select("row", "label", F.least("new", F.coalesce("far", "new")).alias("new")),
            "labels")
        changed = after.where("new != label").limit(1).count()
        drop_tables(lower, labels)
        labels = after.select("row", F.col("new").alias("label"))
        if not changed:
            drop_tables(edges)
            return labels
