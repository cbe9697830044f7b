"""Connected components of a link table, by minimum labels and pointer jumping; all of it in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, write_and_read


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b): label is the smallest node of its component.

    A round takes the smallest label among neighbours and then the label's own label, so that the rounds grow with the
    logarithm of a component's diameter. Each round is a table in the shared folder; only its number of changes comes
    to the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = write_and_read(both.distinct(), "edges")
    labels = write_and_read(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        of_low = labels.select(F.col("node").alias("low"), F.col("label").alias("of_low"))
        new = step.join(of_low, "low").select("node", F.least("low", "of_low").alias("label"), (F.least("low", "of_low") != F.col("label")).alias("changed"))
        new = write_and_read(new, "labels")
        remove(labels)
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            remove(edges)
            return labels
