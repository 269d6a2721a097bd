"""Connected components of a link table by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def contract(edges: DataFrame) -> DataFrame:
    """Fewer ``edges(a, b)`` of the same components: ``a`` keeps its smallest ``b``, to which its others link.

    An ``a`` may have only a bounded number of different ``b``; a ``b`` may have any number of ``a``.
    """
    met = edges.where("a <> b").select("a", "b").distinct().groupBy("a").agg(F.collect_set("b").alias("met"))
    met = materialize(met.withColumn("hook", F.array_min("met")), "met")
    others = met.select(F.explode("met").alias("a"), F.col("hook").alias("b")).where("a <> b")
    return met.select("a", F.col("hook").alias("b")).union(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(id, label)``: the smallest id that each end reaches.

    Each round takes the smallest label among the neighbours (aggregated before the shuffle, so a
    hub with a third of all links costs one row a task) and then the label of the label.  Rounds
    grow with the logarithm of the longest path; each is written to the shared folder.
    """
    both = edges.where("a <> b").select("a", "b")
    both = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("hook"))
        target = labels.select(F.col("id").alias("hook"), F.col("label").alias("jump"))
        labels = materialize(hooked.join(target, "hook").select("id", F.least("hook", "jump").alias("label"), (F.least("hook", "jump") < F.col("old")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("id", "label")
        labels = labels.select("id", "label")
