"""Connected components of a table of edges, by labels that fall to the least neighbour's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (x, y): the smallest node reachable.

    Each round takes the least label of all neighbours, then that label's own label, so
    chains shrink by jumps. Least labels are pre-aggregated before the shuffle. Ends when
    no label changes; no links or labels come to the driver.
    """
    both = materialize(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    labels = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("m"))
        stepped = labels.join(near, "x").select("x", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("x").alias("m"), F.col("l").alias("j"))
        new = materialize(stepped.join(jump, "m").select("x", F.least("m", "j").alias("n"), (F.least("m", "j") < F.col("l")).alias("moved")))
        labels = new.select("x", F.col("n").alias("l"))
        if new.where("moved").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("l").alias("component"))
