"""Connected components by minimum labels with pointer jumping.

Labels and links stay distributed; each round is written to the shared folder.
A node with very many links is pre-aggregated by map-side combining, its links, slim
rows, can be split among tasks as in any sort-merge join, and no list of neighbours is
ever gathered. Labels only fall, and each round that changes none is the last, so
the rounds end; jumping halves the way to the smallest node in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, component, ...): the smallest node reachable."""
    both = C.saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = C.saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("seen"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        step = C.saved(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("component")), "hook")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = C.saved(step.join(jump, "component", "left").select("node", "was", F.least("component", "further").alias("component")), "labels")
        C.discard(step, labels)
        labels = new
        if not new.where("component < was").head(1):
            C.discard(both)
            return new
