"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Places that the nodes of one label are dealt to.
SALTS = 64


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of the links (a, b), the least node it reaches.

    Each round takes the least label among neighbours, then the label's own
    label. Tables stay distributed, and a round's table is written to the
    shared folder, so no lineage grows and lost executors cost one round.
    """
    shared_dir(links.sparkSession)
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("node"), "l").checkpoint()
    for _ in range(most_rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("l").alias("m"))
        low = label.join(near, label["node"] == near["a"], "left").select("node", "l", F.least("l", "m").alias("m"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("s"))
        # a label that many nodes have is looked up once for each salt, and meets them in as many places
        up = low.select(F.col("node").alias("m"), F.col("m").alias("__m"))
        jump = low.select("m", "s").distinct().join(up, "m")
        new = low.join(jump, ["m", "s"], "left").select("node", F.least("m", "__m").alias("l"), (F.col("l") != F.least("m", "__m")).alias("moved")).checkpoint()
        label = new.select("node", "l")
        if not new.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return label.select("node", F.col("l").alias("component"))
