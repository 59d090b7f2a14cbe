"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ciphersift.llm.common import scratch_path, drop_path


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links(src, dst)``; component is its smallest reachable node.

    Each round takes the least label among a node and its neighbours and then
    the label of that label, so long chains shrink quickly.  Labels live in the
    shared checkpoint folder; the driver only reads how many changed.
    """
    spark = links.sparkSession
    both_path = scratch_path(spark, "links")
    (links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
     .distinct().write.parquet(both_path))
    both = spark.read.parquet(both_path)

    old_path = None
    path = scratch_path(spark, "labels")
    (both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component"))
     .withColumn("changed", F.lit(True)).write.parquet(path))
    for _ in range(rounds):
        labels = spark.read.parquet(path)
        if not labels.filter("changed").limit(1).count():
            break
        own = labels.select("node", "component")
        near = (both.join(own.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("c").alias("near")))
        least = own.join(near, "node").select("node", F.col("component").alias("was"),
                                              F.least("component", "near").alias("component"))
        jump = own.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        nxt = least.join(jump, "component", "left").select(
            "node", F.least("component", "jump").alias("component"),
            (F.least("component", "jump") != F.col("was")).alias("changed"))
        new_path = scratch_path(spark, "labels")
        nxt.write.parquet(new_path)
        if old_path:
            drop_path(spark, old_path)
        old_path, path = path, new_path
    else:
        raise RuntimeError("components did not settle")
    drop_path(spark, both_path)
    if old_path:
        drop_path(spark, old_path)
    return spark.read.parquet(path).select("node", "component")
