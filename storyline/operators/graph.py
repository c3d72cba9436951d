"""Graph operators over edge tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the shared folder (spark.checkpoint.dir; a local one only where unset)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or os.environ.get("STORYLINE_CHECKPOINTS")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.environ.setdefault("STORYLINE_CHECKPOINTS", tempfile.mkdtemp(prefix="storyline-")))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where a small table has fewer; large ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node and component (the smallest node reachable) for edges (left, right), by smallest neighbours with jumps.

    Every round halves the distance to the smallest node about, and ends in a checkpoint.
    Rounds go on until nothing changes; if ``rounds`` of them don't suffice, an error is raised.
    """
    both = edges.select("left", "right").unionByName(edges.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("left").agg(F.least(F.min("right"), F.col("left")).alias("component")).withColumnRenamed("left", "node"))
    done = 0
    while rounds is None or done < rounds:
        done += 1
        near = both.join(labels.select(F.col("node").alias("right"), "component"), "right").groupBy("left").agg(F.min("component").alias("c"))
        step = labels.join(near.withColumnRenamed("left", "node"), "node").select("node", F.least("component", "c").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = checkpointed(step.join(jump, "component").select("node", F.least("component", "further").alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was")
        labels_before, labels = labels, after
        if changed.isEmpty():
            return labels_before
    raise RuntimeError(f"components haven't settled in {rounds} rounds")


def pair_quality(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs wrongly merged and split, and precision, recall and F1 (as integers in millionths) of pairs in equal clusters, against gold clusters.

    Both have (id, cluster).  Counted from the sizes of the clusters and their
    intersections; no pair is ever formed.
    """
    both = predicted.select("id", F.col("cluster").alias("p")).join(gold.select("id", F.col("cluster").alias("g")), "id")
    pairs = lambda *by: both.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("k"))
    joined = pairs("p", "g").withColumnRenamed("k", "both").crossJoin(pairs("p").withColumnRenamed("k", "predicted")).crossJoin(pairs("g").withColumnRenamed("k", "gold"))
    share = lambda a, b: F.when(F.col(b) == 0, F.lit(1000000)).otherwise(F.floor(F.col(a) * 1000000 / F.col(b))).cast("long")
    f1 = F.when(F.col("predicted") + F.col("gold") == 0, F.lit(1000000)).otherwise(F.floor(F.col("both") * 2000000 / (F.col("predicted") + F.col("gold")))).cast("long")
    false = lambda a: (F.col(a) - F.col("both")).cast("long")
    return joined.select("both", "predicted", "gold", false("predicted").alias("false_merges"), false("gold").alias("false_splits"), share("both", "predicted").alias("precision"), share("both", "gold").alias("recall"), f1.alias("f1"))
