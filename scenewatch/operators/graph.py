"""Connected components of a graph given as links, by alternating large and small stars; and cut lineage."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one set in spark.checkpoint.dir.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster that is an error, since executors
    could not read it.
    """
    context = spark.sparkContext
    if found := context.getCheckpointDir():
        return found
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder by checkpoint(), so that later steps neither recompute it nor hang on executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Has Spark delete what nothing refers to any more, shuffle files above all: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of links (a, b) with the least node of its component; nodes of any ordered type.

    A large star ties each node's greater neighbours to its least neighbour, a small star ties its lesser neighbours
    and itself to the least of them. Both keep the components; the number of links never grows beyond the first, and
    the rounds grow with the logarithm of the longest path. Links of a node to itself are ignored, null ends dropped.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        ends = F.explode(F.array(F.struct("m", F.col("a").alias("x")), F.struct("m", F.col("b").alias("x"))))
        small = large.join(low, "b").select(ends.alias("e")).select(F.col("e.m").alias("a"), F.col("e.x").alias("b"))
        edges = cut(small.where("a < b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root").unionByName(roots)
