"""Connected components by alternating star contraction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder that the session names for what driver and executors share. A session on one machine gets one of its own
    where none is named; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which is deleted when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/edges-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


#: Nodes with their least neighbours that may be broadcast; beyond it the joins below are shuffled.
BROADCAST_NODES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """From (u, v) edges: (node, root), root being the smallest node reachable; nodes without an edge and roots are absent.
    A round links every neighbour to the least node around (two group minima and the joins back), so no node's neighbours
    are gathered, and the number of rounds grows with the logarithm of the longest path. Rounds end when each node is
    either a root or a leaf with one edge."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        rows, most = ends.agg(F.sum("up"), F.max(F.col("up") + F.col("down"))).first()
        if not rows or most == 1:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        side = F.broadcast if 2 * rows <= BROADCAST_NODES else lambda x: x
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        far = both.where("v > u").join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(side(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
