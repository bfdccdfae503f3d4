"""Tables written in the folder that all machines share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (as in tests on one machine) a folder of our own, which only one machine sees."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, large: bool = True) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    spark = df.sparkSession
    del df
    if large:  # shuffle files of what was written go when the JVM finds them unreachable
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node of its connected component. Nodes are of any type that has an order.

    Alternating large and small stars, each written to the shared folder. The number of rounds grows
    with the logarithm of the largest component. Only minima are gathered, never the neighbours of a node; minima are dealt anew
    before they are joined, so that Spark can split the edges of a node that many share.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # grouped by a struct, so that the join below needs an exchange of its own on either side
    minima = lambda e: e.groupBy(F.struct("a").alias("k")).agg(F.min("b").alias("m")).select(F.col("k.a").alias("a"), "m")
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), large=False)
    while True:
        # stars are done: no node has two edges down, and none has both an edge down and one up
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("b", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("n").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or (down > 0 and up > 0)")
        if open_.isEmpty():
            break
        s = both(e)
        least = minima(s).select("a", F.least("m", "a").alias("m"))
        large = written(s.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), large=False)
        down = minima(large)
        # one row for each edge and its target, exploded: the join is made once
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        e = written(large.join(down, "a").select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct(), large=False)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
