"""Lineage cuts, row numbers and connected components for operators that go in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, as the context has it; all machines share it.

    Where none is named, a local session (as in tests) gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and return it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``, their place in order, from 0, by range partitions and one count of each.

    No window over all rows: only the counts pass through the driver.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = sorted((r["part"], r["count"]) for r in held.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = F.broadcast(held.sparkSession.createDataFrame(starts, "_part long, _start long"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_start") + within).drop("_part", "_start", "_place")


def components(edges: DataFrame, a: str = "src", b: str = "dst", rounds: int = 100) -> DataFrame:
    """``node, component``: the smallest node that each node of the undirected edges is joined with.

    Rounds of two steps: every node hands its smallest neighbour to its larger ones, then the smallest to all that are not
    larger (large and small stars; Kiveris and others, 2014), until no edge changes. A node's neighbours meet in aggregates
    and joins alone, and rounds grow with the logarithm of the longest way.
    """
    links = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            nodes = edges.select(F.col(a).alias("node")).union(edges.select(b)).distinct()
            return nodes.join(links.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
        mark = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        links = cut(small.where("u <> v").distinct())
    raise RuntimeError("components did not settle")
