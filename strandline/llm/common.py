"""Helpers shared by the corpus operators: table reading, lineage cuts, row numbers, spread and lookup joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder; read by Spark only, so any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``).

    Where none is named, a local session (as in tests) gets a temporary one; on a cluster that is an error, as a
    folder of one machine would not be seen by the others.
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
    """Materialise ``df`` once in the shared checkpoint folder and return it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder: for wide rows, smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the table that ``written`` made for ``df``; nothing may read it afterwards."""
    spark = df.sparkSession
    root = shared_folder(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in folder and folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """``ordered`` (range-partitioned and sorted) with ``name``, the place of each row in the whole order, from 0.

    The rows are materialised once; only one count for each partition passes through the driver.
    """
    held = cut(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = sorted(held.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for r in counts:
        starts.append((r["part"], total))
        total += r["count"]
    offsets = held.sparkSession.createDataFrame(starts, "_part long, _start long")
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + within).drop("_part", "_start", "_place")


def spread_join(rows: DataFrame, values: DataFrame, on: list[str], share: str = "share") -> DataFrame:
    """``rows`` joined to ``values`` (few for each key) so that the rows of a common key spread over tasks.

    The values go to the distinct pairs of key and share first, of which a key has no more than there are shares, and
    from these to the rows. ``share`` is a column of the rows that must not change if they are computed again.
    """
    pairs = rows.select(*on, share).distinct()
    return rows.join(pairs.join(values, on), [*on, share])


#: Bytes of key text and rows of a table that ``attach`` broadcasts at most.
LOOKUP_BYTES, LOOKUP_ROWS = 16 << 20, 200_000


def attach(rows: DataFrame, values: DataFrame, on: str, rank: Column, most: int = 1_000_000, limit: int = LOOKUP_ROWS) -> DataFrame:
    """``rows`` joined to ``values``, which has one row a key (text, not null), however large either of them is.

    ``values`` is small by its checked size (``limit`` rows, LOOKUP_BYTES of keys) and then broadcast, or the rows of a
    key are dealt in shares of about ``most`` rows. ``values`` has ``rows``, the rows of its key; ``rank`` is a number of
    the rows, spread evenly within a key, that is the same if they are computed again.
    """
    size = values.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(on)).alias("bytes")).first()
    if size["n"] <= limit and (size["bytes"] or 0) <= LOOKUP_BYTES:
        return rows.join(F.broadcast(values.drop("rows")), on)
    shares = values.agg(F.max("rows")).first()[0] // most + 1
    dealt = rows.withColumn("_share", F.pmod(rank, F.lit(shares)))
    return spread_join(dealt, values.drop("rows"), [on], "_share").drop("_share")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has columns ``a`` and ``b`` (any orderable type, self-loops allowed); returns ``node, component``.
    Alternates large-star and small-star rounds, in which each node links its larger neighbours, then all
    its neighbours, to its smallest one. A node's neighbours meet only in aggregates and joins, never in a
    list, so a hub costs rows and no memory. Stops when a pair of rounds leaves the edges as they were.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = cut(links)
    mark = _fingerprint(links)
    for _ in range(rounds):
        # large star: every neighbour larger than u goes to the smallest of u and its neighbours
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every neighbour not larger than u, and u itself, goes to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        links = cut(small.where("u <> v").distinct())
        now = _fingerprint(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("connected components did not settle")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return nodes.join(links.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def _fingerprint(links: DataFrame) -> tuple:
    """Row count and an order-free checksum of the links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
