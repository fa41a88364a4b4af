"""Nearest neighbours through shifted Hilbert curves, made exact by a bounded search of the curve's blocks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, numbered, table

#: Curves, dimensions that each projects to, bits of each dimension, and rows of a window on either side.
CURVES, DIMS, BITS, WINDOW = 4, 6, 10, 256
#: Rows that the curves' scales are fitted on, rows of a block, and most blocks.
SAMPLE, BLOCK, MAX_BLOCKS = 5_000, 4_096, 4_096
SEED = 17


class Curve(NamedTuple):
    """A projection, the lowest value and width of each projected dimension, and the shift of the grid."""

    matrix: np.ndarray
    low: np.ndarray
    width: np.ndarray
    shift: np.ndarray


def hilbert_index(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (0 to 2**bits - 1 each).

    Undoes the curve's rotations from the highest bit down, then reads the Gray code of the interleaved bits.
    """
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def fit_curves(sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, seed: int = SEED) -> list[Curve]:
    """Random projections scaled so that the middle 98 percent of the sample fill half of each grid, shifted at random."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(curves):
        matrix = rng.normal(size=(sample.shape[1], dims))
        flat = sample @ matrix
        low, high = np.quantile(flat, [0.01, 0.99], axis=0)
        out.append(Curve(matrix, low, np.maximum(high - low, 1e-12), rng.uniform(0, 0.5, size=dims)))
    return out


def curve_keys(curve: Curve, vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of vectors; values beyond the sample's range are clipped to the grid's edge."""
    unit = ((vectors @ curve.matrix - curve.low) / curve.width) * 0.5 + curve.shift
    top = (1 << bits) - 1
    return hilbert_index(np.clip(np.floor(unit * (top + 1)), 0, top), bits)


def nearest(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray) -> list[tuple[int, int, float]]:
    """(query row, id, distance) of the k nearest vectors, ties to smaller ids, within ``limit`` of each query.

    A matrix product ranks roughly; whatever could be among the k is measured again by differences in double.
    """
    out = []
    norms = np.einsum("ij,ij->i", vectors, vectors)
    step = max(1, (1 << 21) // max(1, len(vectors)))
    for a in range(0, len(queries), step):
        block = queries[a : a + step]
        rough = norms[None, :] + np.einsum("ij,ij->i", block, block)[:, None] - 2 * (block @ vectors.T)
        rough[own[a : a + step, None] == ids[None, :]] = np.inf
        slack = 1e-9 * (1 + norms.max(initial=0.0))
        for i, row in enumerate(rough):
            bound = limit[a + i] ** 2 + slack
            if len(row) > k:
                bound = min(bound, np.partition(row, k - 1)[k - 1] + slack)
            at = np.flatnonzero((row <= bound) & np.isfinite(row))
            exact = np.sqrt(((vectors[at] - block[i]) ** 2).sum(axis=1))
            for j in np.lexsort((ids[at], exact))[:k]:
                out.append((a + i, int(ids[at[j]]), float(exact[j])))
    return out


HIT = "query_id long, vec_id long, score double"


def prepare(vectors: DataFrame, every: int) -> DataFrame:
    """``vec_id, embedding, is_query`` of the vectors that take part, one row an id (the smallest vector)."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("is_query", F.col("vec_id") % every == 0)


def window_hits(base: DataFrame, curves: list[Curve], k: int, window: int, parts: int) -> DataFrame:
    """Candidates (HIT): the k nearest of each query within its windows, over all curves.

    Rows are range-partitioned by curve and key and numbered in that order. Buckets of four windows, with a window more
    on either side, are searched one by one, so no window ends at a partition's end, and a task holds one bucket.
    """
    shared = base.sparkSession.sparkContext.broadcast(curves)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                matrix = np.stack(batch["embedding"].to_numpy())
                for c, curve in enumerate(shared.value):
                    yield batch.assign(curve=c, key=curve_keys(curve, matrix))

    keyed = base.mapInPandas(keys, "vec_id long, embedding array<double>, is_query boolean, curve int, key long")
    ordered = keyed.repartitionByRange(parts * len(curves), "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    size = 4 * window
    own, place = F.floor(F.col("n") / size), F.pmod(F.col("n"), F.lit(size))
    buckets = F.array_compact(F.array(own, F.when(place < window, own - 1), F.when(place >= size - window, own + 1)))
    dealt = numbered(ordered, "n").withColumn("bucket", F.explode(buckets))

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["bucket"].iat[0]) * size
        rows = rows.sort_values("n")
        place, curve, ids = rows["n"].to_numpy(), rows["curve"].to_numpy(), rows["vec_id"].to_numpy()
        matrix = np.stack(rows["embedding"].to_numpy())
        hits = []
        for at in np.flatnonzero(rows["is_query"].to_numpy() & (place >= first) & (place < first + size)):
            near = slice(max(0, at - window), at + window + 1)
            same = curve[near] == curve[at]
            found = nearest(matrix[at : at + 1], ids[at : at + 1], matrix[near][same], ids[near][same], k, np.array([np.inf]))
            hits += [(int(ids[at]), v, d) for _, v, d in found]
        return pd.DataFrame(hits, columns=["query_id", "vec_id", "score"])

    return dealt.groupBy("bucket").applyInPandas(scan, HIT)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct hits of each query with their ``rank``."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    distinct = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_hits(base: DataFrame, limits: DataFrame, curve: Curve, k: int, parts: int) -> DataFrame:
    """Hits (HIT) of an exact search: each query in every block of the curve that can hold a nearer vector.

    ``limits`` has ``query_id, embedding, radius``, the distance of the k-th candidate so far (infinite if there are
    fewer). A block is skipped if its centre is farther than its own radius and that distance together.
    """
    spark = base.sparkSession
    shared = spark.sparkContext.broadcast(curve)

    @F.pandas_udf("long")
    def key(vectors: pd.Series) -> pd.Series:
        return pd.Series(curve_keys(shared.value, np.stack(vectors.to_numpy())) if len(vectors) else [], dtype="int64")

    ordered = base.select("vec_id", "embedding", key("embedding").alias("key")).repartitionByRange(parts, "key", "vec_id")
    blocks = cut(ordered.select("vec_id", "embedding", F.spark_partition_id().alias("block")))

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            matrix = np.concatenate([np.stack(b["embedding"].to_numpy()) for b in got])
            centre = matrix.mean(axis=0)
            yield pd.DataFrame({"block": [got[0]["block"].iat[0]], "centre": [centre], "reach": [np.sqrt(((matrix - centre) ** 2).sum(axis=1)).max()]})

    outlines = blocks.mapInPandas(outline, "block int, centre array<double>, reach double").collect()
    names = np.array([r.block for r in outlines])
    centres, reaches = np.array([r.centre for r in outlines]), np.array([r.reach for r in outlines])
    outline_ = spark.sparkContext.broadcast((names, centres, reaches))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, centres, reaches = outline_.value
        for batch in batches:
            rows = []
            for q, e, r in zip(batch["query_id"], batch["embedding"], batch["radius"], strict=True):
                far = np.sqrt(((centres - e) ** 2).sum(axis=1)) - reaches
                rows += [(int(b), q, e, r) for b in names[far <= r + 1e-9]]
            yield pd.DataFrame(rows, columns=["block", "query_id", "embedding", "radius"])

    routed = limits.mapInPandas(route, "block int, query_id long, embedding array<double>, radius double")

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        own = asked["query_id"].to_numpy()
        found = nearest(np.stack(asked["embedding"].to_numpy()), own, np.stack(rows["embedding"].to_numpy()), rows["vec_id"].to_numpy(), k, asked["radius"].to_numpy())
        return pd.DataFrame([(int(own[i]), v, d) for i, v, d in found], columns=["query_id", "vec_id", "score"])

    return blocks.groupBy("block").cogroup(routed.groupBy("block")).applyInPandas(search, HIT)


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, window: int = WINDOW, exact: bool = True) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors (Euclidean) of each whose id ``every`` divides.

    Several Hilbert curves over shifted, projected grids order all vectors; a query's windows on them give
    candidates and so a radius. With ``exact``, every block of the first curve that the radius does not rule out is
    searched too, so the result is that of brute force; without it, it is what the windows hold. Windows reach a recall
    of 0.9 where vectors lie near few dimensions; where they fill all, they do not (see the README for figures). Vectors that are null, zero, or hold null or non-finite components, and those of another length
    than the commonest, take no part. Of repeated ids the smallest vector counts. Ties go to smaller ids; fewer
    than ``k`` other vectors are all returned; an empty table gives an empty result.
    """
    base = cut(prepare(vectors, every))
    sizes = base.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    base = base.where(F.size("embedding") == sizes["n"])
    count = sizes["count"]
    parts = int(min(MAX_BLOCKS, -(-count // BLOCK)))
    sample = base.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    curves = fit_curves(np.stack(sample.to_numpy()))
    found = cut(best(window_hits(base, curves, k, window, parts), k))
    if exact:
        kth = found.groupBy("query_id").agg(F.max("score").alias("far"), F.count(F.lit(1)).alias("n"))
        radius = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
        limits = base.where("is_query").select(F.col("vec_id").alias("query_id"), "embedding").join(kth, "query_id", "left").select("query_id", "embedding", F.coalesce(radius, F.lit(float("inf"))).alias("radius"))
        found = best(found.select("query_id", "vec_id", "score").union(block_hits(base, limits, curves[0], k, parts)), k)
    return found.select("query_id", "rank", "vec_id", "score")


def op7_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector of ``embeddings``."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
QUERIES = {"op7_hilbert_ann": op7_hilbert_ann}
ORACLES = {"op7_hilbert_ann": OP7_SQL}
