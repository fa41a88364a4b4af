"""Anchor graphs: reference k-mers that every sample has, and the sequence between them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import sequence as S
from strandline.operators.kmers import BAIT, PACKED, _stretches, unique_kmers, unpacked, windows_of
from strandline.operators.lineage import cut


def positions(reads: DataFrame, kmers: DataFrame, k: int, key: str, keep: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    """``kmer, key, keep, pos``: where the given k-mers (``kmer``) stand in reads.

    At most BAIT k-mers of PACKED bases or fewer are broadcast as numbers and met where the reads lie, so only places found
    leave a task; more or longer ones, and reads with other letters, are joined.
    """
    known: list | None = None
    if k <= PACKED:
        plain = kmers.where((F.length("kmer") == k) & ~F.col("kmer").rlike("[^ACGT]"))
        known = plain.select(F.conv(F.translate("kmer", "ACGT", "0123"), 4, 10).cast("long").alias("n")).distinct().limit(BAIT + 1).toPandas()["n"].to_numpy(np.int64)
    wide = known is None or len(known) > BAIT
    odd = F.lit(True) if wide else F.col(seq).rlike("[^ACGT]")
    rows = windows_of(reads.where(odd), k, [key, *keep], seq)
    out = rows.join(kmers.select("kmer"), "kmer", "left_semi").select("kmer", key, *keep, "pos")
    if wide:
        return out
    wanted = reads.sparkSession.sparkContext.broadcast(np.sort(known))
    names = [key, *keep]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pos, ahead, _, _, _ in _stretches(batch.column(len(names)), k) if len(wanted.value) else ():
                spot = np.minimum(np.searchsorted(wanted.value, ahead), len(wanted.value) - 1)
                hit = np.flatnonzero(wanted.value[spot] == ahead)
                at = pa.array(row[hit])
                yield pa.RecordBatch.from_arrays([pa.array(ahead[hit]), *(batch.column(c).take(at) for c in range(len(names))), pa.array(pos[hit].astype(np.int32))], ["_n", *names, "pos"])

    short = reads.where(~odd & (F.length(seq) >= k)).select(*names, seq)
    shape = T.StructType([T.StructField("_n", T.LongType()), *(short.schema[c] for c in names), T.StructField("pos", T.IntegerType())])
    return short.mapInArrow(find, shape).select(unpacked("_n", k).alias("kmer"), *names, "pos").union(out)


def in_every_sample(found: DataFrame, key: str, sample: str = "sample") -> DataFrame:
    """``kmer`` that every sample of ``found`` has, in more than one read.

    Reads are more than one if the least and the greatest differ, so no set of them is made.
    """
    samples = found.select(sample).distinct().agg(F.count(F.lit(1)).alias("all"))
    each = found.groupBy("kmer", sample).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    counts = each.groupBy("kmer").agg(F.count(sample).alias("n"), (F.min("_low") < F.max("_high")).alias("several"))
    return counts.join(F.broadcast(samples), F.col("n") == F.col("all")).where("several").select("kmer")


def spaced(anchors: DataFrame, k: int, contig: str = "contig") -> DataFrame:
    """Anchors (``contig, kmer, pos``) kept greedily: each over ``k`` beyond the last one kept, starting from 0.

    Buckets of ``k + 1`` positions keep their smallest. The greedy rule is a fold in order, per contig, over positions
    only.
    """
    first = anchors.groupBy(contig, F.floor(F.col("pos") / (k + 1)).alias("bucket")).agg(F.min(F.struct("pos", "kmer")).alias("a"))
    rows = first.groupBy(contig).agg(F.array_sort(F.collect_list("a")).alias("all"))
    none = F.array().cast("array<struct<pos:int,kmer:string>>")
    fold = F.aggregate(
        F.transform("all", lambda a: F.struct(a["pos"].cast("int").alias("pos"), a["kmer"].alias("kmer"))),
        F.struct(F.lit(0).alias("last"), none.alias("kept")),
        lambda acc, a: F.when(a["pos"] > acc["last"] + k, F.struct(a["pos"].alias("last"), F.concat(acc["kept"], F.array(a)).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return rows.select(contig, F.explode(fold).alias("a")).select(contig, "a.kmer", "a.pos")


def anchor_edges(found: DataFrame, anchors: DataFrame, reads: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """``key, sample, src, dst, seq``: the steps of each read from SOURCE over its anchors, in order, to SINK.

    ``anchors`` has ``kmer, name``; a step's sequence starts with its source anchor and ends before its destination.
    """
    at = found.join(anchors.select("kmer", "name"), "kmer").select(key, "sample", "name", "pos")
    w = Window.partitionBy(key).orderBy("pos", "name")
    steps = at.select(key, "sample", F.lag("name").over(w).alias("src"), F.lag("pos").over(w).alias("a"), F.col("name").alias("dst"), F.col("pos").alias("b"))
    steps = steps.select(key, "sample", F.coalesce("src", F.lit("SOURCE")).alias("src"), "dst", F.coalesce("a", F.lit(0)).alias("a"), "b")
    last = at.groupBy(key, "sample").agg(F.max(F.struct("pos", "name")).alias("l")).select(key, "sample", F.col("l.name").alias("src"), F.lit("SINK").alias("dst"), F.col("l.pos").alias("a"), F.lit(None).cast("int").alias("b"))
    joined = steps.union(last).join(reads.select(key, F.col(seq).alias("_s")), key)
    return joined.select(key, "sample", "src", "dst", F.substring("_s", F.col("a") + 1, F.coalesce("b", F.length("_s")) - F.col("a")).alias("seq"))


def merge_edges(steps: DataFrame, key: str) -> DataFrame:
    """``src, dst, seq, reads, samples``: equal steps merged, with the sorted sets of their reads and samples."""
    return steps.groupBy("src", "dst", "seq").agg(F.array_sort(F.collect_set(key)).alias("reads"), F.array_sort(F.collect_set("sample")).alias("samples"))


def supported(edges: DataFrame, least: int = 30, reference: str | None = None) -> DataFrame:
    """Edges of at least ``least`` reads, and those of the reference."""
    ok = F.size("reads") >= least
    return edges.where(ok | F.array_contains("samples", reference) if reference is not None else ok)


def anchor_name(contig: str, pos: str, k: int) -> Column:
    """Name of an anchor: A, its contig, and the number of its stretch of ``k + 1`` bases, of which each has one anchor."""
    return F.format_string("A%s_%06d", F.col(contig).cast("string"), F.floor(F.col(pos) / (k + 1)).cast("int"))


def build(reads: DataFrame, reference: DataFrame, k: int, key: str, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(anchors, edges) of reads (``key, sample, seq``) against a reference (``contig, seq``).

    An anchor is named by its contig and its place there, so anchors of different contigs never share a name.
    """
    unique = unique_kmers(reference, k)
    found = positions(reads, unique, k, key, ("sample",))
    shared = in_every_sample(found, key)
    on_ref = positions(reference.withColumn("sample", F.lit("reference")), shared, k, "contig").select("contig", "kmer", "pos")
    anchors = spaced(on_ref, k).withColumn("name", anchor_name("contig", "pos", k))
    edges = supported(merge_edges(anchor_edges(found, anchors, reads, k, key), key), least)
    return anchors, edges


def edge_reads(edges: DataFrame) -> DataFrame:
    """Distinct reads over all edges."""
    return edges.select(F.explode("reads").alias("read")).distinct()


def furthest_next(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """``src, dst, step``: for each anchor the successor farthest from it (ties: the smaller name)."""
    p = anchors.select("name", "pos")
    rows = edges.select("src", "dst").distinct().join(p.select(F.col("name").alias("src"), F.col("pos").alias("a")), "src").join(p.select(F.col("name").alias("dst"), F.col("pos").alias("b")), "dst")
    step = F.abs(F.col("b") - F.col("a"))
    return rows.groupBy("src").agg(F.min(F.struct((-step).alias("s"), "dst")).alias("m")).select("src", F.col("m.dst").alias("dst"), (-F.col("m.s")).alias("step"))


def backbone(nexts: DataFrame, start: str, rounds: int = 64) -> DataFrame:
    """``name, depth``: the chain of furthest successors from ``start``, by doubling jumps; stops before a repeat."""
    jump = nexts.select("src", "dst")
    reached = nexts.sparkSession.createDataFrame([(start, 0)], "name string, depth int")
    size = 1
    for _ in range(rounds):
        step = reached.join(jump, reached["name"] == jump["src"]).select(F.col("dst").alias("name"), (F.col("depth") + size).alias("depth"))
        grown = reached.union(step).groupBy("name").agg(F.min("depth").alias("depth"))
        grown = grown.transform(cut)
        if grown.count() == reached.count():
            return grown
        reached = grown
        hop = jump.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        jump = jump.join(hop, "dst").select("src", F.col("far").alias("dst")).transform(cut)
        size *= 2
    return reached


def supported_paths(edges: DataFrame, ends: DataFrame, depth: int | None = None) -> DataFrame:
    """``start, stop, path, seq, reads``: paths between given ends (``start, stop``), of at most ``depth`` edges if given.

    Paths grow edge by edge, never come back to an anchor, and keep the reads that all their edges share; a path without
    such reads ends. So all paths end by themselves.
    """
    live = ends.select("start", "stop", F.col("start").alias("at"), F.array("start").alias("path"), F.lit("").alias("seq"), F.lit(None).cast("array<string>").alias("reads"))
    e = edges.select(F.col("src").alias("at"), "dst", F.col("seq").alias("piece"), F.transform("reads", lambda r: r.cast("string")).alias("more"))
    done = None
    for _ in itertools.count() if depth is None else range(depth):
        grown = live.join(e, "at").where(~F.array_contains("path", F.col("dst")))
        grown = grown.select("start", "stop", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("seq", "piece").alias("seq"), F.when(F.col("reads").isNull(), F.col("more")).otherwise(F.array_intersect("reads", "more")).alias("reads"))
        grown = grown.where(F.size("reads") > 0).transform(cut)
        arrived = grown.where("at = stop").drop("at")
        done = arrived if done is None else done.union(arrived)
        live = grown.where("at <> stop")
        if live.isEmpty():
            break
    return done


def series_parallel(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``src, dst, seq, reads``: what supported_paths finds between the given ends, equal sequences merged, without listing paths.

    Anchors that are no end are taken out, many at a time: each edge into one is joined with each edge out of it that has
    reads in common with it, and the two become one of their joint sequence and common reads. Those taken out in a round are
    no neighbours: each comes first among its neighbours in an order that is drawn anew every round, so rounds grow with the
    logarithm of the anchors, and a read adds a row for each edge it is left on. An edge never passes an anchor twice.
    Ends do not lie within one another's paths.
    """
    fixed = ends.select(F.col("start").alias("node")).union(ends.select("stop")).distinct().transform(cut)
    live = edges.select("src", "dst", "seq", F.transform("reads", lambda r: r.cast("string")).alias("reads"), F.array().cast("array<string>").alias("via")).where("src <> dst").transform(cut)
    for turn in itertools.count():
        inner = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct().join(fixed, "node", "left_anti").transform(cut)
        if inner.isEmpty():
            break
        links = live.select("src", "dst").distinct()
        both = links.union(links.select("dst", "src")).join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi")
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)), F.col(c))
        later = both.where(order("dst") < order("src")).select(F.col("src").alias("node")).distinct()
        out = inner.join(later, "node", "left_anti").transform(cut)
        into = live.join(out.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("a"), F.col("seq").alias("s"), F.col("reads").alias("r"), F.col("via").alias("v"))
        onward = live.join(out.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("b"), F.col("seq").alias("s2"), F.col("reads").alias("r2"), F.col("via").alias("v2"))
        met = into.join(onward, "node").where((F.col("a") != F.col("b")) & ~F.arrays_overlap("v", "v2") & ~F.array_contains("v2", F.col("a")) & ~F.array_contains("v", F.col("b")))
        made = met.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.concat("s", "s2").alias("seq"), F.array_intersect("r", "r2").alias("reads"), F.concat("v", F.array("node"), "v2").alias("via")).where("size(reads) > 0")
        rest = live.join(out.withColumnRenamed("node", "dst"), "dst", "left_anti").join(out.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst", "seq", "reads", "via")
        live = rest.union(made).transform(cut)
    rows = live.join(ends.select(F.col("start").alias("src"), F.col("stop").alias("dst")).distinct(), ["src", "dst"], "left_semi").select("src", "dst", "seq", F.explode("reads").alias("r"))
    return rows.groupBy("src", "dst", "seq").agg(F.array_sort(F.collect_set("r")).alias("reads"))


def single_sample(edges: DataFrame, choices: DataFrame, sample: str) -> DataFrame:
    """The subgraph of one sample: ``choices`` (``read, src, index``) of each read's edge among those that leave an anchor."""
    numbered = edges.withColumn("index", F.row_number().over(Window.partitionBy("src").orderBy("dst", "seq")) - 1)
    rows = choices.join(numbered.select("src", "dst", "seq", "index"), ["src", "index"])
    return rows.groupBy("src", "dst", "seq").agg(F.array_sort(F.collect_set("read")).alias("reads")).withColumn("samples", F.array(F.lit(sample)))


def path_sequence(paths: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """``key, seq``: sequences of the named pieces (``name, seq``) along each path (array), joined in order."""
    rows = paths.select(key, F.posexplode("path").alias("i", "name")).join(pieces, "name")
    return rows.groupBy(key).agg(S.ordered_concat("i", "seq").alias("seq"))
