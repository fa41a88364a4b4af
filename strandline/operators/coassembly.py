"""Scored graphs of long and short reads: correction by file and by window, bubble matrices, two haplotypes.

With ``keys``, every step works on one graph for each of their values, all at once.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import alignment as L
from strandline.operators import graph as G
from strandline.operators import kmers as K
from strandline.operators import model as M
from strandline.operators import phasing as P
from strandline.operators.lineage import cut


def scored_graph(long_: DataFrame, short: DataFrame, k: int, model: PipelineModel | None = None, threshold: float | None = 0.1, keys: G.Keys = (), score: Column | None = None) -> DataFrame:
    """The k-mer table of long and short reads with ``sources`` and ``score``, cleaned unless ``threshold`` is None.

    The model scores k-mers by the six features; without one, ``score`` does (a column of the merged table), or all score 1.
    """
    tables = [K.count_kmers(x, k, keys).withColumn("color", F.lit(c)) for c, x in (("long", long_), ("short", short))]
    both = tables[0].union(tables[1]).transform(cut)
    merged = K.collapse_colors(both, keys)
    if model is None:
        table = merged.withColumn("score", F.lit(1.0) if score is None else score)
    else:
        rows = K.features(K.color_table(both.withColumn("truth", F.lit(0)), ("long", "short", "truth"), keys), keys)
        table = merged.join(M.score(rows, model).select(*keys, "cn_kmer", "score"), [*keys, "cn_kmer"])
    table = table.transform(cut)
    return table if threshold is None else G.clean(table, k, threshold, keys=keys)


def correct_file(long_: DataFrame, short: DataFrame, k: int, key: str, model: PipelineModel | None = None, threshold: float | None = 0.1) -> DataFrame:
    """``key, seq, qual, replaced``: long reads corrected in the cleaned graph (see scored_graph) of all reads, with qualities from k-mer scores."""
    table = scored_graph(long_, short, k, model, threshold)
    fixed = G.correct_reads(long_, table, k, key).transform(cut)
    return fixed.join(score_qualities(fixed, table, k, [key]), key)


def score_qualities(reads: DataFrame, kmers: DataFrame, k: int, by: list[str], keys: G.Keys = ()) -> DataFrame:
    """``by, qual``: a quality for each base, from the scores of the k-mers over it (missing ones: 0 coverage, no vote).

    ``by`` tells reads apart; it includes ``keys``, by which k-mers are looked up. One row a base, summed over the k places
    up to it at which a k-mer over it starts.
    """
    at = K.windows_of(reads, k, by).select(*by, "pos", F.least("kmer", "rc").alias("cn_kmer")).join(kmers.select(*keys, "cn_kmer", "score"), [*keys, "cn_kmer"], "left")
    return _qualities(reads, at.select(*by, "pos", G._log().alias("l")), k, by)


def _qualities(reads: DataFrame, logs: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Qualities from ``by, pos, l``: the logarithm of the score of the k-mer that starts at each place (null: no vote)."""
    n = F.length("seq")
    # places at which no k-mer starts any more
    rest = reads.where(n > 0).select(*by, F.explode(F.sequence(F.greatest(n - k + 1, F.lit(0)), n - 1)).alias("pos"), F.lit(None).cast("double").alias("l")) if k > 1 else None
    rows = logs if rest is None else logs.union(rest)
    over = Window.partitionBy(*by).orderBy("pos").rowsBetween(-(k - 1), 0)
    q = rows.select(*by, "pos", F.when(F.count("l").over(over) == 0, F.lit("!")).otherwise(S.score_quality(F.sum("l").over(over), F.count("l").over(over))).alias("q"))
    listed = q.groupBy(*by).agg(S.ordered_concat("pos", "q").alias("qual"))
    return reads.select(*by).join(listed, by, "left").select(*by, F.coalesce("qual", F.lit("")).alias("qual"))


def correct_windows(pieces: DataFrame, short: DataFrame, k: int, short_key: str, model: PipelineModel | None = None, threshold: float | None = 0.1, score: Column | None = None) -> DataFrame:
    """``locus, read, seq, qual, replaced``: reads corrected window by window and put together again, in order of windows.

    ``pieces`` (``locus, tile, read, seq``) are the parts of long reads in the windows of each locus. Every window has a graph
    of its own: of its pieces and of the short reads of which over half of the distinct k-mers are in these, scored, cleaned, and used
    for its pieces alone; all windows are worked on together. A base's quality comes from the scores of the k-mers over it
    in the windows that the read has pieces in (of several the last; a k-mer that none has counts as 1).
    """
    keys = ("locus", "tile")
    near = K.recruit_distinct(short, pieces, k, short_key, keys, whole=True).select(*keys, "seq")
    table = scored_graph(pieces, near, k, model, threshold, keys, score).transform(cut)
    fixed = G.correct_reads(pieces, table, k, "read", keys=keys).transform(cut)
    whole = fixed.groupBy("locus", "read").agg(S.ordered_concat("tile", "seq").alias("seq"), F.sum("replaced").alias("replaced")).transform(cut)
    at = K.windows_of(whole, k, ["locus", "read"]).select("locus", "read", "pos", F.least("kmer", "rc").alias("cn_kmer"))
    scores = at.join(pieces.select("locus", "read", "tile").distinct(), ["locus", "read"]).join(table.select(*keys, "cn_kmer", "score"), [*keys, "cn_kmer"])
    last = scores.groupBy("locus", "read", "pos").agg(F.max_by("score", "tile").alias("score"))
    logs = at.join(last, ["locus", "read", "pos"], "left").select("locus", "read", "pos", F.coalesce(G._log(), F.lit(0.0)).alias("l"))
    return whole.join(_qualities(whole, logs, k, ["locus", "read"]), ["locus", "read"]).select("locus", "read", "seq", "qual", "replaced")


def bubble_matrix(reads: DataFrame, kmers: DataFrame, k: int, key: str, keys: G.Keys = ()) -> DataFrame:
    """``keys, read, site, allele, weight``: which of a bubble's two best paths each read takes, as cells to phase.

    Without ``keys`` there is one ``locus``, 0. Paths are ranked by geometric mean score; a read takes one if it has over 80
    percent of its k-mers. The weight is the path's quality. A bubble is counted on one strand. Sites are numbered in order of where
    reads pass them, on the whole, within each graph.
    """
    by = [*keys, "entry", "exit"]
    m = G.unitigs(kmers, keys=keys).transform(cut)
    found, inside = G.bubbles(G.unitig_edges(kmers, m, keys))
    best = G.best_paths(kmers, m, found, inside, keys=keys)
    rows = G.path_nodes(best, m, keys).transform(cut)
    # the other strand's bubble has the same k-mers; the one whose first end is smaller counts
    strand = rows.groupBy(*by).agg(F.min_by("node", F.struct("step", "offset")).alias("first"), F.max_by("node", F.struct("step", "offset")).alias("last"))
    kept = strand.where(F.col("first") <= S.reverse_complement("last")).select(*by)
    rows = rows.join(kept, by, "left_semi").join(best.select("entry", "exit", "place", "value"), ["entry", "exit", "place"])
    mine = rows.select(*by, (F.col("place") - 1).alias("allele"), "value", S.canonical("node").alias("cn_kmer")).distinct().transform(cut)
    size = mine.groupBy(*by, "allele").agg(F.count(F.lit(1)).alias("_n"))
    at = K.occurrences(reads, k, [*keys, key]).groupBy(*keys, key, "cn_kmer").agg(F.min("pos").alias("pos"))
    met = mine.join(at, [*keys, "cn_kmer"]).groupBy(*by, "allele", "value", key).agg(F.count(F.lit(1)).alias("hit"), F.min("pos").alias("pos"))
    hits = met.join(size, [*by, "allele"]).where("hit > 0.8 * _n").transform(cut)
    order = Window.partitionBy(*keys).orderBy("mean", "entry", "exit") if keys else Window.partitionBy(F.lit(0)).orderBy("mean", "entry", "exit")
    sites = hits.groupBy(*by).agg(F.avg("pos").alias("mean")).withColumn("site", F.row_number().over(order).cast("long") - 1)
    cells = hits.join(sites, by).groupBy(*keys, key, "site").agg(F.max(F.struct("hit", (-F.col("allele")).alias("a"), "value")).alias("best"))
    locus = [] if keys else [F.lit(0).cast("long").alias("locus")]
    return cells.select(*keys, *locus, F.col(key).alias("read"), "site", (-F.col("best.a")).cast("int").alias("allele"), S.path_quality("best.value").cast("int").alias("weight"))


def co_assemble(long_: DataFrame, short: DataFrame, k: int, key: str, model: PipelineModel | None = None, threshold: float | None = 0.1, locus: str = "locus", least: int = 500) -> DataFrame:
    """``locus, haplotype, seq``: two haplotypes of each locus from long (``locus, key, seq``) and short reads (``locus, seq``).

    Each locus has a cleaned graph of its own, in which its long reads are corrected; which of two paths they take through
    its bubbles is phased, and reads over 80 percent like either haplotype are dealt to the one they are more like (ties: the
    second). The reads of a haplotype of over ``least`` bases are laid on one strand and aligned column by column, and the
    commonest of each column is its sequence. A haplotype without such reads, and a locus without bubbles, give no row.
    """
    keys = (locus,)
    table = scored_graph(long_, short, k, model, threshold, keys).transform(cut)
    fixed = G.correct_reads(long_, table, k, key, keys=keys).select(locus, key, "seq").transform(cut)
    cells = bubble_matrix(fixed, table, k, key, keys).withColumnRenamed(locus, "locus").transform(cut)
    sides = P.assign_by_identity(cells, P.phase_windows(cells)).select(F.col("locus").alias(locus), F.col("read").alias(key), "haplotype")
    own = fixed.join(sides, [locus, key]).where(F.length("seq") > least).transform(cut)
    group = [locus, "haplotype"]
    return L.consensus(L.orient(own, group, key).select(*group, key, "seq").transform(cut), group, key)
