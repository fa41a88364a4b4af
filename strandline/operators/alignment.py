"""Column alignment of reads to a backbone, orientation of reads, and consensus by column, for many loci at once.

Every read is aligned to its group's backbone on its own: words that both have once are chained, and only what lies
between them goes through dynamic programming. Columns are rows, so votes are an aggregate.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators.intervals import overlap_join
from strandline.operators.kmers import windows_of
from strandline.operators.lineage import cut
from strandline.operators.pileup import reference_length

#: Lengths of the words that are chained, the shorter ones between the longer ones.
WORDS = (21, 13, 8)
#: Values of a match, a mismatch, and a base of a gap.
MATCH, MISMATCH, GAP = 2, -4, -3
#: Cells of a table that is filled for one stretch; a larger stretch is laid base by base.
CELLS = 50_000_000
#: Bases of the longer side that a read's end may use beyond the length of the shorter one.
SLACK = 200
#: Shares into which the reads of one group are dealt when they meet its backbone.
SHARES = 16


def chained(a: str, b: str, k: int) -> list[tuple[int, int]]:
    """Places (in ``a``, in ``b``) of words that both have exactly once, in the longest chain that ascends in both."""

    def once(s: str) -> dict[str, int]:
        at: dict[str, int] = {}
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            at[w] = -1 if w in at else i
        return at

    there = once(b)
    pairs = [(i, j) for w, i in once(a).items() if i >= 0 and (j := there.get(w, -1)) >= 0]
    pairs.sort()
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        back[n] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            ends.append(n)
        else:
            tails[at], ends[at] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def aligned(a: str, b: str, free_start: bool = False, free_end: bool = False) -> list[tuple[int, int]]:
    """Pairs (place in ``a``, place in ``b``) of the best alignment; a place is -1 where the other side has a base alone.

    With a free start or end, bases that either side has alone there cost nothing.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return [(i, -1) for i in range(n)] + [(-1, j) for j in range(m)]
    if n * m > CELLS:
        both = min(n, m)
        return [(i, i) for i in range(both)] + [(i, -1) for i in range(both, n)] + [(-1, j) for j in range(both, m)]
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    gaps = GAP * np.arange(m + 1)
    row = np.zeros(m + 1, np.int64) if free_start else gaps.copy()
    ways = np.zeros((n + 1, m + 1), np.int8)  # 0: both, 1: a alone, 2: b alone
    ways[0, 1:] = 2
    last = [int(row[m])]
    for i in range(1, n + 1):
        both = row[:-1] + np.where(y == x[i - 1], MATCH, MISMATCH)
        alone = row[1:] + GAP
        best = np.maximum(both, alone)
        new = np.concatenate([[0 if free_start else GAP * i], best])
        # gaps along b: the running maximum of what each place would start with
        run = np.maximum.accumulate(new - gaps) + gaps
        ways[i, 1:] = np.where(run[1:] > best, 2, np.where(both >= alone, 0, 1))
        ways[i, 0] = 1
        row = run
        last.append(int(row[m]))
    i, j = n, m
    if free_end:
        across, down = int(row.argmax()), int(np.argmax(last))
        i, j = (n, across) if row[across] >= last[down] else (down, m)
    out = [(p, -1) for p in range(n - 1, i - 1, -1)] + [(-1, q) for q in range(m - 1, j - 1, -1)]
    while i or j:
        if i and j and ways[i, j] == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and (not j or ways[i, j] == 1):
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def _between(a: str, b: str, words: tuple[int, ...], start: bool, end: bool) -> list[tuple[int, int]]:
    """Alignment of two stretches; ``start`` and ``end`` tell whether they are free there, as the reads' ends are."""
    if not start and not end and a == b:
        return [(i, i) for i in range(len(a))]
    spots = chained(a, b, words[0]) if words and min(len(a), len(b)) > words[0] else []
    if not spots:
        if words and max(len(a), len(b)) > words[-1]:
            return _between(a, b, words[1:], start, end)
        if start and not end:  # no more of the longer side than its end can be about the shorter one
            i, j = max(0, len(a) - len(b) - SLACK), max(0, len(b) - len(a) - SLACK)
            return [(p, -1) for p in range(i)] + [(-1, q) for q in range(j)] + _moved(aligned(a[i:], b[j:], True, False), i, j)
        if end and not start:
            i, j = min(len(a), len(b) + SLACK), min(len(b), len(a) + SLACK)
            return aligned(a[:i], b[:j], False, True) + [(p, -1) for p in range(i, len(a))] + [(-1, q) for q in range(j, len(b))]
        return aligned(a, b, start, end)
    out, i, j = [], 0, 0
    for n, (p, q) in enumerate(spots):
        if p < i or q < j:
            # words overlap: what both have gone on by is one match
            more = p + words[0] - i
            if q - p == j - i and more > 0:
                out += [(i + x, j + x) for x in range(more)]
                i, j = i + more, j + more
            continue
        out += _moved(_between(a[i:p], b[j:q], words[1:], start and not n, False), i, j)
        out += [(p + x, q + x) for x in range(words[0])]
        i, j = p + words[0], q + words[0]
    return out + _moved(_between(a[i:], b[j:], words[1:], False, end), i, j)


def _moved(pairs: list[tuple[int, int]], i: int, j: int) -> list[tuple[int, int]]:
    return [(p + i if p >= 0 else -1, q + j if q >= 0 else -1) for p, q in pairs]


def columns(read: str, backbone: str) -> list[tuple[int, str]]:
    """(place, what the read has there) for each place of the backbone between the first and the last that the read meets.

    What the read has is its base (``-`` if none) and the bases it has before the next place. What it has beyond the
    backbone's start is at place -1, beyond its end after the last base. Bases at its ends that fit nowhere do not count.
    """
    pairs = _between(read, backbone, WORDS, True, True)
    met = [n for n, (p, q) in enumerate(pairs) if p >= 0 and q >= 0]
    if not met:
        return []
    out: list[list] = []
    lead = "".join(read[p] for p, _ in pairs[: met[0]] if p >= 0)
    first = pairs[met[0]][1]
    if lead and first == 0:
        out.append([-1, lead])
    for p, q in pairs[met[0] : met[-1] + 1]:
        if q >= 0:
            out.append([q, read[p] if p >= 0 else "-"])
        else:
            out[-1][1] += read[p]
    if out[-1][0] == len(backbone) - 1:
        out[-1][1] += "".join(read[p] for p, _ in pairs[met[-1] + 1 :] if p >= 0)
    return [(q, s) for q, s in out]


def orient(reads: DataFrame, group: list[str], key: str, k: int = 17) -> DataFrame:
    """``reads`` (``group, key, seq``) with ``seq`` on one strand within each group, and ``flipped``.

    In order of length (longest first, ties by key), each read is laid as it shares more words with the one before it, as that
    was laid; on a tie it is flipped. The first stays. Only neighbours are compared; the rest is a running parity.
    """
    order = Window.partitionBy(*group).orderBy(F.desc(F.length("seq")), key)
    placed = reads.withColumn("_at", F.row_number().over(order)).transform(cut)
    both = placed.select(*group, "_at", F.explode(F.array(F.struct(F.lit(1).alias("same"), F.col("seq").alias("s")), F.struct(F.lit(-1).alias("same"), S.reverse_complement("seq").alias("s")))).alias("x")).select(*group, "_at", "x.same", "x.s")
    mine = windows_of(both, k, [*group, "_at", "same"], "s").select(*group, (F.col("_at") - 1).alias("_at"), "same", "kmer")
    before = windows_of(placed, k, [*group, "_at"]).select(*group, "_at", "kmer").distinct()
    votes = mine.join(before, [*group, "_at", "kmer"]).groupBy(*group, (F.col("_at") + 1).alias("_at")).agg(F.sum("same").alias("votes"))
    rows = placed.join(votes, [*group, "_at"], "left").withColumn("_turn", F.when(F.col("_at") == 1, 0).when(F.col("votes") > 0, 0).when(F.col("votes") < 0, 1))
    # a tie lays the read on its other strand whatever was before: turns count from there
    w = Window.partitionBy(*group).orderBy("_at")
    rows = rows.withColumn("_part", F.count_if(F.col("_turn").isNull()).over(w))
    since = Window.partitionBy(*group, "_part").orderBy("_at")
    turns = F.sum(F.coalesce("_turn", F.lit(1))).over(since)
    rows = rows.withColumn("flipped", turns % 2 == 1)
    return rows.withColumn("seq", F.when(F.col("flipped"), S.reverse_complement("seq")).otherwise(F.col("seq"))).drop("_at", "votes", "_turn", "_part")


def column_rows(reads: DataFrame, backbones: DataFrame, group: list[str], key: str) -> DataFrame:
    """``group, key, place, shown``: what each read shows at the backbone's places (see columns). ``backbones`` has ``group, seq``."""
    kinds = {c: t for c, t in reads.dtypes}
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in (*group, key)) + ", place int, shown string"
    dealt = backbones.select(*group, F.col("seq").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    met = reads.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int")).join(dealt, [*group, "_share"])

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                shown = columns(row.seq, row.backbone)
                out = pd.DataFrame({"place": [q for q, _ in shown], "shown": [s for _, s in shown]})
                for c in (*group, key):
                    out[c] = pd.Series([getattr(row, c)] * len(shown), dtype=object)
                yield out[[*group, key, "place", "shown"]]

    return met.select(*group, key, "seq", F.col("_b").alias("backbone")).mapInPandas(lay, shape)


def consensus(reads: DataFrame, group: list[str], key: str, rounds: int = 16) -> DataFrame:
    """``group, seq``: the consensus of the oriented reads of each group.

    The longest read (ties: the smallest key) is the backbone. It grows at both ends by the longest stretch that a read
    has beyond them, until no read has any. Then at each place the commonest of what reads show there counts (ties: the
    smallest), which is a base, none, or a base with more after it.
    """
    first = F.min_by("seq", F.struct(-F.length("seq"), F.col(key)))
    spine = reads.groupBy(*group).agg(first.alias("seq")).transform(cut)
    for _ in range(rounds):
        rows = column_rows(reads, spine, group, key).transform(cut)
        sized = rows.join(spine.select(*group, F.length("seq").alias("_n")), group)
        longest = lambda test, piece: F.min(F.when(test, F.struct((-F.length(piece)).alias("n"), piece.alias("s"))))["s"]
        tail = F.substring("shown", F.lit(2), F.length("shown"))
        ends = sized.groupBy(*group).agg(longest(F.col("place") == -1, F.col("shown")).alias("_l"), longest((F.col("place") == F.col("_n") - 1) & (F.length("shown") > 1), tail).alias("_r"))
        grown = spine.join(ends, group, "left").select(*group, F.concat(F.coalesce("_l", F.lit("")), "seq", F.coalesce("_r", F.lit(""))).alias("seq"), (F.col("_l").isNotNull() | F.col("_r").isNotNull()).alias("_grew")).transform(cut)
        if grown.where("_grew").isEmpty():
            break
        spine = grown.drop("_grew")
    counts = rows.groupBy(*group, "place", "shown").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*group, "place").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("shown").alias("s")))["s"].alias("s"))
    return best.groupBy(*group).agg(S.ordered_concat("place", S.ungapped("s")).alias("seq"))


def locus_consensus(alignments: DataFrame, loci: DataFrame, key: str, locus: str) -> DataFrame:
    """``locus, seq``: the consensus (see consensus) of all whole reads that overlap each locus.

    ``alignments`` (``key, contig, pos, cigar, seq``) hold reads on the reference's strand, as alignment files do; rows without
    sequence (secondary ones) do not count, and a read of several alignments counts once a locus. ``loci`` have ``locus,
    contig, start, stop``. A locus without reads gives no row.
    """
    stop = F.col("pos") + reference_length("cigar")
    spans = alignments.where("contig is not null and seq is not null").select("contig", key, F.col("pos").alias("start"), stop.alias("stop"))
    met = overlap_join(spans, loci, key, locus).select(locus, key).distinct()
    longest = alignments.where("seq is not null").groupBy(key).agg(F.max_by("seq", F.struct(F.length("seq"), F.col("seq"))).alias("seq"))
    return consensus(met.join(longest, key).select(locus, key, "seq").transform(cut), [locus], key)
