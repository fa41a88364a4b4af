"""Weighted phasing of reads over sites. Cells are rows ``locus, read, site, allele (0, 1 or null), weight``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.lineage import cut, numbered

#: Most reads of a window (states are its subsets), sites of a window, and step between windows.
READS, SITES, STRIDE = 12, 60, 15
LIMIT = 15
#: Earlier windows that may share sites with one, up to which all their turns are worked out for a block.
BITS = 8


def partition_costs(alleles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Cost at one site of each subset of its reads as one side (bit i: read i): per side, the cheaper allele's total."""
    n = len(alleles)
    bits = np.arange(1 << n)[:, None] >> np.arange(n)[None, :] & 1
    zero, one = weights * (alleles == 0), weights * (alleles == 1)
    inside = np.minimum(bits @ zero, bits @ one)
    outside = np.minimum((1 - bits) @ zero, (1 - bits) @ one)
    return inside + outside


def solve(alleles: np.ndarray, weights: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(cost, haplotype 1, haplotype 2, side of each read) of the cheapest partition of reads; -1 is no allele.

    A read is active from its first to its last allele. Sites are taken in order; a subset of a site's active reads
    may follow any subset that agrees on the reads active at both. Equal costs go to the lowest subset. Haplotypes are
    opposite at each site; haplotype 1 takes the allele that suits its side better.
    """
    reads, sites = alleles.shape
    seen = alleles >= 0
    first = np.where(seen.any(axis=1), seen.argmax(axis=1), sites)
    last = np.where(seen.any(axis=1), sites - 1 - seen[:, ::-1].argmax(axis=1), -1)
    active = [np.flatnonzero((first <= s) & (last >= s)) for s in range(sites)]
    if max(map(len, active), default=0) > LIMIT:
        raise ValueError(f"more than {LIMIT} reads over one site")
    total, back = None, []
    for s in range(sites):
        now = active[s]
        cost = partition_costs(np.where(seen[now, s], alleles[now, s], -1), np.where(seen[now, s], weights[now, s], 0))
        if s:
            before = active[s - 1]
            common = np.intersect1d(now, before)
            old = _project(len(before), np.searchsorted(before, common))
            new = _project(len(now), np.searchsorted(now, common))
            best = np.full(1 << len(common), np.inf)
            np.minimum.at(best, old, total)
            choice = np.full(1 << len(common), -1)
            order = np.arange(len(total))[::-1]
            good = total[order] == best[old[order]]
            choice[old[order][good]] = order[good]
            back.append(choice[new])
            cost = cost + best[new]
        total = cost
    if not sites:
        return 0, np.zeros(0, int), np.zeros(0, int), np.full(reads, -1)
    state = int(np.argmin(total))
    answer = total[state]
    h1, side = np.zeros(sites, int), np.full(reads, -1)
    for s in range(sites - 1, -1, -1):
        now = active[s]
        inside = (state >> np.arange(len(now)) & 1).astype(bool)
        side[now] = np.where(inside, 0, 1)
        a, w = alleles[now, s], np.where(seen[now, s], weights[now, s], 0)
        ones = w[inside & (a == 1)].sum() + w[~inside & (a == 0)].sum()
        zeros = w[inside & (a == 0)].sum() + w[~inside & (a == 1)].sum()
        h1[s] = int(ones > zeros)
        if s:
            state = int(back[s - 1][state])
    return int(answer), h1, 1 - h1, side


def _project(n: int, kept: np.ndarray) -> np.ndarray:
    """For each subset of n reads, the subset of the kept ones."""
    masks = np.arange(1 << n)
    return sum(((masks >> int(k) & 1) << i for i, k in enumerate(kept)), np.zeros(1 << n, dtype=np.int64))


def phase(cells: DataFrame) -> DataFrame:
    """``locus, site, h1, h2, cost`` of each locus as one window."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        matrix, weights, _, sites = _dense(frame)
        cost, h1, h2, _ = solve(matrix, weights)
        return pd.DataFrame({"locus": frame["locus"].iat[0], "site": sites, "h1": h1, "h2": h2, "cost": cost})

    return cells.groupBy("locus").applyInPandas(run, "locus long, site long, h1 int, h2 int, cost long")


def _dense(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    reads, r = np.unique(frame["read"].to_numpy(), return_inverse=True)
    sites, s = np.unique(frame["site"].to_numpy(), return_inverse=True)
    matrix, weights = np.full((len(reads), len(sites)), -1), np.zeros((len(reads), len(sites)), dtype=np.int64)
    matrix[r, s] = frame["allele"].fillna(-1).to_numpy(dtype=int)
    weights[r, s] = np.where(matrix[r, s] >= 0, frame["weight"].fillna(0).to_numpy(dtype=np.int64), 0)
    return matrix, weights, reads, sites


def site_windows(cells: DataFrame, length: int = SITES, stride: int = STRIDE) -> DataFrame:
    """``locus, window, first, last`` in site numbers: starts every stride; none after the window that reaches the end."""
    n = cells.groupBy("locus").agg(F.count_distinct("site").alias("n"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("n") - length) / stride), F.lit(0)).cast("int")))
    rows = n.select("locus", "n", starts.alias("window"))
    return rows.select("locus", "window", (F.col("window") * stride).alias("first"), F.least(F.col("window") * stride + length, F.col("n")).cast("int").alias("last"))


def windowed_cells(cells: DataFrame, length: int = SITES, stride: int = STRIDE) -> DataFrame:
    """Cells with ``window`` and ``rank``, the number of their site in the locus; a cell is in each window over it.

    Ranks come from range partitions and windows from the rank alone, so a locus of any number of sites spreads over tasks.
    """
    placed = numbered(cells.select("locus", "site").distinct(), ["locus", "site"], "_n")
    size = placed.groupBy("locus").agg(F.min("_n").alias("_from"), F.count(F.lit(1)).alias("_sites"))
    ranked = placed.join(size, "locus").select("locus", "site", (F.col("_n") - F.col("_from")).alias("rank"), "_sites")
    first = F.greatest(F.floor((F.col("rank") - length) / stride) + 1, F.lit(0))
    last = F.least(F.floor(F.col("rank") / stride), F.greatest(F.ceil((F.col("_sites") - length) / stride), F.lit(0)))
    return cells.join(ranked, ["locus", "site"]).where(first <= last).withColumn("window", F.explode(F.sequence(first.cast("int"), last.cast("int")))).drop("_sites")


def best_reads(windowed: DataFrame, n: int = READS) -> DataFrame:
    """``locus, window, read, bad``: the ``n`` reads of each window with the fewest missing or zero-weight cells."""
    size = windowed.groupBy("locus", "window").agg(F.count_distinct("site").alias("sites"))
    good = windowed.groupBy("locus", "window", "read").agg(F.count_if(F.expr("allele is not null and weight > 0")).alias("good"))
    bad = good.join(size, ["locus", "window"]).withColumn("bad", F.col("sites") - F.col("good"))
    w = Window.partitionBy("locus", "window").orderBy("bad", "read")
    return bad.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select("locus", "window", "read", "bad")


def phase_windows(cells: DataFrame, length: int = SITES, stride: int = STRIDE, reads: int = READS) -> DataFrame:
    """``locus, site, h1, h2``: windows of the best reads are solved on their own, then stitched in order.

    Each window is turned so that it agrees with the sites stitched before it (ties: as it is), and adds the sites after them.
    """
    kind = dict(cells.dtypes)["locus"]
    win = windowed_cells(cells, length, stride)
    chosen = win.join(best_reads(win, reads), ["locus", "window", "read"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        matrix, weights, _, sites = _dense(frame)
        _, h1, h2, _ = solve(matrix, weights)
        return pd.DataFrame({"locus": frame["locus"].iat[0], "window": frame["window"].iat[0], "site": sites, "h1": h1})

    solved = cut(chosen.select("locus", "window", "read", "site", "allele", "weight").groupBy("locus", "window").applyInPandas(run, f"locus {kind}, window int, site long, h1 int"))
    return stitch(solved, -(-length // stride) - 1)


def stitch(solved: DataFrame, reach: int, block: int = 1024) -> DataFrame:
    """``locus, site, h1, h2`` of solved windows ``locus, window, site, h1``; a site takes the first window that has it.

    Windows that share a site are at most ``reach`` apart. A window is turned where it disagrees with more than half of
    the sites that earlier windows gave, as these were turned themselves. So its turn depends on the turns of the
    ``reach`` windows before it, and on how far it agrees with each, one number a pair. A block of windows thus maps
    every state (those turns) to one state; blocks are worked on apart, one fold over their maps gives the state
    each starts with, and they are gone through again from there. With a reach over BITS a locus is one block.
    """
    kind = dict(solved.dtypes)["locus"]
    given = solved.groupBy("locus", "site").agg(F.min(F.struct("window", "h1")).alias("g")).select("locus", "site", F.col("g.window").alias("given"), F.col("g.h1").alias("value"))
    agree = F.sum(F.when(F.col("h1") == F.col("value"), 1).otherwise(-1))
    pairs = solved.join(given, ["locus", "site"]).where("given < window").groupBy("locus", "window", "given").agg(agree.alias("agree"))
    number = F.floor(F.col("window") / block) if reach <= BITS else F.lit(0).cast("long")
    blocks = cut(pairs.select("locus", number.alias("block"), "window", (F.col("window") - F.col("given") - 1).cast("int").alias("back"), "agree"))

    def turned(states: np.ndarray, back: np.ndarray, agree: np.ndarray) -> np.ndarray:
        """The turn of a window in each state: bit i is the turn of the window i + 1 before it."""
        return ((1 - 2 * (states[:, None] >> back[None, :] & 1)) @ agree < 0).astype(np.int64)

    def shifted(states: np.ndarray, by: int) -> np.ndarray:
        """States ``by`` windows on; windows between that join with none are not turned."""
        return states << by & (1 << reach) - 1 if by < reach else np.zeros_like(states)

    def through(frame: pd.DataFrame, states: np.ndarray) -> tuple[list, np.ndarray]:
        """(turned windows, of the first state; states at the end of the block)."""
        at, found = int(frame["block"].iat[0]) * block, []
        for window, part in frame.sort_values("window").groupby("window", sort=False):
            states = shifted(states, int(window) - at)
            turn = turned(states, part["back"].to_numpy(), part["agree"].to_numpy())
            states = shifted(states, 1) | turn
            at = int(window) + 1
            if turn[0]:
                found.append(int(window))
        return found, shifted(states, (int(frame["block"].iat[0]) + 1) * block - at)

    def mapped(frame: pd.DataFrame) -> pd.DataFrame:
        _, ends = through(frame, np.arange(1 << reach))
        return pd.DataFrame({"locus": frame["locus"].iloc[:1], "block": frame["block"].iloc[:1], "ends": [ends.tolist()]})

    def folded(frame: pd.DataFrame) -> pd.DataFrame:
        frame, state, starts, after = frame.sort_values("block"), 0, [], 0
        for number, ends in zip(frame["block"], frame["ends"], strict=True):
            # blocks that are missing between turn nothing
            state = int(shifted(np.array([state]), (number - after) * block)[0])
            starts.append(state)
            state, after = int(ends[state]), number + 1
        return frame[["locus", "block"]].assign(start=starts)

    def gone_through(frame: pd.DataFrame) -> pd.DataFrame:
        found, _ = through(frame, np.array([frame["start"].iat[0]], dtype=np.int64))
        return pd.DataFrame({"locus": frame["locus"].iat[0], "given": found})

    if reach <= BITS:
        maps = blocks.groupBy("locus", "block").applyInPandas(mapped, f"locus {kind}, block long, ends array<long>")
        starts = maps.groupBy("locus").applyInPandas(folded, f"locus {kind}, block long, start long")
        ready = blocks.join(starts, ["locus", "block"])
    else:
        ready = blocks.withColumn("start", F.lit(0).cast("long"))
    turns = ready.groupBy("locus", "block").applyInPandas(gone_through, f"locus {kind}, given int").withColumn("turn", F.lit(1))
    h1 = F.col("value").bitwiseXOR(F.coalesce("turn", F.lit(0)))
    return given.join(turns, ["locus", "given"], "left").select("locus", "site", h1.alias("h1"), (1 - h1).alias("h2"))


def assign_reads(cells: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """``locus, read, haplotype``: each read's side by weighted agreement with both haplotypes; ties are haplotype 1."""
    votes = cells.where("allele is not null").join(haplotypes, ["locus", "site"])
    score = F.sum(F.when(F.col("allele") == F.col("h1"), F.col("weight")).otherwise(-F.col("weight")))
    return votes.groupBy("locus", "read").agg(F.when(score >= 0, 1).otherwise(2).alias("haplotype"))


def assign_by_sites(cells: DataFrame, haplotypes: DataFrame, least: int = 2) -> DataFrame:
    """``locus, read, haplotype, p1, p2`` of reads with ``least`` informative sites and more matches with one haplotype."""
    rows = cells.where("allele is not null").join(haplotypes.where("h1 <> h2"), ["locus", "site"])
    counts = rows.groupBy("locus", "read").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("allele = h1")).alias("p1"), F.count_if(F.expr("allele = h2")).alias("p2"))
    return counts.where((F.col("n") >= least) & (F.col("p1") != F.col("p2"))).select("locus", "read", F.when(F.col("p1") > F.col("p2"), 1).otherwise(2).alias("haplotype"), "p1", "p2")


def assign_by_identity(cells: DataFrame, haplotypes: DataFrame, least: float = 0.8) -> DataFrame:
    """``locus, read, haplotype`` of reads over ``least`` identical to either haplotype; ties go to the second."""
    rows = cells.where("allele is not null").join(haplotypes, ["locus", "site"])
    r = rows.groupBy("locus", "read").agg(F.avg((F.col("allele") == F.col("h1")).cast("double")).alias("r1"), F.avg((F.col("allele") == F.col("h2")).cast("double")).alias("r2"))
    return r.where(F.greatest("r1", "r2") > least).select("locus", "read", F.when(F.col("r1") > F.col("r2"), 1).otherwise(2).alias("haplotype"))


def majority(votes: DataFrame) -> DataFrame:
    """``locus, read, haplotype`` by majority of window votes (1 or 2); ties are haplotype 1."""
    return votes.groupBy("locus", "read").agg(F.when(F.sum(F.when(F.col("haplotype") == 1, 1).otherwise(-1)) >= 0, 1).otherwise(2).alias("haplotype"))
