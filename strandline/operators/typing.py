"""Haplotype typing by site matches, repeat tables, gene painting, and the set and top-k steps they need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators.lineage import numbered
from strandline.operators.pileup import cigar_offsets, match_value

# --- ordered picks --------------------------------------------------------------------------------------------------


def first_n(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def dedup_pairs(records: DataFrame, name: str, order: str) -> DataFrame:
    """The first two records of each read name."""
    return first_n(records, [name], [order], 2)


def exact_pairs(records: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(records of names with exactly two, one row with the number of records dropped)."""
    counts = records.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    marked = records.join(counts, name)
    return marked.where("_n = 2").drop("_n"), marked.agg(F.count_if(F.expr("_n <> 2")).alias("dropped"))


def chunk_names(rows: DataFrame, order: str, size: int, by: list[str]) -> DataFrame:
    """``rows`` with ``chunk``: groups of ``size`` in order, within ``by``.

    Rows are numbered over range partitions, so a large group spreads over tasks.
    """
    placed = numbered(rows, [*by, order], "_n")
    first = placed.groupBy(*by).agg(F.min("_n").alias("_first"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    joined = placed.alias("p").join(first.alias("f"), same).select("p.*", "_first")
    return joined.withColumn("chunk", F.floor((F.col("_n") - F.col("_first")) / size)).drop("_n", "_first")


def numbered_suffix(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``rows`` with ``name`` followed by ``_n`` for the second and later rows of a group."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit("_"), n)).otherwise(F.col(name)))


def best_with_ties(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """All rows at the group's largest value."""
    top = rows.groupBy(*by).agg(F.max(value).alias("_top"))
    return rows.join(top, by).where(F.col(value) == F.col("_top")).drop("_top")


def best_and_second(rows: DataFrame, by: list[str], fraction: str, total: str, major: str) -> DataFrame:
    """Rows of the best (fraction, total), with ``place`` 1, and the best others of another major allele, with 2."""
    w = Window.partitionBy(*by).orderBy(F.desc(fraction), F.desc(total))
    first = rows.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")
    rest = rows.join(first.select(*by, major).distinct(), [*by, major], "left_anti")
    second = rest.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")
    return first.withColumn("place", F.lit(1)).unionByName(second.withColumn("place", F.lit(2)))


def score_paths_keep(rows: DataFrame, by: list[str], value: str, least: float) -> DataFrame:
    """The best row of each group, and the next one if its value is over ``least``."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    ranked = rows.withColumn("_n", F.row_number().over(w))
    return ranked.where((F.col("_n") == 1) | ((F.col("_n") == 2) & (F.col(value) > least))).drop("_n")


# --- sets -----------------------------------------------------------------------------------------------------------


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, side``: whether each distinct key is in ``a`` only, ``b`` only, or both."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full").select(key, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "a").otherwise("b").alias("side"))


# --- typing ---------------------------------------------------------------------------------------------------------


def site_definitions(variants: DataFrame, allele: str = "allele") -> DataFrame:
    """``variants`` (``allele, pos, ref, alt``) with ``offset``: length changes of the allele's sites before each one."""
    w = Window.partitionBy(allele).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return variants.withColumn("offset", F.coalesce(F.sum(F.length("alt") - F.length("ref")).over(w), F.lit(0)))


def aligned_pairs(alignments: DataFrame, key: list[str]) -> DataFrame:
    """``key, ref_pos, hap_pos`` of aligned bases (``pos, cigar``)."""
    rows = cigar_offsets(alignments.withColumn("_k", F.struct(*key)), "_k", keep=("pos",)).where(F.col("op").isin("M", "=", "X"))
    rows = rows.select("_k", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("j"), (F.col("pos") + F.col("ref_off")).alias("r"), F.col("read_off").alias("h"))
    return rows.select("_k.*", (F.col("r") + F.col("j")).alias("ref_pos"), (F.col("h") + F.col("j")).alias("hap_pos"))


def star_pairs(alignments: DataFrame, order: str) -> DataFrame:
    """``hap, allele, n, ref_pos, hap_pos`` of bases of alleles (``allele``, the read) aligned to haplotypes (``hap``, the reference).

    ``ref_pos`` is the allele's place and ``n`` the number of the alignment, from 1, among those of its allele and haplotype.
    """
    n = F.row_number().over(Window.partitionBy("hap", "allele").orderBy(order))
    rows = aligned_pairs(alignments.withColumn("n", n), ["hap", "allele", "n"])
    return rows.select("hap", "allele", "n", F.col("hap_pos").alias("ref_pos"), F.col("ref_pos").alias("hap_pos"))


def site_matches(sites: DataFrame, pairs: DataFrame, haps: DataFrame, stars: DataFrame, context: int = 20) -> DataFrame:
    """``hap, allele, pos, ref, alt`` of sites at which a haplotype has what the allele has.

    ``sites`` (``allele, pos, ref, alt, offset``), ``pairs`` (``hap, allele, ref_pos, hap_pos``: places in the allele and the
    haplotype; see star_pairs), sequences ``haps`` (``hap, seq``) and ``stars`` (``allele, seq``). At a site that changes no
    length, the haplotype must have the site's ``alt``. At others, it must have the allele's bases from ``context`` before
    the site to ``context`` after ``alt``, as far as either sequence goes; of the haplotype, only the aligned segment counts.
    With ``n`` in ``pairs``, a further alignment of one allele is a haplotype of its own, with its number after the name.
    """
    numbered = "n" in pairs.columns
    by = ["hap", "allele", *(["n"] if numbered else [])]
    reach = pairs.groupBy(*by).agg(F.min("hap_pos").alias("_first"), F.max("hap_pos").alias("_last"))
    at = sites.withColumn("ref_pos", F.col("pos") + F.col("offset")).join(pairs, ["allele", "ref_pos"]).join(reach, by)
    both = at.join(haps.select("hap", F.upper("seq").alias("_h")), "hap").join(stars.select("allele", F.upper("seq").alias("_s")), "allele")
    n, place = F.length("alt"), F.col("hap_pos") - F.col("_first")
    segment = F.substring("_h", F.col("_first") + 1, F.col("_last") - F.col("_first") + 1)

    def around(seq: Column, pos: Column) -> Column:
        start = F.greatest(pos - context, F.lit(0))
        return F.substring(seq, start + 1, pos + n + context - start)

    same = F.when(F.length("ref") == n, F.substring(segment, place + 1, n) == F.upper("alt")).otherwise(around(segment, place) == around(F.col("_s"), F.col("ref_pos")))
    name = F.when(F.col("n") > 1, F.concat_ws("_", "hap", "n")).otherwise(F.col("hap").cast("string")) if numbered else F.col("hap")
    return both.where(same).select(name.alias("hap"), "allele", "pos", "ref", "alt")


def count_sites(matches: DataFrame, sites: DataFrame) -> DataFrame:
    """``hap, allele, matched, total, fraction``."""
    total = sites.groupBy("allele").agg(F.count_distinct("pos", "ref", "alt").alias("total"))
    got = matches.groupBy("hap", "allele").agg(F.count_distinct("pos", "ref", "alt").alias("matched"))
    return got.join(total, "allele").withColumn("fraction", F.col("matched") / F.col("total")).select("hap", "allele", "matched", "total", "fraction")


def genomic_best(alignments: DataFrame, order: str, least: int = 6_000, haps: Sequence[str] = (), alleles: Sequence[str] = ()) -> DataFrame:
    """``hap, allele, score``: the alleles (``qname``) that match each haplotype (``contig``) best, ties included.

    Alignments scored under ``least`` by their AS tag, those of the haplotypes ``haps`` and of the ``alleles`` are left out. A
    further alignment of one allele to one haplotype counts as a haplotype of its own, with its number after the name.
    """
    rows = alignments.where(F.col("tags")["AS"].try_cast("int") >= least).select(F.col("contig").alias("hap"), F.col("qname").alias("allele"), match_value("cigar").alias("score"), order)
    rows = rows.where(~F.col("hap").isin(*haps) & ~F.col("allele").isin(*alleles))
    named = numbered_suffix(rows.withColumn("_own", F.col("hap")), ["_own", "allele"], order, "hap")
    return best_with_ties(named, ["hap"], "score").select("hap", "allele", "score").distinct()


def final_allele(site_best: DataFrame, genome_best: DataFrame, fallback: str | None = None) -> DataFrame:
    """``hap, call`` from the best alleles by sites (``hap, allele, fraction``) and over the whole gene (``hap, allele``).

    Where the best have all their sites matched, the one allele that is also best over the gene is the call. Where they
    have not, the fallback (an allele without sites) is, if it is best over the gene. All else is ``Ambiguous``.
    """
    a = site_best.groupBy("hap").agg(F.collect_set("allele").alias("a"), F.max("fraction").alias("f"))
    b = genome_best.groupBy("hap").agg(F.collect_set("allele").alias("b"))
    none = F.array().cast("array<string>")
    both = a.join(b, "hap", "full").select("hap", "f", F.coalesce("b", none).alias("b"), F.array_intersect(F.coalesce("a", none), F.coalesce("b", none)).alias("c"))
    whole = F.abs(F.coalesce("f", F.lit(0.0)) - 1) <= 1e-9
    call = F.when(whole & (F.size("c") == 1), F.element_at("c", 1))
    if fallback is not None:
        call = call.when(~whole & F.array_contains("b", fallback), fallback)
    return both.select("hap", call.otherwise("Ambiguous").alias("call"))


def call_report(calls: DataFrame, counts: DataFrame) -> DataFrame:
    """``hap, call, sites``: each call with its ``matched/total``."""
    return calls.join(counts.withColumnRenamed("allele", "call"), ["hap", "call"], "left").select("hap", "call", F.when(F.col("total").isNotNull(), F.format_string("%d/%d", "matched", "total")).alias("sites"))


# --- painting -------------------------------------------------------------------------------------------------------


def paint(hits: DataFrame, main: Sequence[str], by: list[str]) -> DataFrame:
    """``by, gene``: the gene that a window maps to best; ``Both`` if that is both main genes, else a main one, else the smallest."""
    top = best_with_ties(hits, by, "mapq").groupBy(*by).agg(F.array_sort(F.collect_set("gene")).alias("g"))
    has = [F.array_contains("g", m) for m in main]
    all_main = has[0]
    for h in has[1:]:
        all_main = all_main & h
    pick = F.when(all_main, "Both")
    for h, m in zip(has, main, strict=True):
        pick = pick.when(h, m)
    return top.select(*by, pick.otherwise(F.element_at("g", 1)).alias("gene"))


def paint_lines(painted: DataFrame, lengths: DataFrame, key: str, size: int, least: int = 1) -> DataFrame:
    """``key, line, coloured``: the genes of every window of a sample in order, ``-`` without one; ``>`` marks a window past the end.

    Samples with fewer than ``least`` windows with a gene are left out.
    """
    grid = lengths.select(key, F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size))).alias("start"), "length")
    rows = grid.join(painted, [key, "start"], "left")
    mark = F.concat(F.coalesce("gene", F.lit("-")), F.when(F.col("start") + size > F.col("length"), ">").otherwise(""))
    lines = rows.groupBy(key).agg(S.ordered_concat("start", mark, " ").alias("line"), F.count("gene").alias("coloured"))
    return lines.where(F.col("coloured") >= least)


# --- repeats --------------------------------------------------------------------------------------------------------


def repeat_table(haps: DataFrame, unit: str, begins: Sequence[str], ends: Sequence[str], interruptions: Sequence[tuple[str, str]], counted: Sequence[str] = ()) -> DataFrame:
    """``repeat, n_repeats, n_haps, haps, interruptions``: distinct repeat sequences of haplotypes (``hap, seq``).

    ``counted`` interruptions count as repeats too (see repeat_units). Largest sets of haplotypes come first, then fewer
    repeats, then the sequence.
    """
    # explode keeps the filter from working the repeat out a second time
    rows = haps.select("hap", F.explode(F.array(S.trim_to_repeat("seq", begins, ends)["repeat"])).alias("repeat")).where("repeat is not null")
    groups = rows.groupBy("repeat").agg(F.array_sort(F.collect_set("hap")).alias("haps"))
    out = groups.select("repeat", S.repeat_units("repeat", unit, counted).alias("n_repeats"), F.size("haps").alias("n_haps"), "haps", S.repeat_interruptions("repeat", interruptions).alias("interruptions"))
    return out.orderBy(F.desc("n_haps"), "n_repeats", "repeat")


def repeat_histogram(table: DataFrame) -> DataFrame:
    """``n_repeats, haps``: haplotypes by number of repeats."""
    return table.groupBy("n_repeats").agg(F.sum("n_haps").alias("haps"))


def interruption_totals(table: DataFrame) -> DataFrame:
    """``interruption, n``: interruptions over all haplotypes."""
    rows = table.select("n_haps", F.explode("interruptions").alias("interruption", "n"))
    return rows.groupBy("interruption").agg(F.sum(F.col("n") * F.col("n_haps")).alias("n"))


def male_rule(haps: DataFrame, sexes: DataFrame) -> DataFrame:
    """``sample, hap, repeat`` without males who have two different repeats, and with one row of those who have one twice."""
    rows = haps.join(sexes, "sample", "left")
    kinds = haps.groupBy("sample").agg(F.count_distinct("repeat").alias("_kinds"))
    ok = rows.join(kinds, "sample").where((F.coalesce("sex", F.lit("")) != "male") | (F.col("_kinds") == 1))
    w = Window.partitionBy("sample").orderBy("hap")
    return ok.withColumn("_n", F.row_number().over(w)).where((F.coalesce("sex", F.lit("")) != "male") | (F.col("_n") == 1)).select("sample", "hap", "repeat")


def concordance(assembled: DataFrame, called: DataFrame) -> DataFrame:
    """``repeat, n_haps, confirmed``: whether another caller has a repeat in any of the same samples."""
    a = assembled.groupBy("repeat").agg(F.count(F.lit(1)).alias("n_haps"), F.collect_set("sample").alias("x"))
    b = called.groupBy("repeat").agg(F.collect_set("sample").alias("y"))
    return a.join(b, "repeat", "left").select("repeat", "n_haps", F.coalesce(F.arrays_overlap("x", "y"), F.lit(False)).alias("confirmed"))


def concordance_counts(rows: DataFrame) -> DataFrame:
    """One row: repeats confirmed and not, and the same for those of one haplotype."""
    single = F.col("n_haps") == 1
    return rows.agg(F.count_if("confirmed").alias("confirmed"), F.count_if(F.expr("not confirmed")).alias("missed"), F.count_if(F.col("confirmed") & single).alias("confirmed_single"), F.count_if(~F.col("confirmed") & single).alias("missed_single"))


def combine_haplotypes(records: DataFrame, prefix: str) -> DataFrame:
    """``sample, hap, seq``: the first record with a name prefix of each sample and haplotype (``ord`` tells the order)."""
    return first_n(records.where(F.col("name").startswith(prefix)), ["sample", "hap"], ["ord"], 1).select("sample", "hap", "seq")
