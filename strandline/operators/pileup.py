"""CIGAR expansion, pile-ups, allele matrices and consensus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import sequence as S
from strandline.operators.intervals import BIN, base_at, overlap_join

#: Operations that move along the reference, and along the read.
ON_REF, ON_READ = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X")
#: Counts of letters by column that a task holds before it hands them on.
HELD_COUNTS = 8_000_000


def parse_cigar(cigar: Column | str) -> Column:
    """Array of ``op, len`` of a CIGAR text."""
    parts = F.regexp_extract_all(S.col(cigar), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.regexp_extract(p, "[0-9]+", 0).cast("int").alias("len")))


_KINDS = "MIDNSHP=X"


def _operations(cigars: list[str | None]) -> tuple[np.ndarray, ...]:
    """(row, number in its row, kind in _KINDS, length, offset on the reference, offset on the read) of all operations of some CIGARs.

    The texts are laid one after the other, and all numbers and sums are made at once.
    """
    text = np.frombuffer("\n".join(["", *(c or "" for c in cigars), ""]).encode(), np.uint8)
    signs = np.flatnonzero((text < 48) | (text > 57))
    digits = np.flatnonzero((text >= 48) & (text <= 57))
    after = np.searchsorted(signs, digits)
    values = np.bincount(after, (text[digits] - 48.0) * 10.0 ** (signs[after] - 1 - digits), len(signs)).astype(np.int64)
    kind = np.full(256, -1, np.int8)
    kind[np.frombuffer(_KINDS.encode(), np.uint8)] = range(len(_KINDS))
    whole = (kind[text[signs]] >= 0) & (signs > 0)
    whole[whole] = np.isin(signs[whole] - 1, digits, assume_unique=True)
    row = (np.cumsum(text[signs] == 10) - 1)[whole]
    ops, size = kind[text[signs[whole]]], values[whole]
    first = np.searchsorted(row, row)
    offsets = []
    for moving in (ON_REF, ON_READ):
        before = np.concatenate([[0], np.cumsum(np.where(np.isin(ops, [_KINDS.index(m) for m in moving]), size, 0))])[:-1]
        offsets.append(before - before[first] if len(before) else before)
    return row, np.arange(len(row)) - first, ops, size, *offsets


def cigar_offsets(alignments: DataFrame, key: str, cigar: str = "cigar", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, i, op, len, ref_off, read_off``: each operation with the bases that lie before it on both sides.

    Running sums are made batch by batch in linear time, from the CIGAR alone; no shuffle is needed.
    """
    names = (key, *keep)
    fields = [f for name in names for f in alignments.schema if f.name == name]
    more = [T.StructField(name, kind) for name, kind in (("i", T.IntegerType()), ("op", T.StringType()), *((c, T.IntegerType()) for c in ("len", "ref_off", "read_off")))]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.array(list(_KINDS))
        for batch in batches:
            row, i, ops, *numbers = _operations(batch.column(len(names)).to_pylist())
            at = pa.array(row)
            columns = [batch.column(c).take(at) for c in range(len(names))]
            columns += [pa.array(i.astype(np.int32)), kinds.take(pa.array(ops)), *(pa.array(n.astype(np.int32)) for n in numbers)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(f.name for f in more)])

    return alignments.select(*names, F.col(cigar).alias("_cigar")).mapInArrow(expand, T.StructType([*fields, *more]))


def reference_length(cigar: Column | str) -> Column:
    """Bases of the reference that a CIGAR covers."""
    return F.aggregate(parse_cigar(cigar), F.lit(0), lambda acc, x: acc + F.when(x["op"].isin(*ON_REF), x["len"]).otherwise(0))


def match_value(cigar: Column | str, match: tuple[str, ...] = ("=",)) -> Column:
    """Matched bases of a CIGAR less mismatched, inserted and deleted ones."""
    value = lambda acc, x: acc + F.when(x["op"].isin(*match), x["len"]).when(x["op"].isin("X", "I", "D"), -x["len"]).otherwise(0)
    return F.aggregate(parse_cigar(cigar), F.lit(0), value)


def match_score(alignments: DataFrame, key: str, cigar: str = "cigar", match: tuple[str, ...] = ("=",)) -> DataFrame:
    """``key, score``: matched bases less mismatched, inserted and deleted ones."""
    return alignments.select(key, match_value(cigar, match).alias("score"))


def trim_clips(seq: Column | str, cigar: Column | str, is_reverse: Column | str) -> Column:
    """Read without leading and trailing soft clips, in its own orientation."""
    s = S.col(seq)
    lead = F.coalesce(F.regexp_extract(S.col(cigar), "^([0-9]+)S", 1).try_cast("int"), F.lit(0))
    tail = F.coalesce(F.regexp_extract(S.col(cigar), "([0-9]+)S$", 1).try_cast("int"), F.lit(0))
    body = F.substring(s, lead + 1, F.length(s) - lead - tail)
    return F.when(S.col(is_reverse), S.reverse_complement(body)).otherwise(body)


def primary(alignments: DataFrame) -> DataFrame:
    """Alignments that are neither secondary nor supplementary."""
    return alignments.where("not is_secondary and not is_supplementary")


def by_haplotype(alignments: DataFrame, haplotype: str, untagged: bool = False) -> DataFrame:
    """Alignments with the HP tag of a haplotype; ``untagged`` keeps those without a tag as well."""
    tag = F.col("tags")["HP"]
    return alignments.where((tag == haplotype) | (tag.isNull() & F.lit(untagged)))


def with_sample(alignments: DataFrame, groups: DataFrame, strict: bool = False) -> DataFrame:
    """Alignments with ``sample`` of their RG tag (``groups``: ``rg, sample``); ``unknown``, or an error, without one."""
    out = alignments.withColumn("rg", F.col("tags")["RG"]).join(groups, "rg", "left")
    missing = F.raise_error(F.lit("read group without sample")) if strict else F.lit("unknown")
    return out.withColumn("sample", F.coalesce("sample", missing)).drop("rg")


def aligned_bases(alignments: DataFrame, key: str, legacy_insertion: bool = False) -> DataFrame:
    """``key, contig, pos, bases, quals``: what each read shows at each reference position it covers.

    An insertion follows the base before it; a deleted position shows nothing. ``legacy_insertion`` repeats the base
    before the insertion and drops the inserted string's last one.
    """
    ops = cigar_offsets(alignments, key, keep=("contig", "pos", "seq", "qual"))
    w = Window.partitionBy(key).orderBy("i")
    after = ops.withColumn("_op2", F.lead("op").over(w)).withColumn("_len2", F.lead("len").over(w))
    rows = after.where(F.col("op").isin("M", "=", "X") & (F.col("len") > 0))
    # each operation's part is taken out of the read once and cut into its bases, so a read of any length costs linear time
    at = F.col("read_off") + 1
    none = F.array().cast("array<string>")
    parts = [F.substring(c, at, F.col("len")) for c in ("seq", "qual")]
    zipped = F.arrays_zip(F.split(parts[0], "").alias("b"), F.coalesce(F.split(parts[1], ""), none).alias("q"))
    extra = [F.when(F.col("_op2") == "I", F.substring(c, at + F.col("len"), F.col("_len2"))).otherwise("") for c in ("seq", "qual")]
    spots = rows.select(key, "contig", "pos", "ref_off", "len", "_len2", extra[0].alias("_b"), extra[1].alias("_q"), F.posexplode(zipped).alias("j", "x"))
    last = (F.col("j") == F.col("len") - 1) & (F.col("_b") != "")

    def shown(own: str, more: str) -> Column:
        whole = F.concat(own, more)
        return F.when(last, F.concat(own, F.substring(whole, F.lit(1), F.col("_len2"))) if legacy_insertion else whole).otherwise(F.col(own))

    return spots.select(key, "contig", (F.col("pos") + F.col("ref_off") + F.col("j")).alias("pos"), shown("x.b", "_b").alias("bases"), shown("x.q", "_q").alias("quals"))


def assemble_pileup(bases: DataFrame, loci: DataFrame, key: str, locus: str, bin_size: int = BIN) -> DataFrame:
    """``locus, key, seq, qual``: each read's bases inside each locus, in reference order."""
    spots = bases.select("contig", key, F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"), "bases", "quals")
    cut = loci.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("stop") - 1) / bin_size)))).select("contig", "bin", locus, F.col("start").alias("_a"), F.col("stop").alias("_b"))
    rows = spots.withColumn("bin", F.floor(F.col("start") / bin_size)).join(cut, ["contig", "bin"]).where("start >= _a and start < _b")
    return rows.groupBy(locus, key).agg(S.ordered_concat("start", "bases").alias("seq"), S.ordered_concat("start", "quals").alias("qual"))


def read_pileup(alignments: DataFrame, loci: DataFrame, key: str, locus: str, bin_size: int = BIN, shown: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """``locus, key, seq, qual``: assemble_pileup of aligned_bases, for alignments and loci whose names occur once.

    Alignments meet loci as intervals, each with the text that it shows and where each position's part of it begins; a pair
    is then two numbers and a substring. No base becomes a row, and pairs are neither shuffled nor grouped. ``shown`` tells what
    is returned of a text: it is made once for an alignment whose loci hold it whole, and for each pair where a locus cuts it.
    """
    kind = alignments.schema[key]
    fields = [kind, alignments.schema["contig"], *(T.StructField(n, T.LongType()) for n in ("start", "stop")), *(T.StructField(n, T.StringType()) for n in ("text", "quals")), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("at", "quals_at"))]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(10_000)(_shown_places)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows, out, at, quals_at = [], [], [], []
            for i, (pos, cigar, seq, qual) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                if pos is None or seq is None or not (places := known(cigar, len(seq), len(seq))):
                    continue
                qual = qual or ""
                other = known(cigar, len(qual), len(seq))
                rows.append(i)
                out.append((pos, pos + len(places[1]) - 1, *("".join([text[x:y] for x, y in parts]) for text, (parts, _) in ((seq, places), (qual, other)))))
                at.append(places[1])
                quals_at.append(None if np.array_equal(other[1], places[1]) else other[1])
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), _listed(at), _listed(quals_at)], [f.name for f in fields])

    laid = alignments.select(key, "contig", "pos", "cigar", "seq", "qual").mapInArrow(lay, T.StructType(fields))
    reads = laid.select("contig", "start", "stop", F.struct(F.col(key).alias("key"), "text", "quals", "at", "quals_at").alias("_read"))

    def ready(x: Column) -> Column:
        own = F.struct(shown(x["text"]).alias("seq"), shown(x["quals"]).alias("qual"), ((x["text"] != "") | (x["quals"] != "")).alias("any"))
        return F.struct(x["key"].alias("key"), x["text"].alias("text"), x["quals"].alias("quals"), x["at"].alias("at"), F.coalesce(x["quals_at"], x["at"]).alias("quals_at"), own.alias("own"))

    pairs = overlap_join(reads, loci.select("contig", "start", "stop", locus), "_read", locus, bin_size, ready=ready)
    first, end = F.greatest(F.col("b_start") - F.col("a_start"), F.lit(0)).cast("int"), (F.least("b_stop", "a_stop") - F.col("a_start")).cast("int")
    whole = (F.col("b_start") <= F.col("a_start")) & (F.col("b_stop") >= F.col("a_stop"))
    span = lambda at: (F.get(F.col(f"_read.{at}"), first), F.get(F.col(f"_read.{at}"), end))

    def piece(text: str, at: str, name: str) -> Column:
        a, z = span(at)
        return F.when(whole, F.col(f"_read.own.{name}")).otherwise(shown(F.substring(F.col(f"_read.{text}"), a + 1, z - a))).alias(name)

    (a, z), (qual_a, qual_z) = span("at"), span("quals_at")
    some = F.when(whole, F.col("_read.own.any")).otherwise((a < z) | (qual_a < qual_z))
    return pairs.where(some).select(locus, F.col("_read.key").alias(key), piece("text", "at", "seq"), piece("quals", "quals_at", "qual"))


def _shown_runs(cigar: str | None) -> list[tuple[int, int, int, int]]:
    """(offset on the reference, length, offset on the read, inserted bases after it) of a CIGAR's operations that show bases."""
    _, _, ops, size, ref, read = (x.tolist() for x in _operations([cigar]))
    inserted = [n if _KINDS[op] == "I" else 0 for op, n in zip(ops[1:], size[1:], strict=True)] + [0] * bool(ops)
    return [(r, n, q, more) for op, n, r, q, more in zip(ops, size, ref, read, inserted, strict=True) if _KINDS[op] in "M=X" and n > 0]


def _shown_places(cigar: str | None, n_text: int, n_seq: int) -> tuple[list[tuple[int, int]], np.ndarray] | None:
    """What a text of ``n_text`` letters shows, as its slices, and where the part of each reference position begins in them.

    One more place tells where the last part ends. A text may end early; an insertion stands after a base only where the
    sequence, of ``n_seq`` bases, has any of it.
    """
    parts, at, shown = [], [], 0
    runs = _shown_runs(cigar)
    for ref, n, read, more in runs:
        at += [shown] * (ref - len(at))
        own = max(min(n, n_text - read), 0)
        at += range(shown, shown + own)
        at += [shown + own] * (n - own)
        if more and own == n and n_seq > read + n:
            own = max(min(n + more, n_text - read), 0)
        parts.append((read, read + own))
        shown += own
    return (parts, np.array([*at, shown], np.int32)) if runs else None


def _listed(arrays: list[np.ndarray | None]) -> pa.ListArray:
    """Arrays of numbers as one column, laid one after the other; None is null."""
    sizes = np.array([0 if x is None else len(x) for x in arrays], np.int64)
    values = np.concatenate([x for x in arrays if x is not None] or [np.zeros(0, np.int32)])
    missing = pa.array([x is None for x in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values), mask=missing)


def column_consensus(columns: DataFrame, group: list[str], pos: str = "pos", base: str = "base") -> DataFrame:
    """``group, seq``: the commonest base of each column (ties: the smallest), gaps dropped, in order."""
    return _commonest(columns.groupBy(*group, pos, base).agg(F.count(F.lit(1)).alias("n")), group, pos, base)


def _commonest(counts: DataFrame, group: list[str], pos: str, base: str) -> DataFrame:
    best = counts.groupBy(*group, pos).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(base).alias("b")))["b"].alias("b"))
    return best.where("b <> '-'").groupBy(*group).agg(S.ordered_concat(pos, "b").alias("seq"))


def text_consensus(texts: DataFrame, group: list[str], seq: str = "seq") -> DataFrame:
    """``group, seq``: column_consensus of texts that start at one column; groups of empty texts alone give no row.

    A task counts the letters of its texts by column before anything is shuffled, and hands its counts on when it holds
    HELD_COUNTS of them, so no row is made for a base.
    """
    more = [T.StructField("pos", T.IntegerType()), T.StructField("base", T.StringType()), T.StructField("n", T.LongType())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (*names, letter), n in held.items():
                at = np.flatnonzero(n)
                own = [pa.repeat(pa.scalar(x, t), len(at)) for x, t in zip([*names, letter], [*types, pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([*own[:-1], pa.array(at.astype(np.int32)), own[-1], pa.array(n[at])], [*group, *(f.name for f in more)])
            held.clear()

        size = 0
        for batch in batches:
            types[:] = batch.schema.types[: len(group)]
            for *names, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                for letter in set(text):
                    n = held.get((*names, letter))
                    if n is None or len(n) < len(points):
                        wider = np.zeros(max(len(points), 2 * (0 if n is None else len(n))), np.int64)
                        if n is not None:
                            wider[: len(n)] = n
                        size += len(wider) - (0 if n is None else len(n))
                        n = held[(*names, letter)] = wider
                    n[: len(points)] += points == ord(letter)
                if size > HELD_COUNTS:
                    yield from handed_on()
                    size = 0
        yield from handed_on()

    rows = texts.where(F.length(seq) > 0).select(*group, F.col(seq).alias("_s"))
    counts = rows.mapInArrow(count, T.StructType([*(texts.schema[c] for c in group), *more])).groupBy(*group, "pos", "base").agg(F.sum("n").alias("n"))
    return _commonest(counts, group, "pos", "base")


def allele_mode(alleles: DataFrame, site: list[str], allele: str = "allele") -> DataFrame:
    """``site, mode, n, n_alleles``: the commonest allele of each site (ties: the smallest)."""
    counts = alleles.groupBy(*site, allele).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*site).agg(F.min_by(allele, F.struct(-F.col("c"), F.col(allele))).alias("mode"), F.max("c").alias("n"), F.count(F.lit(1)).alias("n_alleles"))


def best_allele(alleles: DataFrame, site: list[str], allele: str = "allele", long: int = 1_000) -> DataFrame:
    """``site, best``: the longest allele if it is over ``long`` bases, else the commonest."""
    counts = alleles.groupBy(*site, allele).agg(F.count(F.lit(1)).alias("c")).withColumn("len", F.length(allele))
    common = F.min_by(allele, F.struct(-F.col("c"), F.col(allele)))
    longest = F.min_by(allele, F.struct(-F.col("len"), F.col(allele)))
    return counts.groupBy(*site).agg(F.when(F.max("len") > long, longest).otherwise(common).alias("best"))


def variant_alleles(alignments: DataFrame, chunks: DataFrame, key: str, chunk: int = 10_000) -> DataFrame:
    """``contig, pos, key, allele, qual``: what reads show where they differ from the reference.

    Mismatches stand at their base, insertions and soft clips at the position reached, deletions at the one before,
    as dashes. The longest allele (ties: the smallest) of a read at a position stays.
    """
    ops = cigar_offsets(alignments, key, keep=("contig", "pos", "seq", "qual")).withColumn("at", F.col("pos") + F.col("ref_off"))
    code = lambda c: F.ascii(c) - 33
    match = ops.where(F.col("op").isin("M", "X")).select(key, "contig", "seq", "qual", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("j"), "at", "read_off")
    match = match.select(key, "contig", (F.col("at") + F.col("j")).alias("pos"), F.substring("seq", F.col("read_off") + F.col("j") + 1, F.lit(1)).alias("allele"), code(F.substring("qual", F.col("read_off") + F.col("j") + 1, F.lit(1))).alias("qual"))
    match = base_at(match, chunks, size=chunk).where("allele <> ref_base").drop("ref_base")
    piece = F.substring("seq", F.col("read_off") + 1, F.col("len"))
    quality = code(F.substring("qual", F.col("read_off") + 1, F.lit(1)))
    extra = ops.where(F.col("op").isin("I", "S")).select(key, "contig", F.col("at").alias("pos"), piece.alias("allele"), quality.alias("qual"))
    gone = ops.where("op = 'D'").select(key, "contig", (F.col("at") - 1).alias("pos"), F.repeat(F.lit("-"), F.col("len")).alias("allele"), code(F.substring("qual", F.greatest(F.col("read_off"), F.lit(1)), F.lit(1))).alias("qual"))
    rows = match.select(key, "contig", "pos", "allele", "qual").union(extra.select(key, "contig", "pos", "allele", "qual")).union(gone.select(key, "contig", "pos", "allele", "qual"))
    best = rows.groupBy("contig", "pos", key).agg(F.min(F.struct((-F.length("allele")).alias("n"), F.col("allele"), F.col("qual"))).alias("b"))
    return best.select("contig", "pos", key, "b.allele", "b.qual")


def allele_matrix(alignments: DataFrame, loci: DataFrame, chunks: DataFrame, key: str, locus: str, informative: bool = True, chunk: int = 10_000) -> DataFrame:
    """``locus, pos, key, allele, qual`` at the sites of each locus where any of its reads differs.

    Reads that cover a site without differing show the reference base, at the quality they have there. With
    ``informative``, only sites that pass informative_sites stay, and alleles are filled in by impute.
    """
    seen = variant_alleles(alignments, chunks, key, chunk)
    spots = seen.select("contig", "pos").distinct().select("contig", "pos", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"))
    inside = overlap_join(spots, loci, "pos", locus).select("contig", locus, "pos")
    bases = aligned_bases(alignments, key)
    cover = inside.join(bases.select("contig", "pos", key, F.left("bases", F.lit(1)).alias("base"), (F.ascii("quals") - 33).alias("q")), ["contig", "pos"])
    shown = cover.join(seen, ["contig", "pos", key], "full").join(inside.withColumnRenamed(locus, "_l"), ["contig", "pos"])
    cells = shown.select(F.coalesce(locus, "_l").alias(locus), "pos", key, F.coalesce("allele", "base").alias("allele"), F.coalesce("qual", "q").alias("qual")).distinct()
    if not informative:
        return cells
    keep = informative_sites(cells, locus)
    return impute(cells.join(keep, [locus, "pos"], "left_semi"), locus, key)


def site_matrix(alignments: DataFrame, loci: DataFrame, chunks: DataFrame, key: str, locus: str, chunk: int = 10_000) -> DataFrame:
    """The older matrix: every read at every position of a locus where any read differs, with no rule on sites."""
    return impute(allele_matrix(alignments, loci, chunks, key, locus, False, chunk), locus, key)


def informative_sites(cells: DataFrame, locus: str, pos: str = "pos", allele: str = "allele", gap: int = 20) -> DataFrame:
    """``locus, pos`` of sites with exactly two alleles, both one base, over ``gap`` from the candidate before.

    The candidate before may itself be rejected; the first is measured from 0.
    """
    sites = cells.groupBy(locus, pos).agg(F.count_distinct(allele).alias("n"), F.max(F.length(allele)).alias("len"))
    last = F.lag(pos, 1, 0).over(Window.partitionBy(locus).orderBy(pos))
    return sites.withColumn("_last", last).where((F.col("n") == 2) & (F.col("len") == 1) & (F.col(pos) - F.col("_last") > gap)).select(locus, pos)


def impute(cells: DataFrame, locus: str, key: str, pos: str = "pos", allele: str = "allele", qual: str = "qual") -> DataFrame:
    """Every read of a locus at every site: missing alleles are the site's commonest, at quality 0."""
    sites = allele_mode(cells, [locus, pos], allele).select(locus, pos, "mode")
    reads = cells.select(locus, key).distinct()
    grid = sites.join(reads, locus)
    full = grid.join(cells.select(locus, pos, key, allele, qual), [locus, pos, key], "left")
    return full.select(locus, pos, key, F.coalesce(allele, "mode").alias(allele), F.coalesce(F.col(qual), F.lit(0)).alias(qual))


def top_alleles(alleles: DataFrame, site: list[str], allele: str = "allele", n: int = 2) -> DataFrame:
    """``site, allele, c, code``: the ``n`` commonest alleles of each site (ties: the smaller), coded 0, 1, ..."""
    counts = alleles.groupBy(*site, allele).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*site).orderBy(F.desc("c"), allele)
    return counts.withColumn("code", F.row_number().over(w) - 1).where(F.col("code") < n)


def encode_alleles(alleles: DataFrame, site: list[str], allele: str = "allele") -> DataFrame:
    """``alleles`` of the two commonest kinds of each site, with ``code``."""
    return alleles.join(top_alleles(alleles, site, allele).drop("c"), [*site, allele])
