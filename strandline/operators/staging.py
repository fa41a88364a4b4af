"""Staging: all reads and reference pieces of all files over all loci, as sequences to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators.intervals import chunk_reference, reference_bases
from strandline.operators.pileup import aligned_bases, assemble_pileup, by_haplotype
from strandline.sources.readers import unaligned


def stage(loci: DataFrame, alignments: DataFrame | None = None, references: DataFrame | None = None, haplotype: str | None = None, unmapped: bool = False, chunk: int = 10_000) -> DataFrame:
    """``id, seq, qual`` of every file at every locus (``contig, start, stop, name``), empty ones left out.

    ``alignments`` are those of all files (with ``sample``), ``references`` (``source, contig, seq``) the sequences of all FASTA
    files. A read's part in a locus is named by read, locus, sample and whether it is a secondary or a supplementary one; a
    reference's by place, locus and file. ``haplotype`` keeps reads with that tag; ``unmapped`` adds reads without a place.
    """
    parts = []
    if alignments is not None:
        rows = alignments if haplotype is None else by_haplotype(alignments, haplotype)
        # names may hold bars, but no tabs
        named = rows.where("contig is not null").withColumn("id", F.concat_ws("\t", "qname", "sample", F.col("is_secondary").cast("string"), F.col("is_supplementary").cast("string")))
        seen = assemble_pileup(aligned_bases(named, "id", True), loci, "id", "name")
        bits = F.split("id", "\t")
        parts.append(seen.select(F.concat_ws("|", bits[0], "name", F.slice(bits, F.lit(2), F.size(bits))).alias("id"), "seq", "qual"))
        if unmapped:
            parts.append(unaligned(rows))
    if references is not None:
        placed = references.select("source", F.concat_ws("|", "source", "contig").alias("_c"), "contig", "seq")
        chunks = chunk_reference(placed.select(F.col("_c").alias("contig"), "seq"), chunk)
        asked = loci.join(placed.select("contig", "_c", "source"), "contig")
        key = F.concat(F.concat_ws("|", F.format_string("%s:%d-%d", "contig", "start", "stop"), "name", "source"))
        cut = asked.select(key.alias("id"), F.col("_c").alias("contig"), "start", "stop")
        parts.append(reference_bases(chunks, cut, "id", chunk).withColumn("qual", F.repeat(F.lit("?"), F.length("seq"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.length("seq") > 0)
