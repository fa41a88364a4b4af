"""Writers of sequence, graph, variant and report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators.typing import exact_pairs


def fasta(rows: DataFrame, path: str, name: Column | str = "id", seq: str = "seq", compression: str | None = None) -> None:
    """One record a row; empty sequences are left out."""
    text = rows.where(F.length(seq) > 0).select(F.concat(F.lit(">"), S.col(name), F.lit("\n"), F.col(seq)).alias("value"))
    text.write.mode("overwrite").text(path, compression=compression)


def fastq(rows: DataFrame, path: str, name: str = "id", seq: str = "seq", qual: str = "qual", compression: str | None = None) -> None:
    """Four lines a row; a missing quality is phred 30 throughout."""
    quality = F.coalesce(F.col(qual), F.repeat(F.lit("?"), F.length(seq)))
    text = rows.where(F.length(seq) > 0).select(F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), quality).alias("value"))
    text.write.mode("overwrite").text(path, compression=compression)


def paired_fastq(rows: DataFrame, path: str, compression: str | None = None) -> int:
    """Pairs (``qname, is_reverse, seq, qual``) side by side, reverse reads turned; returns the number of records dropped.

    Only names with exactly two records are written.
    """
    kept, dropped = exact_pairs(rows, "qname")
    turned = kept.select(
        "qname", F.when(F.col("is_reverse"), S.reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"), F.when(F.col("is_reverse"), F.reverse("qual")).otherwise(F.col("qual")).alias("qual")
    )
    ordered = turned.repartition("qname").sortWithinPartitions("qname")
    fastq(ordered, path, "qname", compression=compression)
    return int(dropped.first()[0] or 0)


def gfa(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes ``id, seq`` and edges ``src, dst, weight`` as a plain graph."""
    head = nodes.sparkSession.createDataFrame([("H\tVN:Z:1.0", 0)], "value string, ord int")
    s = nodes.select(F.concat_ws("\t", F.lit("S"), "id", "seq").alias("value"), F.lit(1).alias("ord"))
    link = edges.select(F.concat_ws("\t", F.lit("L"), "src", F.lit("+"), "dst", F.lit("+"), F.lit("0M"), F.concat(F.lit("RC:f:"), F.col("weight"))).alias("value"), F.lit(2).alias("ord"))
    head.union(s).union(link).repartitionByRange("ord", "value").sortWithinPartitions("ord", "value").select("value").write.mode("overwrite").text(path)


def annotated_gfa(anchors: DataFrame, edges: DataFrame, path: str) -> None:
    """Anchors and named edges as segments with JSON notes, and the links between them."""
    head = anchors.sparkSession.createDataFrame([("H\tVN:Z:1.0", 0)], "value string, ord int")
    a = anchors.select(F.concat_ws("\t", F.lit("S"), "name", "seq", F.concat(F.lit("PG:J:"), F.to_json(F.struct("pos")))).alias("value"), F.lit(1).alias("ord"))
    e = edges.select(F.concat_ws("\t", F.lit("S"), "name", "seq", F.concat(F.lit("PG:J:"), F.to_json(F.struct("src", "dst", "reads", "samples"))), F.concat(F.lit("RC:i:"), F.size("reads"))).alias("value"), F.lit(2).alias("ord"))
    link = lambda x, y: edges.select(F.concat_ws("\t", F.lit("L"), x, F.lit("+"), y, F.lit("+"), F.lit("0M")).alias("value"), F.lit(3).alias("ord"))
    head.union(a).union(e).union(link("src", "name")).union(link("name", "dst")).repartitionByRange("ord", "value").sortWithinPartitions("ord", "value").select("value").write.mode("overwrite").text(path)


def node_table(nodes: DataFrame, kmers: DataFrame, path: str) -> None:
    """``node, label, kmer, coverage, entropy`` of each node (``id, seq``) as CSV; the label is source and score."""
    rows = nodes.withColumn("cn_kmer", S.canonical("seq")).join(kmers, "cn_kmer", "left")
    label = F.concat(F.array_join("sources", ","), F.lit(" ("), F.round("score", 2), F.lit(")"))
    rows.select(F.col("id").alias("node"), label.alias("label"), F.col("cn_kmer").alias("kmer"), F.col("cov").alias("coverage"), S.shannon_entropy("seq").alias("entropy")).write.mode("overwrite").csv(path, header=True)


def matrix(cells: DataFrame, path: str, sites: list[int]) -> None:
    """Read by site with ``allele,weight`` cells and ``-,1`` for none, as TSV; ``sites`` are the columns."""
    cell = F.when(F.col("allele").isNotNull(), F.concat_ws(",", "allele", "weight"))
    wide = cells.withColumn("c", cell).groupBy("read").pivot("site", sites).agg(F.first("c", ignorenulls=True))
    wide.select("read", *[F.coalesce(F.col(f"`{s}`"), F.lit("-,1")).alias(str(s)) for s in sites]).orderBy("read").write.mode("overwrite").csv(path, sep="\t", header=True)


def by_haplotype(reads: DataFrame, path: str) -> None:
    """Reads as Parquet, one folder a haplotype."""
    reads.write.mode("overwrite").partitionBy("haplotype").parquet(path)


def vcf(variants: DataFrame, contigs: DataFrame, path: str, sample: str = "sample") -> None:
    """Variant rows as VCF text, in order, after a header with the contigs' lengths."""
    spark = variants.sparkSession
    fixed = ['##fileformat=VCFv4.2', '##INFO=<ID=END,Number=1,Type=Integer,Description="End position">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">']
    order = "value string, part int, contig string, pos long"
    head = spark.createDataFrame([(t, 0, str(i), i) for i, t in enumerate(fixed)], order)
    names = contigs.select(F.format_string("##contig=<ID=%s,length=%d>", "contig", "length").alias("value"), F.lit(1).alias("part"), "contig", F.lit(0).cast("long").alias("pos"))
    columns = spark.createDataFrame([("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample]), 2, "", 0)], order)
    body = variants.select(
        F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit("."), F.lit("PASS"), F.concat(F.lit("END="), F.col("pos") + F.length("ref")), F.lit("GT:GQ"), F.concat(F.array_join(F.transform("gt", lambda g: g.cast("string")), "|"), F.lit(":"), F.col("gq"))).alias("value"),
        F.lit(3).alias("part"), "contig", F.col("pos").cast("long"),
    )
    head.union(names).union(columns).union(body).repartitionByRange("part", "contig", "pos").sortWithinPartitions("part", "contig", "pos").select("value").write.mode("overwrite").text(path)


def report(rows: DataFrame, path: str) -> None:
    """A table as TSV with a header."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)
