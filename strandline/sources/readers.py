"""Readers of sequence, alignment, variant and graph text. All read through Spark, so any of its file systems will do."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators.lineage import numbered
from strandline.operators.pileup import reference_length


def expand_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Distinct paths in order; a ``.txt`` is a list of paths, one a line."""
    out: dict[str, None] = {}
    for p in paths:
        lines = [r.value.strip() for r in spark.read.text(p).toLocalIterator()] if p.endswith(".txt") else [p]
        out.update((x, None) for x in lines if x)
    return list(out)


def loci(spark: SparkSession, items: Sequence[str], padding: int = 0) -> DataFrame:
    """``contig, start, stop, name, ord`` of locus texts and BED-like files, distinct, in order of first mention."""
    rows = None
    for i, item in enumerate(items):
        if item.rsplit(".", 1)[-1] in ("bed", "tsv", "txt"):
            lines = spark.read.text(item).where("value not like '#%' and trim(value) <> ''").select(F.regexp_replace("value", r"\s+", " ").alias("text"), F.monotonically_increasing_id().alias("n"))
        else:
            lines = spark.createDataFrame([(item, 0)], "text string, n long")
        part = lines.select(S.parse_locus("text", padding).alias("l"), F.struct(F.lit(i).alias("i"), "n").alias("ord")).select("l.*", "ord")
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("contig", "start", "stop", "name").agg(F.min("ord").alias("ord")).orderBy("ord")


def fasta(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``id, description, seq`` of FASTA files (compressed ones by their ending).

    A record starts where a line begins with ``>``; other such signs are text. Files are split between records.
    """
    # the separator takes the sign of every record but a file's first one
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths), lineSep="\n>").where("trim(value) <> ''").select(F.regexp_replace("value", r"^\s*>", "").alias("value"))
    head = F.regexp_extract("value", r"^([^\n\r]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n\r]*", ""), r"\s", "")
    return raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), F.upper(body).alias("seq"))


def _fastq_parts(batches: Iterator[pd.DataFrame], rest: bool) -> Iterator[pd.DataFrame]:
    """Whole records of each block of a file, or (``rest``) the lines before its first and after its last one.

    A block may begin in the middle of a record. Its first record is where a line starts with @, the second next with
    +, and the lines between and after are of one length; no other line can pass for it, as bases are letters.
    """
    place, lines, lead = None, [], None

    def starts(at: int) -> bool:
        return lines[at].startswith("@") and lines[at + 2].startswith("+") and len(lines[at + 1]) == len(lines[at + 3])

    def find() -> int | None:
        return next((p for p in range(min(4, len(lines) - 3)) if starts(p)), None)

    def take(end: bool) -> tuple[list, list]:
        """(records, rest lines) that can be told now; they are taken off the lines."""
        nonlocal lead, lines
        records, left = [], []
        if lead is None and (len(lines) >= 7 or end):
            lead = find()
            if lead is None:
                left, lines, lead = [(place, 0, lines)], [], 0
            elif lead:
                left, lines = [(place, 0, lines[:lead])], lines[lead:]
        if lead is not None:
            whole = len(lines) // 4 * 4
            records = [tuple(lines[i : i + 4]) for i in range(0, whole, 4)]
            lines = lines[whole:]
            if end and lines:
                left, lines = [*left, (place, 1, lines)], []
        return records, left

    def frame(records: list, left: list) -> pd.DataFrame:
        if rest:
            return pd.DataFrame([(*p, part, x) for p, part, x in left], columns=["path", "block", "part", "lines"])
        return pd.DataFrame([(h, s, q) for h, s, _, q in records], columns=["head", "seq", "qual"])

    for batch in batches:
        for here, group in batch.groupby(["path", "block"], sort=False):
            if here != place:
                if place is not None:
                    yield frame(*take(True))
                place, lines, lead = here, [], None
            lines += group["value"].tolist()
            yield frame(*take(False))
    if place is not None:
        yield frame(*take(True))


def fastq(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``id, description, seq, qual`` of FASTQ files with four lines a record.

    Files are read in blocks, as any text is: each task finds the records that lie whole in its blocks, and the lines at the
    blocks' ends, a few each, are put together by file.
    """
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths))
    text = raw.select(F.rtrim("value").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    whole = text.mapInPandas(lambda b: _fastq_parts(b, False), "head string, seq string, qual string")
    ends = text.mapInPandas(lambda b: _fastq_parts(b, True), "path string, block long, part int, lines array<string>")
    joined = ends.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "lines"))), lambda x: x["lines"])).alias("l"))
    at = lambda n: F.element_at("l", F.col("i") * 4 + n)
    split = joined.where("size(l) >= 4").select("l", F.explode(F.sequence(F.lit(0), F.floor(F.size("l") / 4).cast("int") - 1)).alias("i")).select(at(1).alias("head"), at(2).alias("seq"), at(4).alias("qual"))
    rows = whole.union(split)
    return rows.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("id"), F.trim(F.regexp_replace("head", r"^@\S*", "")).alias("description"), "seq", "qual")


def sequences(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """FASTA or FASTQ, by the ending, or where that says nothing by the first character; FASTA rows have no ``qual``."""
    kinds: dict[bool, list[str]] = {True: [], False: []}
    for p in paths:
        name = re.sub(r"\.(gz|bz2|zst)$", "", p)
        if re.search(r"\.(fq|fastq)$", name):
            kinds[True].append(p)
        elif re.search(r"\.(fa|fasta|fna)$", name):
            kinds[False].append(p)
        else:
            first = spark.read.text(p).where("value <> ''").head(1)
            kinds[bool(first) and first[0].value.startswith("@")].append(p)
    parts = [fastq(spark, kinds[True])] if kinds[True] else []
    parts += [fasta(spark, kinds[False]).withColumn("qual", F.lit(None).cast("string"))] if kinds[False] else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def sam(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Alignments of SAM text: named fields, 0-based ``pos``, flag columns and ``tags``."""
    return _alignments(spark.read.text(paths if isinstance(paths, str) else list(paths)))


def _alignments(lines: DataFrame, *kept: str) -> DataFrame:
    """Alignments of the lines (``value``) of SAM text, with the columns ``kept``.

    Fields are null where there is none or no number: Spark may work out those of a filter before it drops the headers.
    """
    f = F.split("value", "\t")
    rows = lines.where("value not like '@%' and value <> ''").select(f.alias("f"), *kept)
    tag = F.transform(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v")))
    flag = F.get("f", F.lit(1)).try_cast("int")
    has = lambda bit: flag.bitwiseAND(F.lit(bit)) != 0
    star = lambda i: F.when(F.get("f", F.lit(i)) != "*", F.get("f", F.lit(i)))
    return rows.select(
        F.get("f", F.lit(0)).alias("qname"), flag.alias("flag"), star(2).alias("contig"), (F.get("f", F.lit(3)).try_cast("long") - 1).alias("pos"), F.get("f", F.lit(4)).try_cast("int").alias("mapq"), star(5).alias("cigar"),
        star(9).alias("seq"), star(10).alias("qual"), has(16).alias("is_reverse"), has(256).alias("is_secondary"), has(2048).alias("is_supplementary"), F.map_from_entries(tag).alias("tags"), *kept,
    )


def alignment_index(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``path, block, length, contig, first, stop, reads``: what each block of SAM text holds of each contig.

    Blocks are those that Spark reads the files in (``spark.sql.files.maxPartitionBytes``); ``first`` is the least ``pos`` of
    their alignments there and ``stop`` the greatest end. One pass; write the table beside the files, and regions of them
    need no other. Files need not be sorted, but only of sorted ones a region has few blocks.
    """
    text = spark.read.text(paths if isinstance(paths, str) else list(paths))
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("length")
    rows = _alignments(text.select("value", *place), "path", "block", "length")
    end = F.col("pos") + reference_length("cigar")
    return rows.groupBy("path", "block", "length", "contig").agg(F.min("pos").alias("first"), F.max(end).alias("stop"), F.count(F.lit(1)).alias("reads"))


def _block_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines that start after the first byte of a block (of a file's first one: with it) and not beyond the byte after its last."""
    for batch in batches:
        for path, block, length in batch[["path", "block", "length"]].itertuples(index=False):
            files, place = pyarrow.fs.FileSystem.from_uri(path)
            packed = re.search(r"\.(gz|bz2|zst|lz4)$", place) is not None
            with files.open_input_stream(place) if packed else files.open_input_file(place) as raw:
                if block:
                    raw.seek(block)
                lines, at, found = io.BufferedReader(raw, 1 << 20), block, []
                if block:
                    at += len(lines.readline())
                while packed or at <= block + length:
                    line = lines.readline()
                    if not line:
                        break
                    at += len(line)
                    found.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                    if len(found) == 10_000:
                        yield pd.DataFrame({"value": found})
                        found = []
                yield pd.DataFrame({"value": found}, dtype="object")


def indexed_region(index: DataFrame, contig: str | None = None, start: int | None = None, stop: int | None = None, unmapped: bool = False) -> DataFrame:
    """What ``region`` gives of the alignments that ``index`` (``alignment_index``) describes, from the blocks that can hold it.

    The index says which blocks have an alignment of the contig that may overlap; only these are opened, at their
    place, one task a block. Compressed files are one block each. Files must be as they were indexed.
    """
    held = index if contig is None and not unmapped else index.where(F.col("contig").isNull() if unmapped else F.col("contig") == contig)
    if stop is not None and not unmapped:
        held = held.where(F.col("first") < stop)
    if start is not None and not unmapped:
        held = held.where(F.col("stop") > start)
    blocks = held.select("path", "block", "length").distinct()
    lines = blocks.repartition(max(1, blocks.count())).mapInPandas(_block_lines, "value string")
    return region(_alignments(lines), contig, start, stop, unmapped)


def region(alignments: DataFrame, contig: str | None = None, start: int | None = None, stop: int | None = None, unmapped: bool = False) -> DataFrame:
    """Alignments that overlap a region, those of a contig, all, or those without a place.

    A missing ``start`` or ``stop`` leaves that side open. Where the table has no ``stop``, it follows from the CIGAR.
    """
    if unmapped:
        return alignments.where("contig is null")
    out = alignments if contig is None else alignments.where(F.col("contig") == contig)
    if stop is not None:
        out = out.where(F.col("pos") < stop)
    if start is not None:
        end = F.col("stop") if "stop" in alignments.columns else F.col("pos") + reference_length("cigar")
        out = out.where(end > start)
    return out


def unaligned(alignments: DataFrame) -> DataFrame:
    """``id, seq, qual`` of reads without a place (``sample`` from their read group), named by read and sample."""
    return region(alignments, unmapped=True).select(S.read_name("qname", "sample").alias("id"), "seq", "qual")


def vcf(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``contig, pos, id, ref, alts, qual, filter, info, format, samples, path`` of VCF text; ``pos`` 0-based."""
    f = F.split("value", "\t")
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths)).withColumn("path", F.input_file_name()).where("value not like '#%' and value <> ''").select(f.alias("f"), "path")
    return rows.select(
        F.get("f", F.lit(0)).alias("contig"), (F.get("f", F.lit(1)).try_cast("long") - 1).alias("pos"), F.get("f", F.lit(2)).alias("id"), F.get("f", F.lit(3)).alias("ref"), F.split(F.get("f", F.lit(4)), ",").alias("alts"), F.get("f", F.lit(5)).alias("qual"),
        F.get("f", F.lit(6)).alias("filter"), F.get("f", F.lit(7)).alias("info"), F.get("f", F.lit(8)).alias("format"), F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0))).alias("samples"), "path",
    )


def gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes ``id, seq``, edges ``src, dst, weight``) of a GFA file; short links are skipped, the default weight is 1."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    nodes = rows.where("f[0] = 'S'").select(F.get("f", F.lit(1)).alias("id"), F.get("f", F.lit(2)).alias("seq"))
    links = rows.where("f[0] = 'L' and size(f) >= 6").select(F.get("f", F.lit(1)).alias("src"), F.get("f", F.lit(3)).alias("dst"), F.coalesce(F.regexp_extract(F.array_join("f", " "), r"RC:[if]:([0-9.]+)", 1).try_cast("double"), F.lit(1.0)).alias("weight"))
    known = nodes.select("id")
    return nodes, links.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")


_NOTE = "struct<src:string,dst:string,pos:bigint,reads:array<string>,samples:array<string>>"


def annotated_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(anchors ``name, seq, pos``, edges ``name, seq, src, dst, reads, samples``) of a GFA with JSON notes (``PG:J:``)."""
    rows = spark.read.text(path).where("value like 'S\\t%'").select(F.split("value", "\t").alias("f"), F.from_json(F.regexp_extract("value", r"PG:J:(\{.*\})", 1), _NOTE).alias("n"))
    named = rows.select(F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).alias("seq"), "n.*")
    return named.where("name like 'A%'").select("name", "seq", "pos"), named.where("name like 'E%'").select("name", "seq", "src", "dst", "reads", "samples")


def tsv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A table of tab-separated text."""
    return spark.read.csv(path, sep="\t", header=header)


def keep_order(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``ord``, their number in order of a column, from 0."""
    return numbered(rows, [order], "ord")


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of two sources side by side, the first of each with the first and so on, as ``ord`` and columns with ``from_`` and ``to_`` before their names.

    As many as the shorter one has. Places come from range partitions, so neither source passes through one task.
    """
    a, b = keep_order(left, left_order), keep_order(right, right_order)
    named = lambda rows, source, mark: rows.select("ord", *[F.col(c).alias(f"{mark}_{c}") for c in source.columns if c != "ord"])
    return named(a, left, "from").join(named(b, right, "to"), "ord")


def concatenated(parts: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All rows of several tables, by column name (null where a table lacks one), with ``source``, the table's name."""
    out = None
    for name, rows in parts.items():
        part = rows.withColumn(source, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to concatenate")
    return out


def read_groups(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``rg, sample`` of the read groups in the headers of SAM text."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).where("value like '@RG%'")
    field = lambda name: F.regexp_extract("value", rf"\t{name}:([^\t]*)", 1)
    return lines.select(field("ID").alias("rg"), field("SM").alias("sample")).where("rg <> '' and sample <> ''").distinct()
