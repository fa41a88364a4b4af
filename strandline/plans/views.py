"""Sequence-like views over the driver tables, in Spark and, by the same rules, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encode(text: str):
    """Letters of a text as bases."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]+", "")), _LETTERS, _BASES)


def encoded(text: str):
    """encode, made once for each row however often the column is read later: what explode gives is not put into later expressions."""
    return F.explode(F.array(encode(text)))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, sample, lang, seq`` of all documents."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("source").alias("sample"), "lang", encoded("text").alias("seq"))


def bait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, seq`` of the benchmark."""
    return read(spark, sf_dir, "benchmark").select("item_id", encode("text").alias("seq"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``aln_id, contig, start, stop, mapq, hp, cigar, sample`` of lineitem."""
    start = (F.col("l_partkey") * 911 + F.col("l_linenumber") * 37) % 100000
    n = F.floor("l_quantity")
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n, F.round(F.col("l_discount") * 100).cast("int")).alias("aln_id"),
        (F.col("l_suppkey") % 5).alias("contig"),
        start.alias("start"),
        (start + 10 * n).alias("stop"),
        F.round(F.col("l_discount") * 100).cast("int").alias("mapq"),
        (1 + F.col("l_linenumber") % 2).cast("int").alias("hp"),
        F.concat(F.col("l_linenumber"), F.lit("S"), n.cast("int"), F.lit("M"), F.col("l_linenumber") % 3 + 1, F.lit("I5="), F.lit("2D7M")).alias("cigar"),
        F.col("l_suppkey").alias("sample"),
    )


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``locus, contig, start, stop`` of part."""
    start = (F.col("p_partkey") * 577) % 100000
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("locus"), (F.col("p_partkey") % 5).alias("contig"), start.alias("start"), (start + 20 * F.col("p_size")).alias("stop"))


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site, read, allele, w`` of events: the latest event of each read at each site."""
    site = (F.hour("ts") + 24 * (F.dayofmonth("ts") % 3)).cast("long")
    rows = read(spark, sf_dir, "events").select(site.alias("site"), F.col("user_id").alias("read"), F.struct("event_id", F.col("event_type").alias("allele"), F.floor("value").alias("v")).alias("e"))
    best = rows.groupBy("site", "read").agg(F.max("e").alias("e"))
    return best.select("site", "read", F.col("e.allele").alias("allele"), (F.col("e.v") % 40).alias("w"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label, score`` of labelled documents."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", F.col("quality").alias("label"), ((F.col("n_chars") % 100) / 100.0).alias("score"))


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hap, seq`` of all pages."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("hap"), encoded("html").alias("seq"))


def _enc(text: str) -> str:
    return f"translate(lower(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{_BASES}')"


#: The same views in SQL, as clauses of a WITH.
SQL = {
    "reads": f"reads AS (SELECT doc_id, source AS sample, lang, {_enc('text')} AS seq FROM documents WHERE text IS NOT NULL)",
    "bait": f"bait AS (SELECT item_id, {_enc('text')} AS seq FROM benchmark)",
    "aln": """aln AS (SELECT aln_id, contig, start, start + 10 * n AS stop, mapq, hp, cigar, sample FROM (
      SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT), CAST(round(l_discount * 100) AS INTEGER)) AS aln_id, l_suppkey % 5 AS contig, (l_partkey * 911 + l_linenumber * 37) % 100000 AS start,
        CAST(floor(l_quantity) AS BIGINT) AS n, CAST(round(l_discount * 100) AS INTEGER) AS mapq, CAST(1 + l_linenumber % 2 AS INTEGER) AS hp,
        concat(l_linenumber, 'S', CAST(floor(l_quantity) AS INTEGER), 'M', l_linenumber % 3 + 1, 'I5=2D7M') AS cigar, l_suppkey AS sample FROM lineitem))""",
    "loci": "loci AS (SELECT p_partkey AS locus, p_partkey % 5 AS contig, (p_partkey * 577) % 100000 AS start, (p_partkey * 577) % 100000 + 20 * p_size AS stop FROM part)",
    "alleles": """alleles AS (SELECT site, read, allele, v % 40 AS w FROM (
      SELECT CAST(hour(ts) + 24 * (day(ts) % 3) AS BIGINT) AS site, user_id AS read, event_type AS allele, CAST(floor(value) AS BIGINT) AS v,
        row_number() OVER (PARTITION BY hour(ts) + 24 * (day(ts) % 3), user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)""",
    "scored": "scored AS (SELECT d.doc_id, l.quality AS label, (n_chars % 100) / 100.0 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)",
    "haps": f"haps AS (SELECT page_id AS hap, {_enc('html')} AS seq FROM pages)",
}


def with_views(*names: str) -> str:
    """A WITH clause, open for more, of some views."""
    return "WITH " + ",\n".join(SQL[n] for n in names)


def rc(x: str) -> str:
    """SQL of the other strand."""
    return f"reverse(translate({x}, 'ACGTN', 'TGCAN'))"


def hp(x: str) -> str:
    """SQL of homopolymer compression."""
    for b in "ACGT":
        x = f"regexp_replace({x}, '{b}+', '{b}', 'g')"
    return x


def kmers(source: str, keys: str, k: int, seq: str = "seq", valid: bool = True) -> str:
    """SQL rows ``keys, pos, kmer`` of a view; ``valid`` applies the graph's rule on sequences."""
    rule = f"regexp_full_match({seq}, '[ACGT]+') AND length({seq}) >= {k + 1}" if valid else f"length({seq}) >= {k}"
    return f"SELECT {keys}, pos, substr({seq}, pos + 1, {k}) AS kmer, CASE WHEN pos > 0 THEN substr({seq}, pos, 1) ELSE '' END AS before, substr({seq}, pos + {k + 1}, 1) AS after FROM (SELECT {keys}, {seq}, unnest(range(0, length({seq}) - {k - 1})) AS pos FROM {source} WHERE {rule})"
