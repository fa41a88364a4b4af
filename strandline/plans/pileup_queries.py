"""Queries on CIGARs, alleles and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import pileup as P
from strandline.plans import views as V


def q_cigar_offsets(spark, d):
    """Operations of each alignment with running offsets."""
    return P.cigar_offsets(V.alignments(spark, d).withColumn("pos", F.col("start")), "aln_id", keep=("pos",)).select("aln_id", "i", "op", "len", (F.col("pos") + F.col("ref_off")).alias("at"), "read_off")


def q_match_score(spark, d):
    """Matched less unmatched bases of each alignment."""
    return P.match_score(V.alignments(spark, d), "aln_id")


def q_allele_mode(spark, d):
    """Commonest allele of each site."""
    return P.allele_mode(V.alleles(spark, d), ["site"])


def q_best_allele(spark, d):
    """Longest allele over 8 letters, else the commonest, of each site."""
    return P.best_allele(V.alleles(spark, d), ["site"], long=8)


def q_top2_alleles(spark, d):
    """Two commonest alleles of each site."""
    return P.top_alleles(V.alleles(spark, d), ["site"]).select("site", "allele", "c", F.col("code").cast("int").alias("code"))


def q_encode(spark, d):
    """Reads' alleles as 0 and 1."""
    return P.encode_alleles(V.alleles(spark, d), ["site"]).select("site", "read", F.col("code").cast("int").alias("code"), "w")


def q_impute(spark, d):
    """Every read at every site, gaps filled with the site's commonest allele at quality 0."""
    rows = V.alleles(spark, d).withColumn("locus", F.lit(1))
    return P.impute(rows, "locus", "read", "site", "allele", "w").select("site", "read", "allele", "w")


def q_site_filter(spark, d):
    """Sites (every document's alignment start) whose reads show two single-base alleles, over 20 from the one before."""
    rows = V.alignments(spark, d).select("contig", F.col("start").alias("pos"), F.substring("cigar", 1, 1).alias("allele"))
    return P.informative_sites(rows, "contig")


def q_pileup_consensus(spark, d):
    """Commonest base in each column of each source's documents, joined."""
    return P.text_consensus(V.reads(spark, d), ["sample"]).select("sample", F.length("seq").alias("n"), F.md5("seq").alias("seq_md5"))


def q_haplotype_reads(spark, d):
    """Alignments and bases of each haplotype tag and sample."""
    tags = V.alignments(spark, d).withColumn("tags", F.create_map(F.lit("HP"), F.col("hp").cast("string"), F.lit("RG"), F.col("sample").cast("string")))
    names = V.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("rg"), F.col("s_name").alias("sample"))
    one = P.with_sample(P.by_haplotype(tags, "1").drop("sample"), names)
    return one.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"))


_A = V.with_views("alleles")
_OPS = """o AS (SELECT aln_id, start, unnest(range(0, len(x))) AS i, x FROM (SELECT aln_id, start, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS x FROM aln)),
  p AS (SELECT aln_id, start, CAST(i AS INTEGER) AS i, right(x[i + 1], 1) AS op, CAST(regexp_extract(x[i + 1], '[0-9]+') AS INTEGER) AS len FROM o)"""
_MODE = "c AS (SELECT site, allele, count(*) AS c FROM alleles GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY c DESC, allele) AS rn FROM c)"
ORACLES = {
    "q_cigar_offsets": f"""{V.with_views('aln')}, {_OPS} SELECT aln_id, i, op, len, CAST(start + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS BIGINT) AS at,
      CAST(coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS INTEGER) AS read_off FROM p WINDOW w AS (PARTITION BY aln_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "q_match_score": f"{V.with_views('aln')}, {_OPS} SELECT aln_id, CAST(sum(CASE WHEN op = '=' THEN len WHEN op IN ('X', 'I', 'D') THEN -len ELSE 0 END) AS INTEGER) AS score FROM p GROUP BY aln_id",
    "q_allele_mode": f"{_A}, {_MODE} SELECT site, max(allele) FILTER (rn = 1) AS mode, max(c) AS n, count(*) AS n_alleles FROM r GROUP BY site",
    "q_best_allele": f"{_A}, {_MODE}, l AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY length(allele) DESC, allele) AS rl FROM r) SELECT site, CASE WHEN max(length(allele)) > 8 THEN max(allele) FILTER (rl = 1) ELSE max(allele) FILTER (rn = 1) END AS best FROM l GROUP BY site",
    "q_top2_alleles": f"{_A}, {_MODE} SELECT site, allele, c, CAST(rn - 1 AS INTEGER) AS code FROM r WHERE rn <= 2",
    "q_encode": f"{_A}, {_MODE} SELECT a.site, read, CAST(rn - 1 AS INTEGER) AS code, w FROM alleles a JOIN r ON a.site = r.site AND a.allele = r.allele AND rn <= 2",
    "q_impute": f"{_A}, {_MODE} SELECT s.site, u.read, coalesce(a.allele, s.allele) AS allele, coalesce(a.w, 0) AS w FROM (SELECT site, allele FROM r WHERE rn = 1) s CROSS JOIN (SELECT DISTINCT read FROM alleles) u LEFT JOIN alleles a ON a.site = s.site AND a.read = u.read",
    "q_site_filter": f"""{V.with_views('aln')}, s AS (SELECT contig, start AS pos, count(DISTINCT substr(cigar, 1, 1)) AS n FROM aln GROUP BY ALL), l AS (SELECT *, lag(pos, 1, 0) OVER (PARTITION BY contig ORDER BY pos) AS last FROM s) SELECT contig, pos FROM l WHERE n = 2 AND pos - last > 20""",
    "q_pileup_consensus": f"""{V.with_views('reads')}, b AS (SELECT sample, pos, substr(seq, pos + 1, 1) AS base FROM (SELECT sample, seq, unnest(range(0, length(seq))) AS pos FROM reads)), c AS (SELECT sample, pos, base, count(*) AS n FROM b GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY sample, pos ORDER BY n DESC, base) AS rn FROM c) SELECT sample, CAST(count(*) AS INTEGER) AS n, md5(string_agg(base, '' ORDER BY pos)) AS seq_md5 FROM r WHERE rn = 1 AND base <> '' GROUP BY sample""",
    "q_haplotype_reads": f"{V.with_views('aln')} SELECT coalesce(s_name, 'unknown') AS sample, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS bases FROM aln LEFT JOIN supplier ON s_suppkey = aln.sample WHERE hp = 1 GROUP BY ALL",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
