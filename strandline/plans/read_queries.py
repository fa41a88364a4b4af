"""Queries on k-mer steps, names, qualities, trimmed and piled-up reads, and path pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import anchors as A
from strandline.operators import haplotypes as H
from strandline.operators import kmers as K
from strandline.operators import pileup as P
from strandline.operators.lineage import shared_folder
from strandline.plans import views as V
from strandline.plans.haplotype_queries import _ANCHORS, K_ANCHOR, _anchor_parts
from strandline.sources import readers as R

K_STEP = 11


def q_kmer_steps(spark, d):
    """The k-mers before and after each document k-mer, and whether a walk branches ahead on either strand."""
    t = K.count_kmers(V.reads(spark, d), K_STEP)
    k, e = F.col("cn_kmer"), F.col("edges")
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return t.select(
        "cn_kmer", text(S.next_kmers(k, e)).alias("next"), text(S.previous_kmers(k, e)).alias("previous"),
        text(S.next_kmers(S.reverse_complement(k), e)).alias("next_rc"), S.junction_ahead(k, e).alias("ahead"), S.junction_ahead(S.reverse_complement(k), e).alias("behind"),
    )


def q_union_kmers(spark, d):
    """Distinct k-mers of documents and of the benchmark together."""
    return K.union_set([K.count_kmers(V.reads(spark, d), K_STEP), K.count_kmers(V.bait(spark, d), K_STEP)])


def q_link_text(spark, d):
    """Bases around each document's middle as link texts of both strands."""
    r = V.reads(spark, d).select("doc_id", F.substring("seq", F.floor(F.length("seq") / 2).cast("int") + 1, F.lit(8)).alias("j"))
    return r.select("doc_id", S.link_text(F.col("doc_id") % 2 == 0, "j").alias("link"), S.link_text(F.col("doc_id") % 2 == 1, S.link_complement("j")).alias("other"))


def q_qualities(spark, d):
    """Quality text of each read over its sites."""
    rows = V.alleles(spark, d).groupBy("read").agg(F.array_sort(F.collect_list(F.struct("site", F.col("w").cast("int").alias("w")))).alias("a"))
    return rows.select("read", S.phred_text(F.transform("a", lambda x: x["w"])).alias("qual"))


def q_score_qualities(spark, d):
    """Qualities of document scores, as of a path and as of one to four k-mers."""
    rows = V.scored(spark, d).withColumn("n", F.col("doc_id") % 4 + 1)
    p = F.greatest(F.col("score"), F.lit(0.005))
    return rows.select("doc_id", S.path_quality("score").alias("path"), S.score_quality(F.ln(p) * F.col("n"), F.col("n")).alias("qual"))


def q_read_names(spark, d):
    """Names of pages: joined fields, sample, base name of the url, and with a prefix."""
    p = V.read(spark, d, "pages")
    name = S.read_name(F.col("page_id").cast("string"), F.length("html").cast("string"), F.concat(F.lit("s"), F.col("page_id") % 7))
    return p.select("page_id", name.alias("name"), S.sample_of(name).alias("sample"), S.base_name(F.concat(F.coalesce("url", F.lit("")), F.lit("/r"), "page_id", F.lit(".fa.gz")), (".gz", ".fa", ".fasta")).alias("base"), S.renamed(name, F.lit("p")).alias("renamed"))


def q_bed(spark, d):
    """Padded loci of parts as lines of BED."""
    l = V.loci(spark, d)  # noqa: E741
    text = F.concat(F.lit("c"), "contig", F.lit(":"), "start", F.lit("-"), "stop", F.lit("|part "), "locus")
    return l.select("locus", S.bed_line(S.parse_locus(text, 50)).alias("line"))


def q_edit_distance(spark, d):
    """Edit distance of each document's first and last 60 bases, and its gapped middle without gaps."""
    r = V.reads(spark, d)
    a, b = F.substring("seq", 1, 60), F.right("seq", F.lit(60))
    gapped = F.translate(F.substring("seq", F.lit(1), F.length("seq")), "G", "-")
    return r.select("doc_id", S.edit_distance(a, b).cast("long").alias("distance"), F.md5(S.ungapped(gapped)).alias("ungapped"))


def q_apply_cs(spark, d):
    """Documents with a substitution, an insertion and a deletion written as a difference string."""
    r = V.reads(spark, d).where(F.length("seq") >= 70)
    edits = F.concat(F.lit(":"), F.col("doc_id") % 50, F.lit("*ag+ct-acg:7"))
    return r.select("doc_id", S.apply_cs("seq", edits).alias("seq"))


def _placed(spark, d):
    """Alignments with bases and qualities: as many letters as the CIGAR reads, from a repeated pattern; equal ones once."""
    clip, m = F.element_at(F.split("aln_id", "-"), 2).cast("int"), ((F.col("stop") - F.col("start")) / 10).cast("int")
    n = clip + m + clip % 3 + 13
    return V.alignments(spark, d).distinct().select(
        "aln_id", "contig", "start", "cigar", F.left(F.repeat(F.when(clip % 2 == 0, "ACGTTGCAAC").otherwise("GATTACAGGC"), 12), n).alias("seq"),
        F.left(F.repeat(F.lit("!#+5?I"), 20), n).alias("qual"), (F.col("hp") == 2).alias("is_reverse"), (F.col("mapq") == 0).alias("is_secondary"), (clip == 7).alias("is_supplementary"),
    )


def q_trimmed_reads(spark, d):
    """Primary alignments' reads without soft clips, in their own orientation."""
    return P.primary(_placed(spark, d)).select("aln_id", S.col("start").alias("start"), P.trim_clips("seq", "cigar", "is_reverse").alias("seq"))


def q_pileup(spark, d):
    """Bases and qualities of each alignment inside each part's locus."""
    rows = _placed(spark, d).withColumn("pos", F.col("start"))
    out = P.read_pileup(rows, V.loci(spark, d), "aln_id", "locus", shown=F.md5)
    return out.select("locus", "aln_id", F.col("seq").alias("seq_md5"), F.col("qual").alias("qual_md5"))


def q_large_variants(spark, d):
    """Operations of alignments that tell haplotypes apart: mismatches, and insertions and deletions over two bases."""
    return H.large_variants(P.cigar_offsets(V.alignments(spark, d), "aln_id"), 2).select("aln_id", "i", "op", "len")


def q_msa_sites(spark, d):
    """Alleles of parts at the runs of variable columns of their types, within a brand and size."""
    p = V.read(spark, d, "part").select(F.concat_ws("|", "p_brand", "p_size").alias("grp"), "p_partkey", F.rpad("p_type", 24, "-").alias("seq"))
    return H.msa_sites(p, "grp", "p_partkey").select("grp", F.col("site").cast("long").alias("site"), "p_partkey", "allele")


def q_haplotype_sequence(spark, d):
    """Documents with two bases for every tenth and two bases deleted after every twentieth, over the whole sequence."""
    r = V.reads(spark, d).where(F.length("seq") > 0).select(F.col("doc_id").alias("key"), F.lit(100).alias("start"), "seq")
    at = F.explode(F.sequence(F.lit(100), F.length("seq") + 99, F.lit(10)))
    a = r.select("key", at.alias("pos")).withColumn("allele", F.when(F.col("pos") % 20 == 0, "--").otherwise("GG"))
    return H.haplotype_sequence(r, a, "key").select("key", F.md5("seq").alias("seq_md5"))


def q_edge_reads(spark, d):
    """Documents on anchor edges that at least two of them take."""
    reads, found, named = _anchor_parts(spark, d)
    e = A.supported(A.merge_edges(A.anchor_edges(found, named, reads, K_ANCHOR, "doc_id"), "doc_id"), 2)
    return A.edge_reads(e).select(F.col("read").alias("doc_id"))


def q_furthest_next(spark, d):
    """The farthest successor of each anchor over all documents' steps."""
    reads, found, named = _anchor_parts(spark, d)
    e = A.merge_edges(A.anchor_edges(found, named, reads, K_ANCHOR, "doc_id"), "doc_id")
    return A.furthest_next(e, named).select("src", "dst", F.col("step").cast("long").alias("step"))


def q_path_sequence(spark, d):
    """Names of the parts of each order joined along its lines."""
    lines = V.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("path"))
    pieces = V.read(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("seq"))
    return A.path_sequence(lines, pieces, "l_orderkey")


_COMP = "translate({0}, 'ACGT', 'TGCA')"
_RC = V.rc("kmer")
_PLACED = """y AS (SELECT DISTINCT *, CAST(split_part(aln_id, '-', 2) AS BIGINT) AS clip FROM aln), y2 AS (SELECT *, (stop - start) // 10 + clip + clip % 3 + 13 AS n FROM y),
  x AS (SELECT aln_id, contig, start, cigar, left(repeat(CASE WHEN clip % 2 = 0 THEN 'ACGTTGCAAC' ELSE 'GATTACAGGC' END, 12), n) AS seq, left(repeat('!#+5?I', 20), n) AS qual, hp = 2 AS is_reverse, mapq = 0 OR clip = 7 AS other, clip, n FROM y2)"""
_EDGES = f"""{_ANCHORS}, p AS (SELECT doc_id, name, found.pos FROM found JOIN anchors a ON found.kmer = a.kmer), s AS (
      SELECT doc_id, coalesce(lag(name) OVER w, 'SOURCE') AS src, name AS dst, coalesce(lag(pos) OVER w, 0) AS a, pos AS b FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos, name)
      UNION ALL SELECT doc_id, name, 'SINK', pos, NULL FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC, name DESC) AS rn FROM p) WHERE rn = 1),
      e AS (SELECT s.doc_id, src, dst, substr(seq, CAST(a AS BIGINT) + 1, CAST(coalesce(b, length(seq)) - a AS BIGINT)) AS seq FROM s JOIN reads r ON s.doc_id = r.doc_id)"""
_SCORES = "CASE WHEN q IS NULL THEN NULL ELSE chr(CAST(least(greatest(q, 33), 73) AS INTEGER)) END"
ORACLES = {
    "q_region_scan": """WITH a AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT), CAST(round(l_discount * 100) AS INTEGER)) AS aln_id, CAST((l_partkey * 911 + l_linenumber * 37) % 100000 AS BIGINT) AS pos, CAST(floor(l_quantity) AS BIGINT) AS n, l_linenumber AS m FROM lineitem WHERE l_suppkey % 5 = 3)
      SELECT aln_id, pos, m || 'S' || n || 'M' || (m % 3 + 1) || 'I5=2D7M' AS cigar FROM a WHERE pos < 21000 AND pos + n + 14 > 20000""",
    "q_kmer_steps": f"""{V.with_views('reads')}, o AS (SELECT least(kmer, {_RC}) AS cn, CASE WHEN kmer < {_RC} THEN after ELSE {_COMP.format('before')} END AS nxt, CASE WHEN kmer < {_RC} THEN before ELSE {_COMP.format('after')} END AS prv FROM ({V.kmers('reads', 'doc_id', K_STEP)})),
      n AS (SELECT cn, string_agg(substr(cn, 2) || nxt, ',' ORDER BY nxt) AS next, count(*) > 1 AS ahead FROM (SELECT DISTINCT cn, nxt FROM o WHERE nxt <> '') GROUP BY cn),
      p AS (SELECT cn, string_agg(prv || substr(cn, 1, {K_STEP - 1}), ',' ORDER BY prv) AS previous, string_agg({V.rc(f'(prv || substr(cn, 1, {K_STEP - 1}))')}, ',' ORDER BY {_COMP.format('prv')}) AS next_rc, count(*) > 1 AS behind FROM (SELECT DISTINCT cn, prv FROM o WHERE prv <> '') GROUP BY cn)
      SELECT k.cn AS cn_kmer, coalesce(next, '') AS next, coalesce(previous, '') AS previous, coalesce(next_rc, '') AS next_rc, coalesce(ahead, FALSE) AS ahead, coalesce(behind, FALSE) AS behind FROM (SELECT DISTINCT cn FROM o) k LEFT JOIN n ON n.cn = k.cn LEFT JOIN p ON p.cn = k.cn""",
    "q_union_kmers": f"{V.with_views('reads', 'bait')} SELECT least(kmer, {_RC}) AS cn_kmer FROM ({V.kmers('reads', 'doc_id', K_STEP)}) UNION SELECT least(kmer, {_RC}) FROM ({V.kmers('bait', 'item_id', K_STEP)})",
    "q_link_text": f"""{V.with_views('reads')}, j AS (SELECT doc_id, substr(seq, length(seq) // 2 + 1, 8) AS j FROM reads) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'F ' ELSE 'R ' END || j AS link, CASE WHEN doc_id % 2 = 1 THEN 'F ' ELSE 'R ' END || {_COMP.format('j')} AS other FROM j""",
    "q_qualities": f"{V.with_views('alleles')} SELECT read, string_agg(chr(CAST(33 + w AS INTEGER)), '' ORDER BY site) AS qual FROM alleles GROUP BY read",
    "q_score_qualities": f"""{V.with_views('scored')}, s AS (SELECT doc_id, score, doc_id % 4 + 1 AS n, greatest(score, 0.005) AS p FROM scored), q AS (SELECT *, floor(-10 * log10(1 - greatest(exp(ln(p) * n / (n + 1)) - 1e-4, 0.0))) + 33 AS q FROM s)
      SELECT doc_id, CASE WHEN score >= 1 THEN 60 ELSE least(60, CAST(trunc(-10 * log10(1 - score)) AS INTEGER)) END AS path, {_SCORES} AS qual FROM q""",
    "q_read_names": """SELECT page_id, concat_ws('|', page_id, length(html), 's' || page_id % 7) AS name, 's' || page_id % 7 AS sample, 'r' || page_id AS base, concat_ws('|', 'p', page_id, length(html), 's' || page_id % 7) AS renamed FROM pages""",
    "q_bed": f"{V.with_views('loci')} SELECT locus, concat_ws(chr(9), 'c' || contig, greatest(start - 50, 0), stop + 50, 'part ' || locus) AS line FROM loci",
    "q_edit_distance": f"{V.with_views('reads')} SELECT doc_id, levenshtein(substr(seq, 1, 60), right(seq, 60)) AS distance, md5(replace(seq, 'G', '')) AS ungapped FROM reads",
    "q_apply_cs": f"{V.with_views('reads')} SELECT doc_id, substr(seq, 1, doc_id % 50) || 'G' || 'CT' || substr(seq, doc_id % 50 + 5, 7) AS seq FROM reads WHERE length(seq) >= 70",
    "q_trimmed_reads": f"""{V.with_views('aln')}, {_PLACED}, t AS (SELECT *, substr(seq, clip + 1) AS body FROM x WHERE NOT other) SELECT aln_id, start, CASE WHEN is_reverse THEN {V.rc('body')} ELSE body END AS seq FROM t""",
    "q_pileup": f"""{V.with_views('aln', 'loci')}, {_PLACED},
      c AS (SELECT aln_id, contig, start, seq, qual, clip, n - clip - 13 - clip % 3 AS m, clip % 3 + 1 AS ins FROM x),
      b AS (SELECT aln_id, contig, start + j AS pos, clip + j AS off, CASE WHEN j = m - 1 THEN ins + 1 ELSE 1 END AS w, seq, qual FROM (SELECT *, unnest(range(0, m)) AS j FROM c)
        UNION ALL SELECT aln_id, contig, start + m + j, clip + m + ins + j, 1, seq, qual FROM (SELECT *, unnest(range(0, 5)) AS j FROM c)
        UNION ALL SELECT aln_id, contig, start + m + 7 + j, clip + m + ins + 5 + j, 1, seq, qual FROM (SELECT *, unnest(range(0, 7)) AS j FROM c))
      SELECT locus, aln_id, md5(string_agg(substr(seq, off + 1, w), '' ORDER BY pos)) AS seq_md5, md5(string_agg(substr(qual, off + 1, w), '' ORDER BY pos)) AS qual_md5 FROM b JOIN loci l ON b.contig = l.contig AND pos >= l.start AND pos < l.stop GROUP BY locus, aln_id""",
    "q_large_variants": f"""{V.with_views('aln')} SELECT aln_id, 2 AS i, 'I' AS op, 3 AS len FROM aln WHERE contains(cigar, 'M3I')""",
    "q_msa_sites": """WITH p AS (SELECT p_brand || '|' || p_size AS grp, p_partkey, left(rpad(p_type, 24, '-'), 24) AS seq FROM part), c AS (SELECT grp, p_partkey, i, substr(seq, i, 1) AS base FROM (SELECT *, unnest(range(1, 25)) AS i FROM p)),
      k AS (SELECT grp, i, count(DISTINCT base) AS n FROM c GROUP BY ALL), m AS (SELECT *, CASE WHEN n > 1 AND lag(n, 1, 1) OVER (PARTITION BY grp ORDER BY i) = 1 THEN 1 ELSE 0 END AS new FROM k), s AS (SELECT grp, i, n, CAST(sum(new) OVER (PARTITION BY grp ORDER BY i) AS BIGINT) AS site FROM m)
      SELECT c.grp, site, p_partkey, string_agg(base, '' ORDER BY c.i) AS allele FROM c JOIN s ON c.grp = s.grp AND c.i = s.i WHERE n > 1 GROUP BY ALL""",
    "q_haplotype_sequence": f"""{V.with_views('reads')}, b AS (SELECT doc_id, i, substr(seq, i + 1, 1) AS base FROM (SELECT doc_id, seq, unnest(range(0, length(seq))) AS i FROM reads WHERE length(seq) > 0))
      SELECT doc_id AS key, md5(string_agg(CASE WHEN i % 20 IN (1, 2) THEN '' WHEN i % 20 = 10 THEN 'GG' ELSE base END, '' ORDER BY i)) AS seq_md5 FROM b GROUP BY doc_id""",
    "q_edge_reads": f"{_EDGES}, k AS (SELECT src, dst, seq FROM e GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2) SELECT DISTINCT doc_id FROM e JOIN k ON e.src = k.src AND e.dst = k.dst AND e.seq = k.seq",
    "q_furthest_next": f"{_EDGES}, t AS (SELECT DISTINCT src, dst, abs(b.pos - a.pos) AS step FROM e JOIN anchors a ON src = a.name JOIN anchors b ON dst = b.name) SELECT src, dst, step FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY step DESC, dst) AS rn FROM t) WHERE rn = 1",
    "q_path_sequence": "SELECT l_orderkey, string_agg(p_name, '' ORDER BY l_linenumber, l_partkey) AS seq FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey",
}
def q_region_scan(spark, d):
    """Alignments of the lines that overlap 20,000 to 21,000 of contig 3, from their sorted SAM text by its index."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    fields = [F.col("aln_id"), F.lit(0), F.col("contig"), F.col("start") + 1, F.col("mapq"), F.col("cigar"), *map(F.lit, ("*", 0, 0, "*", "*"))]
    V.alignments(spark, d).orderBy("contig", "start").select(F.concat_ws("\t", *fields)).write.text(folder)
    index = R.alignment_index(spark, folder)
    return R.indexed_region(index, "3", 20_000, 21_000).select(F.col("qname").alias("aln_id"), F.col("pos").cast("long").alias("pos"), "cigar")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
