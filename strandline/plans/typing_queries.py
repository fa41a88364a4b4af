"""Queries on sites of alleles, picks in order, repeat reports, callers, read assignment and variant rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import haplotypes as H
from strandline.operators import phasing as P
from strandline.operators import typing as T
from strandline.operators.lineage import cut
from strandline.plans import haplotype_queries as Q
from strandline.plans import views as V


def _site_parts(spark, d):
    """(sites of benchmark items, aligned pairs of pages to items, pages, items): a page aligns to the item of its number."""
    items, pages = V.bait(spark, d).where("length(seq) >= 60").select(F.col("item_id").alias("allele"), "seq"), V.haplotypes(spark, d)
    at = F.explode(F.sequence(F.lit(0), F.lit(42), F.lit(7)))
    cut = items.select("allele", "seq", at.alias("pos"))
    n = 1 + F.col("pos") % 2
    sites = cut.select("allele", "pos", F.substring("seq", F.col("pos") + 1, F.lit(1)).alias("ref"), F.substring("seq", F.col("pos") + 1, n).alias("alt"))
    aln = pages.select("hap", (F.col("hap") % 50).alias("allele"), (F.col("hap") % 3).cast("int").alias("pos"), F.concat(F.col("hap") % 9, F.lit("S20M1I5=2D60M")).alias("cigar"))
    return T.site_definitions(sites), T.aligned_pairs(aln, ["hap", "allele"]), pages, items


def q_aligned_pairs(spark, d):
    """Aligned bases of pages and benchmark items."""
    return _site_parts(spark, d)[1]


def q_site_matches(spark, d):
    """Sites at which a page has what its benchmark item has: the changed base, or around insertions all bases within three."""
    sites, pairs, pages, items = _site_parts(spark, d)
    return T.site_matches(sites, pairs, pages, items, 3)


def q_site_counts(spark, d):
    """Matched sites of each page's benchmark item, of all its sites."""
    return T.count_sites(q_site_matches(spark, d), _site_parts(spark, d)[0]).select("hap", "allele", "matched", "total", F.round("fraction", 9).alias("fraction"))


def q_genomic_best(spark, d):
    """Best parts of each supplier by matched bases, of alignments scored 6,000 or more, without one supplier and one part."""
    part, score = F.element_at(F.split("aln_id", "-"), 3).cast("long") % 20, (F.col("stop") - F.col("start")) * 30
    a = V.alignments(spark, d).select("aln_id", "cigar", F.col("sample").cast("string").alias("contig"), part.cast("string").alias("qname"), F.create_map(F.lit("AS"), score.cast("string")).alias("tags"))
    return T.genomic_best(a, "aln_id", 6_000, ("3",), ("7",))


def q_call_report(spark, d):
    """Calls of reads with their matched and total sites."""
    counts = Q._fractions(spark, d).withColumnRenamed("read", "hap")
    return T.call_report(Q.q_final_allele(spark, d), counts)


def q_paint_lines(spark, d):
    """Genes of all windows of each contig in order, and how many windows have one."""
    ends = V.alignments(spark, d).groupBy("contig").agg((F.max("stop") + 150).alias("length"))
    lines = T.paint_lines(Q.q_gene_paint(spark, d), ends, "contig", 100)
    return lines.select("contig", F.md5("line").alias("line_md5"), "coloured")


def _repeats(spark, d):
    return T.repeat_table(V.haplotypes(spark, d), Q.UNIT, Q.BEGINS, Q.ENDS, Q.BREAKS, Q.COUNTED)


def q_repeat_totals(spark, d):
    """Pages by number of repeats, and interruptions over all pages."""
    t = cut(_repeats(spark, d).select("n_repeats", "n_haps", "interruptions"))
    sizes = T.repeat_histogram(t).select(F.lit("repeats").alias("kind"), F.col("n_repeats").cast("string").alias("name"), F.col("haps").cast("long").alias("n"))
    return sizes.union(T.interruption_totals(t).select(F.lit("interruption"), "interruption", F.col("n").cast("long")))


def q_male_rule(spark, d):
    """Order states of customers; every third counts as male and keeps one row, or none if the states differ."""
    haps = V.read(spark, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("hap"), F.col("o_orderstatus").alias("repeat"))
    sexes = V.read(spark, d, "customer").select(F.col("c_custkey").alias("sample"), F.when(F.col("c_custkey") % 3 == 0, "male").otherwise("female").alias("sex"))
    return T.male_rule(haps, sexes)


def _callers(spark, d):
    lines = V.read(spark, d, "lineitem")
    ours = lines.select(F.col("l_partkey").alias("repeat"), F.col("l_suppkey").alias("sample"))
    theirs = lines.where("l_returnflag = 'R' and l_linenumber = 1").select(F.col("l_partkey").alias("repeat"), (F.col("l_suppkey") + F.col("l_orderkey") % 2).alias("sample"))
    return T.concordance(ours, theirs)


def q_concordance(spark, d):
    """Parts whose supplier a second caller saw with them too."""
    return _callers(spark, d)


def q_concordance_counts(spark, d):
    """Parts confirmed and missed."""
    return T.concordance_counts(_callers(spark, d))


def q_combine_haplotypes(spark, d):
    """The first click of each user and day."""
    e = V.read(spark, d, "events").select(F.col("user_id").alias("sample"), F.dayofmonth("ts").alias("hap"), F.col("event_type").alias("name"), F.col("event_id").alias("ord"), F.col("props").alias("seq"))
    return T.combine_haplotypes(e, "cl")


def q_numbered_suffix(spark, d):
    """Events of each user and type, the second and later ones numbered."""
    e = V.read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), F.col("event_type").alias("name"))
    return T.numbered_suffix(e, ["user_id", "kind"], "event_id", "name").select("event_id", "name")


def q_best_and_next(spark, d):
    """The last order of each customer, and the one before it if it is in the later half of all order numbers."""
    o = V.read(spark, d, "orders")
    half = o.agg(F.max("o_orderkey").alias("m")).first()["m"]
    return T.score_paths_keep(o.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", (half or 0) / 2)


def _sides(cells):
    """Two haplotypes over the sites: a rule of the site's number, with every fifth the same on both."""
    one = F.col("site") % 2
    return cells.select("locus", "site").distinct().select("locus", "site", one.cast("int").alias("h1"), F.when(F.col("site") % 5 == 0, one).otherwise(1 - one).cast("int").alias("h2"))


def q_assign_sites(spark, d):
    """Reads by which of two haplotypes more of their sites match."""
    c = Q.cells(spark, d)
    return P.assign_by_sites(c, _sides(c))


def q_assign_identity(spark, d):
    """Reads over half identical to either of two haplotypes."""
    c = Q.cells(spark, d)
    return P.assign_by_identity(c, _sides(c), 0.5)


def q_assign_votes(spark, d):
    """Reads by weighted votes for two haplotypes."""
    c = Q.cells(spark, d)
    return P.assign_reads(c, _sides(c))


def _variant_sites(spark, d):
    """Sites from lines (of lines at one place, the least part): reference and haplotype alleles by rules of the keys."""
    at, k, s = F.col("pos"), F.col("l.l_partkey"), F.col("l.l_suppkey")
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = V.read(spark, d, "lineitem").groupBy(place.alias("pos")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("l"))
    base = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    ref = base(k)
    h1 = F.when(k % 5 == 0, None).when(k % 7 == 0, "--").otherwise(base(k + s))
    h2 = F.when(s % 6 == 0, None).when(s % 4 == 0, F.concat(ref, base(at))).otherwise(ref)
    return lines.select((k % 5).alias("contig"), "pos", ref.alias("ref"), F.lit("GT").alias("deleted"), h1.alias("h1"), h2.alias("h2"), base(at).alias("before"), base(at + 1).alias("after"))


def q_variant_rows(spark, d):
    """Variant rows with reference, alternatives and genotype."""
    r = H.variant_rows(_variant_sites(spark, d))
    return r.select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), F.concat_ws("|", F.col("gt").cast("array<string>")).alias("gt"), "phased", "gq")


def q_clean_variants(spark, d):
    """Sites without those empty on both sides and without one-base insertions that repeat a neighbour."""
    rows = _variant_sites(spark, d).withColumn("locus", F.col("contig"))
    return H.clean_variants(rows).select("locus", "pos", "h1", "h2")


_C, _FR = Q._C, Q._FR
_SIDES = "sides AS (SELECT site, site % 2 AS h1, CASE WHEN site % 5 = 0 THEN site % 2 ELSE 1 - site % 2 END AS h2 FROM (SELECT DISTINCT site FROM cells)), r AS (SELECT read, c.site, allele, weight, h1, h2 FROM cells c JOIN sides s ON c.site = s.site WHERE allele IS NOT NULL)"
_SITES = f"""{V.with_views('bait', 'haps')}, items AS (SELECT item_id AS allele, seq FROM bait WHERE length(seq) >= 60),
  st AS (SELECT allele, pos, substr(seq, pos + 1, 1) AS ref, substr(seq, pos + 1, 1 + pos % 2) AS alt, seq FROM (SELECT allele, seq, unnest(range(0, 43, 7)) AS pos FROM items)),
  sites AS (SELECT *, CAST(coalesce(sum(length(alt) - length(ref)) OVER (PARTITION BY allele ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM st),
  pairs AS (SELECT hap, hap % 50 AS allele, hap % 3 + j + CASE WHEN j >= 25 THEN 2 ELSE 0 END AS ref_pos, hap % 9 + j + CASE WHEN j >= 20 THEN 1 ELSE 0 END AS hap_pos FROM (SELECT hap, unnest(range(0, 85)) AS j FROM haps))"""
_MATCHES = f"""{_SITES}, reach AS (SELECT hap, min(hap_pos) AS a, max(hap_pos) AS b FROM pairs GROUP BY hap),
  y AS (SELECT p.hap, s.allele, s.pos, s.ref, s.alt, s.seq, ref_pos, hap_pos - a AS place, substr(h.seq, a + 1, b - a + 1) AS seg
    FROM sites s JOIN pairs p ON p.allele = s.allele AND p.ref_pos = s.pos + s.shift JOIN haps h ON h.hap = p.hap JOIN reach ON reach.hap = p.hap),
  z AS (SELECT *, CASE WHEN length(alt) = length(ref) THEN substr(seg, place + 1, length(alt)) = alt
    ELSE seg[greatest(place - 3, 0) + 1 : place + length(alt) + 3] = seq[greatest(ref_pos - 3, 0) + 1 : ref_pos + length(alt) + 3] END AS good FROM y),
  hits AS (SELECT hap, allele, pos, ref, alt FROM z WHERE good)"""
_CALLERS = """WITH a AS (SELECT l_partkey AS repeat, count(*) AS n_haps FROM lineitem GROUP BY 1), c AS (SELECT DISTINCT x.l_partkey AS repeat FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey + y.l_orderkey % 2 WHERE y.l_returnflag = 'R' AND y.l_linenumber = 1),
  r AS (SELECT a.repeat, n_haps, c.repeat IS NOT NULL AS confirmed FROM a LEFT JOIN c ON a.repeat = c.repeat)"""
_B = "substr('ACGT', CAST({0} % 4 + 1 AS BIGINT), 1)"
_VARIANTS = f"""WITH l AS (SELECT k, s, pos FROM (SELECT l_partkey AS k, l_suppkey AS s, l_orderkey * 10 + l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1), v AS (SELECT k % 5 AS contig, pos, {_B.format('k')} AS ref, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN '--' ELSE {_B.format('(k + s)')} END AS h1,
  CASE WHEN s % 6 = 0 THEN NULL WHEN s % 4 = 0 THEN {_B.format('k')} || {_B.format('pos')} ELSE {_B.format('k')} END AS h2, {_B.format('pos')} AS before, {_B.format('(pos + 1)')} AS after FROM l)"""
ORACLES = {
    "q_aligned_pairs": f"{_SITES} SELECT hap, allele, CAST(ref_pos AS INTEGER) AS ref_pos, CAST(hap_pos AS INTEGER) AS hap_pos FROM pairs",
    "q_site_matches": f"{_MATCHES} SELECT hap, allele, CAST(pos AS INTEGER) AS pos, ref, alt FROM hits",
    "q_site_counts": f"{_MATCHES}, n AS (SELECT allele, count(DISTINCT (pos, ref, alt)) AS total FROM sites GROUP BY allele), m AS (SELECT hap, allele, count(DISTINCT (pos, ref, alt)) AS matched FROM hits GROUP BY ALL) SELECT hap, m.allele, matched, total, round(matched / total, 9) AS fraction FROM m JOIN n ON m.allele = n.allele",
    "q_genomic_best": """WITH a AS (SELECT CAST(l_suppkey AS VARCHAR) AS hap, CAST(l_partkey % 20 AS VARCHAR) AS allele, CAST(5 - l_linenumber % 3 - 1 - 2 AS INTEGER) AS score, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT), CAST(round(l_discount * 100) AS INTEGER)) AS id FROM lineitem WHERE floor(l_quantity) * 300 >= 6000 AND l_suppkey <> 3 AND l_partkey % 20 <> 7),
      n AS (SELECT *, row_number() OVER (PARTITION BY hap, allele ORDER BY id) AS rn FROM a), m AS (SELECT hap || CASE WHEN rn > 1 THEN '_' || rn ELSE '' END AS hap, allele, score FROM n), t AS (SELECT *, max(score) OVER (PARTITION BY hap) AS top FROM m) SELECT DISTINCT hap, allele, score FROM t WHERE score = top""",
    "q_call_report": f"""{Q.ORACLES['q_final_allele'].replace('SELECT read AS hap', ', calls AS (SELECT read AS hap').strip()}) SELECT hap, call, CASE WHEN total IS NOT NULL THEN matched || '/' || total END AS sites FROM calls LEFT JOIN f ON f.read = hap AND f.allele = call""",
    "q_paint_lines": f"""{Q.ORACLES['q_gene_paint'].replace('SELECT contig, start, CASE WHEN a AND b', ', painted AS (SELECT contig, start, CASE WHEN a AND b')}), ends AS (SELECT contig, max(stop) + 150 AS length FROM aln GROUP BY contig), grid AS (SELECT contig, length, unnest(range(0, CAST(length AS BIGINT), 100)) AS start FROM ends)
      SELECT e.contig, md5(string_agg(coalesce(gene, '-') || CASE WHEN e.start + 100 > length THEN '>' ELSE '' END, ' ' ORDER BY e.start)) AS line_md5, count(gene) AS coloured FROM grid e LEFT JOIN painted p ON p.contig = e.contig AND p.start = e.start GROUP BY e.contig HAVING count(gene) >= 1""",
    "q_repeat_totals": f"""WITH t AS ({Q.ORACLES['q_repeat_table']}) SELECT 'repeats' AS kind, CAST(n_repeats AS VARCHAR) AS name, CAST(sum(n_haps) AS BIGINT) AS n FROM t GROUP BY n_repeats
      UNION ALL SELECT 'interruption', 'CAGC', CAST(sum(cagc * n_haps) AS BIGINT) FROM t HAVING sum(cagc) > 0 UNION ALL SELECT 'interruption', 'GTC', CAST(sum(gtc * n_haps) AS BIGINT) FROM t HAVING sum(gtc) > 0""",
    "q_male_rule": """WITH h AS (SELECT o_custkey AS sample, o_orderkey AS hap, o_orderstatus AS repeat, coalesce(c_custkey % 3 = 0, FALSE) AS male, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders LEFT JOIN customer ON c_custkey = o_custkey), k AS (SELECT sample, count(DISTINCT repeat) AS kinds FROM h GROUP BY sample)
      SELECT h.sample, hap, repeat FROM h JOIN k ON h.sample = k.sample WHERE NOT male OR (kinds = 1 AND rn = 1)""",
    "q_concordance": f"{_CALLERS} SELECT repeat, n_haps, confirmed FROM r",
    "q_concordance_counts": f"{_CALLERS} SELECT count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (NOT confirmed) AS missed, count(*) FILTER (confirmed AND n_haps = 1) AS confirmed_single, count(*) FILTER (NOT confirmed AND n_haps = 1) AS missed_single FROM r",
    "q_combine_haplotypes": "SELECT sample, hap, seq FROM (SELECT user_id AS sample, CAST(day(ts) AS INTEGER) AS hap, props AS seq, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY event_id) AS rn FROM events WHERE starts_with(event_type, 'cl')) WHERE rn = 1",
    "q_numbered_suffix": "SELECT event_id, event_type || CASE WHEN rn > 1 THEN '_' || rn ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)",
    "q_best_and_next": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 OR (rn = 2 AND o_orderkey > (SELECT max(o_orderkey) FROM orders) / 2.0)",
    "q_assign_sites": f"{_C}, {_SIDES}, n AS (SELECT read, count(*) AS n, count(*) FILTER (allele = h1) AS p1, count(*) FILTER (allele = h2) AS p2 FROM r WHERE h1 <> h2 GROUP BY read) SELECT CAST(0 AS BIGINT) AS locus, read, CASE WHEN p1 > p2 THEN 1 ELSE 2 END AS haplotype, p1, p2 FROM n WHERE n >= 2 AND p1 <> p2",
    "q_assign_identity": f"{_C}, {_SIDES}, n AS (SELECT read, count(*) FILTER (allele = h1) / count(*) AS r1, count(*) FILTER (allele = h2) / count(*) AS r2 FROM r GROUP BY read) SELECT CAST(0 AS BIGINT) AS locus, read, CASE WHEN r1 > r2 THEN 1 ELSE 2 END AS haplotype FROM n WHERE greatest(r1, r2) > 0.5",
    "q_assign_votes": f"{_C}, {_SIDES} SELECT CAST(0 AS BIGINT) AS locus, read, CASE WHEN sum(CASE WHEN allele = h1 THEN weight ELSE -weight END) >= 0 THEN 1 ELSE 2 END AS haplotype FROM r GROUP BY read",
    "q_variant_rows": f"""{_VARIANTS}, w AS (SELECT contig, pos, ref, coalesce(h1, h2) AS a, coalesce(h2, h1) AS b FROM v WHERE h1 IS NOT NULL OR h2 IS NOT NULL), g AS (SELECT *, starts_with(a, '-') OR starts_with(b, '-') AS gone FROM w),
      s AS (SELECT contig, pos, CASE WHEN gone THEN ref || 'GT' ELSE ref END AS r, CASE WHEN starts_with(a, '-') THEN ref WHEN gone AND a = ref THEN ref || 'GT' ELSE a END AS x, CASE WHEN starts_with(b, '-') THEN ref WHEN gone AND b = ref THEN ref || 'GT' ELSE b END AS y FROM g)
      SELECT contig, pos, r AS ref, CASE WHEN x = r THEN y WHEN y = r OR y = x THEN x ELSE x || ',' || y END AS alts, CASE WHEN x = r THEN '0|1' WHEN y = r THEN '1|0' WHEN x = y THEN '1|1' ELSE '1|2' END AS gt, TRUE AS phased, 40 AS gq FROM s WHERE x <> r OR y <> r""",
    "q_clean_variants": f"{_VARIANTS} SELECT contig AS locus, pos, h1, h2 FROM v WHERE (h1 IS NOT NULL OR h2 IS NOT NULL) AND NOT (length(coalesce(h1, h2)) = 2 AND (right(coalesce(h1, h2), 1) = before OR right(coalesce(h1, h2), 1) = after))",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
