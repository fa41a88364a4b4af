"""Queries on phasing, models, anchors, typing, repeats and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import anchors as A
from strandline.operators import coassembly as C
from strandline.operators import graph as G
from strandline.operators import haplotypes as H
from strandline.operators import kmers as K
from strandline.operators import model as M
from strandline.operators import phasing as P
from strandline.operators import pileup
from strandline.operators import typing as T
from strandline.operators.lineage import cut
from strandline.plans import views as V
from strandline.plans.kmer_queries import colors

K_ANCHOR = 9
#: Repeat patterns over encoded pages: unit, begin and end patterns in priority order, interruptions.
UNIT, BEGINS, ENDS, BREAKS, COUNTED = "CAG", ("ACGACG", "ACGTA"), ("TTACC", "GGCAT"), (("CAGC", "CAGC"), ("GTC", "GTC")), ("GTC",)


def cells(spark, d):
    """Cells ``locus, read, site, allele, weight`` of the events: top two alleles of a site as 0 and 1, others null."""
    rows = V.alleles(spark, d)
    codes = pileup.top_alleles(rows, ["site"]).select("site", "allele", F.col("code").cast("int").alias("code"))
    joined = rows.join(codes, ["site", "allele"], "left")
    return joined.select(F.lit(0).cast("long").alias("locus"), "read", "site", F.col("code").alias("allele"), F.col("w").cast("int").alias("weight"))


def q_site_windows(spark, d):
    """Windows of 20 sites every 5."""
    return P.site_windows(cells(spark, d), 20, 5)


def q_best_reads(spark, d):
    """The 12 most complete reads of each window."""
    return P.best_reads(P.windowed_cells(cells(spark, d), 20, 5))


def q_majority(spark, d):
    """Majority of each read's coded alleles over sites, as a haplotype."""
    votes = cells(spark, d).where("allele is not null").withColumn("haplotype", F.col("allele") + 1)
    return P.majority(votes)


def q_phase(spark, d):
    """Haplotypes of all sites, phased in windows and stitched."""
    return P.phase_windows(cells(spark, d), 20, 5)


def q_phase_reads(spark, d):
    """Haplotype of each read by weighted votes."""
    c = cells(spark, d)
    return P.assign_reads(c, P.phase_windows(c, 20, 5))


def q_confusion(spark, d):
    """Outcome counts and rates of the document scores."""
    c = M.confusion(V.scored(spark, d))
    return c.select("tp", "fp", "tn", "fn", *[F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


def q_roc(spark, d):
    """Rates at 100 thresholds."""
    return M.roc(V.scored(spark, d)).select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def q_gbt_score(spark, d):
    """Scores of all k-mers by a boosted-tree model of their truth label."""
    rows = K.features(K.color_table(colors(spark, d), ("long", "short", "truth")))
    return M.score(rows, M.train(rows)).select("cn_kmer", "label", F.round("score", 6).alias("score"))


def _anchor_parts(spark, d):
    reads, ref = V.reads(spark, d), V.bait(spark, d).withColumnRenamed("item_id", "contig")
    found = cut(A.positions(reads, K.unique_kmers(ref, K_ANCHOR), K_ANCHOR, "doc_id", ("sample",)))
    shared = A.in_every_sample(found, "doc_id")
    on_ref = A.positions(ref.withColumn("sample", F.lit("reference")), shared, K_ANCHOR, "contig").select("contig", "kmer", "pos")
    named = A.spaced(on_ref, K_ANCHOR).withColumn("name", A.anchor_name("contig", "pos", K_ANCHOR))
    return reads, found, named


def q_anchors(spark, d):
    """Benchmark k-mers that are unique there and that every source has, kept well apart."""
    return _anchor_parts(spark, d)[2].select("contig", "kmer", F.col("pos").cast("long").alias("pos"), "name")


def q_anchor_edges(spark, d):
    """Steps of all documents between anchors, merged."""
    reads, found, named = _anchor_parts(spark, d)
    e = A.merge_edges(A.anchor_edges(found, named, reads, K_ANCHOR, "doc_id"), "doc_id")
    return e.select("src", "dst", F.md5("seq").alias("seq_md5"), F.size("reads").cast("long").alias("n_reads"), F.array_join("samples", ",").alias("samples"))


def q_seed_map(spark, d):
    """Where each document maps in the benchmark, by seed votes."""
    return H.seed_map(V.reads(spark, d), V.bait(spark, d), 11, "doc_id", "item_id")


def _customer_features(spark, d, *parts):
    o, c = V.read(spark, d, "orders"), V.read(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("grp"), "c_custkey", F.concat_ws("|", "o_orderpriority", "o_orderstatus", *parts).alias("feature"))


def q_variant_distance(spark, d):
    """Distances of customers by priority, status and month of their orders, within each nation."""
    return H.variant_distances(_customer_features(spark, d, F.month("o_orderdate")), "grp", "c_custkey", "feature")


def q_cluster_reads(spark, d):
    """Density clusters of all customers of each nation by priority and status of their orders."""
    reads = V.read(spark, d, "customer").select(F.col("c_nationkey").alias("grp"), "c_custkey")
    return H.cluster_reads(_customer_features(spark, d), reads, "grp", "c_custkey", "feature")


def q_dedup_pairs(spark, d):
    """The first two events of each user and type."""
    e = V.read(spark, d, "events").withColumn("name", F.concat_ws("|", "user_id", "event_type"))
    return T.dedup_pairs(e, "name", "event_id").select("name", "event_id")


def q_paired_only(spark, d):
    """Orders with exactly two lines."""
    return T.exact_pairs(V.read(spark, d, "lineitem"), "l_orderkey")[0].select("l_orderkey", "l_partkey", "l_linenumber")


def q_chunk_names(spark, d):
    """Documents of each source in chunks of 100."""
    return T.chunk_names(V.read(spark, d, "documents").select("doc_id", "source"), "doc_id", 100, ["source"])


def q_indel_offset(spark, d):
    """Running length change before each part of a brand."""
    p = V.read(spark, d, "part").select(F.col("p_brand").alias("allele"), F.col("p_partkey").alias("pos"), F.substring("p_name", 1, 3).alias("ref"), F.col("p_type").alias("alt"))
    return T.site_definitions(p).select("allele", "pos", "offset")


def _fractions(spark, d):
    e = V.alleles(spark, d)
    return e.groupBy("read", "allele").agg(F.count_if(F.expr("w >= 20")).alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("fraction", F.col("matched") / F.col("total"))


def q_site_best_second(spark, d):
    """Best and second-best allele of each read, by share of heavy sites."""
    return T.best_and_second(_fractions(spark, d), ["read"], "fraction", "total", "allele").select("read", "allele", "matched", "total", "place")


def q_final_allele(spark, d):
    """One allele a read: the best by count among those whose sites are all heavy, else the fallback, or Ambiguous."""
    f = _fractions(spark, d).withColumnRenamed("read", "hap")
    return T.final_allele(T.best_with_ties(f, ["hap"], "fraction"), T.best_with_ties(f, ["hap"], "total"), "click")


def q_gene_paint(spark, d):
    """Genes (suppliers' nations) painted over windows of alignments."""
    a = V.alignments(spark, d).join(V.read(spark, d, "supplier"), F.col("sample") == F.col("s_suppkey"))
    hits = a.select("contig", (F.floor(F.col("start") / 100) * 100).alias("start"), F.concat(F.lit("n"), "s_nationkey").alias("gene"), "mapq")
    return T.paint(hits, ("n1", "n2"), ["contig", "start"])


def q_repeat_table(spark, d):
    """Repeat sequences of encoded pages with counts of units, haplotypes and interruptions."""
    t = T.repeat_table(V.haplotypes(spark, d), UNIT, BEGINS, ENDS, BREAKS, COUNTED)
    return t.select(F.md5("repeat").alias("repeat_md5"), F.col("n_repeats").cast("long").alias("n_repeats"), F.col("n_haps").cast("long").alias("n_haps"), *[F.coalesce(F.col("interruptions")[n], F.lit(0)).cast("long").alias(n.lower()) for n, _ in BREAKS])


def q_set_compare(spark, d):
    """Words of the benchmark and of the labelled good documents: on which side each is."""
    words = lambda t: t.select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("word")).where("word <> ''")
    good = V.read(spark, d, "documents").join(V.read(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return T.compare(words(V.read(spark, d, "benchmark")), words(good), "word")


def q_unitigs(spark, d):
    """Non-branching runs of the benchmark's k-mer graph."""
    return G.contigs(K.count_kmers(V.bait(spark, d), 15))


def _scored_bait(spark, d):
    """The benchmark's k-mers, scored by their GC share; those of a low share come from short reads alone."""
    t = K.count_kmers(V.bait(spark, d), 15).withColumn("score", S.gc_content("cn_kmer"))
    return t.withColumn("sources", F.when(F.col("score") < 0.3, F.array(F.lit("short"))).otherwise(F.array(F.lit("long"), F.lit("short"))))


def q_clean(spark, d):
    """Benchmark k-mers left after all cleaning steps."""
    return G.clean(_scored_bait(spark, d), 15, 0.3).select("cn_kmer", "cov")


def q_correct(spark, d):
    """All documents, their poor stretches replaced by ways through the benchmark's k-mers."""
    t = K.count_kmers(V.bait(spark, d), 15, score=True)
    fixed = G.correct_reads(V.reads(spark, d).select("doc_id", "seq"), t, 15, "doc_id")
    return fixed.select("doc_id", F.md5("seq").alias("seq_md5"), "replaced")


def q_windowed_correction(spark, d):
    """Two plain copies of each benchmark item and one with a wrong base in every window of 100, corrected window by window with pieces of the documents."""
    tiles = V.bait(spark, d).select("item_id", F.explode(S.tiles("seq", 100)).alias("t")).select("item_id", F.floor(F.col("t.start") / 100).cast("int").alias("tile"), F.col("t.seq").alias("seq"))
    wrong = F.concat(F.left("seq", F.lit(45)), F.translate(F.substring("seq", 46, 1), "ACGT", "CGTA"), F.substring("seq", F.lit(47), F.length("seq")))
    copies = tiles.select(F.col("item_id").alias("locus"), "tile", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("read"), "seq")
    pieces = copies.withColumn("seq", F.when((F.col("read") == 2) & (F.length("seq") >= 90), wrong).otherwise(F.col("seq")))
    shorts = V.reads(spark, d).select(F.explode(S.tiles("seq", 100)).alias("t"), "doc_id").select(F.concat_ws("_", "doc_id", "t.start").alias("short"), F.col("t.seq").alias("seq"))
    fixed = C.correct_windows(pieces, shorts, 15, "short", threshold=None, score=F.when(F.col("cov") >= 2, 0.99).otherwise(0.01))
    return fixed.select("locus", "read", F.md5("seq").alias("seq_md5"), "replaced", F.length("qual").alias("n_quals"))


def q_co_assembly(spark, d):
    """Two haplotypes of each benchmark item, which differ by a base and by seven bases, from copies on either strand."""
    third = F.floor(F.length("seq") / 3).cast("int")
    one = V.bait(spark, d).select(F.col("item_id").alias("locus"), "seq", third.alias("at"))
    base = F.translate(F.substring("seq", F.col("at") + 1, F.lit(1)), "ACGT", "CGTA")
    other = F.concat(F.left("seq", F.col("at")), base, F.substring("seq", F.col("at") + 2, F.col("at") - 1), F.lit("GATTACA"), F.substring("seq", 2 * F.col("at") + 1, F.length("seq")))
    both = one.select("locus", F.explode(F.array("seq", other)).alias("seq"))
    reads = both.select("locus", F.posexplode(F.array("seq", S.reverse_complement("seq"), "seq")).alias("i", "seq"))
    reads = reads.select("locus", F.xxhash64("i", "seq").alias("read"), "seq")
    found = C.co_assemble(reads, reads, 15, "read", threshold=None, least=40)
    return found.select("locus", F.md5(S.canonical("seq")).alias("seq_md5"))


def q_superbubbles(spark, d):
    """Bubbles of the word graph of each benchmark item."""
    w = V.read(spark, d, "benchmark").select("item_id", F.posexplode(F.split(F.lower("text"), r"[^a-zà-ÿ]+")).alias("i", "word"))
    e = w.alias("x").join(w.alias("y"), (F.col("x.item_id") == F.col("y.item_id")) & (F.col("y.i") == F.col("x.i") + 1)).select(F.concat_ws("|", "x.item_id", "x.word").alias("src"), F.concat_ws("|", "y.item_id", "y.word").alias("dst")).where("src <> dst").distinct()
    return G.superbubbles(e)


_C = f"{V.with_views('alleles')}, tc AS (SELECT site, allele, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, allele) AS rn FROM alleles GROUP BY site, allele), cells AS (SELECT a.read, a.site, CASE WHEN rn <= 2 THEN rn - 1 END AS allele, w AS weight FROM alleles a JOIN tc ON a.site = tc.site AND a.allele = tc.allele)"
_W = "n AS (SELECT count(DISTINCT site) AS n FROM cells), wins AS (SELECT w AS win, w * 5 AS first, least(w * 5 + 20, n) AS last FROM (SELECT n, unnest(range(0, CAST(greatest(ceil((n - 20) / 5), 0) AS BIGINT) + 1)) AS w FROM n))"
_FR = f"{V.with_views('alleles')}, f AS (SELECT read, allele, count(*) FILTER (w >= 20) AS matched, count(*) AS total, count(*) FILTER (w >= 20) / count(*) AS fraction FROM alleles GROUP BY ALL)"
_K9 = K_ANCHOR
_ANCHORS = f"""WITH RECURSIVE {V.SQL['reads']}, {V.SQL['bait']},
  bk AS (SELECT item_id AS contig, pos, substr(seq, pos + 1, {_K9}) AS kmer FROM (SELECT item_id, seq, unnest(range(0, length(seq) - {_K9 - 1})) AS pos FROM bait WHERE length(seq) >= {_K9})),
  u AS (SELECT kmer FROM bk GROUP BY kmer HAVING count(*) = 1),
  found AS (SELECT * FROM (SELECT doc_id, sample, pos, substr(seq, pos + 1, {_K9}) AS kmer FROM (SELECT doc_id, sample, seq, unnest(range(0, length(seq) - {_K9 - 1})) AS pos FROM reads WHERE length(seq) >= {_K9})) WHERE kmer IN (SELECT kmer FROM u)),
  shared AS (SELECT kmer FROM found GROUP BY kmer HAVING count(DISTINCT sample) = (SELECT count(DISTINCT sample) FROM found) AND count(DISTINCT doc_id) > 1),
  r AS (SELECT contig, pos, kmer FROM bk WHERE kmer IN (SELECT kmer FROM shared)),
  b AS (SELECT contig, min(pos) AS pos FROM r GROUP BY contig, pos // {_K9 + 1}),
  g AS (SELECT contig, min(pos) AS pos FROM b WHERE pos > {_K9} GROUP BY contig UNION ALL SELECT g.contig, min(b.pos) AS pos FROM g JOIN b ON g.contig = b.contig AND b.pos > g.pos + {_K9} GROUP BY g.contig),
  anchors AS (SELECT g.contig, r.kmer, g.pos, printf('A%d_%06d', g.contig, g.pos // {_K9 + 1}) AS name FROM g JOIN r ON g.contig = r.contig AND g.pos = r.pos)"""


def _first_of(patterns: tuple[str, ...], text: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains({text}, '{p}') THEN strpos({text}, '{p}') END" for p in patterns) + ")"


def _which_of(patterns: tuple[str, ...], text: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains({text}, '{p}') THEN {len(p)} END" for p in patterns) + ")"


_GOLD = "(SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM {0}) WHERE word <> '')"
ORACLES = {
    "q_site_windows": f"{_C}, {_W} SELECT CAST(0 AS BIGINT) AS locus, CAST(win AS INTEGER) AS \"window\", CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM wins",
    "q_best_reads": f"""{_C}, {_W}, k AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS rank FROM (SELECT DISTINCT site FROM cells)),
      x AS (SELECT win, read, c.site, allele, weight FROM cells c JOIN k ON c.site = k.site JOIN wins ON rank >= first AND rank < last),
      s AS (SELECT win, count(DISTINCT site) AS sites FROM x GROUP BY win), g AS (SELECT win, read, count(*) FILTER (allele IS NOT NULL AND weight > 0) AS good FROM x GROUP BY ALL),
      o AS (SELECT g.win, read, sites - good AS bad, row_number() OVER (PARTITION BY g.win ORDER BY sites - good, read) AS rn FROM g JOIN s ON g.win = s.win)
      SELECT CAST(0 AS BIGINT) AS locus, CAST(win AS INTEGER) AS "window", read, bad FROM o WHERE rn <= 12""",
    "q_majority": f"{_C} SELECT CAST(0 AS BIGINT) AS locus, read, CASE WHEN sum(CASE WHEN allele = 0 THEN 1 ELSE -1 END) >= 0 THEN 1 ELSE 2 END AS haplotype FROM cells WHERE allele IS NOT NULL GROUP BY read",
    "q_confusion": f"""{V.with_views('scored')}, c AS (SELECT count(*) FILTER (score > 0.5 AND label = 1) AS tp, count(*) FILTER (score > 0.5 AND label = 0) AS fp, count(*) FILTER (score <= 0.5 AND label = 0) AS tn, count(*) FILTER (score <= 0.5 AND label = 1) AS fn FROM scored)
      SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "q_roc": f"{V.with_views('scored')} SELECT i / 100.0 AS threshold, round(count(*) FILTER (score > i / 100.0 AND label = 0) / count(*) FILTER (label = 0), 6) AS fpr, round(count(*) FILTER (score > i / 100.0 AND label = 1) / count(*) FILTER (label = 1), 6) AS tpr FROM scored CROSS JOIN range(0, 100) t(i) GROUP BY i",
    "q_anchors": f"{_ANCHORS} SELECT contig, kmer, pos, name FROM anchors",
    "q_anchor_edges": f"""{_ANCHORS}, p AS (SELECT doc_id, sample, name, found.pos FROM found JOIN anchors a ON found.kmer = a.kmer) , s AS (
      SELECT doc_id, sample, coalesce(lag(name) OVER w, 'SOURCE') AS src, name AS dst, coalesce(lag(pos) OVER w, 0) AS a, pos AS b FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos, name)
      UNION ALL SELECT doc_id, sample, name, 'SINK', pos, NULL FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC, name DESC) AS rn FROM p) WHERE rn = 1),
      e AS (SELECT s.doc_id, s.sample, src, dst, substr(seq, CAST(a AS BIGINT) + 1, CAST(coalesce(b, length(seq)) - a AS BIGINT)) AS seq FROM s JOIN reads r ON s.doc_id = r.doc_id)
      SELECT src, dst, md5(seq) AS seq_md5, count(DISTINCT doc_id) AS n_reads, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples FROM e GROUP BY src, dst, seq""",
    "q_seed_map": f"""{V.with_views('reads', 'bait')}, r AS (SELECT doc_id, pos AS rp, least(kmer, {V.rc('kmer')}) AS cn, kmer < {V.rc('kmer')} AS rf FROM ({V.kmers('reads', 'doc_id', 11)})), t AS (SELECT item_id, pos AS tp, least(kmer, {V.rc('kmer')}) AS cn, kmer < {V.rc('kmer')} AS tf FROM ({V.kmers('bait', 'item_id', 11)})),
      q AS (SELECT cn FROM t GROUP BY cn HAVING count(*) <= 200), h AS (SELECT doc_id, item_id, CASE WHEN rf = tf THEN '+' ELSE '-' END AS strand, CASE WHEN rf = tf THEN tp - rp ELSE tp + rp END AS shift, q.cn IS NOT NULL AS rare FROM r JOIN t ON r.cn = t.cn LEFT JOIN q ON t.cn = q.cn),
      f AS (SELECT doc_id, item_id, strand, CAST(floor(shift / 50) AS BIGINT) AS band, count(*) AS votes FROM h WHERE rare GROUP BY ALL HAVING count(*) >= 3),
      v AS (FROM f UNION ALL SELECT doc_id, item_id, strand, CAST(floor(shift / 50) AS BIGINT) AS band, count(*) AS votes FROM h WHERE doc_id NOT IN (SELECT doc_id FROM f) GROUP BY ALL HAVING count(*) >= 3), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, item_id, strand, band) AS rn FROM v)
      SELECT doc_id, item_id, strand, band * 50 AS "at", votes FROM b WHERE rn = 1""",
    "q_variant_distance": """WITH r AS (SELECT DISTINCT c_nationkey AS grp, c_custkey, concat_ws('|', o_orderpriority, o_orderstatus, month(o_orderdate)) AS feature FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT grp, c_custkey, count(*) AS n FROM r GROUP BY ALL),
      b AS (SELECT x.grp, x.c_custkey AS a, y.c_custkey AS b, count(*) AS m FROM r x JOIN r y ON x.grp = y.grp AND x.feature = y.feature AND x.c_custkey < y.c_custkey GROUP BY ALL)
      SELECT b.grp, a, b, p.n + q.n - 2 * m AS d2 FROM b JOIN n p ON p.grp = b.grp AND p.c_custkey = a JOIN n q ON q.grp = b.grp AND q.c_custkey = b""",
    "q_dedup_pairs": "SELECT name, event_id FROM (SELECT concat_ws('|', user_id, event_type) AS name, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 2",
    "q_paired_only": "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n = 2",
    "q_chunk_names": "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS chunk FROM documents",
    "q_indel_offset": "SELECT p_brand AS allele, p_partkey AS pos, CAST(coalesce(sum(length(p_type) - length(substr(p_name, 1, 3))) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM part",
    "q_site_best_second": f"""{_FR}, a AS (SELECT *, rank() OVER (PARTITION BY read ORDER BY fraction DESC, total DESC) AS r FROM f), o AS (SELECT * FROM a WHERE r = 1), s AS (SELECT *, rank() OVER (PARTITION BY read ORDER BY fraction DESC, total DESC) AS q FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.read = f.read AND o.allele = f.allele))
      SELECT read, allele, matched, total, 1 AS place FROM o UNION ALL SELECT read, allele, matched, total, 2 FROM s WHERE q = 1""",
    "q_final_allele": f"""{_FR}, m AS (SELECT *, max(fraction) OVER (PARTITION BY read) AS mf, max(total) OVER (PARTITION BY read) AS mt FROM f), c AS (SELECT read, max(fraction) AS f, count(DISTINCT allele) FILTER (fraction = mf AND total = mt) AS n, max(allele) FILTER (fraction = mf AND total = mt) AS allele, bool_or(allele = 'click' AND total = mt) AS spare FROM m GROUP BY read)
      SELECT read AS hap, CASE WHEN f = 1 AND n = 1 THEN allele WHEN f < 1 AND spare THEN 'click' ELSE 'Ambiguous' END AS call FROM c""",
    "q_gene_paint": f"""{V.with_views('aln')}, h AS (SELECT contig, (start // 100) * 100 AS start, 'n' || s_nationkey AS gene, mapq FROM aln JOIN supplier ON aln.sample = s_suppkey), t AS (SELECT *, max(mapq) OVER (PARTITION BY contig, start) AS top FROM h),
      g AS (SELECT contig, start, bool_or(gene = 'n1') AS a, bool_or(gene = 'n2') AS b, min(gene) AS low FROM t WHERE mapq = top GROUP BY ALL) SELECT contig, start, CASE WHEN a AND b THEN 'Both' WHEN a THEN 'n1' WHEN b THEN 'n2' ELSE low END AS gene FROM g""",
    "q_repeat_table": f"""{V.with_views('haps')}, s AS (SELECT hap, substr(seq, {_first_of(BEGINS, 'seq')} + {_which_of(BEGINS, 'seq')}) AS rest FROM haps WHERE {_first_of(BEGINS, 'seq')} IS NOT NULL), t AS (SELECT hap, substr(rest, 1, {_first_of(ENDS, 'rest')} - 1) AS repeat FROM s WHERE {_first_of(ENDS, 'rest')} IS NOT NULL),
      g AS (SELECT repeat, count(DISTINCT hap) AS n_haps FROM t GROUP BY repeat)
      SELECT md5(repeat) AS repeat_md5, CAST(len(regexp_extract_all(repeat, 'CAG')) + len(regexp_extract_all(regexp_extract(repeat, 'CAG(.*CAG)?'), 'GTC')) AS BIGINT) AS n_repeats, n_haps, CAST(len(regexp_extract_all(repeat, 'CAGC')) AS BIGINT) AS cagc, CAST(len(regexp_extract_all(regexp_replace(repeat, 'CAGC', '....', 'g'), 'GTC')) AS BIGINT) AS gtc FROM g""",
    "q_set_compare": f"WITH a AS {_GOLD.format('benchmark')}, b AS {_GOLD.format('(SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))')} SELECT coalesce(a.word, b.word) AS word, CASE WHEN a.word IS NULL THEN 'b' WHEN b.word IS NULL THEN 'a' ELSE 'both' END AS side FROM a FULL JOIN b ON a.word = b.word",
}
ORACLES |= {
    # what was planted comes back
    "q_windowed_correction": f"""{V.with_views('bait')}, t AS (SELECT item_id AS locus, seq, unnest([0, 1, 2]) AS read FROM bait)
      SELECT locus, read, md5(seq) AS seq_md5, CAST(CASE WHEN read = 2 THEN length(seq) // 100 + CASE WHEN length(seq) % 100 >= 90 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS replaced, CAST(length(seq) AS INTEGER) AS n_quals FROM t WHERE length(seq) > 0""",
    "q_co_assembly": f"""{V.with_views('bait')}, o AS (SELECT item_id AS locus, seq, CAST(length(seq) // 3 AS INTEGER) AS n FROM bait),
      h AS (SELECT locus, seq FROM o UNION ALL SELECT locus, substr(seq, 1, n) || translate(substr(seq, n + 1, 1), 'ACGT', 'CGTA') || substr(seq, n + 2, n - 1) || 'GATTACA' || substr(seq, 2 * n + 1) FROM o)
      SELECT locus, md5(least(seq, {V.rc('seq')})) AS seq_md5 FROM h""",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
