"""Queries on k-mers: counts, edges, screens, colors, features, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import kmers as K
from strandline.plans import views as V

SIZE = 11


def q_kmer_count(spark, d):
    """Canonical k-mer counts of all reads, by strand."""
    return K.count_kmers(V.reads(spark, d), SIZE).select("cn_kmer", *[F.col(c).cast("long").alias(c) for c in ("cov", "cov_fw", "cov_rc")])


def q_kmer_edges(spark, d):
    """Observed edges and degrees of each k-mer."""
    t = K.count_kmers(V.reads(spark, d), SIZE)
    return t.select("cn_kmer", "edges", S.edges_text("edges").alias("edges_text"), S.in_degree("edges").cast("int").alias("in_degree"), S.out_degree("edges").cast("int").alias("out_degree"))


def q_degree_junctions(spark, d):
    """K-mers by inferred degrees, and how many of them are junctions."""
    t = K.infer_edges(K.count_kmers(V.reads(spark, d), SIZE))
    t = t.select(S.in_degree("edges").cast("int").alias("in_degree"), S.out_degree("edges").cast("int").alias("out_degree"), S.is_junction("edges").alias("j"))
    return t.groupBy("in_degree", "out_degree").agg(F.count(F.lit(1)).alias("n"), F.count_if("j").alias("junctions"))


def q_noise_repeats(spark, d):
    """K-mers that no read repeats."""
    r = V.reads(spark, d)
    return K.without(K.count_kmers(r, SIZE), K.noise_kmers(r, SIZE, "doc_id")).select("cn_kmer", F.col("cov").cast("long").alias("cov"))


def q_seq_stats(spark, d):
    """Length, compressed length, entropy, GC share and both ends of the other strand of each read."""
    r, rc = V.reads(spark, d), S.reverse_complement("seq")
    return r.select(
        "doc_id", F.length("seq").cast("long").alias("n"), F.length(S.homopolymer_compressed("seq")).cast("long").alias("n_compressed"), F.round(S.shannon_entropy("seq"), 6).alias("entropy"),
        F.round(S.gc_content("seq"), 6).alias("gc"), F.md5(rc).alias("rc_md5"),
    )


def q_color_merge(spark, d):
    """K-mer coverages summed over colors (languages), with the sorted list of colors."""
    t = K.count_kmers(V.reads(spark, d), SIZE, ("lang",)).withColumnRenamed("lang", "color")
    return K.collapse_colors(t).select("cn_kmer", "cov", "cov_fw", F.array_join("sources", ",").alias("sources"))


def colors(spark, d):
    """K-mer tables of the colors long (English), short (other languages) and truth (good documents)."""
    r = V.reads(spark, d)
    truth = r.join(V.read(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    parts = {"long": r.where("lang = 'en'"), "short": r.where("lang <> 'en'"), "truth": truth}
    tables = [K.count_kmers(x, SIZE).select("cn_kmer", "cov", "cov_fw", F.lit(c).alias("color")) for c, x in parts.items()]
    return tables[0].union(tables[1]).union(tables[2])


def q_features(spark, d):
    """The six features and the label of each k-mer."""
    return K.features(K.color_table(colors(spark, d), ("long", "short", "truth"))).select(
        "cn_kmer", "in_long", "short_cov", F.round("strand_ratio", 6).alias("strand_ratio"), "hp_loss", F.round("entropy", 6).alias("entropy"), F.round("gc", 6).alias("gc"), "label"
    )


def q_training_bag(spark, d):
    """How often each k-mer stands in the bag of long, short and truth keys."""
    c = colors(spark, d)
    bag = K.union_bag([c.where(F.col("color") == x) for x in ("long", "short", "truth")])
    return bag.groupBy("cn_kmer").agg(F.count(F.lit(1)).alias("n"))


def _tiles(spark, d):
    rows = V.reads(spark, d).select("doc_id", F.explode(S.tiles("seq", 100)).alias("t"))
    return rows.select(F.concat_ws("_", "doc_id", "t.start").alias("tile"), F.col("t.seq").alias("seq"))


def q_rescue(spark, d):
    """100-base tiles of documents that share over 70 percent with the benchmark's k-mers."""
    return K.screen(_tiles(spark, d), V.bait(spark, d), SIZE, 70.0, "tile").select("tile", "hits", F.col("length").cast("long").alias("length"))


def q_recruit_distinct(spark, d):
    """Documents of other languages that share over half of their k-mers with a source's English ones."""
    r = V.reads(spark, d)
    return K.recruit_distinct(r.where("lang <> 'en'"), r.where("lang = 'en'"), 7, "doc_id", ("sample",))


def q_contig_end_distance(spark, d):
    """Least distance of each k-mer to an end of a document."""
    return K.end_distance(V.reads(spark, d), SIZE)


def q_unique_ref_kmers(spark, d):
    """K-mers that occur once in the whole benchmark."""
    return K.unique_kmers(V.bait(spark, d), SIZE)


def q_links(spark, d):
    """Junction choices of benchmark sequences, by anchor."""
    b = V.bait(spark, d)
    return K.links(b, K.count_kmers(b, 5), 5, "item_id").select("anchor_kmer", "is_forward", F.md5("junctions").alias("junctions"), "n")


def q_shared_pairs(spark, d):
    """K-mers that consecutive benchmark items share."""
    b = V.bait(spark, d)
    k = K.occurrences(b, 7, ["item_id"])
    pairs = b.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return K.shared_in_pairs(k, pairs, "item_id").select("a", "b", F.col("shared").cast("long").alias("shared"))


def q_low_complexity(spark, d):
    """Low-complexity stretches of the benchmark."""
    return K.low_complexity(V.bait(spark, d), "item_id", limit=1.0)


_B = V.with_views
_CN = f"least(kmer, {V.rc('kmer')})"


def _occ(k: int) -> str:
    return f"occ AS (SELECT *, {_CN} AS cn, kmer < {V.rc('kmer')} AS fw FROM ({V.kmers('reads', 'doc_id, lang, sample', k)}))"


_OCC = _occ(SIZE)


def _bits(b: str, base: int) -> str:
    return f"CASE {b} WHEN 'A' THEN {base} WHEN 'C' THEN {2 * base} WHEN 'G' THEN {4 * base} WHEN 'T' THEN {8 * base} ELSE 0 END"


_EDGE = f"CASE WHEN fw THEN ({_bits('before', 1)}) | ({_bits('after', 16)}) ELSE ({_bits(V.rc('after'), 1)}) | ({_bits(V.rc('before'), 16)}) END"
_TEXT = " || ".join(f"CASE WHEN edges & {1 << i} <> 0 THEN '{c}' ELSE '.' END" for i, c in enumerate("acgtACGT"))
_IN, _OUT = "CAST(bit_count(CAST(edges & 15 AS INTEGER)) AS INTEGER)", "CAST(bit_count(CAST(edges & 240 AS INTEGER)) AS INTEGER)"


def _near(i: int) -> str:
    b = "ACGT"[i % 4]
    x = f"substr(cn, 2) || '{b}'" if i >= 4 else f"'{b}' || substr(cn, 1, {SIZE - 1})"
    return f"SELECT cn, {1 << i} AS bit, least({x}, {V.rc(f'({x})')}) AS near FROM k"


def _color_sql(group: str) -> str:
    truth = "doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"
    return f"""c AS (SELECT cn, least(count(*) FILTER (lang = 'en'), 65535) AS long_cov, least(count(*) FILTER (lang <> 'en'), 65535) AS short_cov,
      least(count(*) FILTER (lang <> 'en' AND fw), 65535) AS short_fw, least(count(*) FILTER ({truth}), 65535) AS truth_cov FROM occ GROUP BY cn)"""


def _entropy(x: str) -> str:
    return " + ".join(f"CASE WHEN contains({x}, '{b}') THEN -(length({x}) - length(replace({x}, '{b}', ''))) / length({x}) * log2((length({x}) - length(replace({x}, '{b}', ''))) / length({x})) ELSE 0 END" for b in "ACGT")


_GC = "length(regexp_replace({0}, '[^GC]', '', 'g')) / length({0})"
ORACLES = {
    "q_kmer_count": f"{_B('reads')}, {_OCC} SELECT cn AS cn_kmer, least(count(*), 65535) AS cov, least(count(*) FILTER (fw), 65535) AS cov_fw, least(count(*) FILTER (NOT fw), 65535) AS cov_rc FROM occ GROUP BY cn",
    "q_kmer_edges": f"{_B('reads')}, {_OCC}, e AS (SELECT cn, bit_or({_EDGE}) AS edges FROM occ GROUP BY cn) SELECT cn AS cn_kmer, edges, {_TEXT} AS edges_text, {_IN} AS in_degree, {_OUT} AS out_degree FROM e",
    "q_degree_junctions": f"""{_B('reads')}, {_OCC}, k AS (SELECT DISTINCT cn FROM occ), n AS ({' UNION ALL '.join(_near(i) for i in range(8))}),
      e AS (SELECT k.cn, coalesce(bit_or(n.bit), 0) AS edges FROM k LEFT JOIN (SELECT * FROM n WHERE near IN (SELECT cn FROM k)) n ON n.cn = k.cn GROUP BY k.cn),
      f AS (SELECT {_IN} AS in_degree, {_OUT} AS out_degree FROM e)
      SELECT in_degree, out_degree, count(*) AS n, count(*) FILTER (in_degree > 1 OR out_degree > 1) AS junctions FROM f GROUP BY ALL""",
    "q_noise_repeats": f"{_B('reads')}, {_OCC}, x AS (SELECT DISTINCT cn FROM (SELECT doc_id, cn FROM occ GROUP BY ALL HAVING count(*) > 1)) SELECT cn AS cn_kmer, least(count(*), 65535) AS cov FROM occ WHERE cn NOT IN (SELECT cn FROM x) GROUP BY cn",
    "q_seq_stats": f"{_B('reads')} SELECT doc_id, length(seq) AS n, length({V.hp('seq')}) AS n_compressed, CASE WHEN length(seq) > 0 THEN round({_entropy('seq')}, 6) ELSE 0 END AS entropy, CASE WHEN length(seq) > 0 THEN round({_GC.format('seq')}, 6) ELSE 0 END AS gc, md5({V.rc('seq')}) AS rc_md5 FROM reads",
    "q_color_merge": f"{_B('reads')}, {_OCC}, c AS (SELECT cn, lang, least(count(*), 65535) AS cov, least(count(*) FILTER (fw), 65535) AS cov_fw FROM occ GROUP BY ALL) SELECT cn AS cn_kmer, CAST(sum(cov) AS BIGINT) AS cov, CAST(sum(cov_fw) AS BIGINT) AS cov_fw, string_agg(lang, ',' ORDER BY lang) AS sources FROM c GROUP BY cn",
    "q_features": f"""{_B('reads')}, {_OCC}, {_color_sql('cn')} SELECT cn AS cn_kmer, CAST(long_cov > 0 AS DOUBLE) AS in_long, CAST(short_cov AS DOUBLE) AS short_cov, CASE WHEN short_cov > 0 THEN round(short_fw / short_cov, 6) ELSE 0.5 END AS strand_ratio,
      CAST({SIZE} - length({V.hp('cn')}) AS DOUBLE) AS hp_loss, round({_entropy('cn')}, 6) AS entropy, round({_GC.format('cn')}, 6) AS gc, CAST(truth_cov > 0 AS DOUBLE) AS label FROM c""",
    "q_training_bag": f"{_B('reads')}, {_OCC}, {_color_sql('cn')} SELECT cn AS cn_kmer, CAST(long_cov > 0 AS BIGINT) + CAST(short_cov > 0 AS BIGINT) + CAST(truth_cov > 0 AS BIGINT) AS n FROM c",
    "q_rescue": f"""{_B('reads', 'bait')}, t AS (SELECT doc_id || '_' || start AS tile, substr(seq, start + 1, 100) AS s FROM (SELECT doc_id, seq, unnest(range(0, length(seq), 100)) AS start FROM reads)),
      h AS (SELECT tile, {V.hp('s')} AS hp FROM t), b AS (SELECT {V.hp('seq')} AS hp FROM bait), w AS (SELECT DISTINCT {_CN} AS cn FROM ({V.kmers('b', 'hp', SIZE, 'hp', False).replace('SELECT hp, hp,', 'SELECT hp,')})),
      o AS (SELECT tile, n, {_CN} AS cn FROM (SELECT tile, length(hp) AS n, unnest(list_transform(range(0, length(hp) - {SIZE - 1}), lambda i: substr(hp, i + 1, {SIZE}))) AS kmer FROM h WHERE length(hp) >= {SIZE}))
      SELECT tile, count(*) AS hits, max(n) AS length FROM o WHERE cn IN (SELECT cn FROM w) GROUP BY tile HAVING count(*) / max(n) > 0.7""",
    "q_recruit_distinct": f"""{_B('reads')}, {_occ(7)}, m AS (SELECT DISTINCT doc_id, cn FROM occ WHERE lang <> 'en'), t AS (SELECT doc_id, count(*) AS total FROM m GROUP BY doc_id), l AS (SELECT DISTINCT sample, cn FROM occ WHERE lang = 'en'),
      s AS (SELECT sample, doc_id, count(*) AS shared FROM m JOIN l ON m.cn = l.cn GROUP BY ALL) SELECT sample, s.doc_id, shared, total FROM s JOIN t ON s.doc_id = t.doc_id WHERE shared > floor(total * 0.5)""",
    "q_contig_end_distance": f"{_B('reads')}, o AS (SELECT n, pos, kmer FROM (SELECT length(seq) AS n, unnest(range(0, length(seq) - {SIZE - 1})) AS pos, seq FROM reads WHERE length(seq) >= {SIZE}), LATERAL (SELECT substr(seq, pos + 1, {SIZE}) AS kmer)) SELECT {_CN} AS cn_kmer, CAST(min(least(pos, n - pos - {SIZE})) AS INTEGER) AS distance FROM o GROUP BY 1",
    "q_unique_ref_kmers": f"{_B('bait')} SELECT kmer FROM (SELECT unnest(list_transform(range(0, length(seq) - {SIZE - 1}), lambda i: substr(seq, i + 1, {SIZE}))) AS kmer FROM bait WHERE length(seq) >= {SIZE}) GROUP BY kmer HAVING count(*) = 1",
    "q_shared_pairs": f"""{_B('bait')}, o AS (SELECT DISTINCT item_id, {_CN} AS cn FROM ({V.kmers('bait', 'item_id', 7)})), s AS (SELECT x.item_id AS a, count(*) AS shared FROM o x JOIN o y ON x.cn = y.cn AND y.item_id = x.item_id + 1 GROUP BY 1)
      SELECT item_id AS a, item_id + 1 AS b, coalesce(shared, 0) AS shared FROM bait LEFT JOIN s ON a = item_id""",
    "q_links": f"""{_B('bait')}, g AS (SELECT least(kmer, {V.rc('kmer')}) AS cn, bit_or({_EDGE.replace('WHEN fw', 'WHEN kmer < ' + V.rc('kmer'))}) AS edges FROM ({V.kmers('bait', 'item_id', 5)}) GROUP BY 1),
      b AS (SELECT item_id, TRUE AS fw, seq FROM bait UNION ALL SELECT item_id, FALSE, {V.rc('seq')} FROM bait),
      o AS (SELECT item_id, fw, pos, kmer, after, kmer = cn AS straight, edges FROM ({V.kmers('b', 'item_id, fw', 5)}) JOIN g ON cn = {_CN}),
      p AS (SELECT *, CASE WHEN straight THEN {_OUT} ELSE {_IN} END > 1 AS chooses, CASE WHEN straight THEN {_IN} ELSE {_OUT} END > 1 AS joins, lag(kmer) OVER (PARTITION BY item_id, fw ORDER BY pos) AS back FROM o),
      a AS (SELECT item_id, fw, pos - 1 AS start, back FROM p WHERE joins AND pos > 0),
      j AS (SELECT a.item_id, a.fw, start, a.back, string_agg(after, '' ORDER BY pos) AS junctions FROM a JOIN p ON p.item_id = a.item_id AND p.fw = a.fw AND p.chooses AND p.after <> '' AND p.pos >= start GROUP BY ALL)
      SELECT least(back, {V.rc('back')}) AS anchor_kmer, back = least(back, {V.rc('back')}) AS is_forward, md5(junctions) AS junctions, count(*) AS n FROM j GROUP BY ALL""",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
