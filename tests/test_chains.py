"""Co-assembly, correction by file and window, staging, typing from sites, and small functions."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import anchors as A
from strandline.operators import coassembly as C
from strandline.operators import haplotypes as H
from strandline.operators import intervals as I
from strandline.operators import kmers as K
from strandline.operators import model as M
from strandline.operators import phasing as P
from strandline.operators import pileup as U
from strandline.operators import typing as T
from strandline.operators.staging import stage
from strandline.sources import writers as W

K_SIZE = 15


@pytest.fixture(autouse=True)
def small_plans(spark):
    """One job a step: these chains are many steps over few rows."""
    small = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def _genome(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def _flip(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _put(s, at, base):
    return s[:at] + (base if s[at] != base else "ACGT"[("ACGT".index(base) + 1) % 4]) + s[at + 1 :]


def _model(spark, g, longs, shorts):
    parts = [K.count_kmers(x, K_SIZE).withColumn("color", F.lit(c)) for c, x in (("long", longs), ("short", shorts), ("truth", spark.createDataFrame([(1, g)], "id int, seq string")))]
    return M.train(K.features(K.color_table(parts[0].union(parts[1]).union(parts[2]), ("long", "short", "truth"))), 40)


def test_correction_by_file_and_by_window(spark):
    g = _genome(21, 240)
    wrong = {1: _put(g, 120, "A"), 2: _flip(_put(g, 60, "C")), 3: g}
    longs = spark.createDataFrame(list(wrong.items()), "id int, seq string").cache()
    shorts = spark.createDataFrame([(i, g[a : a + 60] if i % 2 else _flip(g[a : a + 60])) for i, a in enumerate([*range(0, 181, 12)] * 3)], "s int, seq string").cache()
    model = _model(spark, g, longs, shorts)
    got = {r.id: r for r in C.correct_file(longs, shorts, K_SIZE, "id", model, None).collect()}
    assert {i: r.seq for i, r in got.items()} == {1: g, 2: _flip(g), 3: g} and [got[i].replaced for i in (1, 2, 3)] == [1, 1, 0]
    assert all(len(r.qual) == len(g) for r in got.values())
    far = spark.createDataFrame([(99, _genome(22, 60))], "s int, seq string")
    pieces = spark.createDataFrame([("l", t, f"r{i}", s[a:z]) for i, s in ((1, wrong[1]), (3, g)) for t, (a, z) in enumerate(((0, 90), (90, 240)))], "locus string, tile int, read string, seq string")
    rows = C.correct_windows(pieces, shorts.union(far), K_SIZE, "s", model, None).collect()
    assert {r.read: (r.seq, r.replaced) for r in rows} == {"r1": (g, 1), "r3": (g, 0)} and all(len(r.qual) == len(g) for r in rows)


def test_co_assembly_tells_two_haplotypes_apart(spark):
    one = _genome(12, 120)
    two = _put(_put(one, 40, "A"), 80, "A")
    longs = spark.createDataFrame([("l", i, (one, two)[i % 2]) for i in range(4)], "locus string, id int, seq string")
    got = {r.haplotype: r.seq for r in C.co_assemble(longs, longs, K_SIZE, "id", threshold=None, least=50).collect()}
    assert set(got) == {1, 2} and set(got.values()) == {one, two}


def test_staging_of_all_files_at_all_loci(spark):
    ref = _genome(23, 60)
    rows = [
        ("r|1", "c", 10, "20M", ref[10:30], "I" * 20, False, False, "s1", {"HP": "1"}, False),
        ("r2", "c", 12, "10M", ref[12:22], "I" * 10, False, True, "s2", {"HP": "2"}, True),
        ("un", None, None, "*", "ACGT", "IIII", False, False, "s1", {}, False),
    ]
    kinds = "qname string, contig string, pos long, cigar string, seq string, qual string, is_secondary boolean, is_supplementary boolean, sample string, tags map<string,string>, is_reverse boolean"
    aln = spark.createDataFrame(rows, kinds)
    loci = spark.createDataFrame([("c", 15, 20, "a"), ("c", 40, 50, "b"), ("c", 28, 33, "e")], "contig string, start long, stop long, name string")
    refs = spark.createDataFrame([("f1", "c", ref), ("f2", "c", ref[:35])], "source string, contig string, seq string")
    got = {r.id: (r.seq, r.qual) for r in stage(loci, aln, chunk=7).collect()}
    assert got == {"r|1|a|s1|false|false": (ref[15:20], "IIIII"), "r2|a|s2|false|true": (ref[15:20], "IIIII"), "r|1|e|s1|false|false": (ref[28:30], "II")}
    assert {r.id for r in stage(loci, aln, haplotype="2").collect()} == {"r2|a|s2|false|true"}
    both = {r.id: r.seq for r in stage(loci, references=refs, chunk=7).collect()}
    assert both == {"c:15-20|a|f1": ref[15:20], "c:40-50|b|f1": ref[40:50], "c:28-33|e|f1": ref[28:33], "c:15-20|a|f2": ref[15:20], "c:28-33|e|f2": ref[28:33]}


def test_typing_from_sites(spark):
    star = "ACGTACGTACGGTTACGATT"
    good, bad = star, star[:9] + "T" + star[10:]
    stars = spark.createDataFrame([("x1", star)], "allele string, seq string")
    haps = spark.createDataFrame([("h1", good), ("h2", bad)], "hap string, seq string")
    aln = spark.createDataFrame([("h1", "x1", 0, "20M"), ("h2", "x1", 0, "20M")], "hap string, allele string, pos long, cigar string")
    sites = T.site_definitions(spark.createDataFrame([("x1", 4, "G", "A"), ("x1", 9, "G", "C")], "allele string, pos int, ref string, alt string"))
    matches = T.site_matches(sites, T.aligned_pairs(aln, ["hap", "allele"]), haps, stars)
    counts = T.count_sites(matches, sites)
    assert {r.hap: (r.matched, r.total, r.fraction) for r in counts.collect()} == {"h1": (2, 2, 1.0), "h2": (1, 2, 0.5)}
    genome = spark.createDataFrame([("h1", "x1"), ("h2", "x1"), ("h2", "none")], "hap string, allele string")
    calls = T.final_allele(T.best_with_ties(counts, ["hap"], "fraction"), genome, "none")
    assert {(r.hap, r.call, r.sites) for r in T.call_report(calls, counts).collect()} == {("h1", "x1", "2/2"), ("h2", "none", None)}


def _script_matches(site, star, place, segment, context):
    """A site's test in words: the changed bases, or all bases around an insertion or deletion, as far as sequences go."""
    pos, ref, alt = site
    if len(ref) == len(alt):
        return segment[place : place + len(alt)] == alt
    window = lambda s, p: s[max(0, p - context) : p + len(alt) + context]
    return window(segment, place) == window(star, pos)


def test_sites_by_alt_and_by_aligned_segment(spark):
    rng = random.Random(31)
    star = _genome(30, 60)
    # the allele lacks its own alt at 10; 3 and 57 lie near its ends; 30 and 40 change length
    sites = [(10, star[10], "ACGT"[("ACGT".index(star[10]) + 1) % 4]), (20, "A", star[20]), (3, star[3] + "T", star[3]), (30, star[30], star[30:32]), (40, star[40:42], star[40]), (57, star[57], star[57:59])]
    haps, rows = {}, []
    for h in range(30):
        start, stop = rng.choice([(0, 60), (0, 60), (2, 60), (0, 59)])
        lead, body = _genome(h + 40, rng.choice([0, 4, 30])), star[start:stop]
        for at in rng.sample([10, 20, 3, 5, 30, 31, 45, 57, 58], rng.choice([0, 1, 2])):
            if start <= at < stop:
                body = _put(body, at - start, rng.choice("ACGT"))
        haps[f"h{h}"] = (lead + body + _genome(h + 90, rng.choice([0, 25])), len(lead), start, stop)
        rows.append((f"h{h}", "x", len(lead), (f"{start}S" if start else "") + f"{stop - start}=" + (f"{60 - stop}S" if stop < 60 else ""), h))
    want = set()
    for h, (seq, lead, start, stop) in haps.items():
        want |= {(h, *s) for s in sites if start <= s[0] < stop and _script_matches(s, star, s[0] - start, seq[lead : lead + stop - start], 20)}
    aln = spark.createDataFrame([*rows, ("h0", "x", *rows[0][2:4], 99)], "hap string, allele string, pos int, cigar string, o int")
    defined = spark.createDataFrame([("x", *s, 0) for s in sites], "allele string, pos int, ref string, alt string, offset int")
    got = T.site_matches(defined, T.star_pairs(aln, "o"), spark.createDataFrame([(h, x[0]) for h, x in haps.items()], "hap string, seq string"), spark.createDataFrame([("x", star)], "allele string, seq string"))
    found = {(r.hap, r.pos, r.ref, r.alt) for r in got.collect()}
    assert found == want | {("h0_2", *x[1:]) for x in want if x[0] == "h0"}
    assert len({x[1] for x in want}) >= 4 and any(x[1] == 3 for x in want)


def test_genomic_matches(spark):
    rows = [("x1", "h1", "100=", "7000", 1), ("x2", "h1", "90=10X", "7000", 2), ("x3", "h1", "200=", "10", 3), ("x1", "h1", "50=", "8000", 4), ("x1", "h2", "9=", "9000", 5), ("x4", "h1", "300=", None, 6)]
    aln = spark.createDataFrame([(q, c, g, {"AS": s} if s else {}, o) for q, c, g, s, o in rows], "qname string, contig string, cigar string, tags map<string,string>, o int")
    assert {(r.hap, r.allele, r.score) for r in T.genomic_best(aln, "o", haps=["h2"]).collect()} == {("h1", "x1", 100), ("h1_2", "x1", 50)}


def test_repeat_reports(spark):
    table = spark.createDataFrame([("a", 3, 2, {"GTC": 1}), ("b", 3, 1, {"GTC": 2, "AA": 1}), ("c", 5, 1, {})], "repeat string, n_repeats int, n_haps int, interruptions map<string,int>")
    assert {(r.n_repeats, r.haps) for r in T.repeat_histogram(table).collect()} == {(3, 3), (5, 1)}
    assert {(r.interruption, r.n) for r in T.interruption_totals(table).collect()} == {("GTC", 4), ("AA", 1)}
    made = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s3")], "repeat string, sample string")
    called = spark.createDataFrame([("a", "s2"), ("b", "s1")], "repeat string, sample string")
    checked = T.concordance(made, called)
    assert {(r.repeat, r.n_haps, r.confirmed) for r in checked.collect()} == {("a", 2, True), ("b", 1, False)}
    assert tuple(T.concordance_counts(checked).first()) == (1, 1, 0, 1)
    records = spark.createDataFrame([("s", 1, "gene_b", "C", 2), ("s", 1, "gene_a", "A", 1), ("s", 2, "other", "T", 1)], "sample string, hap int, name string, seq string, ord int")
    assert [tuple(r) for r in T.combine_haplotypes(records, "gene").collect()] == [("s", 1, "A")]
    scored = spark.createDataFrame([("g", 0.9), ("g", 0.5), ("g", 0.4), ("k", 0.3), ("k", 0.2)], "g string, v double")
    assert sorted(tuple(r) for r in T.score_paths_keep(scored, ["g"], "v", 0.4).collect()) == [("g", 0.5), ("g", 0.9), ("k", 0.3)]


def test_reads_go_to_haplotypes(spark):
    haps = spark.createDataFrame([(0, 1, 0, 1), (0, 2, 1, 0), (0, 3, 1, 1)], "locus long, site long, h1 int, h2 int")
    rows = {1: (0, 1, 1), 2: (1, 0, 1), 3: (0, 0, 0), 4: (0, None, 1), 5: (None, None, 1)}
    cells = spark.createDataFrame([(0, r, s + 1, a) for r, x in rows.items() for s, a in enumerate(x)], "locus long, read int, site long, allele int")
    assert {r.read: (r.haplotype, r.p1, r.p2) for r in P.assign_by_sites(cells, haps).collect()} == {1: (1, 2, 0), 2: (2, 0, 2)}
    assert {r.read: r.haplotype for r in P.assign_by_identity(cells, haps).collect()} == {1: 1, 2: 2, 4: 1, 5: 2}


def test_variant_filters(spark):
    kinds = "locus string, pos int, h1 string, h2 string, before string, after string"
    rows = [("l", 1, None, None, "A", "C"), ("l", 2, "A" * 200, None, "A", "C"), ("l", 3, None, "A" * 150, "A", "C"), ("l", 4, "GA", None, "A", "C"), ("l", 5, "GT", None, "A", "C"), ("l", 6, "T", "C", "A", "C"), ("m", 7, "A" * 150, None, "A", "C")]
    assert {r.pos for r in H.clean_variants(spark.createDataFrame(rows, kinds)).collect()} == {2, 5, 6, 7}
    ops = spark.createDataFrame([("X", 1), ("I", 5), ("D", 6), ("=", 90)], "op string, len int")
    assert {(r.op, r.len) for r in H.large_variants(ops).collect()} == {("X", 1), ("D", 6)}


def test_anchor_graph_pieces(spark):
    edges = spark.createDataFrame([("a", "b", "AC", ["r1", "r2"]), ("a", "b", "AG", ["r3"]), ("b", "c", "TT", ["r1"])], "src string, dst string, seq string, reads array<string>")
    assert {r.read for r in A.edge_reads(edges).collect()} == {"r1", "r2", "r3"}
    picks = spark.createDataFrame([("r1", "a", 1), ("r3", "a", 1), ("r1", "b", 0), ("r9", "b", 4)], "read string, src string, index int")
    assert {(r.src, r.seq, tuple(r.reads), tuple(r.samples)) for r in A.single_sample(edges, picks, "s").collect()} == {("a", "AG", ("r1", "r3"), ("s",)), ("b", "TT", ("r1",), ("s",))}
    paths = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["y"])], "p int, path array<string>")
    pieces = spark.createDataFrame([("x", "AC"), ("y", "G")], "name string, seq string")
    assert {r.p: r.seq for r in A.path_sequence(paths, pieces, "p").collect()} == {1: "ACGAC", 2: "G"}


def test_small_functions(spark):
    row = spark.createDataFrame([("AACGT", "2S3M", "chr1:5-9|g", [0, 40])], "seq string, cigar string, locus string, quals array<int>")
    got = row.select(
        U.trim_clips("seq", "cigar", F.lit(False)).alias("fw"),
        U.trim_clips("seq", F.lit("1S3M1S"), F.lit(True)).alias("rc"),
        S.phred_text("quals").alias("phred"),
        S.score_quality(F.lit(0.0), F.lit(3)).alias("best"),
        S.score_quality(F.log(F.lit(1e-300)), F.lit(1)).alias("worst"),
        F.array(S.path_quality(F.lit(1.0)), S.path_quality(F.lit(0.9)), S.path_quality(F.lit(0.0))).alias("pq"),
        S.link_complement(F.lit("ACG")).alias("lc"),
        S.link_text(F.lit(True), F.lit("AC")).alias("lt"),
        S.bed_line(S.parse_locus("locus")).alias("bed"),
        S.renamed(F.lit("n"), F.lit("s")).alias("renamed"),
        S.edit_distance(F.lit("ACGT"), F.lit("AGT")).alias("ed"),
        S.ungapped(F.lit("A--C-")).alias("gapless"),
        # two out-edges on the canonical strand, one in-edge
        F.array(S.junction_ahead(F.lit("AAC"), F.lit(16 + 32 + 1)), S.junction_ahead(F.lit("GTT"), F.lit(16 + 32 + 1))).alias("ahead"),
    ).first()
    assert (got.fw, got.rc, got.phred, got.best, got.worst) == ("CGT", "CGT", "!I", "I", "!")
    assert got.pq[0] == 60 and got.pq[1] in (9, 10) and got.pq[2] == 0
    assert (got.lc, got.lt, got.bed, got.renamed, got.ed, got.gapless) == ("TGC", "F AC", "chr1\t5\t9\tg", "s|n", 1, "AC")
    assert got.ahead == [True, False]


def test_primary_and_order_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", False, False), ("b", True, False), ("c", False, True)], "q string, is_secondary boolean, is_supplementary boolean")
    assert [r.q for r in U.primary(rows).collect()] == ["a"]
    spots = spark.createDataFrame([("c2", 5), ("c1", 9), ("c1", 2)], "contig string, pos int")
    assert [tuple(r) for r in I.coordinate_sort(spots).collect()] == [("c1", 2), ("c1", 9), ("c2", 5)]
    W.report(spots.coalesce(1), f"{tmp_path}/r")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/r").collect())[-1] == "contig\tpos"
    kmers = spark.createDataFrame([("AAC", ["x"], 0.5, 7)], "cn_kmer string, sources array<string>, score double, cov int")
    W.node_table(spark.createDataFrame([("n1", "GTT")], "id string, seq string"), kmers, f"{tmp_path}/n")
    row = spark.read.csv(f"{tmp_path}/n", header=True).first()
    assert (row.node, row.label, row.kmer, row.coverage) == ("n1", "x (0.5)", "AAC", "7")
