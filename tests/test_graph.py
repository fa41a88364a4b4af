import random

from strandline.functions import sequence as S
from strandline.operators import graph as G
from strandline.operators import kmers as K

GENOME = "ACTGATTTCGATGCGATGCGATGCCACGGTGG"
TABLE = """AAATC 1 ..g.A... AATCA 1 a.....G. ACCGT 1 .c....G. ACTGA 1 .......T ATCAG 1 a......T ATCGA 1 .c..A... ATCGC 2 .c..A...
ATGCC 1 ..g.A... ATGCG 2 ..g.A... ATTTC 1 ..g...G. CACCG 1 .c.....T CACGG 1 .c.....T CATCG 3 ..g.AC.. CCACC 1 ......G.
CCACG 1 ..g...G. CGAAA 1 ...t...T GATGC 3 .c...CG. GCCAC 1 ...t..G. TCGAA 1 a...A... TCGCA 2 a......T TGCCA 1 a....C..""".split()


def _genome(spark):
    reads = spark.createDataFrame([(0, GENOME)], "id long, seq string")
    return reads, K.count_kmers(reads, 5, score=True).cache()


def test_kmer_table(spark):
    _, table = _genome(spark)
    got = {(r.cn_kmer, r.cov, r.text) for r in table.select("cn_kmer", "cov", S.edges_text("edges").alias("text")).collect()}
    assert got == {(a, int(b), c) for a, b, c in zip(TABLE[::3], TABLE[1::3], TABLE[2::3], strict=True)}


def test_inferred_edges_equal_observed_on_the_genome(spark):
    _, table = _genome(spark)
    seen = {r.cn_kmer: r.edges for r in table.collect()}
    inferred = {r.cn_kmer: r.edges for r in K.infer_edges(table).collect()}
    assert all(inferred[k] & seen[k] == seen[k] for k in seen)


def test_links(spark):
    reads, table = _genome(spark)
    got = {(r.anchor_kmer, r.is_forward, r.junctions, r.n) for r in K.links(reads, table, 5, "id").collect()}
    want = {("ATGCC", "CCA"), ("ATCGC", "GC"), ("ATCGC", "C"), ("ATGCG", "CA"), ("ATGCG", "A"), ("ATCGA", "GGC")}
    assert got == {(a, False, b, 1) for a, b in want}


def test_neighbours(spark):
    _, table = _genome(spark)
    ask = spark.createDataFrame([(x,) for x in ("TTTCG", "GATGC", "GGTGG", "CGATG", "ACTGA")], "kmer string").withColumn("cn_kmer", S.canonical("kmer")).join(table, "cn_kmer")
    got = {r.kmer: (set(r.n), set(r.p)) for r in ask.select("kmer", S.next_kmers("kmer", "edges").alias("n"), S.previous_kmers("kmer", "edges").alias("p")).collect()}
    assert got["TTTCG"] == ({"TTCGA"}, {"ATTTC"})
    assert got["GATGC"][0] == {"ATGCG", "ATGCC"}
    assert got["GGTGG"][0] == set() and got["ACTGA"][1] == set()
    assert got["CGATG"][1] == {"TCGAT", "GCGAT"}


def test_rooted_traversal(spark):
    _, table = _genome(spark)
    e = G.traverse(table)
    nodes = G.reachable(e, spark.createDataFrame([("ATTTC",)], "node string"))
    back = G.reachable(e.selectExpr("dst as src", "src as dst"), spark.createDataFrame([("ATTTC",)], "node string"))
    whole = nodes.union(back).distinct()
    assert whole.count() == 21
    assert e.join(whole.withColumnRenamed("node", "src"), "src").count() == 21 + 0


def test_assembly_with_links(spark):
    reads, table = _genome(spark)
    links = K.links(reads, table, 5, "id").selectExpr("0 as component", "*")
    seeds = ["ACTGA", "TTCGA", "TGCCA", "GGTGG"]
    rows = spark.createDataFrame([(0, x) for x in seeds] + [(0, G._rc(x)) for x in seeds], "component int, seed string")
    got = {r.seed: r.contig for r in G.assemble(table.selectExpr("0 as component", "*"), links, rows, 5).collect()}
    assert all(got[x] == GENOME for x in seeds)
    assert all(got[G._rc(x)] == G._rc(GENOME) for x in seeds)


def test_bounded_walk(spark):
    reads, table = _genome(spark)
    walker = G.Walker({r.cn_kmer: r.edges for r in table.collect()}, {}, 5)
    assert walker.forward("ACTGA", {"TTCGA"}) == "ACTGATTTCGA"
    assert G._rc(walker.forward(G._rc("GGTGG"), {G._rc("TGCCA")})) == "TGCCACGGTGG"


def test_unitigs_cover_the_graph(spark):
    _, table = _genome(spark)
    m = G.unitigs(table)
    rows = m.collect()
    assert len({r.node for r in rows}) == len(rows) == 42
    seqs = {r.seq for r in G.unitig_table(m, table).collect()}
    assert "ACTGATTTCGAT" in seqs and "ATGCCACGGTGG" in seqs


def test_ring_is_cut_at_its_smallest_kmer(spark):
    ring = "ACGGTCATTG" * 3
    table = K.count_kmers(spark.createDataFrame([(0, ring)], "id long, seq string"), 7, score=True)
    rows = G.unitigs(table).collect()
    assert len({r.unitig for r in rows}) == 2
    assert sorted(r.offset for r in rows) == sorted([*range(10), *range(10)])


def test_superbubbles(spark):
    # a chain of a bubble of two, one of three with a bubble inside, and one of two
    edges = [("s", "a"), ("s", "b"), ("a", "t"), ("b", "t"), ("t", "c"), ("t", "d"), ("c", "e"), ("c", "f"), ("e", "g"), ("f", "g"), ("g", "u"), ("d", "u"), ("u", "x"), ("u", "y"), ("x", "v"), ("y", "v")]
    got = {(frozenset((r.entry, r.exit)), r.interior, r.is_nested) for r in G.superbubbles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {(frozenset("st"), 2, False), (frozenset("tu"), 5, False), (frozenset("uv"), 2, False), (frozenset("cg"), 2, True)}


def test_cleaning_removes_low_scores(spark):
    good = "ACGTTGCATGCCGATCTAGGCTTAACGGATCCTTAGCAGGCATTACGATCAGGT" * 1
    bad = good[:20] + "T" + good[21:]
    reads = spark.createDataFrame([(0, good), (1, bad)], "id long, seq string")
    table = K.count_kmers(reads, 11)
    real = {r.cn_kmer for r in K.count_kmers(reads.where("id = 0"), 11).collect()}
    from pyspark.sql import functions as F

    table = table.withColumn("score", F.when(F.col("cn_kmer").isin(sorted(real)), 1.0).otherwise(0.01)).withColumn("sources", F.array(F.lit("long")))
    left = {r.cn_kmer for r in G.remove_branches(table, 0.1).collect()}
    assert left == real
    fixed = {r.id: r.seq for r in G.correct_reads(reads, table, 11, "id").collect()}
    assert fixed == {0: good, 1: good}


def test_reachable_nodes_of_long_ways_and_rings(spark):
    rng = random.Random(8)
    for trial in range(3):
        n = 60
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(600)] + [(5, 100), (700, 7)]
        pairs += [(1000 + i, 1000 + (i + 1) % 9) for i in range(9)] + [(1004, 1100), (2, 2)] + pairs[:5]
        roots = [5, 2, 5000] if trial else [400]
        want, todo = set(), list(roots)
        while todo:
            x = todo.pop()
            if x not in want:
                want.add(x)
                todo += [b for a, b in pairs if a == x]
        frame = spark.createDataFrame(pairs, "src int, dst int")
        got = [r.node for r in G.reachable(frame, spark.createDataFrame([(x,) for x in [*roots, roots[0], None]], "node int")).collect()]
        assert sorted(got) == sorted(want)
    assert G.reachable(frame.limit(0), spark.createDataFrame([(3,)], "node int")).collect()[0].node == 3
