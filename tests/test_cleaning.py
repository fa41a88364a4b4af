"""Cleaning, correction, bubbles and co-assembly on small random genomes."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import coassembly as C
from strandline.operators import graph as G
from strandline.operators import kmers as K

K_SIZE = 15


def _genome(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def _flip(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _put(s, at, base):
    return s[:at] + (base if s[at] != base else "ACGT"[("ACGT".index(base) + 1) % 4]) + s[at + 1 :]


def _kmers(s, k=K_SIZE):
    return {min(s[i : i + k], _flip(s[i : i + k])) for i in range(len(s) - k + 1)}


def _table(spark, seqs, real, color="long"):
    t = K.count_kmers(spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, seq string"), K_SIZE)
    good = F.col("cn_kmer").isin(sorted(real))
    t = t.withColumn("score", F.when(good, 1.0).otherwise(0.01))
    return t.withColumn("sources", F.when(good, F.array(F.lit("long"), F.lit("short"))).otherwise(F.array(F.lit(color)))).cache()


def _left(t):
    return {r.cn_kmer for r in t.collect()}


def test_tips_short_contigs_and_colors(spark):
    g = _genome(1, 300)
    real = _kmers(g)
    tip = g[100:130] + _genome(2, 12)
    alone = _genome(3, 60)
    t = _table(spark, [g, tip, alone], real, "short")
    assert _left(G.remove_short(t, K_SIZE)) == real | _kmers(tip)
    assert _left(G.remove_tips(t, K_SIZE, 0.1, strict=False)) == real | _kmers(alone)
    assert _left(G.remove_tips(t, K_SIZE, 0.1)) == _left(t)
    assert _left(G.remove_color_paths(t, "short", 0.1)) == real
    assert _left(G.remove_color_paths(t, "long", 0.1)) == _left(t)


def test_tangles_go_from_their_seeds(spark):
    core = _genome(4, K_SIZE)
    ways = [_genome(s, 40) + x + core + y + _genome(s + 20, 40) for s, x, y in ((5, "A", "G"), (6, "C", "T"))]
    g = _genome(7, 300)
    t = _table(spark, [g, *ways], _kmers(g), "short")
    # the branching k-mer and its neighbours go; k-mers that are low are not passed, so the ways' far ends stay
    left = _left(G.remove_tangles(t, "short", 0.1))
    assert _kmers(g) <= left < _left(t) and not _kmers(core) & left and _kmers(ways[0][:40]) <= left


def test_bubbles_also_nested_ones(spark):
    g = _genome(8, 300)
    one, two = _put(g, 100, "A"), _put(_put(g, 200, "C"), 208, "G")
    inner = _put(g, 208, "G")
    real = _kmers(g)
    t = _table(spark, [g, one, two, inner], real, "short")
    m = G.unitigs(t)
    pairs = G.superbubbles(G.unitig_edges(t, m)).collect()
    assert len(pairs) == 4 and {r.interior for r in pairs} > {2}
    assert _left(G.remove_bubbles(t, "short", 0.1)) == real


def test_the_cleaning_chain(spark):
    g = _genome(8, 200)
    t = _table(spark, [g, _put(g, 100, "A"), g[100:130] + _genome(2, 12)], _kmers(g), "short")
    assert _left(G.clean(t, K_SIZE, 0.1)) == _kmers(g)


def test_paths_are_ranked_and_supported(spark):
    g = _genome(8, 300)
    one = _put(g, 100, "A")
    t = _table(spark, [g, one], _kmers(g))
    m = G.unitigs(t)
    found, inside = G.bubbles(G.unitig_edges(t, m))
    best = G.best_paths(t, m, found, inside)
    rows = G.path_nodes(best, m)
    whole = rows.groupBy("entry", "exit", "place").agg(F.array_sort(F.collect_list(F.struct("step", "offset", "node"))).alias("x")).select(F.concat_ws(" ", "entry", "place").alias("path_id"), "place", F.transform("x", lambda x: x["node"]).alias("path"))
    seqs = {(r.place, r.seq) for r in whole.select("place", S.contig_of_path("path").alias("seq")).collect()}
    # 15 k-mers differ, and with both ends a path is 17 k-mers, on either strand
    want = {(i + 1, x[100 - K_SIZE : 100 + K_SIZE + 1]) for i, x in enumerate((g, one))}
    assert seqs == want | {(i, _flip(x)) for i, x in want} and {r.n for r in best.collect()} == {17}
    ranked = G.rank_paths(whole.select(F.lit("s").alias("start"), F.lit("e").alias("stop"), "path"), t.select("cn_kmer", "score"), 1).collect()
    assert len(ranked) == 1 and ranked[0].value == 1.0
    reads = spark.createDataFrame([(1, g), (2, one), (3, g[:50])], "id int, seq string")
    support = G.path_support(whole, K.occurrences(reads, K_SIZE, ["id"]), "id").collect()
    assert sorted(r.id for r in support) == [1, 1, 2, 2]


def test_correction_of_several_errors(spark):
    g = _genome(9, 400)
    snp = _put(g, 60, "T")
    reads = {
        1: g,
        2: _put(_put(_put(g, 150, "A"), 156, "C"), 171, "G"),
        3: g[:220] + g[221:],
        4: _flip(g[:310] + "A" + g[310:]),
        5: _put(snp, 250, "T"),
        6: g[100:110],
        7: _put(g, 3, "A"),
        8: g[:300] + _genome(10, 90) + g[330:],
    }
    frame = spark.createDataFrame(list(reads.items()), "id int, seq string")
    table = K.count_kmers(spark.createDataFrame([(1, g), (2, snp)], "id int, seq string"), K_SIZE, score=True)
    got = {r.id: (r.seq, r.replaced) for r in G.correct_reads(frame, table, K_SIZE, "id").collect()}
    assert got[1] == (g, 0) and got[2][0] == g and got[2][1] == 1 and got[3] == (g, 1) and got[4] == (_flip(g), 1)
    assert got[5] == (snp, 1) and got[6] == (g[100:110], 0) and got[7] == (reads[7], 0) and got[8] == (g, 1)


def test_assembly_at_bubbles(spark):
    g = _genome(11, 200)
    one = _put(g, 100, "A")
    reads = spark.createDataFrame([(1, g), (2, one)], "id int, seq string")
    t = K.count_kmers(reads, K_SIZE, score=True)
    got = {r.contig for r in G.assemble_at_bubbles(t, K.links(reads, t, K_SIZE, "id"), K_SIZE).collect()}
    assert got == {min(x, _flip(x)) for x in (g, one)}


def test_reads_take_the_paths_of_bubbles(spark):
    one = _genome(12, 300)
    two = _put(_put(one, 90, "A"), 200, "A")
    longs = spark.createDataFrame([(i, (one, two)[i % 2]) for i in range(4)], "id int, seq string")
    cells = C.bubble_matrix(longs, C.scored_graph(longs, longs, K_SIZE, threshold=None), K_SIZE, "id").collect()
    got = {(r.read, r.site): r.allele for r in cells}
    assert len(got) == len(cells) == 8 and {r.weight for r in cells} == {60}
    assert all(got[0, s] == got[2, s] != got[1, s] == got[3, s] for s in (0, 1))


def test_qualities_follow_scores(spark):
    one = _genome(12, 200)
    table = _table(spark, [one], _kmers(one))
    reads = spark.createDataFrame([(0, one), (9, _put(one, 100, "C"))], "id int, seq string")
    quals = {r.id: r.qual for r in C.score_qualities(reads, table, K_SIZE, ["id"]).collect()}
    assert all(len(q) == 200 for q in quals.values()) and quals[9][100] == "!" and quals[0][100] > "!"


def test_numbers_and_texts_count_alike(spark):
    rng = random.Random(3)
    reads = spark.createDataFrame([(i, "xy"[i % 2], "".join(rng.choice("ACGT" if i else "A") for _ in range(rng.choice([5, 6, 40, 90])))) for i in range(40)] + [(99, "x", "ACGNACGTTT"), (100, None, "ACGTTGCAACGT")], "id int, g string, seq string")
    for k in (1, 5, 8, 31):
        o = K.occurrences(reads, k, ["g"])
        want = {(r.g, r.cn_kmer, r.n, r.f, r.e) for r in o.groupBy("g", "cn_kmer").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_fw").alias("f"), F.bit_or(S.edge_bits(F.col("before"), F.col("after"), F.col("is_fw"))).alias("e")).collect()}
        assert {(r.g, r.cn_kmer, r.cov, r.cov_fw, r.edges) for r in K.count_kmers(reads, k, ("g",)).collect()} == want
        assert K.count_kmers(reads, k).agg(F.sum("cov")).first()[0] == o.count()


def test_batches_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(K, "STEP", 7)
    frame = spark.createDataFrame([(1, _genome(5, 60)), (2, _genome(6, 33))], "id int, seq string").toPandas()
    parts = [r for p in K._batch_counts(frame, 5, [], "seq") for r in p.itertuples(index=False)]
    monkeypatch.setattr(K, "STEP", 1 << 20)
    whole = [r for p in K._batch_counts(frame, 5, [], "seq") for r in p.itertuples(index=False)]

    def total(rows):
        out = {}
        for r in rows:
            n, fw, e = out.get(r.kmer, (0, 0, 0))
            out[r.kmer] = (n + r.n, fw + r.fw, e | r.edges)
        return out

    assert total(parts) == total(whole)


def test_screens_by_number_and_by_join_agree(spark, monkeypatch):
    rng = random.Random(4)
    bait = spark.createDataFrame([(_genome(7, 300),)], "seq string")
    text = bait.first().seq
    rows = [(i, text[a : a + 60]) for i, a in enumerate(range(0, 240, 30))] + [(50 + i, "".join(rng.choice("ACGT") for _ in range(60))) for i in range(8)] + [(90, ""), (91, text[:30] + "N" + text[31:60])]
    reads = spark.createDataFrame(rows, "id int, seq string")
    got = {(r.id, r.hits, r.length) for r in K.screen(reads, bait, 7, 30.0, "id").collect()}
    monkeypatch.setattr(K, "BAIT", 10)
    assert got == {(r.id, r.hits, r.length) for r in K.screen(reads, bait, 7, 30.0, "id").collect()} and len(got) >= 8
    assert 91 in {x[0] for x in got}
    kept = K.screen(reads.withColumn("lane", F.col("id") % 2), bait, 7, 30.0, "id", keep=(F.col("lane") == 0) & (F.col("hits") > 1)).collect()
    assert {r.id for r in kept} == {x[0] for x in got if x[0] % 2 == 0 and x[1] > 1}


def _dust(s, window=64, limit=2.0):
    def value(i, j):
        t = [s[x : x + 3] for x in range(i, j - 2)]
        return sum(t.count(x) * (t.count(x) - 1) / 2 for x in set(t)) / (len(t) - 1) if len(t) > 1 else 0.0

    n = len(s)
    scores = {(i, j): value(i, j) for i in range(n) for j in range(i + 3, min(i + window, n) + 1)}
    return {(i, j) for (i, j), v in scores.items() if v > limit and all(v >= scores[x, y] for x in range(i, j - 2) for y in range(x + 3, j + 1))}


def test_low_complexity_stretches_against_enumeration(spark):
    rng = random.Random(6)
    for text in ["A" * 30, "ACGACGACGACGACGTTTTTTTTTAC", "".join(rng.choice("AC") for _ in range(45)), "".join(rng.choice("ACGT") for _ in range(45)), "", "AC", "ACG"]:
        assert set(K.dust_spans(text, 24, 1.5)) == _dust(text, 24, 1.5)
    long = _genome(13, 150) + "AC" * 40 + _genome(14, 150) + "T" * 20 + _genome(15, 60)
    frame = spark.createDataFrame([(1, long), (2, "")], "id int, seq string")
    whole = {(r.id, r.start, r.stop) for r in K.low_complexity(frame, "id").collect()}
    assert whole == {(r.id, r.start, r.stop) for r in K.low_complexity(frame, "id", piece=40).collect()} and len(whole) >= 2


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    from strandline.operators.lineage import components

    rng = random.Random(seed)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(200, 700)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in components(spark.createDataFrame(pairs, "src int, dst int")).collect()} == {x: root(x) for x in parent}
