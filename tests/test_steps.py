"""Steps that work where the rows lie: what they make must not grow with depth, copies or batches."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import anchors as A
from strandline.operators import haplotypes as H
from strandline.operators import intervals as I
from strandline.operators import kmers as K


def _reads(spark, n=60, seed=1, letters="ACGT"):
    rng = random.Random(seed)
    rows = [(i, "xyz"[i % 3], "".join(rng.choice(letters) for _ in range(rng.choice([3, 9, 40, 200])))) for i in range(n)]
    # rows that share a key are one read, and so are those without one
    rows += [(7, "x", "ACGTTGCATT"), (7, "x", "GGACGTTGCA"), (None, "y", "TTGACCAGTA"), (None, "z", "ATTGACCAGT"), (900, "x", "ACGNACGTTTACGT")]
    return spark.createDataFrame(rows, "id int, sample string, seq string")


def test_columns_are_cut_out_of_reads_without_joining_bases(spark):
    rows = spark.createDataFrame([(1, 1, "ACGTT"), (1, 2, "ACCTA"), (1, 3, "AC"), (1, 4, None), (2, 5, "AAAA")], "g int, read int, seq string")
    found = H.msa_sites(rows, "g", "read")
    assert {(r.site, r.read, r.allele) for r in found.collect()} == {(1, 1, "G"), (1, 2, "C"), (2, 1, "T"), (2, 2, "A")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.split("\n") if "Join" in x)
    assert "rightHint=(strategy=merge)" in join


@pytest.mark.parametrize("seed", range(3))
def test_semi_overlap_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    one = [(i, rng.randrange(2), a := rng.randrange(5000), a + rng.choice([0, 1, 30, 400])) for i in range(60)]
    two = [(rng.randrange(2), a := rng.randrange(70_000) if rng.random() < 0.2 else rng.randrange(5000), a + rng.choice([0, 1, 9, 60])) for i in range(40)]
    rows = spark.createDataFrame(one + [(99, 0, 6000, 6000)], "k int, contig int, start long, stop long")
    regions = spark.createDataFrame(two + [(0, 5990, 6000), (0, 6000, 6010)], "contig int, start long, stop long")
    got = {r.k for r in I.semi_overlap(rows, regions, "k").collect()}
    assert got == {k for k, c, a, b in one if any(c == d and a < y and x < b for d, x, y in [*two, (0, 5990, 6000), (0, 6000, 6010)])}


def test_semi_overlap_meets_merged_regions(spark, monkeypatch):
    met = []
    join = I.overlap_join
    monkeypatch.setattr(I, "overlap_join", lambda a, b, *more: met.append(b.count()) or join(a, b, *more))
    rows = spark.createDataFrame([(1, 0, 10, 50)], "k int, contig int, start long, stop long")
    deep = spark.range(2000).select(F.lit(0).alias("contig"), (F.col("id") % 20).alias("start"), (F.col("id") % 20 + 25).alias("stop"))
    assert I.semi_overlap(rows, deep, "k").count() == 1 and met == [1]


@pytest.mark.parametrize("held", [5_000_000, 50])
def test_a_task_hands_on_each_kmer_once(spark, monkeypatch, held):
    monkeypatch.setattr(K, "HELD", held)
    read = "ACGTTGCATTGACCAGTACCA"
    tables = [t for _ in range(40) for t in K._count_tables(iter([K.pa.RecordBatch.from_arrays([K.pa.array([read])], ["seq"])]), 5, 0)]
    out = list(K._held(iter(tables), K._COUNT))
    assert sum(int(c[1].sum()) for _, c in out) == 40 * (len(read) - 4)
    assert sum(len(c[0]) for _, c in out) <= 20 and len(out) == 1


def test_noise_equals_repeats_of_each_read(spark, monkeypatch):
    reads = _reads(spark)
    for k in (3, 5, 31):
        want = {r.cn_kmer for r in K.repeated_within(reads, k, "id").collect()}
        for step in (1 << 20, 16):
            monkeypatch.setattr(K, "STEP", step)
            assert {r.cn_kmer for r in K.noise_kmers(reads, k, "id").collect()} == want
    monkeypatch.setattr(K, "LONG", 20)
    assert {r.cn_kmer for r in K.noise_kmers(reads, 5, "id").collect()} == {r.cn_kmer for r in K.repeated_within(reads, 5, "id").collect()}


def test_end_distance_equals_windows(spark):
    reads = _reads(spark)
    for k in (3, 9):
        rows = K.windows_of(reads, k, [])
        want = rows.groupBy(F.least("kmer", "rc").alias("cn_kmer")).agg(F.min(F.least(F.col("pos"), F.col("n") - F.col("pos") - k)).alias("distance"))
        assert {tuple(r) for r in K.end_distance(reads, k).collect()} == {tuple(r) for r in want.collect()}


def test_positions_equal_windows(spark, monkeypatch):
    reads = _reads(spark)
    wanted = K.unique_kmers(reads, 5).union(spark.createDataFrame([("CGNAC",), ("AC",)], "kmer string"))
    want = {tuple(r) for r in K.windows_of(reads, 5, ["id", "sample"]).join(wanted, "kmer", "left_semi").select("kmer", "id", "sample", "pos").collect()}
    for bait in (4_000_000, 3):
        monkeypatch.setattr(A, "BAIT", bait)
        found = A.positions(reads, wanted, 5, "id", ("sample",))
        assert {tuple(r) for r in found.collect()} == want
    shared = {r.kmer for r in A.in_every_sample(A.positions(reads, K.windows_of(reads, 3, []).select("kmer").distinct(), 3, "id", ("sample",)), "id").collect()}
    by: dict = {}
    for r in reads.collect():
        for i in range(len(r.seq) - 2):
            by.setdefault(r.seq[i : i + 3], set()).add((r.sample, r.id))
    assert shared == {x for x, who in by.items() if len({s for s, _ in who}) == 3 and len({i for _, i in who if i is not None}) > 1}


@pytest.mark.parametrize("bait", [4_000_000, 5])
def test_recruits_equal_those_of_joins(spark, monkeypatch, bait):
    monkeypatch.setattr(K, "BAIT", bait)
    shorts = _reads(spark, seed=2)
    longs = _reads(spark, seed=2).where("id % 2 = 0").withColumn("sample", F.when(F.col("sample") != "x", F.col("sample")))
    theirs = K.occurrences(longs, 5, ["sample"]).select("sample", "cn_kmer").distinct()
    want = sorted(map(tuple, K._recruited(shorts.drop("sample"), theirs, 5, "id", ("sample",), "seq").collect()), key=str)
    for step in (1 << 20, 16):
        monkeypatch.setattr(K, "STEP", step)
        assert want and sorted(map(tuple, K.recruit_distinct(shorts.drop("sample"), longs, 5, "id", ("sample",)).collect()), key=str) == want


def test_alleles_are_put_in_at_once(spark):
    ref = spark.createDataFrame([(1, 10, "ACGTACGT"), (2, 0, "AC"), (3, 0, "AC")], "k int, start int, seq string")
    put = spark.createDataFrame([(1, 11, "--"), (1, 12, "T"), (1, 15, "GG"), (1, 15, "AA"), (1, 17, "-"), (1, 9, "TT"), (1, 30, "A"), (2, -1, "--"), (4, 1, "G"), (3, None, "G"), (3, 1, None)], "k int, pos int, allele string")
    found = H.haplotype_sequence(ref, put, "k")
    assert {r.k: r.seq for r in found.collect()} == {1: "ACAAAGGGT", 3: "AC"}
    # nothing has a row a base any more
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
