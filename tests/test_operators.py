import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import anchors as A
from strandline.operators import haplotypes as H
from strandline.operators import intervals as I
from strandline.operators import kmers as K
from strandline.operators import model as M
from strandline.operators import phasing as P
from strandline.operators import pileup as U
from strandline.operators import typing as T


def _cells(spark, alleles, weights):
    rows = [(0, i, j, None if a == "-" else int(a), w) for i, (line, ws) in enumerate(zip(alleles, weights, strict=True)) for j, (a, w) in enumerate(zip(line, ws, strict=True))]
    return spark.createDataFrame(rows, "locus long, read long, site long, allele int, weight int")


def test_published_phasing_costs():
    alleles = np.array([[0, -1], [1, 0], [1, 1], [-1, 0]])
    weights = np.array([[5, 0], [3, 2], [6, 1], [0, 2]])
    costs = P.partition_costs(alleles[:3, 0], weights[:3, 0])
    assert [costs[0b111], costs[0b011], costs[0b101], costs[0b110]] == [5, 3, 5, 0]
    assert P.solve(alleles, weights)[0] == 1


def test_published_phasing_haplotypes(spark):
    cells = _cells(spark, ["0--01", "100--", "110--", "-001-", "--101", "---01"], [[3, 2, 0, 34, 17], [15, 25, 13, 0, 0], [7, 3, 15, 0, 0], [0, 12, 23, 29, 31], [0, 0, 25, 17, 19], [0, 0, 0, 20, 10]])
    rows = sorted(P.phase(cells).collect(), key=lambda r: r.site)
    assert {"".join(str(r.h1) for r in rows), "".join(str(r.h2) for r in rows)} == {"01101", "10010"}
    assert rows[0].cost == 3


def test_windows_recover_haplotypes(spark):
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, size=40)
    rows = []
    for r in range(30):
        side, a = r % 2, rng.integers(0, 28)
        rows += [(0, r, int(s), int(truth[s] ^ side), 20) for s in range(a, min(a + 14, 40))]
    cells = spark.createDataFrame(rows, "locus long, read long, site long, allele int, weight int")
    haps = P.phase_windows(cells, 16, 4)
    h1 = [r.h1 for r in sorted(haps.collect(), key=lambda r: r.site)]
    sites = sorted({r[2] for r in rows})
    want = [int(truth[s]) for s in sites]
    assert h1 in (want, [1 - x for x in want])
    sides = {r.read: r.haplotype for r in P.assign_reads(cells, haps).collect()}
    assert len({sides[r] for r in range(0, 30, 2)}) == 1 and sides[0] != sides[1]


def test_too_many_reads_are_refused():
    with pytest.raises(ValueError, match="more than"):
        P.solve(np.zeros((16, 1), int), np.ones((16, 1), int))


def test_interval_joins_against_brute_force(spark):
    rng = np.random.default_rng(1)
    make = lambda n, w: [(int(c), i, int(a), int(a + b)) for i, (c, a, b) in enumerate(zip(rng.integers(0, 3, n), rng.integers(0, 5000, n), rng.integers(1, w, n), strict=True))]
    x, y = make(80, 3000), make(60, 900)
    a, b = spark.createDataFrame(x, "contig int, a long, start long, stop long"), spark.createDataFrame(y, "contig int, b long, start long, stop long")
    got = {(r.a, r.b) for r in I.overlap_join(a, b, "a", "b", 256).collect()}
    assert got == {(p[1], q[1]) for p in x for q in y if p[0] == q[0] and p[2] < q[3] and q[2] < p[3]}
    got = {(r.a, r.b) for r in I.containment_join(a, b, "a", "b", 256).collect()}
    assert got == {(p[1], q[1]) for p in x for q in y if p[0] == q[0] and p[2] <= q[2] and p[3] >= q[3]}


def test_reference_pieces(spark):
    refs = spark.createDataFrame([("c", "ACGTACGTTTGGCCAA")], "contig string, seq string")
    chunks = I.chunk_reference(refs, 5)
    loci = spark.createDataFrame([("c", 3, 12, 1), ("c", 0, 5, 2)], "contig string, start long, stop long, id int")
    assert {r.id: r.seq for r in I.reference_bases(chunks, loci, "id", 5).collect()} == {1: "TACGTTTGG", 2: "ACGTA"}


def test_pileup_and_alleles(spark):
    ref = "ACGTACGTACGTACGTACGTACGTACGT"
    aln = spark.createDataFrame([("r1", "c", 2, "3M2I3M", "GTAGGCGT", "IIIIIIII"), ("r2", "c", 4, "2M2D2M", "ACAC", "IIII"), ("r3", "c", 1, "2S4M", "TTCGTT", "IIIIII")], "qname string, contig string, pos long, cigar string, seq string, qual string")
    bases = U.aligned_bases(aln, "qname")
    r1 = {r.pos: r.bases for r in bases.where("qname = 'r1'").collect()}
    assert r1 == {2: "G", 3: "T", 4: "AGG", 5: "C", 6: "G", 7: "T"}
    legacy = {r.pos: r.bases for r in U.aligned_bases(aln, "qname", True).where("qname = 'r1'").collect()}
    assert legacy[4] == "AAG"
    loci = spark.createDataFrame([("c", 3, 7, "L")], "contig string, start long, stop long, locus string")
    assert {r.qname: r.seq for r in U.assemble_pileup(bases, loci, "qname", "locus").collect()} == {"r1": "TAGGCG", "r2": "AC", "r3": "TT"}
    chunks = I.chunk_reference(spark.createDataFrame([("c", ref)], "contig string, seq string"), 10)
    seen = {(r.qname, r.pos): r.allele for r in U.variant_alleles(aln, chunks, "qname", 10).collect()}
    assert seen == {("r1", 5): "GG", ("r2", 5): "--", ("r3", 1): "TT", ("r3", 4): "T"}
    cells = {(r.pos, r.qname): (r.allele, r.qual) for r in U.allele_matrix(aln, loci.withColumn("start", F.lit(0)).withColumn("stop", F.lit(20)), chunks, "qname", "locus", informative=False, chunk=10).collect()}
    assert cells[4, "r1"] == ("A", 40) and cells[4, "r3"] == ("T", 40) and cells[5, "r2"] == ("--", 40)


def test_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.random((300, 6)), columns=M.FEATURES)
    frame["label"] = (frame["short_cov"] + 0.1 * rng.normal(size=300) > 0.5).astype(float)
    rows = spark.createDataFrame(frame)
    model = M.train(rows, 5)
    M.save(model, f"{tmp_path}/m")
    a, b = M.score(rows, model).toPandas(), M.score(rows, M.load(f"{tmp_path}/m")).toPandas()
    assert np.allclose(a["score"], b["score"]) and M.confusion(M.score(rows, model)).first().accuracy > 0.85


def test_anchor_graph(spark):
    ref = "TTGACCATGCAAGTCCGATTACGGATCTTGCAACC"
    reads = spark.createDataFrame([(f"{s}{i}", s, ref) for s in "ab" for i in range(2)], "read string, sample string, seq string")
    refs = spark.createDataFrame([("c", ref)], "contig string, seq string")
    anchors, edges = A.build(reads, refs, 7, "read", 2)
    rows = sorted(anchors.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == [8, 16, 24] and all(ref[r.pos : r.pos + 7] == r.kmer for r in rows)
    steps = {(r.src, r.dst): (r.seq, r.reads, r.samples) for r in edges.collect()}
    assert len(steps) == 4 and all(v[1] == ["a0", "a1", "b0", "b1"] and v[2] == ["a", "b"] for v in steps.values())
    assert "".join(v[0] for _, v in sorted(steps.items(), key=lambda x: ["SOURCE", "Ac_000001", "Ac_000002", "Ac_000003"].index(x[0][0]))) == ref
    chain = {r.name: r.depth for r in A.backbone(A.furthest_next(edges, anchors), "Ac_000001").collect()}
    assert chain == {"Ac_000001": 0, "Ac_000002": 1, "Ac_000003": 2}
    paths = A.series_parallel(edges, spark.createDataFrame([("Ac_000001", "Ac_000003")], "start string, stop string")).collect()
    assert len(paths) == 1 and paths[0].seq == ref[8:24]


def test_anchors_of_two_contigs_keep_apart(spark):
    one, two = "TTGACCATGCAAGTCCGATTACGGATCTTGCAACC", "GGCATTCAGTACCGTTAGACTCCTGAGTTATCGGA"
    refs = spark.createDataFrame([("c", one), ("d", two)], "contig string, seq string")
    reads = spark.createDataFrame([(f"{s}{c}{i}", s, x) for s in "ab" for c, x in (("c", one), ("d", two)) for i in range(2)], "read string, sample string, seq string")
    anchors, edges = A.build(reads, refs, 7, "read", 2)
    names = [r.name for r in anchors.collect()]
    assert len(names) == len(set(names)) == 6
    steps = {(r.src, r.dst): r.reads for r in edges.collect()}
    assert len(steps) == 8 and all({x[1] for x in reads_} == {(src + dst).replace("SOURCE", "").replace("SINK", "")[1]} for (src, dst), reads_ in steps.items())


def test_series_parallel_equals_supported_paths(spark):
    """Random anchor graphs, with cycles and reads that pass an anchor twice, against the paths themselves."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows, ends = [], []
    for g in range(12):
        spine = [f"{g}b{i}" for i in range(3)]
        ends += list(zip(spine, spine[1:], strict=False))
        held = {}
        for r in range(6):
            for x, y in zip(spine, spine[1:], strict=False):
                walk = [x, *rng.choices([f"{x}_{i}" for i in range(4)], k=rng.randint(0, 4)), y]
                for a, b in zip(walk, walk[1:], strict=False):
                    held.setdefault((a, b, rng.choice(["A", "C"])), set()).add(f"{g}r{r}")
        rows += [(a, b, f"{a[-1]}{s}{b[-1]}", sorted(x)) for (a, b, s), x in held.items()]
    edges = spark.createDataFrame(rows, "src string, dst string, seq string, reads array<string>")
    pairs = spark.createDataFrame(ends, "start string, stop string")
    paths = A.supported_paths(edges, pairs).select("start", "stop", "seq", F.explode("reads").alias("r")).groupBy("start", "stop", "seq").agg(F.array_sort(F.collect_set("r")).alias("reads"))
    want = {(r.start, r.stop, r.seq, tuple(r.reads)) for r in paths.collect()}
    assert {(r.src, r.dst, r.seq, tuple(r.reads)) for r in A.series_parallel(edges, pairs).collect()} == want and len(want) > 60


def test_clusters(spark):
    rows = [("g", f"r{i}", f"v{i % 2}{j}") for i in range(8) for j in range(3)] + [("g", "odd", "x")]
    variants = spark.createDataFrame(rows, "g string, read string, v string")
    reads = variants.select("g", "read").distinct()
    labels = {r.read: r.label for r in H.cluster_reads(variants, reads, "g", "read", "v").collect()}
    assert len({labels[f"r{i}"] for i in range(0, 8, 2)}) == 1 and labels["r0"] != labels["r1"] and labels["r0"] >= 0
    d = {(r.a, r.b): r.d2 for r in H.variant_distances(variants, "g", "read", "v").collect()}
    assert d["r0", "r2"] == 0 and ("r0", "r1") not in d


def test_orientation_and_haplotypes(spark):
    seq = "ACGTTGCATGCCGATCTAGGCTTAACGGATC"
    flip = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([("g", 1, seq), ("g", 2, flip[:28]), ("g", 3, flip[2:27]), ("g", 4, seq[3:25])], "g string, read int, seq string")
    assert {r.read: r.forward for r in H.orient_chain(reads, 9, "g", "read").collect()} == {1: True, 2: False, 3: False, 4: True}
    ref = spark.createDataFrame([(1, 10, "ACGTACGT")], "id int, start long, seq string")
    put = spark.createDataFrame([(1, 11, "CTT"), (1, 13, "--")], "id int, pos long, allele string")
    assert H.haplotype_sequence(ref, put, "id").first().seq == "ACTTGTGT"
    msa = spark.createDataFrame([("g", 1, "AACGT"), ("g", 2, "ATCGT"), ("g", 3, "ATCCC")], "g string, read int, seq string")
    assert {(r.site, r.read): r.allele for r in H.msa_sites(msa, "g", "read").collect()} == {(1, 1): "A", (1, 2): "T", (1, 3): "T", (2, 1): "GT", (2, 2): "GT", (2, 3): "CC"}


def test_variant_rows(spark):
    rows = [("c", 5, "A", "", "T", "A"), ("c", 7, "G", "CC", "--", "G"), ("c", 9, "T", "", None, "TAA"), ("c", 11, "C", "", "C", "C")]
    got = {r.pos: (r.ref, r.alts, r.gt) for r in H.variant_rows(spark.createDataFrame(rows, "contig string, pos long, ref string, deleted string, h1 string, h2 string")).collect()}
    assert got == {5: ("A", ["T"], [1, 0]), 7: ("GCC", ["G"], [1, 0]), 9: ("T", ["TAA"], [1, 1])}


def test_typing(spark):
    male = spark.createDataFrame([("s1", 1, "X"), ("s1", 2, "Y"), ("s2", 1, "X"), ("s2", 2, "X"), ("s3", 1, "X"), ("s3", 2, "Y")], "sample string, hap int, repeat string")
    sexes = spark.createDataFrame([("s1", "male"), ("s2", "male"), ("s3", "female")], "sample string, sex string")
    assert sorted((r.sample, r.hap) for r in T.male_rule(male, sexes).collect()) == [("s2", 1), ("s3", 1), ("s3", 2)]
    rows = spark.createDataFrame([("w", 0, "a", 5), ("w", 0, "b", 5), ("w", 10, "b", 1), ("w", 10, "z", 9)], "s string, start int, gene string, mapq int")
    painted = T.paint(rows, ("a", "b"), ["s", "start"])
    lengths = spark.createDataFrame([("w", 25)], "s string, length int")
    assert T.paint_lines(painted, lengths, "s", 10).first().line == "Both z ->"
    assert K.SATURATED == 65_535


def test_low_complexity_and_screen(spark):
    seqs = spark.createDataFrame([(1, "ACGATTGCCATAGCTA" + "A" * 80 + "CGATTGCAGCTAAGCT")], "id long, seq string")
    spans = K.low_complexity(seqs, "id").collect()
    assert len(spans) == 1 and spans[0].start <= 16 and spans[0].stop >= 96
    bait = spark.createDataFrame([("ACGTTGCATGCCGATC",)], "seq string")
    reads = spark.createDataFrame([(1, "ACGTTGCATGCCGATC"), (2, "GATCGGCATGCAACGT"), (3, "TTTTTTTTTTTTTTTT"), (4, "")], "id long, seq string")
    assert {r.id for r in K.screen(reads, bait, 5, 70.0, "id").collect()} == {1, 2}


def test_overlaps_of_intervals_of_any_length(spark):
    """Pairs as by brute force, from single bases to 100 million, negative starts and empty intervals too; two bins an interval at most."""
    import random

    from strandline.operators import intervals as I

    rng = random.Random(8)

    def some(n):
        rows = []
        for i in range(n):
            start = rng.choice([rng.randint(-5_000, 120_000_000), rng.randint(0, 4_000)])
            rows.append((i, rng.choice("cd"), start, start + rng.choice([0, 1, 7, 1_000, 1_001, 8_000, 60_000, 5_000_000, 100_000_000])))
        return rows

    left, right = some(150), some(120)
    a, b = (spark.createDataFrame(x, f"{k} int, contig string, start long, stop long") for k, x in (("x", left), ("y", right)))
    got = [(r.x, r.y, r.contig, r.a_start, r.a_stop, r.b_start, r.b_stop) for r in I.overlap_join(a, b, "x", "y").collect()]
    want = {(i, j, c, s, e, t, f) for i, c, s, e in left for j, d, t, f in right if c == d and s < f and t < e}
    assert len(got) == len(want) > 500 and set(got) == want
    for side, frame, key in (("a", a, "x"), ("b", b, "y")):
        spread = I._binned(I._classed(frame, I.BIN, key, side).withColumnRenamed("_class", "_level"), I.BIN, side)
        assert spread.groupBy(key).count().agg({"count": "max"}).first()[0] <= 2


def test_operations_of_odd_cigars():
    """All CIGARs at once as one by one, with what is no operation left out."""
    import random
    import re

    from strandline.operators import pileup as U

    rng = random.Random(3)
    texts = [None, "", "*", "5M", "M5", "12", "3S10M2I4D1X9=", "10M*3D", "é5M7", "007M", "0M5I", *["".join(rng.choice(["5M", "12I", "3", "D", "100N", "=", "7S", "x"]) for _ in range(6)) for _ in range(200)]]
    want = []
    for r, text in enumerate(texts):
        ref = read = 0
        for i, (n, op) in enumerate(re.findall("([0-9]+)([MIDNSHP=X])", text or "")):
            want.append((r, i, U._KINDS.index(op), int(n), ref, read))
            ref += int(n) * (op in "MDN=X")
            read += int(n) * (op in "MIS=X")
    assert [tuple(map(int, x)) for x in zip(*U._operations(texts), strict=True)] == want
    assert all(len(x) == 0 for x in U._operations([None, ""]))
