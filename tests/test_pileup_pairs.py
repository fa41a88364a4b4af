import random

from strandline.operators import pileup as P
from strandline.plans.read_queries import q_pileup


def test_pairs_equal_the_bases_put_together(spark):
    rng = random.Random(8)
    aln = [(f"r{i}", rng.choice("cd"), rng.randint(0, 400), "".join(f"{rng.randint(1, 9)}{rng.choice('MIDNSH=X')}" for _ in range(rng.randint(1, 7)))) for i in range(60)]
    text = lambda letters: "".join(rng.choice(letters) for _ in range(80))
    rows = [(*a, text("ACGT"), text("!#5I")[: rng.choice([80, 80, 7])]) for a in aln]
    rows += [("short", "c", 5, "4M3I6M2D3M", "ACGTA", "!!!!!"), ("bare", "c", 5, "4M2I3M", "ACGTAAACC", None), ("none", "c", 5, None, "ACGT", "!!!!"), ("long", "c", 5, "4M2D2=", "ACGTCC", "!!!!##")]
    reads = spark.createDataFrame(rows, "qname string, contig string, pos long, cigar string, seq string, qual string")
    loci = spark.createDataFrame([(f"l{i}", rng.choice("cd"), a, a + rng.randint(1, 90)) for i, a in enumerate(rng.randint(0, 400) for _ in range(40))] + [("gap", "c", 9, 11)], "locus string, contig string, start long, stop long")
    wanted = P.assemble_pileup(P.aligned_bases(reads, "qname"), loci, "qname", "locus").where("seq <> '' or qual <> ''")
    got = P.read_pileup(reads, loci, "qname", "locus", 64)
    assert sorted(map(str, got.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    assert got.where("locus = 'gap' and qname = 'long'").isEmpty()


def test_pairs_are_not_grouped(spark):
    plan = q_pileup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
