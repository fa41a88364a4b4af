from pyspark.sql import functions as F

from strandline.operators import pileup as P


def test_digests_stand_for_their_texts(spark):
    reads = spark.createDataFrame([("r", "c", 5, "4M3I6M2D3M", "ACGTACGTACGTACGT", "!!##"), ("bare", "c", 5, "4M2I3M", "ACGTAAACC", None)], "qname string, contig string, pos long, cigar string, seq string, qual string")
    loci = spark.createDataFrame([(f"l{a}-{z}", "c", a, z) for a in range(0, 22, 3) for z in (a, a + 1, a + 7, 40)], "locus string, contig string, start long, stop long")
    plain = P.read_pileup(reads, loci, "qname", "locus", 16)
    wanted = plain.select("locus", "qname", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))
    got = P.read_pileup(reads, loci, "qname", "locus", 16, shown=F.md5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) != []
    # a digest of the whole text is made below the pairs
    assert "md5" in got._jdf.queryExecution().optimizedPlan().toString().split("Generate inline")[1]
