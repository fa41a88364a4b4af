import gzip
import random

from strandline.sources import readers as R
from strandline.sources import writers as W


def test_fasta_and_fastq_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ACGT", "IIII"), ("b", "GG", None), ("c", "", "")], "id string, seq string, qual string")
    W.fasta(rows, f"{tmp_path}/fa", compression="gzip")
    assert {(r.id, r.seq) for r in R.fasta(spark, f"{tmp_path}/fa").collect()} == {("a", "ACGT"), ("b", "GG")}
    W.fastq(rows, f"{tmp_path}/fq")
    assert {(r.id, r.seq, r.qual) for r in R.fastq(spark, f"{tmp_path}/fq").collect()} == {("a", "ACGT", "IIII"), ("b", "GG", "??")}
    (tmp_path / "x.fa").write_text(">one first\nAC\nGT\n>two\nTT\n")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/x.fa\n\n{tmp_path}/x.fa\n")
    with gzip.open(tmp_path / "y.fq.gz", "wt") as f:
        f.write("@q1 d\nACG\n+\n@II\n")
    paths = [*R.expand_paths(spark, [f"{tmp_path}/list.txt"]), f"{tmp_path}/y.fq.gz"]
    assert {(r.id, r.description, r.seq, r.qual) for r in R.sequences(spark, paths).collect()} == {("one", "first", "ACGT", None), ("two", "", "TT", None), ("q1", "d", "ACG", "@II")}


def test_fasta_headers_hold_signs(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 has A>G change\nACGT\n>s2>x\r\nAC\r\nGG\r\n\n>s3\n>s4 >\nTT")
    want = {("s1", "has A>G change", "ACGT"), ("s2>x", "", "ACGG"), ("s3", "", ""), ("s4", ">", "TT")}
    assert {(r.id, r.description, r.seq) for r in R.fasta(spark, f"{tmp_path}/a.fa").collect()} == want
    assert {(r.id, r.seq) for r in R.sequences(spark, [f"{tmp_path}/a.fa"]).collect()} == {(a, c) for a, _, c in want}


def test_fasta_is_split_between_records(spark, tmp_path):
    records = {f"r{i}": "ACGT" * (i % 50) for i in range(400)}
    (tmp_path / "a.fa").write_text("".join(f">{n} a>b\n{s}\n" for n, s in records.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = R.fasta(spark, f"{tmp_path}/a.fa")
        assert rows.rdd.getNumPartitions() > 4 and {r.id: r.seq for r in rows.collect()} == records
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pairs(spark, tmp_path):
    rows = spark.createDataFrame([("p", False, "ACG", "ABC"), ("p", True, "AAC", "XYZ"), ("lone", False, "A", "I")], "qname string, is_reverse boolean, seq string, qual string")
    assert W.paired_fastq(rows, f"{tmp_path}/p") == 1
    assert {(r.seq, r.qual) for r in R.fastq(spark, f"{tmp_path}/p").collect()} == {("ACG", "ABC"), ("GTT", "ZYX")}


def test_loci(spark, tmp_path):
    (tmp_path / "l.bed").write_text("# note\nchr2\t5\t9\tgene\nchr1\t1\t2\n")
    rows = R.loci(spark, ["chr1:10-20", f"{tmp_path}/l.bed", "chr1:10-20"]).collect()
    assert [(r.contig, r.start, r.stop, r.name) for r in rows] == [("chr1", 10, 20, "chr1:10-20"), ("chr2", 5, 9, "gene"), ("chr1", 1, 2, "chr1:1-2")]


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:c\tLN:9\nr1\t16\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tHP:i:1\tRG:Z:g\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    rows = {r.qname: r for r in R.sam(spark, f"{tmp_path}/a.sam").collect()}
    assert rows["r1"].pos == 4 and rows["r1"].is_reverse and rows["r1"].tags == {"HP": "1", "RG": "g"} and rows["r2"].contig is None
    assert R.region(R.sam(spark, f"{tmp_path}/a.sam"), unmapped=True).count() == 1


def test_graphs(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "AC"), ("n2", "GT")], "id string, seq string")
    edges = spark.createDataFrame([("n1", "n2", 2.5)], "src string, dst string, weight double")
    W.gfa(nodes, edges, f"{tmp_path}/g")
    n, e = R.gfa(spark, f"{tmp_path}/g")
    assert n.count() == 2 and [tuple(r) for r in e.collect()] == [("n1", "n2", 2.5)]
    anchors = spark.createDataFrame([("A1", "AC", 5)], "name string, seq string, pos long")
    steps = spark.createDataFrame([("E1", "GG", "A1", "SINK", ["r"], ["s"])], "name string, seq string, src string, dst string, reads array<string>, samples array<string>")
    W.annotated_gfa(anchors, steps, f"{tmp_path}/ag")
    a, s = R.annotated_gfa(spark, f"{tmp_path}/ag")
    assert [tuple(r) for r in a.collect()] == [("A1", "AC", 5)] and s.first().reads == ["r"]


def test_variants_and_matrix(spark, tmp_path):
    v = spark.createDataFrame([("c", 9, "A", ["T"], [1, 0], 40)], "contig string, pos long, ref string, alts array<string>, gt array<int>, gq int")
    W.vcf(v, spark.createDataFrame([("c", 100)], "contig string, length long"), f"{tmp_path}/v")
    r = R.vcf(spark, f"{tmp_path}/v").first()
    assert (r.contig, r.pos, r.ref, r.alts, r.samples) == ("c", 9, "A", ["T"], ["1|0:40"])
    cells = spark.createDataFrame([(1, 5, 0, 7), (2, 6, 1, 3)], "read int, site int, allele int, weight int")
    W.matrix(cells, f"{tmp_path}/m", [5, 6])
    assert sorted(tuple(r) for r in R.tsv(spark, f"{tmp_path}/m").collect()) == [("1", "0,7", "-,1"), ("2", "-,1", "1,3")]


def test_rows_side_by_side_and_one_after_another(spark):
    left = spark.createDataFrame([("c", 5), ("a", 3), ("b", 4)], "name string, at int")
    right = spark.createDataFrame([(9, "x"), (7, "y")], "at int, name string")
    got = {tuple(r) for r in R.zipped(left, right, "at", "at").select("ord", "from_name", "from_at", "to_name", "to_at").collect()}
    assert got == {(0, "a", 3, "y", 7), (1, "b", 4, "x", 9)}
    assert R.zipped(left, right.limit(0), "at", "at").count() == 0
    both = R.concatenated({"l": left, "r": right.drop("at")})
    assert {tuple(r) for r in both.select("name", "at", "source").collect()} == {("c", 5, "l"), ("a", 3, "l"), ("b", 4, "l"), ("x", None, "r"), ("y", None, "r")}


def test_unaligned_reads_and_read_groups(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@RG\tID:g\tSM:s1\n@RG\tID:h\n@SQ\tSN:c\tLN:9\nr1\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tRG:Z:g\nr2\t0\tc\t1\t9\t2M\t*\t0\t0\tGG\tII\n")
    assert [tuple(r) for r in R.read_groups(spark, f"{tmp_path}/a.sam").collect()] == [("g", "s1")]
    rows = R.sam(spark, f"{tmp_path}/a.sam").selectExpr("*", "'s1' as sample")
    assert [(r.seq, r.qual) for r in R.unaligned(rows).collect()] == [("AC", "II")]
    both = R.keep_order(rows, "qname").collect()
    assert {(r.qname, r.ord) for r in both} == {("r1", 0), ("r2", 1)}


def test_region_by_index_reads_few_blocks(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((c, rng.randrange(1, 40_000), i) for i in range(3_000) for c in [rng.choice("abc")])
    lines = [f"r{i}\t0\t{c}\t{p}\t60\t{rng.choice(['50M', '20M400N30M', '50M2D'])}\t*\t0\t0\t{'A' * 50}\t*" for c, p, i in rows]
    lines += [f"u{i}\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*" for i in range(40)]
    folder = tmp_path / "some reads"
    folder.mkdir()
    (folder / "a.sam").write_text("@HD\tVN:1.6\tSO:coordinate\tGO:none\n@CO\tone two\n" + "\n".join(lines) + "\n")
    with gzip.open(folder / "b.sam.gz", "wt") as f:
        f.write("\n".join(lines[::60]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        R.alignment_index(spark, str(folder)).write.parquet(f"{tmp_path}/index")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    index, whole = spark.read.parquet(f"{tmp_path}/index"), R.sam(spark, str(folder))
    blocks = index.select("path", "block").distinct().count()
    assert blocks > 20 and index.agg({"reads": "sum"}).first()[0] == whole.count()
    for place in ({"contig": "b", "start": 9_000, "stop": 9_500}, {"contig": "a"}, {"contig": "c", "start": 39_900}, {"contig": "b", "stop": 300}, {"unmapped": True}, {}, {"contig": "none"}):
        got, want = R.indexed_region(index, **place), R.region(whole, **place)
        assert sorted(r.qname for r in got.collect()) == sorted(r.qname for r in want.collect())
    narrow = R.indexed_region(index, "b", 9_000, 9_500)
    assert narrow.columns == whole.columns and narrow.rdd.getNumPartitions() < blocks / 5
    assert R.indexed_region(index.limit(0), "b").count() == 0
