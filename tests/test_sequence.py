import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("kmer", "want"), [("CGTA", "CGTA"), ("TACG", "CGTA"), ("AAAA", "AAAA"), ("TTTT", "AAAA")])
def test_canonical(spark, kmer, want):
    assert _one(spark, S.canonical("k"), k=kmer) == want


def test_palindromes_are_reverse(spark):
    assert _one(spark, S.is_forward("k"), k="ACGT") is False


@pytest.mark.parametrize(
    ("text", "padding", "want"),
    [
        ("chr1:1000-2000", 0, ("chr1", 1000, 2000, "chr1:1000-2000")),
        ("chr2:5000-6000", 100, ("chr2", 4900, 6100, "chr2:4900-6100")),
        ("chr3:10,000-20,000|gene1", 0, ("chr3", 10000, 20000, "gene1")),
        ("chr4 30000-40000", 0, ("chr4", 30000, 40000, "chr4:30000-40000")),
        ("chr8\t90000\t100000\tgene2", 0, ("chr8", 90000, 100000, "gene2")),
        ("chr9:110000\t120000", 0, ("chr9", 110000, 120000, "chr9:110000-120000")),
        ("chr10-A:130000-140000|chr10-A", 0, ("chr10-A", 130000, 140000, "chr10-A")),
        ("chr22:42121531-42135680:1-14150", 0, ("chr22:42121531-42135680", 1, 14150, "chr22:42121531-42135680:1-14150")),
        ("chr1:50-60", 100, ("chr1", 0, 160, "chr1:0-160")),
    ],
)
def test_loci(spark, text, padding, want):
    assert tuple(_one(spark, S.parse_locus("t", padding), t=text)) == want


@pytest.mark.parametrize("text", ["chr5:start-50000", "chr6:60000-50000"])
def test_wrong_loci(spark, text):
    with pytest.raises(Exception, match="not a locus"):
        _one(spark, S.parse_locus("t"), t=text)


def test_strings(spark):
    assert _one(spark, S.homopolymer_compressed("s"), s="AAACCGTTTT") == "ACGT"
    assert _one(spark, S.reverse_complement("s"), s="ACGTN") == "NACGT"
    assert _one(spark, S.windows("s", 3), s="ACGTA") == ["ACG", "CGT", "GTA"] and _one(spark, S.windows("s", 3), s="AC") == []
    assert [tuple(x) for x in _one(spark, S.tiles("s", 2, F.lit("n")), s="ACGTA")] == [(0, "AC", "n_0_to_2"), (2, "GT", "n_2_to_4"), (4, "A", "n_4_to_6")]
    assert _one(spark, S.shannon_entropy("s"), s="ACGT") == 2.0 and _one(spark, S.gc_content("s"), s="GGCA") == 0.75
    assert _one(spark, S.contig_of_path(F.array(F.lit("ACG"), F.lit("CGT"))), s="") == "ACGT"
    assert _one(spark, S.base_name("s", [".fa", ".gz", ".fasta"]), s="/a/b/x.fa.gz") == "x"
    assert _one(spark, S.sample_of("s"), s="a|b|c") == "c"
    assert _one(spark, S.apply_cs("s", F.lit(":2*gt+aa:1-ta:1")), s="ACGTTAC") == "ACTAATC"


def test_edges(spark):
    for text in ("acgtACGT", "........", ".c...CG."):
        bits = _one(spark, S.parse_edges("t"), t=text)
        assert _one(spark, S.edges_text("b"), b=bits) == text
    assert _one(spark, S.is_junction("b"), b=1 + 2) and not _one(spark, S.is_junction("b"), b=1 + 16)


def test_windows_of_intervals(spark):
    p = _one(spark, S.pad_interval("a", "b", 10), a=12, b=25)
    assert (p.start, p.stop) == (9, 29)
    assert _one(spark, S.window_starts("a", "b", 10), a=9, b=29) == [9, 19]


def test_repeats(spark):
    t = _one(spark, S.trim_to_repeat("s", ["GGG", "AAT"], ["CCC"]), s="TTAATCAGCAGCAACAGCCCTT")
    assert (t.pre, t.repeat, t.post) == ("AAT", "CAGCAGCAACAG", "CCC")
    assert _one(spark, S.repeat_units("s", "CAG"), s=t.repeat) == 3
    assert _one(spark, S.repeat_interruptions("s", [("CAA", "CAA"), ("AAC", "AAC")]), s=t.repeat) == {"CAA": 1}
    # a marker before the unit may be asked for by looking ahead
    assert _one(spark, S.repeat_interruptions("s", [("CAA", "CAA(?=CAG)")]), s=t.repeat) == {"CAA": 1}
