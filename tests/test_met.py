import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.operators import kmers as K


@pytest.mark.parametrize("told", [500_000, 0])
def test_words_are_met_where_they_stand(spark, monkeypatch, told):
    monkeypatch.setattr(K, "TOLD", told)
    rng = random.Random(5)
    reads = [(i % 2, f"r{i}", "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 4, 5, 6, 40, 200])] + [(0, "odd", "ACGTNACGTA"), (1, "none", None)]
    words = [(w, i if i % 3 else None, w[::-1]) for i, w in enumerate(sorted({"".join(rng.choice("ACGT") for _ in range(5)) for _ in range(300)}))]
    frame, table = spark.createDataFrame(reads, "g int, id string, seq string"), spark.createDataFrame(words, "kmer string, n long, back string")
    wanted = sorted((g, r, p, *w) for g, r, s in reads if s and len(s) > 5 and "N" not in s for p in range(len(s) - 4) for w in words if w[0] == s[p : p + 5])
    none = lambda rows: [tuple(-1 if x is None else x for x in r) for r in rows]
    got = K.met(frame, table, 5, ["g", "id"])
    assert got.columns == ["g", "id", "pos", "kmer", "n", "back"] and sorted(none(got.collect())) == sorted(none(wanted))
    assert K.met(frame, table.limit(0), 5, ["g", "id"]).isEmpty() and K.met(frame.limit(0), table, 5, ["g", "id"]).isEmpty()


def test_correction_makes_no_row_of_a_foreign_kmer(spark, monkeypatch):
    rng = random.Random(6)
    true = "".join(rng.choice("ACGT") for _ in range(120))
    wrong = true[:60] + "ACGT"["ACGT".index(true[60]) - 1] + true[61:]
    foreign = "".join(rng.choice("ACGT") for _ in range(3000))
    table = K.count_kmers(spark.createDataFrame([(true,)], "seq string"), 15, score=True)
    reads = spark.createDataFrame([("a", true), ("b", wrong), ("c", foreign), ("d", foreign[:500] + wrong + foreign[500:])], "id string, seq string")
    rows, real = [], G._poor_stretches
    monkeypatch.setattr(G, "_poor_stretches", lambda at, *more: rows.append(at.agg(F.count("pos"), F.count_if(F.col("pos") >= 500)).first()) or real(at, *more))
    got = {r.id: (r.seq, r.replaced) for r in G.correct_reads(reads, table, 15, "id").collect()}
    assert got == {"a": (true, 0), "b": (true, 1), "c": (foreign, 0), "d": (foreign[:500] + true + foreign[500:], 1)}
    # 106 places of the true k-mers, and twice 91 beside the wrong base
    assert tuple(rows[0]) == (106 + 91 + 91, 91)


def test_recruited_reads_come_with_their_texts(spark, monkeypatch):
    rng = random.Random(8)
    longs = [(w, "".join(rng.choice("ACGT") for _ in range(120))) for w in range(3)]
    shorts = [(f"s{i}", longs[i % 3][1][a : a + 50]) for i, a in enumerate(rng.randrange(70) for _ in range(12))] + [("far", "ACGT" * 12), ("twice", longs[0][1][:40]), ("twice", longs[0][1][30:70])]
    short, long_ = spark.createDataFrame(shorts, "id string, seq string"), spark.createDataFrame(longs, "w int, seq string")
    asked, real = [], K._recruited
    monkeypatch.setattr(K, "_recruited", lambda rows, *more: asked.append(sorted(r.id for r in rows.collect())) or real(rows, *more))
    got = K.recruit_distinct(short, long_, 11, "id", ("w",), whole=True)
    joined = sorted(map(tuple, K.recruit_distinct(short, long_, 11, "id", ("w",)).join(short, "id").select(*got.columns).collect()))
    assert sorted(map(tuple, got.collect())) == joined and [r[1] for r in joined].count("twice") == 2
    # reads are joined with their texts only where a key has several rows
    assert asked[0] == ["twice", "twice"]
    monkeypatch.setattr(K, "BAIT", 0)
    assert sorted(map(tuple, K.recruit_distinct(short, long_, 11, "id", ("w",), whole=True).collect())) == joined
