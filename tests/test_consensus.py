import random

from pyspark.sql import functions as F

from strandline.operators import pileup as P


def test_texts_are_counted_by_column_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD_COUNTS", 50)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), "".join(rng.choice("ACGT-é") for _ in range(rng.randint(1, 40)))) for _ in range(200)]
    texts = spark.createDataFrame(rows, "g string, seq string").repartition(3)
    one = P.column_consensus(texts.select("g", F.posexplode(F.split("seq", "")).alias("pos", "base")), ["g"])
    assert sorted(map(str, P.text_consensus(texts, ["g"]).collect())) == sorted(map(str, one.collect()))


def test_empty_and_missing_texts_show_no_column(spark):
    texts = spark.createDataFrame([("a", ""), ("a", ""), ("a", "C"), ("b", ""), ("b", None)], "g string, seq string")
    assert [tuple(r) for r in P.text_consensus(texts, ["g"]).collect()] == [("a", "C")]


def test_query_leaves_empty_texts_out_like_its_sql(spark, tmp_path):
    from strandline.plans.pileup_queries import q_pileup_consensus
    docs = spark.createDataFrame([(1, "", "s", "en"), (2, "..", "s", "en"), (3, "a", "s", "en")], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert q_pileup_consensus(spark, str(tmp_path)).first()["n"] == 1
