from strandline.functions import sequence as S
from strandline.plans import haplotype_queries as Q
from strandline.plans import typing_queries as Y

D = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_encoded_once(spark):
    plan = _plan(Q.q_repeat_table(spark, D))
    assert plan.count("regexp_replace(html") == 1


def test_repeat_totals_read_pages_once(spark):
    assert _plan(Y.q_repeat_totals(spark, D)).count("html") == 0


def test_trimmed_by_the_first_pattern_that_ends(spark):
    rows = spark.createDataFrame([("xBBcagEEy",), ("xAAcagFFy",), ("BBAAzEE",), ("AAz",), ("EEAA",), (None,)], "s string")
    got = [r.t and (r.t.trimmed, r.t.repeat, r.t.pre, r.t.post) for r in rows.select(S.trim_to_repeat("s", ["A+", "B+"], ["E+", "F+"]).alias("t")).collect()]
    assert got == [("BBcagEE", "cag", "BB", "EE"), ("AAcagFF", "cag", "AA", "FF"), ("AAzEE", "z", "AA", "EE"), None, None, None]
