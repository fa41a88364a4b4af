import pytest


@pytest.fixture
def docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = "alpha beta gamma delta " * 5_000
    rows = [
        (1, "Plain words make a line.\nAnother line of words follows it.", "en", "s", 60),
        (1, "Plain words make a line.\nAnother line of words follows it.", "en", "s", 60),
        (2, None, None, None, None),
        (3, "", "en", "s", 0),
        (4, " \n\t ", "en", "s", 4),
        (5, long, "en", "s", len(long)),
        (6, long, "en", "s", len(long)),
        (7, "é ü   漢字 😀 token = 'abcdef123' Released under the MIT License", "fr", "s", 20),
        (None, "no id here", "en", "s", 10),
    ]
    clash = "7 as score, 7 as k, 7 as fp, 7 as blob, 7 as spans, 7 as predicted, 7 as labels, 7 as n, 7 as core, 7 as rule, 7 as component_id"
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *clash.split(", "))
