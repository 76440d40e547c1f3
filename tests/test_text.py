import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import stem, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("a,b", [("running", "run"), ("relational", "relat"), ("generously", "generous"), ("ponies", "poni"), ("ties", "tie"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("consign", "consign"), ("knightly", "knight"), ("national", "nation"), ("cats", "cat"), ("agreed", "agre"), ("happy", "happi"), ("say", "say"), ("adjustable", "adjust"), ("controlling", "control")])
def test_stems(a, b):
    assert stem.stem(a) == b


def test_terms_keep_numbers_and_other_scripts():
    assert [stem.index_term(t) for t in ("3.75", "2nd", "größen", "valves")] == ["3.75", "2nd", "größen", "valv"]


@pytest.mark.parametrize("t", ["Kolben-Größe 3.75 m² v2", "a.b.c 1.2.3", "", "été_x Ωm"])
def test_tokens_equal_regular_expression(spark, t):
    assert one(spark, t, text.tokens) == re.findall(r"\d+\.\d+|\b\w+\b", t.lower())


def test_titles_and_fields(spark):
    d = spark.createDataFrame([("x\n Title : Big Pump \ny", "f.txt"), ("no", "f.txt"), (None, "g.txt")], "t string, f string")
    assert [r[0] for r in d.select(text.title(F.col("t"), F.col("f"))).collect()] == ["Big Pump", "f.txt", "g.txt"]
    assert one(spark, "DOC: GCA-2024-0002\nREV: --", lambda c: F.concat_ws("/", text.catalog_field(c, "DOC"), text.catalog_field(c, "REV"))) == "GCA-2024-0002/—"
    assert one(spark, "intro\n1. one\nx\n2.  two", text.step_lines) == ["1. one", "2.  two"]


def test_markdown(spark):
    assert one(spark, [["a", "b|c"], [None, "x\ny"]], text.markdown_table, "array<array<string>>") == "| a | b\\|c |\n| --- | --- |\n|  | x y |"
    assert one(spark, [["only"]], text.markdown_table, "array<array<string>>") == "| only |\n| --- |"


def test_telemetry_and_summary(spark):
    assert one(spark, "a\n2024-01-02 03:04:05 x\r\nb\n", text.without_telemetry) == "a\nb"
    assert one(spark, "  System Mass            59.473       kg\nprose\n", lambda c: text.summary_text(F.lit("T"), c)) == "T | System Mass: 59.473 kg"
    assert one(spark, "prose", lambda c: text.summary_text(F.lit("T"), c)) is None


def test_answer_values(spark):
    assert set(one(spark, "28 V and 59.4730 kg, -40°C; 28.0 V", text.answer_values)) == {"28v", "59.473kg", "-40°c"}
