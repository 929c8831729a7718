"""Text functions on single strings."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T


def value(spark, f, s):
    return spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "s, prose", [("", False), ("다음 자료를 보고 답하시오", True), ("A + B -> C", False), ("this is a long line of ordinary words", True), ("a/b", False), ("그림", False)]
)
def test_prose(spark, s, prose):
    assert value(spark, T.is_prose, s) is prose


@pytest.mark.parametrize("s, equation", [("x^2 + y^2 = 25", True), ("a -> b", False), ("A -> B", True), ("", False), ("12 + 3 - 4", True), ("plain", False)])
def test_equation(spark, s, equation):
    assert value(spark, T.is_equation, s) is equation


@pytest.mark.parametrize(
    "s, repaired",
    [
        ("lonic bond", "Ionic bond"), ("colonic", "colonic"), ("a particles", "α particles"), ("거리가 2.3 8일 때", "거리가 2.3Å일 때"), ("2.27 A", "2.27Å"), ("197 Au 79 + ion", "¹⁹⁷Au⁷⁹⁺ion"),
        ("(He2+)", "(⁴₂He²⁺)"), ("A +B (g)", "A⁺B⁻(g)"), ("6H,0(1)", "6H.0(l)"), ("[Fe(H2O)6]*", "[Fe(H2O)6]+"),
    ],
)
def test_repair(spark, s, repaired):
    assert value(spark, T.repair_scientific, s) == repaired


@pytest.mark.parametrize(
    "token, script",
    [("H2O", "H_{2}O"), ("Na+(aq)", "Na^{+}(aq)"), ("[Co(CO)6]3+", "[Co(CO)_{6}]^{3+}"), ("ABC", None), ("A⁺B⁻(g)", "A^{+}B^{-}(g)"), ("⁴₂He²⁺", " ^{4}_{2}He^{2+} "), ("Na⁺(g)", "Na^{+}(g)"), ("abc", None)],
)
def test_script(spark, token, script):
    assert value(spark, T.chem_script, token) == script


def test_segments_keep_all_text(spark):
    parts = value(spark, T.chem_segments, "mix H2O with salt")
    assert [(p["type"], p["text"] or p["script"]) for p in parts] == [("text", "mix "), ("equation", "H_{2}O"), ("text", " with salt")]
    assert [p["text"] for p in value(spark, T.chem_segments, "only words")] == ["only words"]


@pytest.mark.parametrize("s, label", [("-4.0", True), ("(다)", True), ("Contour plots", True), ("this is a rather long sentence of text", False), ("", False)])
def test_chart_label(spark, s, label):
    assert value(spark, T.is_chart_label, s) is label


def test_canonical_and_note_lead(spark):
    assert value(spark, T.canonicalize, "  page 12  of 30 ") == "page # of #"
    assert value(spark, lambda s: T.strip_note_lead(s, F.lit(3)), "3. answer") == "answer"


def test_texts_are_collapsed_once_for_all_tests(spark):
    for test in (T.is_prose, T.is_equation, T.norm_formula, T.norm_chem_equation):
        plan = spark.range(1).select(F.col("id").cast("string").alias("s")).select(test(F.col("s")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"(?U)\s+, ") == 1, test
