"""Coercion, answers, prompts, texts and tails on worked cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import answers, coerce, prompts, tails, text


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_truth_rules_differ(spark):
    values = ["True", " true", "1", "yes", None, "no"]
    assert column(spark, values, coerce.true_exact) == [True, False, False, False, False, False]
    assert column(spark, values, coerce.true_report) == [True, False, True, True, False, False]
    assert column(spark, values, coerce.true_stripped) == [True, True, False, False, False, False]


def test_numbers(spark):
    assert column(spark, ["5d", "5f", " 1.5\t", "", None, "1e3", ".5", "5."], coerce.number) == [None, None, 1.5, None, None, 1000.0, 0.5, 5.0]
    assert column(spark, ["inf", "-Infinity"], coerce.number) == [math.inf, -math.inf]
    assert column(spark, ["3", "0", "-2", "1.0", "x", None, " 7 "], coerce.run_number) == [3, 0, 0, 0, 0, 0, 7]


@pytest.mark.parametrize("value", ["1", "1.0", "0.7", "0.50", "0", "-0.0", "1e20", "123456789012345", "0.00001", "1e-7", "100", "2.5000000000001"])
def test_temperature_key_is_12_digits(spark, value):
    assert column(spark, [value], coerce.temperature_key) == [format(float(value), ".12g")]


def test_temperature_key_of_no_number(spark):
    assert column(spark, ["", None, "warm"], coerce.temperature_key) == ["", "", ""]


def test_comparison_cell(spark):
    assert column(spark, ["5.0", "5", " x ", "2.5", ""], coerce.comparison_cell) == ["5", "5", "x", "2.5", ""]


CASES = [
    ("500\n3", 500, 3, ""),
    ("Line 1: 500\nLine 2: 3", 500, 3, ""),
    ("1. 500 CHF\n2. 3", 500, 3, ""),
    ("Wager: 250\nRisk profile (1-5): 4", 250, 4, ""),
    ("Wager: 250 Risk profile (1-5): 4", 250, 4, ""),
    ("I would wager 300 CHF.\nRisk preference: 2", 300, 2, ""),
    ("My allocation amount is 1000 and my risk preference is 5.", 1000, 5, ""),
    ("Allocation amount: 620\nRisk preference: 3", 620, 3, ""),
    ("1500\n3", None, 3, "no_number"),
    ("500\n7", 500, None, ""),
    ("", None, None, "empty_response"),
    ("I cannot help with that.\n100\n1", 100, 1, "refusal_language"),
    ("-5\n2", 5, 2, ""),
    ("1,000\n2", 1, 2, ""),
    ("12CHF\n3", 3, None, ""),
    ("500\v3", 500, 3, ""),
    ("500 3", 500, 3, ""),
]


def test_answers(spark):
    more = [
        (None, None, None, "empty_response"),
        ("Line 1: 2000\r\nLine 2: 9\n", None, None, "no_number"),
        ("Risk: 3, wager = 40 (of 1000)", 40, 3, ""),
        ("wager then stake: 70", 70, None, ""),
        ("bet: 5 bet: 6", 5, None, ""),
        ("RISK PROFILE 4", None, 4, "no_number"),
        ("I stake (12) nothing, or 30 at most, 2", 30, None, ""),
        ("٣٠\n٢", 30, 2, ""),
        ("99999999999999999999\n2", None, 2, "no_number"),
        ("1) 20\n2) 5", 20, 5, ""),
        ("a: b: 7\nc: 8: 1", 7, 1, ""),
    ]
    cases = [*CASES, *more]
    got = column(spark, [c[0] for c in cases], answers.parse_answer)
    for (said, wager, risk, error), r in zip(cases, got, strict=True):
        assert (r["wager"], r["risk"], r["error"]) == (wager, risk, error), said
        assert r["valid"] == (wager is not None) and r["valid_risk"] == (risk is not None)


def test_labels(spark):
    said = ["REALIZED", "it is paper_open.", "realized or paper", "1", "zero", "", None, "closed", "unrealized"]
    got = [tuple(r) for r in column(spark, said, answers.parse_label)]
    assert got == [("REALIZED", True, ""), ("PAPER", True, ""), ("", False, "ambiguous_label"), ("REALIZED", True, ""), ("", False, "invalid_label"), ("", False, "empty_response"), ("", False, "empty_response"), ("REALIZED", True, ""), ("PAPER", True, "")]


def test_signed_integers(spark):
    assert column(spark, ["-5 and 7", "1,000", "x"], answers.signed_integers) == [["-5", "7"], ["1", "000"], []]


def test_prompts(spark):
    rows = spark.createDataFrame([("paper", 0, "absolute"), ("realized", -50, "absolute"), ("realized", -51, "absolute"), ("paper", 81, "qualitative"), ("realized", 10, "balance")], "k string, a int, v string")
    got = [r[0] for r in rows.select(prompts.prompt_text(F.col("k"), F.col("a"), F.col("v"))).collect()]
    for part, p in zip(("neither won nor lost", "a small loss of 50 CHF", "you paid 51 CHF", "won a substantial amount", "10 CHF above where you started"), got, strict=True):
        assert part in p and p.endswith("very aggressive/high-volatility)")
    with pytest.raises(Exception, match="no template"):
        rows.select(prompts.prompt_text(F.col("k"), F.col("a"), F.lit("new"))).collect()


def test_core_text_and_sets(spark):
    x = "Read.\n\nScenario:\nA man Has won 5 chips\n\nDo not answer yet. Go on."
    assert column(spark, [x], text.core) == ["A man Has won 5 chips"]
    assert column(spark, ["a man has won 5 chips"], text.content_tokens) == [["man", "won", "chips"]]
    assert column(spark, ["one two three four five six", "one two"], text.ngrams) == [["one two three four five", "two three four five six"], []]
    sets = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]


def test_regions_and_span_labels(spark):
    x = "Read.\n\nScenario:\nabc\n\nDo not answer yet."
    got = column(spark, [x, "nothing", "How much do you want"], lambda c: text.regions(c, F.lit("")))
    assert [tuple(s) for s in got[0]] == [("wrapper", 0, 17), ("scenario", 17, 20), ("processing_instruction", 20, 40)]
    assert [tuple(s) for s in got[1]] == [("prompt", 0, 7)]
    spans = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in (("x", 0, 4), ("y", 4, 8))])
    one = spark.range(1)
    label = lambda a, b: one.select(text.span_label(F.lit(a), F.lit(b), spans)).first()[0]
    assert [label(3, 7), label(3, 5), label(9, 12), label(2, 2)] == ["y", "x", "other", "special"]


def test_prompt_issues(spark):
    good = text.PROMPT_PREFIX + "She has two integers from 1 to 1000 and 1-5." + text.PROMPT_SUFFIX
    assert column(spark, [good, "I am a dataset", None], text.prompt_issues) == [[], ["bad_prefix", "bad_suffix", "missing_behavior_instruction", "first_person", "internal_label_leak"], ["bad_prefix", "bad_suffix", "missing_behavior_instruction"]]


def test_tails():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.f_upper(4.9646027437307128, 1, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.sign_test(5, 0) == 0.0625
    assert tails.sign_test(0, 0) is None
    assert tails.sign_test(3000, 2900) == pytest.approx(0.1977, abs=2e-3)
