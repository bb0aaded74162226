import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text

CASES = ["No information", "ok\nNo information here", "x\rNo facts", "a\u2028no facts", "Amazon now has new information", "do not contain", "", "\nno facts", "fine no mention of it\nother"]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("t"))).collect()]


def test_informative_looks_at_the_first_line(spark):
    want = [bool(t) and not re.match(text.UNINFORMATIVE, t) for t in CASES]
    assert column(spark, CASES, text.informative) == want
    assert want == [False, True, False, False, False, False, False, True, False]
    assert column(spark, ["ok\nno facts", None], lambda c: text.informative(c, True)) == [False, False]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="no facts\n\r\u2028\x1c\t\u00a0NX", max_size=12), min_size=1, max_size=30))
def test_python_parity(spark, values):
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.rstrip) == [v.rstrip() for v in values]
    assert column(spark, values, text.first_token) == [(v.split() or [None])[0] for v in values]
    assert column(spark, values, text.informative) == [bool(v) and not re.match(text.UNINFORMATIVE, v) for v in values]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("**Stock Return:** 2.5% (up)", "Positive"),
        ("Stock Return: -1.2% (Down)", "Negative"),
        ("Stock Return:\u00a03% (up)", "Positive"),
        ("Stock Return: [2]% (up)", "Unknown"),
        ("Stock Return: 2% up", "Unknown"),
        ("Stock Return: 1% (down) Stock Return: 1% (up)", "Negative"),
    ],
)
def test_direction(spark, said, want):
    assert column(spark, [said], text.direction) == [want]


def test_prediction_and_prompts(spark):
    assert column(spark, ["Price Movement: Positive\nx", "a Price Movement: b Price Movement: Negative. c", "Price Movement:  "], text.prediction) == ["Positive", "Negative.", None]
    prompt = "A:\nHere are some examples:\nx\n(END OF EXAMPLES)\n\nrest \n"
    assert column(spark, [prompt, "no end"], text.remove_fewshot) == ["A:\n\nrest", None]
    failed = "pre\n\nYou have attempted to tackle the following task before and failed. n\n\nFacts:\n2022-01-01\nx"
    assert column(spark, [failed], text.remove_reflections) == ["pre\n\nFacts2022-01-01\nx"]
    assert column(spark, [failed], lambda c: text.remove_reflections(c, True)) == ["pre\n\nFacts:\n2022-01-01\nx"]
    assert column(spark, ["x"], lambda c: text.bullets(F.array(c, F.lit(" b ")), "H\n")) == ["H\nReflections:\n- x\n- b"]
    assert column(spark, ["x"], lambda c: text.bullets(F.array().cast("array<string>"), "H\n")) == [""]
    assert column(spark, ["50% {x}"], lambda c: text.fill("{t} of {t}!", {"t": c})) == ["50% {x} of 50% {x}!"]
    assert column(spark, [None], lambda c: text.fill("{t}", {"t": c})) == [None]


def test_python_list_is_repr(spark):
    lists = [[], ["a"], ["it's", 'say "x"', "it's \"x\""], ["\\ \n\r\t\x00\x1f\x7f\xa0 é字\U0001f600퟿\U000e0001"], [None, ""], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>")
    assert [r.t for r in df.select("i", text.python_list(F.col("x")).alias("t")).orderBy("i").collect()] == [None if x is None else repr(x) for x in lists]
