from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corollary.functions import templates, text
from corollary.operators import relational

BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def column(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def truncated(text, max_words=None, max_chars=None, message=text.TRUNCATION_MESSAGE):
    if text is None or text.endswith(message):
        return text
    cut = text
    if max_words is not None and len(text.split()) > max_words:
        cut = " ".join(text.split()[:max_words])
    if max_chars is not None:
        cut = cut[:max_chars]
    return cut + message if cut != text else text


def test_blanks_are_those_of_python():
    assert sorted(text.BLANK_CHARS) == sorted(BLANKS)


def test_strip_valid_and_split_know_every_blank(spark):
    df = column(spark, [b + "a" + b + "b" + b for b in BLANKS] + BLANKS + ["", None])
    n = len(BLANKS)
    assert values(df, text.strip(F.col("t")))[:n] == ["a" + b + "b" for b in BLANKS]
    assert values(df, text.is_valid(F.col("t"))) == [True] * n + [False] * (n + 2)
    assert values(df, text.truncate(F.col("t"), max_words=1))[:n] == ["a" + text.TRUNCATION_MESSAGE] * n


@pytest.mark.parametrize("limits", [{"max_words": 2}, {"max_chars": 5}, {"max_words": 3, "max_chars": 4}, {"max_words": 0}])
def test_truncate(spark, limits):
    texts = ["", " ", "one", "one two", "one two three", "  one\n two three ", "äöü ß é", "x" * 9, None, "a b c" + text.TRUNCATION_MESSAGE]
    df = column(spark, texts)
    got = values(df, text.truncate(F.col("t"), **limits))
    assert got == [truncated(t, **limits) for t in texts]
    again = column(spark, got)
    assert values(again, text.truncate(F.col("t"), **limits)) == got


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\0")), min_size=40, max_size=80),
    words=st.integers(1, 4),
    chars=st.integers(1, 12),
)
def test_truncate_any_text(spark, texts, words, chars):
    df = column(spark, texts)
    for limits in ({"max_words": words}, {"max_chars": chars}, {"max_words": words, "max_chars": chars}):
        assert values(df, text.truncate(F.col("t"), **limits)) == [truncated(t, **limits) for t in texts]
    assert values(df, text.strip(F.col("t"))) == [t.strip() for t in texts]
    assert values(df, text.is_valid(F.col("t"))) == [bool(t.strip()) for t in texts]


def test_truncate_without_limits_and_by_tokens(spark):
    df = column(spark, ["a-b-c-d", "a", None])
    assert values(df, text.truncate(F.col("t"))) == ["a-b-c-d", "a", None]
    tokenizer = (lambda s: s.split("-"), lambda tokens: "-".join(tokens))
    cut = text.truncate(F.col("t"), max_tokens=2, tokenizer=tokenizer)
    assert values(df, cut) == ["a-b" + text.TRUNCATION_MESSAGE, "a", None]
    with pytest.raises(ValueError):
        text.truncate(F.col("t"), max_tokens=2)


def test_printing_and_key(spark):
    df = column(spark, ["a\nb", "x" * 130, "y" * 250])
    assert values(df, text.for_printing(F.col("t")))[0] == "a b"
    assert values(df, text.for_printing(F.col("t")))[1] == "x" * 128 + text.TRUNCATION_MESSAGE
    assert values(df, text.identity_key(F.lit("c"), F.col("t")))[::2] == ["c|||a\nb...a\nb", "c|||" + "y" * 100 + "..." + "y" * 100]


def test_row_to_text_skips_unknown_and_missing(spark):
    df = spark.createDataFrame(
        [("x", 1, 2.5), ("Unknown", None, float("nan")), (None, 3, 1.0)], "home_town string, age int, dose double"
    )
    got = [r[0] for r in df.select(text.row_to_text(df, df.columns)).collect()]
    assert got == ["Home town: x, Age: 1, Dose: 2.5", "", "Age: 3, Dose: 1.0"]


def test_few_shot_prompt(spark):
    rows = spark.createDataFrame([(i, i * 10, "yes" if i % 2 else "no") for i in range(4)], "row_id long, dose int, label string")
    head, tail = relational.head_tail_split(rows, 2)
    prompts = relational.few_shot_prompts(head, tail, ["dose"], "label", n_examples=2).orderBy("row_id").collect()
    assert [p.row_id for p in prompts] == [2, 3]
    assert prompts[0].prompt == (
        templates.FEW_SHOT_HEADER + "Input: Dose: 0\nOutput: no\n\nInput: Dose: 10\nOutput: yes"
        "\n\nNow, given a new patient:\nInput: Dose: 20\nOutput:"
    )


def test_names_and_answers(spark):
    raw = ['- "mentions a"', '  "- mentions b"', '" -mentions c"', "mentions d"]
    assert values(column(spark, raw), text.clean_name(F.col("t"))) == ["mentions a", " mentions b", "mentions c", "mentions d"]
    answers = column(spark, ["Yes.", "No way", "well, yes and no", "maybe", None])
    assert values(answers, text.parse_yes_no(F.col("t"))) == [1, 0, 1, None, None]
    graded = column(spark, [" YES", "related.", "no", "hm", "not yes"])
    assert values(graded, text.parse_graded(F.col("t"))) == [1.0, 0.5, 0.0, None, 0.0]


def test_templates(spark):
    df = column(spark, ["{text} with braces"])
    assert values(df, templates.fill("<{a}|{b}>", a=F.col("t"), b=F.lit(1))) == ["<{text} with braces|1>"]
    with pytest.raises(KeyError):
        templates.fill("{a}{b}", a=F.lit("x"))


def test_model_input_and_labels(spark):
    df = column(spark, ["x"])
    assert values(df, text.model_input(F.col("t"), "nomic-ai/embed")) == ["search_document: x"]
    assert values(df, text.model_input(F.col("t"), "other")) == ["x"]
    assert values(df, text.model_input(F.col("t"), "some/instructor-base")) == [["Represent the text for classification: ", "x"]]
    labels = column(spark, ["home", "died"])
    assert values(labels, text.map_labels(F.col("t"), {"home": 0, "died": 1})) == [0, 1]
    with pytest.raises(PySparkException):
        values(column(spark, ["home", "lost"]), text.map_labels(F.col("t"), {"home": 0}))
    with pytest.raises(PySparkException):
        values(column(spark, [None]), text.map_labels(F.col("t"), {"home": 0}))
