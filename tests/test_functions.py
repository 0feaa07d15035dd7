"""Hand-made rows for the column functions."""

import pytest
from pyspark.sql import functions as F

from kappaframe.functions import labels as L
from kappaframe.functions import recode as C
from kappaframe.functions import seeded
from kappaframe.functions import text as X
from kappaframe.functions import vectors as V


def value(spark, column, row=None):
    frame = spark.createDataFrame([row], ", ".join(f"{k} {t}" for k, (t, _) in SCHEMA.items())) if row else spark.range(1)
    return frame.select(column.alias("v")).head()["v"]


SCHEMA: dict = {}


def lits(*values):
    return [F.lit(v) if v is not None else F.lit(None).cast("string") for v in values]


def slots(*pairs):
    return [tuple(lits(*p)) for p in pairs]


@pytest.mark.parametrize(
    "pairs, want",
    [
        (((1, 1), (2, 2), (3, 3), (4, 4)), "3/4 * 6/7"),
        (((4, 1), (3, 2), (2, 3), (1, 4)), "7/6 * 4/3"),
        (((1, 1), (2, 2), (3, 3), (4, 0)), "nan1/nan2 * nan3/nan4"),
        (((1, 1), (2, 2), (3, 3), (None, 4)), "3/4 * 6/nan"),
        (((1, 1), (2, 1), (3, 3), (4, 4)), "nan1/nan2 * nan3/nan4"),
        (((9, 1), (2, 2), (3, 3), (4, 4)), "nan1/nan2 * nan3/nan4"),
    ],
)
def test_division(spark, pairs, want):
    assert value(spark, C.division(slots(*pairs))) == want


def test_four_cards_and_least(spark):
    assert value(spark, C.four_cards(slots((4, 1), (0, 2), (None, None)))) == "62 * nan - nan3"
    assert value(spark, C.four_cards(slots((1, 1), (2, 1), (3, 3)))) == "27 * nan2 - 54"  # the later slot wins
    assert value(spark, C.least_value(slots((1, 1), (2, 2), (3, 3), (4, 4)))) == "(w * x) - (y + z)"


def test_chance_item(spark):
    grade = F.lit("2")
    assert value(spark, C.chance_part_a(grade, lits("0", "1", "0", "0"))) == "Part A is correct: 1/8"
    assert value(spark, C.chance_part_a(grade, lits("0", "1", "1", "0"), fixed=True)) == "Part A is correct: 3/8, 5/8"
    assert value(spark, C.chance_part_a(F.lit(None), lits(None, None, None, None))) == "Part A is empty: No answer"
    none = F.lit(None).cast("string")
    assert value(spark, C.chance_part_b(none, none, none)) == "Not Sure , I don't know"
    assert value(spark, C.chance_part_b(F.lit(True), F.lit(False), F.lit("x"))) == "Yes, the probability will change, x"
    assert value(spark, C.chance_part_b(F.lit(1), F.lit(1), F.lit("x"))) == "Not sure , x"
    assert value(spark, C.chance_part_b(none, none, F.lit("x"), F.lit("1"), none, fixed=True)).startswith("No, the")


def test_age_item(spark):
    none = F.lit(None).cast("string")
    text = lambda r, s=None, v="current": value(spark, C.age_choice_text(F.lit(r), none if s is None else F.lit(s), v))
    assert text("TRUE FALSE") == "I choose A"
    assert text("TRUE TRUE") == "I choose Aand B"
    assert text("FALSE FALSE") == "I choose No Idea. "
    assert text("TRUE TRUE", "FALSE TRUE") == "I choose A"
    assert text("TRUE TRUE", None, "0604") == "Student choose A, Student choose B"
    assert value(spark, C.age_evidence(F.lit("TRUE FALSE"), none)) == 1
    assert value(spark, C.age_evidence(F.lit("TRUE TRUE"), none)) == 0
    assert value(spark, C.age_part_a(F.lit("2"), F.lit("c(1, 2)"))) == "Part A is correct: 4 older"
    assert value(spark, C.age_part_a(F.lit("1"), F.lit("c(NA, 1)"))) == "Part A is incorrect: Null younger"
    assert value(spark, C.age_part_a(F.lit("0"), none)) == "Part A is empty: Null Null"
    assert value(spark, C.age_full_context(F.lit("2"), F.lit("c(2, 1)"), F.lit("FALSE TRUE"), none, extra=True)) == (
        "Phil is not 2 years older than Zach in ten year. Part A is correct: 8 younger"
    )


def test_slope_item(spark):
    none = F.lit(None).cast("string")
    one = "TRUE FALSE FALSE FALSE"
    assert value(spark, C.slope_choice(F.lit(one), none, none)) == "The slope of the lines must be equal. No idea."
    assert value(spark, C.slope_choice(F.lit("TRUE TRUE FALSE FALSE"), none, none)) is None
    left = C.slope_choice(F.lit("FALSE FALSE FALSE FALSE"), F.lit("TRUE FALSE FALSE TRUE"), F.lit("b"))
    assert value(spark, left) == "I choose B and C b"
    assert value(spark, C.slope_choice(none, F.lit("TRUE TRUE TRUE TRUE"), F.lit("b"))) == "Not sure. b"


def test_geo_halves_joined(spark):
    none = F.lit(None).cast("string")
    assert value(spark, C.two_graded_parts(F.lit("1"), F.lit("t"), F.lit("2"), none)) == "A is incorrect: t; B is correct: 0"
    assert value(spark, C.halves(lits("1", "0", None, "1"))) == "s: [1, 0], e: [0, 1]"
    assert value(spark, C.joined_text(F.lit("a"), none)) == "a. 0"


def test_rounding_and_labels(spark):
    got = [value(spark, L.round_half_even(F.lit(x))) for x in (2.5, 1.5, 0.5)]
    assert got == [2, 2, 0]
    assert value(spark, L.label_digits(F.lit("2A"))) == 2
    assert [value(spark, L.canonical_label(F.lit(x))) for x in ("1", "1.0", 1.0, 1)] == ["1"] * 4
    assert value(spark, L.item_id(F.lit("VH266510"), F.lit("2017.0"))) == "VH266510_2017"
    assert value(spark, L.row_mean([F.lit(1), F.lit(None).cast("int"), F.lit(4)])) == 2.5
    assert value(spark, L.reduce_by_evidence(F.lit(3), F.lit(0))) == 2


def test_scores_in_text(spark):
    from kappaframe.operators.agreement import score_code

    assert value(spark, score_code(X.score_after_word(F.lit("so Score 4: ok")))) == "2A"
    assert value(spark, score_code(X.score_after_word(F.lit("no idea")))) == "-1"
    assert value(spark, score_code(X.score_after_word(F.lit("Score 9: ok")))) == "9"
    assert value(spark, X.first_score(F.lit("got 1A"))) == "1A"
    assert value(spark, X.first_score(F.lit("got 1A"), longest_first=False)) == "1"
    assert value(spark, X.first_score(F.lit("none"))) == "1"
    assert value(spark, X.checkpoint_epoch(F.lit("checkpoint-5"))) == 5
    assert value(spark, X.checkpoint_epoch(F.lit("best"))) is None
    assert tuple(value(spark, X.metric_parts(F.lit("eval_slope_2017_kappa")))) == ("eval", "slope_2017", "kappa")


def test_prompts(spark):
    assert value(spark, X.tagged_block(F.lit("a<q1>x <b>y</q1>z"), F.lit("q1"))) == "x <b>y"
    assert value(spark, X.tagged_block(F.lit("nothing"), F.lit("q1"))) is None
    assert value(spark, X.fill(F.lit("{T} and {U}"), {"{T}": F.lit("a"), "{U}": F.lit(None).cast("string")})) == "a and "
    assert value(spark, X.with_closed_form(F.lit("t"), F.lit("c"))) == "t. c"
    line = X.example_line(F.lit("e"), F.lit("2"))
    assert value(spark, X.prompt(F.lit("t"), F.array(line))) == "Score this response: t\nExamples: e. Score: 2"
    assert value(spark, X.prompt(F.lit("t"), F.array(line), generative=True)) == "Examples: e. Score: 2\nt. Score: "
    assert value(spark, X.group_text({"dsex": F.lit(1), "lep": F.lit(2)})) == "male, not english"


def test_vectors(spark):
    assert value(spark, V.parse_vector(F.lit("[0.1  0.7\n 0.2]"))) == [0.1, 0.7, 0.2]
    soft = value(spark, V.softmax(F.array(*lits(1.0, 2.0, 3.0)), 3))
    assert soft == pytest.approx([0.09003057, 0.24472847, 0.66524096])
    assert value(spark, V.argmax(F.array(*lits(0.2, 0.5, 0.5)))) == 1
    assert value(spark, V.cosine(F.array(*lits(1.0, 0.0)), F.array(*lits(0.0, 0.0)))) == 0.0
    loss = value(spark, V.ordinal_log_loss(F.array(*lits(0.5, 0.3, 0.2)), F.lit(0), 3))
    import math

    assert loss == pytest.approx(-math.log(0.7) - 4 * math.log(0.8))


def test_seeded_draws_are_even(spark):
    draws = spark.range(20000).select((seeded.mix("id", 5) % 10).alias("d"), F.expr(seeded.mix_sql("id", 5)).alias("s"),
                                      seeded.mix("id", 5).alias("m"))
    assert draws.where("s <> m").count() == 0
    counts = [r["count"] for r in draws.groupBy("d").count().collect()]
    assert len(counts) == 10 and min(counts) > 1700 and max(counts) < 2300
