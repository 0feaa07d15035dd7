"""Multi-part answers to text. A NULL cell plays the part of an empty answer (0) everywhere.

All functions return columns built from native expressions, so a whole table with eleven kinds of items
is recoded in one projection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kappaframe.functions.labels import lookup

# Grade words and the cards of the drag-and-drop items.
GRADE_WORDS = {0: "empty", 1: "incorrect", 2: "correct"}
DIV_TEMPLATE, DIV_CARDS = "nan1/nan2 * nan3/nan4", {1: "3", 2: "4", 3: "6", 4: "7", 0: "nan"}
CARD_TEMPLATE, CARD_CARDS = "nan1 * nan2 - nan3", {1: "17", 2: "27", 3: "54", 4: "62", 0: "nan"}
LEAST_TEMPLATE, LEAST_CARDS = "(nan1 * nan2) - (nan3 + nan4)", {1: "w", 2: "x", 3: "y", 4: "z", 0: "nan"}

# Option texts of the probability item.
CHANCE_OPTIONS = ["1/8", "3/8", "5/8", "6/8"]
CHANCE_YES, CHANCE_NO = "Yes, the probability will change", "No, the probability won't change"
CHANCE_YES_LONG = "Replacing the card will change Trent probability of wining"
CHANCE_NO_LONG = "Replacing the card wont change Trent probability of wining"

# Texts of the age item, per script variant.
AGE_NUMBERS, AGE_ORDER = {0: "Null", 1: "4", 2: "8"}, {0: "Null", 1: "younger", 2: "older"}
AGE_CHOICES = {
    ("current", False): ("No Idea. ", "A", "B"),
    ("current", True): (
        "No Idea. ",
        "Phil age is not 3 times of Alex in 10 year",
        "Phil is not 2 years older than Zach in ten year",
    ),
    ("0604", False): ("No answer", "Student choose A", "Student choose B"),
    ("0604", True): (
        "No answer",
        "Phil age 3 times of Alex in 10 year is wrong",
        "Phil is 2 years older than Zach in ten year is wrong",
    ),
}

# Statements of the slope item.
SLOPE_STATEMENTS = [
    "The slope of the lines must be equal.",
    "The y-intercepts of the lines must be equal.",
    "The slopes of the lines cannot be equal.",
    "The y-intercepts of the lines cannot be equal.",
]


def _zero(cell: Column) -> Column:
    return F.coalesce(cell.cast("int"), F.lit(0))


def _true(cell: Column) -> Column:
    """A flag is set when it is neither missing, 0 nor false; booleans, numbers and their text forms are taken."""
    return F.coalesce(~F.lower(cell.cast("string")).isin("0", "0.0", "false", ""), F.lit(False))


def _bit(cell: Column) -> Column:
    return _true(cell).cast("int").cast("string")


def grade_word(grade: Column) -> Column:
    return lookup(GRADE_WORDS, _zero(grade))


def _slots(template: str, cards: dict[int, str], slots: list[tuple[Column, Column]], all_or_nothing: bool) -> Column:
    """Fills `nan1`, `nan2`, ... with the cards put on these places.

    Slots are laid out last first, so the first position of a place in the target array is the slot that wins.
    """
    targets = F.array(*[_zero(t) for _, t in reversed(slots)])
    drawn = F.array(*[lookup(cards, _zero(s)) for s, _ in reversed(slots)])
    pieces = re.split(r"nan(\d)", template)
    text = [F.lit(pieces[0])]
    for place, after in zip(pieces[1::2], pieces[2::2]):
        card = F.get(drawn, (F.array_position(targets, F.lit(int(place))) - 1).cast("int"))
        text += [F.coalesce(card, F.lit(f"nan{place}")), F.lit(after)]
    usable = ~F.exists(drawn, lambda card: card.isNull())
    if all_or_nothing:
        wanted = F.array(*[F.lit(i) for i in range(1, len(slots) + 1)])
        usable = usable & (F.size(F.array_except(wanted, targets)) == 0)
    return F.when(usable, F.concat(*text)).otherwise(F.lit(template))


def division(slots: list[tuple[Column, Column]]) -> Column:
    """Four cards on `a/b * c/d`: the template stays unless every place is filled."""
    return _slots(DIV_TEMPLATE, DIV_CARDS, slots, True)


def four_cards(slots: list[tuple[Column, Column]]) -> Column:
    return _slots(CARD_TEMPLATE, CARD_CARDS, slots, False)


def least_value(slots: list[tuple[Column, Column]]) -> Column:
    return _slots(LEAST_TEMPLATE, LEAST_CARDS, slots, False)


def graded_part(part: str, grade: Column, text: Column) -> Column:
    """`A correct:3/4 * 6/7`"""
    return F.concat(F.lit(f"{part} "), grade_word(grade), F.lit(":"), text)


def two_graded_parts(grade_a: Column, text_a: Column, grade_b: Column, text_b: Column) -> Column:
    missing = F.lit("0")
    return F.concat(
        F.lit("A is "), grade_word(grade_a), F.lit(": "), F.coalesce(text_a, missing),
        F.lit("; B is "), grade_word(grade_b), F.lit(": "), F.coalesce(text_b, missing),
    )


def chance_part_a(grade: Column, selected: list[Column], fixed: bool = False) -> Column:
    """Selected options as text. By default option names are shifted by one and not separated, as in the
    recorded data; `fixed` names them right and separates them."""
    names = CHANCE_OPTIONS if fixed else ["Null", *CHANCE_OPTIONS[:3]]
    text = F.concat_ws(", " if fixed else "", *[F.when(_true(s), F.lit(n)) for s, n in zip(selected, names)])
    return F.concat(
        F.lit("Part A is "), grade_word(grade), F.lit(": "), F.when(text == "", "No answer").otherwise(text)
    )


def chance_part_b(
    yes: Column, no: Column, text: Column, yes_out: Column | None = None, no_out: Column | None = None,
    fixed: bool = False, extra: bool = False,
) -> Column:
    """Choice and explanation. `fixed` lets a struck-out option count as a choice of the other one."""
    say_yes, say_no = (CHANCE_YES_LONG, CHANCE_NO_LONG) if extra else (CHANCE_YES, CHANCE_NO)
    names = {"10": say_yes, "01": say_no, "11": "Not sure ", "00": "Not Sure "}
    flags = [yes, no]
    if fixed and yes_out is not None and no_out is not None:
        flags += [yes_out, no_out]
        struck = {"10": CHANCE_NO, "01": CHANCE_YES}
        names = {
            f"{c}{o}": struck.get(o, text_) if c == "00" else text_
            for c, text_ in names.items()
            for o in ("00", "01", "10", "11")
        }
    choice = lookup(names, F.concat(*[_bit(f) for f in flags]))
    return F.concat(choice, F.lit(", "), F.coalesce(text, F.lit("I don't know")))


def halves(cells: list[Column]) -> Column:
    """`s: [1, 0], e: [0, 1]`"""
    middle = len(cells) // 2

    def shown(part: list[Column]) -> Column:
        return F.concat(F.lit("["), F.array_join(F.array(*[c.cast("string") for c in part]), ", ", "0"), F.lit("]"))

    return F.concat(F.lit("s: "), shown(cells[:middle]), F.lit(", e: "), shown(cells[middle:]))


def _age_part_a(response: Column) -> Column:
    """`c(1, 2)` to `4 older`; absent numbers read as 0."""
    bare = F.regexp_replace(response, "^c\\(|\\)$", "")
    numbers = F.split(bare, " *, *| +")
    pick = lambda i: F.coalesce(F.get(numbers, F.lit(i)).try_cast("int"), F.lit(0))
    return F.concat(lookup(AGE_NUMBERS, pick(0)), F.lit(" "), lookup(AGE_ORDER, pick(1)))


def _age_code(response: Column, struck: Column) -> Column:
    """`10` when only the first choice is left, `01` the second, `11` both, `00` none."""

    def left(digit: str, flag: str) -> Column:
        seen = F.coalesce(response, F.lit("")).rlike(f"{digit}|{flag}")
        out = F.coalesce(struck, F.lit("")).rlike(f"{digit}|{flag}")
        return (seen & ~out).cast("int").cast("string")

    return F.concat(left("1", "TRUE "), left("2", " TRUE"))


def age_choice_text(response: Column, struck: Column, variant: str = "current") -> Column:
    """The sentence for part B alone (`I choose A`)."""
    none, a, b = AGE_CHOICES[(variant, False)]
    start, joint = ("I choose ", "and ") if variant == "current" else ("", ", ")
    names = {"00": none, "10": a, "01": b, "11": a + joint + b}
    return lookup({k: start + v for k, v in names.items()}, _age_code(response, struck))


def age_evidence(response: Column, struck: Column) -> Column:
    """1 only when exactly the right choice is left."""
    return (_age_code(response, struck) == "10").cast("int")


def age_part_a(grade: Column, response: Column, extra: bool = True, variant: str = "current") -> Column:
    text = F.concat(F.lit("Part A is "), grade_word(grade))
    if not extra:
        return text
    if variant == "0604":
        return F.concat(text, F.lit(": "))
    return F.concat(text, F.lit(": "), _age_part_a(response))


def age_full_context(
    grade: Column, part_a: Column, response: Column, struck: Column, extra: bool = False, variant: str = "current"
) -> Column:
    """Choices first, then the grade of part A."""
    none, a, b = AGE_CHOICES[(variant, extra)]
    text = lookup({"00": none, "10": a, "01": b, "11": f"{a}, {b}"}, _age_code(response, struck))
    grade_text = F.concat(F.lit("Part A is "), grade_word(grade))
    if extra:
        grade_text = F.concat(grade_text, F.lit(": "), _age_part_a(part_a))
    return F.concat(text, F.lit(". "), grade_text)


def slope_choice(selected: Column, struck: Column, text: Column, variant: str = "current") -> Column:
    """Chosen statement, or the options left after elimination, and the explanation.

    More than one choice is a broken row and gives NULL.
    """
    if variant == "0604":
        zero = F.lit("0")
        return F.concat(
            F.lit("s: ["), F.coalesce(selected, zero), F.lit("], e: ["), F.coalesce(struck, zero), F.lit("]")
        )
    flags = F.split(F.coalesce(selected, F.lit("")), " ")
    outs = F.split(F.coalesce(struck, F.lit("")), " ")
    n_chosen = F.size(F.filter(flags, lambda f: f == "TRUE"))
    first = F.get(F.array(*[F.lit(s) for s in SLOPE_STATEMENTS]), (F.array_position(flags, "TRUE") - 1).cast("int"))
    letters = F.array(*[F.lit(o) for o in "ABCD"])
    left = F.array_join(F.filter(letters, lambda _, i: ~F.coalesce(F.get(outs, i) == "TRUE", F.lit(False))), " and ")
    statement = F.when(n_chosen == 1, first).when(
        n_chosen == 0, F.when(left == "", "Not sure.").otherwise(F.concat(F.lit("I choose "), left))
    )
    return F.concat(statement, F.lit(" "), F.coalesce(text, F.lit("No idea.")))


def joined_text(first: Column, second: Column, missing: str = "0") -> Column:
    return F.concat(F.coalesce(first, F.lit(missing)), F.lit(". "), F.coalesce(second, F.lit(missing)))


def reversed_map(table: dict[str, list[str]]) -> dict[str, str]:
    """Label lists by reduced label to reduced label by label."""
    return {label: reduced for reduced, labels in table.items() for label in labels}
