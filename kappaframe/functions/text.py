"""Prompt and completion text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kappaframe.constants import (
    GROUP_TEXT,
    PROMPT_EXAMPLE,
    PROMPT_GROUP,
    PROMPT_QUERY,
    PROMPT_QUESTION,
    PROMPT_SCORE,
    SCORE_TOKENS,
    SELECTION_WORDS,
)
from kappaframe.functions.labels import lookup
from kappaframe.functions.seeded import mix

COMPLETION_SCORE = "Score \\s*([A-Za-z0-9]+):"


def with_closed_form(text: Column, context: Column) -> Column:
    """Appends the closed-form answer where there is one; a cell that is only `..` becomes `.`."""
    joined = F.when(context.isNotNull(), F.concat(text, F.lit(". "), context)).otherwise(text)
    return F.when(joined == "..", F.lit(".")).otherwise(joined)


def example_line(text: Column, label: Column) -> Column:
    return F.concat(F.lit(PROMPT_EXAMPLE), text, F.lit(". " + PROMPT_SCORE), label.cast("string"))


def prompt(
    text: Column, examples: Column | None = None, question: Column | None = None, group: Column | None = None,
    generative: bool = False,
) -> Column:
    """Prompt of one response. `examples` is an array of example lines. A generative prompt puts the
    examples first and ends with the score word, the other form starts with the task words."""
    body = text
    if question is not None:
        body = F.concat(body, F.lit(PROMPT_QUESTION), question)
    if group is not None:
        body = F.concat(body, F.lit("\n" + PROMPT_GROUP), group)
    if examples is not None:
        lines = F.array_join(examples, "\n")
        if generative:
            body = F.concat(lines, F.lit("\n"), body, F.lit(". " + PROMPT_SCORE))
        else:
            body = F.concat(body, F.lit("\n"), lines)
    return body if generative else F.concat(F.lit(PROMPT_QUERY), body)


def group_text(levels: dict[str, Column], blind_id: Column | None = None, seed: int = 0) -> Column:
    """Group description of a row. With `blind_id` a level is drawn by id instead of the row's own."""
    words = []
    for position, (attribute, level) in enumerate(levels.items()):
        book = GROUP_TEXT[attribute]
        code = level.cast("int")
        if blind_id is not None:
            code = (mix(blind_id, seed + position) % (len(book) - 1) + 1).cast("int")
        words.append(lookup(book, code))
    return F.array_join(F.array(*words), ", ")


def tagged_block(document: Column, tag: Column) -> Column:
    """Text between `<tag>` and `</tag>`, NULL when there is none."""
    after = F.when(document.contains(F.concat(F.lit("<"), tag, F.lit(">"))), document)
    start = F.concat(F.lit("<"), tag, F.lit(">"))
    begin = F.position(start, after)
    rest = F.substring(after, begin + F.length(start), F.length(after))
    end = F.position(F.concat(F.lit("</"), tag, F.lit(">")), rest)
    return F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replaces every placeholder by the row's value (empty when missing)."""
    filled = template
    for placeholder, value in values.items():
        filled = F.replace(filled, F.lit(placeholder), F.coalesce(value, F.lit("")))
    return filled


def selection_words(flags: Column) -> Column:
    return lookup(SELECTION_WORDS, flags)


def first_score(completion: Column, longest_first: bool = True) -> Column:
    """First score token contained in the completion, `1` when there is none. Detailed scores are looked
    for first; `longest_first=False` keeps the listed order, where `1` hides `1A`."""
    tokens = sorted(SCORE_TOKENS, key=len, reverse=True) if longest_first else SCORE_TOKENS
    return F.coalesce(*[F.when(completion.contains(t), F.lit(t)) for t in tokens], F.lit("1"))


def score_after_word(completion: Column) -> Column:
    """Code behind the word `Score`, `-1` when there is none."""
    code = F.regexp_extract(completion, COMPLETION_SCORE, 1)
    return F.when(code == "", F.lit("-1")).otherwise(code)


def checkpoint_epoch(name: Column) -> Column:
    """`checkpoint-5` to 5, NULL for names without a number."""
    digits = F.regexp_replace(name, "[^0-9]", "")
    return F.when(digits != "", digits.cast("int"))


def metric_parts(name: Column) -> Column:
    """`eval_geo_kappa` to `(prefix, item, metric)`; the item may hold underscores."""
    pattern = "^([^_]+)_(.+)_([^_]+)$"
    return F.struct(*[F.regexp_extract(name, pattern, i).alias(n) for i, n in ((1, "prefix"), (2, "item"), (3, "metric"))])
