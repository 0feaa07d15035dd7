"""From raw export cells to the folded training table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaframe.constants import REDUCED_LABELS, RENAMES
from kappaframe.functions import recode as C
from kappaframe.functions.labels import canonical_label, item_id, lookup
from kappaframe.operators.splits import held_out, stratified_folds
from kappaframe.session import spread

OUTPUT = ["id", "qid", "label", "text", "text1", "text2", "context_all", "r_label", "est_score", "fold"]


def _cells(raw: DataFrame):
    present = set(raw.columns)

    def cell(name: str) -> Column:
        return F.col(f"`{name}`") if name in present else F.lit(None).cast("string")

    return cell


def labelled(raw: DataFrame) -> DataFrame:
    """Adds the item id and the label; cheap, so that folds can be worked out before any text is."""
    cell = _cells(raw)
    rows = spread(raw).withColumns({"accession": item_id(cell("accession"), cell("year")), "id": cell("student_id")})
    grade = {q: cell("ptb_rtr1") for q in ("VH266015", "VH507804", "VH269384", "VH271613")}
    grade["VH302907"] = cell("pta_rtr1")
    return rows.withColumn("label", canonical_label(_case(F.col("accession"), grade, cell("score"))))


def recoded(raw: DataFrame, variant: str = "current") -> DataFrame:
    """Label, text and context of all items in one pass (no pass per item).

    `raw` holds text cells with NULL for missing; columns an item kind does not fill may be absent.
    `variant='0604'` gives the texts of the earlier script.
    """
    return with_texts(labelled(raw), variant)


def with_texts(rows: DataFrame, variant: str = "current") -> DataFrame:
    """Adds texts and contexts to labelled rows.

    Done step by step, so that a value used twice is one column and not two copies of its expression.
    """
    cell = _cells(rows)
    rows = rows.withColumn("_answer", cell("predict_from"))
    key, answer, none = F.col("accession"), F.col("_answer"), F.lit(None).cast("string")
    current = variant == "current"
    slots = [(cell(f"source{i}"), cell(f"target{i}")) for i in range(1, 5)]
    choice = cell("partB_response_val"), cell("partB_eliminations")
    slope = C.slope_choice(cell("selected"), cell("eliminated"), answer, variant)
    first_part = {
        "VH269384": C.chance_part_a(cell("pta_rtr1"), [cell(f"selected{i}") for i in range(1, 5)]),
        "VH271613": C.age_choice_text(*choice, variant=variant),
    }
    rows = rows.withColumn("text1", _case(key, first_part, none))
    text = {"VH269384": C.chance_part_b(cell("selected1.1"), cell("selected2.1"), answer)}
    if current:
        text |= {"VH266510_2019": slope, "VH271613": C.joined_text(F.col("text1"), answer)}
    context = {
        "VH266015": C.graded_part("A", cell("pta_rtr1"), C.division(slots)),
        "VH302907": C.two_graded_parts(
            cell("ptb_rtr1").try_cast("int"), cell("parsed_xml_v2"), cell("ptc_rtr1"), cell("parsed_xml_v3")
        ),
        "VH507804": C.graded_part("A", cell("pta_rtr1"), C.four_cards(slots[:3])),
        "VH139380": cell("parsed_xml_v1"),
        "VH304954": cell("parsed_xml_v2"),
        "VH525628": C.least_value(slots),
        "VH266510_2017": cell("eliminations"),
        "VH266510_2019": F.lit("") if current else slope,
        "VH269384": F.col("text1"),
        "VH271613": C.age_part_a(cell("pta_rtr1"), cell("partA_response_val"))
        if current
        else C.age_full_context(cell("pta_rtr1"), cell("partA_response_val"), *choice, variant=variant),
    }
    is_age = key == "VH271613"
    rows = rows.withColumns(
        {
            "predict_from": _case(key, text, answer),
            "context_all": _case(key, context, none),
            "r_label": F.when(is_age, lookup(C.reversed_map(REDUCED_LABELS), F.col("label"))),
            "est_score": F.when(is_age, C.age_evidence(*choice)),
        }
    )
    second_part = {"VH269384": F.col("predict_from"), "VH271613": answer}
    return rows.withColumn("text2", _case(key, second_part, none)).drop("_answer")


def _case(key: Column, table: dict[str, Column], default: Column) -> Column:
    items = list(table.items())
    chain = F.when(key == items[0][0], items[0][1])
    for name, value in items[1:]:
        chain = chain.when(key == name, value)
    return chain.otherwise(default)


def training_table(raw: DataFrame, pos: str = "pos", variant: str = "current") -> DataFrame:
    """Recoded rows with stratified folds per item, under their final column names."""
    folded = stratified_folds(labelled(raw), "accession", "label", pos)
    return with_texts(folded, variant).withColumnsRenamed(RENAMES).select(*OUTPUT)


def unlabelled_table(raw: DataFrame, variant: str = "current", seed: int = 0) -> DataFrame:
    """Recoded rows without labels: placeholder labels and the held-out fold."""
    return held_out(recoded(raw, variant), "student_id", seed).withColumnsRenamed(RENAMES).select(*OUTPUT)
