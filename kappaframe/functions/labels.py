"""Label and cell helpers: every function takes and returns columns built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaframe.constants import MISSING_TOKENS, SPLIT_BY_YEAR


def lookup(table: Mapping, key: Column) -> Column:
    """Value of a small fixed table, NULL for an unknown key."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def label_digits(label: Column) -> Column:
    """Detailed label to its number: `2A` to 2."""
    return F.regexp_replace(label.cast("string"), "[^0-9]", "").cast("int")


def canonical_label(label: Column) -> Column:
    """`1`, `1.0` and 1.0 all become `1`."""
    return F.regexp_replace(label.cast("string"), "\\.0$", "")


def reduce_by_evidence(predicted: Column, evidence: Column) -> Column:
    """A top score without evidence for the right choice drops to 2."""
    return F.when((predicted == 3) & (evidence == 0), F.lit(2)).otherwise(predicted)


def reduce_by_text(predicted: Column, text: Column, wrong_choice: str) -> Column:
    """A top score on a text that shows the wrong choice drops to 2."""
    return F.when((predicted == 3) & text.contains(wrong_choice), F.lit(2)).otherwise(predicted)


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int")


def null_if_missing(cell: Column) -> Column:
    return F.when(~cell.isin(MISSING_TOKENS), cell)


def normalise_missing(df: DataFrame) -> DataFrame:
    """Missing tokens become NULL in text columns; NULL numbers become 0 (text stays NULL)."""
    numeric = (T.IntegralType, T.FractionalType)
    columns = []
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            cell = null_if_missing(cell)
        elif isinstance(field.dataType, numeric):
            cell = F.coalesce(cell, F.lit(0).cast(field.dataType))
        columns.append(cell.alias(field.name))
    return df.select(*columns)


def floats_to_integers(df: DataFrame) -> DataFrame:
    """Every double or float column is cut toward zero to BIGINT, in one projection."""
    columns = []
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            cell = cell.cast("bigint")
        columns.append(cell.alias(field.name))
    return df.select(*columns)


def item_id(accession: Column, year: Column) -> Column:
    """The accession that ran in two years is told apart by year."""
    return F.when(
        accession == SPLIT_BY_YEAR, F.concat_ws("_", accession, year.cast("double").cast("int").cast("string"))
    ).otherwise(accession)


def row_mean(columns: list[Column]) -> Column:
    """Mean of several columns of one row, NULLs skipped."""
    zero = F.lit(0.0)
    total = sum((F.coalesce(c.cast("double"), zero) for c in columns), zero)
    count = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(count > 0, total / count)


def epoch_columns(names: list[str], start: int = 1, end: int | None = None) -> list[str]:
    """`predict<k>` columns with start <= k <= end, found by name."""
    numbered = {int(n[7:]): n for n in names if n.startswith("predict") and n[7:].isdigit()}
    last = max(numbered) if end is None else end
    return [numbered[k] for k in sorted(numbered) if start <= k <= last]


def label_regime(df: DataFrame, regime: int) -> DataFrame:
    """Chooses the label column: 0 plain score, 1 detailed label, 2 reduced label with the plain score kept."""
    rows = df.withColumn("label1", F.col("label"))
    if regime == 0:
        rows = rows.withColumn("label", F.col("score_to_predict"))
    elif regime == 2:
        rows = rows.withColumns({"eval_label": F.col("score_to_predict"), "label": F.col("r_label")})
    elif regime != 1:
        raise ValueError("regime must be 0, 1 or 2")
    return rows.withColumn("label", canonical_label(F.col("label")))
