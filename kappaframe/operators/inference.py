"""User-supplied models on a column: batches inside tasks, the model loaded once per task."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaframe.session import small_batches, spread

Batch = Callable[[list[str]], list]


def infer(
    df: DataFrame, text: str, load: Callable[[], Batch], output: str, output_type: T.DataType, keep: list[str],
    batch_size: int = 10, by_length: bool = True,
) -> DataFrame:
    """`(keep, output)`: the batch function returned by `load()` applied to `text`.

    Rows are ordered by length inside their partition, longest first, so that a batch holds texts of
    similar length.
    """
    small_batches(df.sparkSession)
    rows = spread(df.select(*keep, F.col(text).alias("_text")))
    if by_length:
        rows = rows.sortWithinPartitions(F.desc(F.length("_text")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            texts = part["_text"].tolist()
            values: list = []
            for start in range(0, len(texts), batch_size):
                values.extend(model(texts[start : start + batch_size]))
            result = part[keep].copy()
            result[output] = values
            yield result

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(output, output_type)])
    return rows.mapInPandas(run, schema)


def column_function(function: Callable[[pd.Series], pd.Series], returns: str, column: str) -> Column:
    """A Series to Series function as a column, for code that has no native form; a Series is bounded in rows and bytes.

    `s.str` keeps its Series in a cycle of references, so what earlier batches left is collected before each one; else a
    task would hold most of its texts.
    """
    small_batches(SparkSession.active())

    def bounded(values: pd.Series) -> pd.Series:
        gc.collect()
        return function(values)

    return F.pandas_udf(bounded, returns)(F.col(column))
