"""Folds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kappaframe.constants import HELD_OUT_FOLDS
from kappaframe.functions.seeded import mix, slice_of_draw
from kappaframe.operators.ordering import after_ranks, bucket_sizes, draw_slices, position_bucket, with_order

TEST_FOLD = 10


def stratified_folds(
    df: DataFrame, item: str, label: str, pos: str, folds: int = 10, bucket: Column | None = None
) -> DataFrame:
    """Adds `fold`: per item, every fold gets the same share of every label, deterministic in row order.

    Labels are laid end to end by first appearance. With `s` rows before label c, fold i takes
    `cnt_i(s + n_c) - cnt_i(s)` of its rows, where `cnt_i(x)` counts the numbers below x that are i modulo
    the number of folds; rows fill the folds in order. Only label counts are combined across the item; rows
    are numbered per position bucket, so a dominant item or label stays spread out.

    No row is lost: a NULL label counts as label 0, rows with a NULL item are an item of their own; both columns
    stay as they are.
    """
    bucket = position_bucket(pos) if bucket is None else bucket
    key = ["_item", "_class"]
    # an empty array stands for the missing item and meets no named one
    named = F.when(F.col(item).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(item).cast("string")))
    strata = {"_item": named, "_class": F.coalesce(F.col(label).cast("string"), F.lit("0"))}
    rows = with_order(df.withColumns(strata), F.col(pos), bucket)
    sizes = bucket_sizes(rows, key, F.min("_order").alias("_first"))
    classes = sizes.groupBy(*key).agg(F.sum("_k").alias("_n"), F.min("_first").alias("_first"))
    earlier = Window.partitionBy("_item").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    below = lambda x, i: F.floor((x + (folds - 1 - i)) / folds)
    shares = [below(F.col("_start") + F.col("_n"), i) - below(F.col("_start"), i) for i in range(folds)]
    ends = [sum(shares[: i + 1], F.lit(0)).cast("bigint").alias(f"r{i}") for i in range(folds - 1)]
    placed = after_ranks(rows, key, sizes, classes.select(*key, *ends), folds - 1)
    return placed.drop(*key).withColumnRenamed("_after", "fold")


def hashed_folds(df: DataFrame, id_column: str, folds: int = 10, seed: int = 0) -> DataFrame:
    """Folds by id hash: no shuffle, shares equal in expectation only."""
    return df.withColumn("fold", (mix(id_column, seed) % folds).cast("int"))


def split_of_fold(fold: Column, val_fold: int, test_fold: int) -> Column:
    """`val`, `test`, `train` or NULL (held out). A row without a fold goes to training."""
    if val_fold == test_fold:
        raise ValueError("validation and test fold must differ")
    return (
        F.when(fold == val_fold, "val")
        .when(fold == test_fold, "test")
        .when(~F.coalesce(fold.isin(HELD_OUT_FOLDS), F.lit(False)), "train")
    )


def train_val_test(df: DataFrame, val_fold: int, test_fold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = split_of_fold(F.col("fold"), val_fold, test_fold)
    return tuple(df.where(part == name) for name in ("train", "val", "test"))  # type: ignore[return-value]


def random_split(
    df: DataFrame, item: str, id_column: str, seed: int = 0, train: float = 0.8, val_of_rest: float = 0.5
) -> DataFrame:
    """Adds `split` with exact sizes per item: `floor(train * n)` rows train, half of the rest validate."""
    rows = _in_draw_order(df.where(F.col(item).isNotNull()), id_column, seed)
    sizes = bucket_sizes(rows, [item])
    n = F.sum("_k").alias("_n")
    n_train = F.floor(F.col("_n") * F.lit(train)).cast("bigint")
    n_val = F.floor((F.col("_n") - n_train) * F.lit(val_of_rest)).cast("bigint")
    wanted = sizes.groupBy(item).agg(n).select(item, n_train.alias("r0"), (n_train + n_val).alias("r1"))
    placed = after_ranks(rows, [item], sizes, wanted, 2)
    part = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("_after") + 1)
    return placed.withColumn("split", part).drop("_after")


def _in_draw_order(df: DataFrame, id_column: str, seed: int) -> DataFrame:
    draw = mix(id_column, seed)
    slices = slice_of_draw(draw, draw_slices(df))
    return with_order(df, F.struct(draw.alias("d"), F.col(id_column).alias("i")), slices)


def sample_n(df: DataFrame, n: int, id_column: str, seed: int = 0) -> DataFrame:
    """n rows without replacement."""
    return sample_per_key(df.withColumn("_all", F.lit(0)), ["_all"], n, id_column, seed).drop("_all")


def sample_per_key(df: DataFrame, keys: list[str], n: int, id_column: str, seed: int = 0) -> DataFrame:
    """n rows per key without replacement (all rows of a smaller key): those first in a seeded order of ids."""
    rows = _in_draw_order(df.dropna(subset=keys), id_column, seed)
    sizes = bucket_sizes(rows, keys)
    wanted = sizes.groupBy(*keys).agg(F.least(F.sum("_k"), F.lit(n)).alias("r0"))
    return after_ranks(rows, keys, sizes, wanted, 1).where("_after = 0").drop("_after")


def fold_audit(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """Rows per fold and label, one column per label."""
    wide = df.groupBy("fold").pivot(label, labels).agg(F.count(F.lit(1)))
    return wide.select("fold", *[F.coalesce(F.col(f"`{l}`"), F.lit(0)).alias(f"n_{l}") for l in labels])


def placeholder_label(id_column: Column | str, seed: int = 0) -> Column:
    """Reproducible random label for rows that have none."""
    return F.element_at(F.array(F.lit("1"), F.lit("2"), F.lit("3")), (mix(id_column, seed) % 3 + 1).cast("int"))


def held_out(df: DataFrame, id_column: str = "id", seed: int = 0) -> DataFrame:
    """Unlabelled rows get a placeholder label and the held-out fold."""
    label = placeholder_label(id_column, seed)
    return df.withColumns({"score_to_predict": label, "label": label, "fold": F.lit(TEST_FOLD)})

