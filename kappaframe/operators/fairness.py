"""Differences between groups of people: statistics, pairwise bias, offset scenarios.

Responses are reduced to `(item, attribute levels, y, n)` counts before attributes are unpivoted, so the
big table is read once and neither the unpivot nor the pair join touches it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaframe.functions.labels import round_half_even
from kappaframe.operators.agreement import agreement, confusion_cells
from kappaframe.operators.ordering import running_total


def join_attributes(predictions: DataFrame, attributes: DataFrame, groups: list[str], on: str = "id") -> DataFrame:
    """Left join of demographic attributes; columns of the same name on the left are replaced. The attribute
    table is deduplicated; a dominant join key is split by Spark's skew-join handling."""
    kept = attributes.select(on, *groups).dropDuplicates()
    return predictions.drop(*groups).join(kept, on, "left")


def count_values(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """`(keys, y, n)`: the pre-aggregated form every function below takes."""
    return df.select(*keys, value.alias("y")).groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))


def group_stats(counts: DataFrame, groups: list[str], item: str = "qid") -> DataFrame:
    """Mean, sample deviation and non-null count of `y` per (item, attribute, level).

    `y` holds whole numbers, so the moments are exact sums and do not depend on the order of addition.
    Rows with a null item or level are left out.
    """
    pairs = [F.struct(F.lit(g).alias("attr"), F.col(g).cast("string").alias("level")) for g in groups]
    y, n = F.col("y").cast("decimal(20,0)"), F.col("n")
    cells = (
        counts.where(F.col(item).isNotNull() & F.col("y").isNotNull())
        .select(item, "y", "n", F.inline(F.array(*pairs)))
        .where(F.col("level").isNotNull())
        .groupBy(item, "attr", "level")
        .agg(F.sum("n").alias("n"), F.sum(y * n).alias("_s"), F.sum(y * y * n).alias("_q"))
    )
    count, total = F.col("n").cast("double"), F.col("_s").cast("double")
    spread = (F.col("_q").cast("double") - total * total / count) / (count - 1)
    return cells.select(
        item,
        "attr",
        "level",
        (total / count).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("std"),
        F.col("n").cast("bigint").alias("n"),
    )


def effect_size(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    """Difference of means over the pooled variance; NULL for a single row or a zero variance."""
    spread = (n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2
    return F.when(spread > 0, (m1 - m2) * (n1 + n2 - 2) / spread)


def bias_pairs(stats: DataFrame, item: str = "qid") -> DataFrame:
    """Effect size of every ordered pair of levels of an attribute within an item (joined on the aggregated
    statistics, which hold one row per level)."""
    side = lambda tag: stats.select(
        item, "attr", *[F.col(c).alias(f"{c}{tag}") for c in ("level", "mean", "std", "n")]
    )
    pairs = side(1).join(side(2), [item, "attr"]).where(F.col("level1") != F.col("level2"))
    value = effect_size(*[F.col(f"{c}{tag}") for tag in (1, 2) for c in ("mean", "std", "n")])
    return pairs.select(item, "attr", F.col("level1").alias("g1"), F.col("level2").alias("g2"), value.alias("bias"))


def bias_overall(pairs: DataFrame, item: str = "qid") -> DataFrame:
    """Mean of the distinct absolute pair values: per item, and running over the items in order.

    A value enters the running mean with the first item that shows it, so the running form needs one row
    per item and no comparison of items.
    """
    values = pairs.where(F.col("bias").isNotNull()).select(item, F.abs("bias").alias("v")).distinct()
    own = values.groupBy(item).agg(F.avg("v").alias("item_bias"))
    first = values.groupBy("v").agg(F.min(item).alias(item)).groupBy(item)
    fresh = first.agg(F.sum("v").alias("_s"), F.count("v").alias("_c"))
    joined = own.join(fresh, item, "left").fillna(0, ["_s", "_c"])
    upto = running_total(joined, [item], {"_before": "_s", "_count": "_c"})
    return upto.select(item, "item_bias", ((F.col("_before") + F.col("_s")) / (F.col("_count") + F.col("_c"))).alias("running_bias"))


def bias_matrix(pairs: DataFrame, levels: list[str], item: str = "qid") -> DataFrame:
    """Group by group matrix of one table row per `g1`; the diagonal is 0."""
    wide = pairs.groupBy(item, "attr", "g1").pivot("g2", levels).agg(F.first("bias"))
    cells = [F.when(F.col("g1") == l, F.lit(0.0)).otherwise(F.col(f"`{l}`")).alias(f"vs_{l}") for l in levels]
    return wide.select(item, "attr", "g1", *cells)


def offset_scenarios(
    df: DataFrame, mean: str, truth: str, treated: Column, offset: float = 0.2, keys: list[str] | None = None
) -> DataFrame:
    """`(keys, scenario, label, y)` for truth, prediction, and prediction with `offset` added to one group,
    all in one pass over the table."""
    shifted = F.when(treated, F.col(mean) + F.lit(offset)).otherwise(F.col(mean))
    cases = F.array(
        F.struct(F.lit("truth").alias("scenario"), F.col(truth).cast("int").alias("y")),
        F.struct(F.lit("before").alias("scenario"), round_half_even(F.col(mean)).alias("y")),
        F.struct(F.lit("after").alias("scenario"), round_half_even(shifted).alias("y")),
    )
    return df.select(*(keys or []), F.col(truth).cast("int").alias("label"), F.inline(cases))


def scenario_report(df: DataFrame, mean: str, truth: str, attr: str, treated: Column, item: str = "qid") -> DataFrame:
    """Quadratic kappa per item and mean absolute bias between the levels of `attr`, per scenario."""
    cases = offset_scenarios(df, mean, truth, treated, keys=[item, attr])
    counts = cases.groupBy(item, attr, "scenario", "label", "y").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy("scenario", item, "label", "y").agg(F.sum("n").alias("n"))
    kappas = agreement(
        cells.select("scenario", item, F.col("label").alias("truth"), F.col("y").alias("predicted"), "n").dropna(),
        ["scenario", item],
    )
    tagged = counts.select(F.struct("scenario", item).alias("_k"), attr, "y", "n")
    pairs = bias_pairs(group_stats(tagged, [attr], "_k"), "_k")
    gaps = pairs.groupBy("_k").agg(F.avg(F.abs("bias")).alias("mean_abs_bias"))
    gaps = gaps.select("_k.*", "mean_abs_bias")
    return kappas.join(gaps, ["scenario", item], "left").select(
        "scenario", item, "n", "quadratic_kappa", "mean_abs_bias"
    )


def per_group_rows(df: DataFrame, groups: list[str]) -> DataFrame:
    """One copy of every row per attribute, tagged `attr`, `level` and `type` (`attr_level`)."""
    pairs = [F.struct(F.lit(g).alias("attr"), F.col(g).cast("string").alias("level")) for g in groups]
    return (
        df.select("*", F.inline(F.array(*pairs)))
        .where(F.col("level").isNotNull())
        .withColumn("type", F.concat_ws("_", "attr", "level"))
    )


def per_group_agreement(df: DataFrame, groups: list[str], truth: str, predicted: str) -> DataFrame:
    """Agreement per attribute level: cells are counted with all attributes first, then unpivoted."""
    cells = confusion_cells(df, groups, truth, predicted)
    pairs = [F.struct(F.lit(g).alias("attr"), F.col(g).cast("string").alias("level")) for g in groups]
    rows = cells.select("truth", "predicted", "n", F.inline(F.array(*pairs)))
    small = rows.groupBy("attr", "level", "truth", "predicted").agg(F.sum("n").alias("n"))
    return agreement(small, ["attr", "level"])


def stack(frames: list[DataFrame]) -> DataFrame:
    """Union of frames with different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
