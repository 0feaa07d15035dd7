"""Choosing epochs and uncertain rows from prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kappaframe.functions.labels import epoch_columns, round_half_even
from kappaframe.operators.agreement import agreement, confusion_cells


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """`predict<k>` columns to rows `(keys, epoch, predict)`."""
    names = epoch_columns(wide.columns)
    pairs = [F.struct(F.lit(int(n[7:])).alias("epoch"), F.col(n).alias("predict")) for n in names]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def to_wide(long: DataFrame, keys: list[str], epochs: list[int]) -> DataFrame:
    """Rows per epoch to `predict<k>` columns; the epoch list is given, so nothing is collected."""
    wide = long.groupBy(*keys).pivot("epoch", epochs).agg(F.first("predict", ignorenulls=True))
    return wide.select(*keys, *[F.col(str(e)).alias(f"predict{e}") for e in epochs])


def epoch_agreement(long: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement per key and epoch."""
    return agreement(confusion_cells(long, [*keys, "epoch"], "label", "predict"), [*keys, "epoch"])


def best_epoch(metrics: DataFrame, item: str = "qid", keys: list[str] | None = None) -> DataFrame:
    """Epoch with the highest positive validation kappa per item, and per `keys` such as the run (first epoch on ties), and
    the test kappa at that epoch. `metrics` holds `(keys, item, epoch, eval_kappa, test_kappa)`."""
    by = [*(keys or []), item]
    choice = F.max_by(
        F.struct("epoch", "eval_kappa", "test_kappa"), F.struct(F.col("eval_kappa"), (-F.col("epoch")).alias("e"))
    )
    best = metrics.where(F.col("eval_kappa") > 0).groupBy(*by).agg(choice.alias("b"))
    return best.select(*by, F.col("b.epoch").alias("epoch"), "b.eval_kappa", "b.test_kappa")


def window_predictions(wide: DataFrame, keys: list[str], label: str, shortest: int = 3) -> DataFrame:
    """`(keys, label, s, e, predict)` for every epoch window of at least `shortest` epochs.

    Prefix sums over the epoch columns of one row give every window mean without a shuffle. NULL
    predictions are skipped.
    """
    names = epoch_columns(wide.columns)
    epochs = [int(n[7:]) for n in names]
    sums, counts = [F.lit(0.0)], [F.lit(0)]
    prefix = wide
    for i, n in enumerate(names, 1):
        prefix = prefix.withColumns(
            {
                f"_s{i}": sums[-1] + F.coalesce(F.col(n).cast("double"), F.lit(0.0)),
                f"_c{i}": counts[-1] + F.col(n).isNotNull().cast("int"),
            }
        )
        sums.append(F.col(f"_s{i}"))
        counts.append(F.col(f"_c{i}"))
    cases = []
    for i in range(len(epochs)):
        for j in range(i + shortest - 1, len(epochs)):
            total, count = sums[j + 1] - sums[i], counts[j + 1] - counts[i]
            mean = F.when(count > 0, total / count)
            cases.append(
                F.struct(
                    F.lit(epochs[i]).alias("s"), F.lit(epochs[j]).alias("e"), round_half_even(mean).alias("predict")
                )
            )
    return prefix.select(*keys, label, F.inline(F.array(*cases)))


def window_agreement(wide: DataFrame, label: str = "label", shortest: int = 3) -> DataFrame:
    """Kappa of every epoch window per (run, split, item): windows are expanded on the map side and counted
    into cells before the only shuffle."""
    keys = ["run", "split", "qid"]
    rows = window_predictions(wide, keys, label, shortest)
    return agreement(confusion_cells(rows, [*keys, "s", "e"], label, "predict"), [*keys, "s", "e"])


def best_window(scores: DataFrame, digits: int = 12) -> DataFrame:
    """Best window per item over all runs on validation kappa (positive, first run and window on ties), with
    the test kappa of the same run and window."""
    value = F.round("quadratic_kappa", digits)
    sides = scores.groupBy("qid", "run", "s", "e").agg(
        F.max(F.when(F.col("split") == "val", value)).alias("val_kappa"),
        F.max(F.when(F.col("split") == "test", value)).alias("test_kappa"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("val_kappa"), "run", "s", "e")
    best = sides.where(F.col("val_kappa") > 0).withColumn("_r", F.row_number().over(order))
    return best.where(F.col("_r") == 1).select("qid", "run", "s", "e", "val_kappa", "test_kappa")


def rows_of_best_window(wide: DataFrame, best: DataFrame) -> DataFrame:
    """Prediction rows of the chosen run with the chosen window's mean as `avg0` and its rounding as `avg`."""
    names = epoch_columns(wide.columns)
    inside = lambda n: F.lit(int(n[7:])).between(F.col("s"), F.col("e"))
    count = sum(((F.col(n).isNotNull() & inside(n)).cast("int") for n in names), F.lit(0))
    total = sum((F.when(inside(n), F.coalesce(F.col(n), F.lit(0))).otherwise(0) for n in names), F.lit(0))
    rows = wide.join(best.select("qid", "run", "s", "e"), ["qid", "run"])
    rows = rows.withColumn("avg0", F.when(count > 0, total.cast("double") / count))
    return rows.select("run", "split", "id", "qid", "label", "avg0", round_half_even(F.col("avg0")).alias("avg"))


def uncertain(mean: Column, scale: tuple[float, ...] = (1.0, 2.0, 3.0)) -> Column:
    """A mean prediction that is not a whole label."""
    return ~mean.isin(*scale)


def uncertain_coverage(df: DataFrame, unsure: Column, wrong: Column, keys: list[str]) -> DataFrame:
    """How many wrong rows the uncertain rows cover, and how many uncertain rows are wrong, in one pass."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(unsure).alias("n_uncertain"),
        F.count_if(wrong).alias("n_wrong"),
        F.count_if(unsure & wrong).alias("n_both"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counts.select(
        *keys, "n", "n_uncertain", "n_wrong",
        share("n_both", "n_wrong").alias("coverage"),
        share("n_both", "n_uncertain").alias("precision"),
    )
