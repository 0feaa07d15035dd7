"""Agreement between two raters, always computed from confusion cells.

A response table is reduced to `(keys, truth, predicted, n)` first: the rows are counted on the map side,
so the shuffle carries cells and a dominant item costs no more than a small one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaframe.constants import REGRADE_CODES, SCORE_CODES
from kappaframe.functions.labels import label_digits, lookup, reduce_by_evidence

ALL_ITEMS = "ALL"


def confusion_cells(df: DataFrame, keys: list[str], truth: Column | str, predicted: Column | str) -> DataFrame:
    """`(keys, truth, predicted, n)`; rows with a null key, truth or prediction are left out."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    cells = df.select(*keys, as_column(truth).alias("truth"), as_column(predicted).alias("predicted"))
    return (
        cells.dropna(subset=[*keys, "truth", "predicted"])
        .groupBy(*keys, "truth", "predicted")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pool_items(cells: DataFrame, item: str, pools: dict[str, list[str]], overall: bool = True) -> DataFrame:
    """Adds pooled report groups on the cells: a pool takes every item whose id contains one of its marks."""
    members: list[Column] = [F.col(item)]
    for name, marks in pools.items():
        hit = reduce(lambda a, b: a | b, [F.col(item).contains(m) for m in marks])
        members.append(F.when(hit, F.lit(name)))
    if overall:
        members.append(F.lit(ALL_ITEMS))
    others = [c for c in cells.columns if c not in (item, "n")]
    return (
        cells.withColumn(item, F.explode(F.array_compact(F.array(*members))))
        .groupBy(item, *others)
        .agg(F.sum("n").alias("n"))
    )


def agreement(cells: DataFrame, keys: list[str], scale: str = "index", clamp_negative: bool = False) -> DataFrame:
    """`n, accuracy, kappa, quadratic_kappa` per key.

    One confusion matrix per key is gathered (bounded by the label set) and reduced with array functions.
    `scale='index'` weighs by the rank of a label among the labels seen by either rater, `scale='value'`
    by the label itself. A zero denominator gives NULL; `clamp_negative` lifts a negative kappa to 0.01.
    """
    gathered = cells.groupBy(*keys).agg(
        F.collect_list(F.struct("truth", "predicted", F.col("n").cast("double").alias("n"))).alias("c"),
        F.sum("n").cast("bigint").alias("n"),
    )
    labels = F.array_sort(
        F.array_distinct(
            F.concat(F.transform("c", lambda x: x["truth"]), F.transform("c", lambda x: x["predicted"]))
        )
    )
    gathered = gathered.withColumn("labels", labels)
    if scale == "index":
        at = lambda x: F.array_position("labels", x).cast("double")
    elif scale == "value":
        at = lambda x: x.cast("double")
    else:
        raise ValueError("scale must be 'index' or 'value'")
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda acc, x: acc + f(x))
    marginal = lambda side, l: total(F.filter("c", lambda x: x[side] == l), lambda x: x["n"])
    n = F.col("n").cast("double")
    sums = gathered.select(
        *keys,
        "n",
        total("c", lambda x: F.when(x["truth"] == x["predicted"], x["n"]).otherwise(0.0)).alias("_hit"),
        total("labels", lambda l: marginal("truth", l) * marginal("predicted", l)).alias("_chance"),
        total("c", lambda x: x["n"] * F.pow(at(x["truth"]) - at(x["predicted"]), 2.0)).alias("_d2"),
        total("c", lambda x: x["n"] * (F.pow(at(x["truth"]), 2.0) + F.pow(at(x["predicted"]), 2.0))).alias("_s2"),
        total("c", lambda x: x["n"] * at(x["truth"])).alias("_st"),
        total("c", lambda x: x["n"] * at(x["predicted"])).alias("_sp"),
    )
    po, pe = F.col("_hit") / n, F.col("_chance") / (n * n)
    spread = F.col("_s2") - 2.0 * F.col("_st") * F.col("_sp") / n
    kappa = F.when(pe < 1.0, (po - pe) / (1.0 - pe))
    quadratic = F.when(spread > 1e-12, 1.0 - F.col("_d2") / spread)
    if clamp_negative:
        kappa = F.when(kappa < 0, F.lit(0.01)).otherwise(kappa)
        quadratic = F.when(quadratic < 0, F.lit(0.01)).otherwise(quadratic)
    return sums.select(*keys, "n", po.alias("accuracy"), kappa.alias("kappa"), quadratic.alias("quadratic_kappa"))


def accuracy(truth: str, predicted: str) -> Column:
    """Aggregate expression for use in any `agg`."""
    return F.avg((F.col(truth) == F.col(predicted)).cast("double"))


def regime_columns(regime: int) -> tuple[Column, Column]:
    """Truth and prediction of a label regime: 0 plain, 1 detailed labels by digit, 2 reduced with evidence."""
    if regime == 0:
        return F.col("label").cast("int"), F.col("predict").cast("int")
    if regime == 1:
        return label_digits(F.col("label")), label_digits(F.col("predict"))
    if regime == 2:
        return F.col("eval_label").cast("int"), reduce_by_evidence(label_digits(F.col("predict")), F.col("est_score"))
    raise ValueError("regime must be 0, 1 or 2")


def regime_agreement(df: DataFrame, keys: list[str], regime: int) -> DataFrame:
    """Agreement in a label regime; a negative kappa is lifted to 0.01 in the plain regime only."""
    truth, predicted = regime_columns(regime)
    return agreement(confusion_cells(df, keys, truth, predicted), keys, clamp_negative=regime == 0)


def long_metrics(scores: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Wide scores to `(keys, metric, value)` with prefixed metric names."""
    names = ["accuracy", "kappa", "quadratic_kappa"]
    pairs = [F.struct(F.lit(prefix + m).alias("metric"), F.col(m).alias("value")) for m in names]
    return scores.select(*keys, F.inline(F.array(*pairs)))


def itemwise_scores(df: DataFrame, split: str, item: str, truth: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Long metrics per split and item (and `keys`, such as the run), with `MACRO` (mean over items) and `POOLED` (all rows)
    added per split.

    Metric names carry the split as prefix.
    """
    by = [*(keys or []), split]
    cells = confusion_cells(df, [*by, item], truth, predicted)
    pooled = cells.withColumn(item, F.lit("POOLED")).groupBy(*by, item, "truth", "predicted").agg(F.sum("n").alias("n"))
    per_item = agreement(cells.unionByName(pooled), [*by, item])
    macro = per_item.where(F.col(item) != "POOLED").groupBy(*by).agg(
        F.lit("MACRO").alias(item),
        F.sum("n").alias("n"),
        *[F.avg(m).alias(m) for m in ("accuracy", "kappa", "quadratic_kappa")],
    )
    both = per_item.unionByName(macro)
    return long_metrics(both, [*by, item]).withColumn("metric", F.concat_ws("_", F.col(split), F.col("metric")))


def parsed_score_agreement(df: DataFrame, keys: list[str]) -> DataFrame:
    """Strict and relaxed agreement of scores parsed from completions (`pred` vs `label`, first digit vs plain score)."""
    relaxed = F.when(F.col("pred") == "-1", F.col("pred")).otherwise(F.substring("pred", 1, 1))
    pairs = F.array(
        F.struct(F.lit("strict").alias("mode"), F.col("label").alias("t"), F.col("pred").alias("p")),
        F.struct(F.lit("relaxed").alias("mode"), F.col("score_to_predict").alias("t"), relaxed.alias("p")),
    )
    cells = df.groupBy(*keys, "label", "pred", "score_to_predict").agg(F.count(F.lit(1)).alias("m"))
    both = cells.select(*keys, "m", F.inline(pairs)).groupBy(*keys, "mode", "t", "p").agg(F.sum("m").alias("n"))
    both = both.select(*keys, "mode", F.col("t").alias("truth"), F.col("p").alias("predicted"), "n")
    return agreement(both.dropna(), [*keys, "mode"])


def regrade_agreement(predictions: DataFrame, regraded: DataFrame) -> DataFrame:
    """Plain kappa of new human grades against the old label and against the model, on rows graded again."""
    grade = lookup(REGRADE_CODES, F.col("grade"))
    joined = predictions.join(regraded.select("id", grade.alias("regrade")), "id")
    cells = joined.groupBy("regrade", "label", "predict").agg(F.count(F.lit(1)).alias("m"))
    pairs = F.array(
        F.struct(F.lit("label").alias("against"), F.col("label").cast("int").alias("p")),
        F.struct(F.lit("model").alias("against"), F.col("predict").cast("int").alias("p")),
    )
    both = cells.select("regrade", "m", F.inline(pairs)).groupBy("against", "regrade", "p").agg(F.sum("m").alias("n"))
    both = both.select("against", F.col("regrade").alias("truth"), F.col("p").alias("predicted"), "n")
    return agreement(both.dropna(), ["against"]).select("against", "n", "accuracy", "kappa")


def score_code(code: Column) -> Column:
    """Completion score code to label; unknown codes are kept."""
    return F.coalesce(lookup(SCORE_CODES, code), code)
