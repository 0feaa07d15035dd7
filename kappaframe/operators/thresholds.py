"""Thresholds per group that equalise a rate and keep the objective high (Hardt, Price, Srebro 2016)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kappaframe.functions.seeded import MODULUS, mix
from kappaframe.operators.ordering import running_sums
from kappaframe.session import cut_lineage, fresh

SIMPLE_CONSTRAINTS = {
    "demographic_parity": "selection_rate",
    "selection_rate_parity": "selection_rate",
    "true_positive_rate_parity": "true_positive_rate",
    "false_positive_rate_parity": "false_positive_rate",
    "true_negative_rate_parity": "true_negative_rate",
    "false_negative_rate_parity": "false_negative_rate",
}
SIMPLE_OBJECTIVES = (
    "accuracy_score", "balanced_accuracy_score", "selection_rate", "true_positive_rate", "true_negative_rate"
)
SCORE_BUCKETS = 1024


def _metric(name: str, tp: Column, fp: Column) -> Column:
    p, n = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    some = lambda a, b: F.when(b > 0, a / b)
    return {
        "selection_rate": (tp + fp) / (p + n),
        "true_positive_rate": some(tp, p),
        "false_positive_rate": some(fp, n),
        "true_negative_rate": some(n - fp, n),
        "false_negative_rate": some(p - tp, p),
        "accuracy_score": (tp + n - fp) / (p + n),
        "balanced_accuracy_score": (some(tp, p) + some(n - fp, n)) / 2,
    }[name]


def roc_points(
    df: DataFrame, score: str = "score", y: str = "y", group: str = "grp", bucket: Column | None = None
) -> DataFrame:
    """`(grp, score, cum_pos, cum_neg, total_pos, total_neg)`: one point per distinct score of a group, counting
    the rows at or above it.

    Scores are counted first; running sums are taken inside score buckets (equal-width on [0, 1] by
    default, any expression that falls with the score is fine), so a dominant group is spread out.
    """
    if bucket is None:
        bucket = (-F.floor(F.col("score") * SCORE_BUCKETS)).cast("bigint")
    counts = (
        df.where(F.col(group).isNotNull() & F.col(score).isNotNull() & F.col(y).isNotNull())
        .select(F.col(group).cast("string").alias("grp"), F.col(score).cast("double").alias("score"), F.col(y).alias("_y"))
        .groupBy("grp", "score")
        .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))
    )
    return running_sums(counts, ["grp"], F.desc("score"), bucket, ["pos", "neg"]).drop("pos", "neg")


def _plane(x: str, y: str) -> Column:
    """Sign of the area that (positives, negatives) turn into (x, y): every rate is linear in the two counts, so a corner of
    the hull is a corner in whole numbers, up to this sign; 0 where x and y rise together everywhere."""
    at = lambda name, pos, neg: _metric(name, F.lit(float(pos)), F.lit(float(neg)))
    slope = lambda name, pos, neg: at(name, pos, neg) - at(name, 0, 0)
    area = slope(x, 1, 0) * slope(y, 0, 1) - slope(x, 0, 1) * slope(y, 1, 0)
    size = F.abs(slope(x, 1, 0) * slope(y, 0, 1)) + F.abs(slope(x, 0, 1) * slope(y, 1, 0))
    return F.when(F.abs(area) <= size * 1e-12, 0).otherwise(F.signum(area)).cast("int")


def _upper_hull(rows: pd.DataFrame) -> pd.DataFrame:
    """Corners of the upper hull of `(x, y, thr, pos, neg)`, in x order; exact, since turns are taken from the counts.

    Of points with equal x the highest stays, then the smallest threshold.
    """
    rows = rows.sort_values(["x", "y", "thr"], ascending=[True, False, True], kind="stable")
    rows = rows[rows["x"].diff().fillna(1.0) > 1e-15]
    sign = int(rows["sign"].iloc[0])
    pos, neg = rows["pos"].tolist(), rows["neg"].tolist()
    kept: list[int] = []
    for p in range(len(rows)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            turn = (pos[b] - pos[a]) * (neg[p] - neg[a]) - (neg[b] - neg[a]) * (pos[p] - pos[a])
            if turn * sign < 0:
                break
            kept.pop()
        kept.append(p)
    return rows.iloc[kept]


HULL = ["grp", "x", "y", "thr", "pos", "neg", "total_pos", "total_neg", "sign"]
HULL_TYPES = "grp string, x double, y double, thr double, pos bigint, neg bigint, total_pos bigint, total_neg bigint, sign int"
STRIPS = 256


def hull_points(points: DataFrame, x: str, y: str) -> DataFrame:
    """`HULL`: corners of the upper hull of every group's points and of selecting nobody.

    First the highest point of each of STRIPS strips of x is found, natively; a point below the chord between the highest
    points of the strips beside its own is on no hull and goes, still natively. What stays is a running hull per partition and
    group, and only these meet.
    """
    own = points.select("grp", F.col("score").alias("thr"), F.col("cum_pos").alias("pos"), F.col("cum_neg").alias("neg"), "total_pos", "total_neg")
    none = own.groupBy("grp").agg(*[F.max(c).alias(c) for c in ("total_pos", "total_neg")]).select(
        "grp", F.lit(float("inf")).alias("thr"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"), "total_pos", "total_neg"
    )
    rate = lambda name: _metric(name, F.col("pos").cast("double"), F.col("neg").cast("double"))
    every = own.unionByName(none).withColumns({"x": rate(x), "y": rate(y), "sign": _plane(x, y)}).select(*HULL).dropna()
    strip = F.least(F.floor(F.col("x") * STRIPS), F.lit(STRIPS - 1)).cast("int")
    marked = every.withColumn("_s", strip)
    tops = marked.groupBy("grp", "_s").agg(F.max_by(F.struct("x", "y"), F.struct("y", "x")).alias("top"))
    near = Window.partitionBy("grp").orderBy("_s")  # at most STRIPS rows of a group
    chords = tops.select("grp", "_s", F.lag("top").over(near).alias("a"), F.lead("top").over(near).alias("b"))
    chord = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    kept = fresh(marked).join(chords, ["grp", "_s"]).where(F.col("a").isNull() | F.col("b").isNull() | (F.col("y") >= chord - 1e-9))

    def partition_hulls(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hulls: dict[str, pd.DataFrame] = {}
        for part in parts:
            for grp, rows in part.groupby("grp", sort=False):
                hulls[grp] = _upper_hull(pd.concat([hulls[grp], rows]) if grp in hulls else rows)
        yield from hulls.values()

    return kept.select(*HULL).mapInPandas(partition_hulls, HULL_TYPES).groupBy("grp").applyInPandas(_upper_hull, HULL_TYPES)


def _on_grid(hull: DataFrame, grid_size: int) -> DataFrame:
    """`(grp, i, x, y, p0, t0, p1, t1, totals)`: each hull read off at the grid values, as a mix of two thresholds."""

    def interpolate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        hx, hy, ht = (part[c].to_numpy(dtype=float) for c in ("x", "y", "thr"))
        i = np.arange(grid_size + 1)
        x = i / grid_size
        inside = (x >= hx[0] - 1e-12) & (x <= hx[-1] + 1e-12)
        i, x = i[inside], x[inside]
        right = np.clip(np.searchsorted(hx, x, side="left"), 0, len(hx) - 1)
        left = np.maximum(right - 1, 0)
        width = hx[right] - hx[left]
        p1 = np.where(width > 0, (x - hx[left]) / np.where(width > 0, width, 1.0), 1.0)
        p1 = np.clip(p1, 0.0, 1.0)
        return pd.DataFrame(
            {"grp": part["grp"].iloc[0], "i": i, "x": x, "y": (1 - p1) * hy[left] + p1 * hy[right],
             "p0": 1 - p1, "t0": ht[left], "p1": p1, "t1": ht[right],
             "total_pos": part["total_pos"].iloc[0], "total_neg": part["total_neg"].iloc[0]}
        )

    return hull.groupBy("grp").applyInPandas(
        interpolate,
        "grp string, i bigint, x double, y double, p0 double, t0 double, p1 double, t1 double, "
        "total_pos bigint, total_neg bigint",
    )


def fit_thresholds(
    df: DataFrame, constraint: str = "demographic_parity", objective: str = "accuracy_score", grid_size: int = 1000,
    score: str = "score", y: str = "y", group: str = "grp", bucket: Column | None = None,
) -> DataFrame:
    """Rule table `(grp, x, y, p0, t0, p1, t1, p_ignore, p_const)`, one row per group.

    A row of a group is positive with probability `p0 [score >= t0] + p1 [score >= t1]`, mixed for
    equalised odds with the constant `p_const` at probability `p_ignore`. The value of the constrained rate
    is the grid value with the best weighted objective over all groups (smallest on ties). A group whose labels
    are all equal may have no such rate: it does not take part in the choice, `x` and `y` are NULL, and its rule
    is its only label, as a constant.
    """
    odds = constraint == "equalized_odds"
    if not odds and constraint not in SIMPLE_CONSTRAINTS:
        raise ValueError(f"unknown constraint {constraint}")
    if objective not in (("accuracy_score", "balanced_accuracy_score") if odds else SIMPLE_OBJECTIVES):
        raise ValueError(f"objective {objective} does not go with {constraint}")
    x_name, y_name = ("false_positive_rate", "true_positive_rate") if odds else (SIMPLE_CONSTRAINTS[constraint], objective)
    points = cut_lineage(roc_points(df, score, y, group, bucket))
    hull = hull_points(points, x_name, y_name)
    joined = cut_lineage(_on_grid(hull, grid_size))  # grid_size + 1 rows per group
    weight = F.col("total_pos") + F.col("total_neg")
    groups = F.count(F.lit(1)).alias("_g")
    if odds:
        base = joined.groupBy("i", "x").agg(
            F.min("y").alias("_y"), F.sum("total_pos").alias("_p"), F.sum("total_neg").alias("_n"), groups
        )
        if objective == "accuracy_score":
            value = (F.col("_p") * F.col("_y") + F.col("_n") * (1 - F.col("x"))) / (F.col("_p") + F.col("_n"))
        else:
            value = (F.col("_y") + 1 - F.col("x")) / 2
        totals = base.withColumn("value", value)
    else:
        totals = joined.groupBy("i", "x").agg(
            (F.sum(weight * F.col("y")) / F.sum(weight)).alias("value"), F.min("y").alias("_y"), groups
        )
    # a grid value counts when every group can reach it; the grid has at most grid_size + 1 rows
    reach = Window.orderBy(F.desc("_g"), F.desc(F.round("value", 12)), "i")
    best = totals.withColumn("_r", F.row_number().over(reach)).where("_r = 1").select("i", "_y")
    rules = joined.join(best, "i")
    if odds:
        above = F.col("y") - F.col("x")
        ignore = F.when(above > 1e-12, (F.col("y") - F.col("_y")) / above).otherwise(0.0)
        rules = rules.withColumns({"p_ignore": ignore, "p_const": F.col("x")})
    else:
        rules = rules.withColumns({"p_ignore": F.lit(0.0), "p_const": F.lit(0.0)})
    rules = rules.select("grp", "x", "y", "p0", "t0", "p1", "t1", "p_ignore", "p_const")
    totals = points.groupBy("grp").agg(F.max("total_pos").alias("_p"), F.max("total_neg").alias("_n"))
    alone = totals.where("_p = 0 OR _n = 0").join(fresh(joined.select("grp")), "grp", "left_anti")
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    constant = [none.alias("x"), none.alias("y"), *[zero.alias(c) for c in ("p0", "t0", "p1", "t1")]]
    return rules.unionByName(
        alone.select("grp", *constant, F.lit(1.0).alias("p_ignore"), (F.col("_p") > 0).cast("double").alias("p_const"))
    )


def predict_with_thresholds(
    df: DataFrame, rules: DataFrame, id_column: str = "id", score: str = "score", group: str = "grp", seed: int = 0
) -> DataFrame:
    """Adds `p_positive` and the randomised, reproducible prediction `z`."""
    rule = rules.select(F.col("grp").alias("_g"), "p0", "t0", "p1", "t1", "p_ignore", "p_const")
    joined = df.join(rule, F.col(group).cast("string") == F.col("_g"), "left")
    passes = lambda t: (F.col(score) >= F.col(t)).cast("double")
    mixed = F.col("p0") * passes("t0") + F.col("p1") * passes("t1")
    p = F.col("p_ignore") * F.col("p_const") + (1 - F.col("p_ignore")) * mixed
    drawn = mix(F.col(id_column), seed) / F.lit(float(MODULUS))
    return joined.select(*df.columns, p.alias("p_positive"), (drawn < p).cast("int").alias("z"))


def group_rates(df: DataFrame, group: str, y: str, z: str) -> DataFrame:
    """Rates of a 0/1 prediction per group."""
    counts = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(z) == 1).alias("_s"),
        F.count_if((F.col(z) == 1) & (F.col(y) == 1)).alias("_tp"),
        F.count_if(F.col(y) == 1).alias("_p"),
        F.count_if(F.col(z) == F.col(y)).alias("_ok"),
    )
    ratio = lambda a, b: F.try_divide(a, b)
    return counts.select(
        group, "n",
        ratio(F.col("_s"), F.col("n")).alias("selection_rate"),
        ratio(F.col("_tp"), F.col("_p")).alias("true_positive_rate"),
        ratio(F.col("_s") - F.col("_tp"), F.col("n") - F.col("_p")).alias("false_positive_rate"),
        ratio(F.col("_ok"), F.col("n")).alias("accuracy"),
    )


def logistic_scores(df: DataFrame, features: list[str], y: str = "y", regularisation: float = 0.0) -> DataFrame:
    """Adds `score` (probability of 1) and `before` (its 0/1 prediction) from a logistic regression."""
    prepared = df.withColumn("_v", array_to_vector(F.array(*[F.col(f).cast("double") for f in features])))
    model = LogisticRegression(
        featuresCol="_v", labelCol=y, regParam=regularisation, probabilityCol="_p", predictionCol="_z", rawPredictionCol="_r"
    ).fit(prepared)
    scored = model.transform(prepared)
    return scored.withColumns(
        {"score": vector_to_array("_p")[1], "before": F.col("_z").cast("int")}
    ).drop("_v", "_p", "_z", "_r")
