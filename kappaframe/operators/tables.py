"""Row sets by id, unions, copies, label numbers, and profiles of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kappaframe.operators.ordering import running_total


def keep_ids(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def upsert(df: DataFrame, replacement: DataFrame, on: str = "id") -> DataFrame:
    """Rows of `replacement` take the place of rows with the same id."""
    return df.join(replacement.select(on), on, "left_anti").unionByName(replacement, allowMissingColumns=True)


def apply_corrections(df: DataFrame, corrections: DataFrame, current: str, on: str = "id") -> DataFrame:
    """Adds `modified`: the human score where one was given, the current one elsewhere."""
    fixes = corrections.select(on, F.col("score").alias("_score"))
    joined = df.join(fixes, on, "left")
    return joined.withColumn("modified", F.coalesce(F.col("_score"), F.col(current)).cast("int")).drop("_score")


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each fully equal row; copies collapse before the shuffle."""
    return df.dropDuplicates()


def union_of_ids(frames: list[DataFrame], on: str = "id") -> DataFrame:
    result = frames[0].select(on)
    for frame in frames[1:]:
        result = result.unionByName(frame.select(on))
    return result.distinct()


def stack_versions(old: DataFrame, new: DataFrame, label: str = "label1") -> DataFrame:
    """Two versions of a table in one, the old one's labels prefixed `o_`."""
    marked = old.withColumn(label, F.concat(F.lit("o_"), F.col(label).cast("string")))
    return marked.unionByName(new.withColumn(label, F.col(label).cast("string")), allowMissingColumns=True)


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels numbered from 0, however many there are."""
    labels = df.where(F.col(label).isNotNull()).select(label).distinct().withColumn("_one", F.lit(1))
    return running_total(labels, [label], {"label_id": "_one"}).drop("_one")


def label_shares(df: DataFrame, item: str, label: str) -> DataFrame:
    """Count and share of every label within its item."""
    counts = df.dropna(subset=[item, label]).groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(item)))


def level_counts(df: DataFrame, groups: list[str]) -> DataFrame:
    """Distinct levels per attribute. Level combinations are reduced first, so no attribute is shuffled whole."""
    pairs = [F.struct(F.lit(g).alias("attr"), F.col(g).cast("string").alias("level")) for g in groups]
    levels = df.select(*groups).distinct().select(F.inline(F.array(*pairs))).distinct()
    return levels.groupBy("attr").agg(F.count("level").alias("n_levels"))


def answer_distribution(df: DataFrame, correct: Column, keys: list[str]) -> DataFrame:
    """How often each recoded answer occurs among rows graded correct."""
    return df.where(correct).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def selection_profile(df: DataFrame, keys: list[str], answer: Column) -> DataFrame:
    """Per key: share of rows without a selection, with the right one (1, 2 and 4 struck), with another one,
    and with option 3 kept."""
    empty = answer.isNull() | (answer == "0")
    right = ~empty & answer.contains("1") & answer.contains("2") & answer.contains("4")
    wrong = ~empty & ~right
    partial = ~empty & ~answer.contains("3")
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(c).alias(a) for c, a in ((empty, "_e"), (right, "_r"), (wrong, "_w"), (partial, "_p"))],
    )
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    return counts.select(
        *keys, "n",
        share("_e").alias("no_selection"), share("_r").alias("right"),
        share("_w").alias("wrong"), share("_p").alias("partial"),
    )


def useful_fields(raw: DataFrame, item: str, pos: str, missing: str = "NA") -> DataFrame:
    """Columns that hold a value in the first row of each item, as `(item, position, field)`."""
    names = [c for c in raw.columns if c != pos]
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)) for c in names])
    first = raw.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(
        F.min_by(cells, F.col(pos)).alias("cells")
    )
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("field"), F.col("cells").alias("cell"))
    exploded = first.select("item", F.posexplode(pairs).alias("position", "p"))
    kept = exploded.where(F.col("p.cell") != missing)
    return kept.select("item", F.col("position").cast("bigint").alias("position"), F.col("p.field").alias("field"))


def metrics_with_items(metrics: DataFrame, items: DataFrame) -> DataFrame:
    """Metric table with item name and type, joined on the item parsed out of the metric name."""
    return metrics.join(items.select("item", "name", "type"), "item", "left")


def fit_share(reduced: DataFrame, whole: DataFrame) -> DataFrame:
    """Row count of a reduced table, of the whole one, and their ratio."""
    a = reduced.agg(F.count(F.lit(1)).alias("n_reduced"))
    b = whole.agg(F.count(F.lit(1)).alias("n_all"))
    both = a.join(b, F.lit(True))
    return both.select("n_reduced", "n_all", F.try_divide(F.col("n_reduced"), F.col("n_all")).alias("share"))
