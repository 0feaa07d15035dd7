"""Row numbers and running sums inside a key that never bring the rows of one key together.

A window over a key puts all rows of that key into one task. Here the order is cut into buckets (an
expression that grows with the order): bucket sizes are aggregated, their running sum is taken on that
small table, and the window runs inside (key, bucket) only. The numbering is the same whatever the
buckets are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kappaframe.functions.seeded import slice_of_draw
from kappaframe.session import cut_lineage, shuffle_width

POSITION_BUCKET = 1 << 20


def position_bucket(pos: str, width: int = POSITION_BUCKET) -> Column:
    """Bucket of a unique integer position: at most `width` rows each, whatever the gaps."""
    return F.floor(F.col(pos) / width).cast("bigint")


def draw_slices(df: DataFrame) -> int:
    """Number of slices for hash-ordered numbering: a few per shuffle partition."""
    return 4 * shuffle_width(df.sparkSession)


def _keyed(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(0)]


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    name: str = "rn",
    size: str | None = None,
    first: int | None = None,
) -> DataFrame:
    """1-based row number per key; `first` keeps only that many rows per key and drops later buckets early.

    Keys must not be null. `order` must be total and `bucket` must not decrease along it.
    """
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*_keyed(keys)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_keyed(keys))
    offsets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(whole).alias("_size"),
        )
    )
    if first is not None:
        offsets = offsets.where(F.col("_offset") < first)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    result = rows.join(offsets, [*keys, "_bucket"]).withColumn(
        name, (F.row_number().over(inside) + F.col("_offset")).cast("bigint")
    )
    if first is not None:
        result = result.where(F.col(name) <= first)
    if size is not None:
        result = result.withColumnRenamed("_size", size)
    return result.drop("_bucket", "_offset", "_size")


def numbered_by_draw(
    df: DataFrame, keys: list[str], draw: Column, tie: str, name: str = "rn", size: str | None = None,
    first: int | None = None,
) -> DataFrame:
    """`numbered` in the order of a seeded draw (ties by id)."""
    slices = draw_slices(df)
    rows = df.withColumn("_draw", draw)
    result = numbered(
        rows, keys, [F.col("_draw"), F.col(tie)], slice_of_draw(F.col("_draw"), slices), name, size, first
    )
    return result.drop("_draw")


def running_sums(df: DataFrame, keys: list[str], order: Column, bucket: Column, values: list[str]) -> DataFrame:
    """Adds `cum_<v>` (running sum in order, own row included) and `total_<v>` per key for each value column."""
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*_keyed(keys)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_keyed(keys))
    parts = rows.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    offsets = parts.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(whole).alias(f"total_{v}") for v in values],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = rows.join(offsets, [*keys, "_bucket"])
    sums = {f"cum_{v}": F.sum(v).over(inside) + F.col(f"_o_{v}") for v in values}
    return joined.withColumns(sums).drop("_bucket", *[f"_o_{v}" for v in values])


def with_order(df: DataFrame, order: Column, bucket: Column) -> DataFrame:
    """Adds `_order` (any orderable value, unique per key) and its `_bucket`."""
    return df.withColumns({"_order": order, "_bucket": bucket})


def bucket_sizes(rows: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """`(keys, _bucket, _k, extra)`, written once: ranks and their places are all worked out on this small table."""
    return cut_lineage(rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_k"), *extra))


def after_ranks(rows: DataFrame, keys: list[str], sizes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Adds `_after`: how many of the ranks `r0 ... r<width-1>` (from `wanted`, one row per key) a row comes after.

    No row is moved for this. The bucket sizes tell which buckets hold the wanted ranks; only the rows of
    these are numbered, which gives the order value at each rank; then every row is compared with the few
    values of its key where it is. The table of values has one row per key; it is written, so that Spark knows
    its size and broadcasts it below `spark.sql.autoBroadcastJoinThreshold`.
    """
    before = Window.partitionBy(*_keyed(keys)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select(*keys, "_bucket", "_k", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_offset"))
    asked = wanted.select(*keys, F.posexplode(F.array(*[F.col(f"r{i}") for i in range(width)])).alias("_i", "_r"))
    inside_bucket = (F.col("_r") > F.col("_offset")) & (F.col("_r") <= F.col("_offset") + F.col("_k"))
    held = placed.join(asked, keys).where(inside_bucket).groupBy(*keys, "_bucket", "_offset")
    targets = cut_lineage(held.agg(F.collect_list(F.struct("_i", "_r")).alias("_asked")))
    ranked = rows.select(*keys, "_bucket", "_order").join(targets, [*keys, "_bucket"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_order")
    ranked = ranked.withColumn("_rank", F.row_number().over(inside) + F.col("_offset"))
    hits = ranked.select(*keys, "_order", "_rank", F.inline("_asked")).where("_rank = _r").groupBy(*keys)
    at = [F.max(F.when(F.col("_i") == i, F.col("_order"))).alias(f"_c{i}") for i in range(width)]
    values = cut_lineage(hits.agg(*at))
    # rank 0 has no row and so no value: every row comes after it
    after = [F.coalesce((F.col("_order") > F.col(f"_c{i}")).cast("int"), F.lit(1)) for i in range(width)]
    joined = rows.join(values, keys, "left")
    return joined.withColumn("_after", sum(after[1:], after[0])).drop(
        "_order", "_bucket", *[f"_c{i}" for i in range(width)]
    )


def running_total(df: DataFrame, order: list[str], totals: dict[str, str]) -> DataFrame:
    """`df` with a column per entry of `totals`, new name to summed column: the sum over all rows before in the order of
    `order`, whose values are distinct.

    Rows are dealt out by sampled ranges of the order; a range adds up its own rows, and the driver adds up one number per
    range, so no task sees all rows.
    """
    held = cut_lineage(df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()))
    sums = [F.sum(value).alias(name) for name, value in totals.items()]
    rows = {r["_range"]: r for r in held.groupBy("_range").agg(*sums).collect()}  # a row per range
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = held
    for name, value in totals.items():
        kind = df.schema[value].dataType
        starts, so_far = [], 0
        for i in range(max(rows, default=-1) + 1):
            starts.append(so_far)
            so_far += rows[i][name] or 0 if i in rows else 0
        start = F.get(F.array(*[F.lit(x) for x in starts] or [F.lit(0)]), F.col("_range"))
        inner = F.coalesce(F.sum(value).over(own), F.lit(0))
        out = out.withColumn(name, (start + inner).cast("double" if kind.typeName() in ("double", "float") else "bigint"))
    return out.drop("_range")
