"""Labelled examples for a response: few-shot sets, oversampling, training pairs.

Drawing n examples per label by comparing every row with its item would pair all rows. Instead the pool of
each (item, label) is numbered in hash order, every query computes which slots it takes, and one equi-join
on (item, label, slot) fetches them: the work grows with rows times n, and slots are hit evenly even when
one item holds most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaframe.constants import LOWEST_LABELS, OVERSAMPLED_ITEMS
from kappaframe.functions.seeded import MODULUS, mix
from kappaframe.operators.ordering import numbered_by_draw
from kappaframe.session import cut_lineage


def _slot_join(queries: DataFrame, pool: DataFrame, keys: list[str], slot: str) -> DataFrame:
    return queries.join(pool, [*keys, slot])


def few_shot(
    df: DataFrame, n: int, keys: list[str] | None = None, label: str = "label", id_column: str = "id",
    payload: tuple[str, ...] = ("text",), seed: int = 0, same_label: bool = False,
) -> DataFrame:
    """`(query_id, keys, label, example_id, position, payload)`: n examples per label of the key for every row.

    A row is never its own example; a pool with no more than n other rows is taken whole. With `same_label`
    five times as many are drawn from the row's own label only. Add an attribute level to `keys` to draw
    from the same group.
    """
    keys = keys or ["qid"]
    rows = df.dropna(subset=[*keys, label])
    pool = numbered_by_draw(rows, [*keys, label], mix(id_column, seed), id_column, "_rn", size="_m")
    pool = pool.select(
        *keys, label, F.col(id_column).alias("example_id"), *payload, (F.col("_rn") - 1).alias("_slot"), "_m"
    )
    draw = mix(F.col("query_id"), seed + 1)
    queries = pool.select(
        *keys, F.col(label).alias("_own"), F.col("example_id").alias("query_id"), F.col("_slot").alias("_self")
    )
    if same_label:
        n = 5 * n
        sizes = cut_lineage(rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_m")))
        wanted = queries.withColumn(label, F.col("_own")).join(sizes, [*keys, label])
    else:
        # one row per key with its few labels; the size of the table is checked before it is broadcast
        pairs = F.collect_list(F.struct(F.col(label), F.col("_m")))
        sizes = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_m"))
        pools = cut_lineage(sizes.groupBy(*keys).agg(pairs.alias("_pools")))
        wanted = queries.join(pools, keys)
        wanted = wanted.select(*keys, "_own", "query_id", "_self", F.inline("_pools"))
    start = draw % F.col("_m")
    own = F.col("_own") == F.col(label)
    # distance of the row's own slot from its start; its own slot is stepped over
    ahead = F.when(own, F.pmod(F.col("_self") - start, F.col("_m"))).otherwise(F.col("_m"))
    others = F.when(own, F.col("_m") - 1).otherwise(F.col("_m"))
    take = F.least(others, F.lit(n))
    steps = F.transform(
        F.when(take > 0, F.sequence(F.lit(0).cast("bigint"), take - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda j: F.when(j >= F.col("_ahead"), j + 1).otherwise(j),
    )
    wanted = wanted.withColumns({"_start": start, "_ahead": ahead}).withColumn("_steps", steps)
    wanted = wanted.select(*keys, label, "query_id", "_start", "_m", F.posexplode("_steps").alias("position", "_j"))
    wanted = wanted.select(
        *keys, label, "query_id", "position", ((F.col("_start") + F.col("_j")) % F.col("_m")).alias("_slot")
    )
    return _slot_join(wanted, pool.drop("_m"), [*keys, label], "_slot").select(
        "query_id", *keys, label, "example_id", F.col("position").cast("bigint").alias("position"), *payload
    )


def example_lists(
    examples: DataFrame, line: Column, order: list[Column] | None = None, shuffle_seed: int | None = None
) -> DataFrame:
    """`(query_id, examples)`: the example lines of each query in order, or shuffled by a seeded key.

    A query holds at most n lines per label, so the gathered list is short.
    """
    if shuffle_seed is not None:
        order = [mix(F.col("example_id") + F.col("query_id") * 7, shuffle_seed), F.col("example_id")]
    order = order or [F.col("label"), F.col("position")]
    entry = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], line.alias("line"))
    gathered = examples.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return gathered.select("query_id", F.transform("e", lambda x: x["line"]).alias("examples"))


def oversample(
    df: DataFrame, seed: int = 0, probability: float = 0.1, id_column: str = "id", item: str = "qid",
    label: str = "label", payload: tuple[str, ...] = ("text",), plan: dict[str, list[str]] | None = None,
    lowest: list[str] | None = None,
) -> DataFrame:
    """Every row of a listed item with a lowest label is replaced, with the given probability, by a random row
    of the same item whose label is on the item's list.

    Output: `(id, qid, source_id, label, payload, replaced)`. Only the replaced rows are joined.
    """
    plan = OVERSAMPLED_ITEMS if plan is None else plan
    lowest = LOWEST_LABELS if lowest is None else lowest
    eligible = F.col(item).isin(list(plan)) & F.col(label).isin(lowest)
    coin = mix(F.col(id_column), seed) / F.lit(float(MODULUS)) > 1.0 - probability
    flagged = F.coalesce(eligible & coin, F.lit(False))
    listed = F.lit(False)
    for key, labels in plan.items():
        listed = listed | ((F.col(item) == key) & F.col(label).isin(labels))
    pool = numbered_by_draw(
        df.where(listed), [item], mix(F.col(id_column), seed + 1), id_column, "_rn", size="_m"
    ).select(
        item, (F.col("_rn") - 1).alias("_slot"), F.col(id_column).alias("source_id"), F.col(label).alias("_label"),
        *[F.col(p).alias(f"_{p}") for p in payload],
    )
    sizes = df.where(listed).groupBy(item).agg(F.count(F.lit(1)).alias("_m"))
    chosen = (
        df.where(flagged)
        .join(sizes, item, "left")
        .withColumn("_slot", mix(F.col(id_column), seed + 2) % F.col("_m"))
        .join(pool, [item, "_slot"], "left")
    )
    swapped = chosen.select(
        id_column, item,
        F.coalesce("source_id", id_column).alias("source_id"),
        F.coalesce("_label", label).alias(label),
        *[F.coalesce(f"_{p}", p).alias(p) for p in payload],
        F.col("source_id").isNotNull().cast("int").alias("replaced"),
    )
    kept = df.where(~flagged).select(
        id_column, item, F.col(id_column).alias("source_id"), label, *payload, F.lit(0).alias("replaced")
    )
    return kept.unionByName(swapped)


def training_pairs(candidates: DataFrame, seed: int = 0) -> DataFrame:
    """One partner per query from its ordered candidates `(query_id, query_label, example_id, label, position)`.

    With even odds the last candidate of the same label, else the first of another label; when there is
    none, a random candidate. `target` is 1 for equal labels.
    """
    same = F.col("label") == F.col("query_label")
    partner = F.struct("example_id", "label")
    position = F.struct("position", "label", "example_id")
    by_draw = F.struct(mix(F.col("example_id") + F.col("query_id") * 7, seed + 1), F.col("example_id"))
    found = candidates.groupBy("query_id", "query_label").agg(
        F.max_by(F.when(same, partner), F.when(same, position)).alias("_same"),
        F.min_by(F.when(~same, partner), F.when(~same, position)).alias("_other"),
        F.min_by(partner, by_draw).alias("_any"),
    )
    wants_same = mix(F.col("query_id"), seed) / F.lit(float(MODULUS)) > 0.5
    pick = F.coalesce(F.when(wants_same, F.col("_same")).otherwise(F.col("_other")), F.col("_any"))
    chosen = found.select("query_id", "query_label", pick.alias("p"))
    return chosen.select(
        "query_id", "query_label",
        F.col("p.example_id").alias("partner_id"), F.col("p.label").alias("partner_label"),
        (F.col("p.label") == F.col("query_label")).cast("int").alias("target"),
    )
