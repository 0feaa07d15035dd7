"""Most similar rows within an item, exactly.

Exact search (`nearest`) scans 8-bit codes of the item's distinct vectors block by block (`operators/scan.py`), so a vector
that fills a third of an item costs as much as a rare one, and works for vectors that lie in no clusters.

Sampled search (`sampled_nearest`) is the variant with a fixed number of candidates per label, drawn once.

`sim` is the cosine, rounded to scan.DIGITS digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kappaframe.operators.scan import best_vectors, names
from kappaframe.operators.splits import sample_per_key


def nearest(
    queries: DataFrame, pool: DataFrame, k: int, item: str = "qid", id_column: str = "id", vector: str = "emb", apart: str | None = None,
) -> DataFrame:
    """Edges `(item, query_id, neighbor_id, rank, sim)`: the k most similar pool rows of every query within its
    item, never the row itself; equal similarities are ordered by id. The whole pool is searched, exactly.

    `apart` names a construct column: rows that share the query's construct are not neighbours. Rows without an item are in
    no pool and have no neighbours.
    """
    need = k + 1  # room for the row itself
    own = F.lit(0).cast("bigint") if apart is None else F.xxhash64(F.coalesce(F.col(apart).cast("string"), F.lit("")))

    def keyed(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(item).isNotNull())
        return rows.select(item, F.col(id_column).alias("id"), F.col(vector).alias("vec"), own.alias("own"))

    p = keyed(pool)
    q = p if queries is pool else keyed(queries)
    best, wide = best_vectors(q, p, item, need, apart is not None)
    key = [item, "va", "vb", "own"]
    ranked = Window.partitionBy(*key).orderBy(F.desc("sim"), "neighbor_id")
    named = best.select(*key, F.explode("ids").alias("neighbor_id"), "sim").withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= need)
    entry = F.struct(F.col("_r"), F.col("neighbor_id"), F.col("sim"))
    lists = named.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    rows = q.select(item, F.col("id").alias("query_id"), *names(F.col("vec").cast(wide)), "own")
    return _edges(rows.join(lists, key), item, k)


def _edges(joined: DataFrame, item: str, k: int) -> DataFrame:
    others = F.slice(F.filter("e", lambda x: x["neighbor_id"] != F.col("query_id")), 1, k)
    rows = joined.select(item, "query_id", F.posexplode(others).alias("_p", "n"))
    return rows.select(
        item, "query_id", F.col("n.neighbor_id").alias("neighbor_id"), (F.col("_p") + 1).cast("int").alias("rank"),
        F.col("n.sim").alias("sim"),
    )


def candidates_per_label(
    pool: DataFrame, per_label: int, item: str = "qid", label: str = "label1", id_column: str = "id", seed: int = 0
) -> DataFrame:
    """At most `per_label` rows of every (item, label), drawn once per run by id hash."""
    return sample_per_key(pool, [item, label], per_label, id_column, seed)


def sampled_nearest(
    queries: DataFrame, pool: DataFrame, k: int, per_label: int = 500, item: str = "qid", label: str = "label1",
    id_column: str = "id", vector: str = "emb", seed: int = 0,
) -> DataFrame:
    """`nearest` over the sampled candidates: one bounded pool per item meets the queries block by block."""
    return nearest(queries, candidates_per_label(pool, per_label, item, label, id_column, seed), k, item, id_column, vector)


def neighbour_labels(edges: DataFrame, pool: DataFrame, label: str = "label1", id_column: str = "id") -> DataFrame:
    """`(query_id, label, n)`: label histogram of each query's neighbours."""
    labels = pool.select(F.col(id_column).alias("neighbor_id"), F.col(label).alias("label"))
    return edges.join(labels, "neighbor_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))


def label_maps(histogram: DataFrame) -> DataFrame:
    """Histogram rows to one map per query (at most k entries)."""
    pairs = F.sort_array(F.collect_list(F.struct("label", "n")))
    return histogram.groupBy("query_id").agg(F.map_from_entries(pairs).alias("label_counts"))


def label_mix_change(
    before: DataFrame, after: DataFrame, pool: DataFrame, label: str = "label1", id_column: str = "id"
) -> DataFrame:
    """Neighbour label counts under two embeddings: `(query_id, label, n_before, n_after)`."""
    a = neighbour_labels(before, pool, label, id_column).withColumnRenamed("n", "n_before")
    b = neighbour_labels(after, pool, label, id_column).withColumnRenamed("n", "n_after")
    return a.join(b, ["query_id", "label"], "full").fillna(0, ["n_before", "n_after"])


def reduce_by_uncertainty(
    queries: DataFrame, unsure_ids: list[DataFrame], pool: DataFrame, k: int, **options
) -> DataFrame:
    """Ids worth keeping: the uncertain rows and, in the training pool, the neighbours of `queries`."""
    edges = nearest(queries, pool, k, **options)
    kept = edges.select(F.col("neighbor_id").alias("id"))
    for frame in unsure_ids:
        kept = kept.unionByName(frame.select("id"))
    return kept.distinct()


def reduce_by_label(
    rows: DataFrame, pools: dict[str, DataFrame], k: int, query_labels: list[str], train_labels: list[str],
    label: str = "label1", id_column: str = "id", **options,
) -> DataFrame:
    """`(query_id, split, neighbors)` for rows with a query label: neighbours per split; on the training split
    only neighbours with a training label stay. Lists are per row and ordered by rank."""
    queries = rows.where(F.col(label).isin(query_labels))
    parts = []
    for split, pool in pools.items():
        edges = nearest(queries, pool, k, id_column=id_column, **options)
        if split == "train":
            allowed = pool.where(F.col(label).isin(train_labels)).select(F.col(id_column).alias("neighbor_id"))
            edges = edges.join(allowed, "neighbor_id", "left_semi")
        parts.append(edges.withColumn("split", F.lit(split)))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    ranked = F.sort_array(F.collect_list(F.struct("rank", "neighbor_id")))
    lists = stacked.groupBy("query_id", "split").agg(ranked.alias("e"))
    return lists.select("query_id", "split", F.transform("e", lambda x: x["neighbor_id"]).alias("neighbors"))
