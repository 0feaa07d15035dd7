"""Clusters and maps of embeddings: density clusters, k-means, mixtures, two-dimensional maps, and what the
clusters hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kappaframe.operators.cells import (
    BLOCK,
    CELL,
    assign_cells,
    block_pairs,
    cell_table,
    chord,
    distinct_vectors,
    pack_cells,
    pivots_of,
    unit_rows,
    vector_key,
    visit_cells,
)
from kappaframe.operators.components import components
from kappaframe.operators.ordering import numbered
from kappaframe.session import cut_lineage, fresh, spread

NOISE = -1


def _near(rows: pa.Table, others: pa.Table, eps: float) -> np.ndarray:
    return chord(unit_rows(rows, "vec") @ unit_rows(others, "vec").T) <= eps


def _neighbour_weight(visits: DataFrame, members: DataFrame, item: str, eps: float, block: int) -> DataFrame:
    """`(item, vid, weight)`: rows within eps of each distinct vector, itself and its copies included."""

    def count(rows: pa.Table, others: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or others.num_rows == 0:
            return pa.table([rows.column(item).slice(0, 0), pa.array([], pa.string()), pa.array([], pa.int64())],
                            names=[item, "vid", "w"])
        copies = others.column("copies").to_numpy()
        weight = _near(rows, others, eps).astype(np.int64) @ copies
        return pa.table([rows.column(item), rows.column("vid"), pa.array(weight)], names=[item, "vid", "w"])

    kind = visits.schema[item].dataType.simpleString()
    parts = block_pairs(visits, members, item, block).applyInArrow(count, f"`{item}` {kind}, vid string, w bigint")
    return parts.groupBy(item, "vid").agg(F.sum("w").alias("weight"))


def _links(visits: DataFrame, cores: DataFrame, item: str, eps: float, block: int) -> DataFrame:
    """`(item, vid, core, rep)`: each visitor with one core vector per local component it touches.

    The components of the eps graph between two blocks are found in the task, so a dense block gives one
    link per vector and not one per pair.
    """

    def local(rows: pa.Table, others: pa.Table) -> pa.Table:
        names = [item, "vid", "core", "rep"]
        if rows.num_rows == 0 or others.num_rows == 0:
            return pa.table(
                [rows.column(item).slice(0, 0), pa.array([], pa.string()), pa.array([], pa.bool_()),
                 pa.array([], pa.string())], names=names)
        near = _near(rows, others, eps)
        core = np.array(rows.column("core").to_pylist(), dtype=bool)
        big = others.num_rows
        label = np.arange(big)
        while True:
            # smallest label reachable over a core visitor
            over = np.where(near & core[:, None], label[None, :], big).min(axis=1)
            back = np.where(near & core[:, None], over[:, None], big).min(axis=0)
            fresh = np.minimum(label, back)
            if (fresh == label).all():
                break
            label = fresh
        theirs = others.column("vid").to_pylist()
        mine = rows.column("vid").to_pylist()
        at, rep = [], []
        for i in range(rows.num_rows):
            for component in np.unique(label[near[i]]):
                at.append(i)
                rep.append(theirs[component])
        # a member joined to another one only through a visitor keeps that tie
        tied = np.nonzero(label != np.arange(big))[0]
        whole = pa.concat_tables([rows.select([item]), others.select([item])])
        at += [rows.num_rows + int(j) for j in tied]
        mine = mine + theirs
        core = np.concatenate([core, np.ones(big, dtype=bool)])
        rep += [theirs[j] for j in label[tied]]
        return pa.table(
            [whole.column(item).take(pa.array(at, pa.int64())), pa.array([mine[i] for i in at], pa.string()),
             pa.array(core[at] if at else [], pa.bool_()), pa.array(rep, pa.string())], names=names)

    kind = visits.schema[item].dataType.simpleString()
    return block_pairs(visits, cores, item, block).applyInArrow(
        local, f"`{item}` {kind}, vid string, core boolean, rep string"
    )


def connected_components(edges: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """`(key, vid, comp)`: smallest node name of the component of every node, over `(key, a, b)` edges."""
    linked = components(edges, key)
    return nodes.select(*key, "vid").join(linked, [*key, "vid"], "left").withColumn("comp", F.coalesce("comp", "vid"))


def density_clusters(
    df: DataFrame, eps: float = 0.3, min_samples: int = 10, item: str = "qid", id_column: str = "id",
    vector: str = "emb", cell: int = CELL, block: int = BLOCK,
) -> DataFrame:
    """`(item, id, core, c_label)`: density clusters per item on unit vectors, noise is -1.

    A row with at least `min_samples` rows within eps (itself included) is a core; cores within eps share a
    cluster; other rows join the lowest-numbered cluster with a core within eps. Clusters are numbered from 0
    per item by their smallest id. Equal vectors are handled as one weighted vector, and no pair of rows is
    ever written out: blocks give neighbour counts and local components.
    """
    rows = df.where(F.col(item).isNotNull()).select(
        item, F.col(id_column).alias("id"), F.col(vector).alias("vec"), vector_key(F.col(vector)).alias("vid")
    )
    vectors = cut_lineage(distinct_vectors(rows, item, "vec"))
    pivots = cut_lineage(pivots_of(vectors, item, cell))
    members = cut_lineage(assign_cells(vectors, pivots, item, block))
    packs = pack_cells(pivots, item, cell, block)
    cells = cell_table(members, pivots, item).join(packs, [item, "cell"])

    def visits_to(visitors: DataFrame, homes: DataFrame) -> DataFrame:
        reached = cells.join(homes.select(item, "home").distinct().withColumnRenamed("home", "cell"), [item, "cell"], "left_semi")
        return visit_cells(visitors, reached, item, eps, block)

    members = members.join(fresh(packs), [item, "cell"]).withColumnsRenamed({"cell": "home", "pack": "cell"})
    weight = _neighbour_weight(visits_to(vectors, members), members, item, eps, block)
    cores = cut_lineage(weight.select(item, "vid", (F.col("weight") >= min_samples).alias("core")))
    members = members.join(cores, [item, "vid"])
    marked = vectors.join(cores, [item, "vid"])
    core_members = members.where("core")
    links = cut_lineage(_links(visits_to(marked, core_members), core_members, item, eps, block))
    edges = links.where("core").select(item, F.col("vid").alias("a"), F.col("rep").alias("b"))
    comps = connected_components(edges, cores.where("core"), [item])
    # number clusters by their smallest row id
    ids = rows.select(item, "vid", "id")
    first = ids.groupBy(item, "vid").agg(F.min("id").alias("first_id"))
    starts = comps.join(first, [item, "vid"]).groupBy(item, "comp").agg(F.min("first_id").alias("first_id"))
    number = (F.row_number().over(Window.partitionBy(item).orderBy("first_id")) - 1).cast("bigint")
    names = starts.select(item, "comp", number.alias("c_label"))
    core_names = comps.join(names, [item, "comp"]).select(item, "vid", "c_label")
    border = (
        links.where("NOT core").join(core_names.withColumnRenamed("vid", "rep"), [item, "rep"])
        .groupBy(item, "vid").agg(F.min("c_label").alias("c_label"))
    )
    named = core_names.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    labelled = ids.join(named, [item, "vid"], "left")
    return labelled.select(
        item, "id", F.coalesce("core", F.lit(False)).cast("int").alias("core"),
        F.coalesce("c_label", F.lit(NOISE)).cast("bigint").alias("c_label"),
    )


def cluster_sizes(clusters: DataFrame, keys: list[str]) -> DataFrame:
    return clusters.groupBy(*keys, "c_label").agg(F.count(F.lit(1)).alias("n"))


def cluster_summary(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Number of clusters, of noise rows and of rows per key."""
    sizes = cluster_sizes(clusters, keys)
    return sizes.groupBy(*keys).agg(
        F.count_if(F.col("c_label") != NOISE).alias("n_clusters"),
        F.sum(F.when(F.col("c_label") == NOISE, F.col("n")).otherwise(0)).alias("n_noise"),
        F.sum("n").alias("n_rows"),
    )


def cluster_rank(clusters: DataFrame, label: str = "c_label", per_page: int = 5) -> DataFrame:
    """Clusters by size with the page they fall on. Sizes are numbered per power of two, so even very many
    clusters are never ranked in one task."""
    sizes = clusters.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    bucket = (-F.floor(F.log2(F.col("n").cast("double")))).cast("bigint")
    ranked = numbered(sizes, [], [F.desc("n"), F.col(label)], bucket, "rank")
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / per_page).cast("bigint"))


def top_tokens(df: DataFrame, cluster: str, text: str, k: int = 50) -> DataFrame:
    """The k most frequent words of every cluster (ties in word order)."""
    words = spread(df.select(cluster, text)).select(cluster, F.explode(F.split(F.lower(text), "[^\\p{L}\\p{N}_]+")).alias("token"))
    counts = words.where(F.col("token") != "").groupBy(cluster, "token").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(cluster).orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def k_means(df: DataFrame, vector: str, k: int = 2, seed: int = 0) -> DataFrame:
    """Adds `cluster`."""
    prepared = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(prepared)
    return model.transform(prepared).drop("_v")


def _project(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Adds `_p`: the first k principal components, fitted on all rows."""
    prepared = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(prepared).transform(prepared).drop("_v")


def gaussian_mixture(df: DataFrame, vector: str, components: int = 20, dims: int = 4, seed: int = 0) -> DataFrame:
    """Adds `cluster` and `membership` (probability of the chosen component), fitted on a few principal components."""
    projected = _project(df, vector, dims)
    model = GaussianMixture(
        k=components, seed=seed, featuresCol="_p", predictionCol="cluster", probabilityCol="_m"
    ).fit(projected)
    return model.transform(projected).withColumn("membership", F.array_max(vector_to_array("_m"))).drop("_p", "_m")


def plane_map(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """`(keep, x, y)`: two-dimensional map of all rows."""
    placed = _project(df, vector, 2).withColumn("_xy", vector_to_array("_p"))
    return placed.select(*keep, F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y"))
