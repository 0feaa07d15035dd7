"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers floor(SCALE * x). Vectors are packed once into chunks: for every dimension the integers that
occur in the chunk, and for every vector the places of its integers among them (two bytes each). A round tabulates, for
each dimension, occurring integer and centroid, the squared difference; distances are gathers from these tables and sums.
The chunks stay where they are: a task sends one row of sums per chunk and centroid, and the centroids (k rows) are all
that the driver holds. All arithmetic is on integers and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaframe.session import discard, written

SCALE, WIDTH, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
CHUNK = 4096  # vectors of a chunk; places among its integers fit two bytes
LARGEST = 1 << 27  # integers beyond it could push a squared distance over 64 bits


def usable(vector: Column, width: int = WIDTH) -> Column:
    """Exactly `width` components, none null, NaN or infinite; false for a null vector."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & ~bad, F.lit(False))


def integers(lists: pa.ListArray, width: int) -> np.ndarray:
    """`(n, width)` of floor(SCALE * component). Raises where a squared distance might not fit 64 bits."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} have squared distances that do not fit a long")
    return scaled.astype(np.int64)


def packed_chunk(ids: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
    values, places, sizes = [], np.empty(numbers.shape, np.uint16), []
    for d in range(numbers.shape[1]):
        occurring, place = np.unique(numbers[:, d], return_inverse=True)
        values.append(occurring)
        places[:, d] = place
        sizes.append(len(occurring))
    whole = [np.concatenate(values), places, np.array(sizes, np.int32)]
    return pa.RecordBatch.from_arrays(
        [pa.array([ids.to_pylist()], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in whole]],
        names=["ids", "occurring", "places", "sizes"],
    )


class Chunk:
    """A packed chunk as read back: vectors as places among the occurring integers of each dimension."""

    def __init__(self, row: dict, width: int):
        self.ids = row["ids"]
        self.sizes = np.frombuffer(row["sizes"], np.int32)
        self.occurring = np.frombuffer(row["occurring"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        # places count through the integers of all dimensions, so one table serves all of them
        self.places = np.frombuffer(row["places"], np.uint16).reshape(-1, width).astype(np.int64) + self.starts

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """`(n, k)` squared distances: one gather per dimension from the table of the chunk."""
        own = np.repeat(centroids.T, self.sizes, axis=0)
        table = (self.occurring[:, None] - own) ** 2
        total = np.zeros((len(self.places), len(centroids)), np.int64)
        for d in range(self.places.shape[1]):
            total += table[self.places[:, d]]
        return total

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest number of a nearest centroid, and its distance."""
        far = self.distances(centroids)
        cluster = far.argmin(axis=1)
        return cluster, far[np.arange(len(cluster)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> Iterator[tuple[int, int, list[int]]]:
        for c in range(k):
            mine = self.places[cluster == c]
            if len(mine):
                yield c, len(mine), [int(self.occurring[mine[:, d]].sum()) for d in range(mine.shape[1])]


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Chunk]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Chunk(row, width)


def packed(vectors: DataFrame, id_column: str, vector_column: str, width: int = WIDTH) -> DataFrame:
    """The usable vectors as a written table of chunks."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), vector.alias("vector")).where(usable(F.col("vector"), width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                yield packed_chunk(part.column("id"), integers(part.column("vector"), width))

    return written(kept.mapInArrow(pack, "ids array<long>, occurring binary, places binary, sizes binary"), "chunks")


def first_centroids(vectors: DataFrame, id_column: str, vector_column: str, k: int, seed: int, width: int = WIDTH) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id; null ids come last, equal ids in the order of their components."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_column}`").cast("long").cast("string")), 256)
    rows = vectors.select(name.alias("h"), vector.alias("v")).where(usable(F.col("v"), width))
    first = rows.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return integers(pa.array([r.v for r in first], pa.list_(pa.float64())), width)


def moved(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of the means, empty ones as they were."""
    k, width = centroids.shape

    def round_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, width):
            rows = list(chunk.sums(chunk.nearest(centroids)[0], k))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                names=["cluster", "n", "total"],
            )

    sums = chunks.mapInArrow(round_sums, "cluster int, n long, total array<long>")
    exact = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"t{d}") for d in range(width)]
    after = centroids.copy()
    for row in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # k rows at most
        after[row["cluster"]] = [int(row[f"t{d}"]) // row["n"] for d in range(width)]
    return after


def clusters(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """`(vec_id, cluster, distance)` of every usable vector, written, and the final centroids.

    Vectors that are null, of another length or with null or non-finite components are left out. With fewer than `k`
    vectors there are as many centroids as vectors; an empty table gives no rows and no centroids. Repeated rows and ids
    are vectors of their own; ties go to the smaller centroid; null ids are clustered too but start as centroids last.
    Components beyond LARGEST / SCALE raise. Other columns are not read.
    """
    centroids = first_centroids(vectors, id_column, vector_column, k, seed, width)
    chunks = packed(vectors, id_column, vector_column, width)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(chunks, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, width):
            cluster, distance = chunk.nearest(centroids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.ids, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    out = written(chunks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    discard(chunks)
    return out, centroids


def centroid_name(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`assigned` with the inertia of the cluster and of all, and the hash of the centroid: constants of k clusters."""
    sums = {r["cluster"]: int(r["t"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("t")).collect()}
    number = F.col("cluster")
    pick = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), number)
    return assigned.select(
        "vec_id", "cluster", "distance", pick([sums.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), pick([centroid_name(c) for c in centroids], "string").alias("centroid_sha256"),
    )
