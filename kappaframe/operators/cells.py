"""Cells around pivots, for work on all vectors of an item within a distance: a vector visits only the cells that can hold
something near enough (triangle inequality). Cells larger than a block are split, so a task sees two blocks at a time.

All distances are between unit vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kappaframe.functions.seeded import mix_text
from kappaframe.session import cut_lineage, fresh

BLOCK = 2048
CELL = 2048
CARRIED = ("copies", "core")  # optional columns that travel with a vector


def vector_key(vector: Column) -> Column:
    """128-bit name of a vector: equal vectors share it, so copies meet without a join on the array."""
    return F.concat_ws("-", F.hex(F.xxhash64(vector)), F.hex(F.xxhash64(F.lit(7), vector)))


def unit_rows(table: pa.Table, column: str) -> np.ndarray:
    """Matrix of the list column with rows scaled to length 1 (zero rows stay zero); raises on null or ragged vectors."""
    lists = table.column(column).combine_chunks()
    if lists.null_count or len(lists.value_lengths().unique()) > 1:
        raise ValueError("vectors that are null or of several lengths cannot be compared; leave them out first")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths > 0, lengths, 1.0)


def chord(sim: np.ndarray) -> np.ndarray:
    """Distance of unit vectors from their cosine."""
    return np.sqrt(np.maximum(2.0 - 2.0 * sim, 0.0))


def distinct_vectors(df: DataFrame, item: str, vector: str) -> DataFrame:
    """`(item, vid, vec, copies)`: one row per distinct vector of an item."""
    keyed = df.select(item, vector_key(F.col(vector)).alias("vid"), F.col(vector).alias("vec"))
    return keyed.groupBy(item, "vid").agg(F.any_value("vec").alias("vec"), F.count(F.lit(1)).cast("bigint").alias("copies"))


def _salts(df: DataFrame, item: str, block: int) -> DataFrame:
    """`(item, _salts)`: into how many blocks the rows of each item go. One row per item."""
    return fresh(df.groupBy(item).agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias("_salts")))


def _salted(df: DataFrame, item: str, salts: DataFrame) -> DataFrame:
    """Adds `_salt`, so that (item, _salt) holds about a block of rows."""
    return df.join(salts, item).withColumn("_salt", F.pmod(F.xxhash64("vid"), F.col("_salts"))).drop("_salts")


def _to_every_salt(df: DataFrame, item: str, salts: DataFrame) -> DataFrame:
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))
    return df.join(salts, item).withColumn("_salt", every).drop("_salts")


def pivots_of(vectors: DataFrame, item: str, cell: int = CELL) -> DataFrame:
    """`(item, pid, pvec)`: enough hash-chosen vectors per item for cells of about `cell` rows."""
    counts = vectors.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.select(
        item, (F.ceil(F.col("_n") / cell) / F.col("_n")).alias("_share"), "_n"
    )
    draw = mix_text(F.col("vid"), 3)
    # over-draw by share, then keep the first of each item in draw order: only a sample is ranked
    likely = vectors.join(fresh(share), item).where(
        draw < F.lit(2147483647) * F.least(F.lit(1.0), F.col("_share") * 4 + 64.0 / F.col("_n"))
    )
    order = Window.partitionBy(item).orderBy(draw, "vid")
    ranked = likely.withColumn("_r", F.row_number().over(order))
    kept = ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.round(F.col("_share") * F.col("_n"))))
    return kept.select(item, F.col("vid").alias("pid"), F.col("vec").alias("pvec"))


def assign_cells(vectors: DataFrame, pivots: DataFrame, item: str, block: int = BLOCK) -> DataFrame:
    """`(item, vid, vec, cell, dist)`: nearest pivot of every vector, computed block by block."""
    salts = _salts(vectors, item, block)
    kept = [item, "vid", "vec", *[c for c in CARRIED if c in vectors.columns]]
    left = _salted(vectors.select(*kept), item, salts)
    right = _to_every_salt(pivots, item, salts)

    def nearest_pivot(rows: pa.Table, centres: pa.Table) -> pa.Table:
        out = rows.select(kept)
        if rows.num_rows == 0 or centres.num_rows == 0:
            return out.slice(0, 0).append_column("cell", pa.array([], pa.string())).append_column(
                "dist", pa.array([], pa.float64())
            )
        d = chord(unit_rows(rows, "vec") @ unit_rows(centres, "pvec").T)
        best = d.argmin(axis=1)
        names = np.array(centres.column("pid").to_pylist(), dtype=object)
        out = out.append_column("cell", pa.array(names[best].tolist(), pa.string()))
        return out.append_column("dist", pa.array(d[np.arange(len(best)), best]))

    schema = ", ".join([*[_field(vectors, c) for c in kept], "cell string", "dist double"])
    return left.groupBy(item, "_salt").cogroup(fresh(right).groupBy(item, "_salt")).applyInArrow(nearest_pivot, schema)


def _field(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def visit_cells(queries: DataFrame, cells: DataFrame, item: str, radius: float, block: int = BLOCK) -> DataFrame:
    """`(item, vid, vec, [payload], cell)`: the packs of cells that can hold something within `radius` of each query,
    each once.

    `cells` holds `(item, cell, pvec, n, r, pack)`; the packs are named `cell` in the result.
    """
    salts = _salts(queries, item, block)
    kept = [item, "vid", "vec", *[c for c in CARRIED if c in queries.columns]]
    left = _salted(queries.select(*kept), item, salts)
    right = _to_every_salt(cells, item, salts)

    def choose(rows: pa.Table, centres: pa.Table) -> pa.Table:
        out = rows.select(kept)
        if rows.num_rows == 0 or centres.num_rows == 0:
            return out.slice(0, 0).append_column("cell", pa.array([], pa.string()))
        d = chord(unit_rows(rows, "vec") @ unit_rows(centres, "pvec").T)
        reach = d - np.array(centres.column("r").to_pylist(), dtype=float)[None, :]
        packs = np.array(centres.column("pack").to_pylist(), dtype=object)
        order = np.argsort(packs, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], packs[order][1:] != packs[order][:-1]]))
        at, pack = np.nonzero(np.logical_or.reduceat(reach[:, order] <= radius + 1e-9, first, axis=1))
        return out.take(pa.array(at)).append_column("cell", pa.array(packs[order[first]][pack].tolist(), pa.string()))

    fields = [_field(queries, c) for c in kept]
    return left.groupBy(item, "_salt").cogroup(fresh(right).groupBy(item, "_salt")).applyInArrow(
        choose, ", ".join([*fields, "cell string"])
    )


def block_pairs(visits: DataFrame, members: DataFrame, item: str, block: int = BLOCK):
    """Cogrouped (visitors, members) of every cell, both cut into blocks: one task step sees two blocks."""
    key = [item, "cell"]
    n_members = members.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias("_mb"))
    n_visits = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias("_vb"))
    # one row per cell: the blocks of its members and of its visitors
    grid = fresh(n_members.join(n_visits, key))
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    slot = lambda c: F.pmod(F.xxhash64(F.col("vid"), F.lit(11)), F.col(c))
    left = visits.join(grid, key).withColumn("_v", slot("_vb")).withColumn("_m", spread("_mb")).drop("_mb", "_vb")
    right = members.join(grid, key).withColumn("_m", slot("_mb")).withColumn("_v", spread("_vb")).drop("_mb", "_vb")
    by = [*key, "_v", "_m"]
    return left.groupBy(*by).cogroup(fresh(right).groupBy(*by))


def cell_table(members: DataFrame, pivots: DataFrame, item: str) -> DataFrame:
    """`(item, cell, pvec, n, r)`: size and radius of each cell that has members."""
    stats = members.groupBy(item, "cell").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.max("dist").alias("r")
    )
    return stats.join(pivots.withColumnRenamed("pid", "cell"), [item, "cell"])


def pack_cells(pivots: DataFrame, item: str, cell: int, block: int = BLOCK) -> DataFrame:
    """`(item, cell, pack)`: cells around nearby pivots go together into packs of about a block of rows, so that a vector
    is sent once to a pack however many of its cells it reaches. Cells of about a block are packs of their own."""
    if 2 * cell > block:
        return pivots.select(item, F.col("pid").alias("cell"), F.col("pid").alias("pack"))
    centres = pivots.select(item, F.col("pid").alias("vid"), F.col("pvec").alias("vec"))
    placed = assign_cells(centres, cut_lineage(pivots_of(centres, item, block // cell)), item, block)
    return cut_lineage(placed.select(item, F.col("vid").alias("cell"), F.col("cell").alias("pack")))
