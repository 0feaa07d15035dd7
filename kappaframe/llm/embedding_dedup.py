"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

A rotation is learned on a bounded sample so that the signs of the rotated, centred vectors are balanced and lose
little (alternating signs and an orthogonal fit). The code is cut into substrings, each the key of one table; two
vectors are compared where they share a key in some table. Substrings get longer with the logarithm of the number of
vectors, and as many tables are used as keep the share of found links at the threshold at RECALL, measured on pairs
made from the sample; several rotations serve when one code is too short. Equal vectors are one point with a weight.

Tables reduce to counts, so buckets of one point are never shuffled; large buckets are split into chunks, and each pair
of chunks is a task of its own. A pair that shares several tables counts in the first. Tasks give link counts and one
link per point to the smallest point of its component among the task's links, no pairs. Pairs too near the threshold for
sums of doubles are decided in extended precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaframe.operators.components import components
from kappaframe.session import written

SAMPLE = 8_000  # vectors that rotations are learned on, at most
RECALL = 0.93
PAIRS = 1_000  # made pairs of each kind that the number of tables is measured on, at most
DENSE = 16
CHUNK = 1024
DEEP, LARGE = 32, 4  # buckets of more than DEEP chunks have chunks LARGE times as large, so that rows are copied fewer times
VISITS = 4096  # points of a task's group, about


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Bits per table and number of tables for `n` vectors: buckets of a few points, and at the threshold a share
    RECALL of links found (a bit differs with probability angle / pi)."""
    bits = max(16, math.ceil(math.log2(max(n, 2))))
    hit = (1 - math.acos(min(cosine, 1.0)) / math.pi) ** bits
    return bits, 1 if hit >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - hit))


def learned_rotation(x: np.ndarray, width: int, seed: int, rounds: int = 30) -> np.ndarray:
    """Projection to `width` signs by iterative quantisation of the rows of `x` (centred)."""
    draw = np.random.default_rng(seed)
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :width]
    v = x @ basis
    turn = np.linalg.qr(draw.normal(size=(width, width)))[0]
    for _ in range(rounds):
        signs = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ v)
        turn = (left @ right).T
    return basis @ turn


def _beside(x: np.ndarray, cosine: float) -> list[np.ndarray]:
    """For unit rows two partners each at exactly `cosine`: in a direction drawn at random, and towards another row."""
    draw = np.random.default_rng(1)
    out = []
    for step in (draw.normal(size=x.shape), x[draw.permutation(len(x))] + 1e-6 * draw.normal(size=x.shape)):
        step = step - (step * x).sum(axis=1, keepdims=True) * x
        step /= np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-300)
        out.append(cosine * x + math.sqrt(max(1 - cosine**2, 0.0)) * step)
    return out


def measured_plan(x: np.ndarray, n: int, cosine: float) -> tuple[int, int, np.ndarray, list[np.ndarray]]:
    """Bits per table, number of tables, what is taken off each vector, and rotations, by unit rows `x` of a sample.

    Centring widens angles, so tables are added to those of `plan` until a share RECALL of the sample's made pairs at
    the threshold meets in one. Where DENSE times as many are not enough, less of the mean is taken off; without
    centring the angles are those of `plan`, and tables are added until the share is reached."""
    bits, least = plan(n, cosine)
    width, mean = x.shape[1], x.mean(axis=0)
    some = x[:PAIRS]
    pairs = _beside(some, cosine) if width > 1 and cosine < 1 else []
    for share in (1.0, 0.5, 0.0):
        middle, tables = share * mean, least
        turns: list[np.ndarray] = []
        while True:
            while len(turns) * width < bits * tables:
                seed = len(turns)
                # further turns are drawn: learned ones may resemble one another
                drawn = seed * width >= bits * least
                turns.append(np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0] if drawn else learned_rotation(x - middle, width, seed))
            turn = np.concatenate(turns, axis=1)[:, : bits * tables]
            met = np.ones(tables)
            for other in pairs:
                same = ((some - middle) @ turn >= 0) == ((other - middle) @ turn >= 0)
                meets = same.reshape(len(some), tables, bits).all(axis=2)
                met = np.minimum(met, np.logical_or.accumulate(meets, axis=1).mean(axis=0))
            enough = np.flatnonzero(met >= RECALL)
            if len(enough):
                tables = max(least, int(enough[0]) + 1)
                return bits, tables, middle, turns[: math.ceil(bits * tables / width)]
            if share and tables >= DENSE * least:
                break
            tables *= 2


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    return column.flatten().to_numpy().reshape(-1, width)


def vectors_of(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """`(vec_id, vec, ok)`: `ok` where the vector has components, all finite and not all zero."""
    vec = F.col(f"`{vector_column}`").cast("array<double>")
    usable = F.coalesce(
        vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(vec, lambda v: v != 0), F.lit(False),
    )
    return df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), vec.alias("vec"), usable.alias("ok"))


def _coded(rotations: list[np.ndarray], middle: np.ndarray, bits: int, tables: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"))
            unit = x / np.abs(x).max(axis=1, keepdims=True)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]
            exact = np.ldexp(x, -exponent)  # a power of two is taken off, so no digit changes
            signs = np.concatenate([(unit - middle) @ r >= 0 for r in rotations], axis=1)[:, : bits * tables]
            keys = signs.reshape(len(x), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            offsets = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("pid"), batch.column("w"), pa.array([v.tobytes() for v in exact], pa.binary()),
                 pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["pid", "w", "vec", "keys"])

    return task


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of `a` and `b`, worked out in extended precision and rounded to double."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    return ((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))).astype(np.float64)


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Takes the links `x`-`y` into `root`, which holds the smallest place of every place's component."""
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _linked(cosine: float, table: int, keys: np.ndarray, pid: np.ndarray, w: np.ndarray, vectors: np.ndarray, units: np.ndarray, mine, theirs):
    """Weighted link counts of the points (ascending by `pid`) at `mine` and `theirs` that first share `table`, and the
    smallest point of each one's component over these links."""
    slack = 4 * (vectors.shape[1] + 16) * np.finfo(np.float64).eps
    same = mine is theirs
    count, root = np.zeros(len(pid), dtype=np.int64), np.arange(len(pid))
    for a in range(0, len(mine), 256):
        i = mine[a : a + 256]
        near = units[i] @ units[theirs].T
        r, c = np.nonzero(near >= cosine - slack)
        x, y = i[r], theirs[c]
        keep = x < y if same else x != y
        x, y, told = x[keep], y[keep], near[r[keep], c[keep]]
        if not len(x):
            continue
        first = (keys[x, :table] != keys[y, :table]).all(axis=1)
        x, y, told = x[first], y[first], told[first]
        close = np.flatnonzero(told <= cosine + slack)
        for at in np.split(close, range(CHUNK, len(close), CHUNK)):
            told[at] = _cosines(vectors[x[at]], vectors[y[at]])
        x, y = x[told >= cosine], y[told >= cosine]
        np.add.at(count, x, w[y])
        np.add.at(count, y, w[x])
        _joined(root, x, y)
    some = np.flatnonzero(count)
    return pid[some], count[some], pid[root[some]]


def _compared(cosine: float):
    def task(group: pa.Table) -> pa.Table:
        names = ("t", "key", "c1", "c2", "pid", "w", "c")
        t, key, c1, c2, pid, w, c = (group.column(x).to_numpy() for x in names)
        vectors = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64).reshape(len(pid), -1)
        keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(pid), -1)
        units = _unit(vectors)
        order = np.lexsort((pid, c2, c1, key, t))
        ids = np.stack([t[order], key[order], c1[order], c2[order]])
        edges = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        found = []
        for visit in np.split(order, edges):
            if len(visit) > 1:
                i = visit[0]
                mine = np.flatnonzero(c[visit] == c1[i])
                theirs = mine if c1[i] == c2[i] else np.flatnonzero(c[visit] == c2[i])
                found.append(_linked(cosine, int(t[i]), keys[visit], pid[visit], w[visit], vectors[visit], units[visit], mine, theirs))
        out = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        return pa.table({"pid": out[0], "n": out[1], "b": out[2]})

    return task


def _chunks(m: Column) -> Column:
    """Chunks of a bucket of `m` points."""
    return F.ceil(m / F.when(m > DEEP * CHUNK, LARGE * CHUNK).otherwise(CHUNK)).cast("int")


def shards_of(full: DataFrame) -> int:
    """Groups for the buckets `(m)` of `full`: every point is sent once for each chunk of its bucket."""
    sent = full.agg(F.sum(F.col("m") * _chunks(F.col("m")))).first()[0] or 0
    return max(1, math.ceil(sent / VISITS))


def near_duplicates(
    df: DataFrame, cosine: float = 0.95, sample: int = SAMPLE, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)`, a row for each row of `df`.

    Two vectors link when their cosine, rounded to double precision, is `cosine` or more and they share a table's key; `n_links`
    counts the other rows linked directly, `component_id` is the smallest id reachable, `kept` marks it. Vectors that are
    null, empty or zero, or that hold a null, NaN or infinite component, link with nothing, and vectors link only with
    vectors of their own length. Rows of equal vectors link with one another. Rows with a null id keep it and never
    name a component that has other members. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors_of(df, id_column, vector_column)
    keyed = rows.withColumn("pid", F.when(F.col("ok"), F.xxhash64("vec")))
    last = F.lit((1 << 63) - 1)
    points = written(
        keyed.where("ok").groupBy("pid").agg(
            F.count(F.lit(1)).alias("w"), F.min(F.coalesce("vec_id", last)).alias("least"), F.any_value("vec").alias("vec")
        ).withColumn("width", F.size("vec")), "points",
    )
    edges = counts = None
    for row in points.groupBy("width").count().collect():  # one row per length of vectors
        width, n = row["width"], row["count"]
        own = points.where(F.col("width") == width)
        some = own.orderBy("pid").limit(sample).select("vec").collect()
        x = np.array([r.vec for r in some], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        bits, tables, middle, turns = measured_plan(x, n, cosine)
        coded = written(
            own.select("pid", "w", "vec").mapInArrow(_coded(turns, middle, bits, tables), "pid long, w long, vec binary, keys array<long>"), "codes"
        )
        spots = coded.select("pid", F.posexplode("keys").alias("t", "key"))
        full = written(spots.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "full")
        chunks = _chunks(F.col("m"))
        dealt = spots.join(full, ["t", "key"]).withColumn("c", F.pmod(F.xxhash64("pid", F.lit(1)), chunks).cast("int"))
        others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(F.col("c"), j).alias("c1"), F.greatest(F.col("c"), j).alias("c2")))
        visits = dealt.select("pid", "t", "key", "c", F.explode(others).alias("p")).select("pid", "t", "key", "c", "p.c1", "p.c2")
        # some thousand points to a task's group, by the counted visits; one pair of chunks stays together
        shard = F.pmod(F.xxhash64("t", "key", "c1", "c2"), F.lit(shards_of(full)))
        found = written(
            visits.join(coded, "pid").groupBy(shard.alias("shard")).applyInArrow(_compared(cosine), "pid long, n long, b long"), "links"
        )
        edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        edges = rows.sparkSession.createDataFrame([], "pid long, n long, b long")
    counts = edges.groupBy("pid").agg(F.sum("n").alias("n"))
    comps = components(edges.select(F.col("pid").alias("a"), "b")).withColumnRenamed("vid", "pid")
    placed = points.select("pid", "w", "least").join(comps, "pid", "left").withColumn("comp", F.coalesce("comp", "pid"))
    names = placed.groupBy("comp").agg(F.min("least").alias("name"))
    told = placed.join(names, "comp").join(counts, "pid", "left").select(
        "pid", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("links"), "name"
    )
    out = keyed.select("vec_id", "pid").join(told, "pid", "left")
    name = F.coalesce(F.when(F.col("name") != last, F.col("name")), "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"),
        F.coalesce(F.col("vec_id") == name, F.lit(True)).alias("kept"),
    )
