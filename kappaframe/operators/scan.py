"""Exact nearest vectors of an item by a certified scan of 8-bit codes.

Equal vectors are one vector with its first ids. The vectors of an item are dealt out to blocks, and every vector gets a code of
one byte per component with the length of what the code leaves out, so the cosine of two vectors is known from their codes up
to a proven bound. Four steps follow:

* scan: every pair of blocks meets once, as codes. Per query only vectors whose upper bound reaches the k-th best lower bound
  of the pair stay; a query with very many of them in a block asks for the whole block instead;
* merge: the lower bounds of all blocks of a query are put together, and what cannot reach their k-th best goes;
* rerank: queries travel to the blocks of their remaining candidates, as whole vectors, and meet them in double precision;
* the best k of each query are kept by similarity and then by id.

What is shuffled is codes (bytes) for every pair of blocks, whole vectors only for the candidates. A block is bounded in bytes,
a task holds two of them, and nothing depends on how an item's vectors lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from kappaframe.session import arrow_rows, discard, fresh, written

BLOCK_BYTES = 8 << 20  # codes of a block
PART = 4096  # vectors of a part: blocks are stored and merged part by part
TILE = 128  # queries that meet a block at once
FIRST = 8192  # vectors of a block that give a first bound
LISTED = 16  # candidates of a query and block are listed up to so many times k
DIGITS = 12
SLACK = 1e-9
GRID = 1 << 14  # bounds are kept in steps of 1 / GRID, rounded outwards


def names(vector: Column) -> list[Column]:
    """128 bits that stand for a vector: equal vectors share them."""
    return [F.xxhash64(vector).alias("va"), F.xxhash64(F.lit(7), vector).alias("vb")]


def unit(flat: np.ndarray, width: int) -> np.ndarray:
    """Rows of length 1 in double precision; zero rows stay zero."""
    rows = flat.reshape(-1, width).astype(np.float64)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1.0)


def squeezed(rows: np.ndarray) -> bytes:
    """Numbers as bytes of equal rank side by side, so that signs and exponents compress."""
    planes = np.ascontiguousarray(rows).view(np.uint8).reshape(-1, rows.dtype.itemsize).T
    return rows.nbytes.to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def expanded(value: bytes, numbers: np.dtype, width: int) -> np.ndarray:
    size = int.from_bytes(value[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(value[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(numbers.itemsize, -1).T).view(numbers).reshape(-1, width)


def coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and the lengths of what the codes leave out, rounded up."""
    scale = np.abs(rows).max(axis=1, initial=0.0) / 127
    scale[scale == 0] = 1.0
    codes = np.rint(rows / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(rows - codes * scale[:, None], axis=1)
    return codes, scale, rest * (1 + SLACK) + SLACK


def _packed(item: str, kind: str, k: int):
    """Packs the distinct vectors of a block into parts, in the order of their first ids."""

    def pack(block: pa.Table) -> pa.Table:
        block = block.sort_by("first")
        lists = block.column("vec").combine_chunks()
        widths = lists.value_lengths().unique()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if lists.null_count or len(widths) != 1 or not np.isfinite(flat).all():
            raise ValueError("vectors that are null, not finite or of several lengths cannot be compared; leave them out first")
        width = widths[0].as_py()
        codes, scale, rest = coded(unit(flat, width))
        raw = flat.reshape(-1, width)
        out = []
        for part, at in enumerate(range(0, block.num_rows, PART)):
            rows = slice(at, at + PART)
            some = block.slice(at, PART)
            names_ = np.stack([some.column(c).to_numpy() for c in ("va", "vb", "own")])
            out.append({
                item: block.column(item)[0].as_py(), "b": block.column("b")[0].as_py(), "part": part, "width": width, "ids": some.column("ids").to_pylist(),
                "names": names_.tobytes(), "raw": squeezed(raw[rows]), "codes": codes[rows].tobytes(),
                "scale": scale[rows].tobytes(), "rest": rest[rows].tobytes(),
            })
        columns = list(out[0])
        types = {item: block.schema.field(item).type, "b": pa.int64(), "part": pa.int32(), "width": pa.int32(), "ids": pa.list_(block.schema.field("ids").type)}
        return pa.table([pa.array([r[c] for r in out], types.get(c, pa.binary())) for c in columns], names=columns)

    schema = f"`{item}` {kind}, b bigint, part int, width int, ids array<array<{{}}>>, names binary, raw binary, codes binary, scale binary, rest binary"
    return pack, schema


def blocks(rows: DataFrame, item: str, k: int) -> DataFrame:
    """The vectors `(item, id, vec, own)` as written parts of blocks. `ids` are the first `k` ids of each distinct vector;
    vectors with unlike `own` are told apart."""
    keyed = rows.select(f"`{item}`", "id", "vec", *names(F.col("vec")), "own")
    key = [item, "va", "vb", "own"]
    # of a vector that repeats, a task sends at most k rows on
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("_r") <= k)
    distinct = written(
        ranked.groupBy(*key).agg(F.any_value("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")), "distinct"
    )
    per_block = F.greatest(F.lit(PART), F.floor(F.lit(BLOCK_BYTES) / F.greatest(F.max(F.size("vec")), F.lit(1)) / PART) * PART)
    sizes = written(distinct.groupBy(item).agg(F.ceil(F.count(F.lit(1)) / per_block).cast("bigint").alias("n")), "sizes")
    dealt = distinct.join(sizes, item)
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64(F.lit(5), "va", "vb"), F.col("n"))).withColumn("first", F.get("ids", F.lit(0))).drop("n")
    kind = rows.schema[item].dataType.simpleString()
    pack, schema = _packed(item, kind, k)
    schema = schema.format(rows.schema["id"].dataType.simpleString())
    out = written(dealt.groupBy(item, "b").applyInArrow(pack, schema), "blocks")
    discard(distinct)
    return out


class Codes:
    """The codes of a block, its parts in order."""

    def __init__(self, parts: pa.Table):
        rows = sorted(parts.to_pylist(), key=lambda r: r["part"])
        self.parts = [r["part"] for r in rows]
        self.sizes = [len(r["scale"]) // 8 for r in rows]
        codes = np.concatenate([np.frombuffer(r["codes"], np.int8) for r in rows]).reshape(-1, rows[0]["width"])
        scale, self.rest = (np.concatenate([np.frombuffer(r[c]) for r in rows]) for c in ("scale", "rest"))
        self.rows = codes.astype(np.float32) * scale.astype(np.float32)[:, None]
        self.own = np.concatenate([np.frombuffer(r["names"], np.int64).reshape(3, -1)[2] for r in rows])


def _margin(rest: np.ndarray, other: np.ndarray | float, width: int) -> np.ndarray:
    """How far the product of codes is from the cosine at most: |u v - u' v'| <= a + b + 3 a b for the lengths of what the codes
    leave out, and the rounding of products and bounds in single precision."""
    return rest + other + 3 * rest * other + (2 * width + 40) * 6e-8 + SLACK


def _stepped(bound: np.ndarray) -> np.ndarray:
    """Two bytes hold a bound: cosines lie between -1 and 1, and what lies beyond -2 is no bound at all."""
    return np.clip(bound, -2 * GRID, 2 * GRID - 1).astype(np.int16)


def _candidates(queries: Codes, pool: Codes, k: int, apart: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Per tile of queries: how many entries each has, the rows of the pool, and the least and the most their cosines can be.
    Row -1 is the whole block: the least k cosines of some of its vectors, and the most of any."""
    width = queries.rows.shape[1]
    widest = _margin(queries.rest, float(pool.rest.max()), width)
    for at in range(0, len(queries.rows), TILE):
        tile = slice(at, at + TILE)
        near = queries.rows[tile] @ pool.rows.T
        if apart:
            near[queries.own[tile][:, None] == pool.own[None, :]] = -np.inf
        n, wide = len(near), widest[tile]
        head = near[:, :FIRST]
        kth = min(k, head.shape[1])
        best = -np.partition(-head, kth - 1, axis=1)[:, :kth].astype(np.float64)
        floor = best.min(axis=1) - wide if kth == k else np.full(n, -np.inf)
        q, r = np.divmod(np.flatnonzero(near >= (floor - wide).astype(np.float32)[:, None] - np.float32(1e-6)), near.shape[1])
        crowded = np.bincount(q, minlength=n) > 16 * LISTED * k
        if crowded.any():
            keep = ~crowded[q]
            q, r = q[keep], r[keep]
        value = near[q, r].astype(np.float64)
        margin = _margin(queries.rest[tile][q], pool.rest[r], width)
        low, high = value - margin, value + margin
        order = np.lexsort((-low, q))
        q, r, low, high = (x[order] for x in (q, r, low, high))
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q]
        bound = np.full(n, -np.inf)
        bound[q[place == k - 1]] = low[place == k - 1]
        keep = (high >= bound[q]) & (low > -np.inf)
        count = np.bincount(q[keep], minlength=n)
        many = count > LISTED * k
        if many.any():  # the k best stand for the block
            top = np.full(n, -np.inf)
            np.maximum.at(top, q, high)
            lump = many[q]
            keep = np.where(lump, place < k, keep)
            r, high = np.where(lump, -1, r), np.where(lump, top[q], high)
        q, r, low, high = (x[keep] for x in (q, r, low, high))
        if crowded.any():
            rows = np.flatnonzero(crowded)
            q = np.concatenate([q, np.repeat(rows, kth)])
            r = np.concatenate([r, np.full(len(rows) * kth, -1)])
            low = np.concatenate([low, (best[rows] - wide[rows, None]).ravel()])
            high = np.concatenate([high, np.repeat(near[rows].max(axis=1) + wide[rows], kth)])
            order = np.argsort(q, kind="stable")
            q, r, low, high = (x[order] for x in (q, r, low, high))
        yield np.bincount(q, minlength=n).astype(np.int32), r.astype(np.int32), _stepped(np.floor(low * GRID)), _stepped(np.ceil(high * GRID))


def _scan(queries: DataFrame, pool: DataFrame, item: str, k: int, apart: bool) -> DataFrame:
    """`(item, qb, part, pb, counts, rows, low, high)`: candidates of the queries of a part in one block."""
    light = [item, "part", "width", "codes", "scale", "rest", "names"]
    grid = lambda df, name: df.groupBy(item).agg((F.max("b") + 1).alias(name))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))
    left = queries.select(*light, F.col("b").alias("qb")).join(fresh(grid(pool, "n")), item).withColumn("pb", every("n")).drop("n")
    right = pool.select(*light, F.col("b").alias("pb")).join(fresh(grid(queries, "n")), item).withColumn("qb", every("n")).drop("n")
    kind = queries.schema[item].dataType
    fields = [item, "qb", "part", "pb", "counts", "rows", "low", "high"]

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = {c: [] for c in fields}
        if mine.num_rows and theirs.num_rows:
            q, p = Codes(mine), Codes(theirs)
            told = list(_candidates(q, p, k, apart))
            count, rows, low, high = (np.concatenate([t[i] for t in told]) for i in range(4))
            ends, at, entry = np.concatenate([[0], np.cumsum(count)]), 0, mine.select([item, "qb", "pb"]).slice(0, 1).to_pylist()[0]
            for part, size in zip(q.parts, q.sizes, strict=True):
                a, b = ends[at], ends[at + size]
                row = {**entry, "part": part, "counts": count[at : at + size].tobytes(), "rows": rows[a:b].tobytes(), "low": low[a:b].tobytes(), "high": high[a:b].tobytes()}
                for c in fields:
                    out[c].append(row[c])
                at += size
        types = [mine.schema.field(item).type, pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(out[c], t) for c, t in zip(fields, types, strict=True)], names=fields)

    schema = f"`{item}` {kind.simpleString()}, qb bigint, part int, pb bigint, counts binary, rows binary, low binary, high binary"
    return left.groupBy(item, "qb", "pb").cogroup(fresh(right).groupBy(item, "qb", "pb")).applyInArrow(meet, schema)


def _requests(found: DataFrame, queries: DataFrame, item: str, k: int, numbers: np.dtype) -> DataFrame:
    """`(item, pb, names, raw, width, floor, at, rows)`: the queries of a part that a block must meet, and which of its rows."""
    exact = queries.select(item, F.col("b").alias("qb"), "part", "width", "raw", "names")
    fields = [item, "pb", "width", "names", "raw", "floor", "at", "rows"]

    def merge(cands: pa.Table, mine: pa.Table) -> pa.Table:
        out = {c: [] for c in fields}
        if cands.num_rows and mine.num_rows:
            me = mine.to_pylist()[0]
            told = np.frombuffer(me["names"], np.int64).reshape(3, -1)
            n = told.shape[1]
            raw = expanded(me["raw"], numbers, me["width"])
            q, r, low, high, block = [], [], [], [], []
            for row in cands.to_pylist():
                count = np.frombuffer(row["counts"], np.int32)
                q.append(np.repeat(np.arange(n), count))
                r.append(np.frombuffer(row["rows"], np.int32))
                low.append(np.frombuffer(row["low"], np.int16) / GRID)
                high.append(np.frombuffer(row["high"], np.int16) / GRID)
                block.append(np.full(len(r[-1]), row["pb"]))
            q, r, low, high, block = (np.concatenate(x) for x in (q, r, low, high, block))
            order = np.lexsort((-low, q))
            starts = np.searchsorted(q[order], np.arange(n + 1))
            floor = np.full(n, -np.inf)
            full = np.flatnonzero(np.diff(starts) >= k)
            floor[full] = low[order[starts[full] + k - 1]]
            best = high >= floor[q]
            for b in np.unique(block[best]).tolist():
                here = best & (block == b)
                pair = np.unique(np.stack([q[here], r[here]]), axis=1)
                who, at = np.unique(pair[0], return_inverse=True)
                row = {item: me[item], "pb": b, "width": me["width"], "names": told[:, who].tobytes(), "raw": squeezed(raw[who]), "floor": floor[who].tobytes(),
                       "at": at.astype(np.int32).tobytes(), "rows": pair[1].astype(np.int32).tobytes()}
                for c in fields:
                    out[c].append(row[c])
        types = [cands.schema.field(item).type, pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array(out[c], t) for c, t in zip(fields, types, strict=True)], names=fields)

    kind = queries.schema[item].dataType.simpleString()
    schema = f"`{item}` {kind}, pb bigint, width int, names binary, raw binary, floor binary, at binary, rows binary"
    return found.groupBy(item, "qb", "part").cogroup(fresh(exact).groupBy(item, "qb", "part")).applyInArrow(merge, schema)


def _exact(asked: DataFrame, pool: DataFrame, item: str, k: int, apart: bool, numbers: np.dtype) -> DataFrame:
    """`(item, va, vb, own, ids, sim)`: the candidates of every query with their cosines, at most `k` of a block and query."""
    none = lambda kind: F.lit(None).cast(kind)
    kinds = {f.name: f.dataType for f in pool.schema.fields}
    held = pool.select(item, F.col("b").alias("pb"), F.lit(0).alias("turn"), "part", "width", "ids", "names", "raw", *[none("binary").alias(c) for c in ("floor", "at", "rows")])
    sent = asked.select(item, "pb", F.lit(1).alias("turn"), F.lit(0).alias("part"), "width", none(kinds["ids"]).alias("ids"), "names", "raw", "floor", "at", "rows")
    lined = held.unionByName(sent).repartition(item, "pb").sortWithinPartitions(item, "pb", "turn", "part")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, own, ids, parts = None, None, None, None, []
        for batch in batches:
            types = [batch.schema.field(item).type, *[pa.int64()] * 3, batch.schema.field("ids").type.value_type, pa.float64()]
            for row in batch.to_pylist():
                if (row[item], row["pb"]) != place:
                    place, parts, rows = (row[item], row["pb"]), [], None
                if row["turn"] == 0:
                    parts.append(row)
                    continue
                if rows is None:  # all parts of the block come before its queries
                    rows = np.concatenate([unit(expanded(p["raw"], numbers, p["width"]), p["width"]) for p in parts])
                    own = np.concatenate([np.frombuffer(p["names"], np.int64).reshape(3, -1)[2] for p in parts])
                    ids = [i for p in parts for i in p["ids"]]
                    parts = []
                q, r, sim, told = _met(row, rows, own, k, apart, numbers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[item]] * len(q), types[0]), *[pa.array(told[c][q]) for c in range(3)], pa.array([ids[i] for i in r], types[4]), pa.array(sim)],
                    names=[item, "va", "vb", "own", "ids", "sim"],
                )

    kind = kinds[item].simpleString()
    return lined.mapInArrow(rerank, f"`{item}` {kind}, va bigint, vb bigint, own bigint, ids {kinds['ids'].elementType.simpleString()}, sim double")


def _met(row: dict, rows: np.ndarray, own: np.ndarray, k: int, apart: bool, numbers: np.dtype):
    """Exact cosines of a request: listed rows, or the whole block tile by tile; the best k of each query."""
    told = np.frombuffer(row["names"], np.int64).reshape(3, -1)
    mine = unit(expanded(row["raw"], numbers, row["width"]), row["width"])
    q, r = np.frombuffer(row["at"], np.int32), np.frombuffer(row["rows"], np.int32)
    listed = r >= 0
    a, b = q[listed], r[listed]
    parts = [(a, b, np.round(np.einsum("ij,ij->i", mine[a], rows[b]), DIGITS))]
    whole = q[~listed]
    for at in range(0, len(whole), TILE):
        some = whole[at : at + TILE]
        sim = np.round(mine[some] @ rows.T, DIGITS)
        if apart:
            sim[told[2][some][:, None] == own[None, :]] = -np.inf
        kth = min(k, sim.shape[1])
        least = -np.partition(-sim, kth - 1, axis=1)[:, kth - 1]
        x, y = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
        parts.append((some[x], y, sim[x, y]))
    q, r, sim = (np.concatenate([p[i] for p in parts]) for i in range(3))
    # rows of a block are in the order of their first ids
    order = np.lexsort((r, -sim, q))
    q, r, sim = q[order], r[order], sim[order]
    starts = np.searchsorted(q, np.arange(told.shape[1] + 1))
    floor = np.frombuffer(row["floor"])
    keep = (np.arange(len(q)) - starts[q] < k) & (sim >= floor[q] - 1e-6)
    return q[keep], r[keep], sim[keep], told


def best_vectors(queries: DataFrame, pool: DataFrame, item: str, k: int, apart: bool) -> tuple[DataFrame, DataType]:
    """`(item, va, vb, own, ids, sim)`: the `k` distinct vectors of `pool` nearest to every distinct vector of `queries`, both
    `(item, id, vec, own)`; equal similarities are ordered by the first id. With `apart`, vectors with equal `own` are left
    out. Also the type that vectors have when they get their names."""
    spark = queries.sparkSession
    single = all(df.schema["vec"].dataType.elementType.simpleString() == "float" for df in (queries, pool))
    numbers = np.dtype(np.float32 if single else np.float64)
    same = queries is pool
    pool = pool.withColumn("vec", F.col("vec").cast(f"array<{'float' if single else 'double'}>"))
    queries = pool if same else queries.withColumn("vec", F.col("vec").cast(pool.schema["vec"].dataType))
    with arrow_rows(spark, 32):  # rows are parts of a megabyte or so
        theirs = blocks(pool, item, k)
        mine = theirs if same else blocks(queries, item, k)
        cands = written(_scan(mine, theirs, item, k, apart), "candidates")
        asked = written(_requests(cands, mine, item, k, numbers), "requests")
        found = written(_exact(asked, theirs, item, k, apart, numbers), "found")
    for table in {id(t): t for t in (theirs, mine, cands, asked)}.values():
        discard(table)
    order = Window.partitionBy(item, "va", "vb", "own").orderBy(F.desc("sim"), F.get("ids", F.lit(0)))
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"), pool.schema["vec"].dataType
