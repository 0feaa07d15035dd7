"""Substring dedup by level-wise doubling: removes passages whose word windows occur in an earlier document.

Level 1 looks at windows of half the length. A repeated window of `window` words holds the same half-length
windows in both places, so it is enough to look at its smallest one by hash (leftmost on a tie): about one half-length
window in thirteen is shuffled, and nothing is lost. Only half-length windows that occur in two documents survive, and
only around these are windows extended to twice the length for level 2. Neighbouring extensions of one survivor form a
run; equal runs of later documents need no further look, the first document's runs are compared window by window.

Hot windows never gather in a task: both levels reduce to (hash, smallest document) on the map side and meet the
occurrences in a join that Spark can split. Text is shuffled by document, twice; everything else is hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from kappaframe.llm.words import LAST_ID, Block, as_bytes, cut, expanded, keyed, squeezed, windows
from kappaframe.session import written


def smallest_inside(half: np.ndarray, n: int, span: int) -> np.ndarray:
    """For each of the first `n` places the leftmost place of the smallest value among it and the `span` that follow."""
    best, at = half[:n].copy(), np.arange(n)
    for j in range(1, span + 1):
        other = half[j : j + n]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    return at


class Levels:
    """Both window lengths over one block: where whole windows start and which half-length window stands for each."""

    def __init__(self, block: Block, window: int):
        half = window // 2
        self.half = windows(block.words, half)
        self.full = windows(block.words, window)
        n = len(self.full)
        of = np.repeat(np.arange(len(block.ids)), block.lengths)[:n]
        self.starts = np.flatnonzero(np.arange(n) + window <= block.offsets[of + 1])
        self.doc = of[self.starts]
        at = smallest_inside(self.half, n, window - half) if n else np.empty(0, np.int64)
        self.anchor = at[self.starts]


def _anchors(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts, part in cut(batch.column("_id"), batch.column("_text")):
                block = Block(np.arange(len(texts)), texts)
                found = Levels(block, window)
                anchor, first = np.unique(found.anchor, return_index=True)
                doc = found.doc[first]
                ids, marks = (batch.column(c).to_numpy()[part][doc] for c in ("_id", "_t"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.half[anchor].view(np.int64)), pa.array(ids), pa.array(marks),
                     pa.array((anchor - block.offsets[doc]).astype(np.int32))], names=["h", "_id", "_t", "at"])

    return task


def _runs(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = batch.column("alive")
            for _, texts, part in cut(batch.column("_id"), batch.column("_text")):
                block = Block(np.arange(len(texts)), [expanded(t) for t in texts])
                found = Levels(block, window)
                lists = alive.slice(part.start, part.stop - part.start)
                sizes = lists.value_lengths().to_numpy()
                places = lists.flatten().to_numpy() + np.repeat(block.offsets[:-1], sizes)
                ok = np.zeros(len(block.words) + 1, dtype=bool)
                ok[places] = True
                keep = ok[found.anchor]
                starts, anchor, doc = found.starts[keep], found.anchor[keep], found.doc[keep]
                if not len(starts):
                    continue
                cut_at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                counts = np.diff(np.append(cut_at, len(starts)))
                full = found.full[starts]
                turn = np.arange(len(full)) - np.repeat(cut_at, counts)
                weight = np.uint64(2) * turn.astype(np.uint64) + np.uint64(1)
                run = np.add.reduceat(full * (weight * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), cut_at)
                d = doc[cut_at]
                ids, marks = (batch.column(c).to_numpy()[part][d] for c in ("_id", "_t"))
                offsets = pa.array(np.append(cut_at, len(full)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run.view(np.int64)), pa.array(ids), pa.array(marks),
                     pa.array((starts[cut_at] - block.offsets[d]).astype(np.int32)), pa.array(counts.astype(np.int32)),
                     pa.ListArray.from_arrays(offsets, pa.array(full.view(np.int64)))],
                    names=["run", "_id", "_t", "start", "n", "hashes"])

    return task


def repeated_windows(rows: DataFrame, window: int = 50) -> DataFrame:
    """`(_id, _t, start, n)`: stretches of `n` consecutive windows, from word `start`, that also start in a document
    with a smaller id. `rows` comes from `keyed`."""
    if window < 2:
        raise ValueError("a window has two words at least")
    seen = written(rows.mapInArrow(_anchors(window), "h long, _id long, _t long, at int"), "anchors")
    both = written(seen.groupBy("h").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("h"), "both")
    # rows that repeat have the same places: as sets these stay as many as one row has
    alive = seen.join(both, "h").groupBy("_id", "_t").agg(F.collect_set("at").alias("alive"))
    near = rows.select("_id", "_t", squeezed(F.col("_text")).alias("_text")).join(alive, ["_id", "_t"])
    runs = written(
        near.mapInArrow(_runs(window), "run long, _id long, _t long, start int, n int, hashes array<long>"), "runs"
    )
    # the reduced sides are written, so that both sides of their joins are plain shuffles that Spark may split
    first = written(runs.groupBy("run", "n").agg(F.min("_id").alias("first")), "first")
    told = runs.select("run", "n", "_id", "_t", "start").join(first, ["run", "n"])
    later = told.where("_id > first").select("_id", "_t", "start", "n")
    heads = runs.join(first, ["run", "n"]).where("_id = first").select("_id", "_t", "start", "hashes")
    single = heads.select("_id", "_t", "start", F.posexplode("hashes").alias("i", "h"))
    least = written(
        single.groupBy("h").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("h", "lo"), "least"
    )
    among = single.join(least, "h").where("_id > lo").select(
        "_id", "_t", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("n")
    )
    return later.unionByName(among)


def _cut_out(window: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    @arrow_udf("struct<n_words: long, n_removed: long, kept: string>")
    def cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
        total, gone, kept = [], [], []
        for text, stretches in zip(texts, spans, strict=True):
            words, removed = text.as_py().split(), 0
            n = len(words)
            if stretches.is_valid:
                edge = np.zeros(n + 1, dtype=np.int64)
                start, count = (stretches.values.field(i).to_numpy() for i in (0, 1))
                np.add.at(edge, start, 1)
                np.add.at(edge, np.minimum(start + count + window - 1, n), -1)
                stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                removed = n - len(stay)
                words = [words[i] for i in stay]
            total.append(n)
            gone.append(removed)
            kept.append(b" ".join(words))
        parts = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(parts, fields=list(kind))

    return cut_out.asNondeterministic()


def with_repeats_removed(
    docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text", out: str = "_cut"
) -> DataFrame:
    """`docs` with a struct `out` of n_words, n_removed and kept: the words that remain, joined by one space.

    Every word goes that a window covers whose words also start in a document with a smaller id; windows are judged on
    the input. Null and empty texts have no words; texts shorter than the window stay whole; however long a text is, it
    is handled whole. A null id counts as larger than all others; rows with equal ids never remove each other's
    words, and equal rows are treated alike. An empty table gives an empty result; other columns pass through.
    """
    keys = ["_id", "_t"]
    rows = keyed(docs, id_column, text_column)
    spans = repeated_windows(rows, window).groupBy(*[F.col(c).alias(f"_sd{c}") for c in keys]).agg(
        F.collect_set(F.struct("start", "n")).alias("_sd_spans")
    )
    text = as_bytes(text_column)
    place = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(LAST_ID))
    joined = docs.join(spans, (place == F.col("_sd_id")) & (F.xxhash64(text) == F.col("_sd_t")), "left")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], _cut_out(window)(text, F.col("_sd_spans")).alias(out))


def remove_repeats(docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`(doc_id, n_words, n_removed, kept)`, a row for each row of `docs`; see `with_repeats_removed`."""
    some = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return with_repeats_removed(some, window).select("doc_id", "_cut.n_words", "_cut.n_removed", "_cut.kept")
