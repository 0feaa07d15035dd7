"""Text files read in byte ranges, in file order.

Spark deals a large text file out in byte ranges, and a line belongs to the range it begins in. Numbers and quotes need what
came before: each range's counts are taken natively, summed up over the ranges before it (one row per range), and every task
then works on its own lines alone.

* `numbered_lines`: lines with their place over all files, the same however the files are cut up;
* `quoted_records`: records of a quoted format whose cells may hold line breaks. Whether a line ends inside quotes is the parity
  of the quotes before it; a record belongs to the range it begins in, and the few that run over the end of a range are put
  together from the pieces of the ranges after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kappaframe.operators.ordering import running_total

WHOLE, OPEN, MORE = 0, 1, 2  # a record of one range; the beginning of one that runs on; a piece of one that began before


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`(file, start, value)`: lines that are not blank, with the range they belong to. Ends of lines are `\\n`."""
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal keys begins, and the end."""
    change = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys[0])]])


def _with_places(df: DataFrame) -> DataFrame:
    """`at`: number of a line within its range. A task reads the ranges that it has one after the other."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
            codes = files.indices.to_numpy()
            at = np.empty(batch.num_rows, np.int64)
            edges = _runs([codes, starts])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = (files.dictionary[int(codes[a])].as_py(), int(starts[a]))
                seen = seen if key == last else 0
                at[a:b] = np.arange(seen, seen + b - a)
                last, seen = key, seen + int(b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "at"])

    return df.mapInArrow(number, "file string, start bigint, value string, at bigint")


def numbered_lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """`(pos, value)`: lines that are not blank, numbered from 0 over all files in the order of their names; with `header` the
    first line of each file is left out."""
    rows = lines(spark, path).where("value <> '' AND value <> '\r'")
    first = F.when(F.col("start") == 0, 1).otherwise(0) if header else F.lit(0)
    counts = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.col("n") - first)
    before = running_total(counts, ["file", "start"], {"before": "n"}).select("file", "start", "before")
    placed = _with_places(rows).join(before, ["file", "start"]).withColumn("at", F.col("at") - first)
    return placed.where("at >= 0").select((F.col("before") + F.col("at")).alias("pos"), "value")


def quoted_records(spark: SparkSession, path: str | list[str], header: bool = True, quote: str = '"') -> DataFrame:
    """`(record)`: the records of quoted files as text; with `header` the first of each file is left out, blank ones always.

    Quotes stand around cells or, doubled, inside quoted cells, as CSV writers put them, so their parity tells inside from
    outside. A quote that is never closed ends with its file.
    """
    odd = ((F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2).cast("int")
    rows = lines(spark, path).withColumns({"odd": odd, "range": F.xxhash64("file", "start")})
    sums = rows.groupBy("file", "start", "range").agg((F.sum("odd") % 2).alias("odd"))
    ahead = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("before", F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2).where("before = 1")
    # eight bytes per range that begins inside quotes; the driver's own list of ranges is longer
    begun = np.sort(np.array([r["range"] for r in inside.select("range").collect()], np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parity, pending, kind, number = None, 0, [], WHOLE, 0
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])

        def told(kind: int, text: str | None) -> None:
            for column, x in zip(out, (*place, number, kind, text), strict=True):
                column.append(x)

        def flush() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["file", "start", "number", "kind", "text"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            files, starts, keys = (batch.column(c).to_pylist() for c in ("file", "start", "range"))
            for file, start, key, odd, value in zip(files, starts, keys, batch.column("odd").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if (file, start) != place:
                    if pending:
                        told(OPEN if kind == WHOLE else MORE, "\n".join(pending))
                    place, pending, number = (file, start), [], 0
                    i = int(np.searchsorted(begun, key))
                    parity = int(i < len(begun) and begun[i] == key)
                    kind = MORE if parity else WHOLE
                pending.append(value)
                parity ^= odd
                if not parity:
                    told(kind, pending[0] if len(pending) == 1 else "\n".join(pending))
                    pending, kind, number = [], WHOLE, number + 1
            if len(out[0]) > 1000:
                yield flush()
        if pending:
            told(OPEN if kind == WHOLE else MORE, "\n".join(pending))
        yield flush()

    parts = rows.select("file", "start", "range", "odd", "value").mapInArrow(cut, "file string, start bigint, number bigint, kind int, text string")
    title = (F.col("start") == 0) & (F.col("number") == 0) & F.lit(header)
    whole = parts.where((F.col("kind") == WHOLE) & ~title).select(F.col("text").alias("record"))
    # pieces: at most two per range
    pieces = parts.where(F.col("kind") != WHOLE)
    so_far = Window.partitionBy("file").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") == OPEN, F.col("start")), ignorenulls=True).over(so_far)
    owned = pieces.select("file", "start", "kind").withColumn("owner", owner)
    entry = F.struct("start", "kind", "number", "text")
    joined = pieces.join(owned, ["file", "start", "kind"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(entry)).alias("p"))
    titled = (F.col("owner") == 0) & (F.col("p")[0]["number"] == 0) & F.lit(header)
    long = joined.where(~titled).select(F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("record"))
    return whole.unionByName(long).where("record <> '' AND record <> '\r'")
