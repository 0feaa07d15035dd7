"""Packing into length buckets that waste least.

Texts longer than the context are cut into pieces, so the global histogram of piece lengths has at most `context`
entries. Dynamic programming over it chooses the bucket bounds with the least padding; inside each bucket rows are
numbered and batches of a fixed token budget form. Numbers come from row numbers within small shards and running sums
of shard sizes, so no bucket is ever sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kappaframe.llm.words import as_bytes
from kappaframe.session import written

CONTEXT, BUCKETS, BUDGET = 2048, 16, 65_536
SHARD_ROWS = 50_000


def best_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds for `counts[i]` rows of length i: at most `buckets`, the last one the greatest length, with the least
    sum of bound minus length; of equal choices the one with the smaller bounds."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    rows = np.concatenate([[0.0], np.cumsum(counts[lengths])])
    n = len(lengths)
    best = rows[1:] * lengths
    back = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        # cost[j, i]: lengths j..i in one bucket after the best for those before j
        new, choice = best.copy(), np.zeros(n, dtype=np.int64)
        for i in range(1, n):
            cost = best[:i] + (rows[i + 1] - rows[1 : i + 1]) * lengths[i]
            j = int(cost.argmin())
            if cost[j] < new[i]:
                new[i], choice[i] = cost[j], j + 1
        best = new
        back.append(choice)
    out, i = [], n - 1
    for choice in reversed(back):
        out.append(int(lengths[i]))
        if choice[i] == 0:
            break
        i = int(choice[i]) - 1
    return out[::-1]


def n_words(text_column: str):
    text = F.trim(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"[\x20\x09-\x0D]+"))).cast("long")


def packed(
    docs: DataFrame, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET, length: str | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """`(doc_id, piece, start, length, bucket, batch, slot)`: every piece of every document with its place.

    A piece is tokens start to start + length of its document, at most `context` of them; `bucket` is the padded length,
    `batch` numbers the bucket's batches from 0 and `slot` a batch's rows from 0; a batch holds budget // bucket rows (one
    at least) and only the last of a bucket may hold fewer. Tokens are counted by the column `length`, or are words cut at
    ASCII white space. Null, empty and blank texts have no piece; null ids are packed too; repeated rows are packed each.
    An empty table gives an empty result; other columns are not read.
    """
    tokens = F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0).cast("long")) if length else n_words(text_column)
    # texts are cut into words once; rows without an id, or that share one, are told apart by their place in this small table
    sized = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), tokens.alias("_n"), F.xxhash64(as_bytes(text_column)).alias("_t"))
    rows = written(sized.where("_n > 0").withColumn("_k", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), "lengths")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / context))).alias("piece")
    pieces = rows.select("doc_id", "_n", "_t", "_k", at).select(
        "doc_id", "_t", "_k", "piece", (F.col("piece") * context).alias("start"), F.least(F.lit(context), F.col("_n") - F.col("piece") * context).cast("long").alias("length")
    )
    counts = np.zeros(context + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `context` rows
        counts[r["length"]] = r["count"]
    bounds = best_bounds(counts, buckets)
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("length") <= b, F.lit(b).cast("long")).otherwise(bucket)
    shards = max(1, int(counts.sum()) // SHARD_ROWS)
    hashed = F.xxhash64("doc_id", "piece", "_t", "_k")
    placed = pieces.withColumn("bucket", bucket).withColumn("_h", hashed).withColumn("_s", F.pmod("_h", F.lit(shards)))
    sizes = placed.groupBy("bucket", "_s").count()
    before = Window.partitionBy("bucket").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("bucket", "_s").orderBy("_h", "doc_id", "piece", "length")
    numbered = placed.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, ["bucket", "_s"])
    number, rows_each = F.col("_r") + F.col("_o"), F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")))
    return numbered.select(
        "doc_id", "piece", "start", "length", "bucket", F.floor(number / rows_each).alias("batch"), (number % rows_each).cast("long").alias("slot")
    )
