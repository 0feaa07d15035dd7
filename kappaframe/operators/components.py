"""Connected components over edges too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaframe.session import discard, written


def _stars(edges: DataFrame, key: list[str]) -> DataFrame:
    """Large star then small star: every node hands its larger neighbours to the smallest node it sees, and then
    itself and its smaller neighbours to the smallest of these."""
    both = edges.unionByName(edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(*key, "a").agg(F.min("b").alias("_m")).select(*key, "a", F.least("a", "_m").alias("_m"))
    large = both.where("b > a").join(low, [*key, "a"]).select(*key, F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
    least = large.groupBy(*key, "a").agg(F.min("b").alias("_m"))
    small = large.join(least, [*key, "a"])
    handed = small.where("b <> _m").select(*key, F.col("b").alias("a"), F.col("_m").alias("b"))
    return handed.unionByName(least.withColumnRenamed("_m", "b")).where("a > b").distinct()


def components(edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    """`(key, vid, comp)` for every node on an edge `(key, a, b)`: the smallest node of its component.

    Edges with a null end or equal ends link nothing. Rounds are written and read back, and end when a round changes
    no edge; their number grows with the logarithm of the number of nodes, whatever the shape.
    """
    key = key or []
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*key, high.alias("a"), low.alias("b")).distinct()
    now = written(now, "edges")
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*key, "a", "b"))).first()
        if tuple(mark) == state:
            break
        state = tuple(mark)
        after = written(_stars(now, key), "edges")
        discard(now)
        now = after
    roots = now.select(*key, F.col("b").alias("vid"), F.col("b").alias("comp")).distinct()
    return now.select(*key, F.col("a").alias("vid"), F.col("b").alias("comp")).unionByName(roots)
