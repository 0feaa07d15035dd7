"""Text to vectors and token vectors to text vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaframe.session import spread


def embed_text(df: DataFrame, text: str, width: int = 256, output: str = "emb") -> DataFrame:
    """Adds a unit vector of hashed, inverse-document-weighted words. `operators.inference.infer` takes any
    other encoder."""
    prepared = spread(df).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern="[^\\p{L}\\p{N}]+", minTokenLength=1),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]
    model = Pipeline(stages=stages).fit(prepared)
    vectors = model.transform(prepared).withColumn(output, vector_to_array("_unit", "float32"))
    return vectors.drop("_text", "_words", "_tf", "_idf", "_unit")


def pool_tokens(tokens: DataFrame, width: int, key: str = "id") -> DataFrame:
    """Token rows `(id, pos, vec, mask)` to `(id, mean, max, mean_sqrt, cls)` arrays.

    Masked-out tokens count for nothing; `cls` is the vector at position 0. A text without any token left
    has mean 0 and maximum -1e9. Partial sums are combined on the map side.
    """
    vector = array_to_vector(F.col("vec").cast("array<double>"))
    summary = Summarizer.metrics("sum", "max", "count").summary(F.col("_v"))
    pooled = (
        tokens.where(F.col("mask") == 1).withColumn("_v", vector).groupBy(key).agg(summary.alias("s"))
        .select(key, vector_to_array("s.sum").alias("_sum"), vector_to_array("s.max").alias("_max"),
                F.col("s.count").cast("double").alias("_n"))
    )
    first = tokens.groupBy(key).agg(F.max(F.when(F.col("pos") == 0, F.col("vec"))).alias("cls"))
    zeros, lows = F.array_repeat(F.lit(0.0), width), F.array_repeat(F.lit(-1e9), width)
    joined = first.join(pooled, key, "left")
    return joined.select(
        key,
        F.when(F.col("_n").isNull(), zeros).otherwise(F.transform("_sum", lambda x: x / F.col("_n"))).alias("mean"),
        F.coalesce("_max", lows).alias("max"),
        F.when(F.col("_n").isNull(), zeros)
        .otherwise(F.transform("_sum", lambda x: x / F.sqrt(F.col("_n"))))
        .alias("mean_sqrt"),
        F.transform("cls", lambda x: x.cast("double")).alias("cls"),
    )
