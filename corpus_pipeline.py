"""A corpus pipeline out of five of the operators: what it keeps is clean, unique and packed.

Each stage reads all documents that the one before kept, and is written and read again before the next. Stages take null and
repeated ids, null, blank and long texts, empty tables and further columns of any name, which pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaframe.llm import jaccard_join, packing, secret_scan, substring_dedup, toxicity
from kappaframe.llm.queries import HELD_OUT, fold, table
from kappaframe.llm.words import LAST_ID, as_bytes, small_batches
from kappaframe.session import written

REJECT_FROM = 0.5  # above op2's 0.3: with few labels the calibration puts many clean texts between the two


def _rows(docs: DataFrame) -> DataFrame:
    """`(row, doc_id, text)`: every other column travels in one struct, so no name clashes with one used on the way."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.struct(*(rest or [F.lit(0)])).alias("row"), "doc_id", "text")


def _documents(df: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of `docs` again, with a new text and its length where one is given."""
    new = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if text is not None:
        new |= {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored REJECT_FROM or more go. Sets small Arrow batches for this and the stages after it."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold() != HELD_OUT))
    return _documents(model.score(_rows(docs), "score").where(F.col("score") < REJECT_FROM), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays, then text hash (a null id comes last); rows without
    words stay, and of rows equal in id and text one."""
    first = jaccard_join.first_of_each(docs)
    rows = _rows(docs).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)))
    rows = rows.withColumn("_t", F.xxhash64(as_bytes("text"))).withColumn("_null", F.col("text").isNull())
    kept = rows.join(first, ["_id", "_t"], "left_semi")
    # rows that repeat lie together already, so whole rows are shuffled once and no text is a key
    return _documents(kept.dropDuplicates(["_id", "_t", "doc_id", "_null"]), docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out; a document left without words goes."""
    cleaned = substring_dedup.with_repeats_removed(_rows(docs), out="cut")
    kept = cleaned.where("cut.n_removed = 0 OR cut.n_removed < cut.n_words")
    return _documents(kept, docs, F.when(F.col("cut.n_removed") > 0, F.col("cut.kept")).otherwise(F.col("text")))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    clean = secret_scan.redacted(_rows(docs), secret_scan.fit(docs))
    return _documents(clean, docs, F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in token-budget batches of optimal length buckets."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxic_out), ("jaccard_join", one_of_each), ("substring_dedup", repeats_out), ("secret_scan", secrets_out), ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
