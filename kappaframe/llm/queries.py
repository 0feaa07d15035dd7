"""The registered queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaframe.llm import (
    bpe,
    centroid_clusters,
    embedding_dedup,
    jaccard_join,
    lm_scoring,
    oracles,
    packing,
    personal_data,
    quality_rules,
    secret_scan,
    source_audit,
    substring_dedup,
    toxicity,
    url_filter,
)
from kappaframe.llm.words import small_batches

HELD_OUT = 2
TOXIC_FROM = 0.3
VOCABULARY_FILE = "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; with `documents` the session's Arrow batches become small."""
    if name == "documents":
        small_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold(id_column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(4))


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").where("quality = 1")
    return lm_scoring.cross_entropy_difference(table(spark, folder, "documents"), good)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(fold() != HELD_OUT))
    return model.score(docs.select("doc_id", "text")).select(
        "doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.with_spans(docs, secret_scan.fit(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans")
    )


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, folder, "documents"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    spec = bpe.vocabulary_text(public_tokenizers.path(VOCABULARY_FILE))
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents"), spec), spec)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    told = personal_data.found(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return told.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in personal_data.KINDS], F.sha2(personal_data.lined(F.col("base")), 256).alias("base_sha256"),
        personal_data.lined(F.concat("base", "added")).alias("spans"),
    )


def op12_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audited(table(spark, folder, "documents"))


def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters.described(*centroid_clusters.clusters(table(spark, folder, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_toxicity, op3_url_filter, op4_secret_scan, op5_jaccard_join, op6_substring_dedup, op7_packing,
        op8_bpe, op9_embedding_dedup, op10_quality_rules, op11_personal_data, op12_source_audit, op13_centroid_clusters,
    )
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
