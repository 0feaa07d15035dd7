"""Item metadata: a JSON object keyed by item whose entries have different keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = (
    "struct<name:string, type:int, context_var:map<string,array<string>>, score:string, "
    "correct_score:map<string,array<string>>, reduce_label:map<string,array<string>>, var:array<string>, "
    "question:string, correct_answer:map<string,string>, rubric:map<string,string>, "
    "ungraded_answer:map<string,string>>"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """One row per item with every metadata field as a column."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", f"map<string,{ITEM}>")).alias("qid", "item"))
    return entries.select("qid", "item.*")


def context_columns(items: DataFrame) -> DataFrame:
    """`(qid, part, position, field)`: which columns each part of an item reads."""
    parts = items.select("qid", F.explode("context_var").alias("part", "fields"))
    return parts.select("qid", "part", F.posexplode("fields").alias("position", "field"))


def label_reduction(items: DataFrame) -> DataFrame:
    """`(qid, label, r_label)`: detailed to reduced labels per item."""
    parts = items.select("qid", F.explode("reduce_label").alias("r_label", "labels"))
    return parts.select("qid", F.explode("labels").alias("label"), "r_label")
