"""Reading and writing the tables of the pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaframe.functions.labels import null_if_missing
from kappaframe.sources.ranges import numbered_lines, quoted_records

BOM = "﻿"


def _clean(cell: Column) -> Column:
    return F.replace(F.replace(cell, F.lit(BOM), F.lit("")), F.lit('"'), F.lit(""))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated export as text columns plus `pos`, the row's number from 0 over all files in the order of their names.

    The byte-order mark and every double quote are removed from header and cells; cells are never parsed. Cells that a
    short line lacks are empty, those beyond the header are left out; `pos` does not depend on how files are cut up.
    """
    header = spark.read.text(path, lineSep="\n").where("value <> '' AND value <> '\r'").head()
    if header is None:
        raise ValueError(f"no header line in {path}")
    tidy = lambda c: F.regexp_replace(_clean(c), "\r$", "")
    names = header["value"].replace(BOM, "").replace('"', "").rstrip("\r").split("\t")
    cells = F.split(tidy(F.col("value")), "\t", -1)
    rows = numbered_lines(spark, path).select("pos", cells.alias("_cells"))
    return rows.select("pos", *[F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def audit_export(spark: SparkSession, path: str, items: DataFrame, item_field: int = 1) -> DataFrame:
    """`(line, reason)` for lines with a wrong number of fields or an unknown item; the rows themselves are kept
    by `read_export`. `items` holds the known ids in `item`."""
    lines = spark.read.text(path).select(_clean(F.col("value")).alias("line")).where("line <> ''")
    header = spark.read.text(path).select(_clean(F.col("value")).alias("line")).head()
    if header is None:
        return lines.select("line", F.lit("").alias("reason")).limit(0)
    width = len(header["line"].split("\t"))
    fields = F.split("line", "\t")
    rows = lines.where(F.col("line") != header["line"])
    rows = rows.withColumns({"fields": F.size(fields), "item": F.get(fields, F.lit(item_field))})
    known = items.select("item").distinct().withColumn("known", F.lit(True))
    checked = rows.join(known, "item", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("fields") != width, F.lit("field count")), F.when(F.col("known").isNull(), F.lit("unknown item"))
        )
    )
    return checked.select("line", F.explode(reasons).alias("reason"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A quoted CSV with header; cells that are a missing token become NULL, then types are applied.

    Cells may hold line breaks, and a file is still read by many tasks (`ranges.quoted_records`).
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    record = F.regexp_replace("record", "\r$", "")
    ddl = ", ".join(f"`{f.name}` string" for f in text.fields)
    raw = quoted_records(spark, path).select(F.from_csv(record, ddl, {"escape": '"', "multiLine": "true"}).alias("r")).select("r.*")
    columns = []
    for field in schema.fields:
        cell = null_if_missing(F.col(f"`{field.name}`"))
        if isinstance(field.dataType, T.IntegralType):
            cell = cell.try_cast("double").cast(field.dataType)
        elif not isinstance(field.dataType, T.StringType):
            cell = cell.try_cast(field.dataType)
        columns.append(cell.alias(field.name))
    return raw.select(*columns)


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """CSV with header; arrays and maps are written as JSON text."""
    flat = [
        F.to_json(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    writer = df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics_json(metrics: DataFrame, path: str, name: str = "metric", value: str = "value") -> None:
    """Long metrics as one JSON object per run (`{metric: value}`): a handful of entries each."""
    pairs = F.sort_array(F.collect_list(F.struct(name, value)))
    metrics.groupBy("run").agg(F.map_from_entries(pairs).alias("metrics")).write.mode("overwrite").json(path)


def write_parts(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet partitioned by `keys`; a reader with a filter on a key touches that part only."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_part(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), keys.items(), spark.read.parquet(path))


RUN_FILE = "([^/]*)/(val|test)_predict\\.csv"


def read_run_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Every `<run>/val_predict.csv` and `<run>/test_predict.csv` below `root` (files or folders of part files), one
    table with `run` and `split`.

    Runs may hold different epoch columns and CSV is positional, so files are read per distinct header. Only
    the list of outputs and one header line of each come to the driver.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    output = F.regexp_extract("path", f"^(.*{RUN_FILE})", 1)
    outputs = listing.select(output.alias("output")).where("output <> ''").distinct().collect()
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(row["output"] for row in outputs):
        header = tuple(spark.read.csv(path, header=True, escape='"').columns)
        by_header.setdefault(header, []).append(path)
    frames = []
    for header, paths in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = spark.read.schema(schema).csv(paths, header=True, escape='"')
        stem = F.substring_index(F.col("_metadata.file_path"), "_predict.csv", 1)
        frames.append(
            raw.select(
                F.substring_index(F.substring_index(stem, "/", -2), "/", 1).alias("run"),
                F.substring_index(stem, "/", -1).alias("split"),
                *[F.col(f"`{c}`") for c in schema.names],
            )
        )
    if not frames:
        raise FileNotFoundError(f"no prediction files below {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
