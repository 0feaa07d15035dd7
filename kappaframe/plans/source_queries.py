"""Queries that write tables in the pipeline's formats to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaframe.operators import agreement as A
from kappaframe.operators import selection as S
from kappaframe.plans import bindings as B
from kappaframe.plans.registry import Tables, query
from kappaframe.session import scratch_path
from kappaframe.sources import files, metadata

RAW = [
    "concat('\"', CAST(o_orderkey AS VARCHAR), '\"') AS student_id",
    "o_orderstatus AS accession",
    "CASE WHEN o_custkey % 5 = 0 THEN 'NA' ELSE concat('said \"', o_orderpriority, '\"') END AS predict_from",
]
_CLEAN = "SELECT CAST(o_orderkey AS VARCHAR) AS student_id, o_orderstatus AS accession, CASE WHEN o_custkey % 5 = 0 THEN 'NA' ELSE 'said ' || o_orderpriority END AS predict_from FROM orders"  # noqa: E501


@query("raw_load", _CLEAN)
def raw_load(t: Tables):
    """Quotes are stripped, nothing is parsed."""
    rows = B.derive(t.orders, RAW)
    path = scratch_path(t.spark, "export")
    rows.write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False)
    return files.read_export(t.spark, path).drop("pos")


@query("raw_positions", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CAST(o_orderkey AS VARCHAR) AS student_id FROM orders")
def raw_positions(t: Tables):
    """Row numbers of an export in several files, each with its header, written in the order of a key."""
    rows = t.orders.select(F.col("o_orderkey"), F.lit("x").alias("note"))
    path = scratch_path(t.spark, "export")
    line = F.concat_ws("\t", "o_orderkey", "note")
    ordered = rows.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    ordered.select(line.alias("student_id\tnote")).write.csv(path, header=True, quote="", escapeQuotes=False, sep="\u0001")
    return files.read_export(t.spark, path).select("pos", "student_id")


@query(
    "raw_audit",
    f"""WITH r AS (SELECT *, o_custkey FROM (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS s, o_orderstatus AS a,
        CASE WHEN o_custkey % 5 = 0 THEN 'NA' ELSE 'said ' || o_orderpriority END AS p FROM orders))
    SELECT reason, count(*) AS n FROM (SELECT 'field count' AS reason FROM r WHERE o_custkey % 50 = 0
      UNION ALL SELECT 'unknown item' FROM r WHERE o_custkey % 50 = 1 AND a = 'P') GROUP BY reason""",
)
def raw_audit(t: Tables):
    """Lines with a wrong number of fields or an unknown item are reported."""
    rows = B.derive(t.orders, [*RAW, "o_custkey"])
    line = F.concat_ws("\t", "student_id", "accession", "predict_from")
    broken = (
        F.when(F.col("o_custkey") % 50 == 0, F.concat(line, F.lit("\tmore")))
        .when(F.col("o_custkey") % 50 == 1, F.replace(line, F.lit("\tP\t"), F.lit("\tX\t")))
        .otherwise(line)
    )
    header = "\t".join(("student_id", "accession", "predict_from"))
    path = scratch_path(t.spark, "export")
    rows.select(broken.alias(header)).write.csv(path, header=True, quote="", escapeQuotes=False, sep="\u0001")
    items = t.orders.select(F.col("o_orderstatus").alias("item")).distinct()
    return files.audit_export(t.spark, path, items).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "csv_roundtrip",
    """SELECT doc_id, CASE WHEN text IN ('NA', 'nan', 'null', '') THEN NULL ELSE text END AS text, lang, n_chars FROM documents""",
)
def csv_roundtrip(t: Tables):
    """Texts with quotes, commas and line breaks survive; missing tokens do not."""
    path = scratch_path(t.spark, "csv")
    files.write_csv(t.documents.select("doc_id", "text", "lang", "n_chars"), path)
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()),
        ]
    )
    return files.read_csv(t.spark, path, schema)


@query("json_roundtrip", f"SELECT id, qid, predict1, predict2 FROM ({B.PREDICTIONS_SQL})")
def json_roundtrip(t: Tables):
    path = scratch_path(t.spark, "json")
    nested = B.predictions(t).select("id", "qid", F.array("predict1", "predict2").alias("p"))
    files.write_json(nested, path)
    back = t.spark.read.schema("id bigint, qid string, p array<int>").json(path)
    return back.select("id", "qid", F.col("p")[0].alias("predict1"), F.col("p")[1].alias("predict2"))


_ITEM = B.agreement_sql(f"SELECT run, split, qid, label AS t, predict5 AS p, 1 AS n FROM ({B.RUNS_SQL})", ["run", "split", "qid"])


@query(
    "metrics_json",
    f"{_ITEM} SELECT run, split || '_' || qid || '_kappa' AS metric, ROUND(quadratic_kappa, 6) AS value FROM agr",
)
def metrics_json(t: Tables):
    """Metrics of a run as one JSON object, read back as rows."""
    cells = A.confusion_cells(B.runs(t), ["run", "split", "qid"], "label", "predict5")
    scores = A.agreement(cells, ["run", "split", "qid"])
    named = scores.select("run", F.concat_ws("_", "split", "qid", F.lit("kappa")).alias("metric"), F.round("quadratic_kappa", 6).alias("value"))
    path = scratch_path(t.spark, "metrics")
    files.write_metrics_json(named, path)
    back = t.spark.read.schema("run string, metrics map<string,double>").json(path)
    return back.select("run", F.explode("metrics").alias("metric", "value"))


@query("partitioned_split", f"SELECT id, qid, label FROM ({B.PREDICTIONS_SQL}) WHERE qid = 'O'")
def partitioned_split(t: Tables):
    """Rows written by item; one item is read back and the other folders are not touched."""
    path = scratch_path(t.spark, "items")
    files.write_parts(B.predictions(t), path, ["qid"])
    return files.read_part(t.spark, path, qid="O").select("id", "qid", "label")


@query(
    "item_metadata",
    """WITH i AS (SELECT o_orderstatus AS qid, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders GROUP BY o_orderstatus)
    SELECT qid, 'item ' || qid AS name, CAST(n % 3 + 1 AS INT) AS type, 'A' AS part, 0 AS position, 'c' || CAST(lo AS VARCHAR) AS field FROM i
    UNION ALL SELECT qid, 'item ' || qid, CAST(n % 3 + 1 AS INT), 'A', 1, 'c' || CAST(hi AS VARCHAR) FROM i
    UNION ALL SELECT qid, 'item ' || qid, CAST(n % 3 + 1 AS INT), 'all', 0, 'c' || CAST(n AS VARCHAR) FROM i WHERE qid <> 'F'""",
)
def item_metadata(t: Tables):
    """A metadata object keyed by item, built from the table's items, with different keys per item."""
    items = t.orders.groupBy(F.col("o_orderstatus").alias("qid")).agg(
        F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    named = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    first = F.create_map(F.lit("A"), F.array(named("lo"), named("hi")))
    both = F.create_map(F.lit("A"), F.array(named("lo"), named("hi")), F.lit("all"), F.array(named("n")))
    entry = F.struct(
        F.concat(F.lit("item "), "qid").alias("name"), (F.col("n") % 3 + 1).alias("type"),
        F.when(F.col("qid") == "F", first).otherwise(both).alias("context_var"),
    )
    # one entry per item of the catalogue
    whole = items.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("qid", entry)))).alias("value"))
    path = scratch_path(t.spark, "items")
    whole.write.text(path)
    read = metadata.read_items(t.spark, path)
    return metadata.context_columns(read).join(read.select("qid", "name", "type"), "qid")


@query(
    "run_outputs",
    f"""SELECT run, split, CAST(id AS VARCHAR) AS id, qid, CAST(label AS VARCHAR) AS label_str, CAST(predict1 AS VARCHAR) AS predict1,
      CAST(predict3 AS VARCHAR) AS predict3, CASE WHEN run = 'run0' THEN CAST(predict5 AS VARCHAR) END AS predict5 FROM ({B.RUNS_SQL})""",
)
def run_outputs(t: Tables):
    """Prediction files of several runs with different epoch columns, found below one folder."""
    root = scratch_path(t.spark, "runs")
    rows = B.runs(t).withColumnRenamed("label", "label_str")
    for run in B.RUNS:
        for split in ("val", "test"):
            last = [] if run else ["predict5"]
            part = rows.where((F.col("run") == f"run{run}") & (F.col("split") == split))
            files.write_csv(part.select("id", "qid", "label_str", "predict1", "predict3", *last), f"{root}/run{run}/{split}_predict.csv")
    return files.read_run_outputs(t.spark, root)


@query(
    "window_of_run_outputs",
    f"""{B.agreement_sql(f"SELECT run, split, qid, label AS t, CAST(round_even((predict1 + predict2 + predict3) / 3.0, 0) AS INT) AS p, 1 AS n FROM ({B.RUNS_SQL})",
                         ['run', 'split', 'qid'])},
    m AS (SELECT run, qid, max(CASE WHEN split = 'val' THEN ROUND(quadratic_kappa, 12) END) AS val_kappa,
      max(CASE WHEN split = 'test' THEN ROUND(quadratic_kappa, 12) END) AS test_kappa FROM agr GROUP BY run, qid),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY val_kappa DESC, run) AS k FROM m WHERE val_kappa > 0)
    SELECT qid, run, 1 AS s, 3 AS e, ROUND(val_kappa, 6) AS val_kappa, ROUND(test_kappa, 6) AS test_kappa FROM r WHERE k = 1""",
)
def window_of_run_outputs(t: Tables):
    """The window search started from files."""
    root = scratch_path(t.spark, "runs")
    rows = B.runs(t).withColumnRenamed("label", "label_str")
    columns = ["id", "qid", "label_str", "predict1", "predict2", "predict3"]
    for run in B.RUNS:
        for split in ("val", "test"):
            part = rows.where((F.col("run") == f"run{run}") & (F.col("split") == split))
            files.write_csv(part.select(*columns), f"{root}/run{run}/{split}_predict.csv")
    found = files.read_run_outputs(t.spark, root)
    typed = found.select(
        "run", "split", F.col("id").cast("bigint").alias("id"), "qid", F.col("label_str").cast("int").alias("label"),
        *[F.col(c).cast("int").alias(c) for c in columns[3:]],
    )
    return B.six(S.best_window(S.window_agreement(typed.distinct())), "val_kappa", "test_kappa")

