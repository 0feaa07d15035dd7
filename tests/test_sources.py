"""Readers and writers on small files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaframe.operators.embedding import pool_tokens
from kappaframe.operators.ordering import running_total
from kappaframe.plans.training_table import training_table, unlabelled_table
from kappaframe.sources import files, metadata, ranges


def test_export(spark, tmp_path):
    path = tmp_path / "export.txt"
    path.write_text(
        '﻿"student_id"\taccession\tpredict_from\n"1"\tVH1\tsaid "x", then\n2\tVH9\tNA\n3\tVH1\ta\tb\n', encoding="utf-8"
    )
    rows = files.read_export(spark, str(path)).orderBy("pos").collect()
    assert rows[0].asDict() == {"pos": 0, "student_id": "1", "accession": "VH1", "predict_from": "said x, then"}
    assert [r["student_id"] for r in rows] == ["1", "2", "3"]
    items = spark.createDataFrame([("VH1",)], "item string")
    audit = sorted((r["line"][0], r["reason"]) for r in files.audit_export(spark, str(path), items).collect())
    assert audit == [("2", "unknown item"), ("3", "field count")]


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,text,n\n1,"a ""b"", c\nd",2.0\n2,NA,\n3,0,nan\n')
    schema = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("text", T.StringType()), ("n", T.IntegerType()))])
    rows = [tuple(r) for r in files.read_csv(spark, str(path), schema).orderBy("id").collect()]
    assert rows == [(1, 'a "b", c\nd', 2), (2, None, None), (3, "0", None)]


@pytest.fixture
def ranges_of(spark):
    """Sets the bytes of a range; what was set before comes back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def cut(size):
        for name in names:
            spark.conf.set(name, str(size))

    yield cut
    for name, value in zip(names, before):
        spark.conf.set(name, value)


@pytest.mark.parametrize("size", [7, 40, 1000, 1 << 27])
def test_quoted_records_in_ranges(spark, tmp_path, ranges_of, size):
    draw = random.Random(4)
    want = []
    for name in ("b.csv", "a.csv"):
        rows = [[f"{name}{i}", "".join(draw.choice(['"', ",", "\n", "\r\n", "é", "word", " "]) for _ in range(draw.randint(0, 40)))] for i in range(60)]
        rows[7][1] = "x\n" * 300  # runs over many ranges
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\r\n" if name == "a.csv" else "\n", quoting=csv.QUOTE_ALL)
            out.writerows([["id", "a title\nin two lines"], *rows])
        want += rows
    ranges_of(size)
    records = ranges.quoted_records(spark, str(tmp_path))
    if size == 40:
        assert ranges.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 50
    got = [next(csv.reader(io.StringIO(r["record"], newline=""))) for r in records.collect()]
    assert sorted(got) == sorted(want)
    typed = files.read_csv(spark, str(tmp_path), T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]))
    told = {r["id"]: r["text"] for r in typed.collect()}
    assert len(told) == len(want) and all(told[i] == (t if t not in ("", "NA") else None) for i, t in want if t.strip(" ") == t)


@pytest.mark.parametrize("size", [9, 64, 1 << 27])
def test_positions_do_not_depend_on_ranges(spark, tmp_path, ranges_of, size):
    for k, name in enumerate(("part-1.txt", "part-0.txt", "part-2.txt")):
        body = "\n".join(f"{name}-{i}\tVH{i}\tsome text" for i in range(50 if k < 2 else 0))
        (tmp_path / name).write_text("id\taccession\ttext\n\n" + body + "\n\n")
    ranges_of(size)
    rows = files.read_export(spark, str(tmp_path)).collect()
    assert sorted((r["pos"], r["id"]) for r in rows) == [(50 * k + i, f"part-{k}.txt-{i}") for k in range(2) for i in range(50)]


def test_running_total(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 5) for i in range(101)], "k int, n bigint")
    got = running_total(df, ["k"], {"before": "n"}).orderBy("k").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["n"]
    assert len(got) == 101 and running_total(df.where("false"), ["k"], {"before": "n"}).collect() == []


def test_run_outputs(spark, tmp_path):
    for run, extra in (("a", ",predict3"), ("b", "")):
        (tmp_path / "deep" / run).mkdir(parents=True)
        for split in ("val", "test"):
            body = f"id,qid,label_str,predict1,predict2{extra}\n{run}{split},q,1,1,2" + (",3\n" if extra else "\n")
            (tmp_path / "deep" / run / f"{split}_predict.csv").write_text(body)
    (tmp_path / "deep" / "a" / "other.csv").write_text("x\n1\n")
    rows = {(r["run"], r["split"]): (r["id"], r["predict3"]) for r in files.read_run_outputs(spark, str(tmp_path)).collect()}
    assert rows == {
        ("a", "val"): ("aval", "3"), ("a", "test"): ("atest", "3"), ("b", "val"): ("bval", None), ("b", "test"): ("btest", None)
    }


def test_metadata(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(
        '{"q1": {"name": "n", "type": 3, "context_var": {"A": ["x", "y.1"]}, "reduce_label": {"3": ["3", "2A"]}},\n "q2": {"name": "m"}}'
    )
    items = metadata.read_items(spark, str(path))
    assert items.count() == 2
    assert [tuple(r) for r in metadata.context_columns(items).orderBy("position").collect()] == [
        ("q1", "A", 0, "x"), ("q1", "A", 1, "y.1")
    ]
    assert {tuple(r) for r in metadata.label_reduction(items).collect()} == {("q1", "3", "3"), ("q1", "2A", "3")}


def test_pooling_without_tokens(spark):
    rows = [(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 0.0], 1), (1, 2, [9.0, 9.0], 0), (2, 0, [5.0, 5.0], 0)]
    got = {r["id"]: r for r in pool_tokens(spark.createDataFrame(rows, "id bigint, pos int, vec array<float>, mask int"), 2).collect()}
    assert got[1]["mean"] == [2.0, 1.0] and got[1]["max"] == [3.0, 2.0] and got[1]["cls"] == [1.0, 2.0]
    assert got[2]["mean"] == [0.0, 0.0] and got[2]["max"] == [-1e9, -1e9] and got[2]["cls"] == [5.0, 5.0]


RAW = "pos bigint, student_id string, accession string, predict_from string, year string, score string, pta_rtr1 string, ptb_rtr1 string, partA_response_val string, partB_response_val string, partB_eliminations string"  # noqa: E501


def test_training_table(spark):
    rows = [
        (1, "s1", "VH271613", "since", "2017", None, "2", "2A", "c(1, 2)", "TRUE FALSE", None),
        (2, "s2", "VH266510", None, "2017.0", "3.0", None, None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, RAW)
    got = {r["id"]: r for r in training_table(raw).collect()}
    age = got["s1"]
    assert (age["qid"], age["label"], age["r_label"], age["est_score"]) == ("VH271613", "2A", "3", 1)
    assert age["text"] == "I choose A. since" and age["context_all"] == "Part A is correct: 4 older"
    assert (got["s2"]["qid"], got["s2"]["label"]) == ("VH266510_2017", "3")
    old = {r["id"]: r for r in training_table(raw, variant="0604").collect()}["s1"]
    assert old["text"] == "since" and old["context_all"] == "Student choose A. Part A is correct"
    assert {r["fold"] for r in unlabelled_table(raw.withColumn("student_id", F.col("pos"))).collect()} == {10}
