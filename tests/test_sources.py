from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from verdictflow.operators import normalize
from verdictflow.sources import readers, writers


def test_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write('{"a": 1}\n\nnot json\n{"a": 2, "b": "é"}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "a.jsonl.gz")).count() == 2
    rows = readers.read_json_lines(spark, str(tmp_path / "a.jsonl.gz"), "a int, b string").collect()
    assert sorted((r.a, r.b) for r in rows) == [(1, None), (2, "é")]


def test_decisions_csv(spark, tmp_path):
    lines = [
        "﻿State,Question,Type,Options,Answer,Split",
        '"{""age"": 20}",Is it an adult?,yes/no,,Yes,',
        "text state,Which one?,choice,a|b=second,B,gate",
        "text state,Which one?,choice,a|a,a,",
        '"{bad",Is it?,,,no,',
        "x,Is it?,noul,,maybe,",
        ",Is it?,noul,,no,nowhere",
    ]
    (tmp_path / "d.csv").write_text("\n".join(lines), encoding="utf-8")
    rows = {r.line: r for r in readers.read_decisions_csv(spark, str(tmp_path / "d.csv")).collect()}
    assert rows[2].label == "true" and rows[2].type == "noul" and not rows[2].errors and rows[2].split in ("train", "gate")
    assert rows[3].label == "b" and rows[3].split == "gate" and rows[3].criteria[1].desc == "second"
    assert rows[4].errors == ["repeated option"] and rows[5].errors == ["state is not valid JSON"] and rows[6].errors == ["answer fits no option"]
    assert rows[7].errors == ["empty state", "unknown split"]


def test_gate_share_of_the_hash_split(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("state"), F.lit("q").alias("question"), F.lit("yes").alias("answer"), *[F.lit(None).cast("string").alias(c) for c in ("type", "options", "split", "source")])
    gate = readers.build_decisions(rows).where("split = 'gate'").count()
    assert 0.05 <= gate / 400 <= 0.15


def test_test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("state,instructions\ns,i\n")
    (tmp_path / "t.json").write_text(json.dumps([{"state": "s", "questions": {"q": {"type": "choice", "instructions": "i"}}}]))
    (tmp_path / "t.jsonl").write_text(json.dumps({"state": "s", "questions": {"q": {"instructions": "i"}}}) + "\nbroken\n")
    got = [readers.read_test_questions(spark, str(tmp_path / n)).select("state", "instructions", "type").first() for n in ("t.csv", "t.json", "t.jsonl")]
    assert [tuple(r) for r in got] == [("s", "i", "*"), ("s", "i", "choice"), ("s", "i", "noul")]


def test_logs_and_markdown(spark, tmp_path):
    (tmp_path / "x.log").write_text("- 1 2 3 4 5 6 7 8 all is well\nFATAL 1 2 3 4 5 6 7 8 disk blk_-12 gone\n")
    rows = readers.read_log_lines(spark, str(tmp_path / "x.log")).collect()
    assert sorted((r.alert or "", r.message) for r in rows) == [("", "all is well"), ("FATAL", "disk blk_-12 gone")]
    lines = spark.createDataFrame([("disk blk_-12 gone",), ("other",)], "value string")
    labels = spark.createDataFrame([("blk_-12", 1, 1), ("gone", 0, 2)], "key string, label int, pos int")
    assert {r.value: r.label for r in readers.label_lines(lines, labels).collect()} == {"disk blk_-12 gone": 1, "other": None}
    (tmp_path / "m.md").write_text("# t\n## Outages\n[Acme](http://a). It broke.\ntext\n## Data\n[Beta](http://b) Lost.\n")
    got = [tuple(r) for r in readers.read_markdown_list(spark, str(tmp_path / "m.md")).orderBy("company").collect()]
    assert got == [("Outages", "Acme", "http://a", "It broke."), ("Data", "Beta", "http://b", "Lost.")]


def test_checkpoint_and_publish(spark, tmp_path):
    items = spark.range(10).withColumnRenamed("id", "k")
    path = str(tmp_path / "done")
    assert writers.left_to_do(items, path, ["k"]).count() == 10
    writers.append_checkpoint(items.where("k < 4"), path)
    assert writers.left_to_do(items, path, ["k"]).count() == 6
    base, pointers = str(tmp_path / "v"), str(tmp_path / "p")
    writers.publish(items, base, pointers)
    writers.publish(items.where("k = 1"), base, pointers)
    assert writers.current(spark, base, pointers).count() == 1 and writers.current(spark, base, pointers, 1).count() == 10
    writers.write_json_lines(items.withColumn("split", F.lit("train")), str(tmp_path / "j"), gzip=True, split="split")
    assert spark.read.json(str(tmp_path / "j")).count() == 10
    assert writers.markdown_table(writers.manifest(items.withColumn("s", F.lit("a")), ["s"])).splitlines()[-1] == "| a | 10 |"
    with pytest.raises(ValueError, match="more than 3 rows"):
        writers.markdown_table(items, most=3)


def test_normalize(spark):
    rows = spark.createDataFrame(
        [(1, "our-cases-x", "q", "choice", ["a", "b", "c"], "b"), (2, "web", "q", "score", ["lo", "hi"], "1"), (3, "web", "q", "noul", None, "no"), (4, "web", "q", "score", ["lo", "hi"], "7")],
        "row_id int, source string, qid string, type string, keys array<string>, label string",
    )
    got = {r.row_id: (r.position, r.target) for r in normalize.adapt(rows).collect()}
    assert got == {1: (1, [0.005, 0.99, 0.005]), 2: (1, [0.1, 0.9]), 3: (0, [0.9, 0.1])}
    pairs = spark.createDataFrame([(" p ", "h", "7"), ("p", "h", "-1"), ("", "h", "1"), ("p", "h", "x"), ("é", "h", "1")], "p string, h string, l string")
    assert sorted(r.label for r in normalize.flat_pairs(pairs, F.col("p"), F.col("h"), F.col("l"), "s").collect()) == [0, 2]
    code = spark.createDataFrame([("a\nb\nc", "a\nX\nc")], "x string, y string")
    assert code.select(normalize.diff_window(F.col("x"), F.col("y"), 1).alias("d")).first().d == "a\nX\nc"
    assert normalize.before_after(code, "x", "y").count() == 2
    items = spark.createDataFrame([(1, "r", "t1"), (2, "r", "t2"), (3, "s", "t1"), (4, "r", "t1")], "id int, repo string, t string")
    got = {r.id: r.negative for r in normalize.hard_negatives(items, "repo", "id", "t").collect()}
    assert got == {1: "t2", 2: "t1", 3: "t2", 4: "t2"}  # a group of one text takes one of another group
