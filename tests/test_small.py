"""Renderings, corrupted calls, archives and the thirteen fundamentals."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

from verdictflow.functions import renderings
from verdictflow.operators import deciding, fundamentals
from verdictflow.sources import archives


def test_renderings(spark):
    state = json.dumps({"a_b": 1, "c": {"d": [True, {"e": None}], "f": "x"}, "log": "two\nlines", "ok": False})
    rows = spark.createDataFrame([(state,), ("plain text",), ("[1, [2]]",), ("7",), (None,), ("{}",)], "s string")
    got = [tuple(r) for r in rows.select(renderings.situation("s"), renderings.pairs("s"), renderings.log_with_context("s")).collect()]
    assert got[0] == (
        "Situation: a b is 1. c d item 1 is True. c d item 2 e is None. c f is x. log is two\nlines. ok is False.",
        'a b: 1; c: {"d": [true, {"e": null}], "f": "x"}; log: two\nlines; ok: false',
        "Log:\ntwo\nlines\n\nContext: a b is 1; c is {'d': [True, {'e': None}], 'f': 'x'}; ok is false.",
    )
    assert got[1] == ("plain text", "plain text", None) and got[2][0] == "Situation: item 1 is 1. item 2 item 1 is 2." and got[3][0] == "Situation:  7."
    assert got[4] == (None, None, None) and got[5][0] == "Situation: ."


def test_wrong_arguments(spark):
    call = {"name": "n", "arguments": {"flag": True, "list": [1, 2], "none": [], "f": 2.5, "s": "v"}}
    assert renderings.wrong_arguments(call, 9) == [
        ("shorter list", {"name": "n", "arguments": {**call["arguments"], "list": [1]}}),
        ("wrong value", {"name": "n", "arguments": {**call["arguments"], "f": 3.5}}),
        ("wrong type", {"name": "n", "arguments": {**call["arguments"], "f": "2.5"}}),
        ("wrong value", {"name": "n", "arguments": {**call["arguments"], "s": "v-x"}}),
        ("wrong type", {"name": "n", "arguments": {**call["arguments"], "s": 1}}),
        ("missing field", {"name": "n", "arguments": {k: v for k, v in call["arguments"].items() if k != "flag"}}),
    ]
    rows = spark.createDataFrame([(json.dumps(call),), ("no json",), (None,), ('{"arguments": {"x": 1}}',)], "c string")
    assert [len(r[0]) for r in rows.select(renderings.corruptions("c")).collect()] == [3, 0, 0, 2]


def test_archives(spark, tmp_path):
    files = {"logs/a.log": "k1 went\n\nk2 stayed\n", "logs/b.txt": "k1 and k2\nbad \xff byte\n", "anomaly_label.csv": "k1,x,Anomaly\nk2,Normal\nk1,Normal\nk1,fail\nno verdict\n", "README.txt": "k1\n", "data.csv": "k1,1\n"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, text in files.items():
            z.writestr(name, text.encode("latin-1"))
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("deep/x.log")
        info.size = len(b"k2 here\n" * 3)
        t.addfile(info, io.BytesIO(b"k2 here\n" * 3))
    (tmp_path / "broken.zip").write_bytes((tmp_path / "z.zip").read_bytes()[:200])
    raw = archives.archive_lines(spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("file"), "content"))
    assert raw.where("error is not null").select(F.element_at(F.split("archive", "/"), -1)).first()[0] == "broken.zip"
    got = {(r["member"], r["line"]): (r["text"], r["label"]) for r in archives.read_log_archives(spark, str(tmp_path)).collect()}
    assert got == {
        ("logs/a.log", 1): ("k1 went", 1), ("logs/a.log", 3): ("k2 stayed", 0), ("logs/b.txt", 1): ("k1 and k2", 1), ("logs/b.txt", 2): ("bad  byte", None),
        **{("deep/x.log", i): ("k2 here", 0) for i in (1, 2, 3)},
    }
    assert archives.read_log_archives(spark, str(tmp_path), 1).count() == 2
    assert [r["text"] for r in archives.archive_lines(spark.createDataFrame([("p", bytearray(b"plain\n line "))], "file string, content binary")).collect()] == ["plain", "line"]


def test_fundamentals(spark):
    rows = fundamentals.questions(spark)

    def scorer(ids: pd.Series, markers: pd.Series) -> pd.Series:  # always the first option, sure of it
        return pd.Series([[9.0] + [0.0] * (len(m) - 1) for m in markers])

    answers = deciding.decide(rows, scorer, public_tokenizers.path("byte_bpe_50k.json"))
    assert answers.where(F.size("errors") > 0).count() == 0
    names = F.when(F.col("type") == "score", F.get(F.array(*map(F.lit, ("low", "medium", "high"))), F.round("score").cast("int"))).otherwise(F.col("verdict"))
    made = fundamentals.report(answers.withColumn("verdict", names)).first()
    assert (made["n"], made["correct"], made["unsure"]) == (13, 7, 0)  # the five with "no" and both choices
