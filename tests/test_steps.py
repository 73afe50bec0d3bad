"""Steering, calibration, shards and scoring of streams against sequential code, dense search and failures."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from verdictflow.operators import calibration, leaks, steering
from verdictflow.sources import writers
from verdictflow.streaming import scoring


def one_after_another(rows, margin):
    """rows: (id, group, answer) in order."""
    ahead, out = {}, {}
    for i, g, y in rows:
        d = ahead.get(g, 0)
        taken = True if y is None else d <= margin if y else d >= -margin
        out[i] = taken
        if y is not None and taken:
            ahead[g] = d + (1 if y else -1)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_steering_is_that_of_a_loop(spark, parts):
    for seed in range(3):
        r = random.Random(seed)
        share = {"a": 0.9, "b": 0.5, None: 0.05}
        rows = [(i, g := r.choice(["a", "b", None]), None if r.random() < 0.1 else r.random() < share[g], "x") for i in range(400)]
        df = spark.createDataFrame(rows, "id long, g string, y boolean, _part string").repartition(5)
        out = steering.steer(df, "y", "id", ["g"], margin=2, parts=parts)
        assert out.columns == ["id", "g", "y", "_part", "taken"]
        assert {x["id"]: x["taken"] for x in out.collect()} == one_after_another([x[:3] for x in rows], 2)
    assert steering.steer(df.where("false"), "y", "id").count() == 0
    whole = steering.steer(df, "y", "id", margin=0, parts=parts).where("taken and y is not null")
    assert abs(whole.agg(F.sum(F.when(F.col("y"), 1).otherwise(-1))).first()[0]) <= 1


def test_effects_compose():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.random() < 0.5 for _ in range(r.randint(0, 20))] for _ in range(2))
        whole, start = steering.effect(a + b, 3), r.randint(-3, 3)
        s = start
        for y in a + b:
            s = min(s + 1, 3) if y else max(s - 1, -3)
        assert min(max(start + whole[0], whole[1]), whole[2]) == s
        assert steering.effect(b, 3, steering.effect(a, 3)) == whole


def loss_at(rows, t):
    total = 0.0
    for z, target in rows:
        top = max(z)
        total += sum(target) * (math.log(sum(math.exp((x - top) / t) for x in z)) + top / t) - sum(x * y for x, y in zip(z, target)) / t
    return total / len(rows)


def test_temperatures_are_those_of_a_dense_search(spark):
    r = random.Random(6)
    made = {}
    for kind, scale, n in (("choice", 1.0, 80), ("score", 6.0, 60), ("noul", 0.2, 50), ("few", 1.0, 9), ("flat", 0.0, 20), ("sure", 1.0, 20), ("wrong", 1.0, 20)):
        rows = []
        for _ in range(n):
            z = [scale * r.gauss(0, 1) for _ in range(r.choice([2, 3, 5]))]
            odds = [math.exp(x / (scale or 1)) for x in z]
            pick = z.index(max(z)) if kind == "sure" else z.index(min(z)) if kind == "wrong" else r.choices(range(len(z)), odds)[0]
            peak = 1.0 if kind in ("sure", "wrong") else 0.9
            rows.append((z, [peak if i == pick else (1 - peak) / (len(z) - 1) for i in range(len(z))]))
        made[kind] = rows
    df = spark.createDataFrame([(k, z, t) for k, rows in made.items() for z, t in rows] + [("choice", None, None), ("choice", [1.0], [0.5, 0.5])], "kind string, z array<double>, t array<double>")
    got = {x["kind"]: x for x in calibration.fit_temperatures(df, "kind", "z", "t").collect()}
    assert got["few"]["temperature"] == 1.0 and got["flat"]["temperature"] == 1.0 and got["few"]["n"] == 9
    assert got["sure"]["temperature"] == 0.1 and got["wrong"]["temperature"] == 10.0
    for kind in ("choice", "score", "noul"):
        grid = [10 ** (-1 + 2 * i / 4000) for i in range(4001)]
        best = min(grid, key=lambda t: loss_at(made[kind], t))
        assert abs(math.log(got[kind]["temperature"] / best)) < 2e-3
        assert got[kind]["loss"] <= loss_at(made[kind], best) + 1e-9
    assert calibration.fit_temperatures(df.where("false"), "kind", "z", "t").count() == 0


def test_shards_and_publishing(spark, tmp_path):
    rows = spark.createDataFrame([(i, "é" * (i % 50)) for i in range(500)], "id long, text string")
    shards = writers.in_shards(rows, F.col("id"), 1000)
    sizes = writers.shard_manifest(shards).collect()
    assert max(x["bytes"] for x in sizes) <= 1000 and sum(x["rows"] for x in sizes) == 500 and len(sizes) >= sum(x["bytes"] for x in sizes) / 1000
    with pytest.raises(ValueError):
        writers.in_shards(rows, F.col("id"), 50)
    base, pointers = str(tmp_path / "v"), str(tmp_path / "p")
    first = writers.publish_shards(rows, F.col("id"), 1000, base, pointers)
    assert spark.read.json(f"{base}/{first}/shards").count() == 500

    def refuse(written):
        raise OSError("refused")

    with pytest.raises(OSError):
        writers.publish_shards(rows.where("id < 5"), F.col("id"), 1000, base, pointers, refuse)
    assert [r["version"] for r in spark.read.parquet(pointers).collect()] == [first]  # the old version stays
    assert writers.shard_manifest(writers.in_shards(rows.where("false"), F.col("id"), 1000)).count() == 0


def test_leaked_key_files(spark, tmp_path):
    q = "file string, kind string, question_id long, state string, instructions string, type string"
    train = spark.createDataFrame([("t", None, i, f"state {i}", "q", "noul") for i in range(9)], q)
    test = spark.createDataFrame([("e", "gate", i, f"state {i}", "q", None) for i in range(3, 12)], q)
    found = leaks.leaked_keys(train, test)
    writers.write_leaked_keys(found, leaks.leak_report(found, test), str(tmp_path))
    keys = [r["value"] for r in spark.read.text(f"{tmp_path}/exact").collect()]
    assert len(keys) == 6 and sorted(keys) == sorted(set(keys)) and spark.read.text(f"{tmp_path}/masked").count() == 1
    assert spark.read.json(f"{tmp_path}/report").first()["state"] == 6


def test_models_are_swapped_and_kept(spark):
    now, newest, loaded = [0.0], ["v1"], []

    def load(version):
        loaded.append(version)
        if version == "bad":
            raise OSError("no such file")
        return scoring.Model(version, lambda df: df.withColumn("by", F.lit(version)), lambda df: df.select("id", "by"))

    source = scoring.ModelSource(lambda: newest[0], load, clock=lambda: now[0])
    assert source.current().version == "v1"
    newest[0] = "v2"
    now[0] = 9
    assert source.current().version == "v1"  # not asked before ten seconds have passed
    now[0] = 10
    assert source.current().version == "v2"
    newest[0], now[0] = "bad", 20
    assert source.current().version == "v2" and "no such file" in source.failed["bad"]
    newest[0], now[0] = "v4", 79
    assert source.current().version == "v2"  # while it stands in, a minute
    now[0] = 80
    assert source.current().version == "v4" and loaded == ["v1", "v2", "bad", "v4"]
    with pytest.raises(LookupError):
        scoring.ModelSource(lambda: "bad", load).current()
    # swapped between encoding and scoring: encoded anew
    answers = iter(["v1", "v5", "v5", "v5"])
    swapping = scoring.ModelSource(lambda: next(answers), load, interval=0, fallback_interval=0)
    assert {tuple(r) for r in scoring.score_batch(spark.range(2), swapping).collect()} == {(0, "v5", "v5"), (1, "v5", "v5")}
