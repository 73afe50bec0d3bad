"""Edge cases of answers, generated questions, gates, snapshots, balancing and quantiles."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from verdictflow.operators import answers as N
from verdictflow.operators import datasets as O
from verdictflow.operators import evaluation as E


def test_legal_answers(spark):
    rows = [("noul", '"TRUE"', True), ("noul", "yes", False), ("choice", " b", True), ("choice", "c", False), ("score", "1", True), ("score", "2", False), ("score", "-1", False), ("score", "99999999999", False), ("noul", None, False), ("other", "a", False), (None, "a", False)]
    df = spark.createDataFrame(rows, "kind string, answer string, want boolean")
    got = df.select("want", N.legal_answer(F.col("kind"), F.col("answer"), F.array(F.lit("a"), F.lit("b"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_answer_objects(spark):
    texts = [('```\n{"a": 1}\n{bad\n```', 1), ('so [{"a": [1]}, 3, "x", {"b": 2}] end', 2), ("[broken", 0), ("", 0), (None, 0)]
    df = spark.createDataFrame(texts, "t string, n int")
    assert all(r.n == r.m for r in df.select("n", F.size(N.answer_objects(F.col("t"))).alias("m")).collect())


def test_reference_ids_and_fields(spark):
    df = spark.createDataFrame([("it-ops desk", "k", '{"source": "a b"}'), ("--", "k", '{"source": 1}'), (None, "k", None)], "d string, k string, line string")
    got = df.select(N.reference_id(F.col("d"), F.col("k")).alias("r"), N.raw_field(F.col("line"), "source").alias("s")).collect()
    assert [r.r.split("-")[0] for r in got] == ["ITOPS", "REF", "REF"] and all(100_000 <= int(r.r.split("-")[1]) <= 999_999 for r in got)
    assert [r.s for r in got] == ["a b", None, None]


def test_bare_dates_agree_with_python(spark):
    today = dt.date(2024, 3, 1)
    rows = [(today, today + dt.timedelta(days=k), k % 8, w) for k in (-1, 0, 1) for w in range(8)]
    df = spark.createDataFrame(rows, "t date, d date, thing int, w int")
    tests = {"<": lambda d, t: d < t, ">=": lambda d, t: d >= t, "=": lambda d, t: d == t, ">": lambda d, t: d > t, "<=": lambda d, t: d <= t}
    for r in df.select("*", N.bare_date(F.col("t"), F.col("d"), F.col("thing"), F.col("w"))[1].alias("q"), N.bare_date(F.col("t"), F.col("d"), F.col("thing"), F.col("w"))[2].alias("gold")).collect():
        wording, test = N.BARE_QUESTIONS[r.w]
        assert r.gold == tests[test](r.d, r.t)
        assert r.q == wording.format(n=N.BARE_THINGS[r.thing][0], f=N.BARE_THINGS[r.thing][2], t=r.t, d=r.d)


def test_empty_log_and_missing_figures(spark):
    log = spark.createDataFrame([], "ts long, ms double, error string, questions long, tokens long")
    assert list(N.full_snapshot(log, [F.desc("ts")]).first()) == [0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0]
    metrics = spark.createDataFrame([(None, 0.0)], "confident_right double, confident_wrong double")
    assert N.release_gate(metrics, F.lit(13), F.lit(1), 1).first().failures == ["confident_right"]


def test_snapshot_keeps_the_last_latencies_only(spark):
    log = spark.createDataFrame([(k, float(k), None, 1, 2) for k in range(100)], "ts long, ms double, error string, questions long, tokens long")
    got = N.full_snapshot(log, [F.desc("ts")], 10).first()
    assert (got.requests_total, got.input_tokens_total, got.latency_ms_avg, got.latency_ms_p50, got.latency_ms_max) == (100, 200, 49.5, 94.0, 99.0)


def test_quantiles_of_hot_groups_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(None if g == 2 else str(g), float(rng.choice([5, rng.randint(0, 10**6)])) if g else rng.random()) for g in (0, 0, 0, 1, 2) for _ in range(4000)] + [("one", 3.0), ("none", None)]
    points = {"a": 0.0, "b": 0.0001, "c": 0.5, "d": 0.95, "e": 0.9999, "f": 1.0}
    got = {r.g: r for r in E.floor_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", points).collect()}
    assert set(got) == {"0", "1", None, "one"}
    for g, r in got.items():
        values = sorted(v for k, v in rows if k == g and v is not None)
        assert r.n == len(values) and [r[x] for x in points] == [values[int(p * (len(values) - 1))] for p in points.values()]
    total = E.floor_quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"m": 0.5}).first()
    values = sorted(v for _, v in rows if v is not None)
    assert (total.n, total.m) == (len(values), values[(len(values) - 1) // 2])


def test_quantiles_of_groups_of_every_size(spark):
    rng = random.Random(2)
    rows = [(n, rng.random()) for n in [*range(1, 130), 20_003] for _ in range(n)]
    points = {"a": 0.5, "b": 0.95, "c": 0.99}
    for r in E.floor_quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", points).collect():
        values = sorted(v for g, v in rows if g == r.g)
        assert [r[x] for x in points] == [values[int(p * (len(values) - 1))] for p in points.values()]


def test_balance_of_a_hot_label(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, "few").when(F.col("id") % 50 > 1, "many").alias("label"))
    got = O.balance(rows, "label", F.sha2(F.col("id").cast("string").cast("binary"), 256))
    assert got.columns == ["id", "label"]
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {"few": 100, "many": 100, None: 100}
    assert O.balance(rows.where("false"), "label", F.sha2(F.col("id").cast("string").cast("binary"), 256)).count() == 0


def test_numbers_in_short_form(spark):
    cases = {0.0: "0", 12.5: "12.5", 999999.0: "999999", 1e6: "1e+06", 1234567.0: "1.234567e+06", 1500000.25: "1.50000025e+06", 1e7: "1e+07", 123456789.0: "1.23456789e+08", 1.5e12: "1.5e+12"}
    rows = spark.createDataFrame([(v,) for v in cases], "v double")
    assert {r[0]: r[1] for r in rows.select("v", N.short_number(F.col("v"))).collect()} == cases
