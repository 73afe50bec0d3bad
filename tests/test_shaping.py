from __future__ import annotations

from pyspark.sql import functions as F

from verdictflow.operators import shaping as S


def test_stages_and_judges(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 1)], "k int, v string, at int")
    b = spark.createDataFrame([(3, "z", 1), (1, "w", 1)], "k int, u string, at int")
    assert {tuple(r) for r in S.stage_outcomes(a, b, ["k"], ("v", "u"), "at").collect()} == {(1, "y", "w"), (2, None, None), (3, None, "z")}
    assert {tuple(r) for r in S.two_judges(spark.createDataFrame([(1,), (4,)], "k int"), a, b, "k", ("v", "u")).collect()} == {(1, "y", "w"), (4, None, None)}


def test_labelled_keys(spark):
    lines = spark.createDataFrame([(i, f"id-{i % 3} says {i} id-{i % 3}") for i in range(60)] + [(99, None), (98, "id-9")], "n int, t string")
    labels = spark.createDataFrame([("id-0", 1), ("id-0", 1), ("id-1", 0), ("id-1", 1), ("id-2", None), ("id-9", 0)], "key string, label int")
    got = {r["key"]: (r["label"], r["lines"].split("\n")) for r in S.labelled_keys(lines, "n", "t", r"id-\d", labels).collect()}
    assert set(got) == {"id-0", "id-9"} and got["id-0"][0] == 1 and got["id-0"][1] == [f"id-0 says {i} id-0" for i in range(0, 45, 3)]


def test_padding(spark):
    rows = spark.createDataFrame([(1, [5, 6, 7]), (2, [8]), (3, []), (4, [1, 2])], "k int, v array<int>")
    got = {r["k"]: (r["v"], r["mask"]) for r in S.padded_batches(rows, F.col("k") % 2, "v", 9).collect()}
    assert got == {1: ([5, 6, 7], [1, 1, 1]), 3: ([9, 9, 9], [0, 0, 0]), 2: ([8, 9], [1, 0]), 4: ([1, 2], [1, 1])}
    assert rows.select(S.padded(F.col("v"), 2)).first()[0] == [5, 6]


def test_times(spark):
    row = spark.sql("SELECT timestamp'2024-01-01 00:00:00.5' AS a, timestamp'2024-01-01 00:01:00.4' AS b, cast(null AS timestamp) AS n")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    assert tuple(row.select(S.elapsed_seconds(a, b), S.elapsed_seconds(n, b), S.past_deadline(a, b, 59), S.past_deadline(a, b, 60), S.past_deadline(n, b, 1)).first()) == (59, None, True, False, False)


def test_pairs_and_thresholds(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], "b"), (2, [], "x"), (3, ["a"], None)], "k int, o array<string>, r string")
    assert {tuple(x) for x in S.option_pairs(rows, ["k"], F.col("o"), F.col("r")).collect()} == {(1, "a", 2), (1, "b", 1), (3, "a", 2)}
    near = spark.range(2000).select(S.near_threshold(F.col("id"), F.lit(-1), 25, 2).alias("v")).groupBy("v").count().collect()
    counts = {r["v"]: r["count"] for r in near}
    assert set(counts) == {-1, 23, 27} and all(300 < counts[v] < 500 for v in (23, 27))
