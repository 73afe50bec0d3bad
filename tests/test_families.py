from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verdictflow.operators import families
from verdictflow.operators.families import Family, FamilyQuestion


def test_families_of_given_states(spark):
    rows = spark.createDataFrame([(1, 2, True, "train"), (2, None, None, "eval"), (3, 9, False, "gate")], "id int, days int, reproduces boolean, part string")
    out = {(r["id"], r["family"], r["qid"]): r["label"] for r in families.gold_of(rows, ["id"], split=F.col("part")).collect()}
    assert {f for _, f, _ in out} == {"cert_expiry", "feedback_timeliness", "reproducibility"}  # only those whose fields are there
    assert out[1, "cert_expiry", "urgent"] == "true" and out[1, "cert_expiry", "level"] == "3" and out[3, "cert_expiry", "level"] == "2"
    assert out[2, "cert_expiry", "urgent"] == "false" and (2, "cert_expiry", "level") not in out
    assert (1, "reproducibility", "actionable") not in out and out[3, "reproducibility", "actionable"] == "false"  # for evaluation only
    assert families.gold_of(rows, ["id"], ["reproducibility"]).count() == 3
    assert not families.gold_of(rows.where("false"), ["id"]).collect()


def test_registry(spark):
    with pytest.raises(ValueError):
        families.register(families.FAMILIES["cert_expiry"])
    families.register(Family("everyone", "own", (FamilyQuestion("q", "choice", "CASE WHEN x > 1 THEN 'a' END"),)))
    try:
        got = families.gold_of(spark.createDataFrame([(1, 2), (2, 0)], "id int, x int"), ["id"], ["own"]).collect()
        assert [(r["id"], r["label"]) for r in got] == [(1, "a")]
    finally:
        del families.FAMILIES["own"]


def test_wordings_are_kept_for_their_splits(spark):
    assert [len(families.wordings_of(s)) for s in ("train", "eval", "gate")] == [2, 3, 1]
    rows = spark.range(300).select(F.col("id"), F.get(F.array(*map(F.lit, ("train", "eval", "gate"))), (F.col("id") % 3).cast("int")).alias("s"))
    seen = {}
    for r in rows.select("s", families.worded(F.lit("Is it?"), F.col("s"), F.col("id")).alias("w")).collect():
        seen.setdefault(r["s"], set()).add(r["w"])
    assert {s: len(w) for s, w in seen.items()} == {"train": 2, "eval": 3, "gate": 1} and not seen["gate"] & (seen["train"] | seen["eval"])
