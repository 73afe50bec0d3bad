"""Thirteen plain decisions that any model must get right, and how a model did on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# State | question | type | options | expected.
CASES = """
{"stock_units":0} | Is the item out of stock? | noul | | yes
{"stock_units":500} | Is the item out of stock? | noul | | no
{"age":17} | Is this person an adult (18 or older)? | noul | | no
{"age":30} | Is this person an adult (18 or older)? | noul | | yes
{"checkout":"down for all users"} | Should on-call be paged? | noul | | yes
{"task":"making tea","pending":"nothing"} | Should on-call be paged? | noul | | no
{"command":"git push --force origin main"} | Does this command destroy data or rewrite shared history? | noul | | yes
{"command":"ls -la"} | Does this command destroy data or rewrite shared history? | noul | | no
{"log":"INFO GET /health 200 OK"} | Is this a failure an on-call engineer should act on? | noul | | no
{"log":"ERROR payment-service: connection refused to db (500)"} | Is this a failure an on-call engineer should act on? | noul | | yes
{"pending":["production checkout outage affecting all users","drink tea","reply to newsletter"]} | What should an on-call engineer do first? | choice | {"outage":"handle the production outage","tea":"drink tea","newsletter":"reply to the newsletter"} | outage
{"ticket":"I was charged twice this month"} | Which team should handle this ticket? | choice | {"billing":"payments and charges","engineering":"bugs and outages","sales":"new purchases"} | billing
{"incident":"site completely down for every user"} | How severe is this incident? | score | ["low","medium","high"] | high
"""


def cases() -> list[tuple[int, str, str, str, str, str]]:
    """(number, state, type, instructions, criteria, expected)"""
    lines = [[c.strip() for c in line.split(" | ")] for line in CASES.strip().replace(" | | ", " |  | ").splitlines()]
    return [(i, state, kind, question, options, expected) for i, (state, question, kind, options, expected) in enumerate(lines, 1)]


def questions(spark: SparkSession) -> DataFrame:
    """case, state, questions (JSON with the one question ``q``), expected: as ``decide`` takes them; 13 rows, a fixed size."""
    rows = spark.createDataFrame(cases(), "case int, state string, type string, instructions string, criteria string, expected string")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("instructions").alias("x"))), r'^\{"x":(.*)\}$', 1)
    more = F.when(F.col("criteria") != "", F.concat(F.lit(', "criteria": '), F.col("criteria"))).otherwise("")
    return rows.select("case", "state", F.concat(F.lit('{"q": {"type": "'), F.col("type"), F.lit('", "instructions": '), quoted, more, F.lit("}}")).alias("questions"), "expected")


def report(answers: DataFrame) -> DataFrame:
    """n, correct and unsure of answers (case, expected, verdict); for a score the verdict is the name of its likeliest level."""
    same = F.coalesce(F.col("verdict") == F.col("expected"), F.lit(False))
    return answers.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("correct"), F.count_if(F.col("verdict") == "unsure").alias("unsure"))
