"""Leaks of test questions into training rows, by key at three levels.

``exact``: the same state (canonical JSON or squeezed text) and instructions. ``state``: the same word and number tokens of the state, in its
own or in sorted key order, asked with the same question type; a test question without a type matches any. ``masked``: as ``state`` with
numbers masked. Every way of matching is a key of its own, so each level is one equi-join on 256-bit digests: training questions carry their
keys with their type and with the wildcard, test questions with what they have. No condition has an OR, no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.text import canonical_json, mask_numbers, question_key, word_tokens

LEVELS = ("exact", "state", "masked")
ANY = "*"


def sequence_keys(sequences: Column, types: Column) -> Column:
    """A key for each token sequence with each of the types."""
    return F.flatten(F.transform(sequences, lambda s: F.transform(types, lambda t: F.sha2(F.concat(s, F.lit("||"), t).cast("binary"), 256))))


def leak_keys(questions: DataFrame, test: bool) -> DataFrame:
    """``questions`` (state, instructions, type and others) with a row for each of their keys: level, key. Null states and instructions
    count as empty."""
    own = F.coalesce(F.col("type"), F.lit(ANY))
    types = F.array(own) if test else F.array_distinct(F.array(own, F.lit(ANY)))
    level = lambda name, keys: F.transform(keys, lambda k: F.struct(F.lit(name).alias("level"), k.alias("key")))
    others = [c for c in questions.columns if c not in ("state", "instructions", "type")]
    # Column by column: in one expression, and above all within a generator, Spark would parse and cut a state anew for each use.
    state, json, tokens, ordered, plain, masked, kinds, exact, keys = (f"_leak_{n}" for n in ("state", "json", "tokens", "ordered", "plain", "masked", "types", "exact", "keys"))
    joined = lambda c: F.array_join(word_tokens(c), " ")
    rows = questions.select(*others, F.coalesce(F.col("state"), F.lit("")).alias(state), F.coalesce(F.col("instructions"), F.lit("")).alias("instructions"), types.alias(kinds))
    rows = rows.withColumn(json, canonical_json(F.col(state)))
    rows = rows.select(*others, kinds, question_key(F.col(state), F.col("instructions"), F.col(json)).alias(exact), joined(F.col(state)).alias(tokens), joined(F.col(json)).alias(ordered))
    rows = rows.withColumn(plain, F.array_distinct(F.array(tokens, F.coalesce(ordered, tokens))))
    rows = rows.withColumn(masked, F.array_distinct(F.transform(plain, mask_numbers)))
    rows = rows.select(*others, F.concat(level("exact", F.array(exact)), level("state", sequence_keys(F.col(plain), F.col(kinds))), level("masked", sequence_keys(F.col(masked), F.col(kinds)))).alias(keys))
    return rows.select(*others, F.explode_outer(keys).alias("k")).select(*others, "k.level", "k.key")


def leaked_keys(train: DataFrame, test: DataFrame) -> DataFrame:
    """(level, key, file): the keys common to both sides with the first training file (by name) that has them. ``train`` and ``test`` are
    questions with a column ``file``. Spark broadcasts the test's keys if they prove small at run time, else both sides are shuffled."""
    wanted = leak_keys(test.select("state", "instructions", "type"), True).distinct()
    return leak_keys(train.select("file", "state", "instructions", "type"), False).join(wanted, ["level", "key"], "left_semi").groupBy("level", "key").agg(F.min("file").alias("file"))


def leak_report(leaked: DataFrame, test: DataFrame) -> DataFrame:
    """(file, kind, questions, exact, state, masked) for each file of ``test`` (file, kind, question_id, state, instructions, type): its
    questions, and how many of them have a leaked key at each level. question_id tells the questions of a file apart."""
    keyed = leak_keys(test, True)
    hits = keyed.join(leaked.select("level", "key"), ["level", "key"], "left_semi").select("file", "question_id", "level").distinct()
    counts = hits.groupBy("file").agg(*[F.count_if(F.col("level") == n).alias(n) for n in LEVELS])
    files = test.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("questions"))
    return files.join(counts, "file", "left").na.fill(0, list(LEVELS))


def contributions(leaked: DataFrame) -> DataFrame:
    """(file, level, keys): distinct leaked keys by the training file that has them first."""
    return leaked.groupBy("file", "level").agg(F.count(F.lit(1)).alias("keys"))


def failed_gates(report: DataFrame) -> DataFrame:
    """Gate files of a report that share states with the training: a release must not pass with any."""
    return report.where("kind = 'gate' and state > 0")


def without_leaked(train: DataFrame, leaked: DataFrame) -> DataFrame:
    """Training questions whose exact key is not leaked; leaks of states are reported and remove nothing."""
    key = question_key(F.coalesce("state", F.lit("")), F.coalesce("instructions", F.lit("")))
    exact = leaked.where("level = 'exact'").select(F.col("key").alias("_leaked"))
    return train.join(exact, key == F.col("_leaked"), "left_anti")
