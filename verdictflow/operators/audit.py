"""Audit flow and set checks: trusted keys, judge stages, preferred judges, forbidden states and facts, hold-outs and hash orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.operators.datasets import fresh

# Confidence of a conflict, clarity up to which a question is ambiguous, largest calibration hold-out.
CONFLICT_CONFIDENCE, AMBIGUOUS_CLARITY, HOLDOUT_MOST = 0.9, 2, 400
INT8_MOST = 127


def hash_order(key: Column, seed: object) -> Column:
    """A hexadecimal digest to order by: the same order in every run and engine, another one for every seed."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def drop_sources(rows: DataFrame, source: str, names: Sequence[str]) -> DataFrame:
    """Rows whose source is none of ``names``; rows without a source stay."""
    return rows.where(F.col(source).isNull() | ~F.col(source).isin(*names))


def join_gold(questions: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Questions with their gold answers; questions without one go, as do null answers (column ``label``)."""
    return questions.join(gold.where("label is not null"), list(keys))


def prefer_first(items: DataFrame, a: DataFrame, b: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """``items`` with the verdict of judge ``a``, else that of ``b``, and which judge gave it (null if neither).

    A judge with several rows for a key counts with the last by ``order`` (without one: with the greatest verdict), so items are not doubled."""
    first, second = (j.groupBy(key).agg(F.max_by(value, order or value).alias(name)) for j, name in ((a, "_a"), (b, "_b")))
    joined = items.join(first, key, "left").join(second, key, "left")
    judge = F.when(F.col("_a").isNotNull(), "a").when(F.col("_b").isNotNull(), "b")
    return joined.withColumn(value, F.coalesce("_a", "_b")).withColumn("judge", judge).drop("_a", "_b")


def without_facts(rows: DataFrame, known: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows whose facts (the fields together, null equal to null) are not among those of ``known``. With the state as the only field:
    rows whose state is in no gate or test file, whatever the question's type."""
    other = known.select(*[F.col(f).alias(f"_k_{f}") for f in fields]).distinct()
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_k_{f}"))
    return rows.join(other, same, "left_anti")


def redraw(candidates: DataFrame, taken: DataFrame, fields: Sequence[str], n: int, order: Column) -> DataFrame:
    """``n`` of a surplus of candidates, none of them with facts that are taken: a top-n by ``order``."""
    return without_facts(candidates, taken, fields).orderBy(order).limit(n)


def calibration_holdout(rows: DataFrame, key: Column, seed: object) -> DataFrame:
    """At most ``HOLDOUT_MOST`` rows and at most a tenth of all, those with the least digests of the key."""
    place, most = fresh(rows, "_place", "_most")
    size = rows.agg(F.least(F.lit(HOLDOUT_MOST), F.floor(F.count(F.lit(1)) / 10)).alias(most))
    few = rows.withColumn(place, hash_order(key, seed)).orderBy(place).limit(HOLDOUT_MOST)
    numbered = few.withColumn(place, F.row_number().over(Window.orderBy(place)))  # of at most HOLDOUT_MOST rows
    return numbered.join(F.broadcast(size)).where(F.col(place) <= F.col(most)).drop(place, most)


def shuffled(rows: DataFrame, key: Column, seed: object) -> DataFrame:
    """All rows in a seeded order, with ``place_key``, the digest they are ordered by."""
    return rows.withColumn("place_key", hash_order(key, seed)).orderBy("place_key")


def shuffle_options(options: Column, key: Column, seed: object) -> Column:
    """The options of a row in an order of the row's own: by the digest of key and option."""
    tagged = F.transform(options, lambda o: F.struct(hash_order(F.concat(key.cast("string"), F.lit(":"), o), seed).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(tagged), lambda x: x["o"])


def sample_options(options: Column, key: Column, seed: object, n: int) -> Column:
    """``n`` of the options, by the same order."""
    return F.slice(shuffle_options(options, key, seed), 1, n)


def options_by_key(options: Column) -> Column:
    """The values of a map of options, in the order of their keys."""
    return F.transform(F.array_sort(F.map_keys(options)), lambda k: F.element_at(options, k))


def strip_quotes(text: Column) -> Column:
    """Without blanks, backticks and quotes at both ends."""
    return F.regexp_replace(text, r"""^[\s`"']+|[\s`"']+$""", "")


def rate_report(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    """n and rate of each group, highest rate first; equal rates by the group's name."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("rate")).orderBy(F.desc("rate"), by)


def median_of_runs(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("runs"))


def abs_max_scales(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Scale of each column of weights for eight-bit integers: its largest absolute value over 127."""
    most = F.max(F.abs(value))
    return rows.groupBy(column).agg((most / F.lit(float(INT8_MOST))).alias("scale"))


def trusted_keys(rows: DataFrame, basic: DataFrame) -> DataFrame:
    """Distinct (key, label) of rows whose human labels agree (column ``agree``), and of the basic rows, which are trusted as they are."""
    return rows.where(F.coalesce("agree", F.lit(False))).select("key", "label").union(basic.select("key", "label")).distinct()


def stage_one_conflicts(judged: DataFrame) -> DataFrame:
    """Rows where a confident judge differs from gold."""
    return judged.where((F.col("label") != F.col("gold")) & (F.col("conf") >= CONFLICT_CONFIDENCE))


def stage_two(sampled: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Keys for the second judge, each once: the sample and the conflicts; ``why`` tells a conflict, which wins over the sample."""
    both = sampled.select("key", F.lit("sample").alias("why")).union(conflicts.select("key", F.lit("conflict").alias("why")))
    return both.groupBy("key").agg(F.min("why").alias("why"))


def audit_flags(clarity_a: Column, clarity_b: Column, verdict_a: Column, verdict_b: Column, gold: Column) -> tuple[Column, Column]:
    """(bad, unclear): both judges differ from gold; both find the question ambiguous. A missing judge is neither."""
    bad = F.coalesce((verdict_a != gold) & (verdict_b != gold), F.lit(False))
    unclear = F.coalesce((clarity_a <= AMBIGUOUS_CLARITY) & (clarity_b <= AMBIGUOUS_CLARITY), F.lit(False))
    return bad, unclear


def flagged_sources(reviewed: DataFrame, source: str = "source") -> DataFrame:
    """Sources that are not to be kept (column ``decision``)."""
    return reviewed.where(F.col("decision") != "KEEP").select(source)


def pinned_mismatches(files: DataFrame, pins: DataFrame) -> DataFrame:
    """(name, digest, pinned) of files (name, content) whose SHA-256 is not the pinned one, and of pins (name, pinned) without a file."""
    digests = files.select("name", F.sha2("content", 256).alias("digest"))
    return pins.join(digests, "name", "left").where(~F.col("digest").eqNullSafe(F.lower("pinned"))).select("name", "digest", "pinned")
