"""Small operators on rows and columns: options as pairs, identifiers with their labels, outcomes side by side, padding, rounding, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.text import hash_slot
from verdictflow.operators.datasets import cap_per_key, fresh


def option_pairs(rows: DataFrame, keep: Sequence[str], options: Column, right: Column, name: str = "hypothesis") -> DataFrame:
    """One row for each option: label 1 for the right one, 2 for the others. Rows without options give none."""
    return rows.select(*keep, right.alias("_right"), F.explode(options).alias(name)).select(*keep, name, F.when(F.col(name).eqNullSafe(F.col("_right")), 1).otherwise(2).alias("label"))


def extracted_keys(lines: DataFrame, ident: str, text: str, pattern: str) -> DataFrame:
    """(ident, key, n): identifiers in each line by a pattern, and how often each occurs there."""
    keys = F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0))
    return lines.select(ident, keys.alias("key")).groupBy(ident, "key").agg(F.count(F.lit(1)).alias("n"))


def labelled_keys(lines: DataFrame, order: str, text: str, pattern: str, labels: DataFrame, most: int = 15) -> DataFrame:
    """(key, label, lines): for each identifier in the lines with a label its first ``most`` lines, in order, one to a line. Identifiers whose
    labels contradict each other are left out. ``labels`` is (key, label)."""
    sure = labels.where("label is not null").groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    keys = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)))
    found = lines.select(F.col(order).alias("o"), F.col(text).alias("t"), keys.alias("key")).join(sure, "key")
    few = cap_per_key(found, ["key"], most, [F.col("o")])
    parts = F.sort_array(F.collect_list(F.struct("o", "t")))
    return few.groupBy("key", "label").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("lines"))


def last_written(rows: DataFrame, keys: Sequence[str], value: str, order: str | None) -> DataFrame:
    return rows.groupBy(*keys).agg((F.max_by(value, order) if order else F.max(value)).alias(value))


def stage_outcomes(first: DataFrame, second: DataFrame, keys: Sequence[str], values: tuple[str, str], order: str | None = None) -> DataFrame:
    """Outcomes of two stages side by side, null where a stage has none; of several for a key the last by ``order`` counts."""
    return last_written(first, keys, values[0], order).join(last_written(second, keys, values[1], order), list(keys), "full_outer")


def two_judges(items: DataFrame, a: DataFrame, b: DataFrame, key: str, values: tuple[str, str]) -> DataFrame:
    """``items`` with the verdicts of two judges, null where one has none; a judge's several verdicts on a key count as the greatest."""
    return items.join(last_written(a, [key], values[0], None), key, "left").join(last_written(b, [key], values[1], None), key, "left")


def padded(values: Column, length: Column | int, pad: object = 0) -> Column:
    """An array brought to a length: cut or filled up."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(F.slice(values, F.lit(1), n), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), n - F.size(values))))


def padded_batches(rows: DataFrame, batch: Column, values: str, pad: object = 0) -> DataFrame:
    """``rows`` with ``batch`` and ``values`` brought to the longest of their batch, and ``mask``, 1 where there was a value."""
    (most,) = fresh(rows, "_most")
    numbered = rows.withColumn("batch", batch)
    longest = numbered.groupBy("batch").agg(F.max(F.size(values)).alias(most))
    out = numbered.join(longest, "batch")
    mask = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(most))), lambda i: (i <= F.size(values)).cast("int"))
    # One after the other: within one projection the lambda would see the padded array.
    return out.withColumn("mask", F.slice(mask, F.lit(1), F.col(most))).withColumn(values, padded(F.col(values), F.col(most), pad)).drop(most)


def nice(value: Column) -> Column:
    """Rounded to its two leading digits."""
    step = F.pow(F.lit(10.0), F.length(F.abs(value.cast("long")).cast("string")) - 2)
    return F.round(value / step) * step


def largest_gap(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cross_entropy(probabilities: Column, position: Column) -> Column:
    return -F.log(F.get(probabilities, position))


def logit_gap(first: Column, second: Column, temperature: float = 1.0) -> Column:
    """The difference of two logits, recovered from their probabilities at a temperature."""
    return F.lit(temperature) * (F.log(first) - F.log(second))


def near_threshold(key: Column, value: Column, threshold: Column | int, step: Column | int = 1, share: float = 0.4, salt: str = "s") -> Column:
    """A value for a key: for ``share`` of the keys one step beside the threshold, half of these on either side, else as it is."""
    h = hash_slot(F.concat(F.lit(salt), key.cast("string")))
    t, s = (x if isinstance(x, Column) else F.lit(x) for x in (threshold, step))
    return F.when(h < share / 2, t - s).when(h < share, t + s).otherwise(value)


def flipped(rows: DataFrame, flip: str, decide: str, judge, key: str) -> DataFrame:  # noqa: ANN001
    """Near misses: (key, decision, decision with one fact turned round) where they differ; ``judge`` makes the decision's column."""
    a = judge(rows).select(key, decide)
    b = judge(rows.withColumn(flip, ~F.col(flip))).select(key, F.col(decide).alias("flipped"))
    return a.join(b, key).where(F.col(decide) != F.col("flipped"))


def elapsed_seconds(start: Column, now: Column) -> Column:
    """Whole seconds from one time to another, null if either is missing."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000)


def past_deadline(start: Column, now: Column, seconds: float) -> Column:
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(start.cast("timestamp")) > seconds * 1_000_000, F.lit(False))
