"""Temperatures that fit logits to their targets, for all question types at once.

In b = 1 / temperature the cross-entropy of a type is convex, and its first two derivatives are sums over rows. Each step is one aggregation
that gives both for all types; Newton's step is taken where it stays between the bounds known so far, else their middle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH, FEW = 0.1, 10.0, 10
STEPS, CLOSE = 60, 1e-10


def one_hot(position: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i == position).cast("double"))


def slopes(rows: DataFrame, kind: str, logits: str, target: str, b: Column) -> DataFrame:
    """kind, n, loss, slope, curve: the mean cross-entropy at 1 / b and its derivatives in b."""
    z, t = F.col(logits), F.col(target)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    dot = lambda x, y: add(F.zip_with(x, y, lambda p, q: p * q))
    made = rows.select(F.col(kind).alias("kind"), z.alias("z"), t.alias("t"), b.alias("b")).withColumn("top", F.array_max("z"))
    made = made.withColumn("w", F.transform("z", lambda x: F.exp((x - F.col("top")) * F.col("b")))).withColumn("all", add(F.col("w")))
    mean = dot(F.col("w"), F.col("z")) / F.col("all")
    made = made.withColumns({"mean": mean, "whole": add(F.col("t")), "own": dot(F.col("t"), F.col("z"))})
    spread = add(F.zip_with("w", "z", lambda w, x: w * (x - F.col("mean")) * (x - F.col("mean")))) / F.col("all")
    loss = F.col("whole") * (F.log("all") + F.col("top") * F.col("b")) - F.col("b") * F.col("own")
    return made.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg(F.col("whole") * F.col("mean") - F.col("own")).alias("slope"), F.avg(F.col("whole") * spread).alias("curve"))


def fit_temperatures(rows: DataFrame, kind: str, logits: str, target: str) -> DataFrame:
    """kind, n, temperature, loss: for each of the (few) types the temperature of least mean cross-entropy between ``LOW`` and ``HIGH``; 1.0
    for types of fewer than ``FEW`` rows. ``target`` is an array of probabilities beside the logits; rows without either are left out.

    A handful of passes over the rows, so give it a calibration hold-out, best a written or cached table. Types without any slope (all
    logits of a row equal) keep 1.0."""
    rows = rows.where(F.col(logits).isNotNull() & F.col(target).isNotNull() & (F.size(logits) == F.size(target)) & (F.size(logits) > 0))
    spark = rows.sparkSession
    first = {r["kind"]: r for r in slopes(rows, kind, logits, target, F.lit(1.0)).collect()}
    at = dict.fromkeys(first, 1.0)
    bounds = {k: [1 / HIGH, 1 / LOW] for k in first}
    still = {k for k, r in first.items() if r["n"] >= FEW and not (r["slope"] == 0 and r["curve"] == 0)}
    seen = first

    def current(values: dict) -> Column:
        out = F.lit(1.0)
        for k, v in values.items():
            out = F.when(F.col(kind).eqNullSafe(F.lit(k)), F.lit(v)).otherwise(out)
        return out

    for step in range(STEPS):
        if not still:
            break
        if step:
            seen = {r["kind"]: r for r in slopes(rows, kind, logits, target, current(at)).collect()}
        for k in list(still):
            low, high = bounds[k]
            r, b = seen[k], at[k]
            bounds[k] = [low, b] if r["slope"] > 0 else [b, high]
            low, high = bounds[k]
            newton = b - r["slope"] / r["curve"] if r["curve"] > 0 else math.nan
            ends = {1 / HIGH, 1 / LOW}
            if low < newton < high:
                to = newton
            elif r["curve"] > 0 and (newton <= low and low in ends or newton >= high and high in ends) and b not in ends:
                to = low if newton <= low else high
            else:
                to = (low + high) / 2
            if abs(to - b) < CLOSE or high - low < CLOSE:
                still.discard(k)
            at[k] = to
    final = {r["kind"]: r for r in slopes(rows, kind, logits, target, current(at)).collect()} if first else {}
    made = [(k, r["n"], min(HIGH, max(LOW, 1 / at[k])), r["loss"]) for k, r in final.items()]
    return spark.createDataFrame(made, f"{kind} {rows.schema[kind].dataType.simpleString()}, n long, temperature double, loss double")
