"""Evaluation, calibration, audits and request metrics: aggregations with fixed definitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of gates and of audit verdicts.
CONFIDENT_RIGHT, CONFIDENT_WRONG, FUNDAMENTALS = 0.90, 0.02, 12
TRUSTED_N, TRUSTED_ACCURACY = 50, 0.90
REVIEW_RATE, FEW, BAD_HIGH, UNCLEAR_HIGH, BAD_SOME = 0.15, 20, 0.25, 0.40, 0.10
WARN_FEW, WARN_SHARE = 20, 0.8
# Half the width of a quantile's bracket, and the accuracy of its ends (rank error one part in so many).
BRACKET, RANK_ACCURACY = 0.0005, 20000
# Rows of a group up to which all its values are sorted.
FEW_TO_SORT = 10_000


def share(hit: Column) -> Column:
    """Share of true among all rows, null counted as false; null without rows."""
    return F.avg(F.coalesce(hit, F.lit(False)).cast("int").cast("double"))


def gate_metrics(answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns pred, sure (null: unsure), gold: accuracy, confident_right, confident_wrong and n."""
    right, sure = F.col("pred") == F.col("gold"), F.col("sure")
    return answers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(right).alias("accuracy"), share(sure == F.col("gold")).alias("confident_right"), share(sure.isNotNull() & (sure != F.col("gold"))).alias("confident_wrong")
    )


def gate_failures(metrics: DataFrame) -> DataFrame:
    """``failures`` of each row of metrics and whether it passes."""
    failures = F.array_compact(
        F.array(
            F.when(F.col("confident_right") < CONFIDENT_RIGHT, F.lit("too few confident and right")),
            F.when(F.col("confident_wrong") > CONFIDENT_WRONG, F.lit("too many confident and wrong")),
        )
    )
    return metrics.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def per_type_and_total(answers: DataFrame, kind: str) -> DataFrame:
    """Accuracy by type and over all types (the row ``total``)."""
    return (
        answers.rollup(kind)
        .agg(F.grouping(kind).alias("g"), F.count(F.lit(1)).alias("n"), share(F.col("pred") == F.col("gold")).alias("accuracy"))
        .select(F.when(F.col("g") == 1, "total").otherwise(F.col(kind)).alias(kind), "n", "accuracy")
    )


#: Fixed value: the accuracy below which a training run is refused.
LEAST_ACCURACY = 0.70


def accuracy_gate(report: DataFrame, kind: str, least: float = LEAST_ACCURACY) -> DataFrame:
    """The row ``total`` of ``per_type_and_total`` with ``passed``; null accuracy (no answers) does not pass."""
    return report.where(F.col(kind) == "total").withColumn("passed", F.coalesce(F.col("accuracy") >= least, F.lit(False)))


def calibration_table(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, accuracy and trust of each judge and type; unanswered rows count as wrong."""
    t = judged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.col("verdict") == F.col("gold")).alias("accuracy"))
    return t.withColumn("trusted", (F.col("n") >= TRUSTED_N) & (F.col("accuracy") >= TRUSTED_ACCURACY))


def audit_verdict(disagreements: Column) -> Column:
    return F.when(disagreements >= 2, "BAD").when(disagreements == 1, "SUSPECT").otherwise("OK")


def review_sources(verdicts: DataFrame, source: str = "source") -> DataFrame:
    t = verdicts.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "BAD").alias("bad"), F.count_if(F.col("verdict") == "SUSPECT").alias("suspect"))
    rate = F.col("bad") / F.col("n")
    return t.withColumn("bad_rate", F.round(rate, 4)).withColumn("decision", F.when(rate >= REVIEW_RATE, "REVIEW").otherwise("KEEP"))


def source_decision(n: Column, bad: Column, unclear: Column) -> Column:
    """Decision ladder over counts of a source."""
    b, u = F.try_divide(bad, n), F.try_divide(unclear, n)
    return F.when(n < FEW, "INSUFFICIENT").when((b >= BAD_HIGH) | (u >= UNCLEAR_HIGH), "DROP").when(b >= BAD_SOME, "REVIEW").otherwise("KEEP")


def label_report(rows: DataFrame, question: str, label: str) -> DataFrame:
    """Counts of each question's labels, most common first (ties by label), the largest share, and warnings."""
    counts = rows.groupBy(question, label).agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(question).agg(
        F.sum("c").alias("n"), F.max("c").alias("top"), F.count(F.lit(1)).alias("labels"), F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col(label).alias("label")))).alias("l")
    )
    text = F.array_join(F.transform("l", lambda x: F.concat(x["label"].cast("string"), F.lit("="), (-x["c"]).cast("string"))), ", ")
    few, one_sided = F.col("n") < WARN_FEW, (F.col("n") > 1) & (F.col("top") / F.col("n") > WARN_SHARE)
    return per.select(question, "n", text.alias("counts"), F.round(F.col("top") / F.col("n"), 4).alias("top_share"), few.alias("few"), one_sided.alias("one_sided"))


def mean_reciprocal_rank(scored: DataFrame, query: str, score: str, relevant: str, tie: str) -> DataFrame:
    """mrr and hit@1 of the first relevant candidate of each query; equal scores in order of ``tie``."""
    w = Window.partitionBy(query).orderBy(F.desc(score), tie)
    first = scored.withColumn("rank", F.row_number().over(w)).where(F.col(relevant)).groupBy(query).agg(F.min("rank").alias("rank"))
    return first.agg(F.count(F.lit(1)).alias("queries"), F.avg(1 / F.col("rank")).alias("mrr"), share(F.col("rank") == 1).alias("hit_at_1"))


def floor_quantiles(rows: DataFrame, by: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Quantiles by floor index, without interpolation: the value at position floor(p * (n - 1)) of the sorted values.

    A first pass brackets each point by approximate quantiles, whose rank error is bounded far below the bracket's width. A second one
    counts the values below each bracket and the distinct values within; only the latter, a thousandth of a group, are sorted."""
    keys = [f"_g{i}" for i in range(len(by))]
    seen = rows.where(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).alias("_v"))
    ends = []
    for i, p in enumerate(points.values()):
        low, high = p - BRACKET, p + BRACKET
        least, most = F.min("_v"), F.max("_v")
        few = F.count(F.lit(1)) <= FEW_TO_SORT  # a position may be off by one rank, which the bracket of a small group would not cover
        ends.append((F.when(few, least).otherwise(F.percentile_approx("_v", low, RANK_ACCURACY)) if low > 0 else least).alias(f"_low{i}"))
        ends.append((F.when(few, most).otherwise(F.percentile_approx("_v", high, RANK_ACCURACY)) if high < 1 else most).alias(f"_high{i}"))
    brackets = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *ends)
    names = brackets.columns[len(keys) :]
    other = brackets.select(*[F.col(k).alias(f"_of{k}") for k in keys], *names)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    inside = [F.col("_v").between(F.col(f"_low{i}"), F.col(f"_high{i}")) for i in range(len(points))]
    near = F.when(reduce(or_, inside), F.col("_v")).alias("_near")  # null: in no bracket, counted only
    below = [F.count_if(F.col("_v") < F.col(f"_low{i}")).alias(f"_below{i}") for i in range(len(points))]
    placed = seen.join(other if keys else F.broadcast(other), same)
    counts = placed.groupBy(*keys, near).agg(F.count(F.lit(1)).alias("_c"), *[F.any_value(x).alias(x) for x in names], *below)
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_near")
    found = []
    for i, (name, p) in enumerate(points.items()):
        within = F.col("_near").between(F.col(f"_low{i}"), F.col(f"_high{i}"))
        reach = F.sum(f"_below{i}").over(whole) + F.sum(F.when(within, F.col("_c")).otherwise(0)).over(upto)
        counts = counts.withColumn(f"_reach{i}", reach)
        found.append(F.min(F.when(within & (F.floor(F.lit(p) * (F.col("_n") - 1)) < F.col(f"_reach{i}")), F.col("_near"))).alias(name))
    return counts.groupBy(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)]).agg(F.max("_n").alias("n"), *found)


def last_n(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The last ``n`` rows of the whole table: a top-n, kept in each task and merged."""
    return rows.orderBy(*order).limit(n)


def temperature_grid(rows: DataFrame, kind: str, logits: str, label: str, grid: Sequence[float]) -> DataFrame:
    """Mean cross-entropy of each type at each temperature of the grid, and the best temperature (1.0 below ten rows).

    The grid is a fixed, small table: each row is scored at its points inside the row."""
    top = F.array_max(logits)

    def loss(t: Column) -> Column:
        total = F.aggregate(F.transform(logits, lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, x: a + x)
        return F.log(total) - (F.get(F.col(logits), F.col(label)) - top) / t

    points = F.explode(F.array(*[F.lit(float(t)) for t in grid]))
    losses = rows.withColumn("temperature", points).groupBy(kind, "temperature").agg(F.avg(loss(F.col("temperature"))).alias("loss"), F.count(F.lit(1)).alias("n"))
    best = losses.groupBy(kind).agg(F.min(F.struct(F.round("loss", 9).alias("loss"), "temperature")).alias("b"), F.max("n").alias("n"))
    return best.select(kind, "n", F.when(F.col("n") < 10, F.lit(1.0)).otherwise(F.col("b.temperature")).alias("temperature"), F.round("b.loss", 6).alias("loss"))


def request_totals(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, errors, latency sum and mean over a request log (columns ms, error)."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.round(F.sum("ms"), 2).alias("ms_sum"), F.round(F.avg("ms"), 4).alias("ms_avg")
    )


def exposition(snapshot: DataFrame, prefix: str) -> DataFrame:
    """Text exposition lines of a one-row snapshot, one for each column."""
    cells = [F.format_string(f"{prefix}_{c} %s", F.col(c).cast("string")) for c in snapshot.columns]
    return snapshot.select(F.explode(F.array(*cells)).alias("line"))
