"""Running class balance: rows in an order are taken unless their answer is ahead of the other by more than a margin.

The balance so far is a counter held between two bounds, and what a stretch of rows does to it is ``min(max(s + a, low), high)``; two such
stretches are one of the same form. So each part of the order is summed up by three numbers at once, a fold over the parts (a bounded number)
gives the counter at the start of each, and a second pass decides row by row. No task holds more than an Arrow batch of its part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.operators.datasets import fresh

MARGIN, PARTS = 20, 64


def effect(answers: Iterator[bool], most: int, start: tuple[int, int, int] | None = None) -> tuple[int, int, int]:
    """(a, low, high) of a stretch of answers for counters held to -most ... most."""
    a, low, high = start or (0, -most, most)
    for y in answers:
        if y:
            a, low, high = a + 1, min(low + 1, most), min(high + 1, most)
        else:
            a, low, high = a - 1, max(low - 1, -most), max(high - 1, -most)
    return a, low, high


def steer(rows: DataFrame, label: str, order: str, by: Sequence[str] = (), margin: int = MARGIN, parts: int = PARTS, name: str = "taken") -> DataFrame:
    """``rows`` with ``name``: whether the row is taken if, for each group of ``by``, rows come in the order of a number or time ``order`` and
    one with answer true (false) is taken unless more than ``margin`` more of its kind were taken than of the other so far.

    Rows without an answer are taken and count for neither; of rows with equal order the false ones come first; null orders come first."""
    most = margin + 1
    group, part, place, y, start = fresh(rows, "_group", "_part", "_place", "_y", "_start")
    at = F.col(f"`{order}`").cast("double")
    cuts = rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    tagged = rows.withColumns(
        {
            group: F.to_json(F.struct(*[F.col(f"`{b}`").alias(f"k{i}") for i, b in enumerate(by)])) if by else F.lit(""),
            part: F.coalesce(F.size(F.filter(bounds, lambda b: b < at)), F.lit(0)),
            place: at,
            y: F.col(f"`{label}`").cast("boolean"),
        }
    )
    key = [group, part]

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, so_far, out = None, None, []
        for batch in batches:
            for k, some in batch.groupby(key, sort=False):
                if k != now:
                    out += [] if now is None else [(*now, *so_far)]
                    now, so_far = k, None
                so_far = effect(some[y].tolist(), most, so_far)
        if now is not None:
            out.append((*now, *so_far))
        yield pd.DataFrame(out, columns=["g", "p", "a", "low", "high"])

    answered = tagged.where(F.col(y).isNotNull()).select(*key, place, y)
    in_order = lambda df: df.repartition(*key).sortWithinPartitions(*key, F.col(place).asc_nulls_first(), F.col(y).asc_nulls_first())
    effects = in_order(answered).mapInPandas(sum_up, "g string, p int, a long, low long, high long")
    listed = effects.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("p", "a", "low", "high"))).alias("e"))  # at most ``parts`` a group
    fold = lambda e: F.aggregate(e, F.lit(0).cast("long"), lambda s, x: F.least(F.greatest(s + x["a"], x["low"]), x["high"]))
    starts = listed.select("g", F.explode(F.transform("e", lambda x, i: F.struct(x["p"].alias("p"), fold(F.slice("e", F.lit(1), i)).alias("s")))).alias("x"))
    starts = starts.select(F.col("g").alias(f"{group}2"), F.col("x.p").alias(f"{part}2"), F.col("x.s").alias(start))
    ready = tagged.join(starts, (F.col(group) == F.col(f"{group}2")) & (F.col(part) == F.col(f"{part}2")), "left").drop(f"{group}2", f"{part}2")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = None, 0
        for batch in batches:
            taken = np.ones(batch.num_rows, bool)
            columns = [batch.column(c).to_pylist() for c in (group, part, y, start)]
            for i, (g, p, answer, begin) in enumerate(zip(*columns, strict=True)):
                if (g, p) != now:
                    now, s = (g, p), begin or 0
                if answer is None:
                    continue
                taken[i] = s < most if answer else s > -most
                s += (1 if answer else -1) if taken[i] else 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(taken)], names=[*own, name])

    own = rows.columns
    schema = rows.select(*[F.col(f"`{c}`") for c in own], F.lit(True).alias(name)).schema
    return in_order(ready).mapInArrow(decide, schema)
