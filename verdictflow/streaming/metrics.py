"""Streaming counterparts of the request metrics: running counters, the last N per key, scoring of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of ``folder`` as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def counters(stream: DataFrame, kind: str, value: str) -> DataFrame:
    """Running totals since the start by kind; no window and no watermark, so state grows with the kinds only."""
    return stream.groupBy(kind).agg(F.count(F.lit(1)).alias("requests"), F.sum(value).alias("total"))


def windowed(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests of each kind and window; late rows are counted while the watermark allows (not an operator of the reference)."""
    w = F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("requests")).select(F.col("w.start").alias("start"), kind, "requests")


def last_n_per_key(stream: DataFrame, key: str, ident: str, value: str, n: int = 200) -> DataFrame:
    """Rows (key, seen, last): how many were seen and the last ``n`` values by id, as ring buffers in state."""
    key_type, value_type = stream.schema[key].dataType.simpleString(), stream.schema[value].dataType.simpleString()
    id_type = stream.schema[ident].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, ids, values = state.get if state.exists else (0, [], [])
        ring = list(zip(ids, values, strict=True))
        for b in batches:
            seen += len(b)
            ring = sorted(ring + list(zip(b[ident].tolist(), b[value].tolist(), strict=True)))[-n:]
        state.update((seen, [i for i, _ in ring], [v for _, v in ring]))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "last": [[v for _, v in ring]]})

    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} {key_type}, seen long, last array<{value_type}>", f"seen long, ids array<{id_type}>, vals array<{value_type}>", "update", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Run over what is there now, into the in-memory table ``name`` (tests and reports; its rows are the report's)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
