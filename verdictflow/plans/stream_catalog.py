"""Queries that run as streams over the events table and return the final state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.plans.catalog import query
from verdictflow.streaming import metrics, scoring

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.read_stream(spark, f"{sf_dir}/events.parquet", EVENTS)


def _checkpoint(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only in local mode, where that is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="verdictflow-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("SELECT event_type, count(*) AS requests, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"counters_{uuid.uuid4().hex}"
    metrics.run_available(metrics.counters(_events(spark, sf_dir), "event_type", "value"), name, "complete", _checkpoint(spark))
    return spark.table(name).select("event_type", "requests", F.round("total", 2).alias("total"))


@query("SELECT event_type, count(*) AS seen, round(list_sum(list(value ORDER BY event_id)[greatest(1, count(*) - 199):]), 2) AS last_sum FROM events GROUP BY event_type")
def stream_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"last_{uuid.uuid4().hex}"
    metrics.run_available(metrics.last_n_per_key(_events(spark, sf_dir), "event_type", "event_id", "value"), name, "update", _checkpoint(spark))
    latest = spark.table(name).groupBy("event_type").agg(F.max("seen").alias("seen"), F.max_by("last", "seen").alias("last"))
    return latest.select("event_type", "seen", F.round(F.aggregate("last", F.lit(0.0), lambda a, x: a + x), 2).alias("last_sum"))


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'v1' ELSE 'v2' END AS model_version, round(CASE WHEN event_id % 4 = 0 THEN value ELSE 2 * value + length(event_type) END, 4) AS score FROM events"
)
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a running stream into which the events come in four deliveries, while the model is swapped after the first, and by a version
    that cannot be loaded after the second. What is swapped follows the deliveries, not the number of files, which is up to Spark."""
    home = _checkpoint(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    weights = {"v1": (1, 0), "v2": (2, 1), "v3": None}

    def deliver(k: int) -> None:
        # every row comes once, also those with negative ids and without one
        events.where(F.pmod(F.coalesce("event_id", F.lit(1)), F.lit(4)) == k).write.mode("append").parquet(f"{home}/events")

    def announce(version: str) -> None:
        spark.createDataFrame([(version, weights[version] or [])], "version string, weights array<int>").write.mode("append").parquet(f"{home}/pointers/{version}")

    def pointer() -> str:
        return spark.read.option("recursiveFileLookup", "true").parquet(f"{home}/pointers").agg(F.max("version")).first()[0]

    def load(version: str) -> scoring.Model:
        scale, letters = spark.read.parquet(f"{home}/pointers/{version}").first()["weights"]
        encode = lambda df: df.withColumn("x", F.col("value") * scale + (F.length("event_type") * letters if letters else 0))
        return scoring.Model(version, encode, lambda df: df.select("event_id", F.round("x", 4).alias("score")))

    models = scoring.ModelSource(pointer, load, interval=0, fallback_interval=0)
    announce("v1")
    deliver(0)
    stream = spark.readStream.schema(events.schema).parquet(f"{home}/events")
    running = scoring.stream_scores(stream, models, f"{home}/scores", f"{home}/state", available_now=False)
    try:
        running.processAllAvailable()
        for k, version in ((1, "v2"), (2, "v3"), (3, None)):
            if version:
                announce(version)
            deliver(k)
            running.processAllAvailable()
    finally:
        running.stop()
    if set(models.failed) != {"v3"}:
        raise RuntimeError(f"rows were scored by an older model: {models.failed}")
    return spark.read.parquet(f"{home}/scores").select("event_id", "model_version", "score")
