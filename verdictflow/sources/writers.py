"""Writers: JSON lines, split files, append-only checkpoints with resume, manifests, reports, published versions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_json_lines(rows: DataFrame, path: str, gzip: bool = False, split: str | None = None) -> None:
    """JSON lines, one folder for each value of ``split``."""
    w = rows.write.mode("overwrite")
    if gzip:
        w = w.option("compression", "gzip")
    if split:
        w = w.partitionBy(split)
    w.json(path)


def append_checkpoint(done: DataFrame, path: str) -> None:
    done.write.mode("append").parquet(path)


def left_to_do(items: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Items that the checkpoint does not hold; all of them if there is none yet."""
    try:
        done = items.sparkSession.read.parquet(path).select(*keys).distinct()
    except AnalysisException:
        return items
    return items.join(done, keys, "left_anti")


def latest(path_rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row written for each key."""
    columns = path_rows.columns
    return path_rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")


def manifest(rows: DataFrame, by: list[str], size: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")] + ([F.sum(F.octet_length(size)).alias("bytes")] if size else [])
    return rows.groupBy(*by).agg(*aggs)


def markdown_table(report: DataFrame, most: int = 1000) -> str:
    """A report (an aggregate of bounded size) as a Markdown table, in the order of its columns. One of more than ``most`` rows is an error."""
    rows = report.orderBy(*report.columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the report has more than {most} rows")
    head = [report.columns, ["---"] * len(report.columns)]
    return "\n".join("| " + " | ".join(str(c) for c in r) + " |" for r in [*head, *[list(r) for r in rows]])


def publish(rows: DataFrame, base: str, pointers: str) -> str:
    """Write a new version beside the others, then append it to the pointer table; readers take the latest pointer."""
    version = uuid.uuid4().hex
    rows.write.parquet(f"{base}/{version}")
    rows.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published")).write.mode("append").parquet(pointers)
    return version


def in_shards(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """``rows`` as JSON lines with the shard each belongs to: shard, value, bytes (with the line's end). Rows are in the order of the key's
    digest, and no shard has more than ``limit`` bytes. A ValueError if a single row has.

    Bytes before a row are summed up over parts of the digest first, then within a part, so no task holds all rows."""
    lines = rows.select(F.sha2(key.cast("string").cast("binary"), 256).alias("d"), F.to_json(F.struct("*")).alias("value"))
    lines = lines.select("*", F.substring("d", 1, 4).alias("p"), (F.octet_length("value") + 1).cast("long").alias("bytes"))
    parts = lines.groupBy("p").agg(F.sum("bytes").alias("size"), F.max("bytes").alias("longest"))
    before = parts.select("p", "longest", (F.sum("size").over(Window.orderBy("p")) - F.col("size")).alias("before"))  # at most 65,536 rows
    longest = parts.agg(F.coalesce(F.max("longest"), F.lit(1)).alias("most")).first()["most"]
    if longest > limit:
        raise ValueError(f"a row has {longest} bytes, more than a shard may have")
    within = F.sum("bytes").over(Window.partitionBy("p").orderBy("d", "value").rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("before") + F.coalesce(within, F.lit(0))
    # A shard is what starts within a stretch that leaves room for the longest row to end.
    return lines.join(before.select("p", "before"), "p").select(F.floor(start / (limit - longest + 1)).alias("shard"), "value", "bytes")


def shard_manifest(shards: DataFrame) -> DataFrame:
    """shard, rows, bytes of lines in shards."""
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))


def publish_shards(rows: DataFrame, key: Column, limit: int, base: str, pointers: str, check: Callable[[DataFrame], None] | None = None) -> str:
    """Write ``rows`` as gzip JSON lines in shards of at most ``limit`` bytes with a manifest, compare what was written with the manifest, then
    append the version to the pointer table. Until that, readers have the version before; a failed write or check leaves it in place."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    shards = in_shards(rows, key, limit)
    shards.select("shard", "value").repartition("shard").write.partitionBy("shard").option("compression", "gzip").text(f"{base}/{version}/shards")
    shard_manifest(shards).write.parquet(f"{base}/{version}/manifest")
    written = spark.read.schema("value string, shard long").text(f"{base}/{version}/shards")
    counted = shard_manifest(written.select("shard", (F.octet_length("value") + 1).cast("long").alias("bytes")))
    wanted = spark.read.parquet(f"{base}/{version}/manifest")
    wrong = counted.exceptAll(wanted).union(wanted.exceptAll(counted)).limit(1).collect()
    if wrong:
        raise OSError(f"version {version} is not what was written: {wrong[0].asDict()}")
    if check is not None:
        check(written)
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published")).write.mode("append").parquet(pointers)
    return version


def write_leaked_keys(leaked: DataFrame, report: DataFrame, path: str) -> None:
    """Sorted distinct leaked keys: those that remove questions under ``exact``, those that are only reported in side files ``state`` and
    ``masked``, and the report by test file under ``report``."""
    for level in ("exact", "state", "masked"):
        leaked.where(F.col("level") == level).select("key").distinct().orderBy("key").write.mode("overwrite").text(f"{path}/{level}")
    report.write.mode("overwrite").json(f"{path}/report")


def current(spark: SparkSession, base: str, pointers: str, back: int = 0) -> DataFrame:
    """The published version, or the one ``back`` publications ago (rollback)."""
    found = spark.read.parquet(pointers).orderBy(F.desc("published")).limit(back + 1).collect()
    if len(found) <= back:
        raise LookupError("no such version")
    return spark.read.parquet(f"{base}/{found[back]['version']}")


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))
