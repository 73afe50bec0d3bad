"""Queries over steering, calibration and shards, each with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.operators import calibration, steering
from verdictflow.plans.catalog import query, read
from verdictflow.sources import writers


@query(
    "WITH RECURSIVE r AS (SELECT doc_id, quality, CAST(toxic AS BOOLEAN) AS y, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS n FROM labels), "
    "s AS (SELECT quality, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS doc_id, 0 AS d, true AS taken FROM (SELECT DISTINCT quality FROM r) UNION ALL "
    "SELECT r.quality, r.n, r.doc_id, CASE WHEN y AND d <= 3 THEN d + 1 WHEN NOT y AND d >= -3 THEN d - 1 ELSE d END, CASE WHEN y THEN d <= 3 WHEN NOT y THEN d >= -3 ELSE true END FROM s JOIN r ON r.quality IS NOT DISTINCT FROM s.quality AND r.n = s.n + 1) "
    "SELECT doc_id, quality, taken FROM s WHERE n > 0"
)
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents taken in the order of their ids, toxic ones at most four ahead or behind, for each quality apart."""
    return steering.steer(read(spark, sf_dir, "labels"), "toxic", "doc_id", ["quality"], margin=3).select("doc_id", "quality", "taken")


@query(
    "WITH r AS (SELECT c_mktsegment, [(c_custkey * 3) % 17 / 4.0, (c_custkey * 5) % 17 / 4.0, (c_custkey * 7) % 17 / 4.0] AS z, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 % 3 ELSE list_position([(c_custkey * 3) % 17, (c_custkey * 5) % 17, (c_custkey * 7) % 17], greatest((c_custkey * 3) % 17, (c_custkey * 5) % 17, (c_custkey * 7) % 17)) - 1 END AS y FROM customer), "
    "g AS (SELECT CAST(i AS DOUBLE) / 100 AS t FROM range(10, 1001) x(i)), "
    "s AS (SELECT c_mktsegment, t, avg((z[1] * exp(z[1] / t) + z[2] * exp(z[2] / t) + z[3] * exp(z[3] / t)) / (exp(z[1] / t) + exp(z[2] / t) + exp(z[3] / t)) - z[y + 1]) AS slope FROM r, g GROUP BY 1, 2) "
    "SELECT c_mktsegment, max(t) AS at_least, (SELECT count(*) FROM r WHERE r.c_mktsegment = s.c_mktsegment) AS n FROM s WHERE slope >= 0 GROUP BY 1"
)
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature of each segment, cut to a hundredth: the SQL finds where the slope of the loss changes its sign on a dense grid."""
    i = F.col("c_custkey")
    z = F.array(*[((i * k) % 17).cast("double") / 4 for k in (3, 5, 7)])
    best = F.array_position(z, F.array_max(z)).cast("int") - 1
    rows = read(spark, sf_dir, "customer").select("c_mktsegment", z.alias("z"), calibration.one_hot(F.when(i % 3 == 0, (i % 5 % 3).cast("int")).otherwise(best), F.lit(3)).alias("t"))
    fitted = calibration.fit_temperatures(rows, "c_mktsegment", "z", "t")
    return fitted.select("c_mktsegment", (F.floor(F.col("temperature") * 100) / 100).alias("at_least"), "n")


@query(
    "WITH l AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS d, '{\"o_orderkey\":' || CAST(o_orderkey AS VARCHAR) || ',\"o_orderpriority\":\"' || o_orderpriority || '\"}' AS value FROM orders), "
    "b AS (SELECT *, octet_length(encode(value)) + 1 AS bytes FROM l), s AS (SELECT *, sum(bytes) OVER (ORDER BY d, value) - bytes AS start FROM b) "
    "SELECT CAST(floor(start / (4096 - (SELECT max(bytes) FROM b) + 1)) AS BIGINT) AS shard, count(*) AS n_rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY 1"
)
def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines in shards of at most 4,096 bytes."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    return writers.shard_manifest(writers.in_shards(rows, F.col("o_orderkey"), 4096)).withColumnRenamed("rows", "n_rows")
