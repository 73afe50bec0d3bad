"""Queries over the audit operators, each with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.operators import audit as A
from verdictflow.operators import evaluation as E
from verdictflow.plans.catalog import query, read


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def drop_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.drop_sources(read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("SELECT o_orderkey AS qid, o_custkey AS row_id, l_returnflag AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 2 AND l_returnflag <> 'N'")
def gold_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").where("l_linenumber = 2")
    gold = gold.select(F.col("l_orderkey").alias("qid"), F.nullif("l_returnflag", F.lit("N")).alias("label"))
    return A.join_gold(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("row_id")), gold, ["qid"])


@query(
    "SELECT o_orderkey AS key, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'A' || o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN 'B' || o_orderstatus END) AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN 'a' WHEN o_orderkey % 2 = 0 THEN 'b' END AS judge FROM orders"
)
def preferred_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    judged = lambda name, every: orders.where(F.col("key") % every == 0).select("key", F.concat(F.lit(name), "o_orderstatus").alias("verdict"))
    return A.prefer_first(orders.select("key"), judged("A", 3), judged("B", 2), "key", "verdict")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def forbidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return A.without_facts(read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), gate, ["o_custkey"])


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber = 7 AND b.l_quantity = a.l_quantity AND nullif(b.l_returnflag, 'N') IS NOT DISTINCT FROM nullif(a.l_returnflag, 'N') AND b.l_linestatus = a.l_linestatus)"
)
def forbidden_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus").withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return A.without_facts(rows, rows.where("l_linenumber = 7"), ["l_quantity", "flag", "l_linestatus"]).drop("flag", "l_linestatus")


@query(
    "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY sha256('7:' || CAST(o_orderkey AS VARCHAR)) LIMIT 50"
)
def redraw_untaken(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return A.redraw(read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), taken, ["o_custkey"], 50, A.hash_order(F.col("o_orderkey"), 7)).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('3:' || CAST(o_orderkey AS VARCHAR))) AS p, count(*) OVER () AS n FROM orders) WHERE p <= least(400, n // 10)")
def calibration_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.calibration_holdout(read(spark, sf_dir, "orders", "o_orderkey"), F.col("o_orderkey"), 3)


@query("SELECT c_custkey, sha256('5:' || CAST(c_custkey AS VARCHAR)) AS place_key FROM customer")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shuffled(read(spark, sf_dir, "customer", "c_custkey"), F.col("c_custkey"), 5)


_OPTIONS = "list_transform(list_sort(list_transform(['yes', 'no', 'maybe', 'never'], lambda o: struct_pack(h := sha256('9:' || CAST(p_partkey AS VARCHAR) || ':' || o), o := o))), lambda x: x.o)"


@query(f"SELECT p_partkey, array_to_string({_OPTIONS}, '|') AS options, array_to_string(({_OPTIONS})[1:2], '|') AS two, list_contains(({_OPTIONS})[1:2], 'yes') AS has_yes FROM part")
def option_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    options, key = F.array(*map(F.lit, ("yes", "no", "maybe", "never"))), F.col("p_partkey")
    two = A.sample_options(options, key, 9, 2)
    return read(spark, sf_dir, "part", "p_partkey").select(
        "p_partkey", F.array_join(A.shuffle_options(options, key, 9), "|").alias("options"), F.array_join(two, "|").alias("two"), F.array_contains(two, "yes").alias("has_yes")
    )


@query("SELECT p_partkey, p_size || '|' || p_brand || '|' || p_type AS listed FROM part")
def options_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.create_map(F.lit("b"), "p_brand", F.lit("c"), "p_type", F.lit("a"), F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size").select("p_partkey", F.array_join(A.options_by_key(options), "|").alias("listed"))


@query("SELECT p_partkey, p_type AS stripped FROM part")
def strip_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit(" `\"'"), "p_type", F.lit("'` "))
    return read(spark, sf_dir, "part", "p_partkey", "p_type").select("p_partkey", A.strip_quotes(quoted).alias("stripped"))


@query("SELECT l_suppkey, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM lineitem GROUP BY l_suppkey")
def rate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rate_report(read(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag"), "l_suppkey", F.col("l_returnflag") == "R")


@query("SELECT o_custkey, median(CAST(o_totalprice AS DOUBLE)) AS median, count(*) AS runs FROM orders GROUP BY o_custkey")
def median_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.median_of_runs(read(spark, sf_dir, "orders", "o_custkey", "o_totalprice").withColumn("v", F.col("o_totalprice").cast("double")), ["o_custkey"], "v")


@query("SELECT l_suppkey, max(abs(CAST(l_quantity AS DOUBLE) - 25.5)) / 127.0 AS scale FROM lineitem GROUP BY l_suppkey")
def abs_max_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity").withColumn("w", F.col("l_quantity").cast("double") - 25.5)
    return A.abs_max_scales(rows, "l_suppkey", "w")


@query(
    "SELECT o_orderpriority, max(n) AS n, max(v) FILTER (WHERE p = CAST(floor(0.5 * (n - 1)) AS BIGINT)) AS p50, max(v) FILTER (WHERE p = CAST(floor(0.95 * (n - 1)) AS BIGINT)) AS p95, max(v) FILTER (WHERE p = CAST(floor(0.99 * (n - 1)) AS BIGINT)) AS p99 FROM (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS p, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY o_orderpriority"
)
def stage_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice").withColumn("v", F.col("o_totalprice").cast("double"))
    return E.floor_quantiles(rows, ["o_orderpriority"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT DISTINCT o_custkey AS key, o_orderstatus AS label FROM orders WHERE o_orderkey % 4 = 0 UNION SELECT c_custkey, 'F' FROM customer WHERE c_mktsegment = 'BUILDING'")
def trusted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    rows = rows.select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("label"), F.when(F.col("o_orderkey") % 4 == 0, True).when(F.col("o_orderkey") % 4 == 1, False).alias("agree"))
    basic = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"), F.lit("F").alias("label"))
    return A.trusted_keys(rows, basic)


_JUDGED = "SELECT o_orderkey AS key, o_orderstatus AS gold, CASE WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS label, (o_orderkey % 11) / 10.0 AS conf FROM orders"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderkey") % 5 == 0, "P").otherwise(F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("gold"), label.alias("label"), ((F.col("o_orderkey") % 11) / F.lit(10.0)).alias("conf"))


@query(f"SELECT key FROM ({_JUDGED}) WHERE label <> gold AND conf >= 0.9")
def stage_one_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stage_one_conflicts(_judged(spark, sf_dir)).select("key")


@query(f"SELECT key, CASE WHEN label <> gold AND conf >= 0.9 THEN 'conflict' ELSE 'sample' END AS why FROM ({_JUDGED}) WHERE key % 7 = 0 OR (label <> gold AND conf >= 0.9)")
def stage_two_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    return A.stage_two(judged.where("key % 7 = 0"), A.stage_one_conflicts(judged))


@query(
    "SELECT l_orderkey, l_linenumber, coalesce(l_returnflag <> 'N' AND l_linestatus <> 'N', false) AS bad, coalesce(l_linenumber <= 2 AND CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey % 4 END <= 2, false) AS unclear FROM lineitem"
)
def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 4)
    bad, unclear = A.audit_flags(F.col("l_linenumber"), second, F.col("l_returnflag"), F.col("l_linestatus"), F.lit("N"))
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").select("l_orderkey", "l_linenumber", bad.alias("bad"), unclear.alias("unclear"))


@query("SELECT l_suppkey AS source FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') / CAST(count(*) AS DOUBLE) >= 0.15")
def flagged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = read(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag").select(F.col("l_suppkey").alias("source"), F.when(F.col("l_returnflag") == "R", "BAD").otherwise("OK").alias("verdict"))
    return A.flagged_sources(E.review_sources(verdicts))
