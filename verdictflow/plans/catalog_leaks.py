"""Queries over leaks by key and by containment, each with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.operators import containment, leaks
from verdictflow.plans.catalog import query, read

# Orders as decision questions: even keys train, odd keys test. States are objects in two key orders or plain text; every fifth test question
# has no type. The SQL spells out what the forms come to: the key orders, tokens and canonical text of each.
_PRICE = "CAST(CAST(floor(o_totalprice / 40000) AS INTEGER) AS VARCHAR)"
_ROWS = f"""
WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, {_PRICE} AS n, o_custkey AS c FROM orders),
q AS (SELECT k, k % 2 = 1 AS test,
    CASE WHEN k % 2 = 1 THEN CASE WHEN c % 2 = 0 THEN 'gate.jsonl' ELSE 'eval.csv' END ELSE 'train-' || CAST(c % 3 AS VARCHAR) END AS file,
    CASE WHEN c % 2 = 0 THEN 'gate' ELSE 'eval' END AS kind,
    CASE WHEN k % 2 = 1 AND k % 5 = 0 THEN '*' WHEN k % 3 = 0 THEN 'noul' WHEN k % 3 = 1 THEN 'choice' ELSE 'score' END AS type,
    CASE WHEN c % 3 = 0 THEN 'price: ' || n || '; Priority: ' || p || '; status: ' || s
         WHEN c % 3 = 1 THEN '{{"status": "' || s || '", "Priority": "' || p || '", "price": ' || n || '}}'
         ELSE '{{"Priority": "' || p || '", "price": ' || n || ', "status": "' || s || '"}}' END AS state,
    CASE WHEN c % 3 = 0 THEN 'price: ' || n || '; Priority: ' || p || '; status: ' || s
         ELSE '{{"Priority":"' || p || '","price":' || n || ',"status":"' || s || '"}}' END AS canonical,
    '  Which ' || CASE WHEN k % 4 < 2 THEN 'team' ELSE 'TEAM   takes it' END AS instructions FROM r),
s AS (SELECT k, test, file, kind, type, 'exact' AS level, lower(canonical) || '||' || lower(trim(regexp_replace(instructions, '\\s+', ' ', 'g'))) AS key FROM q
  UNION SELECT k, test, file, kind, type, 'state', array_to_string(regexp_extract_all(lower(x), '[a-z]+|-?[0-9]+(?:\\.[0-9]+)?'), ' ') FROM (SELECT *, unnest([state, canonical]) AS x FROM q)),
m AS (SELECT * FROM s UNION ALL SELECT k, test, file, kind, type, 'masked', regexp_replace(key, '[0-9]+(\\.[0-9]+)?', '#', 'g') FROM s WHERE level = 'state'),
t AS (SELECT DISTINCT level, key || CASE WHEN level = 'exact' THEN '' ELSE '||' || type END AS key, k, file, kind FROM m WHERE test),
u AS (SELECT DISTINCT level, key || CASE WHEN level = 'exact' THEN '' ELSE '||' || unnest([type, '*']) END AS key, file FROM m WHERE NOT test),
l AS (SELECT level, key, min(file) AS file FROM u WHERE (level, key) IN (SELECT (level, key) FROM t) GROUP BY level, key)
"""


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    price = F.floor(F.col("o_totalprice") / 40000).cast("int").cast("string")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = F.concat(F.lit("price: "), price, F.lit("; Priority: "), priority, F.lit("; status: "), status)
    own = F.concat(F.lit('{"status": "'), status, F.lit('", "Priority": "'), priority, F.lit('", "price": '), price, F.lit("}"))
    other = F.concat(F.lit('{"Priority": "'), priority, F.lit('", "price": '), price, F.lit(', "status": "'), status, F.lit('"}'))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(key % 3 == 0, "noul").when(key % 3 == 1, "choice").otherwise("score")
    rows = read(spark, sf_dir, "orders").select(
        key.alias("question_id"),
        F.when(key % 2 == 1, F.when(cust % 2 == 0, "gate.jsonl").otherwise("eval.csv")).otherwise(F.concat(F.lit("train-"), (cust % 3).cast("string"))).alias("file"),
        F.when(cust % 2 == 0, "gate").otherwise("eval").alias("kind"),
        F.when(~((key % 2 == 1) & (key % 5 == 0)), kind).alias("type"),
        F.when(cust % 3 == 0, text).when(cust % 3 == 1, own).otherwise(other).alias("state"),
        F.concat(F.lit("  Which "), F.when(key % 4 < 2, "team").otherwise("TEAM   takes it")).alias("instructions"),
    )
    return rows.where("question_id % 2 = 0"), rows.where("question_id % 2 = 1")


@query(
    _ROWS + "SELECT file, kind, count(DISTINCT k) AS questions, " + ", ".join(f"count(DISTINCT k) FILTER (WHERE level = '{n}' AND (level, key) IN (SELECT (level, key) FROM l)) AS {n}" for n in leaks.LEVELS) + " FROM t GROUP BY file, kind"
)
def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files and how many of their questions are leaked at each level, with wildcard types and both key orders."""
    train, test = _questions(spark, sf_dir)
    return leaks.leak_report(leaks.leaked_keys(train, test), test)


@query(_ROWS + "SELECT file, level, count(*) AS keys FROM l GROUP BY file, level")
def leak_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.contributions(leaks.leaked_keys(*_questions(spark, sf_dir)))


@query(_ROWS + "SELECT k AS question_id FROM s WHERE NOT test AND level = 'exact' AND key NOT IN (SELECT key FROM l WHERE level = 'exact')")
def leaked_questions_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _questions(spark, sf_dir)
    return leaks.without_leaked(train, leaks.leaked_keys(train, test)).select("question_id")


@query(
    "WITH k AS (SELECT row_number() OVER (ORDER BY item_id) AS pos, item_id, lower(substr(text, 1, 24)) AS key FROM benchmark), "
    "h AS (SELECT doc_id, arg_min(item_id, pos) AS label FROM documents JOIN k ON contains(lower(text), key) GROUP BY doc_id) SELECT doc_id, label FROM documents LEFT JOIN h USING (doc_id)"
)
def first_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first benchmark item whose opening a document contains."""
    labels = read(spark, sf_dir, "benchmark", "item_id", "text").select(F.lower(F.substring("text", 1, 24)).alias("key"), F.col("item_id").alias("label"), F.col("item_id").alias("pos"))
    lines = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("text"))
    return containment.first_contained(lines, "text", labels).select("doc_id", "label")
